"""The corpus pipeline: planted cases go, others stay, columns hold."""

import corpus_pipeline
from corpus import empty
from pyspark.sql import functions as F

from riskweave.llm.shared import stage


def planted(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 7)) for _ in range(3000)]
    text = lambda n: [str(x) for x in rng.choice(vocab, n)]
    docs, labels = [], []
    for i in range(240):
        w = text(120)
        toxic = i % 6 == 0
        if toxic:
            for k in (10, 50, 90):
                w.insert(k, ["horrid", "vilest"][i // 6 % 2])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    passage = " ".join(text(60))
    exact = docs[1][1]
    near = docs[2][1].split()
    near[60] = "changed"
    docs += [(1000, exact), (1001, " ".join(near)), (1002, " ".join(text(80)) + " " + passage), (1003, " ".join(text(80)) + " " + passage), (1004, " ".join(text(60)) + " horrid vilest horrid"), (1005, ""), (1006, None)]
    df = spark.createDataFrame([(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    return df, dict(docs), passage


def test_stages_catch_planted_cases(spark, tmp_path):
    df, texts, passage = planted(spark, tmp_path)
    sf, kept, before = f"file://{tmp_path}", {}, df
    for name, step in corpus_pipeline.STAGES[:-1]:
        before = stage(step(spark, before, sf), "test")
        assert before.columns == df.columns
        kept[name] = {r["doc_id"]: r["text"] for r in before.collect()}
    clean = {i for i in range(240) if i % 6}
    assert set(kept["toxicity"]) == clean | {1000, 1001, 1002, 1003, 1005, 1006}
    assert set(kept["simhash_near_dedup"]) >= clean | {1002, 1003} and not {1000, 1001} & set(kept["simhash_near_dedup"])
    after = kept["suffix_array_dedup"]
    assert passage in after[1002] and passage[100:200] not in after[1003] and all(after[i] == texts[i] for i in clean)
    assert set(kept["mix_sources"]) <= set(after) and len(kept["mix_sources"]) > 0.6 * len(after)
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert pieces.select("doc_id").distinct().count() == len(kept["mix_sources"])


def test_run_over_tables(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.count() > 100 and rows.where(F.col("offset") + F.col("length") > 4096).count() == 0


def test_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
