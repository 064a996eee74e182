"""Whole jobs: cases that bounded or approximate searches lose."""

import numpy as np
from corpus import documents

from riskweave.llm import simhash


def jaccard(a, b, size=5):
    x, y = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_similar_finds_every_appended_cut_and_edited_text(spark):
    rng = np.random.default_rng(12)
    vocab = np.array([f"v{i}" for i in range(20000)])
    zipf = 1 / np.arange(1, 20001)
    draw = lambda n: [str(x) for x in rng.choice(vocab, n, p=zipf / zipf.sum())]
    texts, pairs = [], 0
    for k in range(150):
        n = (100, 300, 600)[k % 3]
        a = draw(n)
        if k % 5 < 3:  # a paragraph at the end, before the rest, or cut from the middle
            b = (a + draw(n // 5), draw(n // 5) + a, a[: n // 2] + a[n // 2 + n // 6 :])[k % 5]
        else:
            b = a[:]
            for i in rng.choice(n, max(1, n // 60), replace=False):
                b[i] = "changed"
        texts += [" ".join(a), " ".join(b)]
    got = {r["id"]: r["component"] for r in simhash.similar(documents(spark, texts, False)).collect()}
    for i in range(0, len(texts), 2):
        alike = jaccard(texts[i], texts[i + 1]) >= 0.8
        pairs += alike
        assert (got[i] == got[i + 1]) == alike, i
    assert pairs > 100


def test_similar_leaves_texts_that_share_a_repeated_line(spark):
    rng = np.random.default_rng(14)
    line = "this is the line of nine words repeated often"
    texts = [" ".join([line] * 60 + [f"own{i}x{j}" for j in range(100)]) for i in range(12)]
    # a chain: each is alike to the next only, so the first text of all shared shingles doesn't reach the rest
    words = [f"c{i}" for i in range(180)]
    chain = []
    for k in range(5):
        chain.append(" ".join(words[k * 10 : k * 10 + 100]))
    order = rng.permutation(5)
    got = {r["id"]: r["component"] for r in simhash.similar(documents(spark, texts + [chain[i] for i in order], False)).collect()}
    assert all(got[i] == i for i in range(12))
    assert jaccard(chain[0], chain[1]) >= 0.8 > jaccard(chain[0], chain[2]) and {got[i] for i in range(12, 17)} == {12}


def test_top_k_evaluates_each_of_many_copies_once():
    from riskweave.llm import topk

    rng = np.random.default_rng(13)
    for n_same in (10, 200, 700):
        for _ in range(10):
            rows = rng.integers(-200, 200, (3000, 8)).astype(float)
            # the best score of all, in copies across the first rounds' cuts
            rows[rng.choice(3000, n_same, replace=False)] = 150.0
            better = rng.choice(3000, 60, replace=False)
            rows[better] = 151.0
            ids, q = rng.permutation(3000), np.full((1, 8), 10.0)
            k = 66
            got = [(i, s) for _, i, s in topk.search(q, np.array([-1]), rows, ids, topk.pivots(rows[:500], 4), k)]
            scores = (rows @ q[0]).astype(int)
            assert got == sorted(((int(i), int(s)) for i, s in zip(ids, scores)), key=lambda r: (-r[1], r[0]))[:k]
            # few are asked for, ties go to the smallest ids
            got = [i for _, i, _ in topk.search(q, np.array([-1]), np.full((3000, 8), 3.0), ids, topk.pivots(rows[:500], 4), 5)]
            assert got == [0, 1, 2, 3, 4]


def test_toxicity_catches_misspellings_inside_stems():
    from riskweave.llm import toxicity

    terms = [("rubbish", True), ("dreadfully", True), ("vile", True)]
    m = toxicity.Matcher(terms)
    assert dict(m.match("rubishness")) == dict(m.match("rubbixhest")) == dict(m.match("rubbissh")) == {0: 1}
    assert dict(m.match("rubbishness")) == {0: 0} and dict(m.match("drxadfulyish")) == {1: 2}
    assert m.match("rbbshness") == m.match("vyleness") == ()
    # texts that share stems, with another ending each time
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnop")
    word = lambda n: "".join(rng.choice(letters, n))
    vocab = [word(6) for _ in range(400)]
    def text(bad, stems):
        w = list(rng.choice(vocab, 60))
        for _ in range(bad):
            w.insert(int(rng.integers(0, 60)), str(rng.choice(stems)) + word(3))
        return " ".join(w)
    stems = ["zuqxwish", "wrutzyvl"]
    model = toxicity.learn([text(4, stems) for _ in range(120)], [text(0, stems) for _ in range(300)], 0.2)
    assert all(any(s and t.startswith(x[:5]) for t, s in model.terms) for x in stems)
    m = toxicity.Matcher(model.terms)
    wrong = ["zuqxvish", "wruttzyvl"]
    found = [toxicity.score(model, m, text(4, wrong)) >= 0.5 for _ in range(30)]
    clean = [toxicity.score(model, m, text(0, wrong)) >= 0.5 for _ in range(30)]
    assert sum(found) >= 28 and not any(clean)


def test_toxicity_keeps_the_words_of_short_stems():
    from riskweave.llm import toxicity

    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(400)]
    def text(bad):
        w = list(rng.choice(vocab, 60))
        for _ in range(bad):
            w.insert(int(rng.integers(0, 60)), str(rng.choice([f"zuqx{e}" for e in ("tar", "tyr", "wem", "rin", "sov", "kul")])))
        return " ".join(w)
    model = toxicity.learn([text(4) for _ in range(120)], [text(0) for _ in range(300)], 0.2)
    assert ("zuqx", True) in model.terms
    m = toxicity.Matcher(model.terms)
    assert any(d == 1 for _, d in m.match("zuxtar")) and all(model.terms[t][1] for t, d in m.match("zuqxtar") if d == 0 and t not in m.explained)


def test_stages_leave_clashing_columns_alone(spark):
    from corpus import PASSAGE
    from pyspark.sql import functions as F

    from riskweave.llm import suffixdedup

    names = ["__sha", "__id", "__row", "__changed", "sha", "owner", "starts", "ends", "gone", "changed", "c0", "c1", "left", "a.b"]
    base = documents(spark, [PASSAGE + " one", " ".join(f"w{i}" for i in range(30)) + PASSAGE, "one two three four five six", "one two three four five six", None, ""], False)
    df = base.select("*", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in names))
    for f, want in ((simhash.one_of_each, [0, 1, 2, 4]), (suffixdedup.without_repeats, [0, 1, 2, 3, 4, 5])):
        got = f(df)
        rows = sorted(got.collect(), key=lambda r: r["doc_id"])
        assert got.columns == df.columns and [r["doc_id"] for r in rows] == want, f
        assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)


def test_suffix_dedup_takes_copies_of_falling_ids_in_one_task(spark):
    from riskweave.llm import suffixdedup

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(9, text), (7, "short"), (5, text), (3, text), (1, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ids, results = suffixdedup.removals(docs)
    assert ids.count() == 5
    assert sorted((r["id"], r["n_removed"]) for r in results.collect()) == [(1, 0), (3, 0)]


def test_pipeline_links_near_copies_by_fingerprints(spark, monkeypatch):
    import corpus_pipeline

    rng = np.random.default_rng(21)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 20000, n)]
    line = ["this", "is", "the", "line", "of", "nine", "words", "repeated", "often"]
    texts = []
    for _ in range(12):  # texts, each with copies of which some words are changed
        a = draw(200)
        texts.append(a)
        for _ in range(6):
            b = a[:]
            for i in rng.choice(200, int(rng.integers(1, 5)), replace=False):
                b[i] = "changed"
            texts.append(b)
    texts += [line * 60 + draw(100) for _ in range(5)]  # a line in common, but not near copies
    texts = [" ".join(x) for x in texts]
    prints = [simhash.majority(np.unique(simhash.shingle_hashes(simhash.words_of(x), 3))) for x in texts]
    of = list(range(len(texts)))  # brute force: fingerprints within 5 bits, and alike
    for i in range(len(texts)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & (1 << 64) - 1).bit_count() <= 5 and jaccard(texts[i], texts[j]) >= 0.8:
                of = [min(of[i], of[j]) if c in (of[i], of[j]) else c for c in of]
    calls, links = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: calls.append(a) or links(*a))
    docs = documents(spark, texts, False)
    assert {r["id"]: r["component"] for r in simhash.near_classes(docs).collect()} == dict(enumerate(of))
    assert 17 <= len(set(of)) < 45 and all(of[i] == i for i in range(84, 89))
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(of)) and len(calls) == 2
