"""Small corpora with the awkward cases: nulls, empty and odd texts, copies, ties, clashing columns."""

from pyspark.sql import functions as F

BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
PASSAGE = "A passage of well over one hundred bytes that is found in several documents of this small corpus, word for word, café included."
TEXTS = [
    BASE, BASE, BASE.upper(), "", None, " \t\n", "word", "two words", PASSAGE, "x " + PASSAGE + " y", PASSAGE * 2, "ÉÈ ß mixed ÇASE", "line\nline\nline\n" * 20,
    "Released under the MIT License. MIT License", "licensed under the Apache License, Version 2.0", "GNU General Public License, version 3", "a" * 5000, "it's we're they'll ''s a'b 12½ x²　y İ <|endoftext|> \x1c z",
]


def documents(spark, texts=None, extra=True):
    """doc_id, text, lang, source and, if wanted, columns whose names operators use themselves."""
    rows = [(i, t, ["en", "de", None][i % 3], [f"src{i % 4}", None][i % 5 == 4], len(t or "")) for i, t in enumerate(TEXTS if texts is None else texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in ("id", "words", "score", "fp", "h", "hits", "epoch", "length", "sha", "bucket", "unit"):
            df = df.withColumn(c, F.lit(c))
    return df


def empty(spark, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([], schema)
