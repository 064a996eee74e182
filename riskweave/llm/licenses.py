"""License scans by a positional rare-token index, native expressions only.

Templates (standard notices) are word sequences with a mandatory key phrase. Their words' document frequencies are
counted over all documents. The index has one anchor per template: the key phrase's word of the highest IDF, with its
position. Each file's occurrences of anchors are looked up; an occurrence fixes where the template would start, the
words at the other relative positions are compared there, and the key phrase must stand complete.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A notice: its label, its words, and the words of it (consecutive, found once) that must all stand."""

    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> range:
        words, key = self.words, self.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        return range(at, at + len(key))


#: Base phrases: complete where all their words stand consecutively; every place counts.
BASE = [
    Template("mit", "mit license", "mit license"),
    Template("apache", "apache license", "apache license"),
    Template("gpl", "general public license", "general public license"),
]

#: Standard notices of public licenses (fixed wording), by SPDX-like labels.
NOTICES = [
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    Template("mit-notice", "released under the mit license", "mit license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl-3.0", "licensed under the gnu affero general public license", "affero general public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

#: Least IDF-weighted share of a notice's words that stand at their places.
SHARE = 0.6


def words_of(text: Column) -> Column:
    """Words of the whole text, A-Z lower-cased; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def idf_table(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, float]:
    """IDF over all documents of every template word: ln((1 + n) / (1 + df)). As many rows as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary)))
    # the empty word counts the rows
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), known)).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()
    df = {r["word"]: r["df"] for r in rows}
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) for w in vocabulary}


def _at(start: Column, offset: int, word: str) -> Column:
    return F.coalesce(F.get("words", start + offset) == word, F.lit(False))


def _anchor(t: Template, idf: dict[str, float]) -> int:
    return max(t.key_at, key=lambda j: (idf[t.words[j]], t.words[j], -j))


def _starts(t: Template, idf: dict[str, float]) -> Column:
    """Starts in the file's words where the anchor is followed and preceded by the rest of the key phrase."""
    at = _anchor(t, idf)
    found = F.transform(F.filter("hits", lambda i: F.get("words", i) == t.words[at]), lambda i: i - at)
    def stands(s: Column) -> Column:
        out = F.lit(True)
        for j in t.key_at:
            if j != at:
                out = out & _at(s, j, t.words[j])
        return out
    return F.filter(found, stands)


def _share(t: Template, idf: dict[str, float], start: Column) -> Column:
    total = sum(idf[w] for w in t.words)
    got = F.lit(0.0)
    for j, w in enumerate(t.words):
        got = got + F.when(_at(start, j, w), F.lit(idf[w])).otherwise(F.lit(0.0))
    return F.round(got / total, 6) if total > 0 else F.lit(1.0)


def scan(docs: DataFrame, notices: list[Template] = NOTICES, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, start, share) per row.

    score: the largest share of any notice whose key phrase stands, 1 where a base phrase stands, else 0. Each row is
    judged alone, so repeated rows and null ids each give a row; null and empty texts have no words; an empty table
    gives an empty result. Runs a first pass over the table for the document frequencies.
    """
    idf = idf_table(docs, [*BASE, *notices], text_col)
    anchors = sorted({t.words[_anchor(t, idf)] for t in [*BASE, *notices]})
    cut = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    hits = F.when(F.exists("words", lambda w: w.isin(anchors)), F.filter(F.transform("words", lambda w, i: F.when(w.isin(anchors), i)), lambda i: i.isNotNull())).otherwise(F.array().cast("array<int>"))
    looked = cut.withColumn("hits", hits)
    some = F.size("hits") > 0
    def span_of(t: Template, base: bool):
        return lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("start"), (F.lit(1.0) if base else _share(t, idf, s)).alias("share"), F.lit(base).alias("base"))

    spans = F.concat(*(F.transform(_starts(t, idf), span_of(t, base)) for base, own in ((True, BASE), (False, notices)) for t in own))
    found = looked.withColumn("spans", F.when(some, spans))
    base = F.filter("spans", lambda x: x["base"])
    of = lambda spans: F.coalesce(F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"])))), F.lit(""))
    return found.select(
        "id",
        F.size("words").cast("long").alias("n_words"),
        F.greatest(F.size(base), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).cast("long").alias("last_word"),
        of(base).alias("base_labels"),
        of(F.filter("spans", lambda x: x["share"] >= share)).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
        "spans",
    )


def op1_licenses(spark, sf_dir: str) -> DataFrame:
    """Contract of op1 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).drop("spans").withColumnRenamed("id", "doc_id")


def _rows() -> str:
    out = []
    for kind, templates in ((True, BASE), (False, NOTICES)):
        for t in templates:
            for j, w in enumerate(t.words):
                out.append(f"('{t.label}', {kind}, {j}, '{w}', {j in t.key_at}, {len(t.words)}, {len(t.key_at)})")
    return ", ".join(out)


ORACLE = rf"""
WITH tpl(label, base, j, word, in_key, n, n_key) AS (VALUES {_rows()}),
ws AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
occ AS (SELECT doc_id, unnest(range(0, len(words))) AS i, unnest(words) AS word FROM ws),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM occ WHERE word IN (SELECT word FROM tpl) GROUP BY word),
idf AS (SELECT t.word, ln((1 + (SELECT count(*) FROM documents))::DOUBLE / (1 + coalesce(df, 0))) AS idf FROM (SELECT DISTINCT word FROM tpl) t LEFT JOIN df USING (word)),
total AS (SELECT label, base, sum(idf) AS total FROM tpl JOIN idf USING (word) GROUP BY label, base),
al AS (SELECT doc_id, label, base, i - j AS start, sum(idf) AS got, count(*) FILTER (in_key) AS keys, any_value(n_key) AS n_key
       FROM occ JOIN tpl USING (word) JOIN idf USING (word) GROUP BY doc_id, label, base, i - j),
sp AS (SELECT doc_id, label, base, start, CASE WHEN base OR total <= 0 THEN 1.0 ELSE round(got / total, 6) END AS share
       FROM al JOIN total USING (label, base) WHERE keys = n_key),
agg AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (share >= {SHARE}) AS labels, max(share) AS score FROM sp GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM ws LEFT JOIN agg USING (doc_id)
"""
