"""Quality rules: a threshold table compiled into one projection of ratios, native expressions only.

Every metric is computed from the row's own words and lines, so a document is judged where it is read: no shuffle, no
user function. Metrics without a value (no words, no lines) count as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages.
STOP_WORDS = ["the", "of", "and", "to", "in", "is", "der", "die", "und", "das", "von", "ist", "de", "la", "le", "et", "les", "des", "el", "que", "en", "los", "un", "una"]

#: (metric, smallest value kept, largest value kept); None is open. All rules must hold.
THRESHOLDS: list[tuple[str, float | None, float | None]] = [
    ("mean_word_length", 1.5, 20.0),
    ("symbol_word_ratio", None, 0.2),
    ("stop_word_ratio", 0.005, None),
    ("dup_line_ratio", None, 0.5),
    ("bullet_line_ratio", None, 0.9),
    ("ellipsis_line_ratio", None, 0.5),
]


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts and the ratios of every row's whole text; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    cut = base.select(
        "id",
        F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    three = lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2))
    windows = cut.withColumn("n_words", F.size("words")).withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(F.slice("words", 1, F.greatest(F.lit(1), F.col("n_words") - 2)), three)).otherwise(F.array().cast("array<string>")))
    # only texts that repeat a window at all are sorted
    ordered = windows.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))))
    same = lambda x, k, by: F.coalesce(x["w"] == F.get("sorted", k + by)["w"], F.lit(False))
    places = F.transform("sorted", lambda x, k: F.when(same(x, k, -1) | same(x, k, 1), x["i"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.filter(places, lambda p: p.isNotNull()), lambda p: F.array(p, p + 1, p + 2)))))
    n, lines = F.col("n_words"), F.size("lines")
    dup_lines = lines - F.size(F.array_distinct("lines"))
    return ordered.select(
        "id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        dup_lines.cast("long").alias("n_dup_lines"),
        F.when(F.col("sorted").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        _ratio(F.col("word_chars"), n).alias("mean_word_length"),
        _ratio(F.col("n_symbols"), n).alias("symbol_word_ratio"),
        _ratio(F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))), n).alias("stop_word_ratio"),
        _ratio(dup_lines, lines).alias("dup_line_ratio"),
        _ratio(F.size(F.filter("lines", lambda x: F.ltrim(x).rlike("^[-*•]"))), lines).alias("bullet_line_ratio"),
        _ratio(F.size(F.filter("lines", lambda x: F.rtrim(x).rlike(r"(\.\.\.|…)$"))), lines).alias("ellipsis_line_ratio"),
    )


def passes(thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over ``measure``'s columns."""
    out = F.lit(True)
    for metric, low, high in thresholds:
        if low is not None:
            out = out & (F.col(metric) >= low)
        if high is not None:
            out = out & (F.col(metric) <= high)
    return out


def judge(docs: DataFrame, thresholds: list[tuple[str, float | None, float | None]] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` and base_failed (fewer than 50 words, or over half of them in repeated windows), kept.

    Rows are judged one by one: repeated rows and null ids each give a row; an empty or null text fails; an empty
    table gives an empty result; other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measure(docs, id_col, text_col).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(thresholds))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Contract of op3 over the whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rules() -> str:
    parts = [f"{m} >= {low}" for m, low, _ in THRESHOLDS if low is not None] + [f"{m} <= {high}" for m, _, high in THRESHOLDS if high is not None]
    return " AND ".join(parts)


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w),
f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM f WHERE c > 1) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
      count(*) FILTER (regexp_matches(ltrim(line, ' '), '^[-*•]')) AS bullets,
      count(*) FILTER (regexp_matches(rtrim(line, ' '), '(\.\.\.|…)$')) AS dots
      FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS stops FROM (SELECT doc_id, unnest(ws) AS word FROM w) WHERE lower(word) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
      length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      coalesce(n_lines, 0) AS n_lines, coalesce(stops, 0) AS stops, coalesce(bullets, 0) AS bullets, coalesce(dots, 0) AS dots
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)),
x AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word_length,
      CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbol_word_ratio,
      CASE WHEN n_words > 0 THEN stops::DOUBLE / n_words ELSE 0 END AS stop_word_ratio,
      CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_ratio,
      CASE WHEN n_lines > 0 THEN bullets::DOUBLE / n_lines ELSE 0 END AS bullet_line_ratio,
      CASE WHEN n_lines > 0 THEN dots::DOUBLE / n_lines ELSE 0 END AS ellipsis_line_ratio,
      n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND {_sql_rules()} AS kept
FROM x
"""
