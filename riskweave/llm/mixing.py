"""Mixing sources to target weights by hierarchical budgeting, native expressions only.

The token budget flows down a domain-language-source tree. At each node its budget is dealt to the children by their
weights, none above its capacity (tokens below it times the epochs allowed); what a full child can't take goes to its
siblings, and only what a whole subtree can't take was dealt to the ancestor's other children before. A leaf reads its
documents in a seeded order, a new one each epoch: whole epochs, then the prefix that the rest of its budget pays for.

A leaf may hold most of all rows, so its prefix is found in two steps: token sums per range of the order's hash are
accumulated, and only the rows of the one range where the budget ends are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import stage

LEVELS = ["domain", "lang", "source"]
#: Production parameters: weights by level and value (others: 1), share of the corpus's tokens, epochs at most, seed.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 2}, "source": {}}
FRACTION, EPOCHS, SEED = 0.6, 2, 17
#: Ranges of the order's hash per leaf; the range where a leaf's budget ends holds about 1/RANGES of the leaf.
RANGES = 4096
HASH_BITS = 60
WORD = r"[^\x20\x09-\x0D]+"


def domain_of(source: Column) -> Column:
    """Default domain: sources are numbered, and number n belongs to domain d(n mod 3); others to d0."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1).try_cast("long")
    return F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % 3).cast("string"))


def tokens_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def order_hash(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A document's place in an epoch: 60 bits of an MD5 over seed, epoch and id."""
    key = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def leaves(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, tree path and tokens per row; null tree values count as the empty string."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), domain_of(F.col("source")).alias("domain"), empty("lang").alias("lang"), empty("source").alias("source"), tokens_of(F.col(text_col)).alias("tokens"))


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for value, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == value, w).otherwise(out)
    return out.cast("long")


def deal(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget``: each parent's ``above`` dealt to its children by ``weight``, none over ``cap``.

    A child is full if, at the level where it fills (cap / weight), the children that fill earlier and the shares of
    the others fit into the budget together; the rest is shared by weight.
    """
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy("level", name).rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumn("level", F.col("cap") / F.col("weight"))
    out = out.withColumn("before", F.coalesce(F.sum("cap").over(earlier), F.lit(0)))
    out = out.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    out = out.withColumn("full", F.col("before") + F.col("level") * F.col("rest") <= F.col("above"))
    taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0))
    shares = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    budget = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * (F.col("above") - taken) / shares)
    return out.withColumn("budget", budget).drop("level", "before", "rest", "full", "above")


def plan(rows: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per leaf: domain, lang, source, whole (epochs taken whole), cut_hash, cut_id (the last document of the
    next epoch's prefix; null: none). ``rows`` are ``leaves``."""
    leaf = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("n")).withColumn("cap", F.col("n") * epochs)
    above = leaf.groupBy().agg(F.floor(F.sum("n") * F.lit(fraction)).cast("double").alias("above"))
    parent: list[str] = []
    budgets = None
    for level in LEVELS:
        path = [*parent, level]
        nodes = leaf.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(level, weights))
        # the root's budget is one row, and each level's budgets one row per node: an equi-join on the path
        nodes = nodes.withColumn("root", F.lit(0)).join(above.withColumn("root", F.lit(0)), "root").drop("root") if budgets is None else nodes.join(budgets, parent)
        budgets = deal(nodes, parent, level).select(*path, F.col("budget").alias("above"))
        parent = path
    target = leaf.join(budgets, LEVELS).select(*LEVELS, "n", F.floor("above").cast("long").alias("target"))
    whole = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0).cast("long")
    # staged, its size is known: one row per leaf, so that documents are joined where they are
    target = stage(target.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("n")).drop("n", "target"), "mixing-target")
    shift = HASH_BITS - (RANGES.bit_length() - 1)
    placed = rows.join(target.where("rest > 0"), LEVELS).withColumn("h", order_hash(seed, F.col("whole"), F.col("id"))).withColumn("range", F.shiftright("h", shift))
    sums = placed.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    # first among groups of ranges, then among the ranges of one: a leaf's windows have the square root of RANGES rows
    group = F.shiftright("range", (RANGES.bit_length() - 1) // 2)
    sums = sums.withColumn("group", group)
    groups = sums.groupBy(*LEVELS, "group").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    end = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("group"))
    ending = groups.withColumn("end", end).withColumn("base", F.col("end") - F.col("n")).where("base <= rest and end > rest").select(*LEVELS, "group", "base")
    end = F.col("base") + F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
    inner = sums.join(ending, [*LEVELS, "group"]).withColumn("end", end).withColumn("begin", F.col("end") - F.col("n"))
    last = inner.where("begin <= rest and end > rest").select(*LEVELS, "range", "begin")
    inner = placed.join(last, [*LEVELS, "range"]).withColumn("end", F.col("begin") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("h", "id")))
    inside = inner.where("end <= rest").groupBy(*LEVELS).agg(F.max(F.struct("h", "id")).alias("cut"))
    # a prefix that ends before its range's first document still holds the ranges before it
    edge = last.select(*LEVELS, F.shiftleft("range", shift).alias("edge"))
    cuts = edge.join(inside, LEVELS, "left").select(*LEVELS, F.coalesce("cut.h", F.col("edge") - 1).alias("cut_hash"), F.when(F.col("cut").isNull(), F.lit(None)).otherwise(F.col("cut.id")).alias("cut_id"))
    return target.join(cuts, LEVELS, "left").select(*LEVELS, "whole", "cut_hash", "cut_id")


def select(rows: DataFrame, chosen: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (with the tree's columns and id) once per epoch that takes them, as the column epoch."""
    joined = rows.join(chosen, LEVELS)
    h = order_hash(seed, F.col("whole"), F.col("id"))
    first = (h < F.col("cut_hash")) | ((h == F.col("cut_hash")) & (F.col("cut_id").isNull() | (F.col("id") <= F.col("cut_id"))))
    n = F.col("whole") + F.when(F.coalesce(first, F.lit(False)), 1).otherwise(0)
    return joined.where(n > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).drop("whole", "cut_hash", "cut_id")


def taken(docs: DataFrame, chosen: DataFrame, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with their own columns alone, once per epoch that takes them."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col(id_col).cast("long").alias("id"), domain_of(F.col("source")).alias("domain"), empty("lang").alias("lang"), empty("source").alias("source"))
    return select(rows, chosen, seed).select("__row.*")


def mix(docs: DataFrame, weights: dict[str, dict[str, int]] = WEIGHTS, fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, domain, lang, source, tokens, epoch: a row for each time a document is taken.

    Null languages and sources are leaves of their own, a null text has no tokens (it is taken with the prefix or the
    epoch it stands in), repeated ids are taken together; an empty table gives an empty result.
    """
    rows = stage(leaves(docs, id_col, text_col), "mixing")
    return select(rows, stage(plan(rows, weights, fraction, epochs, seed), "mixing-plan"), seed)


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Documents taken from the whole ``documents`` for 60 % of its tokens at the production weights."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("id").alias("doc_id"), "domain", "lang", "source", F.col("tokens").alias("n_tokens"), "epoch")


def _case(level: str) -> str:
    return " ".join(["CASE", *(f"WHEN {level} = '{v}' THEN {w}" for v, w in WEIGHTS[level].items()), "ELSE 1 END"]) if WEIGHTS[level] else "1"


def _level(level: str, parent: list[str], above: str) -> str:
    path = ", ".join([*parent, level])
    part = f"PARTITION BY {', '.join(parent)}" if parent else ""
    frame = f"OVER ({part} ORDER BY lv, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    join = f"JOIN {above} USING ({', '.join(parent)})" if parent else f", {above}"
    return f"""
{level}_a AS (SELECT *, cap / weight AS lv FROM (SELECT {path}, sum(cap)::BIGINT AS cap, {_case(level)} AS weight FROM leaf GROUP BY {path}) {join}),
{level}_b AS (SELECT *, coalesce(sum(cap) {frame}, 0) AS before, sum(weight) OVER ({part}) - coalesce(sum(weight) {frame}, 0) AS rest FROM {level}_a),
{level}_c AS (SELECT *, before::DOUBLE + lv * rest::DOUBLE <= above AS isfull FROM {level}_b),
{level}_d AS (SELECT {path}, CASE WHEN isfull THEN cap::DOUBLE ELSE weight * (above - coalesce(sum(cap) FILTER (isfull) OVER ({part}), 0)::DOUBLE) / (sum(weight) FILTER (NOT isfull) OVER ({part}))::DOUBLE END AS above FROM {level}_c)"""


def _oracle() -> str:
    path = ", ".join(LEVELS)
    levels = ",".join([_level("domain", [], "root"), _level("lang", ["domain"], "domain_d"), _level("source", ["domain", "lang"], "lang_d")])
    return rf"""
WITH r AS (SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), '') AS BIGINT), 0) % 3)::VARCHAR AS domain,
           coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS tokens FROM documents),
leaf AS (SELECT {path}, sum(tokens)::BIGINT AS n, (sum(tokens) * {EPOCHS})::BIGINT AS cap FROM r GROUP BY {path}),
root AS (SELECT floor(sum(n)::DOUBLE * {FRACTION}::DOUBLE) AS above FROM leaf),{levels},
target AS (SELECT {path}, n, floor(above)::BIGINT AS target, CASE WHEN n > 0 THEN floor(floor(above) / n)::BIGINT ELSE 0 END AS whole FROM leaf JOIN source_d USING ({path})),
placed AS (SELECT r.*, whole, target - whole * n AS rest, ('0x' || substr(md5('{SEED}:' || whole::VARCHAR || ':' || doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM r JOIN target USING ({path})),
upto AS (SELECT *, sum(tokens) OVER (PARTITION BY {path} ORDER BY h, doc_id) AS upto FROM placed),
times AS (SELECT *, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM upto)
SELECT doc_id, domain, lang, source, tokens AS n_tokens, unnest(range(0, n)) AS epoch FROM times WHERE n > 0
"""


ORACLE = _oracle()
