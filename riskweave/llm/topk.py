"""Exact top-k inner products by pivot-table elimination.

|q - x|^2 = |q|^2 + |x|^2 - 2 q.x, so a lower bound of a distance is an upper bound of an inner product. A table of all
rows' distances to some pivots is made once per block; the largest difference of a query's and a row's distance to the
same pivot bounds their distance from below. Rows are evaluated in the order of their bounds, and the search stops
where the next bound is below the k-th best score found: results are exact whatever the pivots.

Queries against all rows go block by block: both sides are dealt into blocks of bounded size, each pair of blocks
yields k rows per query at most, and those are merged per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.shared import stage

#: Rows from which pivots are taken (those of the smallest hashes), and how many pivots.
PIVOT_SAMPLE, PIVOTS = 2048, 16
#: Rows and queries in a block at most, and at least.
ROWS, QUERIES, LEAST = 65_536, 8_192, 2_048


def pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal: each next pivot is the row farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    distance = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and distance.max() > 0:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None] - 2 * x @ p.T, 0))


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, table: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query id, row id, score): each query's k best rows but its own id, ties to the smaller id."""
    norms = (rows**2).sum(axis=1)
    to_rows, to_queries = _distances(rows, table), _distances(queries, table)
    for q, qid, dq in zip(queries, query_ids, to_queries):
        low = np.zeros(len(rows))
        for j in range(len(table)):
            np.maximum(low, np.abs(to_rows[:, j] - dq[j]), out=low)
        own = float(q @ q)
        # room for rounding: distances are within some units in the last place
        bound = (own + norms - np.maximum(low * (1 - 1e-9) - 1e-6, 0) ** 2) / 2
        bound += 1 + 1e-9 * (own + norms)
        bound[row_ids == qid] = -np.inf
        scores, got, left, width, least = [], [], np.arange(len(rows)), max(64, 8 * k), -np.inf
        while len(left):
            # the next rows in the order of their bounds; of equal ones at the cut, those not taken stay for later
            if width < len(left):
                cut = np.argpartition(-bound[left], width - 1)
                part, left = left[cut[:width]], left[cut[width:]]
            else:
                part, left = left, left[:0]
            part = part[(bound[part] >= least) & (bound[part] > -np.inf)]
            if not len(part):
                break
            scores.append(rows[part] @ q)
            got.append(part)
            width *= 4
            flat = np.concatenate(scores)
            if len(flat) >= k:
                least = np.partition(flat, len(flat) - k)[len(flat) - k]
        if got:
            flat, at = np.concatenate(scores), np.concatenate(got)
            keep = np.nonzero(flat >= least)[0]
            keep = keep[np.lexsort((row_ids[at[keep]], -flat[keep]))][:k]
            for i in keep:
                yield int(qid), int(row_ids[at[i]]), int(flat[i])


def vectors(df: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, dim, v): components floor(scale * x); rows with a null id, null vector, null or non-finite component are left out."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row where ``is_query`` (over the columns id, dim, v) its k highest inner products.

    Candidates are all rows with another id and as many components; a query without candidates has no rows; repeated
    rows are candidates each (and one query); an empty table gives an empty result.
    """
    rows = stage(vectors(df, scale, id_col, vector_col).withColumn("at", F.monotonically_increasing_id()), "vectors")
    n, n_queries = (int(x or 0) for x in rows.agg(F.count("*"), F.count_if(is_query)).first())
    sample = rows.orderBy(F.xxhash64("id"), "id", "at").limit(PIVOT_SAMPLE).select("dim", "v").collect()  # bounded
    tables = {}
    for dim in {r["dim"] for r in sample}:
        tables[dim] = pivots(np.array([r["v"] for r in sample if r["dim"] == dim], np.float64).reshape(-1, dim), PIVOTS)
    size = min(ROWS, max(LEAST, n // 24))
    n_blocks, n_parts = max(1, math.ceil(n / size)), max(1, math.ceil(n_queries / QUERIES))
    left = rows.select(F.col("dim").alias("d"), F.pmod("at", F.lit(n_blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "id", "v")
    asked = rows.where(is_query).dropDuplicates(["id", "v"])
    right = asked.select(F.col("dim").alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int").alias("part"), "id", "v")

    def run(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(block) and len(queries):
            dim = int(block["d"].iloc[0])
            x, q = (np.stack(f["v"].to_numpy()).astype(np.float64).reshape(-1, dim) for f in (block, queries))
            table = tables[dim] if dim in tables else x[:1]
            out = list(search(q, queries["id"].to_numpy(), x, block["id"].to_numpy(), table, k))
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype("int64")

    keys = ["d", "block", "part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op8_top_k(spark, sf_dir: str) -> DataFrame:
    """Contract of op8 over the whole ``embeddings``."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(df, F.col("id") % 50 == 0).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.e, x.e)::BIGINT AS score FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id AND len(x.e) = len(q.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
