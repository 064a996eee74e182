"""Hash-chained ledger, Merkle roots, signatures and retry schedules."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

GENESIS = "0" * 64


def append(entries: DataFrame, chain: str = "case_id") -> DataFrame:
    """Entries (chain, seq, payload) hashed in order within each chain (O-53). Hashing is sequential within a chain,
    whose entries stream through a task in order; chains run in parallel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        before, prev, own = GENESIS, [], []
        for seq, payload in zip(pdf["seq"], pdf["payload"]):
            prev.append(before)
            before = hashlib.sha256(f"{seq}|{payload}|{before}".encode()).hexdigest()
            own.append(before)
        return pdf.assign(prev_hash=prev, entry_hash=own)

    t = dict(entries.dtypes)
    return entries.select(chain, "seq", "payload").groupBy(chain).applyInPandas(run, f"{chain} {t[chain]}, seq long, payload string, prev_hash string, entry_hash string")


def verify(ledger: DataFrame, chain: str = "case_id") -> DataFrame:
    """Per chain: entries and broken ones; each is checked against its own content and its predecessor, in parallel (O-53)."""
    own = F.sha2(F.concat_ws("|", F.col("seq").cast("string"), "payload", "prev_hash").cast("binary"), 256)
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy(chain).orderBy("seq")), F.lit(GENESIS))
    t = ledger.select(chain, (own == F.col("entry_hash")).alias("a"), (before == F.col("prev_hash")).alias("b"))
    return t.groupBy(chain).agg(F.count("*").alias("n"), F.count_if(~F.col("a") | ~F.col("b")).alias("n_broken"))


def merkle_roots(leaves: DataFrame, group: str, order: str, leaf: str, levels: int = 10) -> DataFrame:
    """Merkle root per group of up to 2**levels leaves, the last one doubled on odd levels (O-54): one aggregation per level."""
    t = leaves.select(group, (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).alias("i"), F.sha2(F.col(leaf).cast("binary"), 256).alias("h"))
    t = t.withColumn("n", F.count("*").over(Window.partitionBy(group)))
    for _ in range(levels):
        one = F.max(F.when(F.col("i") % 2 == 0, F.col("h")))
        two = F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("h"))), one)
        t = t.groupBy(group, "n", F.floor(F.col("i") / 2).alias("i")).agg(F.when(F.col("n") > 1, F.sha2(F.concat(one, two).cast("binary"), 256)).otherwise(one).alias("h"))
        t = t.withColumn("n", F.ceil(F.col("n") / 2))
    return t.select(group, F.col("h").alias("root"))


def canonical_json(df: DataFrame, columns: list[str]) -> Column:
    """Columns as JSON with sorted keys."""
    return F.to_json(F.struct(*sorted(columns)))


@F.pandas_udf(StringType())
def _hmac(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for key, message in parts:
        yield pd.Series([hmac.new(k.encode(), m.encode(), hashlib.sha256).hexdigest() for k, m in zip(key, message)])


def sign(secret: str, sent: Column, body: Column) -> Column:
    """Signature header of a delivery (O-55)."""
    stamp = sent.cast("string")
    return F.concat(F.lit("t="), stamp, F.lit(",v1="), _hmac(F.lit(secret), F.concat_ws(".", stamp, body)))


def backoff(attempt: Column, base: float = 2.0, most: float = 300.0, tries: int = 5) -> tuple[Column, Column]:
    """(seconds to wait, state) after a failed attempt (O-55)."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1)), F.when(attempt >= tries, "DEAD_LETTER").otherwise("RETRY")


def once(tasks: DataFrame, columns: list[str]) -> DataFrame:
    """Tasks with one idempotency key kept once, the earliest (O-56)."""
    key = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)).cast("binary"), 256)
    rank = F.row_number().over(Window.partitionBy("key").orderBy("us", "txn_id"))
    return tasks.withColumn("key", key).withColumn("r", rank).where("r = 1").drop("r")
