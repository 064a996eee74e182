"""Canonical tables: transactions, closed cases, and the keys that every operator relies on.

Times are real timestamps (``us``: microseconds since the epoch, for range frames); every operator bounds its input by
``as_of`` before deriving anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
DAY = 24 * HOUR
MCCS = [6051, 7995, 4829, 6011, 5411]


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event as a transaction: txn_id, ts, us, card, customer, amount, channel, device, merchant, region,
    email, mcc, risk, is_fraud, flag_new, proxy."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return normalise(events)


def normalise(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    ts = F.col("ts").cast("timestamp")
    mcc = F.element_at(F.array(*map(F.lit, MCCS)), (F.col("k") % 5 + 1).cast("int"))
    online = F.col("event_type").isin("purchase", "view", "click")
    return events.withColumn("k", k).select(
        F.col("event_id").alias("txn_id"),
        ts.alias("ts"),
        F.unix_micros(ts).alias("us"),
        F.col("user_id").alias("card"),
        (F.col("user_id") % 50).alias("customer"),
        F.col("value").alias("amount"),
        F.when(online, "online").otherwise("in_person").alias("channel"),
        F.concat_ws("|", F.col("k").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("device"),
        F.concat_ws("-", "event_type", (F.col("k") % 10).cast("string")).alias("merchant"),
        (F.col("k") % 10).alias("region"),
        F.concat(F.lit("e"), (F.col("k") % 7).cast("string")).alias("email"),
        mcc.alias("mcc"),
        F.least(F.lit(1.0), F.col("value") / 250).alias("risk"),
        (F.col("event_type") == "error").alias("is_fraud"),
        (F.col("k") % 4 == 0).alias("flag_new"),
        (F.col("k") % 6 == 0).alias("proxy"),
    )


def cases(txn: DataFrame) -> DataFrame:
    """Closed cases: one per fraud-flagged transaction, confirmed unless its id is divisible by three."""
    return txn.where("is_fraud").select(
        F.concat(F.lit("C"), F.col("txn_id").cast("string")).alias("case_id"), "txn_id", "card", "customer", "device", F.col("us").alias("opened_us"),
        F.when(F.col("txn_id") % 3 == 0, "cleared").otherwise("confirmed_fraud").alias("outcome"), F.col("amount").alias("exposure"), "risk",
    )


def as_of(df: DataFrame, when: str | None, column: str = "ts") -> DataFrame:
    """Rows up to ``when``, inclusive."""
    return df if when is None else df.where(F.col(column) <= F.lit(when).cast("timestamp"))


def device_key(info: Column, os: Column, browser: Column, screen: Column) -> Column:
    """The four parts of a device joined; blank or missing parts get placeholders."""
    parts = ((info, "UnknownDevice"), (os, "UnknownOS"), (browser, "UnknownBrowser"), (screen, "UnknownScreen"))
    return F.concat_ws(" | ", *(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)) for c, d in parts))


def device_parts(key: Column) -> Column:
    return F.split(key, r" \| ")


def resolve_cards(txn: DataFrame, known: DataFrame, signature: list[str]) -> DataFrame:
    """Card of each transaction: known from a case; else of the smallest known transaction with the same signature;
    with the same first attribute; of the same customer; else the customer's default."""
    base = known.select("txn_id", F.col("card_id").alias("k0"))
    named = txn.join(known, "txn_id")
    out = txn.join(base, "txn_id", "left")
    for i, keys in enumerate((signature, signature[:1], ["customer_id"]), 1):
        first = named.groupBy(*keys).agg(F.min_by("card_id", "txn_id").alias(f"k{i}"))
        out = out.join(first, keys, "left")
    default = F.concat(F.col("customer_id").cast("string"), F.lit("-K1"))
    return out.withColumn("card_id", F.coalesce("k0", "k1", "k2", "k3", default)).drop("k0", "k1", "k2", "k3")


def by(*keys: str) -> Window:
    """The rows of a key in time order, ties by transaction id."""
    return Window.partitionBy(*keys).orderBy("us", "txn_id")


def timed(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("us")
