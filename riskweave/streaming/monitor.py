"""Per-event alert rules, as batch expressions and as Structured Streaming queries that agree with them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SPAN = 300_000_000
HIGH_RISK_MCC = [6051, 7995, 4829, 6011]


def velocity_spike(txn: DataFrame, span: int = SPAN, count: int = 3, total: float = 1000.0, critical: float = 2500.0) -> DataFrame:
    """Events with at least ``count`` of the card's events, or ``total``, in the span up to them, inclusive (T-1, T-2)."""
    w = Window.partitionBy("card").orderBy("us").rangeBetween(-span, 0)
    t = txn.select("txn_id", "card", F.count("*").over(w).alias("n"), F.round(F.sum("amount").over(w), 4).alias("total"))
    return t.where((F.col("n") >= count) | (F.col("total") >= total)).withColumn("severity", F.when(F.col("total") >= critical, "CRITICAL").otherwise("HIGH"))


def novel_device_link(txn: DataFrame) -> DataFrame:
    """First use of a device by a card after another card used it (T-3): the second and later cards by first use."""
    first = txn.groupBy("device", "card").agg(F.min(F.struct("us", "txn_id")).alias("at"))
    w = Window.partitionBy("device").orderBy("at")
    t = first.withColumn("n_before", F.row_number().over(w) - 1)
    return t.where("n_before > 0").select(F.col("at.txn_id").alias("txn_id"), "device", "card", "n_before")


def distance_km(lat1, lon1, lat2, lon2):
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def impossible_travel(txn: DataFrame, speed: float = 800.0, least: float = 100.0) -> DataFrame:
    """Events too far from the card's previous one for the time between (T-4). txn: txn_id, card, us, lat, lon."""
    w = Window.partitionBy("card").orderBy("us", "txn_id")
    t = txn.where("lat is not null and lon is not null").select("txn_id", "card", "lat", "lon", "us", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("lat", "lon", "us")))
    km = distance_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    hours = F.greatest(F.lit(0.001), (F.col("us") - F.col("p_us")) / 3.6e9)
    out = t.where("p_us is not null").select("txn_id", "card", F.round(km, 3).alias("km"), F.round(km / hours, 3).alias("speed"))
    return out.where((F.col("speed") > speed) & (F.col("km") > least))


def located(txn: DataFrame) -> DataFrame:
    """A place per region, for tables without coordinates."""
    return txn.withColumn("lat", (F.col("region") * 7 - 30).cast("double")).withColumn("lon", (F.col("region") * 13 - 60).cast("double"))


def high_risk_mcc(txn: DataFrame, least: float = 250.0) -> DataFrame:
    """Stateless rule (T-5)."""
    return txn.where(F.col("mcc").isin(HIGH_RISK_MCC) & (F.col("amount") >= least)).select("txn_id", "card", "mcc", "amount")


def alert_stats(txn: DataFrame, total: float = 300.0) -> DataFrame:
    """Alerts by rule and severity (T-6)."""
    v = velocity_spike(txn, total=total, critical=2 * total).select(F.lit("VELOCITY_SPIKE").alias("rule"), "severity")
    d = novel_device_link(txn).select(F.lit("NOVEL_DEVICE_LINK").alias("rule"), F.lit("HIGH").alias("severity"))
    m = high_risk_mcc(txn, 100.0).select(F.lit("HIGH_RISK_MCC").alias("rule"), F.lit("MEDIUM").alias("severity"))
    return v.unionByName(d).unionByName(m).groupBy("rule", "severity").agg(F.count("*").alias("n"))


def task_risk(txn: DataFrame) -> DataFrame:
    """Risk of a queued task by a ladder of amounts (T-7)."""
    a = F.col("amount")
    return txn.select("txn_id", F.when(a >= 200, 0.9).when(a >= 100, 0.6).when(a >= 50, 0.3).otherwise(0.1).cast("double").alias("risk"))


def histogram(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets, count and sum of a measure (T-8)."""
    g = df.agg(*(F.count_if(F.col(column) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(column).alias("n"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("bound"), F.col("n").alias("n")))
    return g.select(F.explode(rows).alias("r")).select(F.col("r.bound").alias("bound"), F.col("r.n").alias("n"))


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of event files as a stream of transactions with a watermark on ``ts`` (S9)."""
    from riskweave.operators.canonical import normalise

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return normalise(events).withWatermark("ts", "5 minutes")


def windowed_velocity(stream: DataFrame, count: int = 3, total: float = 1000.0) -> DataFrame:
    """Sliding five-minute counts per card (T-1); late rows beyond the watermark are dropped."""
    w = F.window("ts", "5 minutes", "1 minute")
    g = stream.groupBy(w, "card").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return g.where((F.col("n") >= count) | (F.col("total") >= total)).select("card", F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "n", "total")


def sessions(stream: DataFrame, gap: str = "2 hours", least: int = 3) -> DataFrame:
    """Chains of a card's events as session windows (streaming form of the chain motif)."""
    g = stream.groupBy(F.session_window("ts", gap), "card").agg(F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select("card", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def _spikes(span: int, count: int, total: float) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, amounts = (list(x) for x in state.get) if state.exists else ([], [])
        rows = pd.concat([*batches]).sort_values(["us", "txn_id"])
        out = []
        for us, txn_id, amount in zip(rows["us"], rows["txn_id"], rows["amount"]):
            keep = [i for i, t in enumerate(times) if t >= us - span]  # what has left the span is evicted
            times, amounts = [times[i] for i in keep] + [int(us)], [amounts[i] for i in keep] + [float(amount)]
            if len(times) >= count or sum(amounts) >= total:
                out.append((int(txn_id), key[0], len(times), float(sum(amounts))))
        state.update((times, amounts))
        yield pd.DataFrame(out, columns=["txn_id", "card", "n", "total"])
    return run


def stateful_velocity(stream: DataFrame, span: int = SPAN, count: int = 3, total: float = 1000.0) -> DataFrame:
    """Per-event alerts with a list state per card that holds only the span's events (T-2)."""
    return stream.select("card", "us", "txn_id", "amount").groupBy("card").applyInPandasWithState(_spikes(span, count, total), "txn_id long, card long, n long, total double", "times array<long>, amounts array<double>", "append", GroupStateTimeout.NoTimeout)
