"""Entity profiles, velocity, context windows, novelty and movement, for all entities at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.canonical import DAY, HOUR, as_of, by, cases, timed


def _top(txn: DataFrame, key: str, column: str, n: int, name: str) -> DataFrame:
    counts = txn.where(F.col(column).isNotNull()).groupBy(key, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), F.col(column)))
    ranked = counts.withColumn("r", rank).where(F.col("r") <= n)
    listed = F.array_sort(F.collect_list(F.struct("r", F.col(column).cast("string").alias("v"))))
    return ranked.groupBy(key).agg(F.concat_ws(",", F.transform(listed, lambda x: x["v"])).alias(name))


def entity_profile(txn: DataFrame, key: str = "card", when: str | None = None) -> DataFrame:
    """Count, sums, median, top regions and devices, channel shares, first and last time per entity (O-1)."""
    t = as_of(txn, when)
    base = t.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.round(F.avg("amount"), 4).alias("mean"), F.round(F.median("amount"), 4).alias("median"),
        F.min("amount").alias("least"), F.max("amount").alias("most"), F.count_if(F.col("channel") == "online").alias("n_online"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
    )
    return base.join(_top(t, key, "region", 3, "top_regions"), key, "left").join(_top(t, key, "device", 3, "top_devices"), key, "left")


def txn_context(txn: DataFrame, hours: int = 48) -> DataFrame:
    """Neighbours of each transaction on its card within some hours, and the amount's z-score against all earlier ones (O-2)."""
    w = timed("card")
    before, after = w.rangeBetween(-hours * HOUR, -1), w.rangeBetween(1, hours * HOUR)
    past = w.rangeBetween(Window.unboundedPreceding, -1)
    n, mean, std = F.count("*").over(past), F.avg("amount").over(past), F.stddev_pop("amount").over(past)
    out = txn.select("txn_id", "card", "amount", F.count("*").over(before).alias("n_before"), F.count("*").over(after).alias("n_after"), n.alias("n"), mean.alias("mean"), std.alias("std"), (F.col("us") - F.max("us").over(before)).alias("gap_us"))
    z = F.when((F.col("n") >= 3) & (F.col("std") > 0.01), F.round((F.col("amount") - F.col("mean")) / F.col("std"), 4)).otherwise(0.0)
    return out.select("txn_id", "card", "n_before", "n_after", "gap_us", z.alias("z_score"))


def velocity(txn: DataFrame) -> DataFrame:
    """Counts and sums over 5 minutes, 1 hour, 24 hours and 7 days up to each transaction, both ends inclusive, and the
    hour's spike against the week's rate (O-3)."""
    out = txn.select("txn_id", "card", "us", "amount")
    for name, span in (("5m", HOUR // 12), ("1h", HOUR), ("24h", DAY), ("7d", 7 * DAY)):
        w = timed("card").rangeBetween(-span, 0)
        out = out.withColumn(f"n_{name}", F.count("*").over(w)).withColumn(f"sum_{name}", F.round(F.sum("amount").over(w), 2))
    return out.withColumn("spike", F.round(F.col("n_1h") / (F.col("n_7d") / 168.0 + 0.05), 4)).drop("amount", "us")


def velocity_at(txn: DataFrame, when: str) -> DataFrame:
    """The same windows for every card at one time: one aggregation, no window."""
    end = F.unix_micros(F.lit(when).cast("timestamp"))
    t = as_of(txn, when).where(F.col("us") >= end - 7 * DAY)
    spans = (("5m", HOUR // 12), ("1h", HOUR), ("24h", DAY), ("7d", 7 * DAY))
    inside = {n: F.col("us") >= end - s for n, s in spans}
    return t.groupBy("card").agg(*(F.count_if(inside[n]).alias(f"n_{n}") for n, _ in spans), *(F.round(F.coalesce(F.sum(F.when(inside[n], F.col("amount"))), F.lit(0.0)), 2).alias(f"sum_{n}") for n, _ in spans))


def fresh(column: str) -> Column:
    """Whether a transaction's value is unseen among its customer's earlier ones: an absent (null or empty) device is
    always new, an absent region or email never is."""
    absent = F.col(column).isNull() | (F.col(column).cast("string") == "")
    return F.when(absent, F.lit(column == "device")).otherwise(F.col("us") == F.min("us").over(Window.partitionBy("customer", column)))


def new_entity_check(txn: DataFrame) -> DataFrame:
    """Device, region and email unseen among the customer's earlier transactions (O-7)."""
    return txn.select("txn_id", "customer", fresh("device").alias("new_device"), fresh("region").alias("new_region"), fresh("email").alias("new_email"), F.col("flag_new").alias("identity_flag_new"), F.col("proxy").alias("proxy_flag"))


def geo_impossible(txn: DataFrame, hours: int = 2) -> DataFrame:
    """In-person transactions in another region than the card's previous one less than some hours before (O-8)."""
    t = txn.where("channel = 'in_person'").select("txn_id", "card", "us", "region", F.lag("region").over(by("card")).alias("from_region"), F.lag("us").over(by("card")).alias("from_us"))
    gap = F.col("us") - F.col("from_us")
    return t.where((F.col("region") != F.col("from_region")) & (gap > 0) & (gap < hours * HOUR)).select("txn_id", "card", "from_region", "region", gap.alias("gap_us"))


def money_flow_trace(txn: DataFrame, n: int = 10, when: str | None = None) -> DataFrame:
    """Each card's last transactions in time order, with their running total (O-9)."""
    back = Window.partitionBy("card").orderBy(F.col("us").desc(), F.col("txn_id").desc())
    last = as_of(txn, when).withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    step = F.row_number().over(by("card"))
    running = F.sum("amount").over(by("card").rowsBetween(Window.unboundedPreceding, 0))
    return last.select("card", "txn_id", step.alias("step"), "amount", F.round(running, 4).alias("running"))


def case_history(txn: DataFrame, key: str = "card") -> DataFrame:
    """Closed cases per entity (O-12)."""
    return cases(txn).groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "confirmed_fraud").alias("confirmed"), F.count_if(F.col("outcome") == "cleared").alias("cleared"), F.round(F.sum("exposure"), 2).alias("exposure"))


def playback(txn: DataFrame, breach: float = 1000.0) -> DataFrame:
    """Frames of each card's history: running exposure, new devices, the frame of the first breach (O-37)."""
    w = by("card").rowsBetween(Window.unboundedPreceding, 0)
    t = txn.withColumn("new_device", (F.row_number().over(Window.partitionBy("card", "device").orderBy("us", "txn_id")) == 1))
    t = t.withColumn("frame", F.row_number().over(by("card"))).withColumn("exposure", F.sum("amount").over(w)).withColumn("devices", F.sum(F.col("new_device").cast("long")).over(w))
    first = F.min(F.when(F.col("exposure") >= breach, F.col("frame"))).over(Window.partitionBy("card"))
    return t.select("txn_id", "card", "frame", F.round("exposure", 4).alias("exposure"), "devices", (F.col("frame") == first).alias("breach"), (F.col("frame") >= 3).alias("third_or_later"))
