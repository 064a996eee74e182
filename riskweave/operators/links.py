"""Shared devices, rings, precedents, syndicates and nexuses: equi-joins on shared keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.canonical import as_of, cases


def card_devices(txn: DataFrame, hub_cap: int | None = None) -> DataFrame:
    """Distinct (card, device); devices with more cards than the cap are generic and left out before any join."""
    pairs = txn.where("device is not null").select("card", "device").distinct()
    if hub_cap is None:
        return pairs
    wide = pairs.groupBy("device").agg(F.count("*").alias("n")).where(F.col("n") > hub_cap)
    return pairs.join(wide, "device", "left_anti")


def device_sharing(txn: DataFrame, when: str | None = None) -> DataFrame:
    """Cards, customers and prior cases per device (O-4)."""
    t = as_of(txn, when)
    touched = cases(t).groupBy("device").agg(F.count("*").alias("n_cases"))
    out = t.groupBy("device").agg(F.countDistinct("card").alias("n_cards"), F.countDistinct("customer").alias("n_customers"), F.count("*").alias("n_txns"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.concat_ws(",", F.slice(F.array_sort(F.collect_set("card")), 1, 10)).alias("cards"))
    return out.join(touched, "device", "left").withColumn("n_cases", F.coalesce("n_cases", F.lit(0))).withColumn("is_shared", F.col("n_cards") > 1)


def identity_links(txn: DataFrame, most: int = 15) -> DataFrame:
    """Each card's first other cards on its devices, with the number of devices that they share (O-5).

    No device is too large: the cards that come first among all of a card's links are, on each device that they share,
    among its first ``most`` + 1, so only those are joined and no device's cards are paired with each other.
    """
    d = card_devices(txn)
    first = F.row_number().over(Window.partitionBy("device").orderBy("card"))
    heads = d.withColumn("r", first).where(F.col("r") <= most + 1).select("device", F.col("card").alias("other"))
    pairs = d.select("device", F.col("card").alias("seed")).join(heads, "device").where("seed <> other").groupBy("seed", "other").agg(F.count("*").alias("n_devices"))
    rank = F.row_number().over(Window.partitionBy("seed").orderBy("other"))
    return pairs.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def ring_detection(txn: DataFrame, most: int = 15) -> DataFrame:
    """Rings: a seed with two linked cards at least and a confirmed precedent among them (O-6)."""
    linked = identity_links(txn, most).select("seed", "other")
    members = linked.unionByName(linked.select("seed").distinct().withColumn("other", F.col("seed")))
    fraud = cases(txn).where("outcome = 'confirmed_fraud'").groupBy("card").agg(F.count("*").alias("n"))
    out = members.join(fraud, members.other == fraud.card, "left").groupBy("seed").agg((F.count("*") - 1).alias("n_linked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_precedents"))
    ring = (F.col("n_linked") >= 2) & (F.col("n_precedents") >= 1)
    return out.withColumn("is_ring", ring).withColumn("density", F.least(F.lit(1.0), (F.col("n_linked") + 1) / 5.0))


def similar_cases(txn: DataFrame, most: int = 5) -> DataFrame:
    """Precedents per card: of its customer, then on its devices, each case once (O-10).

    Only cases that can come first are joined. Of a customer those are its first ``most``. Devices count for cards whose
    customers have fewer, and as fewer than ``most`` cases of a device can be the customers' own, its first 2 ``most`` - 1
    hold as many others as are needed.
    """
    c = cases(txn)

    def first(key: str, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(key).orderBy("opened_us", "case_id"))
        return c.where(F.col(key).isNotNull()).select(key, "case_id", "opened_us").distinct().withColumn("r", rank).where(F.col("r") <= n).drop("r")

    mine = txn.select("card", "customer").distinct().join(first("customer", most), "customer").select("card", "case_id", "opened_us").distinct()
    full = mine.groupBy("card").agg(F.count("*").alias("n")).where(F.col("n") >= most).select(F.col("card").alias("full"))
    pairs = card_devices(txn)
    short = pairs.join(full, pairs.card.eqNullSafe(full.full), "left_anti")
    shared = short.join(first("device", 2 * most - 1), "device").select("card", "case_id", "opened_us", F.lit(2).alias("priority"))
    once = mine.withColumn("priority", F.lit(1)).unionByName(shared).groupBy("card", "case_id", "opened_us").agg(F.min("priority").alias("priority"))
    rank = F.row_number().over(Window.partitionBy("card").orderBy("priority", "opened_us", "case_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("card", "case_id", F.when(F.col("priority") == 1, "same_customer").otherwise("shared_device").alias("basis"), "rank")


def case_devices(txn: DataFrame) -> DataFrame:
    """Each case's devices once (S3)."""
    return cases(txn).select("case_id", "device").distinct()


def case_subgraph(txn: DataFrame, most_txns: int = 5, most_peers: int = 2) -> DataFrame:
    """Display graph of each case as edges: customer, card, some transactions, device, peers on it (O-13)."""
    c = cases(txn)
    e = lambda src, kind, dst: (src.cast("string").alias("src"), F.lit(kind).alias("kind"), dst.cast("string").alias("dst"))
    base = c.select("case_id", *e(F.col("case_id"), "INVESTIGATES", F.col("card"))).unionByName(c.select("case_id", *e(F.col("customer"), "OWNS", F.col("card")))).unionByName(c.select("case_id", *e(F.col("card"), "USED", F.col("device"))))
    last = F.row_number().over(Window.partitionBy("card").orderBy(F.col("us").desc(), F.col("txn_id").desc()))
    recent = txn.withColumn("r", last).where(F.col("r") <= most_txns).select("card", F.col("txn_id").alias("t"))
    moves = c.join(recent, "card").select("case_id", *e(F.col("card"), "MADE", F.col("t")))
    pairs = card_devices(txn).select("device", F.col("card").alias("peer"))
    peers = c.join(pairs, "device").where("peer <> card")
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("peer"))
    shares = peers.withColumn("r", rank).where(F.col("r") <= most_peers).select("case_id", *e(F.col("peer"), "SHARES", F.col("device")))
    return base.unionByName(moves).unionByName(shares)


def syndicate_merchants(txn: DataFrame) -> DataFrame:
    """Merchants that several member cards of a customer group use, with collusion scores (O-32)."""
    out = txn.groupBy("customer", "merchant").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("exposure"), F.countDistinct("card").alias("n_cards"), F.round(F.avg("risk"), 6).alias("mean_risk"), F.countDistinct("channel").alias("n_channels"))
    score = F.least(F.lit(0.99), F.when(F.col("n_cards") >= 3, 0.5).otherwise(0.3) + F.when(F.col("exposure") >= 5000, 0.35).when(F.col("exposure") >= 1000, 0.2).otherwise(0.0) + F.when(F.col("mean_risk") >= 0.5, 0.15).otherwise(0.0))
    return out.where("n_cards >= 2").withColumn("score", F.round(score, 4))


def card_syndicates(txn: DataFrame, most: int = 15) -> DataFrame:
    """Merchants that a card shares with its first device peers (O-33)."""
    pairs = identity_links(txn, most).select("seed", "other")
    visits = txn.select("card", "merchant").distinct()
    a, b = visits.select(F.col("card").alias("seed"), "merchant"), visits.select(F.col("card").alias("other"), "merchant")
    shared = pairs.join(a, "seed").join(b, ["other", "merchant"])
    return shared.groupBy("seed").agg(F.countDistinct("merchant").alias("n_merchants"), F.countDistinct("other").alias("n_peers")).withColumn("score", F.least(F.lit(0.99), F.round(0.3 * F.col("n_merchants"), 4)))


def nexus(txn: DataFrame, least: int = 2) -> DataFrame:
    """Nexuses: devices on which confirmed cases of several cards meet; id from the device's hash (O-34)."""
    c = cases(txn).where("outcome = 'confirmed_fraud'")
    out = c.groupBy("device").agg(F.countDistinct("card").alias("n_cards"), F.count("*").alias("n_cases"), F.round(F.sum("exposure"), 2).alias("exposure"), F.concat_ws(",", F.array_sort(F.collect_set("case_id"))).alias("cases"))
    threat = F.when(F.col("exposure") >= 10_000, "CRITICAL").when(F.col("exposure") >= 2_500, "HIGH").otherwise("MEDIUM")
    return out.where(F.col("n_cards") >= least).select(F.concat(F.lit("NX-"), F.substring(F.md5(F.col("device").cast("binary")), 1, 8)).alias("nexus_id"), "device", "n_cards", "n_cases", "exposure", "cases", threat.alias("threat"))


def cross_case_links(txn: DataFrame) -> DataFrame:
    """Pairs of confirmed cases of different cards on one device (O-34)."""
    c = cases(txn).where("outcome = 'confirmed_fraud'").select("device", "case_id", "card")
    a, b = (c.select("device", F.col("case_id").alias(f"{x}_case"), F.col("card").alias(f"{x}_card")) for x in "ab")
    return a.join(b, "device").where("a_case < b_case and a_card <> b_card").select("a_case", "b_case", "device")


def shared_infrastructure(txn: DataFrame) -> DataFrame:
    """Weight between customers: 2 per shared device, 1 per shared merchant (O-36)."""
    def overlap(column: str, weight: float) -> DataFrame:
        d = txn.select("customer", column).distinct()
        a, b = d.select(column, F.col("customer").alias("a")), d.select(column, F.col("customer").alias("b"))
        return a.join(b, column).where("a < b").groupBy("a", "b").agg((F.count("*") * weight).alias("w"))
    return overlap("device", 2.0).unionByName(overlap("merchant", 1.0)).groupBy("a", "b").agg(F.sum("w").alias("weight"))


def circle_layout(nodes: DataFrame, radius: float = 100.0) -> DataFrame:
    """Nodes (id) on a circle, in the order of their ids (O-36). For display: the id's rank needs all rows, so nodes are
    the few groups of a view."""
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    angle = 2 * F.pi() * (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("id")) - 1) / n
    return nodes.select("id", F.round(radius * F.cos(angle), 6).alias("x"), F.round(radius * F.sin(angle), 6).alias("y"))
