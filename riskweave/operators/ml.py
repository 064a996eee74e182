"""Model support: uncertainty, calibration, confusion, stratified samples, active learning, vector precedents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.canonical import DAY, timed


def uncertainty(p: Column) -> tuple[Column, Column]:
    """(entropy in bits, margin) of a probability (O-64)."""
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q)), 1 - 2 * F.abs(q - 0.5)


def uncertain(txn: DataFrame) -> DataFrame:
    h, m = uncertainty(F.col("risk"))
    return txn.select("txn_id", F.round(h, 4).alias("entropy"), F.round(m, 4).alias("margin"))


def topology_flags(txn: DataFrame, low: float = 85.0, limit: float = 100.0) -> DataFrame:
    """Flags of a transaction and its surroundings within a day either way (O-65)."""
    w = timed("card").rangeBetween(-DAY, DAY)
    cards = txn.groupBy("device").agg(F.countDistinct("card").alias("n_cards"))
    t = txn.withColumn("n_near", F.count("*").over(w)).join(cards, "device")
    flags = F.concat_ws(",", F.when(F.col("mcc").isin(6051, 7995, 4829, 6011), "HIGH_RISK_MCC"), F.when((F.col("amount") >= low) & (F.col("amount") < limit), "NEAR_LIMIT"), F.when(F.col("amount") >= limit, "OVER_LIMIT"), F.when(F.col("n_cards") > 1, "SHARED_DEVICE"), F.when(F.col("n_near") >= 4, "DENSE"))
    return t.select("txn_id", flags.alias("flags"))


def select_samples(txn: DataFrame, target: int = 20, scan: int = 2000, per_card: int = 2, per_merchant: int = 3) -> DataFrame:
    """Most informative of the latest transactions, few per card and merchant (O-66). The greedy choice depends on what
    was chosen before; it runs over ``scan`` rows, which is the feature's own limit."""
    h, m = uncertainty(F.col("risk"))
    t = txn.orderBy(F.col("us").desc(), F.col("txn_id").desc()).limit(scan).select("txn_id", "card", "merchant", F.round(0.5 * h + 0.5 * m, 6).alias("value"))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "txn_id"], ascending=[False, True])
        chosen: list[int] = []
        cards: dict = {}
        merchants: dict = {}
        for limit in (per_merchant, target):  # a second pass relaxes the merchants
            for i, card, merchant in zip(pdf["txn_id"], pdf["card"], pdf["merchant"]):
                if len(chosen) < target and i not in chosen and cards.get(card, 0) < per_card and merchants.get(merchant, 0) < limit:
                    chosen.append(i)
                    cards[card] = cards.get(card, 0) + 1
                    merchants[merchant] = merchants.get(merchant, 0) + 1
        out = pdf[pdf["txn_id"].isin(chosen)].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[["rank", "txn_id", "card", "merchant", "value"]]

    return t.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: greedy(pdf.drop(columns="g")), "rank long, txn_id long, card long, merchant string, value double")


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """ECE, MCE and Brier score of (p, y), the last bin closed (O-67)."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1))
    g = pairs.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"))
    gap = F.abs(F.col("conf") - F.col("acc"))
    return g.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def confusion(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, false positive rate and accuracy of (p, y), 0 where undefined (O-68)."""
    hit, y = F.col("p") >= threshold, F.col("y") == 1
    g = pairs.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    div = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    c = F.col
    return g.select("tp", "fp", "fn", "tn", div(c("tp"), c("tp") + c("fp")).alias("precision"), div(c("tp"), c("tp") + c("fn")).alias("recall"), div(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), div(c("fp"), c("fp") + c("tn")).alias("fpr"), div(c("tp") + c("tn"), c("tp") + c("tn") + c("fp") + c("fn")).alias("accuracy"))


def stratified(df: DataFrame, stratum: str, key: str, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """A fixed number of rows per stratum in a seeded order (O-68)."""
    want = F.lit(0)
    for value, n in sizes.items():
        want = F.when(F.col(stratum) == value, n).otherwise(want)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))
    return df.withColumn("rank", rank).where(F.col("rank") <= want).select(key, stratum, "rank")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def precedents(episodes: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The k most alike episodes of the query's own label group by cosine (O-51). Both: id, v, label."""
    q = queries.select(F.col("id").alias("query_id"), F.col("v").alias("q"), "label")
    t = q.join(episodes, "label").where("query_id <> id").select("query_id", "id", F.round(cosine(F.col("q"), F.col("v")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return t.withColumn("rank", rank).where(F.col("rank") <= k)
