"""Scoring and decisions per transaction: one projection over joined evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.operators import patterns, profile


def evidence(txn: DataFrame) -> DataFrame:
    """What scoring reads, gathered per transaction in one plan (O-15)."""
    p = patterns.pattern_match(txn).select("txn_id", "best", "confidence")
    v = profile.velocity(txn).select("txn_id", "spike")
    n = profile.new_entity_check(txn).drop("customer")
    g = profile.geo_impossible(txn).select("txn_id", F.lit(True).alias("geo"))
    base = txn.select("txn_id", "card", "customer", "amount", "risk", "is_fraud")
    return base.join(p, "txn_id").join(v, "txn_id").join(n, "txn_id").join(g, "txn_id", "left").withColumn("geo", F.coalesce("geo", F.lit(False)))


def points() -> Column:
    """Risk points, 0 to 100 (O-52a)."""
    c = F.col
    p = 35 * c("risk") + 30 * c("confidence")
    p = p + F.when(c("new_device") | c("identity_flag_new"), 15).otherwise(0) + F.when(c("new_region"), 10).otherwise(0) + F.when(c("new_email"), 10).otherwise(0)
    p = p + F.when(c("proxy_flag"), 15).otherwise(0) + F.when(c("geo"), 20).otherwise(0) + F.when(c("spike") > 3, 15).when(c("spike") > 1.5, 8).otherwise(0)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), p.cast("double")))


def assess(e: DataFrame) -> DataFrame:
    """Probability, verdict and pattern (O-52a)."""
    out = e.withColumn("probability", F.round(points() / 100, 6))
    verdict = F.when(F.col("probability") >= 0.65, "FRAUD").when(F.col("probability") <= 0.25, "LEGITIMATE").otherwise("UNCERTAIN")
    return out.withColumn("verdict", verdict).withColumn("pattern", F.when(F.col("probability") > 0.25, F.col("best")).otherwise("none"))


def next_actions(a: DataFrame) -> DataFrame:
    """Planned actions by verdict and exposure (O-52b)."""
    c = F.col
    first = F.when(c("verdict") == "FRAUD", F.when(c("amount") > 100, "BLOCK_CARD").otherwise("STEP_UP_AUTH")).when(c("verdict") == "UNCERTAIN", "CONTACT_CUSTOMER").otherwise("CLOSE")
    route = F.when(first == "BLOCK_CARD", F.when(c("amount") <= 2500, "L1").otherwise("L2")).otherwise("AUTO")
    return a.select("txn_id", "verdict", first.alias("action"), route.alias("route"))


def value_of_information(a: DataFrame) -> DataFrame:
    """Entropy that each kind of question could remove, over its cost; the best first (O-52c)."""
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("probability")))
    h = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    kinds = F.array(*(F.struct(F.lit(k).alias("question"), F.lit(share).alias("share"), F.lit(cost).alias("cost")) for k, share, cost in (("device_check", 0.3, 0.05), ("history_check", 0.4, 0.10), ("customer_call", 0.9, 2.50))))
    t = a.select("txn_id", h.alias("h"), F.explode(kinds).alias("q"))
    return t.select("txn_id", F.col("q.question").alias("question"), F.round(F.col("h") * F.col("q.share") / F.col("q.cost"), 5).alias("value"))


def budget(a: DataFrame) -> DataFrame:
    """Evidence budget tier (O-52d)."""
    p = F.col("probability")
    return a.select("txn_id", F.when(p > 0.85, "FAST_BLOCK").when(p.between(0.40, 0.75), "DEEP").when(p < 0.30, "LIGHT").otherwise("STANDARD").alias("tier"))


def what_if(a: DataFrame) -> DataFrame:
    """Probability under each scenario of a fixed table, and its change (O-52d)."""
    scenarios = F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(d).alias("shift")) for n, d in (("amount_over_limit", 0.10), ("unlink_device", -0.15), ("customer_denies", 0.25), ("customer_confirms", -0.50))))
    t = a.select("txn_id", "probability", F.explode(scenarios).alias("s"))
    new = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("probability") + F.col("s.shift"))), 6)
    return t.select("txn_id", F.col("s.scenario").alias("scenario"), new.alias("probability"), ((F.col("probability") >= 0.65) != (new >= 0.65)).alias("flips"))


def consensus(scores: DataFrame) -> DataFrame:
    """Weighted verdict of three assessors (fraud, aml, cyber: 0 to 1), confidence from their spread, and the veto (O-52e, O-52f)."""
    f, a, c = F.col("fraud"), F.col("aml"), F.col("cyber")
    weights = lambda x, y, z: x * f + y * a + z * c
    score = F.when((a >= f) & (a >= c), weights(0.35, 0.45, 0.20)).when((c >= f) & (c >= a), weights(0.35, 0.20, 0.45)).otherwise(weights(0.50, 0.25, 0.25))
    mean = (f + a + c) / 3
    spread = (F.pow(f - mean, 2) + F.pow(a - mean, 2) + F.pow(c - mean, 2)) / 3
    confidence = F.greatest(F.lit(0.2), F.least(F.lit(1.0), 1 - 2.5 * spread))
    verdict = F.when(score >= 0.65, "FRAUD").when(score <= 0.25, "LEGITIMATE").otherwise("UNCERTAIN")
    return scores.select("id", F.round(score, 6).alias("score"), F.round(confidence, 6).alias("confidence"), verdict.alias("verdict"), (a >= 0.7).alias("veto"))


def sar(a: DataFrame) -> DataFrame:
    """Report record of each fraud verdict, with a five-part narrative (O-52j)."""
    narrative = F.concat_ws(" ", F.format_string("Subject card %s of customer %s.", F.col("card").cast("string"), F.col("customer").cast("string")), F.format_string("Pattern: %s.", "pattern"), F.format_string("Transaction %s.", F.col("txn_id").cast("string")), F.format_string("Verdict: %s.", "verdict"), F.lit("Filed under internal policy."))
    return a.where("verdict = 'FRAUD'").select("txn_id", narrative.alias("narrative"), F.round("amount", 0).cast("long").alias("amount"), F.length(narrative).between(50, 17000).alias("valid"))


def to_xml(reports: DataFrame) -> DataFrame:
    """The record as XML, with escaped text."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return reports.select("txn_id", F.format_string("<sar><id>%s</id><amount>%s</amount><narrative>%s</narrative></sar>", F.col("txn_id").cast("string"), F.col("amount").cast("string"), esc(F.col("narrative"))).alias("xml"))


def refine(a: DataFrame, rounds: int = 3) -> DataFrame:
    """Invariants enforced, the first violated one per round (O-52g): a block needs a fraud verdict; a close needs none;
    fraud of a large amount is escalated."""
    out = a
    for _ in range(rounds):
        v, x = F.col("verdict"), F.col("action")
        fixed = F.when((x == "BLOCK_CARD") & (v != "FRAUD"), "CONTACT_CUSTOMER").when((x == "CLOSE") & (v == "FRAUD"), "STEP_UP_AUTH").when((v == "FRAUD") & (F.col("amount") > 2500) & (x != "ESCALATE"), "ESCALATE").otherwise(x)
        out = out.withColumn("action", fixed)
    return out
