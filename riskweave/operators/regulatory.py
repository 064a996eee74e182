"""Regulatory detectors, policy rules, masking, rule mining and case priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.canonical import HOUR, as_of, cases, timed

#: Reporting thresholds by jurisdiction: reporting limit, and the band below it (fixed values).
THRESHOLDS = {"US": (10_000.0, 8_000.0, 9_999.99), "UK": (3_000.0, 2_400.0, 2_999.99), "EU": (2_500.0, 1_800.0, 2_499.99)}
#: High-risk merchant categories: code, risk multiplier, due-diligence and report thresholds, action (fixed values).
MCC_RULES = [
    (6051, 2.0, 1000.0, 2000.0, "RESTRICT_QUASI_CASH"),
    (4829, 2.0, 1500.0, 2500.0, "RESTRICT_OUTBOUND_WIRES"),
    (7995, 2.5, 2000.0, 3000.0, "STEP_UP_AUTH"),
    (5944, 1.75, 2500.0, 5000.0, "ENHANCED_DUE_DILIGENCE"),
    (6211, 1.5, 3000.0, 5000.0, "STEP_UP_AUTH"),
]
#: Category of a product code where no merchant category is given (fixed values).
PRODUCT_MCC = {"C": 6051, "W": 4829}
#: Countries by risk, and those at home (fixed values).
FATF_HIGH = ("IR", "KP", "MM", "SY", "YE", "RU", "999", "OFFSHORE", "HAVEN")
FATF_GREY = ("AE", "PA", "KY", "VG", "BS", "CY", "MT", "888")
DOMESTIC = ("87", "87.0", "US", "USA")


def category(mcc: Column, product: Column) -> Column:
    """The merchant category, or else the product code's."""
    out = F.lit(None).cast("int")
    for code, value in PRODUCT_MCC.items():
        out = F.when(product == code, value).otherwise(out)
    return F.coalesce(mcc, out)


def structuring(txn: DataFrame, scale: float = 1.0, hours: int = 24, jurisdiction: str = "US", key: str = "customer") -> DataFrame:
    """Structuring indicators per entity in the window before its last transaction (O-39); ``scale`` shrinks all limits."""
    limit, low, high = (x * scale for x in THRESHOLDS[jurisdiction])
    end = F.max("us").over(Window.partitionBy(key))
    t = txn.withColumn("end", end).where(F.col("us") >= F.col("end") - hours * HOUR)
    near = F.count_if(F.col("amount") >= 0.7 * limit).over(Window.partitionBy(key).orderBy("us").rangeBetween(-6 * HOUR, 0))
    g = t.withColumn("near", near).groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.max("amount").alias("most"), F.countDistinct("card").alias("n_cards"),
        F.count_if(F.col("amount").between(low, high)).alias("n_band"), F.max("near").alias("near"), F.count_if((F.col("amount") >= 0.25 * low) & (F.col("amount") % 10 == 0)).alias("n_round"),
    )
    c = F.col
    flags = [("CTR_LIMIT", c("total") >= limit), ("SUB_THRESHOLD", c("n_band") >= 2), ("CARD_DISPERSION", (c("n_cards") >= 2) & (c("total") >= limit) & (c("most") < limit)), ("RAPID_NEAR_LIMIT", c("near") >= 3), ("ROUND_SUMS", c("n_round") >= 2)]
    listed = F.concat_ws(",", *(F.when(x, n) for n, x in flags))
    suspicious = (c("n_band") >= 2) | ((c("n_cards") >= 2) & (c("total") >= limit) & (c("most") < limit)) | (c("near") >= 3)
    return g.select(key, "n", "total", "n_cards", listed.alias("indicators"), suspicious.alias("is_structuring"))


def cross_border(txn: DataFrame, hours: int = 48, home: tuple[str, ...] = DOMESTIC, high: tuple[str, ...] = FATF_HIGH, grey: tuple[str, ...] = FATF_GREY, scale: float = 1.0) -> DataFrame:
    """Cross-border layering per card in the window before its last transaction (O-40)."""
    end = F.max("us").over(Window.partitionBy("card"))
    t = txn.withColumn("end", end).where(F.col("us") >= F.col("end") - hours * HOUR)
    place = F.col("region").cast("string")
    out = ~place.isin(*home)
    g = t.groupBy("card").agg(F.count_if(out).alias("n_abroad"), F.countDistinct(F.when(out, F.col("region"))).alias("n_countries"), F.round(F.coalesce(F.sum(F.when(out, F.col("amount"))), F.lit(0.0)), 2).alias("abroad"), F.count_if(place.isin(*high)).alias("n_high"), F.count_if(place.isin(*grey)).alias("n_grey"))
    c = F.col
    layered = ((c("n_countries") >= 3) & (c("n_abroad") >= 2)) | ((c("n_countries") >= 2) & (c("abroad") >= 1000 * scale))
    score = F.least(F.lit(0.99), F.when(c("n_high") > 0, 0.5).when(c("n_grey") > 0, 0.3).otherwise(0.0) + F.when(c("abroad") >= 5000 * scale, 0.3).when(c("abroad") >= 2500 * scale, 0.2).otherwise(0.0) + F.when(layered, 0.25).otherwise(0.0))
    score = F.round(score, 4)
    level = F.when(score >= 0.7, "CRITICAL").when(score >= 0.4, "HIGH").when(score >= 0.15, "MEDIUM").otherwise("LOW")
    return g.withColumn("layered", layered).withColumn("score", score).withColumn("level", level)


def high_risk_mcc(txn: DataFrame, scale: float = 1.0) -> DataFrame:
    """Running exposure at high-risk merchant categories against each category's thresholds (O-41)."""
    rules = txn.sparkSession.createDataFrame(MCC_RULES, "mcc int, factor double, edd double, sar double, action string")
    t = txn.join(F.broadcast(rules), "mcc").select("txn_id", "card", "mcc", "us", "amount", "factor", "edd", "sar", "action")  # the rules are a fixed table
    w = Window.partitionBy("card", "mcc").orderBy("us", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("running", F.sum("amount").over(w))
    n = t.groupBy("card").agg(F.countDistinct("mcc").alias("n_mcc"), F.count("*").alias("n"), F.round(F.max("running"), 4).alias("most"), F.max(F.col("running") >= F.col("edd") * scale).alias("edd"), F.max(F.col("running") >= F.col("sar") * scale).alias("sar"), F.max("factor").alias("factor"), F.concat_ws(",", F.array_sort(F.collect_set("action"))).alias("restrictions"))
    factor = F.col("factor") * F.when(F.col("n_mcc") >= 3, 1.5).when(F.col("n_mcc") == 2, 1.25).otherwise(1.0)
    actions = F.concat_ws(",", F.when(F.col("sar"), "FILE_SAR"), F.when(F.col("edd"), "ENHANCED_DUE_DILIGENCE"), F.lit("MONITOR"))
    return n.select("card", "n_mcc", "n", "most", F.round(factor, 4).alias("factor"), "restrictions", actions.alias("actions"))


def jurisdiction(text: Column) -> Column:
    """UK before EU before US by whole words (O-42)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.rlike(r"\b(uk|gbp|fca|london|united kingdom)\b"), "UK").when(t.rlike(r"\b(eu|eur|euro|gdpr|sepa)\b"), "EU").otherwise("US")


def obligations(c: DataFrame, scale: float = 1.0) -> DataFrame:
    """Filing duty and deadline per case by jurisdiction (O-42); ``c``: case_id, exposure, opened (date), place."""
    limit = F.when(F.col("place") == "UK", 3000 * scale).when(F.col("place") == "EU", 2500 * scale).otherwise(5000 * scale)
    days = F.when(F.col("place") == "UK", 14).when(F.col("place") == "EU", 10).otherwise(30)
    return c.select("case_id", "place", (F.col("exposure") >= limit).alias("must_file"), F.date_format(F.date_add("opened", days), "yyyy-MM-dd").alias("deadline"))


def mask_text(text: Column) -> Column:
    """Card numbers keep their last four digits, mail addresses their first letter (O-43)."""
    cards = F.regexp_replace(text, r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?(\d{4})\b", "****-****-****-$1")
    return F.regexp_replace(cards, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")


def mask_for(role: str, df: DataFrame) -> DataFrame:
    """Ids by role: leads see all, analysts a masked card, others neither card nor customer (O-44)."""
    card = F.col("card").cast("string")
    if role == "lead":
        return df.withColumn("card", card).withColumn("customer", F.col("customer").cast("string"))
    shown = F.concat(F.lit("C****"), F.right(card, F.lit(2)))
    if role == "analyst":
        return df.withColumn("card", shown).withColumn("customer", F.col("customer").cast("string"))
    return df.withColumn("card", F.lit("****")).withColumn("customer", F.lit("****"))


def policy(c: DataFrame) -> DataFrame:
    """Ordered rules, the first that denies wins, else the approval route (O-45, O-46).

    ``c``: case_id, exposure, probability, n_evidence, pattern_new (bool), customer_reply (nullable string).
    """
    x = F.col
    decision = (
        F.when(x("n_evidence") < 1, "DENY_EVIDENCE")
        .when((x("probability") < 0.65) & x("customer_reply").isNull(), "DENY_R8_UNCERTAIN")
        .when(x("customer_reply") == "legitimate", "DENY_R1_CONFIRMED")
        .when(x("pattern_new") & (x("probability") < 0.85), "DENY_R7_NEW_PATTERN")
        .otherwise("ALLOW")
    )
    route = F.when(decision != "ALLOW", "NONE").when(x("exposure") > 10_000, "DIRECTOR").when(x("exposure") > 2_500, "L2").otherwise("L1")
    return c.select("case_id", decision.alias("decision"), route.alias("route"))


def case_facts(txn: DataFrame) -> DataFrame:
    """What policy and rules look at, per case, from its card's earlier transactions."""
    c = cases(txn)
    t = txn.select("card", F.col("us").alias("t"), F.col("amount").alias("a"), F.col("device").alias("d"))
    prior = c.join(t, "card").where(F.col("t") <= F.col("opened_us")).groupBy("case_id").agg(F.count("*").alias("n_txns"), F.countDistinct("d").alias("n_devices"))
    return c.join(prior, "case_id").select("case_id", "card", "customer", "outcome", "exposure", "risk", "n_txns", "n_devices", "opened_us")


def predicates(facts: DataFrame) -> DataFrame:
    """(case_id, predicate): one of each exclusive ladder per case (O-48)."""
    x = F.col
    ladder = F.array(
        F.when(x("risk") >= 0.7, "risk_high").when(x("risk") >= 0.4, "risk_medium").otherwise("risk_low"),
        F.when(x("exposure") >= 150, "exposure_high").when(x("exposure") >= 50, "exposure_medium").otherwise("exposure_low"),
        F.when(x("n_txns") >= 50, "txns_many").when(x("n_txns") >= 10, "txns_some").otherwise("txns_few"),
        F.when(x("n_devices") >= 20, "devices_many").otherwise("devices_few"),
    )
    return facts.select("case_id", "outcome", F.explode(ladder).alias("predicate"))


def mine_rules(facts: DataFrame, support: int = 10, confidence: float = 0.6, most: int = 20) -> DataFrame:
    """Antecedents of one and two predicates for confirmed fraud, by confidence and support (O-48)."""
    p = predicates(facts)
    pairs = p.join(p.select("case_id", F.col("predicate").alias("second")), "case_id").where("predicate < second")
    items = p.select("case_id", "outcome", F.col("predicate").alias("antecedent")).unionByName(pairs.select("case_id", "outcome", F.concat_ws("+", "predicate", "second").alias("antecedent")))
    base = facts.agg((F.count_if(F.col("outcome") == "confirmed_fraud") / F.count("*")).alias("base")).withColumn("one", F.lit(1))
    rules = items.groupBy("antecedent").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "confirmed_fraud").alias("support")).withColumn("confidence", F.col("support") / F.col("n"))
    rules = rules.where((F.col("support") >= support) & (F.col("confidence") >= confidence)).withColumn("one", F.lit(1)).join(F.broadcast(base), "one")
    out = rules.select("antecedent", "support", F.round("confidence", 6).alias("confidence"), F.round(F.col("confidence") / F.col("base"), 6).alias("lift"))
    return out.orderBy(F.col("confidence").desc(), F.col("support").desc(), "antecedent").limit(most)


def apply_rules(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose predicates a case has all (O-49)."""
    own = predicates(facts).groupBy("case_id").agg(F.collect_set("predicate").alias("has"))
    parts = rules.select("antecedent", "confidence", F.explode(F.split("antecedent", r"\+")).alias("predicate"), F.size(F.split("antecedent", r"\+")).alias("size"))
    hits = predicates(facts).select("case_id", "predicate").join(parts, "predicate").groupBy("case_id", "antecedent", "confidence", "size").agg(F.count("*").alias("n")).where("n = size")
    return hits.select("case_id", "antecedent", (F.col("confidence") >= 0.85).alias("strong"))


def rule_chunks(rules: DataFrame) -> DataFrame:
    """Rules as texts for retrieval (O-49)."""
    pct = F.round(F.col("confidence") * 100, 0).cast("long").cast("string")
    return rules.select(F.concat(F.lit("rule-"), F.substring(F.md5(F.col("antecedent").cast("binary")), 1, 8)).alias("chunk_id"), F.concat(F.lit("If "), F.replace("antecedent", F.lit("+"), F.lit(" and ")), F.lit(" then confirmed fraud with confidence "), pct, F.lit(" %, support "), F.col("support").cast("string"), F.lit(".")).alias("text"))


def memory_prior(txn: DataFrame) -> DataFrame:
    """Beta-binomial prior per case from earlier cases of its customer and device; the risk that it adds (O-50)."""
    c = cases(txn)
    w = timed("customer").rangeBetween(Window.unboundedPreceding, -1)
    d = timed("device").rangeBetween(Window.unboundedPreceding, -1)
    c = c.withColumnRenamed("opened_us", "us")
    fraud = F.col("outcome") == "confirmed_fraud"
    t = c.select("case_id", F.count_if(fraud).over(w).alias("confirmed"), F.count_if(~fraud).over(w).alias("cleared"), (F.count_if(fraud).over(d) > 0).alias("device_fraud"))
    posterior = (1 + F.col("confirmed")) / (11 + F.col("confirmed") + F.col("cleared"))
    delta = F.when(F.col("device_fraud"), 6.0).otherwise(0.0) + F.when(F.col("confirmed") > 0, (posterior - 1 / 11) * 20).otherwise(0.0) - F.least(F.lit(10.0), 2.5 * F.col("cleared"))
    return t.select("case_id", "confirmed", "cleared", F.round(posterior, 6).alias("posterior"), F.round(F.greatest(F.lit(-10.0), F.least(F.lit(12.0), delta)), 6).alias("risk_delta"))


#: Compliance checks: framework, name, weight of failing (critical or warning), condition over ``case_facts``.
CHECKS = [
    ("AML", "has_exposure", "critical", "exposure is not null and exposure >= 0"),
    ("AML", "has_history", "warning", "n_txns >= 2"),
    ("FAIRNESS", "not_by_device_alone", "warning", "n_devices < 40"),
    ("AUDIT", "has_outcome", "critical", "outcome in ('confirmed_fraud', 'cleared')"),
    ("AUDIT", "has_time", "critical", "opened_us > 0"),
]


def compliance(facts: DataFrame) -> DataFrame:
    """Checks passed per framework, score and status (O-47)."""
    rows = F.array(*(F.struct(F.lit(f).alias("framework"), F.lit(level).alias("level"), F.expr(cond).alias("passed")) for f, _, level, cond in CHECKS))
    t = facts.select(F.explode(rows).alias("c")).select("c.*")
    g = t.groupBy("framework").agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed") & (F.col("level") == "critical")).alias("critical"), F.count_if(~F.col("passed") & (F.col("level") == "warning")).alias("warnings"))
    score = F.round(F.col("passed") / F.col("n") * 100, 1)
    status = F.when(F.col("critical") > 0, "NON_COMPLIANT").when((F.col("warnings") > 0) | (score < 95), "CONDITIONAL").otherwise("COMPLIANT")
    return g.select("framework", "n", "passed", score.alias("score"), status.alias("status"))
