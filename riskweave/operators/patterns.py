"""Pattern signatures, temporal motifs, bursts and the edge decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.operators.canonical import DAY, HOUR, by, timed
from riskweave.operators.profile import fresh


def pattern_match(txn: DataFrame, window: int = HOUR, tiny: float = 5.0, least: float = 20.0) -> DataFrame:
    """Five signatures per transaction, each with its confidence and whether it matches; the best one, ties to the
    earlier (O-11). A match may have a low confidence (a proxy alone), and a confidence no match."""
    w = timed("card")
    online = F.col("channel") == "online"
    small = F.count_if(online & (F.col("amount") < tiny)).over(w.rangeBetween(-window, 0)) - F.when(online & (F.col("amount") < tiny), 1).otherwise(0)
    past = w.rangeBetween(Window.unboundedPreceding, -1)
    t = txn.select(
        "txn_id", "card", "amount", online.alias("online"), small.alias("small"), F.count_if(online).over(w.rangeBetween(-2 * DAY, 0)).alias("recent"), F.max("amount").over(past).alias("most"), F.count("*").over(past).alias("n_before"),
        fresh("device").alias("nd"), fresh("region").alias("nr"), fresh("email").alias("ne"), "flag_new", "proxy",
    )
    c = F.col
    no = F.lit(False)
    unusual = (c("n_before") > 3) & F.coalesce(c("amount") > 1.5 * c("most"), no)
    signatures = {
        "card_testing": ((c("small") >= 3) & (c("amount") > least), F.when((c("small") >= 3) & (c("amount") > least), 0.85).when(c("small") >= 2, 0.5).otherwise(0.0)),
        "card_not_present_fraud": (c("online") & ((c("recent") >= 2) | unusual), F.when(c("online") & (c("recent") >= 2), 0.70).when(c("online"), 0.5).otherwise(0.1)),
        "card_not_present_new_device": (c("online") & (c("nd") | c("flag_new") | c("proxy")), F.when(c("online") & (c("nd") | c("flag_new")), 0.80).otherwise(0.1)),
        "out_of_region_use": (~c("online") & c("nr"), F.when(~c("online") & c("nr"), 0.75).otherwise(0.1)),
        "account_takeover": (c("nd") & c("ne") & c("online"), F.when(c("nd") & c("ne"), 0.75).otherwise(0.15)),
    }
    names = list(signatures)
    out = t.select("txn_id", *(x.cast("double").alias(n) for n, (_, x) in signatures.items()), *(F.coalesce(m, no).alias(f"{n}_match") for n, (m, _) in signatures.items()))
    best = F.greatest(*names)
    pick = F.lit(names[-1])
    for n in reversed(names[:-1]):
        pick = F.when(F.col(n) == best, n).otherwise(pick)
    return out.withColumn("best", pick).withColumn("confidence", best)


def fan_out(txn: DataFrame, least: int = 4) -> DataFrame:
    """Cards with many merchants within the input's window (O-19)."""
    return txn.groupBy("card").agg(F.countDistinct("merchant").alias("n_merchants"), F.round(F.sum("amount"), 2).alias("total")).where(F.col("n_merchants") >= least)


def fan_in(txn: DataFrame, least: int = 3) -> DataFrame:
    return txn.groupBy("merchant").agg(F.countDistinct("card").alias("n_cards"), F.round(F.sum("amount"), 2).alias("total")).where(F.col("n_cards") >= least)


#: Parts among which a customer's cards are dealt when they are paired.
PARTS = 8
#: Merchants per word of bits.
WORD = 64


def bipartite_mesh(txn: DataFrame, least_txns: int = 2, shared: int = 2) -> DataFrame:
    """Pairs of cards of one customer with some transactions each and several merchants in common.

    A card is one row with its merchants, so a pair is one row from the start, and goes out as it is joined. Only a pair
    whose cards both have several customers can meet more than once; those are grouped.
    """
    c = F.col
    # nulls are in no pair; left out here, all uses read one exchange
    cards = txn.where("customer is not null and card is not null").groupBy("customer", "card").agg(F.count("*").alias("n"), F.collect_set("merchant").alias("m")).where((c("n") >= least_txns) & (F.size("m") > 0))
    cards = cards.select("customer", "card", "m", (F.count("*").over(Window.partitionBy("card")) > 1).alias("several"))
    # a customer's most frequent merchants are bits of a word, its others are compared by name
    counted = cards.select("customer", F.explode("m").alias("merchant")).groupBy("customer", "merchant").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("customer").orderBy(c("n").desc(), "merchant"))
    top = counted.withColumn("r", rank).where(c("r") <= WORD).groupBy("customer").agg(F.array_sort(F.collect_list("merchant")).alias("top"))
    zero = F.lit(0).cast("long")
    bits = F.transform("top", lambda x, i: F.when(F.array_contains("m", x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(zero))
    cards = cards.join(top, "customer").select("customer", "card", "m", "several", F.aggregate(bits, zero, lambda x, y: x.bitwiseOR(y)).alias("word"), F.array_except("m", "top").alias("rest"))

    def met(cards: DataFrame, *columns: str) -> DataFrame:
        n = int(cards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        own = lambda x, part: cards.select("customer", part.alias("part"), c("card").alias(x), *(c(y).alias(f"{y}_{x}") for y in columns)).repartition(n, "customer", "part")
        a, b = own("a", F.explode(F.array(*map(F.lit, range(PARTS))))), own("b", F.pmod(F.xxhash64("card"), F.lit(PARTS)).cast("int"))
        return a.hint("merge").join(b.hint("merge"), ["customer", "part"]).where("a < b")

    both = F.when((F.size("rest_a") == 0) | (F.size("rest_b") == 0), 0).otherwise(F.size(F.array_intersect("rest_a", "rest_b")))
    once = met(cards, "word", "rest", "several").where("not (several_a and several_b)").select("a", "b", (F.bit_count(c("word_a").bitwiseAND(c("word_b"))) + both).cast("long").alias("n_shared"))
    again = met(cards.where("several"), "m").select("a", "b", F.explode(F.array_intersect("m_a", "m_b")).alias("merchant")).groupBy("a", "b").agg(F.countDistinct("merchant").alias("n_shared"))
    return once.unionByName(again).where(c("n_shared") >= shared)


def temporal_chain(txn: DataFrame, gap: int = 2 * HOUR, least: int = 3) -> DataFrame:
    """Runs of a card's transactions with no gap over the limit: islands by a running count of gaps."""
    t = txn.withColumn("brk", F.when(F.col("us") - F.lag("us").over(by("card")) <= gap, 0).otherwise(1))
    t = t.withColumn("chain", F.sum("brk").over(by("card").rowsBetween(Window.unboundedPreceding, 0)))
    return t.groupBy("card", "chain").agg(F.count("*").alias("n"), F.min("us").alias("begin_us"), F.max("us").alias("end_us"), F.round(F.sum("amount"), 2).alias("total")).where(F.col("n") >= least).drop("chain")


def sharing_triangle(txn: DataFrame, hub_cap: int = 15, visited: DataFrame | None = None) -> DataFrame:
    """Pairs of cards on one device that also have a merchant in common. ``visited`` has each card's set of merchants
    (card, m), where it is known already."""
    from riskweave.operators.links import card_devices

    d = card_devices(txn, hub_cap)
    a, b = (d.select("device", F.col("card").alias(x)) for x in "ab")
    pairs = a.join(b, "device").where("a < b").select("a", "b").distinct()
    own = merchants(txn) if visited is None else visited
    x, y = (own.select(F.col("card").alias(c), F.col("m").alias(f"m_{c}")) for c in "ab")
    common = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("m_a", "m_b")).cast("long").alias("n_merchants"))
    return common.where("n_merchants > 0")


def merchants(txn: DataFrame) -> DataFrame:
    """(card, m): each card's set of merchants."""
    return txn.where("card is not null").groupBy("card").agg(F.collect_set("merchant").alias("m"))


def motif_score(txn: DataFrame) -> DataFrame:
    """Capped weighted sum of the five motifs' counts per card, its level and dominant motif (O-20)."""
    of_pairs = lambda df, name: df.select(F.explode(F.array("a", "b")).alias("card")).groupBy("card").agg(F.count("*").alias(name))
    # a card's merchants are gathered once, for fans (as ``fan_out`` and ``fan_in``) and triangles
    visited = merchants(txn)
    visits = visited.select("card", F.explode("m").alias("merchant"))
    busy = visits.groupBy("merchant").agg(F.count("*").alias("n_cards")).where("n_cards >= 3").select("merchant")
    counts = [
        (visited.where(F.size("m") >= 4).select("card", F.lit(1).cast("long").alias("n1")), 0.20, 0.40, "fan_out"),
        (visits.join(busy, "merchant").groupBy("card").agg(F.count("*").alias("n2")), 0.25, 0.50, "fan_in"),
        (of_pairs(bipartite_mesh(txn), "n3"), 0.30, 0.60, "bipartite_mesh"),
        (temporal_chain(txn).groupBy("card").agg(F.count("*").alias("n4")), 0.20, 0.40, "temporal_chain"),
        (of_pairs(sharing_triangle(txn, visited=visited), "n5"), 0.25, 0.50, "sharing_triangle"),
    ]
    out = txn.select("card").distinct()
    parts = []
    for df, weight, cap, name in counts:
        column = df.columns[-1]
        out = out.join(df, "card", "left")
        parts.append((F.least(F.lit(cap), weight * F.coalesce(F.col(column), F.lit(0))), name))
    score = F.round(F.least(F.lit(1.0), sum((p for p, _ in parts), F.lit(0.0))), 4)
    best = F.greatest(*(p for p, _ in parts))
    dominant = F.lit(parts[-1][1])
    for p, n in reversed(parts[:-1]):
        dominant = F.when(p == best, n).otherwise(dominant)
    level = F.when(score >= 0.7, "CRITICAL").when(score >= 0.4, "HIGH").when(score >= 0.2, "MEDIUM").when(score > 0, "LOW").otherwise("NONE")
    return out.select("card", score.alias("score"), level.alias("level"), F.when(best > 0, dominant).alias("dominant"))


def burst_cluster(txn: DataFrame, hours: int = 24) -> DataFrame:
    """Bursts per transaction on its device, or on its card without one: cards, customers, exposure, small amounts and
    the gaps within the window before it; gaps of one rhythm are a bot's (O-21)."""
    c = F.col
    t = txn.withColumn("key", F.coalesce(F.nullif(c("device"), F.lit("")), F.concat(F.lit("card:"), c("card").cast("string"))))
    t = t.withColumn("gap", (c("us") - F.lag("us").over(by("key"))).cast("decimal(18,0)"))
    w = Window.partitionBy("key").orderBy("us").rangeBetween(-hours * HOUR, 0)
    several = lambda x: F.size(F.collect_set(x).over(w)).cast("long")
    # the first one's gap leads out of the window; integers, as it may exceed all others
    outside = F.coalesce(F.min(F.struct("us", "txn_id", "gap")).over(w)["gap"], F.lit(0).cast("decimal(18,0)"))
    squares = F.coalesce(F.sum(c("gap") * c("gap")).over(w), F.lit(0).cast("decimal(38,0)")) - outside * outside
    span = (c("us") - F.min("us").over(w)).cast("decimal(18,0)")
    t = t.select("txn_id", "device", F.count("*").over(w).alias("n"), several("card").alias("n_cards"), several("customer").alias("n_customers"), F.round(F.sum("amount").over(w), 2).alias("exposure"), (F.count_if(c("amount") <= 5).over(w) / F.count("*").over(w)).alias("micro"), span.alias("span"), squares.alias("squares"))
    m = c("n") - 1
    mean = F.when(m > 0, F.round(c("span").cast("double") / m / 1e6, 3)).otherwise(0.0)
    std = F.when(m > 0, F.round(F.sqrt((m.cast("decimal(10,0)") * c("squares") - c("span") * c("span")).cast("double")) / m / 1e6, 3)).otherwise(0.0)
    bot = (c("n") >= 3) & (std > 0) & (std <= 120)
    burst = ((c("n_cards") >= 2) & (c("n") >= 3) & F.lit(hours <= 24)) | ((c("n_cards") >= 3) & (c("n") >= 3)) | ((c("n") >= 4) & (c("micro") >= 0.5))
    confidence = F.when(burst, F.round(F.least(F.lit(0.98), 0.70 + 0.05 * c("n_cards") + 0.10 * c("micro")), 4)).otherwise(0.0)
    return t.select("txn_id", "device", "n", "n_cards", "n_customers", "exposure", F.round("micro", 4).alias("micro"), mean.alias("mean_gap"), std.alias("std_gap"), bot.alias("is_bot"), burst.alias("is_burst"), confidence.alias("confidence"))


def undocumented(txn: DataFrame) -> DataFrame:
    """First signature in priority that a transaction shows at its time (O-22): a proxy on a shared device, a device of
    many owners, a spike on a shared device, several impossible movements. Without a device none is shared."""
    c = F.col
    known = c("device").isNotNull() & (c("device") != "")
    first = lambda x: F.when(F.row_number().over(Window.partitionBy("device", x).orderBy("us", "txn_id")) == 1, 1).otherwise(0)
    card, before = timed("card"), by("card").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(c("channel") == "in_person", F.struct("region", "us")), ignorenulls=True).over(before)
    t = txn.withColumn("fc", first("card")).withColumn("fm", first("customer")).withColumn("last", last)
    gap = c("us") - c("last.us")
    t = t.withColumn("hop", (c("channel") == "in_person") & (c("region") != c("last.region")) & (gap > 0) & (gap < 2 * HOUR))
    upto = timed("device").rangeBetween(Window.unboundedPreceding, 0)
    hour, week = (F.count("*").over(card.rangeBetween(-x, 0)) for x in (HOUR, 7 * DAY))
    t = t.select(
        "txn_id", "device", "proxy", *(F.when(known, F.sum(x).over(upto)).otherwise(1).alias(y) for x, y in (("fc", "n"), ("fm", "m"))),
        F.round(hour / (week / 168.0 + 0.05), 2).alias("spike"), F.count_if("hop").over(card.rangeBetween(Window.unboundedPreceding, 0)).alias("hops"),
    )
    n = c("n")
    rules = [
        ("proxy_rotation_syndicate", (n >= 2) & c("proxy"), F.least(F.lit(0.95), 0.70 + 0.05 * n)),
        ("device_pooling_nexus", (n >= 3) & (c("m") >= 3), F.least(F.lit(0.92), 0.65 + 0.05 * n)),
        ("coordinated_burst_nexus", (n >= 2) & (c("spike") >= 3), F.lit(0.85)),
        ("impossible_geo_dispersion", c("hops") >= 2, F.lit(0.80)),
    ]
    name, confidence = F.lit(None).cast("string"), F.lit(None).cast("double")
    for x, rule, value in reversed(rules):
        name, confidence = F.when(rule, x).otherwise(name), F.when(rule, value).otherwise(confidence)
    return t.select("txn_id", "device", name.alias("signature"), F.round(confidence, 2).alias("confidence")).where("signature is not null")


def decay_weight(age_us: Column, is_fraud: Column, risk: Column, half_life_days: float = 30.0) -> Column:
    """Edge weight: importance times two to the minus age over half-life, 1 at most; 0 for the future (O-25)."""
    importance = F.when(is_fraud, 4.0).when(risk >= 0.70, 2.0).when(risk >= 0.40, 1.5).otherwise(1.0)
    return F.when(age_us < 0, 0.0).otherwise(F.least(F.lit(1.0), importance * F.pow(F.lit(2.0), -(age_us / DAY) / half_life_days)))


def prune_edges(txn: DataFrame, when: str, half_life_days: float = 30.0, least: float = 0.05, most: int = 50) -> DataFrame:
    """Each card's strongest edges at a time: fraud first, then by weight (O-26)."""
    at = F.unix_micros(F.lit(when).cast("timestamp"))
    w = txn.select("txn_id", "card", "is_fraud", F.round(decay_weight(at - F.col("us"), F.col("is_fraud"), F.col("risk"), half_life_days), 6).alias("weight"), (F.col("us") > at).alias("future"))
    kept = w.where("not future").where(F.col("is_fraud") | (F.col("weight") >= least))
    rank = F.row_number().over(Window.partitionBy("card").orderBy(F.col("is_fraud").desc(), F.col("weight").desc(), "txn_id"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= most).select("card", "txn_id", "is_fraud", "weight", "rank")


def prune_stats(txn: DataFrame, when: str, most: int = 10) -> DataFrame:
    """Edges before and after pruning per card (O-27)."""
    kept = prune_edges(txn, when, most=most).groupBy("card").agg(F.count("*").alias("kept"))
    out = txn.where(F.col("ts") <= F.lit(when).cast("timestamp")).groupBy("card").agg(F.count("*").alias("edges")).join(kept, "card", "left")
    return out.select("card", "edges", F.coalesce("kept", F.lit(0)).alias("kept"), F.round(F.coalesce("kept", F.lit(0)) / F.col("edges"), 4).alias("ratio"))
