"""General relational shapes over the star schema: grouping sets, set operations, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exposure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals rolled up by segment and nation."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.rollup("c_mktsegment", "n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def status_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


def active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with open and with finished orders but none pending (intersect, except)."""
    o = table(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select("o_custkey").distinct()
    return of("O").intersect(of("F")).subtract(of("P"))


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


def customers_with_large_orders(spark: SparkSession, sf_dir: str, least: float = 400_000.0) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where(F.col("o_totalprice") >= least)
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


def as_of_status(txn: DataFrame) -> DataFrame:
    """Each transaction with the card's latest earlier error (as-of join): a union and a window, no theta join."""
    left = txn.select("card", "us", "txn_id", F.lit(None).cast("long").alias("error_id"), F.lit(1).alias("side"))
    right = txn.where("is_fraud").select("card", "us", F.lit(None).cast("long").alias("txn_id"), F.col("txn_id").alias("error_id"), F.lit(0).alias("side"))
    w = Window.partitionBy("card").orderBy("us", "side").rowsBetween(Window.unboundedPreceding, 0)
    t = left.unionByName(right).withColumn("error_id", F.last("error_id", ignorenulls=True).over(w))
    return t.where("side = 1").select("txn_id", "error_id")


def interval_pairs(txn: DataFrame, minutes: int = 30) -> DataFrame:
    """Pairs of a card's purchases and later errors within some minutes: an equi-join on card and time buckets, then the
    exact bound, so that no card's history meets itself whole."""
    span = minutes * 60_000_000
    buy = txn.where("merchant like 'purchase%'").select("card", F.col("txn_id").alias("buy_id"), F.col("us").alias("b"), F.explode(F.array(F.floor(F.col("us") / span), F.floor(F.col("us") / span) + 1)).alias("bucket"))
    bad = txn.where("is_fraud").select("card", F.col("txn_id").alias("error_id"), F.col("us").alias("e"), F.floor(F.col("us") / span).alias("bucket"))
    return buy.join(bad, ["card", "bucket"]).where((F.col("e") > F.col("b")) & (F.col("e") - F.col("b") <= span)).select("card", "buy_id", "error_id")


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by flag and status up to a date."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(price), 4).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n"))


def supplier_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-border trade: net price by customer and supplier nation."""
    l, o, c, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation"))
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey).where("c_nationkey <> s_nationkey")
    a, b = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("buyer")), n.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("seller"))
    g = j.groupBy("c_nationkey", "s_nationkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("net"), F.count("*").alias("n"))
    return g.join(a, "c_nationkey").join(b, "s_nationkey").select("buyer", "seller", "net", "n")


def top_customers(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The k customers of each segment with the highest order totals."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    t = o.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).join(c, F.col("o_custkey") == c.c_custkey)
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("total").desc(), "c_custkey"))
    return t.withColumn("rank", rank).where(F.col("rank") <= k).select("c_mktsegment", "c_custkey", "total", "rank")
