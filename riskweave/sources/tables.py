"""Sources and sinks: schema-first CSV and Parquet scans, lookup joins, snapshots, JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSACTIONS = "TransactionID string, TransactionDT long, TransactionAmt double, ProductCD string, card1 string, card2 string, card3 string, card4 string, card5 string, card6 string, addr1 string, addr2 string, P_emaildomain string, R_emaildomain string, customer_id string, ts string, channel string, risk_score double"
IDENTITY = "TransactionID string, DeviceType string, DeviceInfo string, id_15 string, id_23 string, id_30 string, id_31 string, id_33 string"
CLOSED_CASES = "case_id string, customer_id string, card_id string, opened_at string, closed_at string, outcome string, pattern string, first_fraud_txn_id string, txn_ids string, n_txns int, exposure_usd double, connected_card_ids string, actions_taken string, report_filed string, analyst_notes string"
CASE_PACK = "case_id string, opened_at string, trigger_type string, trigger_text string, flagged_txn_id string, card_id string, customer_id string, risk_score double"
LISTS = ["txn_ids", "connected_card_ids", "actions_taken"]


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Only the schema's columns, found by the header's names whatever else the file has."""
    wanted = [c.strip().split(" ") for c in schema.split(",")]
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = set(raw.columns)
    return raw.select(*((F.col(f"`{n}`").try_cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in wanted))


def transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Scan with projection; times parsed, missing amounts and scores 0, blank texts null (S1)."""
    t = _csv(spark, path, TRANSACTIONS)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return t.withColumns({"ts": F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ss")), "TransactionAmt": F.coalesce("TransactionAmt", F.lit(0.0)), "risk_score": F.coalesce("risk_score", F.lit(0.0)), **{c: blank(c) for c in ("addr1", "addr2", "P_emaildomain", "R_emaildomain")}})


def with_identity(txn: DataFrame, identity: DataFrame) -> DataFrame:
    """Left lookup of a transaction's device; Catalyst broadcasts the identities if they are small (S2)."""
    from riskweave.operators.canonical import device_key

    device = identity.select("TransactionID", device_key(F.col("DeviceInfo"), F.col("id_30"), F.col("id_31"), F.col("id_33")).alias("device_profile"), "DeviceType", "id_15", "id_23")
    return txn.join(device, "TransactionID", "left")


def closed_cases_csv(spark: SparkSession, path: str) -> DataFrame:
    """Closed cases; pipe-separated lists become arrays."""
    t = _csv(spark, path, CLOSED_CASES)
    return t.withColumns({c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: x != "") for c in LISTS})


def case_pack_csv(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, CASE_PACK)


def case_device_index(closed: DataFrame, txn: DataFrame) -> DataFrame:
    """(case_id, device_profile), each once, by the transactions that a case lists (S3)."""
    listed = closed.select("case_id", F.explode("txn_ids").alias("TransactionID"))
    return listed.join(txn.where("device_profile is not null").select("TransactionID", "device_profile"), "TransactionID").select("case_id", "device_profile").distinct()


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Snapshot as Parquet (S4, S8)."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_or_build(spark: SparkSession, path: str, build) -> DataFrame:
    """The snapshot, or what ``build(spark)`` gives, saved first."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        save(build(spark), path)
    return load(spark, path)


def save_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row (S6, S7)."""
    df.write.mode("overwrite").json(path)


def load_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def webhook_rows(alerts: DataFrame, secret: str) -> DataFrame:
    """Deliveries of alerts: body and signature (S12); failed ones go on with ``integrity.backoff``."""
    from riskweave.operators.integrity import sign

    body = F.to_json(F.struct(*alerts.columns))
    return alerts.select(body.alias("body"), sign(secret, F.col("us"), body).alias("signature"))
