"""Registry of the analytics queries and of the SQL that they are compared with.

Thresholds are the operators' parameters; those that the reference tables are too sparse for are given here explicitly,
and the SQL repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import canonical, decision, graphs, integrity, linkage, links, ml, patterns, profile, regulatory, relational, text
from riskweave.plans.oracles import ORACLE_SQL
from riskweave.sources import tables
from riskweave.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
AS_OF, BEFORE = "2024-01-20 00:00:00", "2024-01-10 00:00:00"
HUB_CAP = 60


def _on(f: Callable[..., DataFrame], *args, **kw) -> Query:
    """An operator over the canonical transactions."""
    return lambda spark, sf_dir: f(canonical.transactions(spark, sf_dir), *args, **kw)


def _facts(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(regulatory.case_facts(canonical.transactions(spark, sf_dir)))


def _assessed(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(decision.assess(decision.evidence(canonical.transactions(spark, sf_dir))))


def _table(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(relational.table(spark, sf_dir, name))


def _decay(t: DataFrame) -> DataFrame:
    at = F.unix_micros(F.lit(AS_OF).cast("timestamp"))
    return t.select("txn_id", F.round(patterns.decay_weight(at - F.col("us"), F.col("is_fraud"), F.col("risk")), 6).cast("double").alias("weight"))


def _ego(t: DataFrame) -> DataFrame:
    e = graphs.edges(t, HUB_CAP)
    return graphs.ego_net(e, e.where(F.col("src").startswith("c")).select(F.col("src").alias("id")).distinct())


def _obligations(t: DataFrame) -> DataFrame:
    place = F.element_at(F.array(F.lit("US"), F.lit("UK"), F.lit("EU")), (F.col("txn_id") % 3 + 1).cast("int"))
    c = canonical.cases(t).select("case_id", "exposure", F.to_date(F.timestamp_micros("opened_us")).alias("opened"), place.alias("place"))
    return regulatory.obligations(c, scale=0.01)


def _policy(facts: DataFrame) -> DataFrame:
    reply = F.when(F.col("outcome") == "cleared", "legitimate")
    return regulatory.policy(facts.select("case_id", "exposure", F.col("risk").alias("probability"), F.col("n_txns").alias("n_evidence"), (F.col("n_devices") < 3).alias("pattern_new"), reply.alias("customer_reply")))


def _consensus(t: DataFrame) -> DataFrame:
    return decision.consensus(t.select(F.col("txn_id").alias("id"), F.col("risk").alias("fraud"), F.least(F.lit(1.0), F.col("amount") / 100).alias("aml"), F.when(F.col("proxy"), 0.8).otherwise(0.2).alias("cyber")))


def _labelled(t: DataFrame) -> DataFrame:
    return t.select(F.col("risk").alias("p"), F.col("is_fraud").cast("int").alias("y"))


def _precedents(e: DataFrame) -> DataFrame:
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return ml.precedents(rows, rows.where("id % 50 = 0")).select("query_id", "id", "score", "rank")


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = relational.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text.bm25(relational.table(spark, sf_dir, "documents"), asked)


def _retrieval(b: DataFrame) -> DataFrame:
    ranked = text.bm25(b.select(F.col("item_id").alias("doc_id"), "text"), b.select(F.col("item_id").alias("query_id"), "text"))
    return text.retrieval_quality(ranked, b.select(F.col("item_id").alias("query_id"), F.col("item_id").alias("expected")))


def _grounding(t: DataFrame) -> DataFrame:
    """Narratives that cite their case, and an unknown one where the card is even."""
    c = canonical.cases(t)
    narrative = F.concat(F.lit("Opened "), "case_id", F.when(F.col("card") % 2 == 0, F.lit(" after X-1")).otherwise(F.lit("")))
    return text.grounding(c.select(F.col("case_id").alias("id"), narrative.alias("narrative"), F.array("case_id").alias("known")))


def _ledger(t: DataFrame) -> DataFrame:
    rows = canonical.cases(t).select("card", F.col("txn_id").alias("seq"), F.concat_ws("|", "case_id", "outcome").alias("payload"))
    return integrity.verify(integrity.append(rows, "card"), "card")


def _merkle(t: DataFrame) -> DataFrame:
    return integrity.merkle_roots(canonical.cases(t), "card", "txn_id", "case_id")


def _bridges(t: DataFrame) -> DataFrame:
    e = graphs.edges(t, HUB_CAP)
    return graphs.bridges(e, graphs.ego_net(e, e.where(F.col("src").startswith("c")).select(F.col("src").alias("id")).distinct()))


def _hybrid(t: DataFrame) -> DataFrame:
    """Cases of a card's customer (structure) and on its merchants' regions with large exposure (score)."""
    c = canonical.cases(t).withColumn("age_days", (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.col("opened_us")) / canonical.DAY)
    cards = t.select(F.col("card").alias("query_id"), "customer").distinct()
    return text.hybrid_by(cards, c.select("customer", "case_id", "age_days"), c.where("exposure >= 20").select(F.col("card").alias("query_id"), "case_id", (F.col("exposure") / 25).alias("score"), "age_days"), "customer")


def _resolved(t: DataFrame) -> DataFrame:
    """Cards by four fallbacks, a tenth of the transactions known."""
    rows = t.select("txn_id", F.col("customer").alias("customer_id"), "region", "mcc", "channel", "card")
    known = rows.where("txn_id % 10 = 0 and customer_id < 40").select("txn_id", F.concat(F.lit("K"), F.col("card").cast("string")).alias("card_id"))
    return canonical.resolve_cards(rows.drop("card"), known, ["region", "mcc", "channel", "customer_id"]).select("txn_id", "card_id")


def _refined(a: DataFrame) -> DataFrame:
    plan = decision.next_actions(a).select("txn_id", "action")
    return decision.refine(a.withColumn("amount", F.col("amount") * 100).join(plan, "txn_id")).select("txn_id", "verdict", "action")


def _backoff(t: DataFrame) -> DataFrame:
    wait, state = integrity.backoff(F.col("txn_id") % 8 + 1)
    return t.select("txn_id", wait.alias("wait"), state.alias("state"))


QUERIES: dict[str, Query] = {
    "canonical_transactions": _on(lambda t: t.drop("ts")),
    "case_devices": _on(links.case_devices),
    "entity_profile": _on(profile.entity_profile),
    "txn_context": _on(profile.txn_context),
    "velocity": _on(profile.velocity),
    "velocity_at": _on(profile.velocity_at, AS_OF),
    "device_sharing": _on(links.device_sharing),
    "identity_links": _on(links.identity_links),
    "ring_detection": _on(links.ring_detection),
    "new_entity_check": _on(profile.new_entity_check),
    "geo_impossible": _on(profile.geo_impossible),
    "money_flow_trace": _on(profile.money_flow_trace),
    "similar_cases": _on(links.similar_cases),
    "pattern_match": _on(patterns.pattern_match),
    "case_history": _on(profile.case_history),
    "case_subgraph": _on(links.case_subgraph),
    "ego_net": _on(_ego),
    "communities": _on(graphs.communities, 3, HUB_CAP),
    "contagion": _on(graphs.contagion, 4, 0.15, HUB_CAP),
    "node_features": _on(graphs.node_features, HUB_CAP),
    "attention_pool": _on(graphs.attention_pool),
    "fan_out": _on(patterns.fan_out),
    "fan_in": _on(patterns.fan_in),
    "bipartite_mesh": _on(patterns.bipartite_mesh),
    "temporal_chain": _on(patterns.temporal_chain),
    "sharing_triangle": _on(patterns.sharing_triangle),
    "motif_score": _on(patterns.motif_score),
    "burst_cluster": _on(patterns.burst_cluster),
    "undocumented": _on(patterns.undocumented),
    "edge_decay": _on(_decay),
    "prune_edges": _on(patterns.prune_edges, AS_OF),
    "prune_stats": _on(patterns.prune_stats, AS_OF),
    "playback": _on(profile.playback),
    "syndicate_merchants": _on(links.syndicate_merchants),
    "card_syndicates": _on(links.card_syndicates),
    "nexus": _on(links.nexus),
    "cross_case_links": _on(links.cross_case_links),
    "shared_infrastructure": _on(links.shared_infrastructure),
    "circle_layout": _on(lambda t: links.circle_layout(t.select(F.col("customer").alias("id")).distinct())),
    "cycle_rank": _on(graphs.cycle_rank, HUB_CAP),
    "bridges": _on(_bridges),
    "case_documents": _on(lambda t: graphs.case_documents(links.case_subgraph(t))),
    "hybrid_retrieval": _on(_hybrid),
    "card_resolution": _on(_resolved),
    "refine_actions": _assessed(_refined),
    "webhook_rows": _on(lambda t: tables.webhook_rows(monitor.high_risk_mcc(t, 100.0).join(t.select("txn_id", "us"), "txn_id"), "secret")),
    "topology_diff": _on(graphs.topology_diff, BEFORE, AS_OF, HUB_CAP),
    "triplets": _on(graphs.triplets),
    "triplets_cypher": _on(lambda t: graphs.serialise(graphs.triplets(t).where("predicate = 'INVESTIGATES_CARD'"), "cypher")),
    "triplets_ntriples": _on(lambda t: graphs.serialise(graphs.triplets(t), "ntriples")),
    "structuring": _on(regulatory.structuring, 0.01),
    "cross_border": _on(regulatory.cross_border, home=("0",), high=("3", "7"), grey=("5",), scale=0.05),
    "high_risk_mcc": _on(regulatory.high_risk_mcc, 0.1),
    "jurisdiction": _table("conversations", lambda c: c.select("conv_id", "turn", regulatory.jurisdiction(F.col("text")).alias("place"))),
    "obligations": _on(_obligations),
    "mask_text": _table("conversations", lambda c: c.select("conv_id", "turn", regulatory.mask_text(F.col("text")).alias("masked"))),
    "mask_for_analyst": _on(lambda t: regulatory.mask_for("analyst", t.select("txn_id", "card", "customer"))),
    "policy": _facts(_policy),
    "mine_rules": _facts(regulatory.mine_rules),
    "apply_rules": _facts(lambda f: regulatory.apply_rules(f, regulatory.mine_rules(f))),
    "compliance": _facts(regulatory.compliance),
    "memory_prior": _on(regulatory.memory_prior),
    "assess": _assessed(lambda a: a.select("txn_id", "probability", "verdict", "pattern")),
    "next_actions": _assessed(decision.next_actions),
    "value_of_information": _assessed(decision.value_of_information),
    "budget": _assessed(decision.budget),
    "what_if": _assessed(decision.what_if),
    "consensus": _on(_consensus),
    "sar": _assessed(decision.sar),
    "sar_xml": _assessed(lambda a: decision.to_xml(decision.sar(a))),
    "uncertain": _on(ml.uncertain),
    "topology_flags": _on(ml.topology_flags),
    "select_samples": _on(ml.select_samples),
    "calibration": _on(lambda t: ml.calibration(_labelled(t))),
    "confusion": _on(lambda t: ml.confusion(_labelled(t))),
    "stratified": _on(lambda t: ml.stratified(t, "channel", "txn_id", {"online": 84, "in_person": 16})),
    "precedents": _table("embeddings", _precedents),
    "tokens": _table("benchmark", lambda b: b.select("item_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"), F.concat_ws(" ", text.tokens(F.col("text"))).alias("tokens"))),
    "bm25": _bm25,
    "retrieval_quality": _table("benchmark", _retrieval),
    "grounding": _on(_grounding),
    "sanitise": _table("conversations", lambda c: c.select("conv_id", "turn", text.sanitise(F.col("text")).alias("clean"))),
    "ledger_verify": _on(_ledger),
    "merkle_roots": _on(_merkle),
    "backoff": _on(_backoff),
    "tasks_once": _on(lambda t: integrity.once(t, ["card", "merchant"]).select("key", "txn_id")),
    "link_parts": _table("part", linkage.link_parts),
    "device_nexus": _on(linkage.device_nexus),
    "cardholder_sybils": _on(linkage.cardholder_sybils),
    "task_risk": _on(monitor.task_risk),
    "amount_histogram": _on(monitor.histogram, "amount", [1.0, 10.0, 50.0, 100.0]),
    "case_briefs": _facts(lambda f: f.select("case_id", text.brief([F.concat(F.lit("Case "), "case_id"), F.concat(F.lit("Outcome: "), "outcome"), F.concat(F.lit("Transactions: "), F.col("n_txns").cast("string"))], 40).alias("brief"))),
    "rule_chunks": _facts(lambda f: regulatory.rule_chunks(regulatory.mine_rules(f))),
    "velocity_spike": _on(monitor.velocity_spike, total=300.0, critical=600.0),
    "novel_device_link": _on(monitor.novel_device_link),
    "impossible_travel": _on(lambda t: monitor.impossible_travel(monitor.located(t))),
    "stream_mcc": _on(monitor.high_risk_mcc, 100.0),
    "alert_stats": _on(monitor.alert_stats),
    "exposure_rollup": relational.exposure_rollup,
    "status_cube": relational.status_cube,
    "active_customers": relational.active_customers,
    "customers_without_orders": relational.customers_without_orders,
    "customers_with_large_orders": relational.customers_with_large_orders,
    "as_of_status": _on(relational.as_of_status),
    "interval_pairs": _on(relational.interval_pairs),
    "pricing_summary": relational.pricing_summary,
    "supplier_market": relational.supplier_market,
    "top_customers": relational.top_customers,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
