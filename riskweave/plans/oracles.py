"""SQL (DuckDB dialect) that the analytics queries are compared with, written apart from the DataFrame code."""

from __future__ import annotations

H = 3_600_000_000
D = 24 * H

TXN = """t AS (SELECT event_id AS txn_id, ts, epoch_us(ts) AS us, user_id AS card, user_id % 50 AS customer, value AS amount,
 CASE WHEN event_type IN ('purchase', 'view', 'click') THEN 'online' ELSE 'in_person' END AS channel,
 k::VARCHAR || '|' || strftime(ts, '%Y-%m-%d') AS device, event_type || '-' || (k % 10)::VARCHAR AS merchant, k % 10 AS region,
 'e' || (k % 7)::VARCHAR AS email, [6051, 7995, 4829, 6011, 5411][(k % 5) + 1]::INTEGER AS mcc, least(1.0::DOUBLE, value / 250) AS risk,
 event_type = 'error' AS is_fraud, k % 4 = 0 AS flag_new, k % 6 = 0 AS proxy
 FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
CASES = """c AS (SELECT 'C' || txn_id::VARCHAR AS case_id, txn_id, card, customer, device, us AS opened_us,
 CASE WHEN txn_id % 3 = 0 THEN 'cleared' ELSE 'confirmed_fraud' END AS outcome, amount AS exposure, risk FROM t WHERE is_fraud)"""


def devices(cap: int) -> str:
    return f"""d0 AS (SELECT DISTINCT card, device FROM t),
d AS (SELECT * FROM d0 WHERE device NOT IN (SELECT device FROM d0 GROUP BY device HAVING count(*) > {cap}))"""


def q(*parts: str) -> str:
    """CTEs, then the final SELECT."""
    return "WITH " + ",\n".join([TXN, *parts[:-1]]) + "\n" + parts[-1]


def _top(column: str, name: str) -> str:
    return f"""{name}_r AS (SELECT card, {column} AS v, row_number() OVER (PARTITION BY card ORDER BY count(*) DESC, {column}) AS r FROM t GROUP BY card, {column}),
{name} AS (SELECT card, string_agg(v::VARCHAR, ',' ORDER BY r) AS {name} FROM {name}_r WHERE r <= 3 GROUP BY card)"""


FACTS = f"""{CASES},
p AS (SELECT case_id, count(*) AS n_txns, count(DISTINCT t.device) AS n_devices FROM c JOIN t ON c.card = t.card AND t.us <= c.opened_us GROUP BY case_id),
f AS (SELECT c.*, n_txns, n_devices FROM c JOIN p USING (case_id))"""
PREDICATES = f"""{FACTS},
pr AS (SELECT case_id, outcome, unnest([CASE WHEN risk >= 0.7 THEN 'risk_high' WHEN risk >= 0.4 THEN 'risk_medium' ELSE 'risk_low' END,
 CASE WHEN exposure >= 150 THEN 'exposure_high' WHEN exposure >= 50 THEN 'exposure_medium' ELSE 'exposure_low' END,
 CASE WHEN n_txns >= 50 THEN 'txns_many' WHEN n_txns >= 10 THEN 'txns_some' ELSE 'txns_few' END,
 CASE WHEN n_devices >= 20 THEN 'devices_many' ELSE 'devices_few' END]) AS predicate FROM f),
it AS (SELECT case_id, outcome, predicate AS antecedent FROM pr UNION ALL SELECT a.case_id, a.outcome, a.predicate || '+' || b.predicate FROM pr a JOIN pr b ON a.case_id = b.case_id AND a.predicate < b.predicate),
ru AS (SELECT antecedent, count(*) FILTER (outcome = 'confirmed_fraud') AS support, (count(*) FILTER (outcome = 'confirmed_fraud'))::DOUBLE / count(*) AS conf FROM it GROUP BY antecedent),
rules AS (SELECT antecedent, support, round(conf, 6) AS confidence, round(conf / (SELECT (count(*) FILTER (outcome = 'confirmed_fraud'))::DOUBLE / count(*) FROM f), 6) AS lift
 FROM ru WHERE support >= 10 AND conf >= 0.6 ORDER BY confidence DESC, support DESC, antecedent LIMIT 20)"""
PATTERN = f"""pa AS (SELECT *, channel = 'online' AS o,
 count(*) FILTER (channel = 'online' AND amount < 5) OVER (PARTITION BY card ORDER BY us RANGE BETWEEN {H} PRECEDING AND CURRENT ROW) - CASE WHEN channel = 'online' AND amount < 5 THEN 1 ELSE 0 END AS small,
 count(*) FILTER (channel = 'online') OVER (PARTITION BY card ORDER BY us RANGE BETWEEN {2 * D} PRECEDING AND CURRENT ROW) AS recent,
 max(amount) OVER before AS most, count(*) OVER before AS n_before,
 us = min(us) OVER (PARTITION BY customer, device) AS nd, us = min(us) OVER (PARTITION BY customer, region) AS nr, us = min(us) OVER (PARTITION BY customer, email) AS ne
 FROM t WINDOW before AS (PARTITION BY card ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pb AS (SELECT txn_id, (CASE WHEN small >= 3 AND amount > 20 THEN 0.85 WHEN small >= 2 THEN 0.5 ELSE 0 END)::DOUBLE AS card_testing,
 (CASE WHEN o AND recent >= 2 THEN 0.7 WHEN o THEN 0.5 ELSE 0.1 END)::DOUBLE AS card_not_present_fraud,
 (CASE WHEN o AND (nd OR flag_new) THEN 0.8 ELSE 0.1 END)::DOUBLE AS card_not_present_new_device,
 (CASE WHEN NOT o AND nr THEN 0.75 ELSE 0.1 END)::DOUBLE AS out_of_region_use, (CASE WHEN nd AND ne THEN 0.75 ELSE 0.15 END)::DOUBLE AS account_takeover,
 small >= 3 AND amount > 20 AS card_testing_match, o AND (recent >= 2 OR (n_before > 3 AND coalesce(amount > 1.5::DOUBLE * most, false))) AS card_not_present_fraud_match,
 o AND (nd OR flag_new OR proxy) AS card_not_present_new_device_match, NOT o AND nr AS out_of_region_use_match, nd AND ne AND o AS account_takeover_match FROM pa),
pc AS (SELECT *, greatest(card_testing, card_not_present_fraud, card_not_present_new_device, out_of_region_use, account_takeover) AS confidence FROM pb),
pm AS (SELECT *, CASE confidence WHEN card_testing THEN 'card_testing' WHEN card_not_present_fraud THEN 'card_not_present_fraud' WHEN card_not_present_new_device THEN 'card_not_present_new_device' WHEN out_of_region_use THEN 'out_of_region_use' ELSE 'account_takeover' END AS best FROM pc)"""


def _window(name: str, span: int) -> str:
    w = f"OVER (PARTITION BY card ORDER BY us RANGE BETWEEN {span} PRECEDING AND CURRENT ROW)"
    return f"count(*) {w} AS n_{name}, round(sum(amount) {w}, 2) AS sum_{name}"


VELOCITY = f"""v AS (SELECT txn_id, card, {_window('5m', H // 12)}, {_window('1h', H)}, {_window('24h', D)}, {_window('7d', 7 * D)} FROM t),
vs AS (SELECT *, round(n_1h / (n_7d / 168.0::DOUBLE + 0.05::DOUBLE), 4) AS spike FROM v)"""
GEO = f"""g0 AS (SELECT txn_id, card, us, region, lag(region) OVER w AS from_region, lag(us) OVER w AS from_us FROM t WHERE channel = 'in_person' WINDOW w AS (PARTITION BY card ORDER BY us, txn_id)),
geo AS (SELECT txn_id, card, from_region, region, us - from_us AS gap_us FROM g0 WHERE region <> from_region AND us - from_us > 0 AND us - from_us < {2 * H})"""
ASSESS = f"""{PATTERN}, {VELOCITY}, {GEO},
ev AS (SELECT t.txn_id, t.card, t.customer, t.amount, t.risk, pm.best, pm.confidence, vs.spike, pa.nd, pa.nr, pa.ne, t.flag_new, t.proxy, geo.txn_id IS NOT NULL AS geo
 FROM t JOIN pm USING (txn_id) JOIN pa USING (txn_id) JOIN vs USING (txn_id) LEFT JOIN geo USING (txn_id)),
sc AS (SELECT *, round(greatest(0, least(100, 35 * risk + 30 * confidence + CASE WHEN nd OR flag_new THEN 15 ELSE 0 END + CASE WHEN nr THEN 10 ELSE 0 END + CASE WHEN ne THEN 10 ELSE 0 END
 + CASE WHEN proxy THEN 15 ELSE 0 END + CASE WHEN geo THEN 20 ELSE 0 END + CASE WHEN spike > 3 THEN 15 WHEN spike > 1.5 THEN 8 ELSE 0 END)) / 100, 6) AS probability FROM ev),
a AS (SELECT *, CASE WHEN probability >= 0.65 THEN 'FRAUD' WHEN probability <= 0.25 THEN 'LEGITIMATE' ELSE 'UNCERTAIN' END AS verdict, CASE WHEN probability > 0.25 THEN best ELSE 'none' END AS pattern FROM sc)"""
EDGES = f"""{devices(60)},
e AS (SELECT 'c' || card::VARCHAR AS src, 'd' || device AS dst FROM d UNION ALL SELECT 'd' || device, 'c' || card::VARCHAR FROM d)"""


def _lpa(rounds: int) -> str:
    out = ["l0 AS (SELECT DISTINCT src AS id, src AS label FROM e)"]
    for i in range(1, rounds + 1):
        out.append(f"l{i} AS (SELECT src AS id, label FROM (SELECT src, label, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, label) AS r FROM e JOIN l{i - 1} ON dst = id GROUP BY src, label) WHERE r = 1)")
    return ",\n".join(out)


def _ppr(rounds: int) -> str:
    out = ["dg AS (SELECT src, count(*) AS degree FROM e GROUP BY src)", "fs AS (SELECT DISTINCT 'c' || card::VARCHAR AS src FROM c WHERE outcome = 'confirmed_fraud')",
           "st AS (SELECT dg.src, degree, CASE WHEN fs.src IS NULL THEN 0 ELSE 1 END / greatest((SELECT count(*) FROM dg JOIN fs USING (src)), 1)::DOUBLE AS p0 FROM dg LEFT JOIN fs USING (src))", "r0 AS (SELECT *, p0 AS p FROM st)"]
    for i in range(1, rounds + 1):
        out.append(f"r{i} AS (SELECT st.src, degree, p0, 0.15::DOUBLE * p0 + 0.85::DOUBLE * coalesce(got, 0) AS p FROM st LEFT JOIN (SELECT dst, sum(p / degree) AS got FROM r{i - 1} JOIN e USING (src) GROUP BY dst) g ON st.src = g.dst)")
    return ",\n".join(out)


def _tokens(column: str) -> str:
    return f"list_filter(regexp_extract_all(replace(lower(coalesce({column}, '')), '-', ' '), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: length(x) >= 2 AND regexp_full_match(x, '[a-z0-9_]+'))"


def _bm25(docs: str, queries: str) -> str:
    cut = lambda s: f"SELECT *, list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || '_' || w[i + 1])) AS terms FROM ({s})"
    return f"""dt AS ({cut(f"SELECT doc_id, {_tokens('text')} AS w FROM {docs}")}),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM dt) GROUP BY ALL),
te AS (SELECT term, ln(((SELECT count(*) FROM dt) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1) AS idf FROM po GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(terms) AS term FROM ({cut(f"SELECT query_id, {_tokens('text')} AS w FROM {queries}")})) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(qf * idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / (SELECT avg(len(terms)) FROM dt)))), 4) AS score FROM qt JOIN te USING (term) JOIN po USING (term) GROUP BY query_id, doc_id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 5)"""


def _components(rounds: int) -> str:
    out = ["k0 AS (SELECT DISTINCT src AS id, src AS component FROM e)"]
    for i in range(1, rounds + 1):
        out.append(f"k{i} AS (SELECT id, least(any_value(k.component), min(n.component)) AS component FROM k{i - 1} k JOIN e ON e.src = k.id JOIN (SELECT id AS nid, component FROM k{i - 1}) n ON n.nid = e.dst GROUP BY id)")
    return ",\n".join(out)


AS_OF = "TIMESTAMP '2024-01-20'"
AT = f"epoch_us({AS_OF})"
WEIGHT = f"round(CASE WHEN us > {AT} THEN 0 ELSE least(1, (CASE WHEN is_fraud THEN 4.0::DOUBLE WHEN risk >= 0.7 THEN 2.0 WHEN risk >= 0.4 THEN 1.5 ELSE 1 END) * pow(2.0, -(({AT} - us) / {D}::DOUBLE) / 30.0::DOUBLE)) END, 6)"
MESH = "ac AS (SELECT DISTINCT customer, card, merchant FROM t WHERE (customer, card) IN (SELECT (customer, card) FROM t GROUP BY customer, card HAVING count(*) >= 2))"
CHAIN = f"""ch0 AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY card ORDER BY us, txn_id) <= {2 * H} THEN 0 ELSE 1 END AS brk FROM t),
ch1 AS (SELECT *, sum(brk) OVER (PARTITION BY card ORDER BY us, txn_id ROWS UNBOUNDED PRECEDING) AS chain FROM ch0),
ch AS (SELECT card, count(*) AS n, min(us) AS begin_us, max(us) AS end_us, round(sum(amount), 2) AS total FROM ch1 GROUP BY card, chain HAVING count(*) >= 3)"""
FAN = """fo AS (SELECT card, count(DISTINCT merchant) AS n_merchants, round(sum(amount), 2) AS total FROM t GROUP BY card HAVING count(DISTINCT merchant) >= 4),
fi AS (SELECT merchant, count(DISTINCT card) AS n_cards, round(sum(amount), 2) AS total FROM t GROUP BY merchant HAVING count(DISTINCT card) >= 3)"""
LINKS = "dc AS (SELECT DISTINCT card, device FROM t), la AS (SELECT a.card AS seed, b.card AS other, count(*) AS n_devices FROM dc a JOIN dc b ON a.device = b.device AND a.card <> b.card GROUP BY a.card, b.card), li AS (SELECT * FROM la QUALIFY row_number() OVER (PARTITION BY seed ORDER BY other) <= 15)"
NEXUS = "dn AS (SELECT device, count(DISTINCT card) AS n FROM t GROUP BY device), nx AS (SELECT * FROM (SELECT a.device AS device_a, b.device AS device_b, round(jaro_winkler_similarity(a.device, b.device), 4) AS similarity, a.n + b.n AS n_cards FROM dn a JOIN dn b ON split_part(a.device, '|', 1) = split_part(b.device, '|', 1) AND a.device < b.device) WHERE similarity >= 0.97)"
SPIKE = "sp AS (SELECT * FROM (SELECT txn_id, card, count(*) OVER w AS n, round(sum(amount) OVER w, 4) AS total FROM t WINDOW w AS (PARTITION BY card ORDER BY us RANGE BETWEEN 300000000 PRECEDING AND CURRENT ROW)) WHERE n >= 3 OR total >= 300)"
NOVEL = "nv AS (SELECT txn_id, device, card, n_before FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY us, txn_id) - 1 AS n_before FROM (SELECT device, card, min(us) AS us, arg_min(txn_id, (us, txn_id)) AS txn_id FROM t GROUP BY device, card)) WHERE n_before > 0)"
LOCATED = "lo AS (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS b, lag(us) OVER w AS pu FROM (SELECT *, (region * 7 - 30)::DOUBLE AS lat, (region * 13 - 60)::DOUBLE AS lon FROM t) WINDOW w AS (PARTITION BY card ORDER BY us, txn_id))"

ORACLE_SQL: dict[str, str] = {
    "canonical_transactions": q("SELECT txn_id, us, card, customer, amount, channel, device, merchant, region, email, mcc, risk, is_fraud, flag_new, proxy FROM t"),
    "case_devices": q(CASES, "SELECT DISTINCT case_id, device FROM c"),
    "entity_profile": q(_top("region", "top_regions"), _top("device", "top_devices"), "SELECT t.card, count(*) AS n, round(sum(amount), 2) AS total, round(avg(amount), 4) AS mean, round(median(amount), 4) AS median, min(amount) AS least, max(amount) AS most, count(*) FILTER (channel = 'online') AS n_online, min(us) AS first_us, max(us) AS last_us, any_value(top_regions) AS top_regions, any_value(top_devices) AS top_devices FROM t LEFT JOIN top_regions USING (card) LEFT JOIN top_devices USING (card) GROUP BY t.card"),
    "txn_context": q(f"x AS (SELECT *, count(*) OVER b AS n_before, count(*) OVER (PARTITION BY card ORDER BY us RANGE BETWEEN 1 FOLLOWING AND {48 * H} FOLLOWING) AS n_after, us - max(us) OVER b AS gap_us, count(*) OVER p AS n, avg(amount) OVER p AS m, stddev_pop(amount) OVER p AS s FROM t WINDOW b AS (PARTITION BY card ORDER BY us RANGE BETWEEN {48 * H} PRECEDING AND 1 PRECEDING), p AS (PARTITION BY card ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", "SELECT txn_id, card, n_before, n_after, gap_us, CASE WHEN n >= 3 AND s > 0.01 THEN round((amount - m) / s, 4) ELSE 0 END::DOUBLE AS z_score FROM x"),
    "velocity": q(VELOCITY, "SELECT * FROM vs"),
    "velocity_at": q("SELECT card, " + ", ".join(f"count(*) FILTER (us >= {AT} - {s}) AS n_{n}, round(coalesce(sum(amount) FILTER (us >= {AT} - {s}), 0), 2) AS sum_{n}" for n, s in (("5m", H // 12), ("1h", H), ("24h", D), ("7d", 7 * D))) + f" FROM t WHERE ts <= {AS_OF} AND us >= {AT} - {7 * D} GROUP BY card"),
    "device_sharing": q(CASES, "SELECT device, count(DISTINCT card) AS n_cards, count(DISTINCT customer) AS n_customers, count(*) AS n_txns, min(us) AS first_us, max(us) AS last_us, array_to_string(list_slice(list_sort(list(DISTINCT card)), 1, 10), ',') AS cards, coalesce((SELECT count(*) FROM c WHERE c.device = t.device), 0) AS n_cases, count(DISTINCT card) > 1 AS is_shared FROM t GROUP BY device"),
    "identity_links": q(LINKS, "SELECT * FROM li"),
    "ring_detection": q(CASES, LINKS, "lr AS (SELECT seed, other FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY other) AS r FROM li) WHERE r <= 15)", "me AS (SELECT * FROM lr UNION ALL SELECT DISTINCT seed, seed FROM lr)", "fr AS (SELECT card, count(*) AS n FROM c WHERE outcome = 'confirmed_fraud' GROUP BY card)", "SELECT seed, count(*) - 1 AS n_linked, coalesce(sum(n), 0)::BIGINT AS n_precedents, count(*) - 1 >= 2 AND coalesce(sum(n), 0) >= 1 AS is_ring, least(1, count(*) / 5.0::DOUBLE)::DOUBLE AS density FROM me LEFT JOIN fr ON other = card GROUP BY seed"),
    "new_entity_check": q("SELECT txn_id, customer, us = min(us) OVER (PARTITION BY customer, device) AS new_device, us = min(us) OVER (PARTITION BY customer, region) AS new_region, us = min(us) OVER (PARTITION BY customer, email) AS new_email, flag_new AS identity_flag_new, proxy AS proxy_flag FROM t"),
    "geo_impossible": q(GEO, "SELECT * FROM geo"),
    "money_flow_trace": q("m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY us DESC, txn_id DESC) AS back FROM t) WHERE back <= 10)", "SELECT card, txn_id, (row_number() OVER (PARTITION BY card ORDER BY us, txn_id))::INTEGER AS step, amount, round(sum(amount) OVER (PARTITION BY card ORDER BY us, txn_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM m"),
    "similar_cases": q(CASES, "s0 AS (SELECT card, case_id, opened_us, min(p) AS p FROM (SELECT x.card, case_id, opened_us, 1 AS p FROM (SELECT DISTINCT card, customer FROM t) x JOIN c USING (customer) UNION ALL SELECT x.card, case_id, opened_us, 2 FROM (SELECT DISTINCT card, device FROM t) x JOIN c USING (device)) GROUP BY ALL)", "s1 AS (SELECT *, (row_number() OVER (PARTITION BY card ORDER BY p, opened_us, case_id))::INTEGER AS rank FROM s0)", "SELECT card, case_id, CASE p WHEN 1 THEN 'same_customer' ELSE 'shared_device' END AS basis, rank FROM s1 WHERE rank <= 5"),
    "pattern_match": q(PATTERN, "SELECT * FROM pm"),
    "case_history": q(CASES, "SELECT card, count(*) AS total, count(*) FILTER (outcome = 'confirmed_fraud') AS confirmed, count(*) FILTER (outcome = 'cleared') AS cleared, round(sum(exposure), 2) AS exposure FROM c GROUP BY card"),
    "case_subgraph": q(CASES, "rt AS (SELECT card, txn_id AS x FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY us DESC, txn_id DESC) AS r FROM t) WHERE r <= 5)", "pe AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY peer) AS r FROM (SELECT c.case_id, c.device, x.card AS peer FROM c JOIN (SELECT DISTINCT card, device FROM t) x ON c.device = x.device AND x.card <> c.card))", "SELECT case_id, case_id AS src, 'INVESTIGATES' AS kind, card::VARCHAR AS dst FROM c UNION ALL SELECT case_id, customer::VARCHAR, 'OWNS', card::VARCHAR FROM c UNION ALL SELECT case_id, card::VARCHAR, 'USED', device FROM c UNION ALL SELECT case_id, card::VARCHAR, 'MADE', x::VARCHAR FROM c JOIN rt USING (card) UNION ALL SELECT case_id, peer::VARCHAR, 'SHARES', device FROM pe WHERE r <= 2"),
    "ego_net": q(EDGES, "h0 AS (SELECT DISTINCT src AS seed, src AS node FROM e WHERE src LIKE 'c%')", "h1 AS (SELECT DISTINCT seed, dst AS node FROM h0 JOIN e ON node = src)", "h2 AS (SELECT DISTINCT seed, dst AS node FROM h1 JOIN e ON node = src)", "SELECT seed, node, min(hop)::INTEGER AS hop FROM (SELECT *, 0 AS hop FROM h0 UNION ALL SELECT *, 1 FROM h1 UNION ALL SELECT *, 2 FROM h2) GROUP BY seed, node"),
    "communities": q(CASES, EDGES, _lpa(3), "cc AS (SELECT 'c' || card::VARCHAR AS id, count(*) AS n FROM c WHERE outcome = 'confirmed_fraud' GROUP BY card)", "SELECT label, count(*) AS n_nodes, count(*) FILTER (id LIKE 'c%') AS n_cards, coalesce(sum(n), 0)::BIGINT AS n_cases, round(CASE WHEN coalesce(sum(n), 0) > 0 THEN least(1.0::DOUBLE, 0.45::DOUBLE + 0.15::DOUBLE * sum(n)) ELSE 0 END, 4)::DOUBLE AS contagion FROM l3 LEFT JOIN cc USING (id) GROUP BY label"),
    "contagion": q(CASES, EDGES, _ppr(4), "SELECT src AS id, round(p, 8) AS score, CASE WHEN p >= 0.15 THEN 'CRITICAL' WHEN p >= 0.08 THEN 'HIGH' WHEN p >= 0.03 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r4"),
    "node_features": q(devices(60), "pp AS (SELECT DISTINCT a.card AS a, b.card AS b FROM d a JOIN d b ON a.device = b.device AND a.card < b.card)", "de AS (SELECT card, count(*) AS degree FROM (SELECT a AS card FROM pp UNION ALL SELECT b FROM pp) GROUP BY card)", "tr AS (SELECT x.a, x.b, y.b AS c3 FROM pp x JOIN pp y ON x.b = y.a JOIN pp z ON z.a = x.a AND z.b = y.b)", "tn AS (SELECT card, count(*) AS triangles FROM (SELECT a AS card FROM tr UNION ALL SELECT b FROM tr UNION ALL SELECT c3 FROM tr) GROUP BY card)", "SELECT card, coalesce(degree, 0) AS degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN coalesce(degree, 0) >= 2 THEN 2 * coalesce(triangles, 0) / (degree * (degree - 1))::DOUBLE ELSE 0 END, 6)::DOUBLE AS clustering, round(least(1, log10(greatest(1, most)) / 6), 6)::DOUBLE AS scale, round(risk, 6) AS risk, fraud FROM (SELECT card, max(amount) AS most, max(risk) AS risk, max(is_fraud::INTEGER)::BIGINT AS fraud FROM t GROUP BY card) LEFT JOIN de USING (card) LEFT JOIN tn USING (card)"),
    "attention_pool": q(f"z AS (SELECT card, amount, risk - 0.05::DOUBLE * (max(us) OVER (PARTITION BY card) - us) / {D}::DOUBLE AS z FROM t)", "x AS (SELECT *, exp(z - max(z) OVER (PARTITION BY card)) AS e FROM z)", "SELECT card, round(sum(e * amount) / sum(e), 4) AS attended, round(avg(amount), 4) AS mean, max(amount) AS most FROM x GROUP BY card"),
    "fan_out": q(FAN, "SELECT * FROM fo"),
    "fan_in": q(FAN, "SELECT * FROM fi"),
    "bipartite_mesh": q(MESH, "SELECT a.card AS a, b.card AS b, count(DISTINCT a.merchant) AS n_shared FROM ac a JOIN ac b ON a.customer = b.customer AND a.merchant = b.merchant AND a.card < b.card GROUP BY a.card, b.card HAVING count(DISTINCT a.merchant) >= 2"),
    "temporal_chain": q(CHAIN, "SELECT * FROM ch"),
    "sharing_triangle": q(devices(15), "vi AS (SELECT DISTINCT card, merchant FROM t)", "pp AS (SELECT DISTINCT a.card AS a, b.card AS b FROM d a JOIN d b ON a.device = b.device AND a.card < b.card)", "SELECT a, b, count(*) AS n_merchants FROM pp JOIN vi x ON x.card = a JOIN vi y ON y.card = b AND y.merchant = x.merchant GROUP BY a, b"),
    "motif_score": q(FAN, CHAIN, MESH, devices(15), "me AS (SELECT a.card AS a, b.card AS b FROM ac a JOIN ac b ON a.customer = b.customer AND a.merchant = b.merchant AND a.card < b.card GROUP BY a.card, b.card HAVING count(DISTINCT a.merchant) >= 2)", "mc AS (SELECT card, count(*) AS n FROM (SELECT unnest([a, b]) AS card FROM me) GROUP BY card)", "vi AS (SELECT DISTINCT card, merchant FROM t)", "pp AS (SELECT DISTINCT a.card AS a, b.card AS b FROM d a JOIN d b ON a.device = b.device AND a.card < b.card)", "tr AS (SELECT DISTINCT a, b FROM pp JOIN vi x ON x.card = a JOIN vi y ON y.card = b AND y.merchant = x.merchant)", "tc AS (SELECT card, count(*) AS n FROM (SELECT unnest([a, b]) AS card FROM tr) GROUP BY card)", "mo AS (SELECT card, least(0.4::DOUBLE, 0.2::DOUBLE * (SELECT count(*) FROM fo WHERE fo.card = x.card)) AS p1, least(0.5::DOUBLE, 0.25::DOUBLE * (SELECT count(DISTINCT merchant) FROM t WHERE t.card = x.card AND merchant IN (SELECT merchant FROM fi))) AS p2, least(0.4::DOUBLE, 0.2::DOUBLE * (SELECT count(*) FROM ch WHERE ch.card = x.card)) AS p4, least(0.6::DOUBLE, 0.3::DOUBLE * coalesce((SELECT n FROM mc WHERE mc.card = x.card), 0)) AS p3, least(0.5::DOUBLE, 0.25::DOUBLE * coalesce((SELECT n FROM tc WHERE tc.card = x.card), 0)) AS p5 FROM (SELECT DISTINCT card FROM t) x)", "ms AS (SELECT *, round(least(1.0::DOUBLE, p1 + p2 + p3 + p4 + p5), 4) AS score, greatest(p1, p2, p3, p4, p5) AS b FROM mo)", "SELECT card, score, CASE WHEN score >= 0.7 THEN 'CRITICAL' WHEN score >= 0.4 THEN 'HIGH' WHEN score >= 0.2 THEN 'MEDIUM' WHEN score > 0 THEN 'LOW' ELSE 'NONE' END AS level, CASE WHEN b > 0 THEN CASE b WHEN p1 THEN 'fan_out' WHEN p2 THEN 'fan_in' WHEN p3 THEN 'bipartite_mesh' WHEN p4 THEN 'temporal_chain' ELSE 'sharing_triangle' END END AS dominant FROM ms"),
    "burst_cluster": q(
        f"b0 AS (SELECT x.txn_id, x.device, y.card, y.customer, y.amount, (y.us - lag(y.us) OVER (PARTITION BY x.txn_id ORDER BY y.us, y.txn_id)) / 1e6::DOUBLE AS gap FROM t x JOIN t y ON x.device = y.device AND y.us BETWEEN x.us - {D} AND x.us)",
        "b AS (SELECT txn_id, device, count(*) AS n, count(DISTINCT card) AS n_cards, count(DISTINCT customer) AS n_customers, round(sum(amount), 2) AS exposure, (count(*) FILTER (amount <= 5))::DOUBLE / count(*) AS m, round(coalesce(avg(gap), 0), 3)::DOUBLE AS mean_gap, round(coalesce(stddev_pop(gap), 0), 3)::DOUBLE AS std_gap FROM b0 GROUP BY txn_id, device)",
        "b2 AS (SELECT *, n >= 3 AND std_gap > 0 AND std_gap <= 120 AS is_bot, (n_cards >= 2 AND n >= 3) OR (n >= 4 AND m >= 0.5) AS is_burst FROM b)",
        "SELECT txn_id, device, n, n_cards, n_customers, exposure, round(m, 4) AS micro, mean_gap, std_gap, is_bot, is_burst, CASE WHEN is_burst THEN round(least(0.98::DOUBLE, 0.7::DOUBLE + 0.05::DOUBLE * n_cards + 0.1::DOUBLE * m), 4) ELSE 0 END::DOUBLE AS confidence FROM b2",
    ),
    "undocumented": q(
        VELOCITY, GEO,
        "sh AS (SELECT x.txn_id, x.device, x.proxy, count(DISTINCT y.card) AS n, count(DISTINCT y.customer) AS m FROM t x JOIN t y ON x.device = y.device AND y.us <= x.us GROUP BY x.txn_id, x.device, x.proxy)",
        "ho AS (SELECT t.txn_id, count(g.us) AS hops FROM t LEFT JOIN (SELECT g0.card, g0.us FROM g0 JOIN geo USING (txn_id)) g ON g.card = t.card AND g.us <= t.us GROUP BY t.txn_id)",
        "al AS (SELECT sh.*, hops, round(n_1h / (n_7d / 168.0::DOUBLE + 0.05::DOUBLE), 2) >= 3 AS spiked FROM sh JOIN ho USING (txn_id) JOIN vs USING (txn_id))",
        "SELECT txn_id, device, CASE WHEN n >= 2 AND proxy THEN 'proxy_rotation_syndicate' WHEN n >= 3 AND m >= 3 THEN 'device_pooling_nexus' WHEN n >= 2 AND spiked THEN 'coordinated_burst_nexus' ELSE 'impossible_geo_dispersion' END AS signature, round(CASE WHEN n >= 2 AND proxy THEN least(0.95::DOUBLE, 0.7::DOUBLE + 0.05::DOUBLE * n) WHEN n >= 3 AND m >= 3 THEN least(0.92::DOUBLE, 0.65::DOUBLE + 0.05::DOUBLE * n) WHEN n >= 2 AND spiked THEN 0.85 ELSE 0.8 END::DOUBLE, 2) AS confidence FROM al WHERE (n >= 2 AND proxy) OR (n >= 3 AND m >= 3) OR (n >= 2 AND spiked) OR hops >= 2",
    ),
    "edge_decay": q(f"SELECT txn_id, {WEIGHT}::DOUBLE AS weight FROM t"),
    "prune_edges": q(f"w AS (SELECT *, {WEIGHT}::DOUBLE AS weight FROM t)", f"r AS (SELECT *, (row_number() OVER (PARTITION BY card ORDER BY is_fraud DESC, weight DESC, txn_id))::INTEGER AS rank FROM w WHERE us <= {AT} AND (is_fraud OR weight >= 0.05))", "SELECT card, txn_id, is_fraud, weight, rank FROM r WHERE rank <= 50"),
    "prune_stats": q(f"w AS (SELECT *, {WEIGHT}::DOUBLE AS weight FROM t)", f"k AS (SELECT card, least(10, count(*)) AS kept FROM w WHERE us <= {AT} AND (is_fraud OR weight >= 0.05) GROUP BY card)", f"SELECT card, count(*) AS edges, coalesce(any_value(kept), 0) AS kept, round(coalesce(any_value(kept), 0) / count(*)::DOUBLE, 4) AS ratio FROM t LEFT JOIN k USING (card) WHERE us <= {AT} GROUP BY card"),
    "playback": q("x AS (SELECT *, row_number() OVER (PARTITION BY card, device ORDER BY us, txn_id) = 1 AS nd, row_number() OVER w AS frame, sum(amount) OVER w AS ex FROM t WINDOW w AS (PARTITION BY card ORDER BY us, txn_id))", "y AS (SELECT *, sum(nd::BIGINT) OVER (PARTITION BY card ORDER BY us, txn_id ROWS UNBOUNDED PRECEDING) AS dv, min(frame) FILTER (ex >= 1000) OVER (PARTITION BY card) AS fb FROM x)", "SELECT txn_id, card, frame::INTEGER AS frame, round(ex, 4) AS exposure, dv::BIGINT AS devices, frame = fb AS breach, frame >= 3 AS third_or_later FROM y"),
    "syndicate_merchants": q("s AS (SELECT customer, merchant, count(*) AS n, round(sum(amount), 2) AS exposure, count(DISTINCT card) AS n_cards, round(avg(risk), 6) AS mean_risk, count(DISTINCT channel) AS n_channels FROM t GROUP BY customer, merchant)", "SELECT *, round(least(0.99::DOUBLE, CASE WHEN n_cards >= 3 THEN 0.5 ELSE 0.3 END + CASE WHEN exposure >= 5000 THEN 0.35 WHEN exposure >= 1000 THEN 0.2 ELSE 0 END + CASE WHEN mean_risk >= 0.5 THEN 0.15 ELSE 0 END), 4)::DOUBLE AS score FROM s WHERE n_cards >= 2"),
    "card_syndicates": q(LINKS, "vi AS (SELECT DISTINCT card, merchant FROM t)", "SELECT seed, count(DISTINCT x.merchant) AS n_merchants, count(DISTINCT other) AS n_peers, least(0.99::DOUBLE, round(0.3::DOUBLE * count(DISTINCT x.merchant), 4)) AS score FROM li JOIN vi x ON x.card = seed JOIN vi y ON y.card = other AND y.merchant = x.merchant GROUP BY seed"),
    "nexus": q(CASES, "SELECT 'NX-' || substr(md5(device), 1, 8) AS nexus_id, device, count(DISTINCT card) AS n_cards, count(*) AS n_cases, round(sum(exposure), 2) AS exposure, array_to_string(list_sort(list(DISTINCT case_id)), ',') AS cases, CASE WHEN round(sum(exposure), 2) >= 10000 THEN 'CRITICAL' WHEN round(sum(exposure), 2) >= 2500 THEN 'HIGH' ELSE 'MEDIUM' END AS threat FROM c WHERE outcome = 'confirmed_fraud' GROUP BY device HAVING count(DISTINCT card) >= 2"),
    "cross_case_links": q(CASES, "SELECT a.case_id AS a_case, b.case_id AS b_case, a.device FROM c a JOIN c b ON a.device = b.device AND a.case_id < b.case_id AND a.card <> b.card WHERE a.outcome = 'confirmed_fraud' AND b.outcome = 'confirmed_fraud'"),
    "shared_infrastructure": q("x AS (SELECT DISTINCT customer, device FROM t)", "y AS (SELECT DISTINCT customer, merchant FROM t)", "SELECT a, b, sum(w)::DOUBLE AS weight FROM (SELECT l.customer AS a, r.customer AS b, 2.0 * count(*) AS w FROM x l JOIN x r ON l.device = r.device AND l.customer < r.customer GROUP BY ALL UNION ALL SELECT l.customer, r.customer, 1.0 * count(*) FROM y l JOIN y r ON l.merchant = r.merchant AND l.customer < r.customer GROUP BY ALL) GROUP BY a, b"),
    "circle_layout": q("n AS (SELECT DISTINCT customer AS id FROM t)", "SELECT id, round(100 * cos(2 * pi() * (row_number() OVER (ORDER BY id) - 1) / (SELECT count(*) FROM n)), 6) AS x, round(100 * sin(2 * pi() * (row_number() OVER (ORDER BY id) - 1) / (SELECT count(*) FROM n)), 6) AS y FROM n"),
    "cycle_rank": q(EDGES, _components(6), "n AS (SELECT component, count(*) AS n_nodes FROM k6 GROUP BY component)", "m AS (SELECT component, (count(*) // 2)::BIGINT AS n_edges FROM e JOIN k6 ON src = id GROUP BY component)", "SELECT component, n_nodes, n_edges, n_edges - n_nodes + 1 AS cycles FROM n JOIN m USING (component)"),
    "hybrid_retrieval": q(CASES, f"cx AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-01') - opened_us) / {D}::DOUBLE AS age FROM c)", "s AS (SELECT x.card AS query_id, case_id, age FROM (SELECT DISTINCT card, customer FROM t) x JOIN cx USING (customer))", "l AS (SELECT card AS query_id, case_id, age, greatest(0.4::DOUBLE, least(0.9::DOUBLE, CASE WHEN exposure / 25 > 1 THEN exposure / 25 / 10 ELSE exposure / 25 END)) AS b FROM cx WHERE exposure >= 20)", "SELECT query_id, case_id, round(greatest(CASE WHEN s.age IS NULL THEN 0 ELSE 0.75 END, coalesce(b, 0)) * CASE WHEN s.age IS NOT NULL AND b IS NOT NULL THEN 1.25 ELSE 1 END * (0.2::DOUBLE + 0.8::DOUBLE * pow(2.0, -coalesce(s.age, l.age) / 30.0::DOUBLE)), 6)::DOUBLE AS score FROM s FULL JOIN l USING (query_id, case_id)"),
    "card_resolution": q("x AS (SELECT txn_id, customer, region, mcc, channel, CASE WHEN txn_id % 10 = 0 AND customer < 40 THEN 'K' || card END AS k FROM t)", "s1 AS (SELECT region, mcc, channel, customer, arg_min(k, txn_id) AS k FROM x WHERE k IS NOT NULL GROUP BY ALL)", "s2 AS (SELECT region, arg_min(k, txn_id) AS k FROM x WHERE k IS NOT NULL GROUP BY region)", "s3 AS (SELECT customer, arg_min(k, txn_id) AS k FROM x WHERE k IS NOT NULL GROUP BY customer)", "SELECT txn_id, coalesce(x.k, s1.k, s2.k, s3.k, x.customer || '-K1') AS card_id FROM x LEFT JOIN s1 USING (region, mcc, channel, customer) LEFT JOIN s2 USING (region) LEFT JOIN s3 USING (customer)"),
    "refine_actions": q(ASSESS, "SELECT txn_id, verdict, CASE WHEN verdict = 'FRAUD' THEN CASE WHEN amount * 100 > 2500 THEN 'ESCALATE' WHEN amount > 100 THEN 'BLOCK_CARD' ELSE 'STEP_UP_AUTH' END WHEN verdict = 'UNCERTAIN' THEN 'CONTACT_CUSTOMER' ELSE 'CLOSE' END AS action FROM a"),
    "case_documents": q(CASES, "rt AS (SELECT card, txn_id AS x FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY us DESC, txn_id DESC) AS r FROM t) WHERE r <= 5)", "pe AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY peer) AS r FROM (SELECT c.case_id, c.device, x.card AS peer FROM c JOIN (SELECT DISTINCT card, device FROM t) x ON c.device = x.device AND x.card <> c.card))", "ed AS (SELECT case_id, case_id || ' INVESTIGATES ' || card AS line FROM c UNION ALL SELECT case_id, customer || ' OWNS ' || card FROM c UNION ALL SELECT case_id, card || ' USED ' || device FROM c UNION ALL SELECT case_id, card || ' MADE ' || x FROM c JOIN rt USING (card) UNION ALL SELECT case_id, peer || ' SHARES ' || device FROM pe WHERE r <= 2)", "SELECT case_id, count(*) AS n, string_agg(line, ';' ORDER BY line) AS edges FROM ed GROUP BY case_id"),
    "topology_diff": q("o AS (SELECT DISTINCT card, device FROM t WHERE ts <= TIMESTAMP '2024-01-10')", "o2 AS (SELECT * FROM o WHERE device NOT IN (SELECT device FROM o GROUP BY device HAVING count(*) > 60))", "n AS (SELECT DISTINCT card, device FROM t WHERE ts <= TIMESTAMP '2024-01-20')", "n2 AS (SELECT * FROM n WHERE device NOT IN (SELECT device FROM n GROUP BY device HAVING count(*) > 60))", "ch AS (SELECT card, 1 AS a, 0 AS g FROM (SELECT * FROM n2 EXCEPT SELECT * FROM o2) UNION ALL SELECT card, 0, 1 FROM (SELECT * FROM o2 EXCEPT SELECT * FROM n2))", "cg AS (SELECT card, sum(a)::BIGINT AS added, sum(g)::BIGINT AS removed FROM ch GROUP BY card)", "x AS (SELECT card, added, removed, (SELECT count(*) FROM o2 WHERE o2.card = cg.card) AS d1, (SELECT count(*) FROM n2 WHERE n2.card = cg.card) AS d2 FROM cg)", "SELECT *, CASE WHEN d1 < 3 AND d2 >= 3 THEN 'STAR_FORMED' WHEN added >= 5 THEN 'EXPLOSION' ELSE 'STABLE' END AS shift FROM x"),
    "triplets": q(CASES, "rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY card ORDER BY us DESC, txn_id DESC) AS r FROM t) WHERE r <= 30)", "SELECT card::VARCHAR AS subject, 'HAS_TRANSACTION' AS predicate, txn_id::VARCHAR AS object FROM rt UNION SELECT txn_id::VARCHAR, 'TRANS_AT', region::VARCHAR FROM rt UNION SELECT txn_id::VARCHAR, 'USED_DEVICE', device FROM rt UNION SELECT customer::VARCHAR, 'OWNS_CARD', card::VARCHAR FROM t UNION SELECT case_id, 'INVESTIGATES_CARD', card::VARCHAR FROM c UNION SELECT case_id, 'FLAGGED_TRANSACTION', txn_id::VARCHAR FROM c"),
    "triplets_cypher": q(CASES, "SELECT DISTINCT 'MERGE (a:Entity {id: \"' || case_id || '\"}) MERGE (b:Entity {id: \"' || card || '\"}) MERGE (a)-[:INVESTIGATES_CARD]->(b)' AS statement FROM c"),
    "structuring": q(f"w AS (SELECT *, max(us) OVER (PARTITION BY customer) AS e FROM t)", f"w2 AS (SELECT *, count(*) FILTER (amount >= 0.7::DOUBLE * 100) OVER (PARTITION BY customer ORDER BY us RANGE BETWEEN {6 * H} PRECEDING AND CURRENT ROW) AS near FROM w WHERE us >= e - {24 * H})", "g AS (SELECT customer, count(*) AS n, round(sum(amount), 2) AS total, max(amount) AS most, count(DISTINCT card) AS n_cards, count(*) FILTER (amount BETWEEN 80 AND 99.9999) AS nb, max(near) AS near, count(*) FILTER (amount >= 20 AND amount % 10 = 0) AS nr FROM w2 GROUP BY customer)", "SELECT customer, n, total, n_cards, concat_ws(',', CASE WHEN total >= 100 THEN 'CTR_LIMIT' END, CASE WHEN nb >= 2 THEN 'SUB_THRESHOLD' END, CASE WHEN n_cards >= 2 AND total >= 100 AND most < 100 THEN 'CARD_DISPERSION' END, CASE WHEN near >= 3 THEN 'RAPID_NEAR_LIMIT' END, CASE WHEN nr >= 2 THEN 'ROUND_SUMS' END) AS indicators, nb >= 2 OR (n_cards >= 2 AND total >= 100 AND most < 100) OR near >= 3 AS is_structuring FROM g"),
    "cross_border": q(f"w AS (SELECT *, max(us) OVER (PARTITION BY card) AS e FROM t)", f"g AS (SELECT card, count(*) FILTER (region <> 0) AS n_abroad, count(DISTINCT region) FILTER (region <> 0) AS n_countries, round(coalesce(sum(amount) FILTER (region <> 0), 0), 2) AS abroad, count(*) FILTER (region IN (3, 7)) AS n_high, count(*) FILTER (region = 5) AS n_grey FROM w WHERE us >= e - {48 * H} GROUP BY card)", "l AS (SELECT *, (n_countries >= 3 AND n_abroad >= 2) OR (n_countries >= 2 AND abroad >= 50) AS layered FROM g)", "s AS (SELECT *, round(least(0.99::DOUBLE, CASE WHEN n_high > 0 THEN 0.5 WHEN n_grey > 0 THEN 0.3 ELSE 0 END + CASE WHEN abroad >= 250 THEN 0.3 WHEN abroad >= 125 THEN 0.2 ELSE 0 END + CASE WHEN layered THEN 0.25 ELSE 0 END), 4)::DOUBLE AS score FROM l)", "SELECT *, CASE WHEN score >= 0.7 THEN 'CRITICAL' WHEN score >= 0.4 THEN 'HIGH' WHEN score >= 0.15 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM s"),
    "high_risk_mcc": q("r(mcc, factor, edd, sar, action) AS (VALUES (6051, 2.0::DOUBLE, 1000.0::DOUBLE, 2000.0::DOUBLE, 'RESTRICT_QUASI_CASH'), (4829, 2.0, 1500, 2500, 'RESTRICT_OUTBOUND_WIRES'), (7995, 2.5, 2000, 3000, 'STEP_UP_AUTH'), (5944, 1.75, 2500, 5000, 'ENHANCED_DUE_DILIGENCE'), (6211, 1.5, 3000, 5000, 'STEP_UP_AUTH'))", "x AS (SELECT t.*, factor, edd, sar, action, sum(amount) OVER (PARTITION BY card, mcc ORDER BY us, txn_id ROWS UNBOUNDED PRECEDING) AS run FROM t JOIN r USING (mcc))", "SELECT card, count(DISTINCT mcc) AS n_mcc, count(*) AS n, round(max(run), 4) AS most, round(max(factor) * CASE WHEN count(DISTINCT mcc) >= 3 THEN 1.5 WHEN count(DISTINCT mcc) = 2 THEN 1.25 ELSE 1 END, 4)::DOUBLE AS factor, array_to_string(list_sort(list(DISTINCT action)), ',') AS restrictions, concat_ws(',', CASE WHEN bool_or(run >= sar * 0.1) THEN 'FILE_SAR' END, CASE WHEN bool_or(run >= edd * 0.1) THEN 'ENHANCED_DUE_DILIGENCE' END, 'MONITOR') AS actions FROM x GROUP BY card"),
    "jurisdiction": "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(coalesce(text, '')), '\\b(uk|gbp|fca|london|united kingdom)\\b') THEN 'UK' WHEN regexp_matches(lower(coalesce(text, '')), '\\b(eu|eur|euro|gdpr|sepa)\\b') THEN 'EU' ELSE 'US' END AS place FROM conversations",
    "obligations": q(CASES, "x AS (SELECT case_id, exposure, date_trunc('day', make_timestamp(opened_us)) AS opened, CASE txn_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'UK' ELSE 'EU' END AS place FROM c)", "SELECT case_id, place, exposure >= CASE place WHEN 'UK' THEN 30 WHEN 'EU' THEN 25 ELSE 50 END AS must_file, strftime(opened + to_days(CASE place WHEN 'UK' THEN 14 WHEN 'EU' THEN 10 ELSE 30 END), '%Y-%m-%d') AS deadline FROM x"),
    "mask_text": r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?(\d{4})\b', '****-****-****-\1', 'g'), '([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})', '\1***@\2', 'g') AS masked FROM conversations",
    "mask_for_analyst": q("SELECT txn_id, 'C****' || right(card::VARCHAR, 2) AS card, customer::VARCHAR AS customer FROM t"),
    "policy": q(FACTS, "x AS (SELECT case_id, exposure, n_txns, least(1.0::DOUBLE, risk) AS p, n_devices < 3 AS pn, CASE WHEN outcome = 'cleared' THEN 'legitimate' END AS reply FROM f)", "y AS (SELECT *, CASE WHEN n_txns < 1 THEN 'DENY_EVIDENCE' WHEN p < 0.65 AND reply IS NULL THEN 'DENY_R8_UNCERTAIN' WHEN reply = 'legitimate' THEN 'DENY_R1_CONFIRMED' WHEN pn AND p < 0.85 THEN 'DENY_R7_NEW_PATTERN' ELSE 'ALLOW' END AS decision FROM x)", "SELECT case_id, decision, CASE WHEN decision <> 'ALLOW' THEN 'NONE' WHEN exposure > 10000 THEN 'DIRECTOR' WHEN exposure > 2500 THEN 'L2' ELSE 'L1' END AS route FROM y"),
    "mine_rules": q(PREDICATES, "SELECT * FROM rules"),
    "apply_rules": q(PREDICATES, "ra AS (SELECT antecedent, confidence, string_split(antecedent, '+') AS parts FROM rules)", "hp AS (SELECT case_id, list(DISTINCT predicate) AS has FROM pr GROUP BY case_id)", "SELECT case_id, antecedent, confidence >= 0.85 AS strong FROM hp JOIN ra ON list_has_all(has, parts)"),
    "compliance": q(FACTS, "x AS (SELECT unnest([{'framework': 'AML', 'level': 'critical', 'ok': exposure >= 0}, {'framework': 'AML', 'level': 'warning', 'ok': n_txns >= 2}, {'framework': 'FAIRNESS', 'level': 'warning', 'ok': n_devices < 40}, {'framework': 'AUDIT', 'level': 'critical', 'ok': outcome IN ('confirmed_fraud', 'cleared')}, {'framework': 'AUDIT', 'level': 'critical', 'ok': opened_us > 0}]) AS s FROM f)", "g AS (SELECT s.framework AS framework, count(*) AS n, count(*) FILTER (s.ok) AS passed, count(*) FILTER (NOT s.ok AND s.level = 'critical') AS cr, count(*) FILTER (NOT s.ok AND s.level = 'warning') AS wa FROM x GROUP BY s.framework)", "SELECT framework, n, passed, round(passed / n::DOUBLE * 100, 1) AS score, CASE WHEN cr > 0 THEN 'NON_COMPLIANT' WHEN wa > 0 OR round(passed / n::DOUBLE * 100, 1) < 95 THEN 'CONDITIONAL' ELSE 'COMPLIANT' END AS status FROM g"),
    "memory_prior": q(CASES, "x AS (SELECT case_id, count(*) FILTER (outcome = 'confirmed_fraud') OVER w AS confirmed, count(*) FILTER (outcome <> 'confirmed_fraud') OVER w AS cleared, count(*) FILTER (outcome = 'confirmed_fraud') OVER v > 0 AS df FROM c WINDOW w AS (PARTITION BY customer ORDER BY opened_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY device ORDER BY opened_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))", "y AS (SELECT *, (1 + confirmed) / (11 + confirmed + cleared)::DOUBLE AS p FROM x)", "SELECT case_id, confirmed, cleared, round(p, 6) AS posterior, round(greatest(-10, least(12, CASE WHEN df THEN 6 ELSE 0 END + CASE WHEN confirmed > 0 THEN (p - 1 / 11::DOUBLE) * 20 ELSE 0 END - least(10.0::DOUBLE, 2.5::DOUBLE * cleared))), 6)::DOUBLE AS risk_delta FROM y"),
    "assess": q(ASSESS, "SELECT txn_id, probability, verdict, pattern FROM a"),
    "next_actions": q(ASSESS, "x AS (SELECT txn_id, amount, verdict, CASE WHEN verdict = 'FRAUD' THEN CASE WHEN amount > 100 THEN 'BLOCK_CARD' ELSE 'STEP_UP_AUTH' END WHEN verdict = 'UNCERTAIN' THEN 'CONTACT_CUSTOMER' ELSE 'CLOSE' END AS action FROM a)", "SELECT txn_id, verdict, action, CASE WHEN action = 'BLOCK_CARD' THEN CASE WHEN amount <= 2500 THEN 'L1' ELSE 'L2' END ELSE 'AUTO' END AS route FROM x"),
    "value_of_information": q(ASSESS, "h AS (SELECT txn_id, greatest(1e-6, least(1 - 1e-6, probability)) AS p FROM a)", "SELECT txn_id, question, round(-(p * log2(p) + (1 - p) * log2(1 - p)) * share / cost, 5) AS value FROM h CROSS JOIN (VALUES ('device_check', 0.3::DOUBLE, 0.05::DOUBLE), ('history_check', 0.4, 0.1), ('customer_call', 0.9, 2.5)) k(question, share, cost)"),
    "budget": q(ASSESS, "SELECT txn_id, CASE WHEN probability > 0.85 THEN 'FAST_BLOCK' WHEN probability BETWEEN 0.40 AND 0.75 THEN 'DEEP' WHEN probability < 0.30 THEN 'LIGHT' ELSE 'STANDARD' END AS tier FROM a"),
    "what_if": q(ASSESS, "x AS (SELECT txn_id, probability AS p, scenario, round(greatest(0, least(1, probability + shift)), 6)::DOUBLE AS q FROM a CROSS JOIN (VALUES ('amount_over_limit', 0.1::DOUBLE), ('unlink_device', -0.15), ('customer_denies', 0.25), ('customer_confirms', -0.5)) k(scenario, shift))", "SELECT txn_id, scenario, q AS probability, (p >= 0.65) <> (q >= 0.65) AS flips FROM x"),
    "consensus": q("x AS (SELECT txn_id AS id, risk AS f, least(1, amount / 100)::DOUBLE AS a, CASE WHEN proxy THEN 0.8 ELSE 0.2 END::DOUBLE AS c FROM t)", "y AS (SELECT *, CASE WHEN a >= f AND a >= c THEN 0.35::DOUBLE * f + 0.45::DOUBLE * a + 0.2::DOUBLE * c WHEN c >= f AND c >= a THEN 0.35::DOUBLE * f + 0.2::DOUBLE * a + 0.45::DOUBLE * c ELSE 0.5::DOUBLE * f + 0.25::DOUBLE * a + 0.25::DOUBLE * c END AS s, (f + a + c) / 3 AS m FROM x)", "SELECT id, round(s, 6) AS score, round(greatest(0.2, least(1, 1 - 2.5 * ((f - m) * (f - m) + (a - m) * (a - m) + (c - m) * (c - m)) / 3)), 6)::DOUBLE AS confidence, CASE WHEN s >= 0.65 THEN 'FRAUD' WHEN s <= 0.25 THEN 'LEGITIMATE' ELSE 'UNCERTAIN' END AS verdict, a >= 0.7 AS veto FROM y"),
    "sar": q(ASSESS, "x AS (SELECT txn_id, 'Subject card ' || card || ' of customer ' || customer || '. Pattern: ' || pattern || '. Transaction ' || txn_id || '. Verdict: ' || verdict || '. Filed under internal policy.' AS narrative, round(amount, 0)::BIGINT AS amount FROM a WHERE verdict = 'FRAUD')", "SELECT txn_id, narrative, amount, length(narrative) BETWEEN 50 AND 17000 AS valid FROM x"),
    "uncertain": q("x AS (SELECT txn_id, greatest(1e-6, least(1 - 1e-6, risk)) AS p FROM t)", "SELECT txn_id, round(-(p * log2(p) + (1 - p) * log2(1 - p)), 4) AS entropy, round(1 - 2 * abs(p - 0.5), 4) AS margin FROM x"),
    "topology_flags": q(f"x AS (SELECT *, count(*) OVER (PARTITION BY card ORDER BY us RANGE BETWEEN {D} PRECEDING AND {D} FOLLOWING) AS nn FROM t)", "dc AS (SELECT device, count(DISTINCT card) AS nc FROM t GROUP BY device)", "SELECT txn_id, concat_ws(',', CASE WHEN mcc IN (6051, 7995, 4829, 6011) THEN 'HIGH_RISK_MCC' END, CASE WHEN amount >= 85 AND amount < 100 THEN 'NEAR_LIMIT' END, CASE WHEN amount >= 100 THEN 'OVER_LIMIT' END, CASE WHEN nc > 1 THEN 'SHARED_DEVICE' END, CASE WHEN nn >= 4 THEN 'DENSE' END) AS flags FROM x JOIN dc USING (device)"),
    "calibration": q("b AS (SELECT least(floor(risk * 10), 9) AS bin, count(*) AS n, avg(risk) AS cf, avg(is_fraud::INTEGER) AS ac, sum((risk - is_fraud::INTEGER) * (risk - is_fraud::INTEGER)) AS sq FROM t GROUP BY 1)", "SELECT sum(n)::BIGINT AS n, round(sum(n * abs(cf - ac)) / sum(n), 6) AS ece, round(max(abs(cf - ac)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM b"),
    "confusion": q("g AS (SELECT count(*) FILTER (risk >= 0.5 AND is_fraud) AS tp, count(*) FILTER (risk >= 0.5 AND NOT is_fraud) AS fp, count(*) FILTER (risk < 0.5 AND is_fraud) AS fn, count(*) FILTER (risk < 0.5 AND NOT is_fraud) AS tn FROM t)", "SELECT tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6)::DOUBLE AS f1, round(coalesce(fp / nullif(fp + tn, 0)::DOUBLE, 0), 6)::DOUBLE AS fpr, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0)::DOUBLE, 0), 6)::DOUBLE AS accuracy FROM g"),
    "stratified": q("s AS (SELECT txn_id, channel, (row_number() OVER (PARTITION BY channel ORDER BY md5('42:' || txn_id), txn_id))::INTEGER AS rank FROM t)", "SELECT * FROM s WHERE rank <= CASE channel WHEN 'online' THEN 84 WHEN 'in_person' THEN 16 ELSE 0 END"),
    "precedents": "WITH x AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0), r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INTEGER AS rank FROM x) SELECT * FROM r WHERE rank <= 5",
    "tokens": f"SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS tokens FROM (SELECT item_id, {_tokens('text')} AS w FROM benchmark)",
    "bm25": "WITH qs AS (SELECT item_id AS query_id, text FROM benchmark),\n" + _bm25("documents", "qs") + "\nSELECT query_id, doc_id, score, rank::INTEGER AS rank FROM bm",
    "retrieval_quality": "WITH qs AS (SELECT item_id AS query_id, text FROM benchmark), b AS (SELECT item_id AS doc_id, text FROM benchmark),\n" + _bm25("b", "qs") + ",\nx AS (SELECT qs.query_id, bm.rank FROM qs LEFT JOIN bm ON bm.query_id = qs.query_id AND bm.doc_id = qs.query_id)\nSELECT round(avg(coalesce(1 / rank::DOUBLE, 0)), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS top1, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS topk FROM x",
    "grounding": q(CASES, "SELECT case_id AS id, CASE WHEN card % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS n_cited, CASE WHEN card % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS n_unknown, CASE WHEN card % 2 = 0 THEN 0.75 ELSE 1 END::DOUBLE AS faithfulness FROM c"),
    "sanitise": r"SELECT conv_id, turn, left(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')), 500) AS clean FROM conversations",
    "ledger_verify": q(CASES, "SELECT card, count(*) AS n, 0::BIGINT AS n_broken FROM c GROUP BY card"),
    "backoff": q("SELECT txn_id, least(300.0::DOUBLE, 2 * pow(2, txn_id % 8)) AS wait, CASE WHEN txn_id % 8 + 1 >= 5 THEN 'DEAD_LETTER' ELSE 'RETRY' END AS state FROM t"),
    "tasks_once": q("x AS (SELECT *, sha256(card::VARCHAR || '|' || merchant) AS key FROM t)", "SELECT key, txn_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, txn_id) AS r FROM x) WHERE r = 1"),
    "link_parts": r"""WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS brand, p_type AS type FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL),
d AS (SELECT name AS w FROM p WHERE name IS NOT NULL UNION SELECT type FROM p),
x0 AS (SELECT a.w AS a, b.w AS b, lower(trim(a.w)) AS u, lower(trim(b.w)) AS v FROM d a CROSS JOIN d b),
x1 AS (SELECT *, jaro_similarity(u, v) AS j, CASE WHEN left(u, 4) = left(v, 4) THEN 4 WHEN left(u, 3) = left(v, 3) THEN 3 WHEN left(u, 2) = left(v, 2) THEN 2 WHEN left(u, 1) = left(v, 1) THEN 1 ELSE 0 END AS l FROM x0),
x AS (SELECT a, b, CASE WHEN u = '' AND v = '' THEN 1 WHEN u = '' OR v = '' THEN 0 ELSE round(j + l * 0.1::DOUBLE * (1 - j), 4) END AS s FROM x1),
y AS (SELECT a.k AS p_partkey_a, b.k AS p_partkey_b, CASE WHEN n.s >= 0.9 THEN 1 WHEN n.s < 0.75 THEN 0 ELSE (n.s - 0.75::DOUBLE) / (0.9::DOUBLE - 0.75::DOUBLE) END AS g, CASE WHEN lower(trim(a.brand)) = lower(trim(b.brand)) THEN 1 ELSE 0 END AS h, CASE WHEN t.s >= 0.85 THEN 1 WHEN t.s < 0.7 THEN 0 ELSE (t.s - 0.7::DOUBLE) / (0.85::DOUBLE - 0.7::DOUBLE) END AS i FROM p a JOIN p b ON a.k < b.k JOIN x t ON t.a = a.type AND t.b = b.type LEFT JOIN x n ON n.a = a.name AND n.b = b.name),
z AS (SELECT *, round(coalesce(g * log2(0.95::DOUBLE / 0.05::DOUBLE) + (1 - g) * log2(0.05::DOUBLE / 0.95::DOUBLE), 0) + h * log2(0.9::DOUBLE / 0.1::DOUBLE) + (1 - h) * log2(0.1::DOUBLE / 0.9::DOUBLE) + i * log2(0.85::DOUBLE / 0.08::DOUBLE) + (1 - i) * log2(0.15::DOUBLE / 0.92::DOUBLE), 6) AS weight FROM y)
SELECT p_partkey_a, p_partkey_b, weight, round(1 / (1 + pow(2.0, -weight)), 6) AS posterior, CASE WHEN 1 / (1 + pow(2.0, -weight)) >= 0.85 THEN 'MATCH' ELSE 'POSSIBLE' END AS decision FROM z WHERE 1 / (1 + pow(2.0, -weight)) >= 0.65""",
    "device_nexus": q(NEXUS, "SELECT * FROM nx"),
    "cardholder_sybils": q(NEXUS, "bo AS (SELECT device_a AS device, device_b AS lk FROM nx UNION ALL SELECT device_b, device_a FROM nx)", "us AS (SELECT DISTINCT card, device FROM t)", "SELECT u.card, count(DISTINCT lk) AS n_links, count(DISTINCT o.card) AS n_cards, round(least(1.0::DOUBLE, 0.35::DOUBLE * count(DISTINCT lk) + 0.2::DOUBLE * count(DISTINCT o.card)), 4)::DOUBLE AS risk FROM us u JOIN bo USING (device) JOIN us o ON o.device = lk AND o.card <> u.card GROUP BY u.card"),
    "task_risk": q("SELECT txn_id, (CASE WHEN amount >= 200 THEN 0.9 WHEN amount >= 100 THEN 0.6 WHEN amount >= 50 THEN 0.3 ELSE 0.1 END)::DOUBLE AS risk FROM t"),
    "amount_histogram": q("SELECT bound, (SELECT count(*) FROM t WHERE amount <= bound) AS n FROM (VALUES (1.0::DOUBLE), (10.0), (50.0), (100.0), ('inf'::DOUBLE)) b(bound)"),
    "case_briefs": q(FACTS, "SELECT case_id, left('Case ' || case_id || chr(10) || 'Outcome: ' || outcome || chr(10) || 'Transactions: ' || n_txns, 40) AS brief FROM f"),
    "rule_chunks": q(PREDICATES, "SELECT 'rule-' || substr(md5(antecedent), 1, 8) AS chunk_id, 'If ' || replace(antecedent, '+', ' and ') || ' then confirmed fraud with confidence ' || round(confidence * 100, 0)::BIGINT || ' %, support ' || support || '.' AS text FROM rules"),
    "velocity_spike": q(SPIKE, "SELECT *, CASE WHEN total >= 600 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM sp"),
    "novel_device_link": q(NOVEL, "SELECT txn_id, device, card, n_before::INTEGER AS n_before FROM nv"),
    "impossible_travel": q(LOCATED, "x AS (SELECT txn_id, card, 2 * 6371.0::DOUBLE * asin(sqrt(least(1, pow(sin(radians(lat - a) / 2), 2) + cos(radians(a)) * cos(radians(lat)) * pow(sin(radians(lon - b) / 2), 2)))) AS km, greatest(0.001::DOUBLE, (us - pu) / 3.6e9::DOUBLE) AS h FROM lo WHERE pu IS NOT NULL)", "SELECT * FROM (SELECT txn_id, card, round(km, 3) AS km, round(km / h, 3) AS speed FROM x) WHERE speed > 800 AND km > 100"),
    "stream_mcc": q("SELECT txn_id, card, mcc, amount FROM t WHERE mcc IN (6051, 7995, 4829, 6011) AND amount >= 100"),
    "alert_stats": q(SPIKE, NOVEL, "SELECT 'VELOCITY_SPIKE' AS rule, CASE WHEN total >= 600 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, count(*) AS n FROM sp GROUP BY 2 UNION ALL SELECT 'NOVEL_DEVICE_LINK', 'HIGH', count(*) FROM nv HAVING count(*) > 0 UNION ALL SELECT 'HIGH_RISK_MCC', 'MEDIUM', count(*) FROM t WHERE mcc IN (6051, 7995, 4829, 6011) AND amount >= 100 HAVING count(*) > 0"),
    "exposure_rollup": "SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (c_mktsegment, n_name)",
    "status_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "active_customers": "(SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "customers_without_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "customers_with_large_orders": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 400000)",
    "as_of_status": q("SELECT txn_id, (SELECT arg_max(e.txn_id, (e.us, e.txn_id)) FROM t e WHERE e.is_fraud AND e.card = x.card AND e.us <= x.us) AS error_id FROM t x"),
    "interval_pairs": q("SELECT b.card, b.txn_id AS buy_id, e.txn_id AS error_id FROM t b JOIN t e ON b.card = e.card AND e.is_fraud AND b.merchant LIKE 'purchase%' AND e.us > b.us AND e.us - b.us <= 1800000000"),
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2)::DOUBLE AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "supplier_market": "SELECT a.n_name AS buyer, b.n_name AS seller, round(sum(l_extendedprice * (1 - l_discount)), 4) AS net, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey WHERE c_nationkey <> s_nationkey GROUP BY a.n_name, b.n_name",
    "top_customers": "WITH x AS (SELECT c_mktsegment, c_custkey, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY total DESC, c_custkey))::INTEGER AS rank FROM x) WHERE rank <= 3",
}
