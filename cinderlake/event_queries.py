"""The registered queries of the library and their SQL twins (DuckDB), side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinderlake.functions import text as X
from cinderlake.operators import evidence as E
from cinderlake.operators import graph as G
from cinderlake.operators import joins as J
from cinderlake.operators import models as M
from cinderlake.operators import normalize as N
from cinderlake.operators import signatures as R
from cinderlake.operators import windows as W
from cinderlake.plans.stored import materialize
from cinderlake.registry import twin, twins
from cinderlake.sources.tables import events, table
from cinderlake.streaming.filters import event_filter

DAY = 86_400

#: SQL of the normalized events and of what several twins share.
EV = """ev AS (SELECT event_id AS pos, epoch_us(ts) AS t, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type, value,
  event_type = 'purchase' AS seed, LEAST(4, GREATEST(0, CAST(floor(value / 25) AS INTEGER))) AS severity FROM events)"""
ENT = EV + """, ent AS (SELECT pos, t, 'U:' || user_id AS entity, seed FROM ev UNION SELECT pos, t, 'K:' || k AS entity, seed FROM ev)"""
EDGES = ENT + """, lagged AS (SELECT entity, pos, t, n, lag(pos, n) OVER (PARTITION BY entity, n ORDER BY t, pos) AS src, lag(t, n) OVER (PARTITION BY entity, n ORDER BY t, pos) AS pt
  FROM ent, (SELECT unnest([1, 2, 3]) AS n) ks), edges AS (SELECT entity, src, pos AS dst FROM lagged WHERE src IS NOT NULL AND t - pt <= 3600000000)"""
COMP = EDGES + """, both_ AS (SELECT DISTINCT src AS a, dst AS b FROM edges UNION SELECT DISTINCT dst, src FROM edges),
  walk(node, root) AS (SELECT pos, pos FROM ev UNION SELECT b, root FROM walk JOIN both_ ON a = node WHERE root < b),
  members AS (SELECT node AS pos, min(root) AS cluster FROM walk GROUP BY node)"""
NEAR = ENT + """, codes AS (SELECT pos, t, entity, seed, CASE WHEN seed THEN (t - 1700000000000000)::HUGEINT * 10000000 + pos END AS code FROM ent),
  sides AS (SELECT pos, t, seed, max(code) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
    min(code) OVER (PARTITION BY entity ORDER BY t RANGE BETWEEN 0 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM codes),
  ways AS (SELECT pos, CAST(0 AS HUGEINT) AS distance, pos AS ref FROM sides WHERE seed
    UNION ALL SELECT pos, abs((t - 1700000000000000) - b // 10000000), b % 10000000 FROM sides WHERE NOT seed AND b IS NOT NULL
    UNION ALL SELECT pos, abs((t - 1700000000000000) - a // 10000000), a % 10000000 FROM sides WHERE NOT seed AND a IS NOT NULL),
  near AS (SELECT pos, CAST(distance AS BIGINT) AS distance, CAST(ref AS BIGINT) AS ref FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY distance, ref) AS r FROM ways) WHERE r = 1)"""


def errors(spark, sf_dir, key="user_id", d=None):
    rows = events(spark, sf_dir).where("event_type = 'error'")
    return rows.select(F.col(key).alias("key"), "t", "pos", *([F.col(d).alias("d")] if d else []))


@twin("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('error', 'purchase') AND ts BETWEEN '2024-01-05' AND '2024-01-12' ORDER BY ts, event_id LIMIT 500")
def scan_filter_events(spark, sf_dir):
    rows = event_filter(table(spark, sf_dir, "events"), ["error", "purchase"], "2024-01-05", "2024-01-12")
    return rows.orderBy("ts", "event_id").limit(500).select("event_id", "user_id", "event_type", "value")


@twin("""SELECT count(*) AS total, count(DISTINCT event_id) AS distinct_ids, count(*) - count(DISTINCT event_id) AS duplicates, count(*) FILTER (user_id IS NULL) AS no_user,
  count(*) FILTER (ts IS NULL) AS no_time, count(*) FILTER (value < 0) AS negative, count(*) FILTER (event_type NOT IN ('view', 'signup', 'error', 'click', 'purchase')) AS bad_type FROM events""")
def validate_events(spark, sf_dir):
    known = ["view", "signup", "error", "click", "purchase"]
    unique = F.countDistinct("event_id")
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("total"), unique.alias("distinct_ids"), (F.count("*") - unique).alias("duplicates"), F.count_if(F.col("user_id").isNull()).alias("no_user"),
        F.count_if(F.col("ts").isNull()).alias("no_time"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(~F.col("event_type").isin(known)).alias("bad_type"),
    )


@twin("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || json_extract_string(props, '$.k') AS shape FROM events")
def kv_extract_props(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("pos").alias("event_id"), "k", F.concat_ws(":", "event_type", F.col("k").cast("string")).alias("shape"))


def _threshold_sql(key: str, met: str) -> str:
    return f"""WITH {EV}, q AS (SELECT {key} AS key, t, pos, user_id AS d FROM ev WHERE event_type = 'error'),
  w AS (SELECT key, t, min(t) OVER win AS start, count(*) OVER win AS c, list(d) OVER win AS ds FROM q WINDOW win AS (PARTITION BY key ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
  hit AS (SELECT key, arg_min(start, t) AS start FROM w WHERE {met} GROUP BY key)
  SELECT q.key, count(*) AS n_events, min(t) AS first_t, max(t) AS last_t, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY t, pos) AS evidence
  FROM q JOIN hit ON q.key = hit.key AND t BETWEEN start AND start + 86400000000 GROUP BY q.key"""


def _flat(alerts):
    return alerts.withColumn("evidence", F.array_join(F.col("evidence").cast("array<string>"), ","))


@twin(_threshold_sql("user_id", "c >= 3"))
def threshold_count(spark, sf_dir):
    return _flat(W.threshold(errors(spark, sf_dir), 3, DAY))


@twin(_threshold_sql("k", "len(list_distinct(ds)) >= 3"))
def threshold_distinct(spark, sf_dir):
    return _flat(W.threshold(errors(spark, sf_dir, "k", "user_id"), 3, DAY, distinct=True))


_BURST = f"""WITH {EV}, q AS (SELECT user_id AS key, t, pos FROM ev WHERE event_type = 'error'),
  w AS (SELECT key, t, count(*) OVER (PARTITION BY key ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS c FROM q),
  b AS (SELECT key, count(*) AS n_events, min(t) AS first_t, max(c) AS peak FROM w GROUP BY key HAVING max(c) >= 3)"""


@twin(_BURST + " SELECT key, n_events, first_t, peak FROM b")
def burst_all_failures(spark, sf_dir):
    return W.burst(errors(spark, sf_dir), 3, DAY)


@twin(_BURST + " SELECT b.key, count(*) AS n_success, min(ev.pos) AS first_pos FROM b JOIN ev ON ev.user_id = b.key AND ev.seed AND ev.t >= b.first_t GROUP BY b.key")
def success_after_burst(spark, sf_dir):
    wins = events(spark, sf_dir).where("seed").select(F.col("user_id").alias("key"), "t", "pos")
    return W.after_burst(burst_all_failures(spark, sf_dir), wins)


@twin("SELECT p_partkey, p_brand, p_type, p_size, shape_count FROM (SELECT *, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS shape_count FROM part) WHERE shape_count <= 2")
def rare_shape(spark, sf_dir):
    shape = ["p_brand", "p_type", "p_size"]
    return W.rare(table(spark, sf_dir, "part").select("p_partkey", *shape), shape)


@twin(f"""WITH {EV}, c AS (SELECT event_type, k, count(*) AS c FROM ev GROUP BY ALL), n AS (SELECT count(*) AS n FROM ev)
  SELECT event_type, k, c, round(c / n, 6) AS event_frequency, round(1 - ln(1 + c) / ln(1 + n), 6) AS rarity FROM c, n""")
def event_frequency_rarity(spark, sf_dir):
    return W.frequency(events(spark, sf_dir), ["event_type", "k"])


def _edges(spark, sf_dir):
    return G.link_edges(G.event_entities(events(spark, sf_dir)))


@twin(f"WITH {EDGES} SELECT entity, src, dst FROM edges")
def k_prev_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@twin(f"WITH {EDGES} SELECT pos, count(*) AS degree FROM (SELECT src AS pos FROM edges UNION ALL SELECT dst FROM edges) GROUP BY pos")
def degree(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@twin(f"WITH RECURSIVE {COMP} SELECT pos, cluster FROM members")
def components(spark, sf_dir):
    return G.clusters(events(spark, sf_dir), _edges(spark, sf_dir))


@twin(f"""WITH RECURSIVE {COMP}, e AS (SELECT cluster, count(*) AS edges FROM edges JOIN members ON dst = pos GROUP BY cluster)
  SELECT m.cluster, count(*) AS size, coalesce(any_value(e.edges), 0) AS edges, round(coalesce(any_value(e.edges), 0) / count(*), 6) AS density FROM members m LEFT JOIN e USING (cluster) GROUP BY m.cluster""")
def cluster_stats(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return G.cluster_statistics(G.clusters(events(spark, sf_dir), edges), edges)


@twin(f"""WITH RECURSIVE {COMP} SELECT pos, cluster, count(*) OVER c AS size, round(sum(CAST(seed AS INTEGER)) OVER c / count(*) OVER c, 6) AS detection_fraction,
  round(count(*) OVER (PARTITION BY cluster, event_type) / count(*) OVER c, 6) AS event_type_similarity, max(CAST(seed AS INTEGER)) OVER c AS has_detection FROM ev JOIN members USING (pos) WINDOW c AS (PARTITION BY cluster)""")
def cluster_composition(spark, sf_dir):
    return G.composition(events(spark, sf_dir), components(spark, sf_dir))


def _near(spark, sf_dir):
    rows = events(spark, sf_dir)
    return J.nearest_seed(G.event_entities(rows), rows.where("seed"))


@twin(f"WITH {NEAR} SELECT pos, ref, distance FROM near")
def nearest_seed(spark, sf_dir):
    return _near(spark, sf_dir)


_TEMPORAL = """round(ln(1 + distance / 1e6), 6) AS timestamp_distance, CAST(distance <= 60000000 AS INTEGER) AS within_1_minute, CAST(distance <= 300000000 AS INTEGER) AS within_5_minutes,
  CAST(distance <= 900000000 AS INTEGER) AS within_15_minutes, CAST(distance <= 3600000000 AS INTEGER) AS within_1_hour, round(exp(-(distance / 1e6) / 900), 6) AS temporal_proximity"""


@twin(f"WITH {NEAR} SELECT pos, {_TEMPORAL} FROM near")
def temporal_features(spark, sf_dir):
    return J.temporal_features(_near(spark, sf_dir))


@twin(f"""WITH {NEAR} SELECT n.pos AS a, n.ref AS b, CAST(x.user_id = y.user_id AS INTEGER) + CAST(x.k = y.k AS INTEGER) AS shared,
  round((CAST(x.user_id = y.user_id AS INTEGER) + CAST(x.k = y.k AS INTEGER)) / (4 - CAST(x.user_id = y.user_id AS INTEGER) - CAST(x.k = y.k AS INTEGER)), 6) AS overlap_ratio
  FROM near n JOIN ev x ON x.pos = n.pos JOIN ev y ON y.pos = n.ref""")
def pair_overlap(spark, sf_dir):
    sets = events(spark, sf_dir).select("pos", "entities")
    return J.overlap(sets, sets, _near(spark, sf_dir).select(F.col("pos").alias("a"), F.col("ref").alias("b")))


#: Sums of doubles depend on their order: this is the twin's.
_ADDED = ["detection_match", "within_5_minutes", "severity", "rarity", "within_1_hour"]


def _scored(spark, sf_dir):
    rows = events(spark, sf_dir)
    rarity = W.frequency(rows, ["event_type", "k"]).select("event_type", "k", "rarity")
    near = J.temporal_features(_near(spark, sf_dir)).select("pos", "within_5_minutes", "within_1_hour")
    features = rows.join(rarity, ["event_type", "k"]).join(near, "pos", "left")
    features = features.select("pos", "t", "event_type", "user_id", "k", F.col("seed").alias("has_detection"), F.col("seed").cast("int").alias("detection_match"), (F.col("severity") / 4).alias("severity"), "rarity", "within_5_minutes", "within_1_hour")
    return features.withColumn("score", E.rounded(E.rule_score(features, _ADDED)))


_SCORED = NEAR + f""", freq AS (SELECT event_type, k, round(1 - ln(1 + count(*)) / ln(1 + (SELECT count(*) FROM ev)), 6) AS rarity FROM ev GROUP BY ALL),
  feat AS (SELECT ev.pos, t, ev.event_type, user_id, ev.k, seed AS has_detection, CAST(seed AS INTEGER) AS dm, severity / 4 AS sev, rarity,
    CAST(coalesce(distance, 999999999999) <= 300000000 AS INTEGER) AS w5, CAST(coalesce(distance, 999999999999) <= 3600000000 AS INTEGER) AS w60
    FROM ev JOIN freq ON freq.event_type = ev.event_type AND freq.k = ev.k LEFT JOIN near ON near.pos = ev.pos),
  scored AS (SELECT *, round((3.0 * dm + w5 + sev + LEAST(1.0, GREATEST(0.0, rarity)) + 0.5 * w60) / {sum(E.WEIGHTS.values())}, 6) AS score FROM feat)"""


@twin(f"WITH {_SCORED} SELECT pos, score FROM scored")
def rule_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("pos", "score")


_RANKED = _SCORED + ", ranked AS (SELECT pos, t, score, has_detection, row_number() OVER (ORDER BY score DESC, t, pos) AS rank, score >= 0.35 OR has_detection AS selected, event_type, user_id FROM scored)"


@twin(f"WITH {_RANKED} SELECT pos, score, rank, selected FROM ranked")
def rank_select(spark, sf_dir):
    return E.ranked(_scored(spark, sf_dir)).select("pos", "score", "rank", "selected")


@twin(f"WITH {_SCORED} SELECT pos, score, event_type FROM scored ORDER BY score DESC, t, pos LIMIT 25")
def topk_candidates(spark, sf_dir):
    return _scored(spark, sf_dir).orderBy(F.desc("score"), "t", "pos").limit(25).select("pos", "score", "event_type")


@twin(f"""WITH {_RANKED}, s AS (SELECT * FROM ranked WHERE selected), g AS (SELECT user_id, event_type, count(*) AS n, min(t) AS first_t, max(t) AS last_t, list(CAST(pos AS VARCHAR) ORDER BY t, pos) AS ids FROM s GROUP BY ALL)
  SELECT user_id, event_type, 'aggregate' AS kind, n, first_t, last_t, array_to_string(ids[1:5], ',') AS ids FROM g WHERE n >= 3
  UNION ALL SELECT s.user_id, s.event_type, 'single', 1, t, t, CAST(pos AS VARCHAR) FROM s JOIN g USING (user_id, event_type) WHERE n < 3""")
def evidence_objects(spark, sf_dir):
    scored = _scored(spark, sf_dir)
    return E.evidence_objects(scored.where((F.col("score") >= E.SELECT_AT) | F.col("has_detection")), ["user_id", "event_type"])


@twin("""WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM p a JOIN p b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 40""")
def cooccurrence_pairs(spark, sf_dir):
    return G.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


_BY_HOUR = f"WITH {EV}, p AS (SELECT DISTINCT t // 3600000000 AS g, k AS x FROM ev), e AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM p a JOIN p b USING (g) WHERE a.x < b.x GROUP BY ALL ORDER BY n DESC, 1, 2 LIMIT 40)"


@twin(f"{_BY_HOUR}, u AS (SELECT a AS x FROM e UNION SELECT b FROM e) SELECT x, count(*) AS n FROM u JOIN p USING (x) GROUP BY x")
def cooccurrence_nodes(spark, sf_dir):
    """Items of the pairs that most often share an hour, and in how many hours each occurs."""
    rows = events(spark, sf_dir).select(F.expr("t div 3600000000").alias("g"), F.col("k").alias("x"))
    return G.cooccurrence_nodes(rows, materialize(G.cooccurrence(rows, "g", "x"), "top-pairs"), "g", "x")


def _alerts(spark, sf_dir):
    """Threshold alerts by user and by k, keyed by the events that they cite."""
    users = W.threshold(errors(spark, sf_dir), 3, DAY).withColumn("alert", F.col("key") * 2)
    ks = W.threshold(errors(spark, sf_dir, "k", "user_id"), 3, DAY, distinct=True).withColumn("alert", F.col("key") * 2 + 1)
    rank = F.when(F.col("n_events") >= 5, 3).otherwise(2)
    return users.union(ks).select("alert", "n_events", "first_t", "last_t", F.col("evidence").alias("keys"), rank.alias("severity_rank"))


def _alert_parts(key: str, met: str, tag: str, alert: str) -> str:
    return f"""q{tag} AS (SELECT {key} AS key, t, pos, user_id AS d FROM ev WHERE event_type = 'error'),
  w{tag} AS (SELECT key, t, min(t) OVER win AS start, count(*) OVER win AS c, list(d) OVER win AS ds FROM q{tag} WINDOW win AS (PARTITION BY key ORDER BY t RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)),
  h{tag} AS (SELECT key, arg_min(start, t) AS start FROM w{tag} WHERE {met} GROUP BY key),
  c{tag} AS (SELECT {alert} AS alert, t, pos FROM q{tag} q JOIN h{tag} h ON q.key = h.key AND t BETWEEN start AND start + 86400000000)"""


_ALERTS = f"""{EV}, {_alert_parts('user_id', 'c >= 3', '1', 'q.key * 2')}, {_alert_parts('k', 'len(list_distinct(ds)) >= 3', '2', 'q.key * 2 + 1')},
  cited AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2), alerts AS (SELECT alert, count(*) AS n_events, min(t) AS first_t, max(t) AS last_t, CASE WHEN count(*) >= 5 THEN 3 ELSE 2 END AS severity_rank FROM cited GROUP BY alert),
  links AS (SELECT DISTINCT x.alert AS a, y.alert AS b FROM cited x JOIN cited y ON x.pos = y.pos AND x.alert < y.alert)"""


@twin(f"WITH {_ALERTS} SELECT a, b FROM links")
def alert_links(spark, sf_dir):
    return E.alert_links(_alerts(spark, sf_dir))


_INCIDENTS = _ALERTS + """, both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links), walk(node, root) AS (SELECT alert, alert FROM alerts UNION SELECT b, root FROM walk JOIN both_ ON a = node WHERE root < b),
  owner AS (SELECT node, min(root) AS incident FROM walk GROUP BY node),
  incidents AS (SELECT incident, count(*) AS n_alerts, CAST(sum(n_events) AS BIGINT) AS n_events, min(first_t) AS first_t, max(last_t) AS last_t, max(severity_rank) AS severity_rank FROM alerts JOIN owner ON alert = node GROUP BY incident)"""


@twin(f"WITH RECURSIVE {_INCIDENTS} SELECT * FROM incidents")
def incidents(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    return E.incidents(alerts, E.connecting_links(alerts))


@twin(f"""WITH RECURSIVE {_INCIDENTS}, p AS (SELECT incident, [0, 5, 12, 22, 30][severity_rank + 1] AS sev, CAST(LEAST(16, 4 * (n_alerts - 1)) AS INTEGER) AS extra, CASE WHEN n_events >= 10 THEN 10 ELSE 0 END AS wide FROM incidents),
  s AS (SELECT *, CAST(LEAST(100, sev + extra + wide) AS INTEGER) AS score FROM p)
  SELECT incident, score, concat_ws(';', CASE WHEN sev > 0 THEN 'severity=' || sev END, CASE WHEN extra > 0 THEN 'extra_alerts=' || extra END, CASE WHEN wide > 0 THEN 'many_events=' || wide END) AS factors,
  CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'informational' END AS band FROM s""")
def risk_itemized(spark, sf_dir):
    return E.risk(incidents(spark, sf_dir)).select("incident", "score", "factors", "band")


def _by_user(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("user_id").alias("key"), "t", "pos", "event_type", "severity")


@twin(f"WITH {EV} SELECT pos, coalesce((event_type, severity) IS DISTINCT FROM lag((event_type, severity)) OVER (PARTITION BY user_id ORDER BY t, pos) AND lag(pos) OVER (PARTITION BY user_id ORDER BY t, pos) IS NOT NULL, false) AS changed FROM ev")
def timeline_transitions(spark, sf_dir):
    return W.transitions(_by_user(spark, sf_dir), ["event_type", "severity"]).select("pos", "changed")


@twin(f"""WITH {EV}, m AS (SELECT user_id AS key, t, pos, event_type, CAST(coalesce(event_type <> lag(event_type) OVER (PARTITION BY user_id ORDER BY t, pos), true) AS INTEGER) AS new FROM ev),
  i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY key ORDER BY t, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)
  SELECT key, island, event_type, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM i GROUP BY key, island, event_type""")
def attack_chain(spark, sf_dir):
    return W.chain(_by_user(spark, sf_dir), "event_type")


_ISLANDS = "WITH u AS (SELECT DISTINCT o_orderkey AS x FROM orders WHERE o_totalprice > 100000), g AS (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM u), r AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM g GROUP BY g)"


def _islands(spark, sf_dir):
    return W.islands(table(spark, sf_dir, "orders").where("o_totalprice > 100000"), "o_orderkey", 1024)


@twin(_ISLANDS + " SELECT lo, hi, n FROM r")
def id_islands(spark, sf_dir):
    return _islands(spark, sf_dir)


@twin(_ISLANDS + " SELECT x AS id FROM u")
def id_expand(spark, sf_dir):
    return _islands(spark, sf_dir).select(F.explode(F.sequence("lo", "hi")).alias("id"))


@twin(f"WITH {EV}, d AS (SELECT unnest([0, 1, 2, 3, 4, 5]) AS severity) SELECT d.severity, count(ev.pos) AS n FROM d LEFT JOIN ev ON ev.severity = d.severity GROUP BY d.severity")
def severity_histogram(spark, sf_dir):
    counted = events(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))
    levels = spark.range(6).select(F.col("id").cast("int").alias("severity"))
    return levels.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


@twin(f"WITH {EV} SELECT event_type, count(*) AS n FROM ev WHERE user_id NOT IN (SELECT user_id FROM ev WHERE seed AND severity = 4) GROUP BY event_type")
def excluded_by_category(spark, sf_dir):
    """Events of users without a detection of the highest severity, by type; all detections of the table count."""
    rows = events(spark, sf_dir)
    relevant = rows.where("seed and severity = 4").select("user_id").distinct()
    return rows.join(relevant, "user_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("n"))


@twin(f"""WITH RECURSIVE {COMP}, hit AS (SELECT DISTINCT cluster FROM ev JOIN members USING (pos) WHERE seed)
  SELECT event_type, count(*) AS n FROM ev JOIN members USING (pos) WHERE cluster NOT IN (SELECT cluster FROM hit) GROUP BY event_type""")
def excluded_by_cluster(spark, sf_dir):
    """Events outside every cluster with a detection, by type; all detections of the table count, whatever their date."""
    return G.without_detection(events(spark, sf_dir), components(spark, sf_dir)).groupBy("event_type").agg(F.count("*").alias("n"))


def _big_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))


@twin("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_big_orders(spark, sf_dir), "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@twin("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(_big_orders(spark, sf_dir), "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@twin("SELECT l_orderkey, count(*) AS n_items, count(*) FILTER (p_size IS NULL OR p_size > 40) AS n_missing, count(*) FILTER (p_size IS NULL OR p_size > 40) = 0 AS complete FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
def completeness_join(spark, sf_dir):
    small = table(spark, sf_dir, "part").where("p_size <= 40").select(F.col("p_partkey").alias("l_partkey"))
    return J.complete(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), small, "l_orderkey", "l_partkey")


@twin("SELECT r_name, count(*) AS n_suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def dim_broadcast(spark, sf_dir):
    # nation and region are fixed dimensions of 25 and 5 rows.
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    dim = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = table(spark, sf_dir, "supplier").join(dim, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name").agg(F.count("*").alias("n_suppliers"), F.round(F.sum("s_acctbal"), 2).alias("balance"))


@twin("""WITH s AS (SELECT doc_id FROM documents WHERE n_chars >= 600), j AS (SELECT coalesce(l.quality = 1, false) AS want, s.doc_id IS NOT NULL AS hit FROM labels l FULL JOIN s ON l.doc_id = s.doc_id),
  c AS (SELECT count(*) FILTER (hit AND want) AS tp, count(*) FILTER (hit AND NOT want) AS fp, count(*) FILTER (NOT hit AND want) AS fn FROM j)
  SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_eval(spark, sf_dir):
    chosen = table(spark, sf_dir, "documents").where("n_chars >= 600").select("doc_id")
    return J.confusion(chosen, table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("positive")), "doc_id")


@twin("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('1337:' || doc_id), 1, 8) AS BIGINT) < 3006477107 THEN 'train' ELSE 'test' END AS split FROM documents")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.hash_split(F.col("doc_id"), "1337", 0.7).alias("split"))


@twin("SELECT p_partkey, round(list_aggregate(string_split(p_name, ''), 'entropy'), 6) AS bits FROM part")
def entropy_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.entropy(F.col("p_name")), 6).alias("bits"))


SCREEN = {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "secret": r"(?i)(token|password|secret) *[=:]", "address": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "license": r"(?i)licen[sc]e"}


@twin("SELECT doc_id, finding FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for k, p in SCREEN.items()) + " END AS finding FROM documents) WHERE finding IS NOT NULL")
def screen_text(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", X.first_match(F.col("text"), SCREEN).alias("finding"))
    return found.where("finding is not null")


@twin(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '((token|password|secret) *[=:] *"?)[A-Za-z0-9]{8,}', '\1[REDACTED_SECRET]', 'g'), '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+', '[REDACTED_EMAIL]', 'g')) AS digest FROM documents""")
def redact_secrets(spark, sf_dir):
    patterns = {"SECRET": r"((?:token|password|secret) *[=:] *\"?)[A-Za-z0-9]{8,}", "EMAIL": X.EMAIL}
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.redact(F.col("text"), patterns)).alias("digest"))


@twin(r"""WITH f AS (SELECT doc_id, list_distinct(m) AS d, m FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+') AS m FROM documents)),
  u AS (SELECT doc_id, v AS value, list_position(m, v) AS p FROM (SELECT doc_id, m, unnest(d) AS v FROM f))
  SELECT doc_id, value, 'EMAIL_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p) AS VARCHAR), 3, '0') AS pseudonym FROM u""")
def pseudonymize_email(spark, sf_dir):
    return X.pseudonyms(table(spark, sf_dir, "documents"), "doc_id", "text", X.EMAIL, "EMAIL")


@twin(r"""WITH a AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'))) AS address FROM documents),
  o AS (SELECT *, CAST(split_part(address, '.', 1) AS BIGINT) AS a1, CAST(split_part(address, '.', 2) AS BIGINT) AS a2, CAST(split_part(address, '.', 3) AS BIGINT) AS a3, CAST(split_part(address, '.', 4) AS BIGINT) AS a4 FROM a),
  v AS (SELECT *, CASE WHEN GREATEST(a1, a2, a3, a4) <= 255 THEN ((a1 * 256 + a2) * 256 + a3) * 256 + a4 END AS number FROM o)
  SELECT doc_id, address, number, (address LIKE '10.%' OR address LIKE '192.168.%' OR address LIKE '172.16.%' OR address LIKE '192.0.2.%') AS inside_prefix,
  (a1 = 10 OR a1 = 127 OR (a1 = 172 AND a2 BETWEEN 16 AND 31) OR (a1 = 192 AND a2 = 168)) AS inside_network FROM v WHERE number IS NOT NULL""")
def ip_classify(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(X.ADDRESS), F.lit(0)))).alias("address"))
    octets = F.split("address", r"\.")
    rows = found.withColumn("number", X.address_number([octets[i] for i in range(4)])).where("number is not null")
    return rows.select("doc_id", "address", "number", X.inside_by_prefix(F.col("address")).alias("inside_prefix"), X.inside_by_network(F.col("number")).alias("inside_network"))


@twin("SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@twin(f"WITH {EV} SELECT user_id AS key, pos, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY severity DESC, t, pos) AS rank FROM ev) WHERE rank <= 15")
def context_budget(spark, sf_dir):
    return W.capped(_by_user(spark, sf_dir), "key", [F.desc("severity"), F.asc("t"), F.asc("pos")], 15).select("key", "pos", "rank")


@twin("""WITH t AS (SELECT CAST(sum(ceil(length(text) / 3.5)) AS BIGINT) AS raw_tokens, CAST(sum(CASE WHEN n_chars >= 600 THEN ceil(length(text) / 3.5) ELSE 0 END) AS BIGINT) AS kept_tokens FROM documents)
  SELECT raw_tokens, kept_tokens, round(raw_tokens / 1e6 * 5 + 2500 / 1e6 * 25, 4) AS raw_cost, round(kept_tokens / 1e6 * 5 + 2500 / 1e6 * 25, 4) AS kept_cost, round(100 * (1 - kept_tokens / raw_tokens), 4) AS reduction FROM t""")
def cost_model(spark, sf_dir):
    tokens = X.token_estimate(F.col("text"))
    sums = table(spark, sf_dir, "documents").agg(F.sum(tokens).alias("raw_tokens"), F.sum(F.when(F.col("n_chars") >= 600, tokens).otherwise(0)).alias("kept_tokens"))
    cost = lambda c: F.round(F.col(c) / 1e6 * 5 + F.lit(2500 / 1e6 * 25), 4)
    return sums.select("raw_tokens", "kept_tokens", cost("raw_tokens").alias("raw_cost"), cost("kept_tokens").alias("kept_cost"), F.round(100 * (1 - F.col("kept_tokens") / F.col("raw_tokens")), 4).alias("reduction"))


@twin(f"""WITH {EV}, r AS (SELECT pos AS request, CASE event_type WHEN 'error' THEN 'isolate' WHEN 'purchase' THEN 'notify' WHEN 'click' THEN 'block' ELSE 'other' END AS action, CASE WHEN k % 10 = 0 THEN NULL ELSE k END AS target, user_id % 7 = 0 AS protected, severity >= 1 AS in_evidence FROM ev),
  j AS (SELECT *, CASE WHEN action NOT IN ('isolate', 'notify', 'block') THEN 'unknown_action' WHEN target IS NULL THEN 'empty_target' WHEN protected THEN 'protected_target' WHEN NOT in_evidence THEN 'not_in_evidence' END AS reason FROM r),
  p AS (SELECT request, row_number() OVER (ORDER BY request) AS place FROM j WHERE reason IS NULL)
  SELECT j.request, action, coalesce(reason, CASE WHEN place > 25 THEN 'over_limit' END, 'executed') AS outcome FROM j LEFT JOIN p USING (request)""")
def policy_gate(spark, sf_dir):
    action = F.when(F.col("event_type") == "error", "isolate").when(F.col("event_type") == "purchase", "notify").when(F.col("event_type") == "click", "block").otherwise("other")
    rows = events(spark, sf_dir).select(F.col("pos").alias("request"), action.alias("action"), F.when(F.col("k") % 10 != 0, F.col("k")).alias("target"), (F.col("user_id") % 7 == 0).alias("protected"), (F.col("severity") >= 1).alias("in_evidence"))
    return E.gate(rows, ["isolate", "notify", "block"], 25)


@twin("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_report(spark, sf_dir):
    revenue = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), revenue.alias("revenue"))


def _raw_events(spark, sf_dir):
    """The events as JSON objects of two shapes, by the parity of their id."""
    rows = events(spark, sf_dir)
    stamp = F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    nested = F.struct(F.col("pos").alias("id"), stamp.alias("@timestamp"), F.col("severity").alias("level"), F.struct(F.col("user_id").alias("name")).alias("user"), (F.col("k") * 1000).alias("sport"), F.col("event_type").alias("type"))
    flat = F.struct(F.col("pos").cast("string").alias("eventID"), F.expr("t div 1000").alias("eventTime"), F.element_at(F.array(*map(F.lit, ["info", "Low", "medium ", "HIGH", "critical"])), F.col("severity") + 1).alias("priority"), F.col("user_id").alias("account_name"), F.concat(F.lit("10.0.0."), F.col("k").cast("string")).alias("src"), F.col("event_type").alias("category"))
    return rows.select("pos", F.when(F.col("pos") % 2 == 0, F.to_json(nested)).otherwise(F.to_json(flat)).alias("raw"))


_NORMAL = f"""WITH {EV}, n AS (SELECT CAST(pos AS VARCHAR) AS event_id, CASE WHEN pos % 2 = 0 THEN t // 1000000 ELSE t // 1000 / 1000.0 END AS secs, severity, CAST(user_id AS VARCHAR) AS username, event_type,
  CASE WHEN pos % 2 = 0 AND k * 1000 <= 65535 THEN k * 1000 END AS source_port, CASE WHEN pos % 2 = 1 AND k <= 255 THEN '10.0.0.' || k END AS source_ip,
  CASE WHEN pos % 2 = 0 AND k * 1000 > 65535 THEN 'invalid_port:source_port' WHEN pos % 2 = 1 AND k > 255 THEN 'invalid_ip:source_ip' END AS issue FROM ev)"""


@twin(_NORMAL + " SELECT event_id, CAST(round(secs * 1000) AS BIGINT) AS at_ms, severity, username, event_type, source_port, source_ip, coalesce(issue, '') AS issues FROM n")
def normalize_events(spark, sf_dir):
    rows = N.normalized(_raw_events(spark, sf_dir))
    return rows.select("event_id", F.unix_millis("timestamp").alias("at_ms"), "severity", "username", "event_type", "source_port", "source_ip", F.array_join("issues", ",").alias("issues"))


@twin(_NORMAL + " SELECT issue, count(*) AS n FROM n WHERE issue IS NOT NULL GROUP BY issue")
def normalize_report(spark, sf_dir):
    return N.report(N.normalized(_raw_events(spark, sf_dir)))


def _signature_rows(spark, sf_dir):
    """The events as log-ins, flows, key creations and opened port ranges, by their type."""
    kind, k = F.col("event_type"), F.col("k")
    api = F.when(kind == "error", "ConsoleLogin").when(kind == "signup", "CreateAccessKey").when(kind == "purchase", "AuthorizeSecurityGroupIngress").when(kind == "view", "DeleteTrail")
    opened = F.struct(F.array(F.struct(F.lit("0.0.0.0/0").alias("cidrIp"), F.lit("tcp").alias("ipProtocol"), k.alias("fromPort"), (k + 5).alias("toPort"))).alias("ipPermissions"))
    return events(spark, sf_dir).select(
        F.col("pos").cast("string").alias("event_id"), F.when(kind == "click", "network").otherwise("cloud").alias("category"), api.alias("api"), F.lit("success").alias("outcome"),
        (F.col("value") > 50).alias("mfa"), F.col("user_id").cast("string").alias("username"), F.lit("inbound").alias("direction"), F.lit("ACCEPT").alias("flow_action"),
        F.concat(F.when(F.col("pos") % 2 == 0, "10.0.0.").otherwise("203.0.113."), k.cast("string")).alias("source_ip"), (k % 10 + 20).cast("int").alias("destination_port"),
        F.when(kind == "purchase", F.to_json(opened)).when((kind == "signup") & (k % 2 == 0), F.to_json(F.struct(F.concat(F.lit("u"), k.cast("string")).alias("userName")))).alias("params"),
    )


@twin(f"""WITH {EV}, hit AS (SELECT 'CLOUD-AUTH-001' AS rule_id, pos, 'high' AS severity, CAST(user_id AS VARCHAR) AS detail FROM ev WHERE event_type = 'error' AND NOT value > 50
  UNION ALL SELECT 'CLOUD-IAM-003', pos, 'high', 'u' || k FROM ev WHERE event_type = 'signup' AND k % 2 = 0
  UNION ALL SELECT 'CLOUD-LOG-001', pos, 'critical', 'DeleteTrail' FROM ev WHERE event_type = 'view'
  UNION ALL SELECT 'CLOUD-NET-002', pos, 'high', '203.0.113.' || k || ':' || (k % 10 + 20) FROM ev WHERE event_type = 'click' AND pos % 2 = 1 AND k % 10 IN (2, 3)
  UNION ALL SELECT 'CLOUD-NET-001', pos, 'high', string_agg(CAST(port AS VARCHAR), ', ' ORDER BY port) FROM ev JOIN (SELECT unnest([22, 23, 1433, 2375, 3306, 3389, 5432, 6379, 9200, 27017]) AS port) p ON port BETWEEN k AND k + 5 WHERE event_type = 'purchase' GROUP BY pos)
  SELECT 'alert-' || rule_id || '-' || pos AS alert_id, CAST(pos AS VARCHAR) AS event_id, rule_id, severity, detail FROM hit""")
def signature_alerts(spark, sf_dir):
    return R.alerts(_signature_rows(spark, sf_dir)).select("alert_id", "event_id", "rule_id", "severity", "detail")


@twin(f"""WITH {EV}, a AS ({twins["signature_alerts"]}), j AS (SELECT user_id, t, rule_id, a.severity, ['low', 'medium', 'high', 'critical'] AS levels FROM a JOIN ev ON CAST(ev.pos AS VARCHAR) = a.event_id)
  SELECT user_id, count(*) AS n_alerts, count(DISTINCT rule_id) AS n_rules, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, arg_max(severity, list_position(levels, severity)) AS severity, min(t) AS first_t FROM j GROUP BY user_id""")
def alert_view(spark, sf_dir):
    """Alerts of all row rules by account: rules, highest severity, first evidence."""
    rows = events(spark, sf_dir).select(F.col("pos").cast("string").alias("event_id"), "user_id", "t")
    found = R.alerts(_signature_rows(spark, sf_dir))
    rank = F.array_position(F.array(*map(F.lit, E.SEVERITY_POINTS)), F.col("severity"))
    return found.join(rows, "event_id").groupBy("user_id").agg(
        F.count("*").alias("n_alerts"), F.countDistinct("rule_id").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.max_by("severity", rank).alias("severity"), F.min("t").alias("first_t"),
    )


@twin(f"""WITH RECURSIVE {_INCIDENTS}, held AS (SELECT DISTINCT pos, incident FROM cited JOIN owner ON alert = node), a AS ({twins["signature_alerts"]}),
  j AS (SELECT user_id, t, rule_id, a.severity, ['low', 'medium', 'high', 'critical'] AS levels, incident FROM a JOIN ev ON CAST(ev.pos AS VARCHAR) = a.event_id LEFT JOIN held ON held.pos = ev.pos),
  g AS (SELECT user_id, count(*) AS n_alerts, count(DISTINCT rule_id) AS n_rules, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules, arg_max(severity, list_position(levels, severity)) AS severity,
    min(t) AS first_t, string_agg(DISTINCT CAST(incident AS VARCHAR), ',' ORDER BY CAST(incident AS VARCHAR)) AS incidents FROM j GROUP BY user_id)
  SELECT * REPLACE (coalesce(incidents, '') AS incidents) FROM g""")
def account_alerts(spark, sf_dir):
    """Alerts of all row rules by account: rules, highest severity, first evidence, incidents that cite the evidence."""
    rows = events(spark, sf_dir).select("pos", F.col("pos").cast("string").alias("event_id"), "user_id", "t")
    found = R.alerts(_signature_rows(spark, sf_dir))
    alerts = _alerts(spark, sf_dir)
    # Alerts that cite an event are linked by it, so an event has one incident at most.
    owners = E.owned(alerts, E.connecting_links(alerts)).select(F.explode("keys").alias("pos"), "incident").distinct()
    rank = F.array_position(F.array(*map(F.lit, E.SEVERITY_POINTS)), F.col("severity"))
    return found.join(rows, "event_id").join(owners, "pos", "left").groupBy("user_id").agg(
        F.count("*").alias("n_alerts"), F.countDistinct("rule_id").alias("n_rules"), F.array_join(F.array_sort(F.collect_set("rule_id")), ",").alias("rules"), F.max_by("severity", rank).alias("severity"), F.min("t").alias("first_t"),
        F.array_join(F.array_sort(F.collect_set(F.col("incident").cast("string"))), ",").alias("incidents"),
    )


def _labelled(spark, sf_dir):
    """The labelled documents with text statistics and class-balancing weights."""
    text = F.col("text")
    ratio = lambda p: (F.length(text) - F.length(F.regexp_replace(text, p, ""))) / F.greatest(F.length(text), F.lit(1))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", F.col("quality").alias("label"), F.log1p(F.length(text)).alias("size"), ratio("[#*$%&|]").alias("symbols"), ratio(r"\p{Lu}").alias("capitals"), ratio("!").alias("marks")).na.fill(0.0, M.FEATURES)
    return M.balanced(rows)


@twin()
def ml_logistic(spark, sf_dir):
    """Logistic regression of the quality label on text statistics; scores of all labelled documents."""
    return M.scored(M.fit(_labelled(spark, sf_dir), "logistic"), _labelled(spark, sf_dir))


@twin()
def ml_tree(spark, sf_dir):
    return M.scored(M.fit(_labelled(spark, sf_dir), "tree"), _labelled(spark, sf_dir))


@twin()
def ml_forest(spark, sf_dir):
    return M.scored(M.fit(_labelled(spark, sf_dir), "forest"), _labelled(spark, sf_dir))


@twin()
def ml_boosted(spark, sf_dir):
    return M.scored(M.fit(_labelled(spark, sf_dir), "boosted"), _labelled(spark, sf_dir))


@twin()
def ml_importance(spark, sf_dir):
    """Weight of each feature in the forest and in the regression."""
    rows = _labelled(spark, sf_dir)
    forest, line = M.importance(M.fit(rows, "forest")), M.importance(M.fit(rows, "logistic"))
    return spark.createDataFrame([(f, forest[f], line[f]) for f in M.FEATURES], "feature string, forest double, logistic double")


#: Columns of rows by n = k % 20 that make every row rule fire in each of its ways, or miss by a little.
_PROBES = {
    "category": {"process": (0, 1, 2), "dns": (3, 4), "other": (5,), "cloud": (6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17), "network": (15,), "alert": (18, 19)},
    "api": {"GetUser": (6,), "ConsoleLogin": (7, 8), "AssumeRole": (9,), "AttachRolePolicy": (10,), "PutUserPolicy": (11,), "CreatePolicyVersion": (12,), "CreateAccessKey": (13,), "AuthorizeSecurityGroupIngress": (14,), "DeleteTrail": (16,), "UpdateTrail": (17,)},
    "process": {"C:\\PowerShell.exe": (0, 1), "CMD.EXE": (2,)}, "parent_process": {"WinWord.exe": (2,)}, "identity_type": {"Root": (6,), "AssumedRole": (9,)}, "direction": {"inbound": (15,)}, "flow_action": {"ACCEPT": (15,)}, "vendor": {"aws-guardduty": (18, 19)},
}
_PROBE_TEXTS = {
    "command_line": "CASE n WHEN 0 THEN 'powershell -NoP -W Hidden IEX ' || k WHEN 1 THEN 'x -Enc QUJDREVGR0hJSktM' || k END", "domain": "CASE n WHEN 3 THEN 'a8f3k2m9x7q1z5' || k || '.example' WHEN 4 THEN 'aaaaaaaaaaaaaa.example' END", "raw": "CASE n WHEN 5 THEN 'read LSASS memory of ' || k END",
    "outcome": "CASE n WHEN 17 THEN 'failure' ELSE 'success' END", "username": "'User' || user_id", "mfa": "CASE n WHEN 7 THEN false END", "principal_arn": "CASE n WHEN 9 THEN 'arn:aws:iam::111:user/a' END", "source_ip": "CASE n WHEN 9 THEN '8.8.8.8' WHEN 15 THEN CASE WHEN user_id % 2 = 0 THEN '192.168.1.1' ELSE '203.0.113.9' END END",
    "destination_port": "CASE n WHEN 15 THEN 22 END", "finding_severity": "CASE n WHEN 18 THEN 7 + user_id % 3 WHEN 19 THEN 6.9 END", "finding_type": "CASE n WHEN 18 THEN 'kind ' || k END",
    "params": """CASE n WHEN 9 THEN '{"roleArn":"arn:aws:iam::222:role/b"}' WHEN 10 THEN '{"policyArn":"arn:aws:iam::aws:policy/AdministratorAccess"}' WHEN 11 THEN '{"policyDocument":"{broken"}' WHEN 12 THEN '{"policyDocument":"{broken"}' WHEN 13 THEN '{"userName":"u' || k || '"}' WHEN 14 THEN '{"ipPermissions":[{"cidrIpv6":"::/0","ipProtocol":"-1"}]}' END""",
}


@twin(f"""WITH {EV}, p AS (SELECT *, k % 20 AS n FROM ev), hit AS (SELECT pos, CASE n WHEN 0 THEN 'SOC-EXEC-001' WHEN 1 THEN 'SOC-EXEC-002' WHEN 2 THEN 'SOC-EXEC-003' WHEN 3 THEN 'SOC-DNS-001' WHEN 5 THEN 'SOC-CRED-001' WHEN 6 THEN 'CLOUD-ROOT-001' WHEN 7 THEN 'CLOUD-AUTH-001' WHEN 9 THEN 'CLOUD-IAM-001' WHEN 10 THEN 'CLOUD-IAM-002' WHEN 11 THEN 'CLOUD-IAM-002'
    WHEN 13 THEN 'CLOUD-IAM-003' WHEN 14 THEN 'CLOUD-NET-001' WHEN 15 THEN CASE WHEN user_id % 2 = 1 THEN 'CLOUD-NET-002' END WHEN 16 THEN 'CLOUD-LOG-001' WHEN 17 THEN 'CLOUD-LOG-001' WHEN 18 THEN 'CLOUD-GD-001' END AS rule_id,
  CASE n WHEN 3 THEN 'medium' WHEN 5 THEN 'critical' WHEN 9 THEN 'medium' WHEN 16 THEN 'critical' WHEN 17 THEN 'medium' WHEN 18 THEN CASE WHEN user_id % 3 = 2 THEN 'critical' ELSE 'high' END ELSE 'high' END AS severity,
  CASE n WHEN 0 THEN '-nop, -w hidden, iex ' WHEN 1 THEN 16 + length(k::VARCHAR) || ' QUJDREVGR0hJSktM' WHEN 2 THEN 'winword.exe > cmd.exe' WHEN 3 THEN 'a8f3k2m9x7q1z5' || k WHEN 5 THEN 'lsass' WHEN 6 THEN 'GetUser' WHEN 7 THEN 'User' || user_id WHEN 9 THEN 'cross-account, role-chaining, external-source' WHEN 10 THEN 'arn:aws:iam::aws:policy/AdministratorAccess' WHEN 11 THEN 'PutUserPolicy'
    WHEN 13 THEN 'u' || k WHEN 14 THEN 'ALL' WHEN 15 THEN '203.0.113.9:22' WHEN 16 THEN 'DeleteTrail' WHEN 17 THEN 'UpdateTrail' WHEN 18 THEN 'kind ' || k END AS detail FROM p) SELECT CAST(pos AS VARCHAR) AS event_id, rule_id, severity, detail FROM hit WHERE rule_id IS NOT NULL""")
def signature_branches(spark, sf_dir):
    """Alerts of all fourteen row rules, on rows that fire each or just miss it."""
    named = {c: F.coalesce(*[F.when(F.col("n").isin(*ns), F.lit(v)) for v, ns in values.items()]) for c, values in _PROBES.items()}
    rows = events(spark, sf_dir).withColumn("n", F.expr("k % 20")).select(F.col("pos").cast("string").alias("event_id"), *[v.alias(c) for c, v in named.items()], *[F.expr(x).alias(c) for c, x in _PROBE_TEXTS.items()])
    return R.alerts(rows).select("event_id", "rule_id", "severity", "detail")
