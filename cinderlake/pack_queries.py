"""Queries for daily context packs and their budgets, with their SQL twins (DuckDB) that write every text anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.context_queries import _ITEMS, _items
from cinderlake.operators import analyses as A
from cinderlake.operators import context as K
from cinderlake.operators import evaluation as E
from cinderlake.operators import packs as P
from cinderlake.operators import segments as S
from cinderlake.plans.stored import materialize
from cinderlake.registry import twin
from cinderlake.sources.telemetry import TELEMETRY_SQL as SEC
from cinderlake.sources.telemetry import telemetry

DAY = 86_400_000_000
#: Token budgets of the experiment; some packs fit, lose context, then relationships, then clip texts.
BUDGETS = [100000, 4500, 3500, 2500, 1000]
_ID = "'E' || lpad(CAST(item AS STRING), CAST(GREATEST(2, length(CAST(item AS STRING))) AS INTEGER), '0')"
_JSON = {
    "item": """'{"action":"' || action || '","count":' || n || ',"id":"' || id || '","rank":' || rank || ',"role":"' || role || '"}'""", "entry": """'{"evidence_id":"' || id || '","time":' || first_t || '}'""",
    "entity": """'{"evidence_ids":[' || {refs} || '],"id":' || place || ',"value":"' || entity || '"}'""", "relationship": """'{"delta_seconds":' || delta || ',"from":"' || src || '","id":' || place || ',"to":"' || dst || '","via":"' || via || '"}'""",
    "rule": """'{"evidence_ids":[' || {refs} || '],"rule_id":"' || rule_id || '"}'""",
}


def _with(name: str, refs: str) -> str:
    return _JSON[name].replace("{refs}", refs)


_SKELETON = '{"detections":[],"entities":[],"evidence":[],"relationships":[],"timeline":[]}'


def _packs(spark, sf_dir) -> P.Packs:
    found = K.scores(_items(spark, sf_dir)).withColumn("pack", F.expr(f"first_t div {DAY}"))
    items = materialize(P.kept(found), "kept").withColumn("id", F.expr(_ID))
    items = items.withColumn("json", F.expr(_JSON["item"])).withColumn("entry", F.expr(_JSON["entry"]))
    top, named = P.entities(items)
    top = top.withColumn("json", F.expr(_with("entity", "''")))
    pairs = P.relationships(named).withColumn("json", F.expr(_JSON["relationship"]))
    cited = items.select("pack", "item", F.explode("rules").alias("entry")).withColumn("section", F.lit("detections"))
    entries = cited.select("pack", "section", "entry").distinct().withColumn("json", F.expr(_with("rule", "''").replace("rule_id ||", "entry ||")))
    return P.Packs(items, materialize(top, "top"), materialize(named.select("pack", "place", "item"), "named"), materialize(pairs, "pairs"), entries, cited, items.select("pack").distinct().withColumn("chars", F.lit(len(_SKELETON)).cast("long")))


_PACKS = _ITEMS + f""", day AS (SELECT s.*, first_t // {DAY} AS pack FROM scored s), ranked AS (SELECT *, row_number() OVER (PARTITION BY pack, role ORDER BY total DESC, first_t, item) AS p, count(*) FILTER (role <> 'context') OVER (PARTITION BY pack) AS taken FROM day),
  kp AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY total DESC, item) AS rank, {_ID.replace('STRING', 'VARCHAR')} AS id FROM ranked WHERE role <> 'context' OR p <= 15 AND p <= 60 - taken),
  k2 AS (SELECT *, CASE WHEN role = 'context' THEN row_number() OVER (PARTITION BY pack, role ORDER BY rank DESC) END AS step, {_JSON['item']} AS js, {_JSON['entry']} AS tj FROM kp),
  en AS (SELECT k2.pack, k2.item, k2.id, k2.step, k2.first_t, k2.last_t, ie.entity FROM k2 JOIN ie USING (item)), et AS (SELECT pack, entity, row_number() OVER (PARTITION BY pack ORDER BY count(*) DESC, entity) AS place FROM en GROUP BY pack, entity QUALIFY place <= 40),
  nm AS (SELECT en.*, place FROM en JOIN et USING (pack, entity)),
  fo AS (SELECT pack, item, step, last_t, entity, place, lead(item) OVER w AS dst, lead(step) OVER w AS step2, lead(first_t) OVER w AS began FROM nm WINDOW w AS (PARTITION BY pack, entity ORDER BY first_t, item)),
  re AS (SELECT pack, item AS src, dst, arg_min(entity, place) AS via, any_value(LEAST(coalesce(step, 9999), coalesce(step2, 9999))) AS dies, arg_min(CAST(trunc((began - last_t) / 1e6) AS BIGINT), place) AS delta FROM fo WHERE dst IS NOT NULL GROUP BY pack, item, dst),
  rl AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY abs(delta), src, dst) AS place FROM re QUALIFY place <= 40), rj AS (SELECT *, {_JSON['relationship']} AS js FROM rl),
  mx AS (SELECT pack, coalesce(max(step), 0) AS m, coalesce((SELECT count(*) FROM rj WHERE rj.pack = k2.pack AND dies = 9999), 0) AS n FROM k2 GROUP BY pack),
  tries AS (SELECT pack, k, 0 AS j FROM (SELECT pack, unnest(range(0, m + 1)) AS k FROM mx) UNION ALL SELECT pack, m, unnest(range(1, n + 1)) FROM mx),
  t1 AS (SELECT pack, k, j, string_agg(js, ',') AS ev, string_agg(tj, ',') AS tl, count(*) AS n_items FROM tries JOIN k2 USING (pack) WHERE step IS NULL OR step > k GROUP BY ALL),
  t2 AS (SELECT pack, k, j, string_agg({_with('entity', 'refs')}, ',') AS es, count(*) AS n_entities FROM (SELECT pack, k, j, place, entity, string_agg('"' || id || '"', ',') AS refs FROM tries JOIN nm USING (pack) WHERE step IS NULL OR step > k GROUP BY ALL) GROUP BY ALL),
  t3 AS (SELECT pack, k, j, string_agg(js, ',') AS rs, count(*) AS n_relationships FROM (SELECT *, row_number() OVER (PARTITION BY pack, k, j ORDER BY place DESC) AS tail FROM tries JOIN rj USING (pack) WHERE dies > k) WHERE tail > j GROUP BY ALL),
  t4 AS (SELECT pack, k, j, string_agg({_with('rule', 'refs')}, ',') AS ds FROM (SELECT pack, k, j, rule_id, string_agg('"' || id || '"', ',') AS refs FROM tries JOIN (SELECT DISTINCT pack, k2.item, id, step, sized.rule_id FROM k2 JOIN (SELECT item, unnest(rs) AS rule_id FROM rules) sized USING (item) ) USING (pack) WHERE step IS NULL OR step > k GROUP BY ALL) GROUP BY ALL),
  sizes AS (SELECT pack, k, j, m, n, n_items, coalesce(n_entities, 0) AS n_entities, coalesce(n_relationships, 0) AS n_relationships, length('{{"detections":[' || coalesce(ds, '') || '],"entities":[' || coalesce(es, '') || '],"evidence":[' || coalesce(ev, '') || '],"relationships":[' || coalesce(rs, '') || '],"timeline":[' || coalesce(tl, '') || ']}}') AS chars
    FROM tries LEFT JOIN t1 USING (pack, k, j) LEFT JOIN t2 USING (pack, k, j) LEFT JOIN t3 USING (pack, k, j) LEFT JOIN t4 USING (pack, k, j) JOIN mx USING (pack)),
  budgets AS (SELECT unnest({BUDGETS}) AS budget), chosen AS (SELECT budget, pack, arg_min((k, j, chars, n_items, n_entities, n_relationships, ceil(chars / 3.5) > budget), (k, j)) AS c FROM sizes, budgets WHERE ceil(chars / 3.5) <= budget OR k = m AND j = n GROUP BY budget, pack)"""
# Rules of an item: those of all events that it stands for.
_PACKS = _PACKS.replace(", day AS (", ", rules AS (SELECT it.item, list_distinct(list(g.rule_id) FILTER (g.rule_id IS NOT NULL)) AS rs FROM it JOIN sized g ON g.key = it.key_ AND coalesce(g.own, -1) = coalesce(it.own_, -1) GROUP BY it.item), day AS (", 1).replace("SELECT g.first_t, g.last_t, g.n,", "SELECT g.key AS key_, g.own AS own_, g.first_t, g.last_t, g.n,", 1)


@twin(f"WITH {_PACKS} SELECT budget, pack, c[1]::BIGINT AS cut, c[2]::BIGINT AS popped, c[3]::BIGINT AS chars, c[4]::BIGINT AS n_items, c[5]::BIGINT AS n_entities, c[6]::BIGINT AS n_relationships, c[7] AS clipped FROM chosen")
def pack_budgets(spark, sf_dir):
    """Daily packs under five token budgets: what goes, what stays and the size of the text."""
    whole, out = _packs(spark, sf_dir), None
    found = materialize(P.elements(whole, P.steps(whole.items)), "elements")
    for budget in BUDGETS:
        left, cuts = P.trimmed(whole, F.lit(budget), found)
        counts = [rows.groupBy("pack").agg(F.count("*").alias(n)) for n, rows in (("n_items", left.items), ("n_entities", left.entities), ("n_relationships", left.relationships))]
        for c in counts:
            cuts = cuts.join(c, "pack", "left")
        zero = [F.coalesce(n, F.lit(0)).alias(n) for n in ("n_items", "n_entities", "n_relationships")]
        one = cuts.select(F.lit(budget).alias("budget"), "pack", F.col("cut").cast("long").alias("cut"), "popped", "chars", *zero, "clipped")
        out = one if out is None else out.union(one)
    return out


#: A daily analyst's document for each account: sound but for one fault, by user_id % 14.
_FAULT = lambda n, bad, good: f"CASE WHEN user_id % 14 = {n} THEN {bad} ELSE {good} END"
_ANALYSIS = " || ".join([
    "'{\"incident_id\":\"' || (user_id + " + _FAULT(1, "1", "0") + ") || '\",\"summary\":\"' || " + _FAULT(2, "'The host has been isolated'", "'No action has been taken'"),
    "'\",\"evidence\":' || " + _FAULT(0, "'{}'", "'[{\"event_ids\":[\"ev-' || first || '\",\"ev-' || " + _FAULT(3, "(first - 100000)", "last") + " || '\"]}]'"),
    "',\"technique_ids\":[\"' || technique || '\"' || CASE user_id % 14 WHEN 4 THEN ',\"T9999\",\"T9999\"' WHEN 5 THEN ',\"T1003\"' ELSE '' END || '],\"confidence\":\"' || " + _FAULT(6, "'sure'", "'high'"),
    "'\",\"proposed_only\":' || " + _FAULT(7, "'false'", "'true'") + " || ',\"recommended_actions\":[{\"action\":\"' || " + _FAULT(8, "'I will block it'", "'block it'") + " || '\",\"tier\":\"T2\",\"requires_human_approval\":' || " + _FAULT(9, "'false'", "'true'"),
    "',\"response_action\":\"' || CASE user_id % 14 WHEN 10 THEN 'wipe_disk' WHEN 11 THEN 'disable_account' ELSE 'block_ip' END || '\"}],\"citations\":[{\"claim\":\"seen\",\"classification\":\"OBSERVED\",\"evidence_ids\":[\"E' || " + _FAULT(12, "(first - 100000)", "first") + " || '\",\"E' || last || 'x\"]}'",
    "',{\"claim\":\"look\",\"classification\":\"ai_recommendation\",\"evidence_ids\":' || " + _FAULT(13, "'[\"E0\"]'", "'[]'") + " || '}]}'",
])
_FIRSTS = SEC + ", who AS (SELECT user_id, min(pos) AS first, max(pos) AS last, min(technique) AS technique FROM sec WHERE seed GROUP BY user_id)"


def _analyses(spark, sf_dir):
    seeds = telemetry(spark, sf_dir).where("seed")
    who = seeds.groupBy("user_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.min("technique").alias("technique"))
    docs = who.select(F.col("user_id").alias("id"), F.col("user_id").alias("incident"), F.parse_json(F.expr(_ANALYSIS)).alias("v"))
    evidence = seeds.select(F.col("user_id").alias("incident"), F.concat(F.lit("E"), "pos").alias("evidence_id"), "event_id", "technique")
    return docs, evidence


_WRONG = {
    0: ("shape", "$.evidence", "'OBJECT<>'"), 1: ("incident_id", "$.incident_id", "CAST(user_id + 1 AS VARCHAR)"), 2: ("performed_action", "$.summary", "'1'"), 3: ("unknown_event", "$.evidence[0].event_ids[1]", "'ev-' || (first - 100000)"), 4: ("unknown_technique", "$.technique_ids[1]", "'T9999'"),
    5: ("unmapped_technique", "$.technique_ids[1]", "'T1003'"), 6: ("confidence", "$.confidence", "'sure'"), 7: ("proposed_only", "$.proposed_only", "'false'"), 8: ("performed_action", "$.recommended_actions[0].action", "'4'"), 9: ("approval", "$.recommended_actions[0].requires_human_approval", "'T2'"),
    10: ("unknown_action", "$.recommended_actions[0].response_action", "'wipe_disk'"), 11: ("tier", "$.recommended_actions[0].tier", "'T2'"), 12: ("unsupported_claim", "$.citations[0]", "'seen'"), 13: ("unsupported_claim", "$.citations[1]", "'look'"),
}


@twin(f"WITH {_FIRSTS} " + " UNION ALL ".join(f"SELECT user_id AS id, '{check}' AS \"check\", '{path}' AS path, {value} AS value FROM who WHERE user_id % 14 = {n}" for n, (check, path, value) in _WRONG.items()))
def analysis_violations(spark, sf_dir):
    """What is wrong in each account's analysis, by path: one fault of each kind."""
    docs, evidence = _analyses(spark, sf_dir)
    return A.violations(docs, evidence, evidence, evidence)


@twin(f"WITH {_FIRSTS} SELECT user_id AS id, '$.citations[0]' AS path, user_id % 14 <> 12 AS supported, CASE WHEN user_id % 14 <> 12 THEN 'ev-' || first ELSE '' END AS events, CASE WHEN user_id % 14 = 12 THEN 'E' || (first - 100000) || ',' ELSE '' END || 'E' || last || 'x' AS bad FROM who UNION ALL SELECT user_id, '$.citations[1]', user_id % 14 <> 13, '', CASE WHEN user_id % 14 = 13 THEN 'E0' ELSE '' END FROM who")
def citation_events(spark, sf_dir):
    """Citations resolved to the events behind their evidence, and whether they stand."""
    docs, evidence = _analyses(spark, sf_dir)
    return A.citations(docs, evidence).select("id", "path", "supported", F.array_join("event_ids", ",").alias("events"), F.array_join("bad", ",").alias("bad"))


#: Fourteen facts, each a set of events that must be there together.
_FACT = "CASE WHEN user_id BETWEEN 1 AND 14 AND (CASE WHEN user_id % 2 = 0 THEN seed ELSE category = 'authentication' AND severity = user_id % 4 END) THEN 'F' || lpad(CAST(user_id AS STRING), 2, '0') END"


@twin(f"""WITH {_PACKS}, facts AS (SELECT pos, {_FACT.replace('STRING', 'VARCHAR')} AS fact FROM sec), alive AS (SELECT budget, k2.item FROM chosen JOIN k2 USING (pack) WHERE step IS NULL OR step > c[1]),
  of AS (SELECT it.item, s.pos FROM it JOIN sized s ON s.key = it.key_ AND coalesce(s.own, -1) = coalesce(it.own_, -1)), got AS (SELECT DISTINCT budget, pos FROM alive JOIN of USING (item)),
  per AS (SELECT b.budget, fact, count(*) AS n_events, count(got.pos) AS n_found FROM (SELECT DISTINCT budget FROM chosen) b CROSS JOIN facts LEFT JOIN got ON got.budget = b.budget AND got.pos = facts.pos WHERE fact IS NOT NULL GROUP BY ALL)
  SELECT budget, count(*) AS n_facts, count(*) FILTER (n_events = n_found) AS n_preserved, coalesce(string_agg(fact, ',' ORDER BY fact) FILTER (n_events <> n_found), '') AS missing, round(100.0 * count(*) FILTER (n_events = n_found) / count(*), 1) AS retention_percent, round(100.0 * sum(n_found) / sum(n_events), 1) AS citation_percent FROM per GROUP BY budget""")
def fact_retention(spark, sf_dir):
    """Facts that daily packs still prove under each budget, and the share of their events that can be cited."""
    whole = _packs(spark, sf_dir)
    order = materialize(P.steps(whole.items), "steps")
    summed = P.sums(whole, materialize(P.elements(whole, order), "elements"))
    cuts = [P.trim(whole, F.lit(budget), summed=summed).select(F.lit(budget).alias("budget"), "pack", "cut") for budget in BUDGETS]
    cuts = materialize(reduce(DataFrame.union, cuts), "cuts")
    # Only items that stand for an event of a fact matter, whichever budget they stay under.
    facts = materialize(telemetry(spark, sf_dir).withColumn("fact", F.expr(_FACT)).where("fact is not null"), "facts")
    of = K.item_events(facts, whole.items).join(order.select("item", "pack", "step"), "item")
    held = of.join(cuts, "pack").where("step is null or step > cut").select("budget", "pos")
    # A budget under which no fact keeps an event has its row too.
    return S.retention(S.coverage(facts.select("fact", "pos"), held.unionByName(cuts.select("budget"), allowMissingColumns=True), "budget"), "budget")


_SEGMENTS = """SELECT user_id AS segment, 'S' || user_id % 5 AS stage, min(pos) AS lo, min(pos) + CASE WHEN user_id % 11 = 0 THEN -1 WHEN user_id % 13 = 0 THEN 1000000000000 ELSE user_id % 7 * 50 END AS hi FROM {} GROUP BY user_id"""
_RULES = {f"S{i}": f"category IN ('{a}', '{b}') OR severity >= 2" for i, (a, b) in enumerate([("cloud", "alert"), ("process", "network"), ("alert", "process"), ("network", "cloud"), ("authentication", "alert")])}
_HELD = f"WITH {SEC}, seg AS ({_SEGMENTS.format('sec')}), held AS (SELECT seg.segment, stage, pos, CASE stage " + " ".join(f"WHEN '{s}' THEN {r}" for s, r in _RULES.items()) + " END AS meets FROM seg JOIN sec ON pos BETWEEN lo AND hi)"


def _audit(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    return S.segment_audit(events.select(F.col("pos").alias("n"), "category", "severity"), spark.sql(_SEGMENTS.format("{e}"), e=events), _RULES)


@twin(f"{_HELD}, c AS (SELECT segment, count(*) AS n, count(*) FILTER (NOT meets) AS broken FROM held GROUP BY segment) SELECT segment, stage, coalesce(n, 0) AS n_events, GREATEST(hi - lo + 1, 0) - coalesce(n, 0) AS n_missing, coalesce(broken, 0) AS n_broken FROM seg LEFT JOIN c USING (segment)")
def segment_audit(spark, sf_dir):
    """Events inside each account's segment of numbers, missing ones, and those that break the rule of its stage."""
    return _audit(spark, sf_dir)[0]


@twin(f"{_HELD} SELECT pos AS n, count(*) AS n_segments FROM held GROUP BY pos HAVING count(*) > 1")
def segments_twice(spark, sf_dir):
    """Event numbers that several segments claim."""
    return _audit(spark, sf_dir)[1]


#: Labels of the telemetry: events of k under 20 are an attack's, in five stages; the engine selects detections and severe events.
_RELATED, _CHOSEN, _STAGE_OF = "k < 20", "seed OR severity >= 3", "'stage ' || k % 5"
_TRUTH = f"WITH {SEC}, jd AS (SELECT pos AS n, {_CHOSEN} AS chosen, {_RELATED} AS related, k < 8 AS critical, {_STAGE_OF} AS stage FROM sec)"


def _judged(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    truth = rows.where(_RELATED).select(F.col("pos").alias("n"), F.lit(True).alias("related"), F.expr("k < 8").alias("critical"), F.expr(_STAGE_OF).alias("stage"))
    absent = truth.where("n % 1000 = 0").select((-F.col("n") - 1).alias("n"), "related", "critical", F.lit("nowhere").alias("stage"))
    return E.judged(rows.where(_CHOSEN).select(F.col("pos").alias("n")), rows.select(F.col("pos").alias("n")), truth.union(absent))


_ALL = _TRUTH + ", al AS (SELECT *, true AS present FROM jd UNION ALL SELECT -n - 1, false, true, critical, 'nowhere', false FROM jd WHERE related AND n % 1000 = 0)"


@twin(f"""{_ALL}, m AS (SELECT count(*) FILTER (present) AS events, count(*) FILTER (chosen) AS selected, count(*) FILTER (chosen AND related) AS tp, count(*) FILTER (chosen AND NOT related) AS fp, count(*) FILTER (NOT chosen AND related) AS fn, count(*) FILTER (related AND critical) AS critical_total, count(*) FILTER (related AND critical AND chosen) AS critical_retained, count(*) FILTER (related AND NOT present) AS absent FROM al)
  SELECT *, events - tp - fp - fn AS tn, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(critical_retained / critical_total, 4) AS critical_recall, round(2.0 * tp / (2 * tp + fp + fn), 4) AS f1 FROM m""")
def selection_metrics(spark, sf_dir):
    """The engine's selection against labels, with labels that have no input."""
    return E.metrics(_judged(spark, sf_dir))


@twin(f"""{_ALL}, r AS (SELECT stage, n, n - row_number() OVER (PARTITION BY stage ORDER BY n) AS g FROM al WHERE related AND NOT chosen), runs AS (SELECT stage, min(n) AS lo, max(n) AS hi FROM r GROUP BY stage, g),
  tx AS (SELECT stage, min(lo) AS first, string_agg('EVT-' || lpad(CAST(lo AS VARCHAR), GREATEST(6, length(CAST(lo AS VARCHAR)))::INT, '0') || CASE WHEN hi > lo THEN '..' || lpad(CAST(hi AS VARCHAR), GREATEST(6, length(CAST(hi AS VARCHAR)))::INT, '0') ELSE '' END, ', ' ORDER BY lo) AS missed FROM runs GROUP BY stage),
  c AS (SELECT stage, count(*) AS events, count(*) FILTER (chosen) AS selected, count(*) FILTER (critical AND NOT chosen) AS critical_missed FROM al WHERE related GROUP BY stage)
  SELECT c.*, missed, first AS missed_first, row_number() OVER (ORDER BY first, stage) AS missed_order FROM c LEFT JOIN tx USING (stage)""")
def missed_stages(spark, sf_dir):
    """Attack events by stage, how many are selected, and the ranges of those that are missed."""
    return E.stages(_judged(spark, sf_dir)).withColumn("missed_order", F.col("missed_order").cast("long"))


_AUDIT = "SELECT 'path ' || user_id AS stage, user_id AS position, min(pos) AS lo, min(pos) + user_id * 3 AS hi FROM {} GROUP BY user_id"


@twin(f"{_TRUTH}, a AS ({_AUDIT.format('sec')}) SELECT a.stage, a.position, count(*) FILTER (related) AS attack_events, count(*) FILTER (related AND chosen) AS selected, count(*) - count(*) FILTER (related AND chosen) AS missed FROM a JOIN jd ON n BETWEEN lo AND hi GROUP BY a.stage, a.position")
def attack_path(spark, sf_dir):
    """Attack events of each audited range, selected and missed; the audit's own counts must agree."""
    rows = telemetry(spark, sf_dir)
    ranges = spark.sql(_AUDIT.format("{e}"), e=rows)
    # The audit counts for itself.
    ends = S.swept(rows.select("pos", "k", "seed", "severity"), "pos", ranges, {"hits": F.expr(f"({_RELATED}) AND ({_CHOSEN})")}).where("_side <> 0")
    audit = ranges.join(ends.groupBy("stage").agg(F.sum(F.col("_side") * F.col("hits")).alias("selected")), "stage", "left").fillna(0, ["selected"])
    return E.attack_path(audit, _judged(spark, sf_dir).where("present"))
