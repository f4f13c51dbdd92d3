"""Analyses of incidents as JSON documents of unknown shape: every violation with its path, and citations resolved to events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlake.functions import policy
from cinderlake.operators.correlation import TECHNIQUES

#: Tiers of the actions that can be named, tiers that need a person, levels of confidence, kinds of claims.
TIERS = {
    "isolate_host": "T2", "disable_account": "T3", "block_ip": "T2", "block_domain": "T2", "collect_artifact": "T1", "create_ticket": "T1", "notify_analyst": "T1", "revoke_access_key": "T2",
    "disable_iam_user": "T3", "detach_policy": "T2", "isolate_ec2_instance": "T2", "modify_security_group": "T2", "block_network_indicator": "T2",
}
APPROVED, CONFIDENCE, CLASSES = ["T2", "T3"], ["low", "medium", "high"], ["OBSERVED", "CORRELATED", "INFERRED", "AI_RECOMMENDATION"]
EXCERPT = 80


def text(v: Column, path: str = "$") -> Column:
    """A text inside a variant; null where it is something else."""
    inside = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(inside) == "STRING", F.try_variant_get(inside, "$", "string"))


def parts(docs: DataFrame, v: str, path: str, *keep: str) -> DataFrame:
    """(keep, path, i, e): the members of the list at a path of docs' variant v; none where there is no list."""
    held = docs.select(*keep, F.col("path").alias("_path"), F.posexplode(F.try_variant_get(v, f"$.{path}", "array<variant>")).alias("i", "e"))
    return held.select(*keep, F.concat("_path", F.lit(f".{path}["), F.col("i"), F.lit("]")).alias("path"), "i", "e")


def citations(docs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, incident, path, claim, classification, cited, bad, event_ids, supported) of each citation of docs(id, incident, v).

    evidence(incident, evidence_id, event_id) resolves ids. A claim is supported if it cites evidence of its incident, or recommends
    something and cites nothing wrong. event_ids are those of the evidence it cites and bad the ids of none, once each, in the order of citation."""
    docs = docs.withColumn("path", F.lit("$"))
    rows = parts(docs, "v", "citations", "id", "incident").drop("i")
    given = F.upper(F.coalesce(text(F.col("e"), "$.classification"), F.lit("")))
    rows = rows.withColumn("claim", F.coalesce(text(F.col("e"), "$.claim"), F.lit(""))).withColumn("classification", F.when(given.isin(CLASSES), given).otherwise("INFERRED"))
    # Numbers are ids too; other members of the list are none.
    ids = parts(rows.withColumnRenamed("path", "p").withColumn("path", F.col("p")), "e", "evidence_ids", "id", "incident", "p")
    ids = ids.select("id", "incident", "p", "i", F.when(F.schema_of_variant("e").isin("STRING", "BIGINT"), F.try_variant_get("e", "$", "string")).alias("evidence_id")).where("evidence_id is not null")
    # A citation may name much evidence and evidence stand for many events: resolved as rows, gathered per citation.
    known = evidence.select(F.col("incident").alias("_n"), F.col("evidence_id").alias("_e"), "event_id")
    met = ids.join(known, (F.col("incident") == F.col("_n")) & (F.col("evidence_id") == F.col("_e")), "left")
    met = met.withColumn("unknown", F.when(F.col("_e").isNull(), F.col("evidence_id")))
    firsts = met.groupBy("id", "p", "event_id", "unknown").agg(F.min("i").alias("i"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("i", F.col(c).alias("v"))))), lambda x: x["v"])
    found = firsts.groupBy("id", "p").agg(listed("event_id").alias("good"), listed("unknown").alias("bad"))
    out = rows.join(found.withColumnsRenamed({"id": "_id"}), (F.col("id") == F.col("_id")) & (F.col("path") == F.col("p")), "left")
    none = F.array().cast("array<string>")
    events, bad = F.coalesce("good", none), F.coalesce("bad", none)
    stands = (F.size(events) > 0) | ((F.col("classification") == "AI_RECOMMENDATION") & (F.size(bad) == 0))
    return out.select("id", "incident", "path", "claim", "classification", events.alias("event_ids"), bad.alias("bad"), stands.alias("supported"))


def violations(docs: DataFrame, events: DataFrame, techniques: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, check, path, value): what is wrong in docs(id, incident, v), v being an analysis of the incident.

    events(incident, event_id) and techniques(incident, technique) are what the engine found, evidence as in citations(). The
    checks: shape (a list, text or boolean that is something else), incident_id, unknown_event, unknown_technique (once each),
    unmapped_technique, unsupported_claim, performed_action (value: the claim's pattern number), confidence, proposed_only, approval,
    unknown_action, tier. Missing lists are empty; a missing confidence or a proposed_only other than true is wrong.
    A document that is null or no object has a shape error alone."""
    kind = F.schema_of_variant("v")
    broken = docs.where(F.coalesce(~kind.startswith("OBJECT"), F.lit(True)))
    docs = docs.where(kind.startswith("OBJECT")).withColumn("path", F.lit("$"))
    say = lambda rows, check, value, path=F.col("path"): rows.select("id", F.lit(check).alias("check"), path.alias("path"), value.cast("string").alias("value"))
    at = lambda rows, name: rows.withColumn("path", F.concat("path", F.lit(f".{name}")))
    v, e = F.col("v"), F.col("e")
    out = [say(broken, "shape", F.coalesce(kind, F.lit("missing")), F.lit("$"))]

    def shape(rows: DataFrame, column: str, name: str, wanted: str) -> None:
        """Remember values of another kind than wanted; absent and null ones are none."""
        held = F.schema_of_variant(F.try_variant_get(column, f"$.{name}", "variant"))
        other = rows.where(held.isNotNull() & (held != "VOID") & ~held.startswith(wanted))
        out.append(say(at(other, name), "shape", held))

    for name in ("evidence", "technique_ids", "recommended_actions", "citations"):
        shape(docs, "v", name, "ARRAY")
    for name in ("incident_id", "summary", "confidence"):
        shape(docs, "v", name, "STRING")
    out.append(say(at(docs.where(~text(v, "$.incident_id").eqNullSafe(F.col("incident").cast("string"))), "incident_id"), "incident_id", text(v, "$.incident_id")))
    out.append(say(at(docs.where(~F.coalesce(text(v, "$.confidence").isin(CONFIDENCE), F.lit(False))), "confidence"), "confidence", text(v, "$.confidence")))
    out.append(say(at(docs.where(~F.coalesce(F.try_variant_get(v, "$.proposed_only", "boolean"), F.lit(False))), "proposed_only"), "proposed_only", F.to_json(F.try_variant_get(v, "$.proposed_only", "variant"))))

    cited = parts(docs, "v", "evidence", "id", "incident")
    shape(cited, "e", "event_ids", "ARRAY")
    ids = parts(cited, "e", "event_ids", "id", "incident").withColumn("event_id", F.try_variant_get("e", "$", "string"))
    out.append(say(ids.join(events.select("incident", "event_id").distinct(), ["incident", "event_id"], "left_anti"), "unknown_event", F.col("event_id")))

    named = parts(docs, "v", "technique_ids", "id", "incident").withColumn("technique", F.try_variant_get("e", "$", "string"))
    known = F.coalesce(F.col("technique").isin(list(TECHNIQUES)), F.lit(False))
    once = named.where(~known).groupBy("id", "technique").agg(F.min_by("path", "i").alias("path"))
    out.append(say(once, "unknown_technique", F.col("technique")))
    out.append(say(named.where(known).join(techniques.select("incident", "technique").distinct(), ["incident", "technique"], "left_anti"), "unmapped_technique", F.col("technique")))

    claims = citations(docs, evidence)
    out.append(say(claims.where(~F.col("supported")), "unsupported_claim", F.substring("claim", 1, EXCERPT)))

    actions = parts(docs, "v", "recommended_actions", "id", "incident")
    for name in ("action", "tier", "response_action"):
        shape(actions, "e", name, "STRING")
    surfaces = [at(docs, "summary").select("id", "path", text(v, "$.summary").alias("said")), at(actions, "action").select("id", "path", text(e, "$.action").alias("said")), at(claims, "claim").select("id", "path", F.col("claim").alias("said"))]
    made = reduce(DataFrame.union, surfaces).select("id", "path", F.explode(policy.claims(F.col("said"))).alias("pattern"))
    out.append(say(made, "performed_action", F.col("pattern")))

    tier, enum = text(e, "$.tier"), text(e, "$.response_action")
    approved = F.coalesce(F.try_variant_get(e, "$.requires_human_approval", "boolean"), F.lit(False))
    out.append(say(at(actions.where(tier.isin(APPROVED) & ~approved), "requires_human_approval"), "approval", tier))
    expected = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), enum)
    out.append(say(at(actions.where(enum.isNotNull() & expected.isNull()), "response_action"), "unknown_action", enum))
    out.append(say(at(actions.where(expected.isNotNull() & ~tier.eqNullSafe(expected)), "tier"), "tier", tier))
    return reduce(DataFrame.union, out)
