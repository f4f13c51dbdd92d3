"""Scores, ranking, evidence objects, incidents, risk and policy gates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.operators.graph import connected_components
from cinderlake.plans.buckets import DAY, bucket_of, carried, same_bucket
from cinderlake.plans.stored import materialize, numbered

#: Weights of the linear score and the selection threshold.
WEIGHTS = {
    "detection_match": 3.0,
    "shared_technique": 0.5,
    "same_user": 1.0,
    "same_host": 1.0,
    "same_source_ip": 1.0,
    "same_destination_ip": 0.5,
    "same_process": 0.5,
    "same_account": 0.25,
    "number_of_shared_entities": 0.25,
    "within_5_minutes": 1.0,
    "within_1_hour": 0.5,
    "severity": 1.0,
    "rarity": 1.0,
    "cluster_has_detection": 0.5,
}
SELECT_AT = 0.35
#: Points of a severity, score bands, evidence points by time gap.
SEVERITY_POINTS = {"informational": 0, "low": 5, "medium": 12, "high": 22, "critical": 30}
BANDS = [(80, "critical"), (60, "high"), (40, "medium"), (20, "low")]


def rounded(value: Column, digits: int = 6) -> Column:
    """A double rounded half away from zero as a double: multiplied, made whole and divided again.

    F.round goes by the shortest decimal text instead: 0.012543499999999999 becomes 0.012543 there and 0.012544 here."""
    return F.round(value * 10.0**digits) / 10.0**digits


def rule_score(features: DataFrame, order: Iterable[str] = tuple(WEIGHTS)) -> Column:
    """Clipped, weighted mean of the weighted features that the frame has, added up in the order given; missing values count as 0."""
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    scaled = lambda c: clip(c) if c != "number_of_shared_entities" else F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0)) / 4.0)
    total = sum((F.lit(w) * scaled(k) for k, w in ((k, WEIGHTS[k]) for k in order) if k in features.columns), F.lit(0.0))
    return total / sum(WEIGHTS.values())


def blend(score: Column, model: Column, weight: float = 0.5) -> Column:
    """The rule score and a model's score, the latter with the given weight."""
    return (1 - weight) * score + weight * model


def ranked(scored: DataFrame) -> DataFrame:
    """scored(pos, t, score, has_detection) with a global rank (score descending, then time, then pos) and selected."""
    out = numbered(scored, [F.desc("score"), F.asc_nulls_last("t"), F.asc("pos")], "rank")
    return out.withColumn("selected", (F.col("score") >= SELECT_AT) | F.col("has_detection"))


def evidence_objects(selected: DataFrame, keys: list[str], least: int = 3, shown: int = 5) -> DataFrame:
    """Groups of at least `least` selected rows as one aggregate each; all other rows as single objects."""
    rows = materialize(selected.select(*keys, "t", "pos"), "selected")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    # The limit on the row number holds before the shuffle too, so no group gathers its rows.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("t"), F.asc_nulls_last("pos")))
    first = rows.withColumn("place", place).where(F.col("place") <= max(shown, least)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t", "pos"))).alias("all"))
    first = first.select(*[F.col(k).alias(f"first_{k}") for k in keys], "all")
    groups = sizes.join(first, [F.col(k).eqNullSafe(F.col(f"first_{k}")) for k in keys])
    ids = lambda a: F.array_join(F.transform(F.slice(a, 1, shown), lambda x: x["pos"].cast("string")), ",")
    many = groups.where(F.col("n") >= least).select(*keys, F.lit("aggregate").alias("kind"), "n", "first_t", "last_t", ids("all").alias("ids"))
    one = groups.where(F.col("n") < least).select(*keys, F.explode("all").alias("e"))
    one = one.select(*keys, F.lit("single").alias("kind"), F.lit(1).cast("long").alias("n"), F.col("e.t").alias("first_t"), F.col("e.t").alias("last_t"), F.col("e.pos").cast("string").alias("ids"))
    return many.unionByName(one)


def alert_links(alerts: DataFrame, seconds: int = 4 * 3600) -> DataFrame:
    """(a, b): alerts that share a link key (an entity or an evidence event) and whose spans are at most so far apart.

    alerts(alert, first_t, last_t, keys array). All pairs, so for reports; connecting_links is for grouping.
    Alerts without a span have no links."""
    keyed = alerts.where("first_t is not null and last_t is not null").select("alert", "first_t", "last_t", F.explode(F.array_distinct("keys")).alias("key"))
    other = keyed.toDF("alert2", "first2", "last2", "key")
    gap = F.greatest(F.lit(0).cast("long"), F.col("first2") - F.col("last_t"), F.col("first_t") - F.col("last2"))
    return keyed.join(other, "key").where((F.col("alert") < F.col("alert2")) & (gap <= seconds * 1_000_000)).select(F.col("alert").alias("a"), F.col("alert2").alias("b")).distinct()


def connecting_links(alerts: DataFrame, seconds: int = 4 * 3600) -> DataFrame:
    """(a, b): some of the links of alert_links, enough to connect what they connect, and at most one per alert and key.

    Of a key's alerts in time order, each links with the one before that lasts longest: what any earlier one reaches,
    that one reaches. The longest of former days is carried to each day, so a hot key is many tasks."""
    keyed = alerts.where("first_t is not null and last_t is not null").select("alert", "first_t", "last_t", F.explode(F.array_distinct("keys")).alias("key")).where("key is not null")
    keyed = keyed.withColumn("bucket", bucket_of(F.col("first_t"), DAY)).withColumn("s", F.struct("last_t", "alert"))
    earlier = carried(keyed, "key", {"longest": F.max("s")}, {"earlier": (F.max("longest"), "before")})
    here = F.max("s").over(Window.partitionBy("key", "bucket").orderBy("first_t", "alert").rowsBetween(Window.unboundedPreceding, -1))
    longest = keyed.withColumn("here", here).join(earlier, same_bucket("key"), "left").withColumn("p", F.greatest("here", "earlier"))
    near = longest.where(F.col("first_t") - F.col("p.last_t") <= seconds * 1_000_000)
    return near.select(F.least("alert", "p.alert").alias("a"), F.greatest("alert", "p.alert").alias("b")).where("a < b").distinct()


def owned(alerts: DataFrame, links: DataFrame) -> DataFrame:
    """alerts with the incident of each: the smallest alert that links lead to."""
    found = connected_components(links)
    return alerts.join(found, F.col("alert") == F.col("node"), "left").withColumn("incident", F.coalesce("component", "alert")).drop("node", "component")


def incidents(alerts: DataFrame, links: DataFrame) -> DataFrame:
    """One row per group of linked alerts, named by its smallest alert, with its span and sizes."""
    return owned(alerts, links).groupBy("incident").agg(F.count("*").alias("n_alerts"), F.sum("n_events").alias("n_events"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), F.max("severity_rank").alias("severity_rank"))


def risk(incident: DataFrame) -> DataFrame:
    """Itemized score 0 to 100 and band of incident(severity_rank, n_alerts, n_events)."""
    points = F.element_at(F.array(*[F.lit(p) for p in SEVERITY_POINTS.values()]), F.col("severity_rank") + 1)
    extra = F.least(F.lit(16), 4 * (F.col("n_alerts") - 1)).cast("int")
    wide = F.when(F.col("n_events") >= 10, 10).otherwise(0)
    factors = F.array(F.struct(F.lit("severity").alias("name"), points.alias("points")), F.struct(F.lit("extra_alerts").alias("name"), extra.alias("points")), F.struct(F.lit("many_events").alias("name"), wide.alias("points")))
    kept = F.filter(factors, lambda f: f["points"] > 0)
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.aggregate(kept, F.lit(0), lambda a, f: a + f["points"])))
    out = incident.withColumn("factors", F.array_join(F.transform(kept, lambda f: F.concat_ws("=", f["name"], f["points"].cast("string"))), ";")).withColumn("score", score)
    band = F.lit("informational")
    for least, name in reversed(BANDS):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return out.withColumn("band", band)


def gate(requests: DataFrame, known: list[str], most: int) -> DataFrame:
    """First refusal reason of each request(request, action, target, protected, in_evidence), or its execution.

    At most `most` requests are executed, in the order of their ids."""
    reason = F.coalesce(
        F.when(~F.col("action").isin(known), "unknown_action"), F.when(F.col("target").isNull(), "empty_target"),
        F.when(F.col("protected"), "protected_target"), F.when(~F.col("in_evidence"), "not_in_evidence"),
    )
    judged = requests.withColumn("reason", reason)
    order = numbered(judged.where("reason is null").select("request"), [F.asc("request")], "place")
    return judged.join(order, "request", "left").select("request", "action", F.coalesce("reason", F.when(F.col("place") > most, "over_limit"), F.lit("executed")).alias("outcome"))
