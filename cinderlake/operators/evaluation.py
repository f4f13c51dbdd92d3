"""Selections against labels: counts, stages with what they miss, and an attack path that refuses stale audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.operators.segments import merged, swept
from cinderlake.plans.stored import materialize

#: Ids of a stage are listed as ranges inside buckets of so many neighbouring numbers first.
BUCKET = 1 << 20


def judged(selected: DataFrame, inputs: DataFrame, truth: DataFrame) -> DataFrame:
    """(n, chosen, present, related, critical, stage): every number of inputs(n), selected(n) or truth(n, related, stage, critical).

    Labels are unique by n; numbers without a label are unrelated. Repeated inputs and selections count once."""
    mark = lambda rows, name: rows.select("n").distinct().withColumn(name, F.lit(True))
    both = mark(inputs, "present").join(mark(selected, "chosen"), "n", "full").join(truth, "n", "full")
    flag = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return both.select("n", flag("chosen"), flag("present"), flag("related"), flag("critical"), F.coalesce("stage", F.lit("?")).alias("stage"))


def metrics(rows: DataFrame) -> DataFrame:
    """One row of judged(): events, selected, tp, fp, fn, tn, precision, recall, f1, critical_total, critical_retained,
    critical_recall, absent (labels without an input). What is undefined is null. tn = events - tp - fp - fn."""
    c = F.count_if
    chosen, related, critical = F.col("chosen"), F.col("related"), F.col("related") & F.col("critical")
    out = rows.agg(c("present").alias("events"), c(chosen).alias("selected"), c(chosen & related).alias("tp"), c(chosen & ~related).alias("fp"), c(~chosen & related).alias("fn"), c(critical).alias("critical_total"), c(critical & chosen).alias("critical_retained"), c(related & ~F.col("present")).alias("absent"))
    out = out.withColumn("tn", F.expr("events - tp - fp - fn")).withColumns({"precision": F.expr("try_divide(tp, tp + fp)"), "recall": F.expr("try_divide(tp, tp + fn)"), "critical_recall": F.expr("try_divide(critical_retained, critical_total)")})
    out = out.withColumn("f1", F.expr("try_divide(2 * precision * recall, precision + recall)"))
    return out.withColumns({n: F.round(n, 4) for n in ("precision", "recall", "f1", "critical_recall")})


def id_ranges(ids: DataFrame, key: str, prefix: str, width: int) -> DataFrame:
    """(key, ranges, n, first): numbers of ids(key, n) as prefix-001..003, comma-joined; numbers of a run once.

    Runs are found inside buckets of numbers, then runs that touch are joined, so a key's numbers never meet in one task; its runs do."""
    rows = ids.select(key, "n").where("n is not null").distinct().withColumn("_b", F.expr(f"n div {BUCKET}"))
    place = F.row_number().over(Window.partitionBy(key, "_b").orderBy("n"))
    runs = rows.withColumn("_g", F.col("n") - place).groupBy(key, "_b", "_g").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    w = Window.partitionBy(key).orderBy("lo")
    new = F.coalesce(F.col("lo") > F.lag("hi").over(w) + 1, F.lit(True)).cast("int")
    joined = runs.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w)).groupBy(key, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    digits = lambda c: F.lpad(F.col(c).cast("string"), F.greatest(F.lit(width), F.length(F.col(c).cast("string"))), F.lit("0"))
    text = F.concat(F.lit(prefix), digits("lo"), F.when(F.col("hi") > F.col("lo"), F.concat(F.lit(".."), digits("hi"))).otherwise(""))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lo", text.alias("text")))), lambda x: x["text"]), ", ")
    return joined.groupBy(key).agg(listed.alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("n"), F.min("lo").alias("first"))


def stages(rows: DataFrame, prefix: str = "EVT-", width: int = 6) -> DataFrame:
    """(stage, events, selected, critical_missed, missed, missed_first, missed_order) of judged(): attack events by stage.

    missed are the ids that aren't selected, as ranges; missed_order numbers the stages that miss some by the first of these."""
    related = rows.where("related")
    counted = related.groupBy("stage").agg(F.count("*").alias("events"), F.count_if("chosen").alias("selected"), F.count_if(F.col("critical") & ~F.col("chosen")).alias("critical_missed"))
    lost = id_ranges(related.where("not chosen"), "stage", prefix, width).select(F.col("stage").alias("_s"), F.col("ranges").alias("missed"), F.col("first").alias("missed_first"))
    lost = lost.withColumn("missed_order", F.row_number().over(Window.orderBy("missed_first", "_s")))  # one row a stage
    return counted.join(lost, F.col("stage") == F.col("_s"), "left").drop("_s")


def attack_path(audit: DataFrame, rows: DataFrame) -> DataFrame:
    """(stage, position, attack_events, selected, missed): audit(stage, position, lo, hi, selected) against judged().

    An audit that counts other selected events than there are is stale: the query then fails and names the stage, whoever reads
    its result, as the check is a part of every row. Stages without events have zeros. Ranges are closed; a stage may have several rows."""
    parts = materialize(audit, "audit")
    hit = F.col("related") & F.col("chosen")
    ends = swept(rows, "n", merged(parts.select(F.col("stage").alias("_stage"), "lo", "hi"), "_stage"), {"attack_events": F.col("related"), "found": hit, "n": F.lit(True)}).where("_side <> 0")
    counted = ends.groupBy("_stage").agg(*[F.sum(F.col("_side") * F.col(c)).alias(c) for c in ("attack_events", "found", "n")])
    said = parts.groupBy("stage").agg(F.min("position").alias("position"), F.max("selected").alias("said"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    met = said.join(counted, F.col("stage") == F.col("_stage"), "left").withColumns({c: zero(c) for c in ("attack_events", "found", "n")})
    stale = F.concat(F.lit("attack path and audit disagree for "), "stage", F.lit("; audit again"))
    checked = F.when(F.col("found") == F.col("said"), F.col("found")).otherwise(F.raise_error(stale).cast("long"))
    return met.select("stage", "position", "attack_events", checked.alias("selected"), (F.col("n") - checked).alias("missed"))


def transitions(held: DataFrame, audit: DataFrame) -> DataFrame:
    """(stage, next, shared, in_order): entities (stage, entity) that each stage of audit(stage, position, first_t, last_t) shares with
    the next one, and whether that begins no earlier."""
    w = Window.orderBy("position")  # one row a stage
    order = audit.withColumns({"next": F.lead("stage").over(w), "began": F.lead("first_t").over(w)}).where("next is not null")
    one = held.select("stage", "entity").distinct()
    shared = order.join(one, "stage").join(one.select(F.col("stage").alias("next"), "entity"), ["next", "entity"]).groupBy("stage").agg(F.array_join(F.slice(F.array_sort(F.collect_set("entity")), 1, 8), ",").alias("shared"))
    return order.join(shared, "stage", "left").select("stage", "next", F.coalesce("shared", F.lit("")).alias("shared"), (F.col("began") >= F.col("first_t")).alias("in_order"))
