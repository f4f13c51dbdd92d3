"""Selections against labels, missed ids as ranges, and attack paths that refuse a stale audit."""

import pytest

from cinderlake.operators import evaluation


def judged(spark, chosen, inputs, truth):
    numbers = lambda ns: spark.createDataFrame([(n,) for n in ns], "n long")
    return evaluation.judged(numbers(chosen), numbers(inputs), spark.createDataFrame(truth, "n long, related boolean, stage string, critical boolean"))


def test_metrics(spark):
    truth = [(1, True, "a", True), (2, True, "a", False), (3, True, None, True), (4, False, None, False), (99, True, "b", True)]
    m = evaluation.metrics(judged(spark, [1, 1, 4, 5], [*range(1, 11), 1], truth)).first()
    assert (m.events, m.selected, m.tp, m.fp, m.fn, m.tn, m.critical_total, m.critical_retained, m.absent) == (10, 3, 1, 2, 3, 4, 3, 1, 1)
    assert (m.precision, m.recall, m.f1, m.critical_recall) == (0.3333, 0.25, 0.2857, 0.3333)
    none = evaluation.metrics(judged(spark, [], [1], [])).first()
    assert none.tn == 1 and none.precision is None and none.recall is None and none.f1 is None and none.critical_recall is None


def test_missed_stages(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BUCKET", 4)
    truth = [(n, True, "late" if n > 40 else "early", n % 2 == 0) for n in [*range(1, 12), 13, 20, *range(41, 44), 1000000, 1000001]] + [(70, True, "all", False)]
    got = {r.stage: r for r in evaluation.stages(judged(spark, [5, 42, 70], range(100), truth)).collect()}
    assert (got["early"].events, got["early"].selected, got["early"].critical_missed, got["early"].missed_order) == (13, 1, 6, 1)
    assert got["early"].missed == "EVT-000001..000004, EVT-000006..000011, EVT-000013, EVT-000020"
    assert got["late"].missed == "EVT-000041, EVT-000043, EVT-1000000..1000001" and got["late"].missed_order == 2
    assert got["all"].missed is None and got["all"].missed_order is None


def test_stale_audits_are_refused(spark):
    rows = judged(spark, [2, 3, 11], range(20), [(n, True, "s", False) for n in (1, 2, 3, 12)])
    audit = lambda said: spark.createDataFrame([("first", 1, 0, 4, said), ("second", 2, 10, 12, 0), ("none", 3, 50, 60, 0)], "stage string, position int, lo long, hi long, selected long")
    path = evaluation.attack_path(audit(2), rows).orderBy("position").collect()
    assert [(r.stage, r.attack_events, r.selected, r.missed) for r in path] == [("first", 3, 2, 3), ("second", 1, 0, 3), ("none", 0, 0, 0)]
    for read in (lambda df: df.collect(), lambda df: df.select("missed").collect()):
        with pytest.raises(Exception, match="disagree for first"):
            read(evaluation.attack_path(audit(1), rows))


def test_transitions(spark):
    audit = spark.createDataFrame([("a", 1, 10, 20), ("b", 2, 5, 30), ("c", 3, 40, 50)], "stage string, position int, first_t long, last_t long")
    held = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "z"), ("c", "q"), ("b", "y"), ("b", "y")], "stage string, entity string")
    assert {tuple(r) for r in evaluation.transitions(held, audit).collect()} == {("a", "b", "x,y", False), ("b", "c", "", True)}


def test_path_makes_no_pairs(spark):
    """Ranges of a stage that overlap count a number once; numbers under 0 count too; no join of numbers with ranges."""
    rows = judged(spark, [-3, 2], range(-5, 5), [(n, True, "s", False) for n in (-3, 1, 2)])
    audit = spark.createDataFrame([("a", 1, -5, 2, 2), ("a", 1, 0, 3, 2), ("a", 1, 1, 1, 2), ("b", 2, 4, 3, 0)], "stage string, position int, lo long, hi long, selected long")
    path = evaluation.attack_path(audit, rows)
    assert sorted((r.stage, r.attack_events, r.selected, r.missed) for r in path.collect()) == [("a", 3, 2, 7), ("b", 0, 0, 0)]
    assert not hasattr(evaluation, "stabbed")
