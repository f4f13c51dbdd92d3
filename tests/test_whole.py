"""Queries see the whole table and say the same of small and of large groups."""

import contextlib
import io
import json
import re

from cinderlake import catalog
from cinderlake.operators import evidence, graph, windows


def events_table(spark, folder, rows):
    """rows (event_id, day of 2024, second, user, k, type) as the events table of a new folder."""
    data = [(i, f"2024-{day} 00:{s // 60:02d}:{s % 60:02d}", user, kind, 10.0, json.dumps({"k": k})) for i, day, s, user, k, kind in rows]
    df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_excluded_by_cluster(spark, tmp_path):
    """A late detection keeps its cluster from being excluded as an early one does; other events of its user are."""
    rows = [(1, "01-01", 0, 1, 1, "purchase"), (2, "01-01", 5, 1, 2, "view"), (3, "06-01", 0, 2, 3, "purchase"), (4, "06-01", 5, 2, 4, "click"),
            (5, "06-03", 0, 2, 5, "error"), (6, "06-05", 0, 3, 6, "error"), (7, "06-05", 5, 3, 6, "view")]
    found = catalog.queries()["excluded_by_cluster"](spark, events_table(spark, tmp_path, rows))
    assert {tuple(r) for r in found.collect()} == {("error", 2), ("view", 1)}


def test_account_alerts(spark, tmp_path):
    """Network rules count, an account with such alerts alone is there, and cited events name their incident."""
    rows = [(1, "01-01", 0, 1, 2, "click"), (2, "01-01", 5, 2, 22, "purchase")] + [(i, "01-02", i, 3, 50, "error") for i in (3, 4, 5)]
    found = {r.user_id: r for r in catalog.queries()["account_alerts"](spark, events_table(spark, tmp_path, rows)).collect()}
    assert {u: (r.n_alerts, r.rules, r.incidents) for u, r in found.items()} == {1: (1, "CLOUD-NET-002", ""), 2: (1, "CLOUD-NET-001", ""), 3: (3, "CLOUD-AUTH-001", "6")}


def plan_of(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("extended")
    return out.getvalue()


def test_no_task_holds_a_group(spark):
    """No window over whole groups, no list of a whole group, no global sort in one task; results stay right."""
    events = spark.createDataFrame([(i, i % 2 == 0, "a" if i < 7 else None) for i in range(10)], "pos long, seed boolean, event_type string")
    mixed = graph.composition(events, events.selectExpr("pos", "0L cluster"))
    assert {tuple(r) for r in mixed.collect()} == {(i, 0, 10, 0.5, 0.7 if i < 7 else 0.3, 1) for i in range(10)}
    assert "Window" not in plan_of(mixed)
    rows = spark.createDataFrame([("a", i, i) for i in range(50, 0, -1)] + [(None, i, 100 + i) for i in range(2)], "k string, t long, pos long")
    shown = evidence.evidence_objects(rows, ["k"])
    assert sorted((r.k or "", r.kind, r.n, r.first_t, r.last_t, r.ids) for r in shown.collect()) == [("", "single", 1, 0, 0, "100"), ("", "single", 1, 1, 1, "101"), ("a", "aggregate", 50, 1, 50, "1,2,3,4,5")]
    assert "WindowGroupLimit" in plan_of(shown)
    ids = spark.createDataFrame([(i,) for i in [*range(3, 30), 32, *range(34, 36), 40, None]], "x long")
    runs = windows.islands(ids, "x", 4)
    assert sorted(map(tuple, runs.collect())) == [(3, 29, 27), (32, 32, 1), (34, 35, 2), (40, 40, 1)]
    assert not re.search(r"windowspecdefinition\(lo", plan_of(runs))
