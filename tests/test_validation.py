"""The first fault of event documents, batches read in order, annotations, and raw messages."""

import json

import pytest
from pyspark.sql import functions as F

from cinderlake.operators import validation
from cinderlake.sources import tables

SOUND = {"event_id": "e1", "timestamp": "2024-01-01T00:00:00Z", "source": "s", "category": "process", "action": "a", "outcome": "success", "severity": "low", "host": {"hostname": "h"}, "process": {"name": "p"}}
GONE = object()
#: Changes of a sound document and its first fault.
CASES = [
    ({}, None), ({"event_id": GONE, "host": GONE}, "missing required field(s): event_id, host"), ({"event_id": None}, "field 'event_id' must be a non-empty string"), ({"source": " \t"}, "field 'source' must be a non-empty string"),
    ({"action": 5}, "field 'action' must be a non-empty string"), ({"action": "x" * 4096}, None), ({"action": "x" * 4097}, "field 'action' is too long"), ({"category": "mail"}, "unknown category mail"), ({"severity": "LOW"}, "unknown severity LOW"), ({"outcome": "maybe"}, "unknown outcome maybe"),
    ({"host": "h"}, "host must be an object"), ({"host": None}, "host must be an object"), ({"host": {}}, "host must have a hostname"), ({"host": {"hostname": 0}}, "host must have a hostname"), ({"host": {"hostname": 7}}, None), ({"host": {}, "cloud": {}}, None), ({"host": GONE, "cloud": {}}, None),
    ({"user": None}, "user must be an object"), ({"user": {}}, None), ({"process": {}}, "category 'process' needs an object 'process'"), ({"process": GONE}, "category 'process' needs an object 'process'"), ({"process": [1]}, "category 'process' needs an object 'process'"),
    ({"category": "cloud", "host": GONE, "cloud": {"a": 1}}, None), ({"category": "cloud", "host": GONE}, "category 'cloud' needs an object 'cloud'"), ({"raw": 5}, "raw must be a string"), ({"raw": "r" * 4097}, "raw is too long"), ({"raw": ""}, None), ({"metadata": []}, "metadata must be an object"),
    ({"timestamp": 5}, "timestamp must be a string"), ({"timestamp": "soon"}, "timestamp is not valid"), ({"timestamp": "2024-13-01T00:00:00Z"}, "timestamp is not valid"), ({"timestamp": "2024-01-01T00:00:00"}, "timestamp must have an offset"), ({"timestamp": "2024-01-01"}, "timestamp must have an offset"),
    ({"timestamp": "2024-01-01T02:00:00.25+02:00"}, None), ({"timestamp": "2024"}, "timestamp is not valid"), ({"source": "", "category": "mail"}, "field 'source' must be a non-empty string"), ({"category": "mail", "outcome": "maybe"}, "unknown category mail"),
]


def changed(change):
    return {k: v for k, v in {**SOUND, **change}.items() if v is not GONE}


def documents(spark, docs):
    return spark.createDataFrame([(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)], "place long, j string").select("place", F.parse_json("j").alias("v"))


def test_first_faults(spark):
    docs = documents(spark, [changed(c) for c, _ in CASES] + [[1], "x", None])
    got = {r.place: r.f for r in docs.select("place", validation.first_fault().alias("f")).collect()}
    assert got == {i: w for i, w in enumerate([w for _, w in CASES] + ["event must be an object"] * 3)}


def test_batches(spark):
    docs = [changed({"event_id": i, **c}) for i, c in [("a", {}), ("b", {"severity": "?"}), ("b", {}), ("a", {}), ("b", {}), ("c", {})]] + [changed({"event_id": GONE})] * 2
    faults = {r.place: (r.event_id, r.fault) for r in validation.batch_faults(documents(spark, docs)).collect()}
    again = "duplicate event_id in batch"
    assert faults == {1: ("b", "unknown severity ?"), 3: ("a", again), 4: ("b", again), 6: (None, "missing required field(s): event_id"), 7: (None, "missing required field(s): event_id")}
    with pytest.raises(Exception, match="b: unknown severity"):
        validation.accepted(documents(spark, docs)).collect()
    assert validation.accepted(documents(spark, [docs[0], docs[2], docs[5]])).count() == 3 and validation.accepted(documents(spark, [])).count() == 0


def test_annotations(spark):
    docs = documents(spark, [changed({"notes": "n", "scenario": 5}), changed({"metadata": {"notes": "own", "x": [1, {"y": None}]}, "notes": "n", "scenario": "s"}), SOUND, changed({"metadata": 7, "notes": "n"})])
    got = [json.loads(r.m) for r in docs.orderBy("place").select(validation.annotated().alias("m")).collect()]
    assert got == [{"notes": "n"}, {"notes": "own", "x": [1, {"y": None}], "scenario": "s"}, {}, {"notes": "n"}]
    others = documents(spark, [changed({"dns": {"q": 1}, "alert": {}, "auth": "x", "other": {"z": 1}}), SOUND]).orderBy("place").select(validation.other_details().alias("o")).collect()
    assert [r.o for r in others] == [["dns"], []]


def test_pairs_of_messages(spark):
    said = {
        'a.b=1 c=x"y': {"b": "1", "c": 'x"y'}, 'k="two words" k=one': {"k": "one"}, 'q="" r="open s=1': {"q": "", "r": '"open', "s": "1"}, "[client 2001:db8::1] x=1": {"client": "2001:db8::1", "x": "1"},
        "client=a [client 1.2.3.4]": {"client": "a"}, "[client 1.2.3.4:80]": {"client": "1.2.3.4:80"}, "[client host] 9x=1 _y=2": {"x": "1", "_y": "2"}, "": {}, "a= b==c d=\u00a0e": {"b": "=c"},
    }
    rows = spark.createDataFrame([(m,) for m in said], "m string").select("m", tables.key_values(F.col("m")).alias("f"))
    assert {r.m: r.f for r in rows.collect()} == said


def test_bad_lines_have_numbers(spark, tmp_path):
    """Bad lines at the start, at the end and in later splits of files that are cut; blank lines count, and don't fault."""
    good = lambda i: json.dumps({"i": i, "pad": "x" * (i % 7)})
    first = ["{", *map(good, range(40)), "", "  ", "[1", *map(good, range(40)), "nul"]
    for name, lines in (("a", first), ("b", [good(1), ""]), ("c", ["}"])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n" * (name == "b"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 5
        found = {(r.file[-7:], r.line, r.value) for r in tables.bad_lines(spark, str(tmp_path)).collect()}
        assert found == {("a.jsonl", 1, "{"), ("a.jsonl", 44, "[1"), ("a.jsonl", 85, "nul"), ("c.jsonl", 1, "}")}
        with pytest.raises(Exception, match="a.jsonl, line 1: not JSON"):
            tables.json_records(spark, str(tmp_path), "i int").collect()
        assert [r.i for r in tables.json_records(spark, f"{tmp_path}/b.jsonl", "i int").collect()] == [1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
