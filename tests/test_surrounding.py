"""Events around incidents: spans of any length, no row an hour of a span."""

import random

from cinderlake.operators import correlation as C

HOUR = 3600 * 1_000_000
EVENTS, OWNED, INCIDENTS = "pos long, t long, entities array<string>", "alert_id string, incident_id string", "incident_id string, first_t long, last_t long"


def frames(spark, events, cited, spans):
    """cited: (incident, pos, entities); every incident has one alert of its name."""
    evidence = spark.createDataFrame([(i, p, e) for i, p, e in cited], "alert_id string, pos long, entities array<string>")
    return spark.createDataFrame(events, EVENTS), spark.createDataFrame([(i, *s) for i, s in spans.items()], INCIDENTS), spark.createDataFrame([(i, i) for i in spans], OWNED), evidence


def test_a_span_of_any_length(spark):
    """More hours than an array can have."""
    end = 4_400_000_000_000_000_000
    events = [(1, 5, ["a"]), (2, end, ["a", "b"]), (3, 5, ["b"]), (4, None, ["a"]), (5, -end, None), (6, 7, [None, "a"])]
    got = C.surrounding(*frames(spark, events, [("i", 5, ["a"])], {"i": (-end, end)}))
    assert sorted(r.pos for r in got.collect()) == [1, 2, 5, 6]


def test_events_near_many_spans(spark):
    """As by brute force: spans that overlap, end and begin with events, within a day and over several, before 1970 too."""
    rnd = random.Random(4)
    time = lambda: rnd.randrange(-90, 200) * HOUR // 2
    events = [(p, time() if p % 50 else None, rnd.sample("abcdefgh", rnd.randint(0, 3))) for p in range(600)]
    spans = {f"i{k}": (t := time(), t + rnd.choice([0, 0, 3, 40]) * HOUR) for k in range(12)}
    cited = [(rnd.choice(sorted(spans)), rnd.randrange(600), rnd.sample("abcdefg", rnd.randint(1, 2))) for _ in range(15)]
    want = {p for _, p, _ in cited}
    for p, t, names in events:
        if t is not None and any(spans[i][0] - HOUR // 2 <= t <= spans[i][1] + HOUR // 2 and set(e) & set(names) for i, _, e in cited):
            want.add(p)
    got = [r.pos for r in C.surrounding(*frames(spark, events, cited, spans)).collect()]
    assert sorted(got) == sorted(want) and 100 < len(want) < 560
