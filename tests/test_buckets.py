"""Window operators in time buckets say what brute force says, over ties, nulls, bucket edges and one hot key."""

import random

from cinderlake.operators import evidence, graph, joins, windows

SECOND = 1_000_000


def timed(seed, n=400):
    """Rows (key, t, pos, d): most of one key; times within a few buckets of a 10 s window, with ties and nulls."""
    rng = random.Random(seed)
    at = lambda: rng.choice([rng.randrange(-40, 400) * SECOND, rng.randrange(-40, 400) * SECOND + rng.randrange(3), 80 * SECOND, 80 * SECOND - 1, None])
    return [("hot" if rng.random() < 0.7 else rng.choice("abcde"), at(), i, rng.choice([None, *range(6)])) for i in range(n)]


def test_thresholds_and_bursts(spark):
    span = 10 * SECOND
    for seed, n in ((1, 4), (2, 6), (3, 9)):
        rows = timed(seed)
        df = spark.createDataFrame(rows, "key string, t long, pos long, d long").repartition(3)
        for distinct in (False, True):
            want = []
            for key in {r[0] for r in rows}:
                mine = sorted((t, pos, -1 if d is None else d) for k, t, pos, d in rows if k == key and t is not None)
                for t, _, _ in mine:
                    window = [r for r in mine if t - span <= r[0] <= t]
                    kinds = {r[2] for r in window} - {-1}
                    if (len(kinds) if distinct and kinds else len(window)) >= n:
                        cited = [r for r in mine if window[0][0] <= r[0] <= window[0][0] + span]
                        want.append((key, len(cited), cited[0][0], cited[-1][0], [r[1] for r in cited]))
                        break
            got = [tuple(r) for r in windows.threshold(df, n, 10, distinct).collect()]
            assert sorted(got) == sorted(want)
        peaks = {}
        for key in {r[0] for r in rows}:
            mine = [r[1] for r in rows if r[0] == key and r[1] is not None]
            peak = max(sum(t - span <= u <= t for u in mine) for t in mine)
            if peak >= n:
                peaks[key] = (len(mine), min(mine), peak)
        assert {r.key: (r.n_events, r.first_t, r.peak) for r in windows.burst(df, n, 10).collect()} == peaks


def test_links_and_nearest(spark):
    rows = [(key, t if t is None else t * 900, pos) for key, t, pos, _ in timed(4)]
    df = spark.createDataFrame(rows, "entity string, t long, pos long")
    want, near = set(), {}
    seeds = {pos for _, _, pos in rows if pos % 9 == 0}
    for key in {r[0] for r in rows}:
        mine = sorted((t, pos) for k, t, pos in rows if k == key and t is not None)
        for i, (t, pos) in enumerate(mine):
            want |= {(key, p, pos) for u, p in mine[max(0, i - 3) : i] if t - u <= 3600 * SECOND}
            found = [(u, p) for u, p in mine if p in seeds]
            before, after = max((s for s in found if s[0] < t), default=None), min((s for s in found if s[0] >= t), default=None)
            ways = [(abs(t - s[0]), s[1]) for s in (before, after) if s]
            if pos in seeds or ways:
                near[pos] = (0, pos) if pos in seeds else min(ways)
    assert {tuple(r) for r in graph.link_edges(df).collect()} == want
    known = df.where("t is not null")
    got = joins.nearest_seed(known, known.where("pos % 9 = 0")).collect()
    assert {r.pos: (r.distance, r.ref) for r in got} == near


def test_transitions_and_chains(spark):
    rows = [(key, t if t is None else t * 1000, pos, "x" if d is None or d < 4 else None) for key, t, pos, d in timed(5)]
    rows += [(None, 1, 1000, "x"), (None, 2 * 86_400 * SECOND, 1001, "x")]
    df = spark.createDataFrame(rows, "key string, t long, pos long, d string")
    changed, runs = {}, []
    for key in {r[0] for r in rows}:
        last = ()
        for _, t, pos, d in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1], r[2])):
            changed[pos] = last not in ((), (d,))
            if last != (d,):
                runs.append([key, d, 0, pos, pos])
            runs[-1] = [key, d, runs[-1][2] + 1, min(runs[-1][3], pos), max(runs[-1][4], pos)]
            last = (d,)
    assert {r.pos: r.changed for r in windows.transitions(df, ["d"]).collect()} == changed
    assert sum(r.changed for r in windows.transitions(df, ["d"], first=True).collect()) == sum(changed.values()) + len({r[0] for r in rows})
    got = [[r.key, r.d, r.n, r.first_pos, r.last_pos] for r in windows.chain(df, "d").collect()]
    assert sorted(got, key=repr) == sorted(runs, key=repr)


def test_connecting_links(spark):
    """The few links connect the same alerts as all links do, over days, and are no more than alerts and keys."""
    rng = random.Random(6)
    rows = [(i, s, s + rng.choice([0, 600, 90_000]) * SECOND, ["hot"] if i % 3 else [f"k{i % 4}", "hot", None]) for i in range(150) for s in [rng.randrange(0, 20 * 86_400) * SECOND]]
    rows += [(200, rows[0][1], rows[0][2], ["alone"]), (201, None, None, ["hot"])]
    df = spark.createDataFrame(rows, "alert long, first_t long, last_t long, keys array<string>")
    few, every = evidence.connecting_links(df), evidence.alert_links(df)
    assert few.count() <= 2 * len(rows) and few.subtract(every).count() == 0
    group = lambda links: {r.alert: r.incident for r in evidence.owned(df, links).collect()}
    assert group(few) == group(every)
