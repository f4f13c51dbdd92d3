"""Near-duplicate vectors by the epsilon grid order join.

Unit vectors whose cosine is at least c lie within eps = sqrt(2 - 2c) of each other. They are sorted by their cells of
width eps on the leading principal dimensions (the epsilon grid order) and the sequence is cut into intervals. The
sequence is joined with itself by recursion: a pair of stretches is dropped if their bounding boxes on the leading
dimensions are provably farther apart than eps, and else falls into the pairs of its parts. Down to intervals this runs
on the boxes alone, as a join a level; below, the vectors of a pair of tiles (TILE intervals each) meet in a task, which
goes on in halves down to SUB vectors and then computes cosines. Where no leading dimension tells vectors apart, as for
directions at random, nothing can be dropped and the work grows with the square of the vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlake.llm.common import col, connected_components, join_hot, materialize, numbered

#: Principal dimensions of the grid, of the bounding boxes, rows of an interval and of a sub-interval, parts of a
#: stretch on the next level, and intervals of a tile.
GRID_DIMS, BOX_DIMS, INTERVAL, SUB, FAN, TILE = 3, 16, 2048, 256, 8, 4


def unit(rows) -> np.ndarray:
    x = np.asarray(rows, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, size: int) -> np.ndarray:
    """Eigenvectors of the second moments, largest first; only size**2 sums leave the executors."""

    def moments(batches):
        total = np.zeros((size, size))
        for batch in batches:
            u = unit(batch.column(0).to_pylist())
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["at", "value"])

    flat = np.zeros(size * size)
    for r in vectors.select("v").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():
        flat[r["at"]] = r["value"]
    _, axes = np.linalg.eigh(flat.reshape(size, size))
    return axes[:, ::-1]


def intervals(vectors: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """One row per interval of the grid order: its vectors, their numbers, and its box; `at` puts intervals in order.

    Components go as 32-bit floats where that changes none of them."""
    grid, box = min(GRID_DIMS, axes.shape[1]), min(BOX_DIMS, axes.shape[1])

    def place(batches):
        for batch in batches:
            p = unit(batch.column(1).to_pylist()) @ axes[:, :grid]
            cells = np.floor(p / eps).astype(np.int64)
            order = ((cells + 64) * (128 ** np.arange(grid - 1, -1, -1))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(order), *batch.columns], names=["cell", "rep", "v", "copies"])

    def cut(batches):
        held, at = [], TaskContext.get().partitionId() << 32

        def interval():
            _, rep, rows, copies = zip(*held)
            p = unit(rows) @ axes[:, :box]
            data = np.asarray(rows, dtype=np.float64)
            short = data.astype(np.float32)
            data = short if (short == data).all() else data
            lists = [pa.array([list(x)], k) for x, k in ((rep, pa.list_(pa.int64())), (copies, pa.list_(pa.int64())), (p.min(axis=0), pa.list_(pa.float64())), (p.max(axis=0), pa.list_(pa.float64())))]
            return pa.RecordBatch.from_arrays([pa.array([at]), *lists[:2], pa.array([data.tobytes()], pa.binary()), *lists[2:]], names=["at", "reps", "copies", "data", "lo", "hi"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                held.append(row)
                if len(held) == INTERVAL:
                    yield interval()
                    held.clear()
                    at += 1
        if held:
            yield interval()

    placed = vectors.select("rep", "v", "copies").mapInArrow(place, "cell long, rep long, v array<double>, copies long")
    ordered = placed.repartitionByRange("cell", "rep").sortWithinPartitions("cell", "rep")
    return ordered.mapInArrow(cut, "at long, reps array<long>, copies array<long>, data binary, lo array<double>, hi array<double>")


def gap2(lo_a, hi_a, lo_b, hi_b) -> float:
    """Squared distance of two boxes: below it, no two points of them lie."""
    return float((np.maximum(0, np.maximum(np.asarray(lo_a) - np.asarray(hi_b), np.asarray(lo_b) - np.asarray(hi_a))) ** 2).sum())


def components_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest connected index of each of n nodes under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def join_pair(a: np.ndarray, b: np.ndarray, same: bool, axes: np.ndarray, eps: float, least: float, weight_a: np.ndarray, weight_b: np.ndarray):
    """Weights of linked vectors for each row of a and b, and links enough to connect what is linked.

    Recursive: stretches whose boxes are farther apart than eps are skipped, others halved down to SUB rows."""
    pa_, pb = a @ axes, b @ axes
    count_a, count_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    links, shift = [], 0 if same else len(a)

    def compare(i, j, k, m):
        near = a[i:j] @ b[k:m].T >= least
        if same and i == k:
            near = np.triu(near, 1)
        r, c = np.nonzero(near)
        if len(r):
            np.add.at(count_a, i + r, weight_b[k + c])
            np.add.at(count_b, k + c, weight_a[i + r])
            nodes, at = np.unique(np.concatenate([i + r, k + c + shift]), return_inverse=True)
            label = components_of(at[: len(r)], at[len(r) :], len(nodes))
            keep = label != np.arange(len(nodes))
            links.append(np.stack([nodes[keep], nodes[label[keep]]], axis=1))

    def join(i, j, k, m):
        """Rows i to j of a with rows k to m of b; of one sequence with itself only pairs in order."""
        x, y = pa_[i:j], pb[k:m]
        if gap2(x.min(axis=0), x.max(axis=0), y.min(axis=0), y.max(axis=0)) > eps * eps:
            return
        if j - i <= SUB and m - k <= SUB:
            compare(i, j, k, m)
        elif same and i == k:
            h = (i + j) // 2
            join(i, h, i, h)
            join(i, h, h, j)
            join(h, j, h, j)
        elif j - i >= m - k:
            h = (i + j) // 2
            join(i, h, k, m)
            join(h, j, k, m)
        else:
            h = (k + m) // 2
            join(i, j, k, h)
            join(i, j, h, m)

    join(0, len(a), 0, len(b))
    return count_a, count_b, np.concatenate(links) if links else np.zeros((0, 2), dtype=np.int64)


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, ...).

    Two rows link if the cosine of their vectors is at least `least`. Vectors that are null, zero, or hold a null or
    non-finite component link with nothing: they have 0 links and are their own component. Equal vectors are joined
    as one, with their number; repeated ids count as rows of their own. component_id is the smallest id of the rows
    reachable by links; a row without id links like others, takes its component's id and has a null kept. Vectors of another length than the most
    frequent one are compared only among equal lengths. An empty table gives an empty result."""
    eps = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-9
    raw = vectors.select(col("vec_id").cast("long").alias("vec_id"), col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = raw.withColumn("v", F.when(valid, F.col("v"))).withColumn("w", F.md5(F.array_join(F.col("v").cast("array<string>"), ",")))
    classes = rows.where("v is not null").groupBy("w").agg(F.first("v").alias("v"), F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # Numbers of vectors, fixed by being written; ids may be null or repeated.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    counts, edges = [], []
    for size in [r[0] for r in classes.select(F.size("v").alias("n")).distinct().orderBy("n").collect()]:
        mine = classes.where(F.size("v") == size)
        axes = principal_axes(mine, size)
        found = _links(mine, axes, eps, least)
        counts.append(found.where("b is null").select("a", "n"))
        edges.append(found.where("b is not null").select("a", "b"))
    if not counts:
        return raw.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = _union(counts).groupBy("a").agg(F.sum("n").alias("n"))
    component = connected_components(_union(edges))
    info = classes.join(linked, classes["rep"] == linked["a"], "left").join(component, classes["rep"] == component["node"], "left")
    info = info.select("w", "low", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    info = materialize(info, "classes")
    lowest = info.groupBy("c").agg(F.min("low").alias("component_id"))
    named = materialize(join_hot(info, lowest, "c").select("w", "n_links", "component_id"), "named")
    out = join_hot(rows.select("vec_id", "w"), named, "w", how="left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("vec_id") == component_id).alias("kept"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def touching(blocks: DataFrame, eps: float, n: int, dims: int) -> DataFrame:
    """(a, b): pairs of intervals of blocks(block from 0 to n - 1, lo, hi) whose boxes may lie within eps, a <= b.

    The recursion goes from one stretch that holds all intervals down by levels of FAN parts each."""
    levels = [blocks.select("block", "lo", "hi")]
    while FAN ** (len(levels) - 1) < n:
        edge = lambda f, name: F.array(*[f(F.col(name)[i]) for i in range(dims)]).alias(name)
        levels.append(levels[-1].groupBy(F.expr(f"block div {FAN}").alias("block")).agg(edge(F.min, "lo"), edge(F.max, "hi")))
    apart = F.aggregate(F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x * x)
    pairs = levels[-1].select(F.col("block").alias("a"), F.col("block").alias("b"))
    for level in levels[-2::-1]:
        left = level.select(F.expr(f"block div {FAN}").alias("a"), F.col("block").alias("x"), "lo", "hi")
        right = level.select(F.expr(f"block div {FAN}").alias("b"), F.col("block").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        pairs = pairs.join(left, "a").join(right, "b").where((F.col("x") <= F.col("y")) & (apart <= eps * eps)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    return pairs


def _links(vectors: DataFrame, axes: np.ndarray, eps: float, least: float) -> DataFrame:
    """Rows (a, n, null): n more vectors link with a; rows (a, null, b): a and b are connected."""
    cut = materialize(intervals(vectors, axes, eps), "intervals")
    box = min(BOX_DIMS, axes.shape[1])
    order = numbered(cut.select("at"), [F.asc("at")], "block").select("at", (F.col("block") - 1).alias("block"))
    blocks = materialize(cut.join(order, "at").drop("at"), "blocks")
    pairs = touching(blocks, eps, blocks.count(), box)
    tile = lambda c: F.expr(f"{c} div {TILE}")
    wanted = pairs.select(tile("a").alias("one"), tile("b").alias("two"), F.explode(F.array("a", "b")).alias("block")).distinct()
    jobs = wanted.join(blocks.select("block", "reps", "copies", "data"), "block")
    size, lead = axes.shape[0], axes[:, :box]

    def run(table: pa.Table) -> pa.Table:
        one, two = table["one"][0].as_py(), table["two"][0].as_py()
        rows = sorted(zip(*[table[c].to_pylist() for c in ("block", "reps", "copies", "data")]))

        def side(tile):
            mine = [r for r in rows if r[0] // TILE == tile]
            parts = [np.frombuffer(d, dtype=np.float32 if len(d) == 4 * size * len(reps) else np.float64).reshape(-1, size) for _, reps, _, d in mine]
            return unit(np.concatenate(parts)), np.concatenate([r[1] for r in mine]).astype(np.int64), np.concatenate([r[2] for r in mine]).astype(np.int64)

        a, ids, wa = side(one)
        b, other, wb = (a, ids, wa) if one == two else side(two)
        ca, cb, links = join_pair(a, b, one == two, lead, eps, least, wa, wb)
        n = ca + cb if one == two else np.concatenate([ca, cb])
        ids = ids if one == two else np.concatenate([ids, other])
        hit = np.flatnonzero(n)
        none = [None] * len(links)
        return pa.table({"a": pa.array(np.concatenate([ids[hit], ids[links[:, 0]]])), "n": pa.array([*n[hit].tolist(), *none], pa.int64()), "b": pa.array([*[None] * len(hit), *ids[links[:, 1]].tolist()], pa.int64())})

    return materialize(jobs.groupBy("one", "two").applyInArrow(run, "a long, n long, b long"), "links")
