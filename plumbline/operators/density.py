"""Density-based clusters (DBSCAN) as grid-cell joins.

The grid cell's diagonal is ``eps``, so points of one cell are always
neighbours.  A cell with at least ``min_samples`` points is all core, and the
core points of any cell belong together, so the graph to connect is one of
cells.  Points are only compared with points of thin cells (fewer than
``min_samples`` points each), which bounds the comparisons per point.  Two
full cells are compared by bounding boxes, split until the boxes decide or
hold few points.  A cell with a third of all rows therefore costs a scan.

Neighbouring cells are found by their grid numbers up to three axes.  Beyond,
where nearly every point has a cell of its own, points are dealt to the leaves of
a tree of median cuts and compared inside them.  Only points that their own leaf
leaves undecided, and core points outside the largest cluster found so far, are
sent to other leaves.  Leaves return counts and links, never pairs of points.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline import settings
from plumbline.functions.columns import ref
from plumbline.functions.joins import spread_join
from plumbline.functions.ordering import materialise, ordered_index, stage_table

# points of one cell per join task
_SPLIT_POINTS = 50_000
# a pair of full boxes with at most this many point pairs is compared point by point
_SMALL_PAIR = 4096
# most grid axes used as join keys; with more axes cells meet by pivots
_KEY_AXES = 3
# points that a leaf should hold, and those compared with a leaf at once
_PIVOT_CELLS, _TILE_CELLS = 4000, 256
# most leaves, the points drawn by hash that the cuts are taken from, visitors of a leaf that a task takes, and points of a leaf
# that look for other leaves' clusters first
_LEAVES, _CUT_POINTS, _VISITORS, _SCOUTS = 1024, 16_384, 50_000, 64


def _gap2(a: Column, b: Column, d: int) -> Column:
    """Squared distance of two points."""
    total = F.lit(0.0)
    for j in range(d):
        total = total + (a[j] - b[j]) * (a[j] - b[j])
    return total


def _box_near2(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, d: int) -> Column:
    """Squared smallest distance of two boxes."""
    total = F.lit(0.0)
    for j in range(d):
        g = F.greatest(lo_a[j] - hi_b[j], lo_b[j] - hi_a[j], F.lit(0.0))
        total = total + g * g
    return total


def _box_far2(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column, d: int) -> Column:
    """Squared largest distance of two boxes."""
    total = F.lit(0.0)
    for j in range(d):
        g = F.greatest(hi_a[j] - lo_b[j], hi_b[j] - lo_a[j])
        total = total + g * g
    return total


def _boxes(points: DataFrame, by: Sequence[str], d: int) -> DataFrame:
    return points.groupBy(*by).agg(
        F.sum("w").alias("n"), F.count("*").alias("m"),
        F.array(*[F.min(F.col("x")[j]) for j in range(d)]).alias("lo"),
        F.array(*[F.max(F.col("x")[j]) for j in range(d)]).alias("hi"))


def _grid(points: DataFrame, side: float, d: int) -> Column:
    return F.array(*[F.floor(F.col("x")[j] / side) for j in range(d)])


def _cell_pairs(cells: DataFrame, eps: float, d: int) -> DataFrame:
    """Ordered pairs (a, b) of different non-empty cells whose boxes come within eps."""
    reach = math.isqrt(d) + 1
    steps = [s for s in itertools.product(range(-reach, reach + 1), repeat=d)
             if sum(max(abs(v) - 1, 0) ** 2 for v in s) <= d]
    near = F.explode(F.array(*[F.array(*[F.lit(int(v)).cast("bigint") for v in s]) for s in steps]))
    left = cells.select(F.col("cid").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"),
                        F.col("cell"), near.alias("step"))
    left = left.select("a", "lo_a", "hi_a", *[
        (F.col("cell")[j] + F.col("step")[j]).alias(f"k{j}") for j in range(d)])
    right = cells.select(F.col("cid").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"),
                         *[F.col("cell")[j].alias(f"k{j}") for j in range(d)])
    both = left.join(right, [f"k{j}" for j in range(d)]).where(F.col("a") != F.col("b"))
    box = [F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
    return both.where(_box_near2(*box, d) <= eps * eps).select("a", "b")


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, d)


def _cuts(sample: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """Nodes (axis, cut, node below or at the cut, node above) of median cuts; a leaf is ~number."""
    nodes: list[tuple[int, float, int, int]] = []

    def grow(some: np.ndarray, wanted: int) -> int:
        span = np.ptp(some, axis=0) if wanted > 1 and len(some) > 1 else np.zeros(1)
        axis = int(np.argmax(span))
        if not span[axis] > 0:
            grow.leaves += 1
            return ~(grow.leaves - 1)
        values = np.sort(some[:, axis])
        cut = values[(len(values) - 1) // 2]
        cut = cut if cut < values[-1] else values[np.searchsorted(values, cut) - 1]
        at, low = len(nodes), some[:, axis] <= cut
        nodes.append((axis, float(cut), 0, 0))
        nodes[at] = (axis, float(cut), grow(some[low], wanted // 2), grow(some[~low], wanted - wanted // 2))
        return at

    grow.leaves = 0
    grow(sample[np.isfinite(sample).all(axis=1)], leaves)
    return nodes


def _leaf_of(x: np.ndarray, nodes: list[tuple[int, float, int, int]]) -> np.ndarray:
    at = np.full(len(x), 0 if nodes else ~0, np.int64)
    while (inner := np.flatnonzero(at >= 0)).size:
        for node in np.unique(at[inner]):
            axis, cut, low, high = nodes[node]
            mine = inner[at[inner] == node]
            at[mine] = np.where(x[mine, axis] <= cut, low, high)
    return ~at


def _close(x: np.ndarray, y: np.ndarray, eps2: float) -> np.ndarray:
    gap2 = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        g = x[:, j][:, None] - y[:, j]
        gap2 += g * g
    return gap2 <= eps2


def _links_inside(x: np.ndarray, eps2: float) -> np.ndarray:
    """A number per point, the same for points that links inside ``x`` connect."""
    group, left, n = np.zeros(len(x), np.int64), np.arange(len(x)), 0
    while len(left):
        front, left = left[:1], left[1:]
        while len(front):
            group[front[:_TILE_CELLS]] = n
            hit = _close(x[front[:_TILE_CELLS]], x[left], eps2).any(axis=0)
            front, left = np.concatenate([front[_TILE_CELLS:], left[hit]]), left[~hit]
        n += 1
    return group


def _visit(leaves: DataFrame, visitors: DataFrame, boxes: np.ndarray, eps: float, d: int, own: bool, fn, schema: str) -> DataFrame:
    """``fn(leaf's rows, visitors)`` for the leaves whose box comes within eps of a visitor (leaf, p, x), its own leaf only if ``own``.

    A leaf with many visitors is copied to several tasks.
    """
    spark = leaves.sparkSession
    sent = spark.sparkContext.broadcast(boxes)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, hi = sent.value[:, :d], sent.value[:, d:]
        for batch in batches:
            for at in range(0, len(batch), 2048):
                piece = batch.slice(at, 2048)
                x = _matrix(piece.column("x"), d)
                gap2 = np.zeros((len(x), len(lo)))
                for j in range(d):
                    g = np.fmax(np.fmax(lo[:, j] - x[:, j][:, None], x[:, j][:, None] - hi[:, j]), 0.0)
                    gap2 += g * g
                near = gap2 <= eps * eps
                near[np.arange(len(x)), piece.column("leaf").to_numpy()] = own
                who, to = np.nonzero(near)
                who = pa.array(who)
                yield pa.RecordBatch.from_pydict({"to": pa.array(to, pa.int64()), "v": piece.column("p").take(who), "vx": piece.column("x").take(who)})

    gone = stage_table(visitors.select("leaf", "p", "x").mapInArrow(go, "to bigint, v bigint, vx array<double>"))
    parts = gone.groupBy("to").agg(F.ceil(F.count("*") / _VISITORS).alias("parts"))  # a row per leaf
    left = leaves.join(F.broadcast(parts.withColumnRenamed("to", "leaf")), "leaf").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    right = gone.join(F.broadcast(parts), "to").withColumn("vpart", F.pmod(F.xxhash64("v"), "parts")).drop("parts")
    return left.groupBy("leaf", "part").cogroup(right.groupBy("to", "vpart")).applyInArrow(fn, schema)


def _clusters_in_leaves(spots: DataFrame, eps: float, min_samples: int, d: int) -> tuple[DataFrame, DataFrame]:
    """Rows (p, comp) of core points, and (p, comp) of the clusters around every point that is no core.

    A pair of core points of two leaves matters only if their clusters are not joined yet: after a few points of every leaf
    have joined what they touch, only core points outside the largest cluster look for the others.
    """
    eps2, spark = eps * eps, spots.sparkSession
    drawn = spots.orderBy(F.xxhash64("x")).limit(_CUT_POINTS).select("x").toArrow()  # at most _CUT_POINTS points
    wanted = max(1, min(_LEAVES, math.ceil(spots.count() / _PIVOT_CELLS)))
    nodes = spark.sparkContext.broadcast(_cuts(_matrix(drawn.column("x"), d), wanted))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = pa.array(_leaf_of(_matrix(batch.column("x"), d), nodes.value), pa.int64())
            yield pa.RecordBatch.from_arrays([leaf, *batch.columns], names=["leaf", *batch.schema.names])

    def count(table: pa.Table) -> pa.Table:
        x, w = _matrix(table.column("x"), d), table.column("w").to_numpy()
        near = np.concatenate([_close(x[a: a + _TILE_CELLS], x, eps2) @ w for a in range(0, len(x), _TILE_CELLS)])
        return table.append_column("near", pa.array(near, pa.int64()))

    placed = spots.select("p", "x", "w").mapInArrow(place, "leaf bigint, p bigint, x array<double>, w bigint")
    counted = stage_table(placed.groupBy("leaf").applyInArrow(count, "leaf bigint, p bigint, x array<double>, w bigint, near bigint"))
    boxes = np.full((wanted, 2 * d), np.nan)
    boxes[:, :d], boxes[:, d:] = np.inf, -np.inf
    for row in counted.groupBy("leaf").agg(*[f(F.col("x")[j]).alias(f"{n}{j}") for n, f in (("lo", F.min), ("hi", F.max)) for j in range(d)]).collect():
        boxes[row.leaf] = [np.nan if v is None else v for v in row[1:]]  # a row per leaf

    def count_others(leaf: pa.Table, others: pa.Table) -> pa.Table:
        found = np.zeros(len(others), np.int64)
        if len(leaf) and len(others):
            x, w, v = _matrix(leaf.column("x"), d), leaf.column("w").to_numpy(), _matrix(others.column("vx"), d)
            found = np.concatenate([_close(v[a: a + _TILE_CELLS], x, eps2) @ w for a in range(0, len(v), _TILE_CELLS)])
        return pa.table({"p": others.column("v"), "more": pa.array(found, pa.int64())})

    unsure = counted.where(F.col("near") < min_samples)
    more = _visit(counted.select("leaf", "x", "w"), unsure, boxes, eps, d, False, count_others, "p bigint, more bigint")
    more = more.groupBy("p").agg(F.sum("more").alias("more"))
    judged = stage_table(counted.join(more, "p", "left").select(
        "leaf", "p", "x", (F.col("near") + F.coalesce("more", F.lit(0)) >= min_samples).alias("core")))

    def join_inside(table: pa.Table) -> pa.Table:
        p, group = table.column("p").to_numpy(), _links_inside(_matrix(table.column("x"), d), eps2)
        first = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, group, p)
        return table.select(["leaf", "p", "x"]).append_column("local", pa.array(first[group], pa.int64()))

    core = stage_table(judged.where("core").groupBy("leaf").applyInArrow(join_inside, "leaf bigint, p bigint, x array<double>, local bigint"))
    locals_ = stage_table(core.groupBy(F.col("local").alias("cid")).agg(F.count("*").alias("n")))

    def touch(leaf: pa.Table, others: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        who, which = [empty], [empty]
        if len(leaf) and len(others):
            leaf = leaf.sort_by("local")
            x, names, p, v = _matrix(leaf.column("x"), d), leaf.column("local").to_numpy(), others.column("v").to_numpy(), _matrix(others.column("vx"), d)
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
            for a in range(0, len(v), _TILE_CELLS):
                at, group = np.nonzero(np.logical_or.reduceat(_close(v[a: a + _TILE_CELLS], x, eps2), first, axis=1))
                who.append(p[a + at])
                which.append(names[first[group]])
        return pa.table({"p": np.concatenate(who), "b": np.concatenate(which)})

    def touched(visitors: DataFrame, own: bool) -> DataFrame:
        return stage_table(_visit(core.select("leaf", "x", "local"), visitors, boxes, eps, d, own, touch, "p bigint, b bigint"))

    def joined(pairs: DataFrame) -> DataFrame:
        return pairs.join(core.select("p", F.col("local").alias("a")), "p").select("a", "b").distinct()

    scouts = core.withColumn("r", F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("p")))).where(F.col("r") <= _SCOUTS)
    links = stage_table(joined(touched(scouts, False)))
    so_far = _components(locals_, links)
    largest = so_far.join(locals_, "cid").groupBy("comp").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "comp").limit(1).select("comp")
    rest = core.join(so_far.join(largest, "comp", "left_anti").select(F.col("cid").alias("local")), "local", "left_semi")
    around = touched(judged.where("not core"), True)
    comp = _components(locals_, links.unionByName(joined(touched(rest, False))))
    return (core.join(comp.withColumnRenamed("cid", "local"), "local").select("p", "comp"),
            around.join(comp.withColumnRenamed("cid", "b"), "b").select("p", "comp").distinct())


def _full_edges(points: DataFrame, pairs: DataFrame, eps: float, side: float, d: int) -> DataFrame:
    """Edges among full cells: (a, b) with a < b that hold points within eps of each other.

    ``points`` are the points of full cells.  Undecided pairs of boxes are split
    in half per axis and round; a decided cell pair drops out with all its boxes.
    """
    eps2 = eps * eps
    found, open_pairs, level = None, pairs.select("a", "b"), 0
    below: DataFrame | None = None  # undecided boxes of the round before
    while True:
        part = F.array(*[F.floor(F.col("x")[j] / (side / 2 ** level)) for j in range(d)])
        held = points.withColumn("box", part)
        boxes = _boxes(held, ["cid", "box"], d)
        up = F.transform(F.col("box"), lambda v: F.floor(v / 2))

        def sided(s: str, boxes: DataFrame = boxes, up: Column = up) -> DataFrame:
            return boxes.select(F.col("cid").alias(s), F.col("box").alias(f"box_{s}"), up.alias(f"up_{s}"),
                                F.col("m").alias(f"m_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}"))

        if below is None:
            joined = open_pairs.join(sided("a"), "a").join(sided("b"), "b")
        else:
            joined = below.join(sided("a"), ["a", "up_a"]).join(sided("b"), ["b", "up_b"])
        box = [F.col(c) for c in ("lo_a", "hi_a", "lo_b", "hi_b")]
        judged = materialise(joined.where(_box_near2(*box, d) <= eps2).select(
            "a", "b", "box_a", "box_b", (F.col("m_a") * F.col("m_b")).alias("work"),
            (_box_far2(*box, d) <= eps2).alias("touch")))
        sure = judged.where("touch").select("a", "b").distinct()
        left = judged.where("not touch").join(sure, ["a", "b"], "left_anti")
        small = left.where(F.col("work") <= _SMALL_PAIR)
        at = held.select(F.col("cid").alias("c"), F.col("box").alias("bx"), "x")
        close = (small.join(at.select(F.col("c").alias("a"), F.col("bx").alias("box_a"), F.col("x").alias("xa")), ["a", "box_a"])
                 .join(at.select(F.col("c").alias("b"), F.col("bx").alias("box_b"), F.col("x").alias("xb")), ["b", "box_b"])
                 .where(_gap2(F.col("xa"), F.col("xb"), d) <= eps2).select("a", "b"))
        edges = materialise(sure.unionByName(close).distinct())
        found = edges if found is None else found.unionByName(edges)
        below = materialise(left.where(F.col("work") > _SMALL_PAIR).join(edges, ["a", "b"], "left_anti").select(
            "a", "b", F.col("box_a").alias("up_a"), F.col("box_b").alias("up_b")))
        if below.isEmpty():
            return found
        level += 1


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (cid, comp): one representative cell per connected group.

    Each round every group joins its smallest neighbour if that is smaller,
    links are followed to their end, and edges are rewritten between the merged
    groups.  Groups and edges shrink by a factor per round, whatever the diameter.
    """
    one_way = edges.where("a <> b")
    links = stage_table(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage_table(nodes.select("cid", F.col("cid").alias("comp")))
    while not links.isEmpty():
        parent = stage_table(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")))
        while True:  # each pass doubles the length of the links followed
            above = parent.select(F.col("a").alias("up"), F.col("up").alias("top"))
            step = stage_table(parent.join(above, "up").select("a", "up", "top"))
            parent = step.select("a", F.col("top").alias("up"))
            if step.where("top <> up").isEmpty():
                break
        labels = stage_table(labels.join(parent.select(F.col("a").alias("comp"), "up"), "comp", "left").select(
            "cid", F.coalesce("up", "comp").alias("comp")))
        links = stage_table(
            links.join(parent.select("a", F.col("up").alias("ua")), "a")
            .join(parent.select(F.col("a").alias("b"), F.col("up").alias("ub")), "b")
            .where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b")).distinct())
    return labels


def density_clusters(points: DataFrame, key_cols: Sequence[str], eps: float = settings.DBSCAN_EPS,
                     min_samples: int = settings.DBSCAN_MIN_SAMPLES) -> DataFrame:
    """Points with ``cluster``: 0.. in order of each cluster's smallest core key, -1 for noise.

    A point within eps of core points of several clusters takes the lowest.
    """
    first = points.select(F.size("x").alias("d")).first()
    if first is None:
        return points.withColumn("cluster", F.lit(-1).cast("bigint"))
    d = first.d
    side = eps / math.sqrt(d) * (1 - 1e-12)
    eps2 = eps * eps
    key = F.struct(*[ref(k) for k in key_cols])

    # copies of a point are one point with a weight
    merged = points.groupBy("x").agg(F.count("*").alias("w"), F.min(key).alias("key"))
    if d > _KEY_AXES:
        spots = materialise(merged.withColumn("p", F.monotonically_increasing_id()))
        core, around = (stage_table(t) for t in _clusters_in_leaves(spots, eps, min_samples, d))
        heads = core.join(spots.select("p", "key"), "p").groupBy("comp").agg(F.min("key").alias("key")).withColumn("g", F.lit("c"))
        numbered = ordered_index(heads.select("g", "comp", "key"), "g", ["key"]).select("comp", F.col("idx").alias("cluster"))
        of_point = core.unionByName(around).join(numbered, "comp").groupBy("p").agg(F.min("cluster").alias("cluster"))
        labels = spots.select("p", "x", "w").join(of_point, "p", "left").select(
            "x", "w", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"))
        return spread_join(points, stage_table(labels), "x", "w", points.count())
    spots = materialise(merged.withColumn("cell", _grid(merged, side, d))
                        .withColumn("p", F.monotonically_increasing_id()))
    cells = materialise(_boxes(spots, ["cell"], d).withColumn("cid", F.monotonically_increasing_id()))
    pieces = F.ceil(F.col("m") / _SPLIT_POINTS)
    info = cells.select("cell", "cid", (F.col("n") >= min_samples).alias("full"), F.col("n").alias("cell_n"),
                        pieces.alias("pieces"))
    placed = materialise(spots.join(info, "cell").select(
        "p", "x", "w", "key", "cid", "full", "cell_n", F.pmod(F.col("p"), "pieces").alias("piece")))
    pairs = materialise(_cell_pairs(cells, eps, d))
    sizes = info.select("cid", "full", "pieces")

    # points of thin cells against the points of neighbouring cells, big cells in pieces
    thin = placed.where("not full")
    visits = (thin.select("p", F.col("x").alias("xp"), F.col("cid").alias("a"))
              .join(pairs, "a").join(sizes.select(F.col("cid").alias("b"), "pieces"), "b")
              .select("p", "xp", "a", "b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece")))
    others = placed.select(F.col("p").alias("q"), F.col("x").alias("xq"), F.col("w").alias("wq"),
                           F.col("full").alias("full_q"), F.col("cid").alias("b"), "piece")
    close = (visits.join(others, ["b", "piece"]).where(_gap2(F.col("xp"), F.col("xq"), d) <= eps2)
             .select("p", "a", "b", "q", "wq", "full_q"))
    around = close.groupBy("p").agg(F.sum("wq").alias("near"))
    thin_core = materialise(thin.join(around, "p", "left").where(
        F.col("cell_n") + F.coalesce("near", F.lit(0)) >= min_samples).select("p", "cid"))

    # the graph of cells that hold core points
    core_points = placed.where("full").select("p", "cid", "key").unionByName(
        placed.join(thin_core.select("p"), "p", "left_semi").select("p", "cid", "key"))
    nodes = core_points.groupBy("cid").agg(F.min("key").alias("key"))
    touching = close.join(thin_core.select("p"), "p", "left_semi")
    q_core = touching.where("full_q").select("a", "b").unionByName(
        touching.where("not full_q").join(thin_core.select(F.col("p").alias("q")), "q", "left_semi").select("a", "b"))
    full_cells = sizes.where("full").select("cid")
    full_pairs = (pairs.where("a < b").join(full_cells.select(F.col("cid").alias("a")), "a", "left_semi")
                  .join(full_cells.select(F.col("cid").alias("b")), "b", "left_semi"))
    edges = q_core.unionByName(_full_edges(placed.where("full").select("cid", "x", "w"), full_pairs, eps, side, d))
    comp = _components(nodes.select("cid"), edges)

    # clusters numbered by their smallest core key
    heads = comp.join(nodes, "cid").groupBy("comp").agg(F.min("key").alias("key")).withColumn("g", F.lit("c"))
    numbered = ordered_index(heads.select("g", "comp", "key"), "g", ["key"]).select("comp", F.col("idx").alias("cluster"))
    of_cell = materialise(comp.join(numbered, "comp").select("cid", "cluster"))

    # border points: lowest cluster among the core points around them
    core_q = close.where("full_q").select("p", F.col("b").alias("cid")).unionByName(
        close.where("not full_q").join(thin_core.select(F.col("p").alias("q")), "q", "left_semi")
        .select("p", F.col("b").alias("cid")))
    own = thin.select("p", "cid").join(thin_core.select("cid").distinct(), "cid", "left_semi")
    rest = core_q.unionByName(own.select("p", "cid")).join(thin_core.select("p"), "p", "left_anti")
    border = rest.join(of_cell, "cid").groupBy("p").agg(F.min("cluster").alias("cluster"))
    core = core_points.select("p", "cid").join(of_cell, "cid").select("p", "cluster")
    labels = placed.select("p", "x", "w").join(core.unionByName(border), "p", "left").select(
        "x", "w", F.coalesce("cluster", F.lit(-1).cast("bigint")).alias("cluster"))
    return spread_join(points, stage_table(labels), "x", "w", points.count())
