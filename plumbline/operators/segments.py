"""Segmentation: scaling, k-means, bisecting and density clusters, quality, projection.

Features travel as one array column ``x`` beside the caller's key columns.
Cluster centres, covariance and the like are small and enter plans as literals;
labels and coordinates stay distributed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import settings
from plumbline.functions.columns import nan_to_null, numeric_columns, percent, ref
from plumbline.functions.joins import spread_join
from plumbline.functions.ordering import ordered_index, stage_table
from plumbline.operators.density import density_clusters

# rounds in which candidates for starting centres are drawn from all rows, and how many a round expects per centre
START_ROUNDS, START_FACTOR = 5, 2
_TILE_ROWS, _TILE_BYTES = 2048, 32 << 20
# rows with the lowest draws that a round looks at; it expects START_FACTOR times k, and looks again if all of them are drawn
_DRAWS = 4096
# k-means: neighbouring points that a pass takes together, the most of one packed row, and of one partition
_LEAF, _CHUNK_POINTS, _CHUNK_BYTES, _PART_POINTS = 64, 131_072, 16 << 20, 1_000_000


def _sums_around(points: DataFrame, near: Sequence[float], crossed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per feature the values held and their sum around ``near``, and the sums of products (the squares alone unless ``crossed``).

    Batches are summed around a point close to the mean and added up in extended precision, so the error does not grow with
    the rows: near-equal variances stay equal, and with them the axes that depend on their difference.
    """
    d, at = len(near), np.array(near, dtype=np.float64)
    cells = [(i, j) for i in range(d) for j in range(i, d if crossed else i + 1)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, second = np.zeros(d), np.zeros(d, np.longdouble), np.zeros((d, d), np.longdouble)
        for batch in batches:
            if not len(batch):
                continue
            gaps = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).T - at[:, None]
            there = ~np.isnan(gaps)  # features of a point that are missing add nothing
            gaps = np.where(there, gaps, 0.0)
            held += there.sum(axis=1)
            first += gaps.sum(axis=1)
            second += gaps @ gaps.T if crossed else np.diag((gaps * gaps).sum(axis=1))
        rows = [(i, j, float(held[i]), float(first[i]), float(second[i, j])) for i, j in cells]
        yield pa.RecordBatch.from_pydict(dict(zip("ijnfs", map(list, zip(*rows)))))

    found = points.select("x").mapInArrow(sums, "i long, j long, n double, f double, s double").groupBy("i", "j").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("s").alias("s"))
    held, first, second = np.zeros(d), np.zeros(d), np.zeros((d, d))
    for r in found.collect():  # one row per pair of features
        second[r.i, r.j] = second[r.j, r.i] = r.s
        if r.i == r.j:
            held[r.i], first[r.i] = r.n, r.f
    return held, first, second


def scaled(df: DataFrame, cols: Sequence[str] | None = None, key_cols: Sequence[str] = ()) -> DataFrame:
    """Keys and ``x``: mean-imputed columns scaled to mean 0 and population std 1.

    Two aggregates, then a narrow projection; a constant column becomes 0.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    clean = nan_to_null(df.select(*[ref(c) for c in dict.fromkeys([*key_cols, *cols])]))
    row = clean.agg(F.count("*").alias("n"), *[e for i, c in enumerate(cols) for e in (
        F.avg(ref(c)).alias(f"m{i}"), (F.min(ref(c)) < F.max(ref(c))).alias(f"varies{i}"))]).first()
    near = [float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))]
    held, first, second = _sums_around(clean.select(F.array(*[ref(c).cast("double") for c in cols]).alias("x")), near, crossed=False)
    parts = []
    for i, c in enumerate(cols):
        shift = first[i] / held[i] if held[i] else 0.0
        mean = near[i] + shift
        # imputed rows sit on the mean, so they only enlarge the divisor
        std = math.sqrt(max(second[i, i] - held[i] * shift * shift, 0.0) / row["n"]) if row[f"varies{i}"] else 0.0
        x = F.coalesce(ref(c).cast("double"), F.lit(mean))
        parts.append((x - mean) / std if std > 0 else F.lit(0.0))
    return clean.select(*[ref(k) for k in key_cols], F.array(*parts).alias("x"))


def vectors(df: DataFrame, array_col: str, key_cols: Sequence[str] = ()) -> DataFrame:
    """Keys and ``x`` from a ready-made numeric array column."""
    return df.select(*[ref(k) for k in key_cols], ref(array_col).cast("array<double>").alias("x"))


def width(points: DataFrame) -> int:
    """Number of features."""
    first = points.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no points")
    return first.d


def _sq_dist(x: Column, centre: Sequence[float | Column]) -> Column:
    total = F.lit(0.0)
    for j, c in enumerate(centre):
        gap = x[j] - c
        total = total + gap * gap
    return total


# ---- k-means ----------------------------------------------------------------

def _plus_plus(sample: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spread-out starting centres: each next one drawn in proportion to its weight times squared distance."""
    centres = [sample[rng.choice(len(sample), p=weight / weight.sum())]]
    near = ((sample - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        total = (near * weight).sum()
        pick = rng.choice(len(sample), p=near * weight / total) if total > 0 else rng.integers(len(sample))
        centres.append(sample[pick])
        near = np.minimum(near, ((sample - sample[pick]) ** 2).sum(axis=1))
    return np.array(centres)


def _spots(points: DataFrame) -> DataFrame:
    """Distinct points as columns ``f0``.. and how many rows each stands for (``w``)."""
    cols = [F.col("x")[j].alias(f"f{j}") for j in range(width(points))]
    return points.select(*cols).groupBy(*[f"f{j}" for j in range(len(cols))]).agg(F.count("*").cast("double").alias("w"))


def _along_curve(spots: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Spots range-sorted along a space-filling curve (interleaved bits), packed into rows of many neighbouring points.

    The order only decides how much a pass over the points can skip, never its result.
    """
    bits = max(1, min(16, 62 // len(cols)))
    cols_used = cols[:62 // bits]
    row = spots.agg(F.count("*").alias("n"), *[e for c in cols_used for e in (F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"))]).first()
    z = F.lit(0).cast("bigint")
    for j, c in enumerate(cols_used):
        lo, span = row[f"lo_{c}"], row[f"hi_{c}"] - row[f"lo_{c}"]
        if span > 0:
            code = F.least(((F.col(c) - lo) / span * float(1 << bits)).cast("bigint"), F.lit((1 << bits) - 1))
            for t in range(bits):
                z = z.bitwiseOR(F.shiftleft(F.shiftright(code, t).bitwiseAND(F.lit(1).cast("bigint")), t * len(cols_used) + j))
    parts = max(spots.sparkSession.sparkContext.defaultParallelism, math.ceil(row.n / _PART_POINTS))
    most = max(_LEAF, min(_CHUNK_POINTS, _CHUNK_BYTES // (8 * len(cols) + 8)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def packed() -> pa.RecordBatch:
            table = np.concatenate(held, axis=1)
            return pa.RecordBatch.from_pydict({"x": pa.array([np.ascontiguousarray(table[:-1].T).tobytes()], pa.binary()),
                                               "w": pa.array([table[-1].tobytes()], pa.binary())})

        for batch in batches:
            for at in range(0, len(batch), most):
                piece = batch.slice(at, most)
                if held and n + len(piece) > most:
                    yield packed()
                    held, n = [], 0
                held.append(np.array([piece.column(c).to_numpy() for c in (*cols, "w")]))
                n += len(piece)
        if n:
            yield packed()

    return (spots.withColumn("z", z).repartitionByRange(parts, "z", *cols).sortWithinPartitions("z", *cols)
            .select(*cols, "w").mapInArrow(pack, "x binary, w binary"))


def _one_round(chunks: DataFrame, runs: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Move the centres of every run once, in one pass over the data.

    A box of neighbouring points that lies on one centre's side of all bisectors goes to that centre by its sums; points
    of other boxes are compared one by one.  Tasks return one sum per (run, centre); returns new centres and the cost of
    the old ones.
    """
    d = runs[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), d + 2)) for c in runs]

        def add(into: np.ndarray, near: np.ndarray, w: np.ndarray, cost: np.ndarray, wx: np.ndarray) -> None:
            into[:, 0] += np.bincount(near, weights=w, minlength=len(into))
            into[:, 1] += np.bincount(near, weights=cost, minlength=len(into))
            for j in range(d):
                into[:, j + 2] += np.bincount(near, weights=wx[:, j], minlength=len(into))

        for px, pw in ((a.as_py(), b.as_py()) for batch in batches for a, b in zip(batch.column("x"), batch.column("w"))):
            x, w = np.frombuffer(px).reshape(-1, d), np.frombuffer(pw)
            starts = np.arange(0, len(x), _LEAF)
            lo, hi = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
            mid = (lo + hi) / 2
            norm, wx, gap = (x * x).sum(axis=1), x * w[:, None], x - np.repeat(mid, _LEAF, axis=0)[:len(x)]
            box_w, box_x, box_gap = (np.add.reduceat(v, starts) for v in (w, wx, gap * w[:, None]))
            box_sq, reach2 = np.add.reduceat((gap * gap).sum(axis=1) * w, starts), norm.max()
            for into, c in zip(total, runs):
                c2 = (c * c).sum(axis=1)
                own = (c2 - 2.0 * (mid @ c.T)).argmin(axis=1)
                rival = np.zeros((len(starts), len(c)))  # the least that another centre is farther, anywhere in the box
                for j in range(d):
                    turn = c[:, j] - c[own, j][:, None]
                    rival += np.maximum(turn * lo[:, j, None], turn * hi[:, j, None])
                rival = c2 - c2[own][:, None] - 2.0 * rival
                rival[np.arange(len(own)), own] = np.inf
                sure = rival.min(axis=1) > 1e-12 * (reach2 + c2.max())
                if sure.any():
                    to = own[sure]
                    off = c[to] - mid[sure]
                    cost = box_sq[sure] - 2.0 * (off * box_gap[sure]).sum(axis=1) + (off * off).sum(axis=1) * box_w[sure]
                    add(into, to, box_w[sure], np.maximum(cost, 0.0), box_x[sure])
                if not sure.all():
                    some = (np.flatnonzero(~sure)[:, None] * _LEAF + np.arange(_LEAF)).ravel()
                    some = some[some < len(x)]
                    dist = norm[some, None] - 2.0 * (x[some] @ c.T) + c2
                    near = dist.argmin(axis=1)
                    add(into, near, w[some], np.maximum(dist[np.arange(len(some)), near], 0.0) * w[some], wx[some])
        rows = [(r, i, row.tolist()) for r, t in enumerate(total) for i, row in enumerate(t) if row[0] > 0]
        yield pa.RecordBatch.from_pylist([dict(zip(("run", "centre", "sums"), r)) for r in rows], schema=shape)

    shape = pa.schema([("run", pa.int32()), ("centre", pa.int32()), ("sums", pa.list_(pa.float64()))])
    parts = chunks.mapInArrow(sums, "run int, centre int, sums array<double>")
    cells = d + 2
    found = parts.groupBy("run", "centre").agg(
        *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(cells)]).collect()
    moved, costs = [c.copy() for c in runs], [0.0] * len(runs)
    for row in found:  # one row per centre
        values = np.array([row[f"s{j}"] for j in range(cells)])
        moved[row.run][row.centre] = values[2:] / values[0]  # a centre that lost all points stays
        costs[row.run] += values[1]
    return moved, costs


def _nearest(x: np.ndarray, centres: Sequence[Sequence[float]]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point, the first of equal ones, and its squared distance."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for i, c in enumerate(centres):
        gap = np.zeros(len(x))
        for j, v in enumerate(c):
            gap += (x[:, j] - v) ** 2
        closer = gap < best
        best[closer], at[closer] = gap[closer], i
    return at, best


def _lowest_draws(spots: DataFrame, cols: Sequence[str], found: list[list[float]], draw: Column,
                  most: int) -> tuple[float, list[tuple[float, float, list[float]]]]:
    """Weighted squared distance of all spots from ``found``, and the ``most`` (draw, own share, point) with lowest draw / share."""
    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, held = 0.0, np.zeros((0, len(cols) + 2))
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in cols], axis=1)
            u, d = batch.column("u").to_numpy(), batch.column("w").to_numpy() * _nearest(x, found)[1]
            cost += float(d.sum())
            some = d > 0
            held = np.concatenate([held, np.column_stack([u, d, x])[some]])
            if len(held) > most:
                held = held[np.argpartition(held[:, 0] / held[:, 1], most)[:most]]
        yield pa.RecordBatch.from_pydict({"cost": pa.array([cost, *[0.0] * len(held)]), "ratio": pa.array([None, *(held[:, 0] / held[:, 1]).tolist()], pa.float64()),
                                          "row": pa.array([None, *held.tolist()], pa.list_(pa.float64()))})

    parts = spots.withColumn("u", draw).mapInArrow(lowest, "cost double, ratio double, row array<double>").persist()
    try:
        cost = parts.agg(F.sum("cost")).first()[0] or 0.0
        rows = parts.where("ratio is not null").orderBy("ratio").limit(most).collect()
    finally:
        parts.unpersist()
    return cost, [(r.row[0], r.row[1], r.row[2:]) for r in rows]


def _candidates(spots: DataFrame, cols: Sequence[str], k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates for starting centres and how many rows are nearest to each (k-means||, Bahmani et al. 2012).

    Each round draws rows from the whole table in proportion to their squared
    distance from the candidates so far, in one pass (the rows that may be drawn come back with the cost); the draw depends on the
    point and the round alone, so it is the same whatever the partitioning.  About 1 + START_ROUNDS * START_FACTOR * k distinct points come
    to the driver.
    """
    # copies of a point are one spot with a weight, so its chance is that of all its copies
    lowest = spots.agg(F.min(F.struct(F.xxhash64(F.lit(seed), *cols).alias("h"), *cols)).alias("p")).first().p
    found = [[float(lowest[c]) for c in cols]]
    for turn in range(START_ROUNDS):
        draw = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), *cols), F.lit(1 << 40)) / float(1 << 40)
        most, drawn = max(_DRAWS, START_FACTOR * k), None
        while drawn is None or len(drawn) == most:  # once, unless all that were looked at are drawn
            most = most if drawn is None else 4 * most
            cost, lowest = _lowest_draws(spots, cols, found, draw, most)
            drawn = [x for u, d, x in lowest if u < d * (START_FACTOR * k / cost)]
        if not cost:
            break
        found += sorted(drawn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(found))
        for batch in batches:
            at, _ = _nearest(np.stack([batch.column(c).to_numpy() for c in cols], axis=1), found)
            total += np.bincount(at, weights=batch.column("w").to_numpy(), minlength=len(found))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(found)), pa.int64()), "w": pa.array(total)})

    weights = dict(spots.mapInArrow(count, "i long, w double").groupBy("i").agg(F.sum("w")).collect())
    return np.array(found), np.array([weights.get(i, 0.0) for i in range(len(found))])


def _fit(points: DataFrame, ks: Sequence[int], restarts: int, max_iter: int, tol: float,
         seed: int) -> dict[int, tuple[np.ndarray, float]]:
    """Best centres and cost for each k, all restarts of all k moving together.

    A run ends when its centres move by no more than ``tol`` times the mean
    feature variance of the table (squared distances, summed).
    """
    spots, chunks = _spots(points).persist(), None
    cols = spots.columns[:-1]
    try:
        m = spots.agg(F.sum("w").alias("n"), *[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in cols]).first()
        spread = np.mean(spots.agg(*[F.sum(F.col("w") * (F.col(c) - m[c]) * (F.col(c) - m[c])) / m.n for c in cols]).first())
        starts = _candidates(spots, cols, max(ks), seed)
        chunks = _along_curve(spots, cols).persist()
        chunks.count()
        spots.unpersist()
        return _move_until_still(chunks, starts, ks, restarts, max_iter, tol * float(spread), seed)
    finally:
        spots.unpersist()
        if chunks is not None:
            chunks.unpersist()


def _move_until_still(chunks: DataFrame, starts: tuple[np.ndarray, np.ndarray], ks: Sequence[int], restarts: int, max_iter: int,
                      tol: float, seed: int) -> dict[int, tuple[np.ndarray, float]]:
    owners = [(k, seed + r) for k in ks for r in range(restarts)]
    runs = [_plus_plus(*starts, k, np.random.default_rng([s, k])) for k, s in owners]
    best: dict[int, tuple[np.ndarray, float]] = {}
    live = list(range(len(runs)))
    for step in range(max_iter + 1):
        moved, costs = _one_round(chunks, [runs[i] for i in live])
        still = []
        for i, new, cost in zip(live, moved, costs):
            shift = float(((new - runs[i]) ** 2).sum())
            if shift <= tol or step == max_iter:
                k = owners[i][0]
                if k not in best or cost < best[k][1]:
                    best[k] = (runs[i], cost)
            else:
                runs[i] = new
                still.append(i)
        live = still
        if not live:
            break
    # number the clusters by the position of their centres
    return {k: (c[np.lexsort(c.T[::-1])], cost) for k, (c, cost) in best.items()}


def kmeans_centres(points: DataFrame, k: int = settings.CLUSTERS, restarts: int = settings.KMEANS_RESTARTS,
                   max_iter: int = 300, tol: float = 1e-4, seed: int = settings.SEED) -> tuple[np.ndarray, float]:
    """Centres of the best of ``restarts`` k-means runs, and its within-cluster sum of squares.

    All restarts share each pass over the data, so ten cost the scans of one.
    """
    return _fit(points, [k], restarts, max_iter, tol, seed)[k]


def assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Add ``cluster``, the nearest centre, and ``distance`` to it; both are null where ``x`` holds a gap."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            at, gap = _nearest(x, centres)
            gaps = np.isnan(x).any(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32), mask=gaps), pa.array(np.sqrt(gap), mask=gaps)],
                                             names=[*batch.schema.names, "cluster", "distance"])

    return points.mapInArrow(place, T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())]))


def kmeans(points: DataFrame, k: int = settings.CLUSTERS, restarts: int = settings.KMEANS_RESTARTS,
           seed: int = settings.SEED) -> DataFrame:
    """Points with their k-means ``cluster`` and the distance to its centre."""
    centres, _ = kmeans_centres(points, k, restarts, seed=seed)
    return assign(points, centres)


def inertia(assigned: DataFrame) -> DataFrame:
    """Within-cluster sum of squares of assigned points."""
    return assigned.agg(F.sum(F.col("distance") * F.col("distance")).alias("inertia"))


def elbow(points: DataFrame, max_k: int = settings.ELBOW_MAX_K, restarts: int = settings.KMEANS_RESTARTS,
          seed: int = settings.SEED) -> DataFrame:
    """Rows (k, inertia, suggested) for k = 2..max_k.

    The suggested k is the left end of the three neighbouring k whose inertia
    bends most (largest second difference).
    """
    ks = list(range(2, max_k + 1))
    fits = _fit(points, ks, restarts, 300, 1e-4, seed)
    costs = [fits[k][1] for k in ks]
    bend = np.diff(costs, 2)
    best = int(np.argmax(bend)) + 2 if len(bend) else None
    return points.sparkSession.createDataFrame(
        [(k, float(c), k == best) for k, c in zip(ks, costs)], "k int, inertia double, suggested boolean")


def hierarchical(points: DataFrame, k: int = settings.CLUSTERS, seed: int = settings.SEED) -> DataFrame:
    """Nested clusters by repeated two-way splits from the top (``cluster`` numbered by centre).

    The cluster with most rows that holds different points is split by 2-means until there are ``k``.  Bottom-up linkage
    needs all pairs of points; splitting needs only passes.
    """
    label, centres, closed = F.lit(0), {0: np.zeros(width(points))}, set()
    while len(centres) < k:
        rows = dict(points.groupBy(label.alias("l")).agg(F.count("*")).collect())  # one row per cluster
        open_ = sorted((leaf for leaf in centres if leaf not in closed and rows.get(leaf)), key=lambda leaf: (-rows[leaf], leaf))
        if not open_:
            break
        leaf, new = open_[0], len(centres)
        two, _ = kmeans_centres(points.where(label == leaf), 2, 1, 50, seed=seed)
        if (two[0] == two[1]).all():
            closed.add(leaf)  # copies of one point
            continue
        left, right = ([float(v) for v in c] for c in two)
        label = F.when((label == leaf) & (_sq_dist(F.col("x"), right) < _sq_dist(F.col("x"), left)), new).otherwise(label)
        centres[leaf], centres[new] = two
    place = np.argsort(np.lexsort(np.array([centres[i] for i in range(len(centres))]).T[::-1]))
    return points.withColumn("cluster", F.element_at(F.array(*[F.lit(int(p)) for p in place]), label + 1))


_METHODS: dict[str, Callable[..., DataFrame]] = {}


def register_method(name: str, fit: Callable[[DataFrame, int, Sequence[str]], DataFrame]) -> None:
    """Add a clustering method: (points, n_clusters, key_cols) to points with a ``cluster`` column."""
    _METHODS[name] = fit


register_method("kmeans", lambda points, k, keys: kmeans(points, k))
register_method("hierarchical", lambda points, k, keys: hierarchical(points, k))
register_method("dbscan", lambda points, k, keys: density_clusters(points, keys))


# ---- quality ----------------------------------------------------------------

def silhouette_squared(labelled: DataFrame) -> float:
    """Silhouette with squared Euclidean distances: linear in the rows."""
    ready = labelled.select(array_to_vector("x").alias("v"), F.col("cluster").cast("double").alias("c"))
    return ClusteringEvaluator(featuresCol="v", predictionCol="c").evaluate(ready)


def _every_pair_of_tiles(left: DataFrame, right: DataFrame, tiles: int, fn: Callable, schema: T.StructType) -> DataFrame:
    """Apply ``fn(left tile, right tile)`` to all pairs of tiles; both sides carry a ``tile`` column.

    For the two measures that compare everything with everything by definition:
    a task holds two tiles and returns sums or extremes, never pairs.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>"))
    a = left.select("*", F.col("tile").alias("i"), every.alias("j")).drop("tile")
    b = right.select("*", every.alias("i"), F.col("tile").alias("j")).drop("tile")
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(fn, schema)


def _silhouette_spots(labelled: DataFrame) -> DataFrame:
    """Distinct points of each cluster with the rows they stand for (``w``), numbered by cluster (``idx``), staged."""
    spots = labelled.groupBy("x", F.col("cluster").cast("bigint").alias("own")).agg(F.count("*").alias("w"))
    return stage_table(ordered_index(spots.withColumn("g", F.lit("s")), "g", ["own", "x"]).drop("g"))


def silhouette_points(labelled: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Keys, cluster and Euclidean silhouette of every point.

    The mean distance of each point to every cluster takes all distances of
    different points by definition.  Copies within a cluster are one spot with a weight; spots are numbered by cluster and
    compared tile by tile.  A tile returns, per spot, sums for its own cluster and those that other tiles share (two at
    most), and of all others the smallest mean; distances never become rows, but the work is quadratic in the spots.
    """
    named = labelled.select(*[ref(k) for k in key_cols], F.struct("x", F.col("cluster").cast("bigint").alias("own")).alias("spot"))
    spots = _silhouette_spots(labelled)
    n, d = spots.count(), width(labelled)
    # a side of a tile takes 32 MiB at most, and small tables still make work for many tasks
    most = max(1, min(_TILE_BYTES // (8 * d), max(_TILE_ROWS, math.ceil(n / 16))))
    tiles = max(1, math.ceil(n / most))
    sizes = spots.groupBy("own").agg(F.sum("w").cast("double").alias("size"))
    sides = spots.join(sizes, "own").select("idx", "own", "size", F.col("w").cast("double").alias("w"), "x", F.floor(F.col("idx") / most).alias("tile"))

    def tile(one: pa.Table, other: pa.Table) -> pa.Table:
        def read(t: pa.Table, side: str) -> tuple:
            t = t.sort_by(f"{side}idx")
            return (*[t.column(f"{side}{c}").to_numpy() for c in ("idx", "own", "size", "w")], t.column(f"{side}x").combine_chunks().flatten().to_numpy().reshape(-1, d))

        out: list[tuple] = []
        if one.num_rows and other.num_rows:
            (ida, own, _, _, x), (idb, near, size, w, y) = read(one, ""), read(other, "r_")
            first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
            names, group, of = near[first], size[first], np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(near)]))
            whole = np.add.reduceat(w, first) == group
            nx, ny = (x * x).sum(axis=1), (y * y).sum(axis=1)
            for r in range(0, len(x), 256):
                rows = slice(r, r + 256)
                total = np.zeros((len(x[rows]), len(first)))
                for c in range(0, len(y), 4096):
                    cols = slice(c, c + 4096)
                    gap = x[rows] @ y[cols].T
                    gap *= -2.0
                    gap += nx[rows, None]
                    gap += ny[cols]
                    # close points lose digits in the products: these are subtracted one by one
                    if gap.min() < 1e-6 * (nx[rows].max() + ny[cols].max()):
                        at, to = np.nonzero(gap < 1e-6 * (nx[rows, None] + ny[cols]))
                        gap[at, to] = sum((x[r + at, j] - y[c + to, j]) ** 2 for j in range(d))
                    np.sqrt(gap, out=gap)
                    gap *= w[cols]
                    part = of[cols]
                    total[:, part[0]:part[-1] + 1] += np.add.reduceat(gap, np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), axis=1)
                same = own[rows, None] == names
                told = same | ~whole
                at, to = np.nonzero(told)
                out.append((ida[rows][at], names[to], total[at, to], group[to]))
                rest = np.where(told, np.inf, total / group)
                out.append((ida[rows], np.full(len(rest), -1), rest.min(axis=1), np.zeros(len(rest))))
        cells = [np.concatenate(v) for v in zip(*out)] if out else [np.zeros(0)] * 4
        return pa.table({"idx": pa.array(cells[0].astype(np.int64)), "near": pa.array(cells[1].astype(np.int64)),
                         "total": pa.array(cells[2].astype(np.float64)), "size": pa.array(cells[3].astype(np.float64))})

    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)).cast("array<bigint>"))
    parts = min(tiles * tiles, 2000)
    left = sides.select("*", every.alias("j")).repartition(parts, "tile", "j")
    right = sides.select(*[F.col(c).alias(f"r_{c}") for c in sides.columns], every.alias("i")).repartition(parts, "i", "r_tile")
    found = left.groupBy("tile", "j").cogroup(right.groupBy("i", "r_tile")).applyInArrow(tile, "idx bigint, near bigint, total double, size double")
    # size 0: the smallest mean of clusters that lie in one tile
    sums = found.groupBy("idx", "near", "size").agg(F.sum("total").alias("total"), F.min("total").alias("least"))
    own = spots.select("idx", "own", "x", "w")
    mine = (F.col("own") == F.col("near")) & (F.col("size") > 0)
    s = sums.join(own, "idx").groupBy("idx", "own", "x", "w").agg(
        F.max(F.when(mine, F.col("size"))).alias("size"),
        F.max(F.when(mine & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(F.col("size") == 0, F.when(F.col("least") < float("inf"), F.col("least")))
              .when(~mine, F.col("total") / F.col("size"))).alias("b"))
    score = F.when(F.col("size") == 1, 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    scores = stage_table(s.select(F.struct("x", "own").alias("spot"), "w", score.alias("silhouette")))
    return spread_join(named, scores, "spot", "w", named.count()).select(
        *[ref(k) for k in key_cols], F.col("spot.own").alias("cluster"), "silhouette")


def cluster_centres(labelled: DataFrame) -> DataFrame:
    """Rows (cluster, size, centre, spread): spread is the mean distance to the centre."""
    d = width(labelled)
    means = labelled.groupBy("cluster").agg(
        F.count("*").alias("size"), F.array(*[F.avg(F.col("x")[j]) for j in range(d)]).alias("centre"))
    gap = F.sqrt(_sq_dist(F.col("x"), [F.col("centre")[j] for j in range(d)]))
    return labelled.join(means, "cluster").groupBy("cluster", "size", "centre").agg(F.avg(gap).alias("spread"))


def davies_bouldin(labelled: DataFrame) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / centre distance; lower is better."""
    centres = cluster_centres(labelled)
    tiles = max(1, math.ceil(labelled.select("cluster").distinct().count() / _TILE_ROWS))
    tile_no = F.pmod(F.xxhash64("cluster"), F.lit(tiles)).alias("tile")
    left = centres.select(F.col("cluster").alias("one"), F.col("centre").alias("x"), F.col("spread").alias("s"), tile_no)
    right = centres.select(F.col("cluster").alias("other"), F.col("centre").alias("y"), F.col("spread").alias("t"), tile_no)

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"one": [], "worst": []})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["y"].to_numpy())
        gap = np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))
        both = a["s"].to_numpy()[:, None] + b["t"].to_numpy()[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(gap > 0, both / gap, 0.0)
        ratio[a["one"].to_numpy()[:, None] == b["other"].to_numpy()[None, :]] = -1.0
        return pd.DataFrame({"one": a["one"], "worst": ratio.max(axis=1)})

    schema = T.StructType([T.StructField("one", centres.schema["cluster"].dataType), T.StructField("worst", T.DoubleType())])
    each = (_every_pair_of_tiles(left, right, tiles, tile, schema)
            .groupBy("one").agg(F.max("worst").alias("worst")).where("worst >= 0"))
    return each.agg(F.avg("worst").alias("davies_bouldin"), F.count("*").alias("n_clusters"))


def quality(labelled: DataFrame, method: str, key_cols: Sequence[str], measure: str = "squared") -> DataFrame:
    """One row of quality numbers; fewer than two labels give nulls and a failed gate.

    Noise (-1) counts as a label.  ``measure`` names the silhouette that the gate
    uses at any size: ``squared`` distances, linear in the rows, or ``euclidean``
    ones, which compare all points and are only computed on request.
    """
    if measure not in ("squared", "euclidean"):
        raise ValueError(f"unknown silhouette measure {measure}")
    counts = labelled.agg(F.count("*").alias("n"), F.countDistinct("cluster").alias("k"),
                          F.count_if(F.col("cluster") == -1).alias("noise")).first()
    plain = both = db = None
    if counts.k >= 2:
        shifted = labelled.withColumn("cluster", F.col("cluster") + 1)  # the evaluator takes no negative label
        both = silhouette_squared(shifted)
        if measure == "euclidean":
            plain = silhouette_points(labelled, key_cols).agg(F.avg("silhouette")).first()[0]
        db = davies_bouldin(labelled).first().davies_bouldin
    score = plain if measure == "euclidean" else both
    row = (method, counts.k, counts.noise, measure, plain, both, db, score is not None and score >= settings.GOOD_SILHOUETTE)
    return labelled.sparkSession.createDataFrame(
        [row], "method string, n_clusters bigint, n_noise bigint, silhouette_kind string, silhouette_euclidean double, "
               "silhouette_squared double, davies_bouldin double, quality_acceptable boolean")


def cluster(points: DataFrame, key_cols: Sequence[str], n_clusters: int = settings.CLUSTERS,
            methods: Sequence[str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Labelled points per method, staged, and one quality row per method."""
    labels, table = {}, None
    for name in methods or ("kmeans", "hierarchical", "dbscan"):
        labels[name] = stage_table(_METHODS[name](points, n_clusters, key_cols))  # assigned once: quality alone reads them in many passes
        row = quality(labels[name], name, key_cols)
        table = row if table is None else table.unionByName(row)
    return labels, table


def cluster_summary(df: DataFrame, label_col: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Size, share, mean and sample variance of the raw columns per cluster."""
    cols = list(cols) if cols is not None else [c for c in numeric_columns(df) if c != label_col]
    clean = nan_to_null(df.select(ref(label_col).alias("cluster"), *[ref(c).cast("double").alias(c) for c in cols]))
    per = clean.groupBy("cluster").agg(F.count("*").alias("size"), *[e for i, c in enumerate(cols) for e in (
        F.avg(ref(c)).alias(f"m{i}"), F.var_samp(ref(c)).alias(f"v{i}"))])
    total = F.lit(df.count()).cast("bigint")
    return per.select(
        "cluster", "size", percent(F.col("size"), total).alias("percentage"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("variance"))
            for i, c in enumerate(cols)])))


# ---- projection -------------------------------------------------------------

def components(points: DataFrame, k: int = settings.PCA_COMPONENTS) -> tuple[np.ndarray, list[float]]:
    """Principal directions (rows) and the share of variance each explains.

    The sign is fixed so that the first of the largest loadings is positive.
    """
    d = width(points)
    if k > d:
        raise ValueError(f"{k} components of {d} features")
    near = [float(v) for v in points.agg(*[F.avg(F.col("x")[j]) for j in range(d)]).first()]
    held, first, second = _sums_around(points, near)
    shares, axes = np.linalg.eigh(second / held[0] - np.outer(first / held, first / held))
    shares, axes = np.maximum(shares[::-1], 0.0), axes.T[::-1][:k].copy()
    for a in axes:
        lead = np.flatnonzero(np.abs(a) >= np.abs(a).max() * (1 - 1e-9))[0]
        if a[lead] < 0:
            a *= -1
    return axes, [float(v / shares.sum()) for v in shares[:k]]


def project(points: DataFrame, k: int = settings.PCA_COMPONENTS) -> DataFrame:
    """Add ``pc1..pck``: coordinates on the principal directions."""
    axes, _ = components(points, k)
    for i, a in enumerate(axes):
        points = points.withColumn(
            f"pc{i + 1}", sum((F.col("x")[j] * float(w) for j, w in enumerate(a)), F.lit(0.0)))
    return points.drop("x")


def explained_variance(points: DataFrame, k: int = settings.PCA_COMPONENTS) -> DataFrame:
    _, shares = components(points, k)
    return points.sparkSession.createDataFrame(
        list(enumerate(shares, 1)), "component int, explained_variance_ratio double")


def distant_points(assigned: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Points unusually far from their own centre, by the interquartile rule on the distance."""
    from plumbline.operators.outliers import flagged_rows, measure

    # assigned once: the search for the quartiles and the flags read three or four columns
    held = stage_table(assigned.select(*[ref(k) for k in key_cols], "cluster", "distance"))
    stats = measure(held, ["distance"], ["iqr"])
    return flagged_rows(held, [*key_cols, "cluster"], ["distance"], ["iqr"], stats).select(
        *[ref(k) for k in key_cols], "cluster", F.col("value").alias("distance"))
