import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import density, importance, segments


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)],
                                 "k long, x array<double>").repartition(parts)


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(8)
    return np.vstack([rng.normal(m, 0.3, (80, 2)) for m in ((0, 0), (4, 0), (0, 4))])


def by_key(df, col="cluster"):
    return np.array([r[col] for r in sorted(df.collect(), key=lambda r: r.k)])


def test_scaling_with_gaps(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0), (4, float("nan"), 5.0)],
                               "k long, a double, same double")
    got = np.array([r.x for r in segments.scaled(df, ["a", "same"], ["k"]).orderBy("k").collect()])
    filled = np.array([1.0, 3.0, 2.0, 2.0])
    assert np.allclose(got[:, 0], (filled - 2) / filled.std()) and not got[:, 1].any()


def test_kmeans(spark, blobs):
    points = frame(spark, blobs)
    centres, cost = segments.kmeans_centres(points, 3, restarts=3)
    labels = by_key(segments.assign(points, centres))
    gaps = ((blobs[:, None] - centres[None]) ** 2).sum(2)
    assert (labels == gaps.argmin(1)).all()
    assert math.isclose(cost, gaps.min(1).sum(), rel_tol=1e-2)
    assert sorted(np.bincount(labels)) == [80, 80, 80]
    other = segments.kmeans_centres(frame(spark, blobs, 9), 3, restarts=3)[0]
    assert np.allclose(centres, other)
    table = {r.k: r for r in segments.elbow(points, 5, restarts=3).collect()}
    costs = [table[k].inertia for k in range(2, 6)]
    assert costs == sorted(costs, reverse=True)
    assert [k for k in table if table[k].suggested] == [int(np.argmax(np.diff(costs, 2))) + 2]


@pytest.mark.parametrize("d,parts", [(1, 3), (3, 5), (6, 2)])
def test_a_pass_of_kmeans_over_boxes_equals_one_over_points(spark, d, parts):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(3000, d)), np.round(rng.normal(size=(3000, d))) + 0.0, np.full((500, d), 30.0)])
    spots = segments._spots(frame(spark, x, parts))
    assert spots.count() == len(np.unique(x, axis=0))  # copies are looked at once
    runs = [x[rng.choice(len(x), k)] + rng.normal(0, 0.05, (k, d)) for k in (2, 5, 9)]  # no ties
    moved, costs = segments._one_round(segments._along_curve(spots, spots.columns[:-1]), runs)
    for c, new, cost in zip(runs, moved, costs):
        gaps = ((x[:, None] - c[None]) ** 2).sum(2)
        near = gaps.argmin(1)
        assert math.isclose(cost, gaps.min(1).sum(), rel_tol=1e-9)
        assert np.allclose(new, [x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])


def test_hierarchical_separates_blobs(spark, blobs):
    labels = by_key(segments.hierarchical(frame(spark, blobs)))
    assert sorted(np.bincount(labels)) == [80, 80, 80]


def test_hierarchical_splits_the_larger_half_and_stops_at_copies(spark, monkeypatch):
    curve, looked = segments._along_curve, []
    monkeypatch.setattr(segments, "_along_curve", lambda spots, cols: looked.append(spots.count()) or curve(spots, cols))
    x = np.concatenate([np.zeros((500, 2)), np.full((20, 2), 6.0), np.full((30, 2), 10.0), np.full((5, 2), 10.5)])
    labels = by_key(segments.hierarchical(frame(spark, x), 3))
    assert [len(set(labels[a:b])) for a, b in ((0, 500), (500, 520), (520, 550), (550, 555))] == [1, 1, 1, 1]
    assert len(set(labels)) == 3 and labels[0] == 0 and labels[-1] == labels[520]
    assert looked == [4, 1, 3]  # a split passes over distinct points


def test_hierarchical_stops_when_only_copies_are_left(spark):
    assert by_key(segments.hierarchical(frame(spark, [[0.0], [0.0], [0.0], [4.0], [4.0]], 2), 3)).tolist() == [0, 0, 0, 1, 1]


def test_starting_points_survive_copies(spark):
    x = np.vstack([np.zeros((900, 2)), np.ones((3, 2)), np.full((3, 2), 5.0)])
    centres, cost = segments.kmeans_centres(frame(spark, x), 3, restarts=2)
    assert cost < 1e-9 and np.allclose(centres, [[0, 0], [1, 1], [5, 5]])


def brute_dbscan(x, eps, m):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core, labels, c = near.sum(1) >= m, np.full(len(x), -1), 0
    for i in range(len(x)):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], todo = c, [i]
        while todo:
            j = todo.pop()
            if core[j]:
                for n in np.flatnonzero(near[j] & (labels < 0)):
                    labels[n] = c
                    todo.append(n)
        c += 1
    return labels


def test_dbscan_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(density, "_SMALL_PAIR", 64)
    monkeypatch.setattr(density, "_SPLIT_POINTS", 50)
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.02, (200, 3)), rng.normal(1, 0.3, (150, 3)), np.zeros((150, 3)), rng.uniform(-2, 2, (80, 3))])
    got = by_key(density.density_clusters(frame(spark, x), ["k"], 0.25, 5))
    assert (got == brute_dbscan(x, 0.25, 5)).all()


def test_leaves_send_points_not_pairs(spark, monkeypatch):
    """Two clusters that both cross leaves, and one point between them: no step returns a row per pair of points."""
    monkeypatch.setattr(density, "_PIVOT_CELLS", 100)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.1, (300, 5)) for c in (0.0, 1.0)] + [np.full((1, 5), 0.5)])
    sent, visit = [], density._visit
    monkeypatch.setattr(density, "_visit", lambda leaves, visitors, *a: sent.append(visitors.count()) or visit(leaves, visitors, *a))
    got = by_key(density.density_clusters(frame(spark, x), ["k"], 0.3, 4))
    assert (got == brute_dbscan(x, 0.3, 4)).all()
    assert sent and max(sent) < 601


@pytest.mark.parametrize("d,pivots,tile", [(4, 1, 2048), (6, 20, 2048), (6, 7, 16), (5, 400, 3)])
def test_dbscan_beyond_three_axes(spark, monkeypatch, d, pivots, tile):
    monkeypatch.setattr(density, "_PIVOT_CELLS", max(1, 400 // pivots))
    monkeypatch.setattr(density, "_TILE_CELLS", tile)
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(c, 0.15, (90, d)) for c in (0, 1, 1.4)] + [rng.uniform(-2, 3, (60, d)), np.full((30, d), 0.25)])
    got = by_key(density.density_clusters(frame(spark, x), ["k"], 0.35, 5))
    assert (got == brute_dbscan(x, 0.35, 5)).all() and len(set(got.tolist())) > 2


def test_dbscan_with_a_third_of_the_rows_in_one_cell(spark):
    """Rows of a hot point stay where they are: no task of the result holds much more than its share."""
    rng = np.random.default_rng(8)
    x = np.concatenate([np.full((3000, 2), 0.5), rng.uniform(0, 40, (6000, 2))])[rng.permutation(9000)]
    points = frame(spark, x).repartition(9, "k")
    shared = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = density.density_clusters(points, ["k"], 0.3, 5)
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 9000 and max(sizes) < 9000 / 3 * 0.8
        assert (by_key(made) == brute_dbscan(x, 0.3, 5)).all()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", shared)


def test_dbscan_long_chain(spark):
    x = np.column_stack([np.arange(300) * 0.1, np.zeros(300)])[np.random.default_rng(0).permutation(300)]
    got = by_key(density.density_clusters(frame(spark, x), ["k"], 0.15, 2))
    assert (got == 0).all()


def test_quality_measures(spark, blobs, monkeypatch):
    monkeypatch.setattr(segments, "_TILE_ROWS", 50)
    labels = np.repeat([0, 1, 2], 80)
    labels[0] = 7  # a cluster of one
    df = frame(spark, blobs).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "k long, cluster long"), "k")
    gap = np.sqrt(((blobs[:, None] - blobs[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(labels):
        mine = labels == c
        if mine.sum() == 1:
            want.append(0.0)
            continue
        a = gap[i][mine].sum() / (mine.sum() - 1)
        b = min(gap[i][labels == o].mean() for o in set(labels) - {c})
        want.append((b - a) / max(a, b))
    assert np.allclose(by_key(segments.silhouette_points(df, ["k"]), "silhouette"), want)
    ids = sorted(set(labels))
    centre = np.array([blobs[labels == c].mean(0) for c in ids])
    spread = [np.sqrt(((blobs[labels == c] - m) ** 2).sum(1)).mean() for c, m in zip(ids, centre)]
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in range(4) if j != i) for i in range(4)])
    assert math.isclose(segments.davies_bouldin(df).first().davies_bouldin, db, rel_tol=1e-9)
    one = df.withColumn("cluster", F.lit(0))
    row = segments.quality(one, "m", ["k"]).first()
    assert row.silhouette_euclidean is None and row.silhouette_squared is None and row.davies_bouldin is None and row.quality_acceptable is False


@pytest.mark.parametrize("rows", [40, 1000])
def test_silhouette_counts_copies_once(spark, monkeypatch, rows):
    """Spots with weights, clusters inside and across tiles, points close together far from the origin."""
    monkeypatch.setattr(segments, "_TILE_ROWS", rows)
    rng = np.random.default_rng(3)
    base = np.concatenate([rng.normal(size=(60, 3)), 1e5 + 1e-3 * rng.normal(size=(60, 3)), np.zeros((4, 3))])
    x, labels = np.tile(base, (6, 1)), np.tile(rng.integers(-1, 12, len(base)) * (np.arange(len(base)) % 5 > 0), 6)
    df = frame(spark, x).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "k long, cluster long"), "k")
    gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = []
    for i, c in enumerate(labels):
        a = gap[i][labels == c].sum() / ((labels == c).sum() - 1)
        b = min(gap[i][labels == o].mean() for o in set(labels) - {c})
        want.append((b - a) / max(a, b))
    made = segments.silhouette_points(df, ["k"])
    assert np.allclose(by_key(made, "silhouette"), want, rtol=0, atol=1e-8) and (by_key(made) == labels).all()
    assert segments._silhouette_spots(df).count() <= len(base)


def test_projection(spark, blobs):
    points = frame(spark, blobs - blobs.mean(0))
    axes, shares = segments.components(points)
    assert math.isclose(sum(shares), 1.0) and all(a[np.abs(a).argmax()] > 0 for a in axes)
    xy = np.array([[r.pc1, r.pc2] for r in segments.project(points).collect()])
    assert abs(np.corrcoef(xy.T)[0, 1]) < 1e-9


def test_axes_of_almost_uncorrelated_columns(spark):
    """Two scaled columns have the diagonals as axes, however small their correlation; a rounding error of a variance turns them."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 40_000))
    a, b = a - a.mean(), b - b.mean()
    b += a * (1e-6 * np.sqrt((b @ b) / (a @ a)) - (a @ b) / (a @ a))
    df = spark.createDataFrame(pd.DataFrame({"a": 25 + 7 * a, "b": 5e4 + 3e4 * b, "same": 0.1})).repartition(7)
    axes, shares = segments.components(segments.scaled(df, ["a", "b"]))
    assert np.allclose(axes, np.array([[1, 1], [1, -1]]) / np.sqrt(2), rtol=0, atol=1e-9) and math.isclose(sum(shares), 1.0)
    assert segments.scaled(df, ["same"]).where(F.col("x")[0] != 0).isEmpty()


def test_cluster_runs_all_methods(spark, blobs):
    labels, table = segments.cluster(frame(spark, blobs), ["k"])
    got = {r.method: r for r in table.collect()}
    assert set(got) == {"kmeans", "hierarchical", "dbscan"} and got["kmeans"].quality_acceptable
    assert labels["dbscan"].count() == 240
    for rows in labels.values():  # staged: their many readers do not assign again
        assert len(rows.inputFiles()) and "MapInArrow" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_importance_finds_the_signal(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b), "hi" if a > 0 else "lo") for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, t string")
    got = importance.forest_importance(df, "t", trees=10, repeats=1).collect()
    assert got[0].feature == "a" and got[0].permutation_mean > 0.2


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000, 4097])
def test_keyed_places_are_permutations(n):
    drawn = [importance.keyed_places(np.arange(n), n, key) for key in range(6)]
    assert all(sorted(p.tolist()) == list(range(n)) for p in drawn)
    if n > 60:
        assert len({tuple(p.tolist()) for p in drawn}) == 6
        assert all((p == np.arange(n)).mean() < 0.1 and abs(np.corrcoef(p, np.arange(n))[0, 1]) < 0.35 for p in drawn)
        some = np.arange(n)[::7]
        assert (importance.keyed_places(some, n, 3) == drawn[3][::7]).all()  # any task places its own rows alike


@pytest.mark.parametrize("target", ["t", "y"])
def test_permutation_importance_equals_shuffling_by_hand(spark, target):
    rng = np.random.default_rng(11)
    rows = [(float(a), float(b), "hi" if a > 0 else "lo", float(2 * a + b)) for a, b in rng.normal(size=(200, 2))]
    df = spark.createDataFrame(rows, "a double, b double, t string, y double")
    got = importance.forest_importance(df, target, ["a", "b"], trees=5, min_importance=0.0, repeats=3).collect()
    ready, is_class = importance._training(df, target, ["a", "b"])
    model = importance._fitted(ready, is_class, 5, 5, 42)
    data = [(r.y, list(r.x)) for r in sorted(ready.collect(), key=lambda r: (r.y, list(r.x)))]

    def score(table):
        made = model.transform(spark.createDataFrame(table, "y double, x array<double>").selectExpr("y", "x").withColumn(
            "v", importance.array_to_vector("x"))).collect()
        y, p = np.array([r.y for r in made]), np.array([r.p for r in made])
        return (y == p).mean() if is_class else 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()

    base = score(data)
    for r in got:
        at, drops = ["a", "b"].index(r.feature), []
        for turn in range(3):
            places = importance.keyed_places(np.arange(200), 200, (42 * 1009 + at) * 1009 + turn)
            table = [(y, list(x)) for y, x in data]
            for j, i in enumerate(places):
                table[i][1][at] = data[j][1][at]
            drops.append(base - score(table))
        assert math.isclose(r.permutation_mean, np.mean(drops), abs_tol=1e-9)
        assert math.isclose(r.permutation_std, np.std(drops), abs_tol=1e-9)
    assert got[0].feature == "a" and got[0].permutation_mean > 0.1
    assert importance.forest_importance(df, target, ["a", "b"], trees=2, repeats=0).first().permutation_mean is None


def test_forest_is_the_same_however_the_rows_lie(spark):
    """The library's forest drew its bootstrap per partition."""
    rng = np.random.default_rng(12)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=600), "b": rng.integers(0, 5, 600), "y": rng.normal(size=600)}))
    fits = [importance._fitted(importance._training(df.repartition(n), "y", ["a", "b"])[0], False, 7, 4, 42) for n in (1, 5)]
    assert np.array_equal(fits[0].feature, fits[1].feature) and np.allclose(fits[0].featureImportances, fits[1].featureImportances)
    weights = importance.bootstrap_weights(np.arange(40_000), 6, 42, importance._poisson_table())
    assert weights.shape == (40_000, 6) and np.allclose(weights.mean(axis=0), 1, atol=0.03) and np.allclose(weights.var(axis=0), 1, atol=0.06)
    assert np.abs(np.corrcoef(weights.T) - np.eye(6)).max() < 0.03


def test_shuffles_over_many_blocks(spark, monkeypatch):
    """Codes sent between blocks, with and without the table of all predictions, give what one block gives."""
    rng = np.random.default_rng(13)
    x = rng.normal(size=(700, 3))
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": 2 * x[:, 0] + x[:, 1]})).repartition(3)

    def rows():
        return [tuple(r) for r in importance.forest_importance(df, "y", trees=6, min_importance=0.0, repeats=2).collect()]

    whole = rows()
    monkeypatch.setattr(importance, "_BLOCK", 64)
    monkeypatch.setattr(importance, "_SENT_ROWS", 100)
    monkeypatch.setattr(importance, "_CELLS", 1)
    monkeypatch.setattr(importance, "_SHUFFLED", 2)
    assert len(whole) == 3 and [r[0] for r in whole] == [r[0] for r in rows()]
    assert np.allclose([r[1:] for r in whole], [r[1:] for r in rows()], rtol=0, atol=1e-9)


@pytest.mark.parametrize("looked_at", [4096, 1])
def test_starting_candidates_equal_draws_by_hand(spark, monkeypatch, looked_at):
    monkeypatch.setattr(segments, "_DRAWS", looked_at)
    rng = np.random.default_rng(14)
    spots = spark.createDataFrame(pd.DataFrame({"f0": rng.normal(size=500), "f1": rng.normal(size=500), "w": rng.integers(1, 4, 500) * 1.0})).repartition(5)
    found, weights = segments._candidates(spots, ["f0", "f1"], 2, 42)
    first = spots.orderBy(F.xxhash64(F.lit(42), "f0", "f1")).first()
    want = [[first.f0, first.f1]]
    for turn in range(segments.START_ROUNDS):
        rows = spots.withColumn("u", F.pmod(F.xxhash64(F.lit(42), F.lit(turn), "f0", "f1"), F.lit(1 << 40)) / float(1 << 40)).toPandas()
        d = rows["w"].to_numpy() * ((rows[["f0", "f1"]].to_numpy()[:, None] - np.array(want)) ** 2).sum(axis=2).min(axis=1)
        want += sorted(rows[["f0", "f1"]][rows["u"].to_numpy() < d * segments.START_FACTOR * 2 / d.sum()].to_numpy().tolist())
    assert found.tolist() == want and weights.sum() == spots.agg(F.sum("w")).first()[0] and len(want) > 8


def test_distant_points_assigns_once(spark):
    """The quartile search and the flags used to assign every point again, each time it was read."""
    rng = np.random.default_rng(15)
    points, seen = frame(spark, rng.normal(size=(400, 2))), spark.sparkContext.accumulator(0)

    def watch(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    centres = np.array([[-1.0, 0.0], [1.0, 0.0]])
    got = {r.k: (r.cluster, r.distance) for r in segments.distant_points(segments.assign(points.mapInArrow(watch, points.schema), centres), ["k"]).collect()}
    assert seen.value == 400
    rows = points.toPandas()
    gaps = np.sqrt(((np.stack(rows["x"])[:, None] - centres) ** 2).sum(axis=2))
    d, (low, high) = gaps.min(axis=1), np.quantile(gaps.min(axis=1), [0.25, 0.75])
    far = (d < low - 1.5 * (high - low)) | (d > high + 1.5 * (high - low))
    assert got == {int(k): (int(c), v) for k, c, v in zip(rows["k"][far], gaps.argmin(axis=1)[far], d[far])} and got


def test_assigning_points_with_gaps(spark):
    rows = spark.createDataFrame([(1, [0.0, 2.0]), (2, [None, 1.0]), (3, [5.0, 5.0])], "k long, x array<double>")
    got = [tuple(r) for r in segments.assign(rows, np.array([[0.0, 0.0], [5.0, 5.0]])).orderBy("k").select("k", "cluster", "distance").collect()]
    assert got == [(1, 0, 2.0), (2, None, None), (3, 1, 0.0)]
