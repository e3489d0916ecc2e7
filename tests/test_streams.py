"""Streams over sorted partitions: both ways give the neighbours, long periods cost no shuffle."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ordering, streams
from plumbline.functions.streams import frame_sums, over_neighbours
from plumbline.operators import temporal
from test_temporal import table


def described():
    """For each row the values 2 before and 3 after it."""
    def step(chunks):
        for c in chunks:
            yield pa.RecordBatch.from_pydict({"series": [c.group] * len(c.rows), "idx": c.first + np.arange(len(c.rows)), "own": c.own,
                                              "back": pa.array(c.at(-2), from_pandas=True), "ahead": pa.array(c.at(3), from_pandas=True)})

    return step


SCHEMA = "series string, idx bigint, own double, back double, ahead double"


@pytest.mark.parametrize("way", ["stream", "small chunks", "many borders", "unordered", "tiny partitions"])
def test_neighbours_by_both_ways(spark, monkeypatch, way):
    a, b = np.random.default_rng(1).normal(size=300), [None if i % 3 else float(i) for i in range(300)]
    rows = temporal.series_rows(table(spark, 16 if way == "tiny partitions" else 4, a=a, b=b, c=[1.0] + [None] * 299), "ts")
    if way == "small chunks":
        monkeypatch.setattr(streams, "CHUNK_ROWS", 1)
    if way == "many borders":
        monkeypatch.setattr(streams, "BORDER_ROWS", 0)
    if way == "unordered":
        rows = rows.repartition(5)
    got = {(r.series, r.idx): (r.own, r.back, r.ahead) for r in over_neighbours(rows, "series", 2, 3, described(), SCHEMA).collect()}
    want = {}
    for name, x in (("a", list(a)), ("b", [v for v in b if v is not None]), ("c", [1.0])):
        for i, v in enumerate(x):
            want[name, i] = (v, x[i - 2] if i >= 2 else None, x[i + 3] if i + 3 < len(x) else None)
    assert got == want
    assert over_neighbours(rows.limit(0), "series", 2, 3, described(), SCHEMA).count() == 0


def plain_trend(x, period):
    half, out = period // 2, []
    for i in range(len(x)):
        if i < half or i >= len(x) - half:
            out.append(None)
            continue
        frame = x[i - half: i + half + 1]
        total = math.fsum(frame) - (frame[0] + frame[-1]) / 2 if period % 2 == 0 else math.fsum(frame)
        out.append(total / period)
    return out


@pytest.mark.parametrize("period,parts", [(24, 4), (7, 16), (600, 16), (1000, 3)])
def test_trend_over_periods_longer_than_partitions(spark, period, parts):
    x = list(1e9 + np.random.default_rng(2).normal(size=2200))
    rows = temporal.series_rows(table(spark, parts, v=x), "ts")
    got = [r.trend for r in temporal.decompose(rows, period).orderBy("idx").collect()]
    want = plain_trend(x, period)
    assert [g is None for g in got] == [w is None for w in want]
    assert all(math.isclose(g, w, rel_tol=1e-15, abs_tol=3e-7) for g, w in zip(got, want) if w is not None)


def test_running_sum_keeps_small_parts():
    x = np.concatenate([[1e16], np.full(1000, 0.123), [-1e16], np.full(1000, 0.1)])
    got = frame_sums(x, 10)
    assert math.isclose(got[500], 1.23, rel_tol=1e-12) and math.isclose(got[-1], 1.0, rel_tol=1e-12)


@pytest.mark.parametrize("period", [24, 8760])
def test_no_exchange_after_the_range_sort(spark, period):
    rows = temporal.series_rows(table(spark, 4, v=np.random.default_rng(3).normal(size=500)), "ts")
    for made in (temporal._smoothed(rows.select("series", "idx", "ts", "value"), {"v": 500}, period), temporal._steps(rows)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange" in line and "BroadcastExchange" not in line]
        assert not moved and "MapInArrow" in plan and "Window" not in plan


def test_kpss_joins_the_lines_of_tasks(spark):
    x = np.cumsum(np.random.default_rng(5).normal(size=700))
    rows = temporal.series_rows(table(spark, 7, v=x), "ts")
    e = x - x.mean()
    want = float((np.cumsum(e) ** 2).sum())
    for shown in (rows, rows.repartition(3)):
        got = temporal._running_squares(shown, temporal._facts(shown)).first().squares
        assert math.isclose(got, want, rel_tol=1e-10)
    assert ordering.BLOCK_ROWS > 0 and rows.where(F.col("idx") < 0).count() == 0
