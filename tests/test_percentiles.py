"""Percentiles of many columns in two passes, against plain ones."""

import numpy as np
import pytest

from quartzite.functions import percentiles as op
from quartzite.operators import grading

POINTS = {"p0": 0.0, "p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("size, eps", [(8192, 1e-3), (64, 1e-6)])  # the second misses its brackets
def test_wide_percentiles(spark, size, eps):
    r = np.random.default_rng(4)
    n = 6000
    columns = [r.normal(size=n), r.integers(0, 5, n).astype(float), np.full(n, 2.5), np.repeat([1.0, 2.0, 9.0], n // 3), np.where(np.arange(n) % 7, r.normal(size=n), np.nan), np.where(np.arange(n) < 2, 1.0 + np.arange(n), np.nan)]
    rows = [tuple(None if np.isnan(x) else float(x) for x in row) + (None,) for row in zip(*columns)]
    frame = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7))).repartition(5)
    got, _ = op.wide_percentiles(frame, POINTS, size, eps)
    for at, column in zip(got, columns):
        assert list(at.values()) == pytest.approx(np.percentile(column[~np.isnan(column)], [100 * q for q in POINTS.values()]).tolist(), abs=1e-12)
    assert got[6] == dict.fromkeys(POINTS)


def test_large_way_makes_no_row_per_metric(spark, monkeypatch):
    """What moves is a row per bin and task, and the values inside brackets, not the items times the metrics."""
    items = spark.range(40_000).selectExpr(*[f"cast(hash(id, {i}) as double) as {m}" for i, m in enumerate(grading.METRICS)])
    kept = []
    stored = op.stored
    monkeypatch.setattr(op, "stored", lambda df, tag: kept.append(stored(df, tag)) or kept[-1])
    got = {r.metric: r for r in grading.scalar_stats(items, large=True).collect()}
    assert len(kept) == 2 and kept[1].count() < 0.03 * 40_000 * len(grading.METRICS)
    want = {r.metric: r for r in grading.scalar_stats(items, large=False).collect()}
    assert all(got[m][k] == pytest.approx(want[m][k], rel=1e-12) for m in want for k in ("n", *grading.POINTS, "mean", "std"))
    assert grading.scalar_stats(items.filter("false"), large=True).count() == 0


def test_metrics_of_few_values_are_counted_in_one_pass(spark, monkeypatch):
    """Only a metric of many values is sketched and bracketed; the others need no second look at the items."""
    few = grading.METRICS[1:]
    items = spark.range(60_000).selectExpr(f"cast(hash(id) as double) as {grading.METRICS[0]}", *[f"case when id % 7 > 0 then cast(id % {i + 2} as double) / 3 end as {m}" for i, m in enumerate(few)]).repartition(5)
    sketched = []
    wide = grading.wide_percentiles
    monkeypatch.setattr(grading, "wide_percentiles", lambda rows, *more: sketched.append(rows.columns) or wide(rows, *more))
    got = {r.metric: r for r in grading.scalar_stats(items, large=True).collect()}
    assert sketched == [[grading.METRICS[0]]]
    want = {r.metric: r for r in grading.scalar_stats(items, large=False).collect()}
    assert all(got[m][k] == pytest.approx(want[m][k], rel=1e-12, abs=1e-9) for m in want for k in ("n", *grading.POINTS, "mean", "std"))


def test_few_values(spark):
    rows = [(1.5, float("nan"), None, float(i)) for i in range(300)] + [(2.5, 1.0, None, 0.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(3)
    (a, b, c, d), total = op.few_values(frame, 299)  # the tasks meet at most 299 values of d, all together 300
    assert total == 301 and [x.tolist() for x in a] == [[1.5, 2.5], [300, 1]] and [x.tolist() for x in c] == [[], []] and d is None
    assert b[0][0] == 1.0 and np.isnan(b[0][1]) and b[1].tolist() == [1, 300]
    assert op.few_values(frame, 300)[0][3][1].tolist() == [2] + [1] * 299
    assert op.few_values(frame.filter("false"))[1] == 0
