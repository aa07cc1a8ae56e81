"""Baselines that grow by arrivals, and versions of thresholds."""

import numpy as np
import pandas as pd
import pytest

from quartzite.operators import grading, growing
from quartzite.sources.scratch import scratch_path, stored

POINTS = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}


def frame(spark, a, b):
    return spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "metric": "x", "bin": 1}))


def check(base, everything):
    got = {r.metric: r for r in base.stats().collect()}
    for m in ("a", "b"):
        x = np.concatenate([e[m] for e in everything])
        assert got[m].n == len(x)
        for p, q in POINTS.items():
            assert got[m][p] == pytest.approx(np.quantile(x, q), abs=2e-9)
        assert got[m]["mean"] == pytest.approx(x.mean(), abs=2e-9) and got[m]["std"] == pytest.approx(x.std(), abs=2e-9)


def test_each_arrival_equals_the_whole(spark):
    """Ties (b has few values), drift (arrivals lie higher and higher) and sizes from one row on."""
    r = np.random.default_rng(1)
    base = growing.GrowingBaseline(spark, scratch_path(spark, "test-growing"), ["a", "b"], bins=32, size=200, heavy=4)
    so_far, epochs = [], []
    for i, n in enumerate((400, 1, 3000, 5000)):
        part = {"a": r.normal(size=n) + 3 * i, "b": r.integers(0, 4, n).astype(float)}
        so_far.append(part)
        assert base.add(frame(spark, **part), f"n{i}")
        assert not base.add(frame(spark, **part), f"n{i}")
        check(base, so_far)
        epochs.append(base.manifest()[0])
    assert epochs[-1] > 0  # drift made bins heavy, so they were cut anew
    assert base.manifest()[1] == [f"n{i}" for i in range(4)]


def test_only_wanted_bins_are_read(spark):
    r = np.random.default_rng(2)
    base = growing.GrowingBaseline(spark, scratch_path(spark, "test-growing"), ["a", "b"], bins=100)
    for i in range(2):
        base.add(frame(spark, r.normal(size=4000), r.random(4000)), f"n{i}")
    bracketed = base.bracketed(base.targets(base.counted()))
    assert bracketed.count() < 0.15 * 16_000
    plan = bracketed._jdf.queryExecution().toString()
    assert "PushedFilters: [Or" in plan and "In(bin" in plan


def test_a_failed_arrival_is_written_again(spark):
    base = growing.GrowingBaseline(spark, scratch_path(spark, "test-growing"), ["a", "b"])
    part = {"a": np.arange(10.0), "b": np.arange(10.0)}
    note, base.note = base.note, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        base.add(frame(spark, **part), "n0")
    base.note = note
    assert base.manifest() == (0, []) and base.stats().count() == 0
    assert base.add(frame(spark, **part), "n0")
    check(base, [part])


def test_edges_of_arrivals(spark):
    base = growing.GrowingBaseline(spark, scratch_path(spark, "test-growing"), ["a", "b"])
    rows = spark.createDataFrame([(None, 1.0), (None, None)], "a double, b double")
    assert base.add(rows.filter("false"), "empty") and base.stats().count() == 0
    assert base.add(rows, "nulls")
    assert [(r.metric, r.n, r.p50, r["std"]) for r in base.stats().collect()] == [("b", 1, 1.0, 0.0)]
    assert base.add(spark.createDataFrame([(5.0, 3.0)], "a double, b double"), "late")
    assert sorted((r.metric, r.n, r.p50) for r in base.stats().collect()) == [("a", 1, 5.0), ("b", 2, 2.0)]


def limits(spark, **values):
    return spark.createDataFrame([(k, v, f"{k} p1") for k, v in values.items()], "limit string, value double, source string")


def test_versions_and_their_record(spark):
    history = spark.createDataFrame([], growing.HISTORY)
    for at, version in ((1, {"x": 1.0, "y": None}), (2, {"x": 1.0, "y": None}), (3, {"x": 2.0, "y": None}), (5, {"y": 4.0}), (5, {"y": 4.0}), (7, {"x": 2.0, "y": None})):
        history = stored(growing.new_version(history, limits(spark, **version), at), "test-history")
    rows = sorted((r.limit, r.valid_from, r.valid_to, r.value) for r in history.collect())
    assert rows == [("x", 1, 3, 1.0), ("x", 3, 5, 2.0), ("x", 7, None, 2.0), ("y", 1, 5, None), ("y", 5, 7, 4.0), ("y", 7, None, None)]
    record = sorted((r.limit, r.valid_from, r.old, r.new, r.source) for r in growing.change_record(history).collect())
    assert record == [
        ("x", 1, None, 1.0, "x p1"), ("x", 3, 1.0, 2.0, "x p1"), ("x", 5, 2.0, None, "gone"), ("x", 7, None, 2.0, "x p1"), ("y", 1, None, None, "y p1"), ("y", 5, None, 4.0, "y p1"), ("y", 7, 4.0, None, "y p1"),
    ]
    assert growing.new_version(history, limits(spark, x=2.0, y=None), 4).count() == 6
    with pytest.raises(ValueError):
        growing.new_version(history, limits(spark, x=3.0), 6)


def test_limits_name_their_source(spark):
    stats = spark.createDataFrame([("mask_ratio", 0.1, 0.2, 0.3, 0.8, 0.9, 0.4, 0.1), ("contour_perim_ratio", 0.1, 0.2, 0.3, 0.8, 0.9, 0.4, 0.1), ("circularity", 0.01, None, 0.3, 0.8, 0.9, 0.4, 0.1)], "metric string, p1 double, p5 double, p50 double, p95 double, p99 double, mean double, std double")
    got = {r.limit: (r.value, r.source) for r in grading.limit_rows(stats).collect()}
    assert got["min_mask"] == (0.1, "mask_ratio p1") and got["soft_mask_hi"] == (0.8, "mask_ratio p95")
    assert got["max_perim"] == (grading.DEFAULTS["max_perim"], "default") and got["min_circ"] == (grading.DEFAULTS["min_circ"], "default")
    plain = {r.limit: r.value for r in grading.limit_rows(None, spark).collect()}
    assert plain["soft_circ_hi"] == grading.DEFAULTS["max_circ"] and len(plain) == len(got)
