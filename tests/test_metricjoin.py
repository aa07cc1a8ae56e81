"""Nearest neighbours and cover by the metric join, against plain distances."""

import numpy as np
import pytest

from quartzite.operators import metricjoin as op

KS = (1, 3, 5, 11, 21)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "item long, x array<double>")


def plain(real, made, ks=KS):
    def cover(points, balls):
        own = np.sqrt(((balls[:, None] - balls[None]) ** 2).sum(2))
        np.fill_diagonal(own, np.inf)
        own = np.sort(own, 1)
        far = np.sqrt(((points[:, None] - balls[None]) ** 2).sum(2))
        return [round(float((far <= np.where(np.isfinite(own[:, k - 1]), own[:, k - 1], -1)[None]).any(1).mean()), 6) if k <= own.shape[1] else 0.0 for k in ks]

    return list(zip(ks, cover(made, real), cover(real, made)))


def clustered(seed, n, centres, d=16, spread=0.05):
    r = np.random.default_rng(seed)
    return centres[r.integers(0, len(centres), n)] + r.normal(size=(n, d)) * spread


def test_clusters_need_few_pairs(spark):
    r = np.random.default_rng(0)
    centres = r.normal(size=(40, 16))
    real, made = clustered(1, 3000, centres), clustered(2, 2400, centres[:30] + r.normal(size=(30, 16)) * 0.03)
    got = op.precision_recall(frame(spark, real), frame(spark, made, 50_000), pivots=64, block_rows=100).collect()
    assert [tuple(x)[:3] for x in got] == plain(real, made)
    assert 0 < got[0].pairs < 0.1 * (len(real) ** 2 + len(made) ** 2 + 2 * len(real) * len(made))


@pytest.mark.parametrize("pivots", [1, 7])
def test_no_structure_ties_and_copies(spark, pivots):
    r = np.random.default_rng(3)
    real = np.concatenate([r.normal(size=(150, 5)), r.integers(0, 3, size=(150, 5)).astype(float), np.zeros((60, 5)), 1e6 + r.normal(size=(40, 5))])
    made = np.concatenate([real[::3], r.normal(size=(90, 5)) * 3, np.zeros((30, 5))])
    got = op.precision_recall(frame(spark, real), frame(spark, made, 1000), pivots=pivots, block_rows=40)
    assert [tuple(x)[:3] for x in got.collect()] == plain(real, made)


def test_no_list_of_all_pairs(spark):
    centres = np.random.default_rng(5).normal(size=(20, 8)) * 5
    blocks, cells = op.blocks_of(op.usable(frame(spark, clustered(6, 2000, centres, 8))), centres, 50)
    n = blocks.count()
    borders = blocks.select("block", "cell", "lo", "hi").selectExpr("*", "0.3D as reach")
    pairs = op.block_pairs(borders, blocks, cells, cells)
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "NestedLoop" not in pairs._jdf.queryExecution().toString()
    assert n <= pairs.count() < 0.2 * n * n


def test_edges(spark):
    nan = float("nan")
    rows = [(None, [0.0, 0.0]), (1, None), (2, [nan, 0.0]), (3, [None, 1.0]), (4, [0.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0])]
    odd = spark.createDataFrame(rows, "item long, x array<double>")
    other = spark.createDataFrame([(9, [0.5, 0.0]), (10, [7.0, 7.0])], "item long, x array<double>")
    got = {r.k: (r.precision, r.recall) for r in op.precision_recall(odd, other).collect()}
    assert got == {1: (0.5, 1.0), 3: (0.0, 0.0), 5: (0.0, 0.0), 11: (0.0, 0.0), 21: (0.0, 0.0)}
    for a, b in ((odd.filter("false"), other), (other, odd.filter("false")), (odd.filter("false"), odd.filter("false"))):
        assert [tuple(r)[1:3] for r in op.precision_recall(a, b).collect()] == [(0.0, 0.0)] * 5


def test_blocks_travel_once_per_group(spark, monkeypatch):
    r = np.random.default_rng(8)
    real, made = r.normal(size=(1500, 12)), r.normal(size=(1300, 12)).astype(np.float32).astype(float)
    came, visits = [], op.visits

    def counted(asking, asked, *rest):
        out = visits(asking, asked, *rest)
        came.append((out.count(), asking.count(), asked.count()))
        return out

    monkeypatch.setattr(op, "visits", counted)
    got = op.precision_recall(frame(spark, real), frame(spark, made, 50_000), pivots=4, block_rows=10).collect()
    assert [tuple(x)[:3] for x in got] == plain(real, made)
    assert len(came) == 4 and all(asked > 100 and n <= asking + 24 * asked for n, asking, asked in came)
