"""Views and operators take all rows."""

import numpy as np

from quartzite.operators import metricjoin
from quartzite.operators import populations as op
from quartzite.plans import populations as plans
from quartzite.sources.adapters import load

SF = "/root/testdata/sf0.001"


def test_components_cover_all_orders(spark):
    got = load(spark, SF, "components")
    assert got.count() == load(spark, SF, "lineitem").count()
    assert got.select("image_id").distinct().count() == load(spark, SF, "lineitem").select("l_orderkey").distinct().count()


def sides(spark):
    sides = plans.populations(spark, SF)
    return sides, [np.stack(s.toPandas().x.to_numpy()) for s in sides]


def test_kernel_distance_of_all_rows(spark):
    frames, (a, b) = sides(spark)
    assert len(a) > 200 and len(b) > 200
    kernel = lambda x, y: (x @ y.T / x.shape[1] + 1) ** 3
    own = lambda x: (kernel(x, x).sum() - np.trace(kernel(x, x))) / (len(x) * (len(x) - 1))
    assert np.isclose(op.kernel_distance(*frames), own(a) + own(b) - 2 * kernel(a, b).mean(), rtol=0, atol=1e-9)


def test_precision_recall_of_all_rows(spark):
    frames, (a, b) = sides(spark)
    gap = lambda x, y: np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    inside = lambda x, y, k: round(float((gap(x, y) <= np.sort(gap(y, y), 1)[None, :, k]).any(1).mean()), 6)
    got = {r["k"]: (r["precision"], r["recall"]) for r in metricjoin.precision_recall(*frames, block_rows=60).collect()}
    assert got == {k: (inside(b, a, k), inside(a, b, k)) for k in (1, 3, 5, 11, 21)}
