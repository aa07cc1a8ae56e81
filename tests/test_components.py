"""Components of small and of large images: equal results by arrays and by cells, and what they move."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quartzite.operators import components
from quartzite.plans import registry, visual  # noqa: F401

SCHEMA = "image_id int, comp_id int, area int, x int, y int, w int, h int"


def moved(spark):
    """Rows written to shuffles so far in this session."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize("name", ["isolated", "clusters"])
def test_points_of_small_images_move_at_most_twice(spark, name):
    """Once to count their images, once to meet; not once for each cell around them."""
    n = 8000
    place = lambda seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(480)).cast("int")
    rows = spark.range(n).select((F.col("id") % 2000).alias("image_id"), F.col("id").cast("int").alias("comp_id"), F.lit(9).alias("area"), place(1).alias("x"), place(2).alias("y"), F.lit(4).alias("w"), F.lit(4).alias("h"))
    before = moved(spark)
    got = components.isolated(rows) if name == "isolated" else components.clusters(rows, F.lit(2909))
    assert len(got.collect()) == 2000
    assert n <= moved(spark) - before <= 2 * n + 100


@pytest.mark.parametrize("few", [0, 12, 128])
def test_arrays_and_cells_agree(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)
    r = np.random.default_rng(few + 1)
    points = [(i, int(x), int(y)) for i in range(30) for x, y in r.integers(0, 100 * (1 + i % 6), (1 + i, 2))]
    rows = spark.createDataFrame([(i, k, 10, x, y, 0, 0) for k, (i, x, y) in enumerate(points)], SCHEMA)

    def near(i, far):
        p = np.array([(x, y) for j, x, y in points if j == i], float)
        return (((p[:, None] - p[None]) ** 2).sum(2) <= far * far).sum(1)

    got = components.isolated(rows).collect()
    assert sorted((g.image_id, g.isolated) for g in got) == [(i, int((near(i, 60) == 1).sum())) for i in range(30)]
    got = components.clusters(rows, F.lit(1000)).collect()
    assert sorted((g.image_id, g.clustered) for g in got) == [(i, int(near(i, 55).max() >= 4)) for i in range(30)]


@pytest.mark.parametrize("few", [2, 128])
@pytest.mark.parametrize("name", ["components_isolated", "components_clusters"])
def test_components_without_a_place_equal_sql(spark, monkeypatch, tmp_path, name, few):
    """Null keys, images without any place, and several components without one in the same image."""
    monkeypatch.setattr(components, "FEW", few)
    r = np.random.default_rng(3)
    n = 400
    some = lambda values, share: [None if d < share else int(v) for v, d in zip(values, r.random(n))]
    image, part, supp = r.integers(0, 80, n), r.integers(0, 5000, n), r.integers(0, 900, n)
    columns = {
        "l_orderkey": pa.array(some(image, 0.03), pa.int64()),
        "l_partkey": pa.array([None if i < 6 else v for i, v in zip(image, some(part, 0.15))], pa.int64()),
        "l_suppkey": pa.array(some(supp, 0.15), pa.int64()),
        "l_linenumber": pa.array(range(n), pa.int32()),
        "l_quantity": pa.array([1.0] * n),
        "l_extendedprice": pa.array([1.0] * n),
    }
    pq.write_table(pa.table(columns), tmp_path / "lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    frame = registry.QUERIES[name](spark, str(tmp_path)).toPandas()
    want = con.execute(registry.SQL[name]).df()[list(frame.columns)]
    key = lambda f: sorted(map(tuple, f.itertuples(index=False)))
    assert len(frame) and key(frame) == key(want)
