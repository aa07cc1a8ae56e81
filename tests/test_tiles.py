"""Tiles round as their SQL does, on components where single and double precision part."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from quartzite.plans import registry, visual  # noqa: F401
from quartzite.sources import adapters


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """Vectors whose components lie around the borders of values."""
    at = np.float32(np.arange(70, 198) / 127.5 - 1)
    near = np.unique(np.concatenate([np.nextafter(at, np.float32(-2)), at, np.nextafter(at, np.float32(2))]))
    single, double = (np.floor((near.astype(t) + t(1)) * t(127.5)) for t in (np.float32, np.float64))
    parting = near[single != double]
    assert len(parting) > 10 and (single[single != double] == 118).any()  # one across the mask's border too
    r = np.random.default_rng(0)
    rows = [r.permutation(np.concatenate([r.choice(parting, 40), r.choice(near, 24)])).astype(np.float32) for _ in range(40)]
    folder = tmp_path_factory.mktemp("edges")
    pq.write_table(pa.table({"vec_id": pa.array(range(40), pa.int64()), "embedding": pa.array([v.tolist() for v in rows], pa.list_(pa.float32())), "label": pa.array([0] * 40, pa.int32())}), os.path.join(folder, "embeddings.parquet"))
    return str(folder)


def equal(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    frame = registry.QUERIES[name](spark, folder).toPandas()
    want = con.execute(registry.SQL[name]).df()[list(frame.columns)]
    key = lambda f: sorted(map(tuple, f.itertuples(index=False)))
    assert len(frame) and key(frame) == key(want)


def test_tiles_view(spark, edges):
    got = {(r.image_id, r.y, r.x): r.v for r in adapters.load(spark, edges, "tiles").collect()}
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{edges}/embeddings.parquet'")
    assert got == {r[:3]: r[3] for r in con.execute(f"with {adapters.cte('tiles')} select image_id, y, x, v from tiles").fetchall()}


@pytest.mark.parametrize("name", ["mask_iou", "otsu_threshold", "winsorize"])
def test_pixel_tables_equal_sql(spark, edges, name):
    equal(spark, edges, name)


@pytest.mark.parametrize("name", ["image_pixels_hist", "scan_images"])
def test_images_equal_sql(spark, edges, name):
    equal(spark, edges, name)


TIED = [
    "6478777a776464646464646464767676646478647964797878787776787a767a6464767764647776647676647676767664647879647a647a6476766476647664",
    "76647678647678787878777777776478647878766464767876767676767676647664766464766476646464646464767776767676767664767764777777647864",
    "76646477646476777676646464767676647664647864787864647664766476767664647676767676786477767664777676767676647676766476777878767778",
]


def test_banding_equals_sql_at_ties(spark, tmp_path):
    """Lines whose variance is 0.15 or 6 times the median one, or off by a last bit."""
    rows = [((np.frombuffer(bytes.fromhex(t), np.uint8) + 0.5) / 127.5 - 1).astype(np.float32).tolist() for t in TIED]
    pq.write_table(pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())}), tmp_path / "embeddings.parquet")
    equal(spark, str(tmp_path), "banding_score")
