"""Every registered query that SQL can state, against DuckDB on the driver's smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quartzite.plans import captions, cleaning, comparison, grading, populations, registry, visual  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, bool):
        return v
    return float(f"{v:.9g}") if isinstance(v, float) else v


def rows(frame):
    names = sorted(frame.columns)
    got = [tuple(map(plain, r)) for r in frame[names].astype(object).itertuples(index=False)]
    return names, sorted(got, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = rows(registry.QUERIES[name](spark, SF).toPandas()), rows(duck.execute(registry.SQL[name]).df())
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns[0] == "run_name"
