"""Joins of bucketed tables: no exchange, and the rows of a plain join on hot, null and missing keys."""

import re

import pytest

from quartzite.plans import cleaning
from quartzite.sources import scratch
from quartzite.sources.bucketed import bucketed, buckets_for, joined


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_of_buckets_need_no_exchange(spark, no_broadcast):
    got = cleaning.bucketed_files_masks(spark, "/root/testdata/sf0.001")
    text = plan(got)
    assert text.count("SortMergeJoin") == 2 and not re.search(r"(?<!Broadcast)Exchange", text)


def test_hot_null_and_missing_keys(spark, no_broadcast):
    left = spark.createDataFrame([(i % 7 if i % 3 else 1, None if i % 11 == 0 else "b", i) for i in range(300)] + [(None, "b", -1), (None, None, -2)], "a int, b string, v int")
    right = spark.createDataFrame([(1, "b", 10), (2, "b", 20), (5, "x", 50), (None, "b", 60)], "a int, b string, w int")
    sides = bucketed(left, "left", ["a", "b"], 8), bucketed(right, "right", ["a", "b"], 8, unique=True)
    assert sides[0].hot.count() >= 1 and sides[0].rows.filter("a = 1 and b = 'b'").count() == 0
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = joined(sides[0], [sides[1]], how)
        want = left.join(right, ["a", "b"], how)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        # Only rows apart meet by broadcasts of hot keys.
        assert not re.search(r"(?<!Broadcast)Exchange", plan(got))


def test_empty_tables_and_wrong_sides(spark):
    empty = bucketed(spark.createDataFrame([], "a int, v int"), "empty", ["a"], 8, unique=True)
    some = bucketed(spark.createDataFrame([(1, 2)], "a int, w int"), "some", ["a"], 8)
    assert [tuple(r) for r in joined(some, [empty]).collect()] == [(1, 2, None)] and joined(empty, [empty], "left_semi").count() == 0
    with pytest.raises(ValueError):
        bucketed(spark.createDataFrame([(1,), (1,)], "a int"), "twice", ["a"], 8, unique=True)
    with pytest.raises(ValueError):
        joined(empty, [some])
    assert buckets_for(1) == 8 and buckets_for(10**9) == 512


def test_clear_drops_tables(spark):
    table = bucketed(spark.createDataFrame([(1, 2)], "a int, v int"), "gone", ["a"], 8)
    name = scratch._tables[-1]
    assert spark.catalog.tableExists(name) and table.rows.count() + table.apart.count() == 1
    scratch.clear(spark)
    assert not spark.catalog.tableExists(name)
