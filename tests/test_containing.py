"""Names looked up in runs by their rarest piece."""

import random

from quartzite.operators import captions


def frames(spark, names, runs):
    return spark.createDataFrame([(n,) for n in names], "batch string"), spark.createDataFrame([(r, 1) for r in runs], "run string, batch int")


def test_equals_all_pairs(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abé%_") for _ in range(n))
    names = [None, "", "a", "ab", "zzz", *[word(r.randint(1, 6)) for _ in range(60)]] * 2
    runs = [None, "", *[word(r.randint(0, 25)) for _ in range(80)]]
    got = captions.last_containing(*frames(spark, names, runs)[:1], "batch", frames(spark, names, runs)[1], "run").collect()
    want = [(n, None if n is None else max((x for x in runs if x is not None and n in x), default=None)) for n in names]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_runs_or_names(spark):
    names, runs = frames(spark, ["a", ""], ["ba"])
    assert sorted(map(tuple, captions.last_containing(names, "batch", runs.filter("false"), "run").collect())) == [("", None), ("a", None)]
    assert captions.last_containing(names.filter("false"), "batch", runs, "run").count() == 0
