"""The verdict cache as keyed state: repeats, late files, restarts and expiry."""

from datetime import datetime, timedelta

from pyspark.sql import Row

from quartzite.sources.scratch import scratch_path
from quartzite.streaming import verdicts

T = datetime(2026, 1, 1)


def row(signature, item, days, passed=None):
    return (signature, item, T + timedelta(days=days), passed)


def run(spark, arrivals, known=(), **how):
    base = scratch_path(spark, "test-verdicts")
    table = spark.createDataFrame(list(known), verdicts.EVENTS)
    for a in arrivals:
        spark.createDataFrame(a, verdicts.EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        verdicts.answered_files(spark, f"{base}/in", table, f"{base}/out", f"{base}/checkpoint", **how)
    return sorted(((r.signature, r.item, r.verdict) for r in spark.read.schema(verdicts.ANSWERS).parquet(f"{base}/out").collect()), key=str)


def test_each_file_is_answered_once(spark):
    known = [row("a", None, 0, True), row("b", None, 0, False), row("b", None, -3, True)]
    first = [row("a", "a", 1), row("b", "b", 1), row("c", "c", 1), (None, "x", T, None), ("y", "y", None, None)]
    again = [row("a", "a", 2), row("c", "c", 2), row("d", None, 1.5), row("c", "c", 1)]
    scored = [row("c", "c", 2.5, False), row("c", "c", 3), row("a", "a", 3)]
    got = run(spark, [first, again, first, scored, scored], known)
    assert got == [("a", "a", "true"), ("b", "b", "false"), ("c", "c", "false"), ("c", "c", "to_score"), ("d", None, "to_score")]
    assert spark.conf.get(verdicts.PROVIDER, None) != verdicts.ROCKSDB


def test_late_files_and_expiry(spark):
    known = [row("old", None, -8, True), row("new", None, 0, True)]
    arrivals = [[row("new", "new", 6), row("old", "old", 0)], [row("new", "late", 1)], [row("new", "new-2", 8)], [row("tick", "tick", 60)], [row("tick", "tick", 61)], [row("new", "new", 62)]]
    got = run(spark, arrivals, known, keep_days=7, late="10 days")
    assert got == [("new", "late", "true"), ("new", "new", "to_score"), ("new", "new", "true"), ("new", "new-2", "to_score"), ("old", "old", "to_score"), ("tick", "tick", "to_score")]


class Counted:
    """A state that counts how often it is asked."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def get(self, name=""):
        self.calls += 1
        return self.held.get(name)

    def update(self, *value):
        self.calls += 1
        self.held[value[0] if len(value) > 1 else ""] = value[-1]

    getValue, updateValue = get, update  # noqa: N815


def test_a_new_file_takes_three_messages(spark):
    """One for the verdict, one for the answer given before, one for the new answer; rows come and go without a data frame."""
    cache = verdicts.VerdictCache(7)
    cache.verdict, cache.answered = Counted(), Counted()
    rows = [Row(signature="s", item="a", seen_at=T, passed=None)]
    assert [tuple(r) for r in cache.handleInputRows(("s",), iter(rows), None)] == [("s", "a", verdicts.instant(T), "to_score")]
    assert cache.verdict.calls + cache.answered.calls == 3
    assert list(cache.handleInputRows(("s",), iter(rows), None)) == []
