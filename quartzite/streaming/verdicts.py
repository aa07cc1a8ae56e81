"""A verdict cache as keyed state of a stream.

Files come as (signature, item, seen_at): a signature stands for one state of a file (its path, time and size), so a
changed file is another key. For each signature the stream remembers the verdict, when it was given, and which items have been answered.
A file whose verdict is known is answered from the state; one without is sent to be scored, once; what comes again,
in a repeated file, a replayed batch or a restart from the checkpoint, is not answered again. Verdicts that other jobs gave before are the
state's first content, and later ones come down the same stream as rows with `passed`.

A verdict lives `keep_days` by the time of the events, not of the machine: a timer of its key clears it when the watermark
passes its end, and a file seen past its end is sent to be scored even before that. Rows later than the watermark are
dropped by Spark, so `late` must cover how late files may come.

Nulls: rows with a null signature or seen_at have no key or time and are left out; a null item is an item of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "signature string, item string, seen_at timestamp, passed boolean"
ANSWERS = "signature string, item string, seen_at timestamp, verdict string"
TO_SCORE = "to_score"


def instant(t: datetime) -> datetime:
    """Rows bring times with a zone, the state gives them back in local time without one."""
    return t.astimezone(timezone.utc)


class VerdictCache(StatefulProcessor):
    """Answers each (signature, item) once: 'true', 'false' or TO_SCORE."""

    def __init__(self, keep_days: float):
        self.keep = timedelta(days=keep_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.verdict = handle.getValueState("verdict", "passed boolean, given timestamp")
        self.answered = handle.getMapState("answered", "item string", "verdict string")

    def known(self) -> tuple | None:
        held = self.verdict.get()
        return None if held is None else (held[0], instant(held[1]))

    def remember(self, held: tuple | None, passed: bool, given: datetime) -> tuple:
        """What is held after a verdict: the latest counts; a repeated or older one changes nothing."""
        if held is not None and held[1] >= given:
            return held
        self.verdict.update((bool(passed), given))
        self.handle.registerTimer(int((given + self.keep).timestamp() * 1000))
        return bool(passed), given

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.remember(self.known(), initialState["passed"], instant(initialState["seen_at"]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # A batch's rows come in any order: those of one key are taken by time, verdicts before files of the same time.
        # The state is asked once for the key's verdict and once per file: each question is a message to the JVM.
        here = sorted(rows, key=lambda r: (r["seen_at"], r["passed"] is None))
        held = self.known()
        for r in here:
            item, at, passed = r["item"], instant(r["seen_at"]), r["passed"]
            if passed is not None:
                held = self.remember(held, passed, at)
                continue
            verdict = str(held[0]).lower() if held is not None and at < held[1] + self.keep else TO_SCORE
            name = (f"={item}" if item is not None else "",)
            before = self.answered.getValue(name)
            if before is None or (before[0] == TO_SCORE and verdict != TO_SCORE):  # first, or scored since
                self.answered.updateValue(name, (verdict,))
                yield Row(signature=key[0], item=item, seen_at=at, verdict=verdict)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The end of a verdict, unless a later one has come since; its file may then be sent to be scored again."""
        end, held = expiredTimerInfo.getExpiryTimeInMs(), self.known()
        if held is not None and int((held[1] + self.keep).timestamp() * 1000) <= end:
            self.verdict.clear()
            self.answered.clear()
        return iter(())

    def close(self) -> None:
        pass


def answers(events: DataFrame, known: DataFrame | None = None, keep_days: float = 7.0, late: str = "30 days") -> DataFrame:
    """events: a stream of EVENTS (passed null: a file; else a verdict). known: a batch table of verdicts of the same shape,
    the state's first content. Returns a stream of ANSWERS; it needs the RocksDB state store."""
    keyed = events.select("signature", "item", F.col("seen_at").cast("timestamp").alias("seen_at"), "passed").filter("signature is not null and seen_at is not null").withWatermark("seen_at", late)
    first = None
    if known is not None:
        first = known.filter("signature is not null and seen_at is not null and passed is not null").select("signature", F.col("seen_at").cast("timestamp").alias("seen_at"), "passed").groupBy("signature")
    return keyed.groupBy("signature").transformWithState(VerdictCache(keep_days), ANSWERS, "Append", "EventTime", first)


def answered_files(spark, source: str, known: DataFrame | None, out: str, checkpoint: str, **how) -> None:
    """Take what is new under `source` (Parquet of EVENTS) and append its answers to `out`, once, however often it is started.
    The session's state store is put back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        files = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(source)
        query = answers(files, known, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
