"""Repeated scrapes as a stream with state: for each url its content hash, attempts, and when it was first and last seen.

Defined cases: rows of one url in one trigger count in the order of their times, equal times by content; a row that isn't later than the last one
seen of its url repeats it (or is late within the watermark) and changes nothing; rows behind the watermark are dropped by the engine; a url that
wasn't seen for `gone_after` is reported as removed when the watermark passes that moment, or when its next row shows it, and starts anew; a null
content is a content; rows without url or time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType([T.StructField("content", T.StringType()), T.StructField("attempts", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType())])


def _micros(t: datetime) -> int:
    t = t if t.tzinfo else t.astimezone(timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


class Visits(StatefulProcessor):
    """Rows (url, content, micros) to rows (url, change, content, attempts, first, last) of times in microseconds."""

    def __init__(self, gone_after: int):
        self.gone_after = gone_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("visits", _STATE)

    def _row(self, key, change: str, state: tuple) -> Row:
        return Row(url=key[0], change=change, content=state[0], attempts=state[1], first=state[2], last=state[3])

    def _due(self, last: int) -> int:
        return -(-(last + self.gone_after) // 1000)  # a timer's time is in milliseconds

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.held.get()) if self.held.exists() else None
        state = before
        for at, _, content in sorted((r["micros"], r["content"] or "", r["content"]) for r in rows):
            if state is not None and at <= state[3]:
                continue
            if state is not None and at > state[3] + self.gone_after:
                yield self._row(key, "removed", state)
                state = None
            if state is None:
                state = (content, 1, at, at)
                yield self._row(key, "new", state)
            else:
                change = "unchanged" if state[0] == content else "updated"
                state = (content, state[1] + 1, state[2], at)
                yield self._row(key, change, state)
        if state is not None and state != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before[3]))
            self.held.update(state)
            self.handle.registerTimer(self._due(state[3]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.held.exists():
            state = tuple(self.held.get())
            self.held.clear()
            yield self._row(key, "removed", state)

    def close(self) -> None:
        pass


def visits(stream: DataFrame, url: str, content: str, ts: str, gone_after: timedelta = timedelta(days=1), late: str = "10 minutes") -> DataFrame:
    """url, change (new, updated, unchanged, removed), content, attempts, first_seen, last_seen: a row for each visit and each removal."""
    moment = F.col(ts).cast("timestamp")
    rows = stream.select(F.col(url).cast("string").alias("url"), F.col(content).cast("string").alias("content"), F.unix_micros(moment).alias("micros"), moment.alias("_at"))
    rows = rows.withWatermark("_at", late).where("url IS NOT NULL AND _at IS NOT NULL")
    out = T.StructType([T.StructField("url", T.StringType()), T.StructField("change", T.StringType()), *_STATE.fields])
    done = rows.groupBy("url").transformWithState(Visits(gone_after // timedelta(microseconds=1)), out, "Append", "EventTime")
    return done.select("url", "change", "content", "attempts", F.timestamp_micros("first").alias("first_seen"), F.timestamp_micros("last").alias("last_seen"))


def run(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Appends what has arrived to the table `out`; a restart with the same checkpoint goes on behind it. State is kept by RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def replay(df: DataFrame, ts: str, folder: str, pieces: int = 2, rows_per_file: int = 10_000) -> DataFrame:
    """A table as a stream of pieces, one a trigger, in the order of time. Pieces have equally many files, as many as the smallest fills (the last
    piece's may be fewer), at most as many as there are cores, so that none is one task's."""
    spark = df.sparkSession
    moment = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(moment), F.max(moment)).first()
    low, high = low or 0, high or 0
    cuts = [low + (high - low) * i // pieces for i in range(pieces + 1)]
    parts = [moment.isNull() | (moment <= cuts[1]), *((moment > a) & (moment <= b) for a, b in zip(cuts[1:-1], cuts[2:], strict=True))]  # a handful of triggers
    sizes = df.agg(*[F.coalesce(F.sum(p.cast("int")), F.lit(0)) for p in parts]).first()
    files = max(1, min(min(sizes) // rows_per_file, spark.sparkContext.defaultParallelism))
    for part in parts:
        held = df.where(part)
        (held.repartition(files) if files > 1 else held.coalesce(1)).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(folder)
