"""Structured Streaming forms of the epoch, bucket, session and button operators.

Stateless and windowed forms are plain DataFrame code and scale like their batch
twins.  The two sequential ones keep a few values per device in keyed state; a
micro-batch (bounded by the source's rate limits) is all a key ever hands over
at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.eventlog import LONG
from ..session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def incoming_files(spark: SparkSession, folder: str, schema: T.StructType, *, pattern: str = "*.parquet", per_trigger: int | None = 100) -> DataFrame:
    """New files of a folder, each picked up once; a backlog is worked off in batches of ``per_trigger`` files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def run_available(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Process what is there and return the result as a table; a given ``folder`` resumes where it stopped.

    Progress, state and output lie in the shared checkpoint folder, so a lost
    executor or a restart loses nothing.
    """
    spark = stream.sparkSession
    root = folder or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    started = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def latest_view(stream: DataFrame, keys: Sequence[str], at: str, value: str, *, length: str = "31 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """The last stretch of samples, renewed every slide."""
    rows = stream.withWatermark(at, late).groupBy(*keys, F.window(at, length, slide).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(at).alias("newest")).select(*keys, F.col("w.start").alias("from_at"), F.col("w.end").alias("to_at"), "n", "mean_value", "newest")


def online_epochs(stream: DataFrame, keys: Sequence[str], at: str, value: str, *, length: str = "30 seconds", late: str = "10 seconds", offset: str = "0 seconds") -> DataFrame:
    """Tumbling epochs, emitted once complete; rows later than the watermark are dropped."""
    rows = stream.withWatermark(at, late).groupBy(*keys, F.window(at, length, length, offset).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value")).select(*keys, F.col("w.start").alias("at"), "n", "mean_value", "std_value")


def online_medians(stream: DataFrame, keys: Sequence[str], at: str, value: str, *, length: str = "30 seconds", late: str = "10 seconds", offset: str = "0 seconds", accuracy: int = 10_000) -> DataFrame:
    """Approximate bucket medians: the state is a bounded sketch, its rank error at most 1 / ``accuracy``; up to ``accuracy`` values it is a value of middle rank."""
    rows = stream.withWatermark(at, late).groupBy(*keys, F.window(at, length, length, offset).alias("w"))
    return rows.agg(F.percentile_approx(value, 0.5, accuracy).alias("median")).select(*keys, F.col("w.start").alias("at"), "median")


def online_bouts(stream: DataFrame, keys: Sequence[str], at: str, gap: str, *, late: str = "10 seconds") -> DataFrame:
    """Groups of events no further than the gap apart."""
    rows = stream.withWatermark(at, late).groupBy(*keys, F.session_window(at, gap).alias("w"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at")).drop("w")


def without_repeats(stream: DataFrame, columns: Sequence[str], at: str, *, late: str = "10 seconds") -> DataFrame:
    """The first of events that agree in the columns within the watermark delay."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(columns))


def enriched_epochs(epochs: DataFrame, events: DataFrame, keys: Sequence[str], epoch_at: str, event_at: str, length: str, *, late: str = "10 seconds") -> DataFrame:
    """Each live epoch with the live events inside it (closed); state is kept only as long as a match is possible."""
    left = epochs.withWatermark(epoch_at, late).alias("l")
    right = events.withWatermark(event_at, late).alias("r")
    on = F.expr(f"r.{event_at} >= l.{epoch_at} AND r.{event_at} <= l.{epoch_at} + INTERVAL {length}")
    for k in keys:
        on = on & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.join(right, on, "inner")


class _CounterFilter(StatefulProcessor):
    def __init__(self, arrival: str, counter: str, modulus: int, columns: list[str]):
        self.arrival, self.counter, self.modulus, self.columns = arrival, counter, modulus, columns

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", T.StructType([T.StructField("counter", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.arrival)
        state = self.kept.get()[0] if self.kept.exists() else None
        keep = []
        for c in batch[self.counter]:
            ok = state is None or int(c) == (state + 1) % self.modulus
            keep.append(ok)
            state = int(c) if ok else state
        self.kept.update((state,))
        yield batch.loc[keep, self.columns]

    def close(self) -> None:
        pass


def online_counter_filter(stream: DataFrame, keys: Sequence[str], arrival: str, counter: str, *, modulus: int = 256) -> DataFrame:
    """Rows whose wrapping counter follows the last kept one; the last kept counter is the state."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_CounterFilter(arrival, counter, modulus, stream.columns), outputStructType=stream.schema, outputMode="Append", timeMode="None")


_PRESSES = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event", T.StringType()), T.StructField("us", T.LongType())])
_LAST = T.StructType([T.StructField("us", T.LongType())])
BUTTON_SCHEMA = T.StructType([
    T.StructField("device", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("event", T.StringType()),
    T.StructField("us", T.LongType()), T.StructField("since", T.LongType())])


class _Buttons(StatefulProcessor):
    """Short presses wait until no long press can follow; long presses get their start from the event before."""

    def __init__(self, within: int, reach: int):
        self.within, self.reach = within, reach

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _PRESSES)
        self.last = handle.getValueState("last", _LAST)

    def _due(self, press) -> int:
        return (press[2] + self.within) // 1000 + 1

    def _wake(self, waiting) -> None:
        """One timer, for the press that is due first; it sets the next. A timer per press would read the whole list for each."""
        if waiting:
            self.handle.registerTimer(min(map(self._due, waiting)))

    def _rows(self, key, rows) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=[f.name for f in BUTTON_SCHEMA]).astype({"since": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "event_id"])
        waiting = [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for event_id, event, us in zip(batch["event_id"], batch["event"], batch["us"]):
            if event.endswith(LONG):
                base = event.removesuffix(LONG)
                waiting = [p for p in waiting if not (p[1] == base and us - p[2] <= self.within)]
                since = us - self.reach if last is None else max(last, us - self.reach)
                out.append((int(event_id), event, int(us), int(since)))
            else:
                waiting.append((int(event_id), event, int(us)))
            last = int(us)
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        out += [(*p, None) for p in waiting if p[2] + self.within <= watermark]
        waiting = [p for p in waiting if p[2] + self.within > watermark]
        self.waiting.put(waiting) if waiting else self.waiting.clear()
        self._wake(waiting)
        self.last.update((last,))
        if out:
            yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, not only the press that this timer is for
        due = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        waiting = [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []
        out = [(*p, None) for p in waiting if self._due(p) <= due]
        rest = [p for p in waiting if self._due(p) > due]
        self.waiting.put(rest) if rest else self.waiting.clear()
        self._wake(rest)
        if out:
            yield self._rows(key, out)

    def close(self) -> None:
        pass


def online_buttons(stream: DataFrame, device: str, at: str, *, within: int = 2_000_000, reach: int = 300_000_000, late: str = "10 seconds") -> DataFrame:
    """De-bounced presses with the start of long ones (``event_id``, ``event``, ``us`` and the watermark column ``at`` are read)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withWatermark(at, late)
    return rows.groupBy(device).transformWithStateInPandas(statefulProcessor=_Buttons(within, reach), outputStructType=BUTTON_SCHEMA, outputMode="Append", timeMode="EventTime")
