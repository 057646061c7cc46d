"""Live ingest with Structured Streaming: parse, window by count or time, keep the last samples, write in batches.

Samples arrive as text lines or rows. Count windows are a stateful operator per subject: the state is at most one
unfinished window, idle subjects are dropped after a timeout, and a whole window leaves as soon as its last sample is in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.config import Sampling
from pulsegrid.sources.readings import parse_lines

WINDOW_SCHEMA = "subject_id long, win long, n int, ir array<double>, red array<double>"
STATE_SCHEMA = "win long, ir array<double>, red array<double>"
#: Windows that leave the operator at once.
PART = 1024


def parse(stream: DataFrame, line: str = "value", exact: bool = True) -> DataFrame:
    """Text lines to ir and red; malformed ones are dropped."""
    return parse_lines(stream, line, exact)


def count_windows(stream: DataFrame, size: int | None = None, idle: str | None = None, stop_after: int | None = None) -> DataFrame:
    """Whole windows of ``size`` samples per subject, in arrival order (ties of a batch by seq).

    stream: subject_id, seq, ir, red. idle: minutes without samples (processing time) after which a subject's unfinished
    window is dropped. stop_after: samples of a subject after which no more windows are given. The state is less than a window;
    what a batch brings of a subject is cut in one pass, so bound the batch (maxFilesPerTrigger) where a backlog is to be drained.
    """
    size = size or Sampling().window
    minutes = int(idle) if idle else None

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        win, *held = state.get if state.exists else (0, [], [])
        got = pd.concat(list(parts)).sort_values("seq", kind="stable")
        ir, red = (np.concatenate([np.asarray(h, float), got[c].to_numpy(float, na_value=np.nan)]) for h, c in zip(held, ("ir", "red"), strict=True))
        whole = len(ir) // size
        state.update((win + whole, ir[whole * size :].tolist(), red[whole * size :].tolist()))
        if minutes:
            state.setTimeoutDuration(minutes * 60_000)
        given = whole if stop_after is None else max(0, min(whole, stop_after // size - win))
        for i in range(0, given, PART):  # a backlog leaves in parts
            k = np.arange(i, min(i + PART, given))
            cut = lambda x, k=k: list(x[k[0] * size : (k[-1] + 1) * size].reshape(-1, size))
            yield pd.DataFrame({"subject_id": key[0], "win": win + k, "n": size, "ir": cut(ir), "red": cut(red)})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if minutes else GroupStateTimeout.NoTimeout
    return stream.groupBy("subject_id").applyInPandasWithState(step, WINDOW_SCHEMA, STATE_SCHEMA, "append", timeout)


def time_windows(stream: DataFrame, length: str = "15 seconds", late: str = "30 seconds", event_time: str = "ts") -> DataFrame:
    """Tumbling windows of event time per subject; later rows than the watermark allows are dropped."""
    w = stream.withWatermark(event_time, late).groupBy("subject_id", F.window(event_time, length).alias("w"))
    out = w.agg(F.count("*").alias("n"), F.avg("ir").alias("mean_ir"), F.avg("red").alias("mean_red"))
    return out.select("subject_id", F.col("w.start").alias("start"), "n", "mean_ir", "mean_red")


def last_samples(stream: DataFrame, n: int) -> DataFrame:
    """The last ``n`` samples of each subject (subject_id, seq, ir, red) after every batch that brought some, as arrays.

    State and output hold n samples a subject, however long it sends; samples are in order of seq.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(dict(zip(("seq", "ir", "red"), state.get, strict=True))) if state.exists else None
        for part in parts:  # a batch may be long: only the last ones stay
            both = part[["seq", "ir", "red"]] if held is None else pd.concat([held, part[["seq", "ir", "red"]]])
            held = both.sort_values("seq", kind="stable").tail(n)
        kept = tuple(held[c].tolist() for c in ("seq", "ir", "red"))
        state.update(kept)
        yield pd.DataFrame([(key[0], *kept)], columns=["subject_id", "seq", "ir", "red"])

    kept = "seq array<long>, ir array<double>, red array<double>"
    return stream.groupBy("subject_id").applyInPandasWithState(step, f"subject_id long, {kept}", kept, "update", GroupStateTimeout.NoTimeout)


FLUSH_SCHEMA = "flush long, cause string, at long, seq long, ir double, red double"


class _Flush(StatefulProcessor):
    """Samples of a subject wait in list state until there are enough of them or the first has waited long enough."""

    def __init__(self, rows: int, milliseconds: int):
        self.rows, self.milliseconds = rows, milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffer = handle.getListState("buffer", "seq long, ir double, red double")
        self.facts = handle.getValueState("facts", "flush long, held long, timer long")

    def _left(self, key: tuple, samples: pd.DataFrame, flush: int, cause: str) -> pd.DataFrame:
        return pd.DataFrame({"subject_id": key[0], "flush": flush, "cause": cause, "at": np.arange(len(samples)), "seq": samples["seq"], "ir": samples["ir"], "red": samples["red"]})

    def _held(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.buffer.get()) if self.buffer.exists() else [], columns=["seq", "ir", "red"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        flush, held, timer = self.facts.get() if self.facts.exists() else (0, 0, 0)
        for part in rows:
            part = part.sort_values("seq", kind="stable")[["seq", "ir", "red"]]
            if held + len(part) < self.rows:  # the block is added as it is; nothing that waits is read or copied
                self.buffer.appendList([tuple(r) for r in part.itertuples(index=False)])
                held += len(part)
            else:
                both = pd.concat([self._held(), part], ignore_index=True) if held else part.reset_index(drop=True)
                whole = len(both) // self.rows
                for i in range(whole):
                    yield self._left(key, both.iloc[i * self.rows : (i + 1) * self.rows], flush + i, "rows")
                flush, rest = flush + whole, both.iloc[whole * self.rows :]
                held = len(rest)
                self.buffer.clear()
                if held:
                    self.buffer.put([tuple(r) for r in rest.itertuples(index=False)])
                if timer:
                    self.handle.deleteTimer(timer)
                    timer = 0
            if held and not timer:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.milliseconds
                self.handle.registerTimer(timer)
        self.facts.update((flush, held, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        flush, held, timer = self.facts.get() if self.facts.exists() else (0, 0, 0)
        if held and timer and timer <= expiredTimerInfo.getExpiryTimeInMs():
            yield self._left(key, self._held(), flush, "time")
            self.buffer.clear()
            self.facts.update((flush + 1, 0, 0))

    def close(self) -> None:
        pass


def flushed(stream: DataFrame, rows: int = 400, seconds: float = 1.0) -> DataFrame:
    """Samples (subject_id, seq, ir, red) in flushes of a subject: a flush leaves when it has ``rows`` samples, or ``seconds`` (processing time)
    after its first sample came, whichever is first. Columns: subject_id, flush (from 0), cause (rows or time), at (place in
    the flush), seq, ir, red. What still waits when a query has stopped is read with ``leftovers``.

    The buffer is list state of the RocksDB store, so start it inside ``rocksdb``.
    """
    kind = stream.schema["subject_id"].dataType.simpleString()
    return stream.select("subject_id", F.col("seq").cast("long").alias("seq"), F.col("ir").cast("double").alias("ir"), F.col("red").cast("double").alias("red")).groupBy("subject_id").transformWithStateInPandas(
        _Flush(rows, int(seconds * 1000)), f"subject_id {kind}, {FLUSH_SCHEMA}", "append", "processingTime"
    )


@contextmanager
def rocksdb(spark, draining: bool = False) -> Iterator[None]:
    """Queries started inside use the state store that list state and timers need. draining: they run no batch without data,
    so that availableNow ends and what waits stays for ``leftovers``; timers would else keep the query alive."""
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    settings |= {"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if draining else {}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def leftovers(spark, checkpoint: str) -> DataFrame:
    """What waited in ``flushed`` when its query stopped: subject_id, flush (the number it would have had), seq, ir, red."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    facts = read("facts").load().select("key.subject_id", "value.flush")
    return read("buffer").load().select("key.subject_id", "list_element.*").join(facts, "subject_id")


def stamped(stream: DataFrame, name: str = "arrived", started: datetime | None = None) -> DataFrame:
    """Arrival time of each row; with a start, the seconds since then."""
    now = F.current_timestamp()
    return stream.withColumn(name, now if started is None else (F.unix_micros(now) - F.unix_micros(F.lit(started))) / 1e6)


def write(df: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, name: str, every: str | None = "1 second", rows: int | None = None, mode: str = "append") -> DataStreamWriter:
    """A writer to a Parquet path or a function of (batch, epoch); ``every`` None drains what is there and stops.

    rows: a file of a Parquet sink is full after so many rows, so output is flushed by rows or by time, whichever is first.
    """
    w = df.writeStream.queryName(name).option("checkpointLocation", checkpoint).outputMode(mode)
    w = w.option("maxRecordsPerFile", rows) if rows else w
    w = w.trigger(availableNow=True) if every is None else w.trigger(processingTime=every)
    return w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)


def fan_out(consumers: list[Callable[[DataFrame, int], None]]) -> Callable[[DataFrame, int], None]:
    """One stream to many consumers: each gets the batch, which is computed once."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for c in consumers:
                c(batch, epoch)
        finally:
            batch.unpersist()

    return each


def start_session(writer: DataStreamWriter, spark, name: str) -> StreamingQuery:
    """Starts the query unless one of this name runs: one session a subject."""
    running = [q for q in spark.streams.active if q.name == name]
    return running[0] if running else writer.start()


def stop_session(spark, name: str) -> bool:
    for q in spark.streams.active:
        if q.name == name:
            q.stop()
            return True
    return False
