"""Burst segmentation with keyed state: each stream of pulses carries its own, and nothing is rewritten between batches.

A stream holds the burst that is open, its number of bursts for each swath, and the pulses
that may still be overtaken: those less than ``delay`` behind its latest one. Older pulses
are cut into runs in order of (time, sequence); a burst is told once, when the next one
begins. A pulse that comes behind what was cut already is told as late and changes nothing.
A stream ends with an end mark (column ``ends``), or after ``idle_ms`` without pulses: a timer
then tells what waits and closes the open burst. State is one burst, a number a swath and
the pulses of ``delay``, however many batches there were; a batch sorts what it has of a
stream, so files a trigger bound its memory.

Edge cases: a null stream is a stream, a null swath a swath; pulses without a time are late.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "stream bigint, swath string, burst int, start_us bigint, stop_us bigint, n bigint, late boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# the process that plans a stateful query does not see files handed to executors, so the class travels by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def in_order(fresh: pd.DataFrame | None, waiting: list[tuple]) -> pd.DataFrame:
    """Pulses (ts_us, seq, swath) by time, sequence and swath; those without a swath have None."""
    parts = [pd.DataFrame(waiting, columns=["ts_us", "seq", "swath"])] if waiting or fresh is None else []
    parts += [fresh[["ts_us", "seq", "swath"]]] if fresh is not None else []
    own = pd.concat([p.astype({"ts_us": "int64", "seq": "int64", "swath": object}) for p in parts], ignore_index=True)
    own["swath"] = own["swath"].where(own["swath"].notna(), None)
    swaths = pd.factorize(own["swath"], sort=True)[0]
    return own.iloc[np.lexsort((swaths, own["seq"], own["ts_us"]))].reset_index(drop=True)


def runs_of(pulses: pd.DataFrame) -> Iterator[tuple]:
    """(swath, first time, last time, pulses) of neighbours of one swath."""
    if not len(pulses):
        return
    codes, ts = pd.factorize(pulses["swath"], use_na_sentinel=True)[0], pulses["ts_us"].to_numpy()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    last = np.append(first[1:], len(codes)) - 1
    yield from zip(pulses["swath"].iloc[first].tolist(), ts[first].tolist(), ts[last].tolist(), (last - first + 1).tolist())


class BurstProcessor(StatefulProcessor):
    def __init__(self, delay_us: int, idle_ms: int | None):
        self.delay_us, self.idle_ms = delay_us, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "swath string, burst int, start_us long, stop_us long, n long")
        self.cut = handle.getValueState("cut", "until_us long")  # what is older has been cut into runs
        self.bursts = handle.getMapState("bursts", "swath string", "n int")
        self.waiting = handle.getListState("waiting", "ts_us long, seq long, swath string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        ended = bool(fresh["ends"].any())
        fresh = fresh[~fresh["ends"]]
        until = self.cut.get()[0] if self.cut.exists() else None
        late = fresh["ts_us"].isna() | (fresh["ts_us"] < until if until is not None else False)
        told = [(r.swath, None, None if pd.isna(r.ts_us) else int(r.ts_us), None if pd.isna(r.ts_us) else int(r.ts_us), 1, True) for r in fresh[late].itertuples()]
        held = in_order(fresh[~late], [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else [])
        if len(held):
            until = max(int(held["ts_us"].iloc[-1]) - self.delay_us, until if until is not None else -(2**62))
            ready = len(held) if ended else int(held["ts_us"].searchsorted(until, "left"))
            told += self.cut_runs(held.iloc[:ready])
        if ended:
            told += self.end_burst()
            until, held = None, held.iloc[:0]
        self.keep(held.iloc[int(held["ts_us"].searchsorted(until, "left")) :] if len(held) else held, until)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self.rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = self.cut_runs(in_order(None, [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []))
        until = self.open.get()[3] + 1 if self.open.exists() else None  # what comes from now on begins a burst of its own
        told += self.end_burst()
        self.keep(in_order(None, []), until if until is not None else self.cut.get()[0] if self.cut.exists() else None)
        yield self.rows(key, told)

    def cut_runs(self, pulses: pd.DataFrame) -> list[tuple]:
        """Pulses in order go on with the open burst or close it; closed bursts are handed back. Only runs of one swath are looked at one by one."""
        told = []
        burst = list(self.open.get()) if self.open.exists() else None
        numbers: dict = {}
        for swath, start, stop, n in runs_of(pulses):
            if burst and burst[0] == swath:
                burst[3], burst[4] = stop, burst[4] + n
                continue
            told += [(*burst, False)] if burst else []
            name = swath or ""
            if name not in numbers:
                numbers[name] = self.bursts.getValue((name,))[0] if self.bursts.containsKey((name,)) else 0
            numbers[name] += 1
            burst = [swath, numbers[name], start, stop, n]
        for name, number in numbers.items():
            self.bursts.updateValue((name,), (number,))
        if burst:
            self.open.update(tuple(burst))
        return told

    def end_burst(self) -> list[tuple]:
        if not self.open.exists():
            return []
        burst = self.open.get()
        self.open.clear()
        return [(*burst, False)]

    def keep(self, held: pd.DataFrame, until: int | None) -> None:
        self.waiting.clear()
        if len(held):
            self.waiting.put(list(zip(held["ts_us"].tolist(), held["seq"].tolist(), held["swath"].tolist())))
        if until is None:
            self.cut.clear()
        else:
            self.cut.update((until,))

    def rows(self, key, told: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(told, columns=["swath", "burst", "start_us", "stop_us", "n", "late"])
        frame.insert(0, "stream", key[0])
        return frame.astype({"stream": "Int64", "burst": "Int32", "start_us": "Int64", "stop_us": "Int64", "n": "Int64", "late": bool})


def keyed_bursts(pulses: DataFrame, delay_us: int = 0, idle_ms: int | None = None) -> DataFrame:
    """Bursts and late pulses of a streaming table (stream, seq, swath, ts_us, ends)."""
    mode = "none" if idle_ms is None else "processingTime"
    return pulses.groupBy("stream").transformWithStateInPandas(statefulProcessor=BurstProcessor(delay_us, idle_ms), outputStructType=OUT, outputMode="append", timeMode=mode)


def start_keyed_bursts(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str, delay_us: int = 0, idle_ms: int | None = None, files: int = 1000) -> StreamingQuery:
    """A query that appends the bursts of ``source`` (stream, seq, swath, ts, and ends where it has end marks) to ``sink``.

    Without ``idle_ms`` it ends with what is there, and the next start goes on from the
    checkpoint; with it, it runs on, as timers need a query that runs.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)  # the only one that keeps this kind of state; a query has its own copy of the settings
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        ends = F.coalesce("ends", F.lit(False)) if "ends" in stream.columns else F.lit(False)
        pulses = stream.select(F.col("stream").cast("bigint").alias("stream"), F.col("seq").cast("bigint").alias("seq"), "swath", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), ends.alias("ends"))
        writer = keyed_bursts(pulses, delay_us, idle_ms).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if idle_ms is None else writer.trigger(processingTime="1 second")).start()
    finally:
        spark.conf.set(key, before)
