"""Structured Streaming jobs: resumable stage processing and online burst segmentation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import range_ranked
from ..operators.windows import runs_of
from ..plans.storage import saved


def run_stage(spark: SparkSession, source: str, schema: str, checkpoint: str, status: str, stage: Callable[[DataFrame], DataFrame]) -> None:
    """Process what is new in a folder of scene rows and append to a status table.

    ``stage`` maps new rows to (scene, status, reason). The checkpoint remembers which files
    were read, so a second run only sees files added since; a batch that is repeated after a
    failure replaces its own part of the table, as each batch has a folder of its own. A
    failed scene does not stop the others.
    """

    def merge(batch: DataFrame, number: int) -> None:
        stage(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{status}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


STATE = "stream bigint, swath string, bursts bigint, open boolean, start_us bigint, stop_us bigint, n bigint"


def segment(fresh: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(burst updates, next state, late pulses) of new pulses (stream, seq, swath, ts_us).

    state: a row for each stream and swath with its number of bursts so far; that of the
    swath on which the stream stands is open and has the last burst. Pulses are cut into
    runs by ranges of time, however many a stream has; a first run of the open swath goes on
    with its burst. Pulses before the end of the open burst come too late: they are handed
    back and change nothing, as bursts that were told already would have to be cut again.
    """
    at = state.where("open").select("stream", F.col("swath").alias("__swath"), F.col("start_us").alias("__start"), F.col("stop_us").alias("__stop"), F.col("n").alias("__n"))
    placed = saved(fresh.join(at.select("stream", "__stop"), "stream", "left"), "burst-pulses")
    late = F.coalesce(F.col("ts_us") < F.col("__stop"), F.lit(False))
    runs = saved(runs_of(placed.where(~late).drop("__stop"), ["stream"], ["ts_us", "seq"], ts="ts_us"), "burst-runs")
    told = range_ranked(runs, ["stream", "swath"], "run").join(state.select("stream", "swath", "bursts"), ["stream", "swath"], "left").join(at, "stream", "left")
    first = runs.groupBy("stream").agg(F.min_by("swath", "run").alias("__first"))
    told = told.join(first, "stream", "left")
    goes_on = F.coalesce(F.col("__swath") == F.col("__first"), F.lit(False)) & (F.col("swath") == F.col("__swath"))
    same = goes_on & (F.col("rn") == 1)
    told = told.select("stream", "swath", "run", (F.coalesce("bursts", F.lit(0)) + F.col("rn") - goes_on.cast("int")).alias("burst"), F.when(same, F.col("__start")).otherwise(F.col("start_ts")).alias("start_us"), F.col("stop_ts").alias("stop_us"), (F.col("n") + F.when(same, F.col("__n")).otherwise(0)).alias("n"))
    told = saved(told, "burst-updates")
    ends = told.groupBy("stream").agg(F.max_by(F.struct("swath", "start_us", "stop_us", "n"), "run").alias("e"))
    counts = told.groupBy("stream", "swath").agg(F.max("burst").alias("more"))
    known = state.join(counts, ["stream", "swath"], "full").join(ends, "stream", "left")
    moved = F.col("e").isNotNull()
    now = F.when(moved, F.col("swath") == F.col("e.swath")).otherwise(F.col("open"))
    after = known.select("stream", "swath", F.coalesce("more", "bursts").alias("bursts"), now.alias("open"), *[F.when(moved, F.when(now, F.col(f"e.{c}"))).otherwise(F.col(c)).alias(c) for c in ("start_us", "stop_us", "n")])
    return told.drop("run"), after, placed.where(late).drop("__stop")


def run_bursts(spark: SparkSession, source: str, schema: str, checkpoint: str, sink: str) -> None:
    """One run over what is new in ``source``: burst updates, late pulses and the state after each batch go to folders of ``sink``.

    A batch reads the state of the batch before it and has folders of its own, so a batch
    that is repeated after a failure gives the same again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        state = own.read.schema(STATE).parquet(f"{sink}/state/batch={number - 1}") if number else own.createDataFrame([], STATE)
        updates, after, late = segment(batch.select("stream", "seq", "swath", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us")), state)
        for name, rows in (("updates", updates), ("state", after), ("late", late)):
            rows.write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_bursts(updates: DataFrame) -> DataFrame:
    """The last update of each burst: a later one has more pulses."""
    return updates.groupBy("stream", "swath", "burst").agg(F.max_by(F.struct("start_us", "stop_us", "n"), "n").alias("b")).select("stream", "swath", F.col("burst").cast("int").alias("burst"), "b.*")
