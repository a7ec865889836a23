"""Window operators: best matches, fills, bursts, running ids and in-tile normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved
from .ranges import earlier, handed_on, ranged


def best_match(df: DataFrame, keys: list[str], distance: str, *order: Column) -> DataFrame:
    """The closest row of each key, the first in order among equals."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(distance, *order))).where("__n = 1").drop("__n")


def at_most(df: DataFrame, keys: list[str], k: int | None, *order: Column) -> DataFrame:
    """The first k rows of each key; all without a k."""
    if k is None:
        return df
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def forward_fill(df: DataFrame, columns: list[str], order: list[str], within: list[str] | None = None) -> DataFrame:
    """Blanks and nulls take the last value above them, inside ``within`` where given.

    Without ``within`` the fill runs over file order: last values of key ranges are found
    first and handed down, so no task holds the whole table.
    """
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    if within:
        over = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({c: F.last(blank(c), ignorenulls=True).over(over) for c in columns})
    own = ranged(df, [], *order)
    over = Window.partitionBy("__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = own.withColumns({c: F.last(blank(c), ignorenulls=True).over(over) for c in columns})
    ends = filled.groupBy("__p").agg(F.max(F.struct(*order, *columns)).alias("e"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    above = ends.select("__p", *[F.last(f"e.{c}", ignorenulls=True).over(before).alias(f"__{c}") for c in columns])
    return filled.join(above, "__p").select(*[F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def partial_runs(pulses: DataFrame, keys: list[str], order: list[str], swath: str, ts: str) -> DataFrame:
    """(keys, range, swath, run, goes_on, start_ts, stop_ts, n): the runs of one swath inside each range of a key's order.

    ``run`` counts along the key; ``goes_on`` marks the part of a run that began in an
    earlier range. Ranges hand on how often the swath turned in them and where they ended.
    """
    own = ranged(pulses, keys, *order)
    within = Window.partitionBy(*keys, "__p").orderBy(*order)
    turn = F.lag(F.struct(swath)).over(within).isNotNull() & ~F.lag(swath).over(within).eqNullSafe(F.col(swath))
    local = own.withColumn("__turn", turn.cast("int")).withColumn("__run", F.sum("__turn").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    parts = saved(local.groupBy(*keys, "__p", "__run", swath).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("stop_ts"), F.count("*").alias("n")), "run-parts")
    ends = parts.groupBy(*keys, "__p").agg(F.max("__run").alias("turns"), F.min_by(F.struct(swath), "__run").alias("first"), F.max_by(F.struct(swath), "__run").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("__p"))
    ends = ends.withColumn("joint", F.coalesce((~before.eqNullSafe(F.col("first"))).cast("int"), F.lit(1))).withColumn("begins", before.isNull())
    ends = ends.withColumn("joint", F.when(F.col("begins"), 0).otherwise(F.col("joint")))
    base = F.coalesce(F.sum(F.col("turns") + F.col("joint")).over(earlier(keys)), F.lit(0)) + F.col("joint")
    met = handed_on(parts, ends, keys, __base=base, __new=F.col("begins") | (F.col("joint") == 1))
    return met.select(*keys, "__p", swath, (F.col("__run") + F.col("__base")).alias("run"), ((F.col("__run") == 0) & ~F.col("__new")).alias("goes_on"), "start_ts", "stop_ts", "n")


def runs_of(pulses: DataFrame, keys: list[str], order: list[str], swath: str = "swath", ts: str = "ts") -> DataFrame:
    """Runs of one swath in order: (keys, swath, run, start_ts, stop_ts, n); run grows along a key. A key of any size is cut into ranges of its order."""
    parts = partial_runs(pulses, keys, order, swath, ts)
    return parts.groupBy(*keys, swath, "run").agg(F.min("start_ts").alias("start_ts"), F.max("stop_ts").alias("stop_ts"), F.sum("n").alias("n"))


def bursts(pulses: DataFrame, keys: list[str], order: list[str], swath: str = "swath", ts: str = "ts") -> DataFrame:
    """Runs of one swath: (keys, swath, burst, start_ts, stop_ts, n); bursts count from 1 per swath. A null swath is one."""
    parts = partial_runs(pulses, keys, order, swath, ts).withColumn("__begins", (~F.col("goes_on")).cast("int"))
    begun = parts.groupBy(*keys, swath, "__p").agg(F.sum("__begins").alias("begun"))
    own = handed_on(parts, begun, [*keys, swath], __before=F.coalesce(F.sum("begun").over(earlier([*keys, swath])), F.lit(0)))
    upto = F.sum("__begins").over(Window.partitionBy(*keys, swath, "__p").orderBy("run").rowsBetween(Window.unboundedPreceding, 0))
    numbered_parts = own.withColumn("burst", F.col("__before") + upto)
    return numbered_parts.groupBy(*keys, swath, "burst").agg(F.min("start_ts").alias("start_ts"), F.max("stop_ts").alias("stop_ts"), F.sum("n").alias("n"))


def numbered(df: DataFrame, keys: list[str], *order: Column, name: str = "n") -> DataFrame:
    """A running id from 1 inside each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def first_filled(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """A row a key with the first value of each column that is not blank."""
    value = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    return df.groupBy(*keys).agg(*[F.min_by(value(c), F.when(value(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def overlap_lines(bursts_: DataFrame, keys: list[str], ts: str, interval: float, lines: int) -> DataFrame:
    """Lines by which each burst overlaps the next: its length less the lines between their starts."""
    after = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts))
    return bursts_.withColumn("overlap", lines - F.rint((F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6 / interval))


def leading_run(series: Column, mark: int = -1) -> Column:
    """Number of leading ``mark`` values of an array."""
    first = F.array_position(F.transform(series, lambda x: x != mark), True)
    return F.when(first == 0, F.size(series)).otherwise((first - 1).cast("int"))


def percentile_scaled(df: DataFrame, keys: list[str], value: str, lo: float = 0.02, hi: float = 0.98, most: int | None = None) -> DataFrame:
    """log1p, clipped to two exact percentiles of the group and scaled to [0, 1] (``scaled``)."""
    from ..functions.columns import log_scaled

    from .aggregates import group_quantiles

    cuts = group_quantiles(df.select(*keys, F.log1p(value).alias("__v")), keys, "__v", most, __lo=lo, __hi=hi)
    return df.join(cuts, keys).withColumn("scaled", log_scaled(F.col(value), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")
