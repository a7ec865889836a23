"""Raw-geometry expressions, calibration and normalisation of pixel values, and chains of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Sampling-rate ratio of each swath against the first, raw block heights.
RATIOS = {1: 1.0, 2: 1.178571429, 3: 1.371428571}
HEIGHTS = {1: 1160, 2: 1290, 3: 1170}


def ratio(swath: Column) -> Column:
    return F.create_map(*[F.lit(v) for p in RATIOS.items() for v in p])[swath]


def raw_sample(sample: Column, swath: Column) -> Column:
    return F.floor(sample * ratio(swath))


def raw_line(line: Column, swath: Column, slope: float = 1.0001, shift: float = 0.25) -> Column:
    """Line of the raw product by a first-degree model."""
    return F.floor(line * slope + shift * swath)


def block_size(spark: SparkSession, size: int = 512, pulse: int = 2048) -> DataFrame:
    """(swath, width, height) of the raw block behind a block of ``size``: three rows."""
    import math

    return spark.createDataFrame([(s, math.ceil(size * r) + pulse, HEIGHTS[s]) for s, r in RATIOS.items()], "swath int, width bigint, height int")


def bilinear(points: DataFrame, grid: DataFrame, dx: int, dy: int) -> DataFrame:
    """Points (.., x0, y0) with the value of a regular grid (gx, gy, value) between their four nodes."""
    gx, gy = F.floor(F.col("x0") / dx) * dx, F.floor(F.col("y0") / dy) * dy
    own = points.withColumn("bx", gx).withColumn("by", gy).withColumn("fx", (F.col("x0") - gx) / dx).withColumn("fy", (F.col("y0") - gy) / dy)
    nodes = own.withColumn("k", F.explode(F.expr("array(struct(0 as a,0 as b),struct(1 as a,0 as b),struct(0 as a,1 as b),struct(1 as a,1 as b))")))
    nodes = nodes.withColumn("gx", F.col("bx") + F.col("k.a") * dx).withColumn("gy", F.col("by") + F.col("k.b") * dy)
    weight = F.when(F.col("k.a") == 1, F.col("fx")).otherwise(1 - F.col("fx")) * F.when(F.col("k.b") == 1, F.col("fy")).otherwise(1 - F.col("fy"))
    return nodes.join(grid, ["gx", "gy"]).groupBy(*points.columns).agg(F.sum(weight * F.col("value")).alias("value"))


def rms_normalise(df: DataFrame, keys: list[str], value: str, eps: float = 1e-8) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("__rms"))
    return df.join(stats, keys).withColumn(value, F.col(value) / F.greatest("__rms", F.lit(eps))).drop("__rms")


def zscore(df: DataFrame, keys: list[str], value: str, floor: float = 1e-6) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__d"))
    return df.join(stats, keys).withColumn(value, (F.col(value) - F.col("__m")) / F.greatest("__d", F.lit(floor))).drop("__m", "__d")


def log_clip(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    from .columns import log_scaled

    return df.withColumn(value, log_scaled(F.col(value), F.lit(lo), F.lit(hi)))


STEPS: dict[str, Callable[..., DataFrame]] = {"rms": rms_normalise, "zscore": zscore, "log_clip": log_clip}


def chain(steps: list[dict]) -> Callable[[DataFrame], DataFrame]:
    """One transform from a configuration: [{name, parameters...}, ...], in order."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            own = dict(step)
            df = STEPS[own.pop("name")](df, **own)
        return df

    return run
