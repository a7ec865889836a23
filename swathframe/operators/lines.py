"""Correlation of sampled lines, block by block in the frequency domain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved

#: Samples of a block.
BLOCK = 1 << 16


def correlated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of a[s] * b[s - lag] for lags from 1 - len(b) to len(a) - 1."""
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b[::-1], size), size)[:n]


def line_blocks(line: DataFrame, keys: list[str], block: int, name: str) -> DataFrame:
    """(keys, first sample, values) of blocks of at most ``block`` neighbouring samples, filled up with zeros."""
    own = line.where("s IS NOT NULL").groupBy(*keys, F.floor(F.col("s") / block).alias("__block")).agg(F.collect_list(F.struct(F.col("s").cast("bigint").alias("s"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))).alias("x"))

    @F.pandas_udf("first bigint, value array<double>")
    def dense(held: pd.Series) -> pd.DataFrame:
        first, values = [], []
        for rows in held:
            s = np.array([r["s"] for r in rows])
            value = np.zeros(s.max() - s.min() + 1)
            np.add.at(value, s - s.min(), np.array([r["value"] for r in rows]))
            first.append(int(s.min()))
            values.append(value)
        return pd.DataFrame({"first": first, "value": values})

    made = own.select(*keys, dense("x").alias("d"))
    return made.select(*keys, F.col("d.first").alias(f"{name}_first"), F.col("d.value").alias(f"{name}_value"))


def best_lag(a: DataFrame, b: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """(keys, lag, score): lag of b against a (keys, s, value) with the largest absolute correlation sum to nine decimals, the smallest of equals.

    Every block of a line of a meets every block of its line of b, and lags are summed over
    block pairs: n log n a line that fits in a block. Rounding errors of the transform only
    choose candidates: lags as close to the best as those errors allow are summed exactly.
    Null values are 0; repeated samples add up; a line that one side lacks has no row.
    """
    left, right = line_blocks(a, keys, block, "a"), line_blocks(b, keys, block, "b")

    @F.pandas_udf("array<double>")
    def scores(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([correlated(np.asarray(p, np.float64), np.asarray(q, np.float64)) for p, q in zip(x, y)], dtype=object)

    power = lambda c: F.aggregate(c, F.lit(0.0), lambda t, v: t + v * v)
    met = left.join(right, keys).select(*keys, (F.col("a_first") - F.col("b_first") - F.size("b_value") + 1).alias("from"), scores("a_value", "b_value").alias("score"), F.sqrt(power("a_value") * power("b_value")).alias("norm"))
    lags = met.select(*keys, "from", "norm", F.posexplode("score").alias("i", "score")).groupBy(*keys, (F.col("from") + F.col("i")).alias("lag")).agg(F.sum("score").alias("score"), F.sum("norm").alias("norm"))
    lags = saved(lags, "lags")
    top = lags.groupBy(*keys).agg(F.max(F.abs("score")).alias("top"), F.max("norm").alias("most"))
    # where all is zero every lag ties, and the smallest one stands for them
    flat = lags.join(top.where("most = 0"), keys).groupBy(*keys).agg(F.min("lag").alias("lag"))
    near = lags.join(top.where("most > 0"), keys).where(F.abs("score") >= F.col("top") - 1e-9 - 1e-12 * F.col("most")).select(*keys, "lag")
    chosen = saved(near.unionByName(flat), "lag-candidates")
    exact = chosen.join(a.select(*keys, F.col("s").alias("at"), F.col("value").alias("x")), keys).withColumn("s", F.col("at") - F.col("lag")).join(b.select(*keys, "s", F.col("value").alias("y")), [*keys, "s"])
    summed = exact.groupBy(*keys, "lag").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0.0)).alias("score"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("score"), 9)), "lag"))
    return summed.withColumn("n", best).where("n = 1").drop("n")
