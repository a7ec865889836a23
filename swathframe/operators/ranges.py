"""Orders over groups of any size: range partitions, with what each hands to the next.

A window by a few hot keys would put each key's rows in one task. Here rows are cut into
ranges of (keys, order), windows run inside ranges, and only a row for each key and range
is looked at to carry ranks, sums or last values over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved


def ranged(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """``df`` with the range of each row (``__p``), saved, so that all uses see one set of bounds. Rows that tie share a range."""
    return saved(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()), "ranged")


def handed_on(own: DataFrame, parts: DataFrame, keys: list[str], **carried: Column) -> DataFrame:
    """``own`` with what ``carried``, expressions over the windows of ``parts``, hands to its key and range; parts: a row for each of them. Null keys are a key."""
    same = {k: f"__k{i}" for i, k in enumerate(keys)}
    other = parts.select(*[F.col(k).alias(n) for k, n in same.items()], F.col("__p").alias("__q"), *[c.alias(n) for n, c in carried.items()])
    met = F.col("__p") == F.col("__q")
    for k, n in same.items():
        met &= F.col(k).eqNullSafe(F.col(n))
    return own.join(other, met).drop("__q", *same.values())


def earlier(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)


def range_ranked(df: DataFrame, cls: str | list[str], *order: str | Column) -> DataFrame:
    """``df`` with the rank of each row inside its class (``rn``, from 1), however large the class."""
    keys = [cls] if isinstance(cls, str) else cls
    own = ranged(df, keys, *order)
    counts = own.groupBy(*keys, "__p").agg(F.count("*").alias("__k"))
    own = own.withColumn("__n", F.row_number().over(Window.partitionBy(*keys, "__p").orderBy(*order)))
    own = handed_on(own, counts, keys, __b=F.coalesce(F.sum("__k").over(earlier(keys)), F.lit(0)))
    return own.withColumn("rn", F.col("__n") + F.col("__b")).drop("__p", "__n", "__b")


def running_sums(df: DataFrame, keys: list[str], order: str | Column, **sums: str) -> DataFrame:
    """``df`` with running sums (name=column) in an order in which rows of a key do not tie."""
    own = ranged(df, keys, order)
    parts = own.groupBy(*keys, "__p").agg(*[F.sum(c).alias(f"__s{n}") for n, c in sums.items()])
    upto = Window.partitionBy(*keys, "__p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumns({f"__u{n}": F.sum(c).over(upto) for n, c in sums.items()})
    own = handed_on(own, parts, keys, **{f"__b{n}": F.coalesce(F.sum(f"__s{n}").over(earlier(keys)), F.lit(0)) for n in sums})
    return own.select(*[F.col(c) for c in df.columns], *[(F.col(f"__u{n}") + F.col(f"__b{n}")).alias(n) for n in sums])
