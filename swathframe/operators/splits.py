"""Splits, sampling, balancing and leakage checks.

A seeded hash of the key takes the place of a shuffle: the order is the same on every run
and for every partitioning. Ranks are taken over distinct scenes, by hash bins, so that no
task holds them all.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import range_ranked


def hash_order(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(str(seed)), key.cast("string")))


def ranked(df: DataFrame, key: str, seed: int, within: list[str]) -> DataFrame:
    """Distinct keys with their rank in hash order (``rn``, from 1) and their number (``n``), per group.

    Two steps: counts of the 256 bins of the first two hash digits, then ranks inside bins.
    """
    own = df.select(*within, key).distinct().withColumn("h", hash_order(seed, F.col(key))).withColumn("bin", F.substring("h", 1, 2))
    bins = own.groupBy(*within, "bin").agg(F.count("*").alias("k"))
    by = Window.partitionBy(*within).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("before", F.sum("k").over(by) - F.col("k")).withColumn("n", F.sum("k").over(Window.partitionBy(*within)))
    joined = own.join(bins.drop("k"), [*within, "bin"])
    return joined.withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy(*within, "bin").orderBy("h"))).select(*within, key, "rn", "n")


def share(n: Column, ratio: float) -> Column:
    """The whole part of n times a ratio as it is written: 90 * 0.7 is 63, though less in floating point."""
    return F.floor(n * F.lit(Decimal(str(ratio))))


def split_keys(df: DataFrame, key: str, ratios: tuple[float, float] = (0.7, 0.15), seed: int = 42, within: list[str] | None = None) -> DataFrame:
    """(within, key, split): floors for train and val, the rest is test."""
    own = ranked(df, key, seed, within or [])
    train, val = share(F.col("n"), ratios[0]), share(F.col("n"), ratios[1])
    return own.select(*(within or []), key, F.when(F.col("rn") <= train, "train").when(F.col("rn") <= train + val, "val").otherwise("test").alias("split"))


def hold_out(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    own = ranked(df, key, seed, [])
    return own.select(key, F.when(F.col("rn") <= share(F.col("n"), fraction), "val").otherwise("train").alias("split"))


def balanced(df: DataFrame, cls: str, name: str, caps: dict | None = None) -> DataFrame:
    """The same number of each class (that of the rarest, at most its cap), in name order."""
    sizes = df.groupBy(cls).agg(F.count("*").alias("k"))
    least = sizes.agg(F.min("k")).first()[0] or 0
    cap = F.lit(least)
    for value, most in (caps or {}).items():
        cap = F.when(F.col(cls) == value, F.least(F.lit(least), F.lit(most))).otherwise(cap)
    return range_ranked(df, cls, name).where(F.col("rn") <= cap).drop("rn")


def sampled_targets(products: DataFrame, grid: DataFrame, n: int, seed: int) -> DataFrame:
    """n products without replacement and a grid point of each."""
    chosen = products.orderBy(hash_order(seed, F.col("product_id")), "product_id").limit(n).select("product_id")
    order = hash_order(seed, F.concat_ws("/", "product_id", "gx", "gy"))
    return grid.join(chosen, "product_id").withColumn("__n", F.row_number().over(Window.partitionBy("product_id").orderBy(order))).where("__n = 1").drop("__n")


def leakage(assigned: DataFrame) -> DataFrame:
    """Scenes in several splits, with the splits."""
    own = assigned.groupBy("scene").agg(F.array_sort(F.collect_set("split")).alias("splits"))
    return own.where(F.size("splits") > 1).select("scene", F.array_join("splits", ",").alias("splits"))


def leakage_verdict(assigned: DataFrame) -> DataFrame:
    return leakage(assigned).agg(F.count("*").alias("leaking")).withColumn("verdict", F.when(F.col("leaking") == 0, "PASS").otherwise("FAIL"))


def membership(assigned: DataFrame, name: str) -> DataFrame:
    """(split, scene, name, n): the report of what is where, a row a name, with the number of names of its scene there."""
    sizes = assigned.groupBy("split", "scene").agg(F.count("*").alias("n"))
    return assigned.select("split", "scene", F.col(name).alias("name")).join(sizes, ["split", "scene"])


def manifest(files: DataFrame, splits: DataFrame, root: str = "dataset") -> DataFrame:
    """(split, kind, src, dst): which file goes where."""
    return files.join(splits, "scene").select("split", "kind", F.col("path").alias("src"), F.concat_ws("/", F.lit(root), "split", "kind", F.substring_index("path", "/", -1)).alias("dst"))


def mask_union(*masks: DataFrame) -> DataFrame:
    """Pixels of several masks; a pixel is set if any mask sets it."""
    every = masks[0]
    for m in masks[1:]:
        every = every.unionByName(m)
    return every.groupBy("tile_id", "r", "c").agg(F.max("label").alias("label"))
