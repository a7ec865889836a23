"""Aggregations: counters, class weights, statistics of tiles, fits and summaries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved
from .ranges import range_ranked


def ships_per_patch(patches: DataFrame, ships: DataFrame) -> DataFrame:
    """(patch_id, n_ships, has_ship): patches without ships stay with 0."""
    counts = ships.groupBy("patch_id").agg(F.count("*").alias("n_ships"))
    return patches.select("patch_id").join(counts, "patch_id", "left").fillna(0, ["n_ships"]).withColumn("has_ship", F.col("n_ships") > 0)


def patch_metadata(rows: DataFrame, first: list[str], length: str, order: str) -> DataFrame:
    """A row a patch: ``first`` columns of its first row, lengths (sorted), ship count and mean length."""
    return rows.groupBy("patch_id").agg(*[F.min_by(c, order).alias(c) for c in first], F.array_sort(F.collect_list(length)).alias("vessel_lengths"), F.count("*").alias("ship_count"), F.avg(length).alias("mean_length"))


def coverage(rows: DataFrame) -> DataFrame:
    """Counters by split and in total (``all``) of rows (split, patch_id, wind, length): one rollup."""
    sized, windy = F.col("length").isNotNull(), F.col("wind").isNotNull()
    own = rows.rollup("split").agg(F.countDistinct("patch_id").alias("patches"), F.count("*").alias("vessels"), F.countDistinct(F.when(windy, F.col("patch_id"))).alias("patches_with_wind"), F.countDistinct(F.when(sized, F.col("patch_id"))).alias("patches_with_length"), F.count_if(sized).alias("vessels_with_length"), F.count_if(sized & windy).alias("vessels_with_both"))
    return own.withColumn("split", F.coalesce("split", F.lit("all")))


def imbalance_weight(pixels: DataFrame, keys: list[str], cap: float = 14.0) -> DataFrame:
    """Negatives over positives of valid pixels, at most ``cap``; 1.0 when either is empty."""
    own = pixels.groupBy(*keys).agg(F.count_if(F.col("valid") & F.col("gt")).alias("pos"), F.count_if(F.col("valid") & ~F.col("gt")).alias("neg"))
    return own.withColumn("weight", F.when((F.col("pos") == 0) | (F.col("neg") == 0), 1.0).otherwise(F.least(F.lit(cap), F.col("neg") / F.col("pos"))))


def weight_of_first(masks: DataFrame, n: int) -> DataFrame:
    """Share of positive pixels (> 127) over the first n masks of each class, by name. Ranks are over distinct names, n of a class leave a task."""
    names = masks.select("class", "name").distinct().withColumn("__n", F.row_number().over(Window.partitionBy("class").orderBy("name"))).where(F.col("__n") <= n).drop("__n")
    own = masks.join(names, ["class", "name"], "left_semi")
    return own.groupBy("class").agg(F.count_if(F.col("value") > 127).alias("pos"), F.count("*").alias("n")).withColumn("weight", F.when(F.col("pos") == 0, 1.0).otherwise((F.col("n") - F.col("pos")) / F.col("pos")))


def power_sums(i: Column, q: Column) -> Column:
    """Sum of squares of two arrays."""
    add = lambda a, x: a + x.cast("double") * x.cast("double")
    return F.aggregate(i, F.lit(0.0), add) + F.aggregate(q, F.lit(0.0), add)


def dataset_rms(tiles: DataFrame, valid: str | None = None) -> DataFrame:
    """One row: rms = sqrt(sum(i^2 + q^2) / samples) and the number of samples.

    ``valid``: an array of flags, one a sample; those not set do not count. Without samples
    the rms is null; tiles without samples add nothing, a tile with a null mask counts whole.
    """
    i, q = F.col("i"), F.col("q")
    if valid:
        flags = F.coalesce(F.col(valid), F.transform(i, lambda _: F.lit(True)))
        some = lambda x: F.filter(F.transform(F.arrays_zip(x.alias("x"), flags.alias("ok")), lambda z: F.when(z["ok"], z["x"])), lambda v: v.isNotNull())
        i, q = some(i), some(q)
    own = tiles.select(i.alias("i"), q.alias("q")).agg(F.sum(power_sums(F.col("i"), F.col("q"))).alias("s"), F.coalesce(F.sum(F.when(F.col("i").isNotNull(), F.size("i"))), F.lit(0)).cast("bigint").alias("samples"))
    return own.select(F.sqrt(F.try_divide("s", "samples")).alias("rms"), "samples")


def channel_stats(values: DataFrame, channel: str = "channel", value: str = "value") -> DataFrame:
    """Mean and population deviation of each channel."""
    return values.groupBy(channel).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def white_pixels(pixels: DataFrame) -> DataFrame:
    """White count and ratio by mask and by scene (mask null): 255 or 1, whichever is more frequent."""
    own = pixels.rollup("scene", "mask").agg(F.greatest(F.count_if(F.col("value") == 255), F.count_if(F.col("value") == 1)).alias("white"), F.count("*").alias("n"))
    return own.where("scene IS NOT NULL").withColumn("ratio", F.col("white") / F.col("n"))


def validation_summary(results: DataFrame) -> DataFrame:
    """Per test case OK, KO and WARNING counts, the running total of warnings, verdict, and the verdict over all cases."""
    own = results.groupBy("test_case").agg(F.count_if(F.col("status") == "PASS").alias("ok"), F.count_if(F.col("status") == "FAIL").alias("ko"), F.count_if(F.col("status") == "WARNING").alias("warnings"))
    own = own.withColumn("running_warnings", F.sum("warnings").over(Window.orderBy("test_case").rowsBetween(Window.unboundedPreceding, 0)))  # a row a test case
    verdict = own.withColumn("verdict", F.when(F.col("ko") == 0, "PASS").otherwise("FAIL"))
    return verdict.withColumn("overall", F.when(F.min((F.col("ko") == 0).cast("int")).over(Window.partitionBy()) == 1, "PASS").otherwise("FAIL"))


def count_rules(files: DataFrame, kind: Column, product: Column) -> DataFrame:
    """One row: files of each kind, distinct products and which count rules hold."""
    n = lambda k: F.count_if(kind == k)
    own = files.agg(n("mask").alias("masks"), n("label").alias("labels"), n("raw").alias("raw"), n("l1").alias("l1"), F.countDistinct(product).alias("products"))
    return own.withColumns({"masks_match": F.col("masks") == F.col("labels"), "raw_match": F.col("raw") == 2 * F.col("labels"), "l1_match": F.col("l1") == 4 * F.col("labels"), "enough_images": F.col("raw") + F.col("l1") >= 1000, "enough_products": F.col("products") >= 10})


def large_groups(files: DataFrame, key: str, least: int) -> DataFrame:
    return files.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def bounds(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def mean_pulse(samples: DataFrame) -> DataFrame:
    """(stream, sample, value): mean over pulses, scaled to unit length per stream; a pulse of zeros has no direction and gives null."""
    own = samples.groupBy("stream", "sample").agg(F.avg("value").alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("stream")))
    return own.select("stream", "sample", F.try_divide(F.col("m"), norm).alias("value"))


def per_threshold(detections: DataFrame, thresholds: list[float]) -> DataFrame:
    """Detections at or above each threshold, in one pass: a detection counts for every threshold up to its confidence, one of NaN for none."""
    reached = F.filter(F.array(*map(F.lit, thresholds)), lambda t: (t <= F.col("conf")) & ~F.isnan("conf"))
    counted = detections.select(F.explode(reached).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"))
    every = detections.sparkSession.createDataFrame([(float(x),) for x in thresholds], "threshold double")
    return every.join(counted, "threshold", "left").fillna(0)


def latency(samples: DataFrame) -> DataFrame:
    """Mean latency by bucket and overall (``all``)."""
    return samples.groupBy("bucket").agg(F.avg("ms").alias("ms"), F.count("*").alias("n")).unionByName(samples.agg(F.lit("all").alias("bucket"), F.avg("ms").alias("ms"), F.count("*").alias("n")))


def region_stat(value: str, method: str) -> Column:
    return {"mean": F.avg(value), "median": F.percentile(F.col(value), F.lit(0.5)), "p90": F.percentile(F.col(value), F.lit(0.9))}[method]


#: Rows of the largest group whose values one task may hold or order.
LARGE_GROUP = 1_000_000


def ranked_groups(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with their rank (__r, from 1) in their group's order of values and its rows (__k), in ranges, however large a group. Nulls go."""
    own = range_ranked(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value)), keys, value).withColumnRenamed("rn", "__r")
    counts = own.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(keys)]).agg(F.count("*").alias("__k"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(keys)])
    return own.join(counts, same).drop(*[f"__g{i}" for i in range(len(keys))])


def has_large_groups(df: DataFrame, keys: list[str], most: int) -> bool:
    return not df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).isEmpty()


def group_quantiles(df: DataFrame, keys: list[str], value: str, most: int | None = None, **quantiles: float) -> DataFrame:
    """(keys, name=quantile, ...): exact, between two values by their distance, as ``percentile`` has them.

    A group of over ``most`` rows is ordered in ranges and its values at the ranks are picked out.
    """
    if not has_large_groups(df, keys, LARGE_GROUP if most is None else most):
        return df.groupBy(*keys).agg(*[F.percentile(F.col(value), F.lit(q)).alias(n) for n, q in quantiles.items()])
    at = {n: q * (F.col("__k") - 1) for n, q in quantiles.items()}
    own = ranked_groups(df, keys, value)
    pick = lambda rank: F.max(F.when(F.col("__r") == rank + 1, F.col(value)))
    found = own.groupBy(*keys, "__k").agg(*[c for n, x in at.items() for c in (pick(F.floor(x)).alias(f"__l{n}"), pick(F.ceil(x)).alias(f"__h{n}"))])
    found = found.select(*keys, *[(F.col(f"__l{n}") * (F.ceil(x) - x) + F.col(f"__h{n}") * (x - F.floor(x)) + F.when(F.ceil(x) == F.floor(x), F.col(f"__l{n}")).otherwise(0.0)).alias(n) for n, x in at.items()])
    every = df.select(*keys).distinct()
    same = reduce(lambda a, b: a & b, [F.col(f"e.{c}").eqNullSafe(F.col(f"f.{c}")) for c in keys])
    return every.alias("e").join(found.alias("f"), same, "left").select("e.*", *[f"f.{n}" for n in quantiles])


def background_stat(df: DataFrame, keys: list[str], value: str, method: str = "median", trim: float = 0.1, most: int | None = None) -> DataFrame:
    """(keys, background): mean, median, p90, or the mean without int(n * trim) values at either end; groups of over ``most`` rows are ordered in ranges."""
    if method in ("median", "p90"):
        return group_quantiles(df, keys, value, most, background={"median": 0.5, "p90": 0.9}[method])
    if method != "trimmed_mean":
        return df.groupBy(*keys).agg(region_stat(value, method).alias("background"))
    if has_large_groups(df, keys, LARGE_GROUP if most is None else most):
        ranked = ranked_groups(df, keys, value)
    else:
        by = Window.partitionBy(*keys)
        ranked = df.where(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(by.orderBy(value))).withColumn("__k", F.count("*").over(by))
    cut = F.floor(F.col("__k") * trim)
    return ranked.where((F.col("__r") > cut) & (F.col("__r") <= F.col("__k") - cut)).groupBy(*keys).agg(F.avg(value).alias("background"))


def list_stat(values: Column, method: str, trim: float = 0.1) -> Column:
    """The same statistics of an array's values."""
    mean = lambda x: F.when(F.size(x) > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x))
    if method == "mean":
        return mean(values)
    n, own = F.size(values), F.array_sort(values)
    if method == "trimmed_mean":
        cut = F.floor(n * trim).cast("int")
        return mean(F.slice(own, cut + 1, n - 2 * cut))
    at = {"median": 0.5, "p90": 0.9}[method] * (n - 1)
    lo, hi = F.get(own, F.floor(at).cast("int")), F.get(own, F.ceil(at).cast("int"))
    return F.when(F.ceil(at) == F.floor(at), lo).otherwise(lo * (F.ceil(at) - at) + hi * (at - F.floor(at)))


def parts_stat(parts: DataFrame, keys: list[str], values: str, method: str, most: int | None = None) -> DataFrame:
    """(keys, background) of values that come in arrays; groups of over ``most`` values are ordered in ranges."""
    sizes = parts.groupBy(*keys).agg(F.sum(F.size(values)).alias("n"))
    if not sizes.where(F.col("n") > (LARGE_GROUP if most is None else most)).isEmpty():
        return background_stat(parts.select(*keys, F.explode(values).alias("v")), keys, "v", method, most=most)
    own = parts.groupBy(*keys).agg(F.flatten(F.collect_list(values)).alias("v"))
    return own.select(*keys, list_stat(F.col("v"), method).alias("background"))


def resource_use(samples: DataFrame, keys: list[str]) -> DataFrame:
    return samples.groupBy(*keys).agg(F.avg("power").alias("avg_power"), F.max("power").alias("peak_power"), F.count("*").alias("samples"))


def polynomial_fit(points: DataFrame, keys: list[str], x: str, y: str, degree: int = 4) -> DataFrame:
    """(keys, c0..cn): least squares of y on the min-max normalised x, per group.

    Moments are summed by Spark; each group is then one small row, solved beside its group.
    """
    edge = points.groupBy(*keys).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    u = F.when(F.col("hi") > F.col("lo"), (F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    own = points.join(edge, keys).withColumn("u", u)
    moments = own.groupBy(*keys, "lo", "hi").agg(*[F.sum(F.pow("u", F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)], *[F.sum(F.pow("u", F.lit(float(k))) * F.col(y)).alias(f"t{k}") for k in range(degree + 1)])
    n = degree + 1

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.array([[a[i + j] for j in range(n)] for i in range(n)]), np.array(b), rcond=1e-12)[0] for a, b in zip(s, t)])

    made = moments.withColumn("c", solve(F.array(*[f"s{k}" for k in range(2 * degree + 1)]), F.array(*[f"t{k}" for k in range(n)])))
    return made.select(*keys, "lo", "hi", *[F.col("c")[k].alias(f"c{k}") for k in range(n)])


def profile(values: DataFrame, keys: list[str], value: str, sample: bool = False) -> DataFrame:
    dev = F.stddev_samp if sample else F.stddev_pop
    return values.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), dev(value).alias("std"))


def version_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """L1, L2 and largest absolute difference of two versions of a tile, over their common pixels."""
    d = F.abs(F.col(f"a.{value}") - F.col(f"b.{value}"))
    met = a.alias("a").join(b.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return met.groupBy(F.col(f"a.{keys[0]}").alias(keys[0])).agg(F.avg(d).alias("l1"), F.sqrt(F.avg(d * d)).alias("l2"), F.max(d).alias("linf"))


def run_summary(outputs: DataFrame, expected: DataFrame, kinds: list[str]) -> DataFrame:
    """Per scene the outputs of each kind, why it failed (null if not), and the status of the run."""
    own = outputs.groupBy("scene").pivot("kind", kinds).count()
    joined = expected.join(own, "scene", "left").fillna(0, kinds)
    empty = F.array_compact(F.array(*[F.when(F.col(k) == 0, F.lit(f"no {k}")) for k in kinds]))
    reason = F.when(F.size(empty) > 0, F.array_join(empty, "; "))
    scenes = saved(joined.withColumn("reason", reason).withColumn("__j", F.lit(1)), "run-summary")
    run = scenes.groupBy("__j").agg(F.when(F.count("reason") > 0, "FAIL").otherwise("PASS").alias("run"))
    return scenes.join(F.broadcast(run), "__j").drop("__j")  # the run is one row
