"""Joins of files, labels, products, targets and tiles.

Theta joins are written as equi-joins: time windows by day buckets, space by cells, name
prefixes by exploding the prefixes. ``first`` always means an explicit order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved
from .ranges import earlier, handed_on, ranged, running_sums


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in the order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def equi_by_id(files: DataFrame, scenes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(files with their scene, files of unmapped ids)."""
    return files.join(scenes, key), files.join(scenes, key, "left_anti")


def pair_polarisations(tiles: DataFrame) -> DataFrame:
    """(base, vv, vh) of tiles (base, pol, path): the largest path wins among doubles; a missing side is null."""
    return tiles.groupBy("base").agg(F.max(F.when(F.col("pol") == "vv", F.col("path"))).alias("vv"), F.max(F.when(F.col("pol") == "vh", F.col("path"))).alias("vh"))


def bucket_days(targets: DataFrame, most: int = 32) -> int:
    """Days of a bucket: a third of the mean window of ``targets``, so that a target meets few products outside its window and is in few buckets."""
    mean = targets.where("start_ts <= stop_ts").agg(F.avg((F.unix_micros(F.col("stop_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 86.4e9)).first()[0]
    return int(max(1, min(most, (mean or 0) / 3)))


def window_parts(targets: DataFrame, products: DataFrame, days: int | None = None, block: int = 4096, pairs: int = 1 << 23, most: int = 1 << 13) -> tuple[DataFrame, DataFrame]:
    """Targets and products with the parts (__b, __i, __j) in which they meet, each row once for each of its parts.

    Long windows meet products over buckets of ``days`` days (``bucket_days``, where not
    given); a product has the one bucket of its start, so no pair is made twice. In a bucket,
    parts of some ``block`` targets meet parts of some ``block`` products, and parts are dealt
    to a task for some ``pairs`` pairs that are looked at: tables that are small beside their
    pairs would else be left to one task. Beyond some ``most`` parts and tasks both grow, so
    that copies of rows for the parts grow as the tables do, not as the pairs.
    """
    days = days or bucket_days(targets)
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / days).cast("int")
    t = targets.withColumn("__b", F.explode(F.sequence(bucket(F.col("start_ts")), bucket(F.col("stop_ts")))))
    p = products.withColumn("__b", bucket(F.col("start_ts")))
    count = lambda df, n: df.groupBy("__b").agg(F.count("*").cast("double").alias(n))
    met = count(t, "__nt").join(count(p, "__np"), "__b")
    seen = met.agg(F.sum(F.col("__nt") * F.col("__np")).alias("pairs"), F.sum("__np").alias("rows")).first()
    looked, rows = seen.pairs or 0, seen.rows or 0
    block = max(block, math.ceil(math.sqrt(looked / most)))
    tasks = max(targets.sparkSession.sparkContext.defaultParallelism, min(most, math.ceil(max(looked / pairs, (looked / block + rows) / (1 << 18)))))
    parts = met.select("__b", *[F.ceil(F.col(n) / block).cast("int").alias(k) for n, k in (("__nt", "__kt"), ("__np", "__kp"))])

    def dealt(df: DataFrame, own: str, k: str, other: str, m: str) -> DataFrame:
        """Each row in its part ``own`` of ``k``, once for each part ``other`` of the other side's ``m``."""
        hashed = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
        placed = df.join(parts, "__b").withColumn(own, F.pmod(hashed, F.col(k)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1)))
        return placed.drop(k, m).repartition(tasks, "__b", "__i", "__j")

    return dealt(t, "__i", "__kt", "__j", "__kp"), dealt(p, "__j", "__kp", "__i", "__kt")


def containing_windows(targets: DataFrame, products: DataFrame, days: int | None = None, only: tuple[str, str] | None = None, **sizes: int) -> DataFrame:
    """Targets whose window contains a product's (t.start <= p.start and t.stop >= p.stop), met in ``window_parts``.

    Where a column of each side is enough (``only``), pairs come from ``window_rectangles``.
    """
    if only:
        met = window_rectangles(targets, products, *only, days=days, **sizes)
        return met.select(F.explode("keys").alias(only[0]), "values").select(only[0], F.explode("values").alias(only[1]))
    t, p = window_parts(targets, products, days, **sizes)
    t, p = t.alias("t"), p.hint("shuffle_hash").alias("p")
    same = [F.col(f"t.{c}") == F.col(f"p.{c}") for c in ("__b", "__i", "__j")]
    return t.join(p, [*same, F.col("t.start_ts") <= F.col("p.start_ts"), F.col("t.stop_ts") >= F.col("p.stop_ts")])


def met_lists(t: DataFrame, p: DataFrame, block: tuple[int, int], pairs: int = 1 << 23, most: int = 1 << 13) -> DataFrame:
    """(targets, products): lists of rows of ``t`` and of ``p`` (b, ...); every two rows of a bucket b are in one of its rows together.

    Lists have some ``block`` rows. They are made first and then copied for the lists that
    they meet, so that rows are shuffled one by one only once. Lists that meet are dealt to a
    task for some ``pairs`` pairs; beyond some ``most`` tasks and meetings lists grow instead.
    """
    count = lambda df, n: df.groupBy("b").agg(F.count("*").cast("double").alias(n))
    met = count(t, "nt").join(count(p, "np"), "b")
    seen = met.agg(F.sum(F.col("nt") * F.col("np")).alias("pairs"), F.sum("nt").alias("nt"), F.sum("np").alias("np")).first()
    looked, least = seen.pairs or 0, t.sparkSession.sparkContext.defaultParallelism
    grown = max(1.0, math.sqrt(looked / most / block[0] / block[1]))
    tall, wide = (math.ceil(n * grown) for n in block)
    tasks = max(least, min(most, math.ceil(max(looked / pairs, (looked / tall + (seen.np or 0)) / (1 << 17)))))
    parts = F.broadcast(met.select("b", F.ceil(F.col("nt") / tall).cast("int").alias("kt"), F.ceil(F.col("np") / wide).cast("int").alias("kp")))  # a row a day at most

    def lists(rows: DataFrame, n: float, own: str, k: str, other: str, m: str, name: str) -> DataFrame:
        columns = [c for c in rows.columns if c != "b"]
        placed = rows.join(parts, "b").withColumn(own, F.pmod(F.xxhash64(*columns), F.col(k)).cast("int"))
        spread = max(least, min(most, math.ceil((n or 0) / (1 << 17))))
        held = placed.repartition(spread, "b", own).groupBy("b", own, m).agg(F.collect_list(F.struct(*columns)).alias(name))
        return held.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop(m).repartition(tasks, "b", "i", "j")

    right = lists(p, seen.np, "j", "kp", "i", "kt", "products").hint("shuffle_hash")
    return lists(t, seen.nt, "i", "kt", "j", "kp", "targets").join(right, ["b", "i", "j"]).select("targets", "products")


def met_rectangles(batches: Iterator[pa.RecordBatch], tall: int, wide: int) -> Iterator[pa.RecordBatch]:
    """(keys, values) of rows (targets, products), lists of (id, start, stop): each key's window contains each value's.

    Products go in order of time, ``wide`` at once; targets whose window holds all of those go ``tall`` at once, the others are looked through.
    """
    for batch in batches:
        for left, right in zip(batch.column("targets"), batch.column("products")):
            t, p = left.values, right.values
            start, stop, first, last = (x.field(c).cast(pa.int64()).to_numpy() for x in (t, p) for c in ("start", "stop"))
            order = np.lexsort((last, first))
            for at in range(0, len(order), wide):
                j = order[at : at + wide]
                a, b = first[j], last[j]
                whole = (start <= a.min()) & (stop >= b.max())
                full = np.flatnonzero(whole)
                rows = [full[k : k + tall] for k in range(0, len(full), tall)]
                held = [j] * len(rows)
                for i in np.flatnonzero(~whole & (start <= a.max()) & (stop >= b.min())):
                    if len(fits := j[(start[i] <= a) & (stop[i] >= b)]):
                        rows.append([i])
                        held.append(fits)
                if rows:
                    lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]), pa.int32()), ids.take(pa.array(np.concatenate(x)))) for x, ids in ((rows, t.field("id")), (held, p.field("id")))]
                    yield pa.RecordBatch.from_arrays(lists, ["keys", "values"])


def window_buckets(targets: DataFrame, products: DataFrame, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``b``: the buckets of days of a target's window, and the bucket of a product's start. Without times that are null."""
    days = days or bucket_days(targets)
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / days).cast("int")
    t = targets.dropna(subset=["start_ts", "stop_ts"]).withColumn("b", F.explode(F.sequence(bucket("start_ts"), bucket("stop_ts"))))
    return t, products.dropna(subset=["start_ts", "stop_ts"]).withColumn("b", bucket("start_ts"))


def window_rectangles(targets: DataFrame, products: DataFrame, key: str, value: str, days: int | None = None, block: int = 4096, tall: int = 16, wide: int = 512, **sizes: int) -> DataFrame:
    """(keys, values): the pairs of ``containing_windows`` as lists, each of ``keys`` with each of ``values``; every pair is in one row."""
    kinds = {df.schema[c].dataType.typeName() for df in (targets, products) for c in ("start_ts", "stop_ts")}
    time = lambda c: F.col(c) if kinds == {"timestamp_ntz"} else F.col(c).cast("timestamp")
    t, p = (df.select(F.col(c).alias("id"), time("start_ts").alias("start"), time("stop_ts").alias("stop"), "b") for df, c in zip(window_buckets(targets.select(key, "start_ts", "stop_ts"), products.select(value, "start_ts", "stop_ts"), days), (key, value)))
    met = met_lists(t, p, (block, block), **sizes)
    return met.mapInArrow(lambda batches: met_rectangles(batches, tall, wide), f"keys array<{t.schema['id'].dataType.simpleString()}>, values array<{p.schema['id'].dataType.simpleString()}>")


def listed_windows(targets: DataFrame, products: DataFrame, key: str, value: str, **sizes: int) -> DataFrame:
    """(key, values): the pairs of ``containing_windows``, those of a target and a part of products in one array."""
    return window_rectangles(targets, products, key, value, **sizes).select(F.explode("keys").alias(key), "values")


def around_windows(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """(start_ts, stop_ts, n, mark) of windows that spans (start_ts, stop_ts, n, mark) begin before and end after.

    A span lies in two cells or three of the power of two that its length reaches; a window
    looks in the cell of its start for each such length that there is.
    """
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    cell = lambda c: F.floor(seconds(c) / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    level = F.ceil(F.log2(seconds("stop_ts") - seconds("start_ts"))).cast("int")
    held = spans.where("start_ts < stop_ts").withColumn("level", level).withColumn("cell", F.explode(F.sequence(cell("start_ts"), cell("stop_ts"))))
    levels = sorted(r.level for r in held.select("level").distinct().collect())  # some sixty at most
    looks = windows.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("cell", cell("start_ts"))
    met = looks.alias("t").join(held.alias("p"), (F.col("t.level") == F.col("p.level")) & (F.col("t.cell") == F.col("p.cell")) & (F.col("p.start_ts") < F.col("t.start_ts")) & (F.col("p.stop_ts") > F.col("t.stop_ts")))
    return met.groupBy("t.start_ts", "t.stop_ts").agg(F.sum("n").alias("n"), F.sum("mark").alias("mark"))


def counted_windows(targets: DataFrame, products: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mark): how many products ``containing_windows`` gives a target, and the sum of their whole numbers ``value``; targets without any have no row.

    Nothing is paired: of all products those that stop too late and those that start too
    early are taken off, read from running sums over time. What would be taken off twice,
    products that begin before a window and end after it, is paired and put back, and
    products that stop before they start are paired as they are.
    """
    both = products.select("start_ts", "stop_ts", F.col(value).alias("__v")).dropna(subset=["start_ts", "stop_ts"])
    own = targets.select(F.col(key).alias("__t"), "start_ts", "stop_ts").where("start_ts <= stop_ts")
    forward = both.where("start_ts <= stop_ts")
    sums = [F.count("*").alias("n"), F.sum("__v").alias("mark")]

    def upto(product: str, target: str, at_end: bool) -> DataFrame:
        """(time of a target, n, mark) of the products before it, with those at it where ``at_end``."""
        first, second = F.lit(0 if at_end else 1), F.lit(1 if at_end else 0)
        times = forward.groupBy(F.col(product).cast("timestamp").alias("__at")).agg(*sums).withColumn("__kind", first)
        asked = own.select(F.col(target).cast("timestamp").alias("__at")).distinct().select("__at", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("mark"), second.alias("__kind"))
        order = F.struct("__at", "__kind")
        run = running_sums(times.unionByName(asked).withColumn("__o", order).fillna(0, ["mark"]), [], "__o", cn="n", cm="mark")
        return run.where(F.col("__kind") == second).select(F.col("__at").alias(target + "_at"), F.col("cn").alias(target + "_n"), F.col("cm").alias(target + "_m"))

    at = own.withColumn("start_ts_at", F.col("start_ts").cast("timestamp")).withColumn("stop_ts_at", F.col("stop_ts").cast("timestamp"))
    read = at.join(upto("stop_ts", "stop_ts", True), "stop_ts_at").join(upto("start_ts", "start_ts", False), "start_ts_at")
    parts = read.select("__t", (F.col("stop_ts_n") - F.col("start_ts_n")).alias("n"), (F.col("stop_ts_m") - F.col("start_ts_m")).alias("mark"))
    parts = parts.unionByName(own.join(around_windows(forward.groupBy("start_ts", "stop_ts").agg(*sums), own.select("start_ts", "stop_ts").distinct()), ["start_ts", "stop_ts"]).select("__t", "n", "mark"))
    odd = both.where("start_ts > stop_ts")
    if not odd.isEmpty():
        paired = containing_windows(targets.select(F.col(key).alias("__t"), "start_ts", "stop_ts"), odd)
        parts = parts.unionByName(paired.select("__t", F.lit(1).cast("bigint").alias("n"), F.col("__v").alias("mark")))
    return parts.groupBy(F.col("__t").alias(key)).agg(F.sum("n").alias("n"), F.sum("mark").alias("mark")).where("n > 0")


def nearest_cell(points: DataFrame, cells: DataFrame, key: str, step: float = 8.0, widest: float = 512.0) -> DataFrame:
    """Each point (key, lat, lon) with its nearest cell (cell, lat, lon, ...) by squared degrees, the smallest cell of equals.

    Points of one place look once, and cells of one place are their smallest. Places look in
    their own and adjoining grid squares, of at most ``step`` degrees and of a few cells each;
    the answer holds if it is closer than the nearest unseen square, else the place looks
    again in squares four times as wide. Squares of ``widest`` degrees see every cell of the
    globe, so all places end.
    """
    columns = [c for c in cells.columns if c not in ("lat", "lon")]
    spots = saved(cells.groupBy(F.col("lat").alias("__lat"), F.col("lon").alias("__lon")).agg(F.min(F.struct(*columns)).alias("__c")), "nearest-spots")
    whole = spots.agg(F.count("*").alias("n"), (F.max("__lat") - F.min("__lat")).alias("h"), (F.max("__lon") - F.min("__lon")).alias("w")).first()
    h, w, n = whole.h or 0.0, whole.w or 0.0, max(whole.n, 1)
    room = max((4 * h * w / n) ** 0.5, 4 * max(h, w) / n)  # squares of four spots on average
    left, done, size = saved(points.select("lat", "lon").distinct(), "nearest-left"), None, min(step, max(room, 1e-3)) if room else step
    near = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while True:
        square = lambda c: F.floor(F.col(c) / size).cast("int")  # noqa: E731, B023
        looks = left.withColumn("__a", near).withColumn("__o", near).withColumn("__y", square("lat") + F.col("__a")).withColumn("__x", square("lon") + F.col("__o"))
        placed = spots.withColumn("__y", square("__lat")).withColumn("__x", square("__lon"))
        met = looks.join(placed, ["__y", "__x"]).withColumn("d2", F.pow(F.col("lat") - F.col("__lat"), 2) + F.pow(F.col("lon") - F.col("__lon"), 2))
        best = met.groupBy("lat", "lon").agg(F.min(F.struct("d2", "__c")).alias("b")).where(F.col("b.d2") <= size * size).select("lat", "lon", "b")
        best = saved(best, "nearest")
        done = best if done is None else done.unionByName(best)
        if size >= widest:
            break
        left, size = saved(left.join(best, ["lat", "lon"], "left_anti"), "nearest-left"), min(size * 4, widest)
        if left.isEmpty():
            break
    found = points.select(key, "lat", "lon").join(done, ["lat", "lon"]).groupBy(key).agg(F.min("b").alias("b"))
    return found.select(key, "b.d2", "b.__c.*")


def grid_distance(matches: DataFrame, grid: DataFrame) -> DataFrame:
    """(target_id, product_id, min_distance_deg): smallest distance from a target to its product's grid points."""
    d = F.sqrt(F.pow(F.col("t.lat") - F.col("g.lat"), 2) + F.pow(F.col("t.lon") - F.col("g.lon"), 2))
    return matches.alias("t").join(grid.alias("g"), "product_id").groupBy("target_id", "product_id").agg(F.min(d).alias("min_distance_deg"))


def listed_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(product_id, lats, lons) of points (product_id, lat, lon): a row for each product of a batch, with its points that have both."""
    for batch in batches:
        ids = batch.column(0).dictionary_encode()
        known = np.flatnonzero(np.asarray(batch.column(1).is_valid()) & np.asarray(batch.column(2).is_valid()))
        code = ids.indices.to_numpy()[known]
        known = pa.array(known[np.argsort(code, kind="stable")])
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(ids.dictionary)))]), pa.int32())
        yield pa.RecordBatch.from_arrays([ids.dictionary] + [pa.ListArray.from_arrays(offsets, batch.column(c).take(known)) for c in (1, 2)], ["product_id", "lats", "lons"])


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Distances rounded as Spark's ``round`` does: half up, by the digits that a double is written with."""
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = x * 10.0**digits
        whole = np.floor(scaled + 0.5)
        odd = np.flatnonzero((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4) | (scaled > 2**36))
    out = whole / 10.0**digits
    for k in odd:
        v = float(x.flat[k])
        out.flat[k] = float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, Context(prec=400))) if math.isfinite(v) else v
    return out


def place_distances(places: np.ndarray, lats: np.ndarray, lons: np.ndarray, sizes: np.ndarray, room: int = 1 << 16) -> np.ndarray:
    """Smallest distance of each place (2, n) to the points of each product, which has ``sizes`` of them, one product after another; NaN where there are none."""
    out, some = np.full((places.shape[1], len(sizes)), np.nan), np.flatnonzero(sizes)
    if len(some):
        offsets = (np.cumsum(sizes) - sizes)[some]
        step = max(1, room // len(lats))
        a, b = np.empty((2, min(step, places.shape[1]), len(lats)))
        for at in range(0, places.shape[1], step):
            y, x = places[:, at : at + step, None]
            p, q = a[: len(y)], b[: len(y)]
            np.subtract(y, lats, out=p)
            np.subtract(x, lons, out=q)
            np.multiply(p, p, out=p)
            np.multiply(q, q, out=q)
            np.add(p, q, out=p)
            out[at : at + step, some] = np.sqrt(np.fmin.reduceat(p, offsets, axis=1))
    return out


def least_distances(batches: Iterator[pa.RecordBatch], digits: int | None = None, pairs: int = 1 << 16, tall: int = 16, cells: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """(keys, values, least) of rows (targets, products), a block of each: lists of (id, lat, lon, start, stop) and of (id, lats, lons, spans, nth). ``least`` has a list of distances to ``values`` for each of ``keys``.

    Targets of one place are looked up once, and rounded there. A product's ``nth`` span counts
    if none before it lies in the window too. Targets whose window holds all products of a
    block go ``tall`` at once, the others are looked through.
    """
    for batch in batches:
        for left, right in zip(batch.column("targets"), batch.column("products")):
            t = left.values
            start, stop = (t.field(c).to_numpy() for c in ("start", "stop"))
            lat, lon = (t.field(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
            places, place = np.unique(np.array([lat, lon]), axis=1, return_inverse=True)
            place, unknown = place.ravel(), np.asarray(t.field("lat").is_null()) | np.asarray(t.field("lon").is_null())
            wide = max(16, cells // places.shape[1])
            for head in range(0, len(right.values), wide):
                p = right.values.slice(head, wide)
                lists, nth = p.field("spans"), p.field("nth").to_numpy()
                sizes = np.diff(p.field("lats").offsets.to_numpy()).astype(np.int64)
                least = place_distances(places, p.field("lats").flatten().to_numpy(), p.field("lons").flatten().to_numpy(), sizes)
                least = least if digits is None else rounded(least, digits)
                at, spans = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
                firsts, lasts = (spans.field(c).to_numpy() for c in ("start", "stop"))
                first, last = firsts[at[:-1] + nth], lasts[at[:-1] + nth]
                empty, later = sizes == 0, np.flatnonzero(nth)
                whole = (start <= first.min()) & (stop >= last.max()) & (not len(later))
                ids, own = t.field("id"), p.field("id")
                step = max(1, pairs // len(p) // tall) * tall

                def handed(d: np.ndarray, none: np.ndarray, key: np.ndarray, value: np.ndarray, ends: tuple[np.ndarray, ...]) -> pa.RecordBatch:
                    """Distances of pairs, and where they are null; ``ends`` of the lists of keys, of values and of each key's distances."""
                    ends = [pa.array(np.concatenate([[0], x]), pa.int32()) for x in ends]
                    inner = pa.ListArray.from_arrays(ends[2], pa.array(d, mask=none if none.any() else None))
                    lists = ids.take(pa.array(key)), own.take(pa.array(value)), inner  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends[k], x) for k, x in zip((0, 1, 0), lists)], ["keys", "values", "least"])

                full, n = np.flatnonzero(whole), len(p)
                for k in range(0, len(full), step):
                    key = full[k : k + step]
                    ends = np.minimum(np.arange(tall, len(key) + tall, tall), len(key))
                    value = np.tile(np.arange(n), len(ends))
                    none = (unknown[key, None] | empty).ravel() if empty.any() or unknown[key].any() else empty
                    yield handed(least[place[key]].ravel(), none, key, value, (ends, np.arange(1, len(ends) + 1) * n, np.arange(1, len(key) + 1) * n))
                some = np.flatnonzero(~whole & (start <= first.max()) & (stop >= last.min()))
                for k in range(0, len(some), step):
                    i = some[k : k + step, None]
                    fits = (start[i] <= first) & (stop[i] >= last)
                    for j in later:
                        before = slice(at[j], at[j] + nth[j])
                        fits[:, j] &= ~((start[i] <= firsts[before]) & (stop[i] >= lasts[before])).any(axis=1)
                    found = fits.sum(axis=1)
                    key, ends = some[k + np.flatnonzero(found)], np.cumsum(found[found > 0])
                    i, j = np.nonzero(fits)
                    if len(j):
                        i = some[k + i]
                        yield handed(least[place[i], j], unknown[i] | empty[j], key, j, (np.arange(1, len(key) + 1), ends, ends))


def window_distances(targets: DataFrame, products: DataFrame, grid: DataFrame, block: tuple[int, int] = (16384, 512), digits: int | None = None) -> DataFrame:
    """(target_id, product_id, min_distance_deg) of ``containing_windows``: the smallest distance from a target to its product's grid points; products without any have no row.

    Targets (target_id, lat, lon, start_ts, stop_ts) have an id each. A product is one row
    with all its points, and lists of targets meet lists of products of a bucket of days
    (``met_lists``): what is shuffled are the lists, and pairs are only made where they are
    handed on, with distances rounded to ``digits``, if given.
    """
    days = bucket_days(targets)
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / days).cast("int")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    t = targets.where("start_ts <= stop_ts").select(F.col("target_id").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), micros("start_ts").alias("start"), micros("stop_ts").alias("stop"), F.explode(F.sequence(bucket("start_ts"), bucket("stop_ts"))).alias("b"))
    spans = products.dropna(subset=["start_ts", "stop_ts"]).groupBy("product_id").agg(F.collect_set(F.struct(micros("start_ts").alias("start"), micros("stop_ts").alias("stop"), bucket("start_ts").alias("b"))).alias("spans"))
    kinds = {**dict(targets.dtypes), **dict(products.dtypes)}
    points = grid.where("product_id IS NOT NULL").select("product_id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    points = points.mapInArrow(listed_points, f"product_id {dict(grid.dtypes)['product_id']}, lats array<double>, lons array<double>").groupBy("product_id").agg(F.collect_list(F.struct("lats", "lons")).alias("points"))
    p = saved(spans.join(points, "product_id").select(F.col("product_id").alias("id"), "spans", F.flatten("points.lats").alias("lats"), F.flatten("points.lons").alias("lons"), F.posexplode("spans").alias("nth", "own")).withColumn("b", F.col("own.b")).drop("own"), "window-products")
    met = met_lists(t, p, block).mapInArrow(lambda batches: least_distances(batches, digits), f"keys array<{kinds['target_id']}>, values array<{kinds['product_id']}>, least array<array<double>>")
    each = met.select("keys", "values", F.posexplode("least").alias("i", "own"))
    return each.select(F.col("keys")[F.col("i")].alias("target_id"), "values", F.posexplode("own").alias("j", "min_distance_deg")).select("target_id", F.col("values")[F.col("j")].alias("product_id"), "min_distance_deg")


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str) -> DataFrame:
    """Points (key, px, py, ...) inside the polygon of their key (key, ord, px, py) by crossing number.

    An edge counts for a point if exactly one of its ends is above it (half-open), and it
    crosses to the right; an odd count is inside.
    """
    return points.join(polygon_edges(polygons, key), key).where(inside_edges()).drop("edges")


def polygon_edges(polygons: DataFrame, key: str) -> DataFrame:
    """(key, edges): the closed ring of each polygon (key, ord, px, py)."""
    ring = Window.partitionBy(key).orderBy("ord")
    whole = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = polygons.select(key, F.col("px").alias("x1"), F.col("py").alias("y1"), F.coalesce(F.lead("px").over(ring), F.first("px").over(whole)).alias("x2"), F.coalesce(F.lead("py").over(ring), F.first("py").over(whole)).alias("y2"))
    return edges.groupBy(key).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))


def inside_edges() -> Column:
    """Whether px, py lies inside ``edges``."""
    crosses = lambda e: ((e["y1"] > F.col("py")) != (e["y2"] > F.col("py"))) & (F.col("px") < (e["x2"] - e["x1"]) * (F.col("py") - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return F.size(F.filter("edges", crosses)) % 2 == 1


def nearest_in_time(left: DataFrame, right: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
    """``left`` (keys, key, ts) with the ``value`` of the right row closest in time, the earlier of equals.

    One pass over the union of both sides, cut into ranges of time: the last right row before
    and the first after, within the range or else handed over from the ranges beside it.
    """
    both = left.select(*keys, "ts", F.col(key).alias("__l"), F.lit(None).cast(right.schema[value].dataType).alias("__v")).unionByName(right.select(*keys, "ts", F.lit(None).cast(left.schema[key].dataType).alias("__l"), F.col(value).alias("__v")))
    own = ranged(both, keys, "ts")
    seen = F.when(F.col("__v").isNotNull(), F.struct("ts", F.col("__v").alias("v")))
    within = Window.partitionBy(*keys, "__p")
    before = F.last(seen, ignorenulls=True).over(within.orderBy("ts", F.col("__v").isNull(), "__v").rowsBetween(Window.unboundedPreceding, 0))
    back = [F.col("ts").desc(), F.col("__v").isNull().desc(), F.col("__v").desc()]  # a growing frame, read backwards
    after = F.last(seen, ignorenulls=True).over(within.orderBy(*back).rowsBetween(Window.unboundedPreceding, 0))
    ends = own.groupBy(*keys, "__p").agg(F.max(seen).alias("last"), F.min(seen).alias("first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("__p")).rowsBetween(Window.unboundedPreceding, -1)
    found = own.withColumn("__b", before).withColumn("__a", after).where(F.col("__l").isNotNull())
    found = handed_on(found, ends, keys, __pb=F.last("last", ignorenulls=True).over(earlier(keys)), __pa=F.last("first", ignorenulls=True).over(later))
    found = found.withColumn("__b", F.coalesce("__b", "__pb")).withColumn("__a", F.coalesce("__a", "__pa"))
    gap = lambda a, b: F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))
    take_after = F.col("__b").isNull() | (gap(F.col("__a.ts"), F.col("ts")) < gap(F.col("ts"), F.col("__b.ts")))
    return found.select(*keys, F.col("__l").alias(key), "ts", F.when(take_after, F.col("__a.v")).otherwise(F.col("__b.v")).alias(value))


def by_prefix(patches: DataFrame, products: DataFrame) -> DataFrame:
    """Patches (patch_id, prefix) with the first product (name) that begins with the prefix; both sides are keyed by it.

    A product's prefix is its name up to the sixth field, so the join is plain equality.
    """
    keyed = products.withColumn("prefix", F.concat(F.substring_index("name", "_", 9), F.lit("_"))).where(F.col("name").endswith(".SAFE"))
    return first_by(patches.join(keyed, "prefix"), ["patch_id"], F.col("name"))


def with_fallback(patches: DataFrame, calibration: DataFrame, order: list[str]) -> DataFrame:
    """Patches with the calibration of the first kind in ``order`` that their key has, and why there is none."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("kind"))
    usable = first_by(calibration.where(F.col("kind").isin(order)).withColumn("rank", rank), ["key"], F.col("rank"), F.col("path"))
    known = calibration.select("key").distinct().withColumn("has_any", F.lit(True))
    joined = patches.join(usable.select("key", "kind", "path"), "key", "left").join(known, "key", "left")
    return joined.withColumn("miss", F.when(F.col("path").isNotNull(), None).when(F.col("has_any"), "no_usable_kind").otherwise("no_calibration")).drop("has_any")


def image_with_label(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Joined by id without leading zeros, sorted by number."""
    number = lambda c: F.col(c).try_cast("bigint")
    return images.withColumn("n", number("image")).join(labels.withColumn("n", number("label")), "n").orderBy("n", "image", "label")


def mask_templates(masks: DataFrame) -> DataFrame:
    """(base, name): the smallest template of a mask id, under a VH and a VV name."""
    one = masks.groupBy("base").agg(F.min("path").alias("path"))
    return one.select("base", "path", F.explode(F.array(F.lit("VH"), F.lit("VV"))).alias("pol")).withColumn("name", F.concat("pol", F.lit("_"), "base"))


def prefer_split(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Each tile (tile, base, split) with one label: of its own split if there is one, else the smallest path."""
    met = tiles.join(labels.withColumnsRenamed({"split": "label_split", "path": "label_path"}), "base")
    return first_by(met, ["tile"], F.desc(F.col("split") == F.col("label_split")), F.col("label_path"))


def by_any_prefix(stems: DataFrame, files: DataFrame) -> DataFrame:
    """Stems with every file that begins with ``stem_``: a file is keyed by each of its prefixes that ends before a ``_``."""
    parts = F.split("name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    keyed = files.where(F.col("name").contains("_")).withColumn("stem", F.explode(prefixes))
    return stems.join(keyed, "stem")


def resolve_products(wanted: DataFrame, products: DataFrame, ambiguous: str = "shortest") -> DataFrame:
    """(wanted, name, status): exact name, else a product that begins with it.

    On several, ``shortest`` takes the shortest (then the smallest), ``fail`` reports it.
    """
    exact = wanted.join(products, wanted.wanted == products.name).select("wanted", "name", F.lit(0).alias("rank"))
    parts = F.split("name", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    longer = products.where(F.col("name").contains("_")).withColumn("wanted", F.explode(prefixes)).join(wanted, "wanted").select("wanted", "name", F.lit(1).alias("rank"))
    found = exact.unionByName(longer)
    sizes = found.groupBy("wanted").agg(F.count_if(F.col("rank") == 0).alias("n0"), F.count("*").alias("n"))
    best = first_by(found, ["wanted"], F.col("rank"), F.length("name"), F.col("name")).join(sizes, "wanted")
    status = F.when(F.col("n0") > 0, "exact").when(F.col("n") == 1, "prefix").otherwise("ambiguous" if ambiguous == "fail" else "shortest")
    best = best.select("wanted", F.when(status == "ambiguous", None).otherwise(F.col("name")).alias("name"), status.alias("status"))
    return wanted.join(best, "wanted", "left").fillna({"status": "missing"})


def remap_lines(points: DataFrame, lines: DataFrame, switch: int) -> DataFrame:
    """Points (line, local_line) with their place in ``lines`` (line, candidate, target): the second candidate from ``switch`` on, if there is one."""
    two = lines.groupBy("line").agg(F.min(F.struct("candidate", "target")).alias("a"), F.max(F.struct("candidate", "target")).alias("b"))
    return points.join(two, "line").withColumn("target", F.when(F.col("local_line") >= switch, F.col("b.target")).otherwise(F.col("a.target"))).drop("a", "b")
