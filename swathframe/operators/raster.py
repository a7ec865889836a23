"""Raster and region analytics on pixel tables (tile_id, r, c, ...): joins and aggregates only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import adaptive_filter, regions, ring_stats, ring_totals, ring_values  # noqa: F401
from .lines import best_lag  # noqa: F401

PIXEL = ["tile_id", "r", "c"]


def span(n: Column | int, start: int = 0) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.explode(F.sequence(F.lit(start), n.cast("int") - 1 + start))


def tile_grid(bursts: DataFrame, size: int) -> DataFrame:
    """(key columns, tile row and column, corners) of windows that fit in bursts (.., width, height)."""
    rows, cols = F.expr(f"height div {size}"), F.expr(f"width div {size}")
    fits = bursts.where((rows > 0) & (cols > 0)).withColumn("tr", span(rows)).withColumn("tc", span(cols))
    return fits.withColumns({"top": F.col("tr") * size, "left": F.col("tc") * size, "bottom": (F.col("tr") + 1) * size - 1, "right": (F.col("tc") + 1) * size - 1})


def zero_fraction(pixels: DataFrame, value: str) -> DataFrame:
    return pixels.groupBy("tile_id").agg((F.count_if(F.col(value) == 0) / F.count("*")).alias("zero_fraction"))


def combined_power(vv: DataFrame, vh: DataFrame) -> DataFrame:
    """|VV|^2 + |VH|^2 of pixels (tile_id, r, c, i, q) that both have."""
    p = lambda s: F.col(f"{s}.i") * F.col(f"{s}.i") + F.col(f"{s}.q") * F.col(f"{s}.q")
    return vv.alias("a").join(vh.alias("b"), PIXEL).select(*PIXEL, (p("a") + p("b")).alias("power"))


def fit_to(pixels: DataFrame, tiles: DataFrame, size: int, value: str) -> DataFrame:
    """Centre crop or zero padding of tiles (tile_id, h, w) to size x size."""
    grid = tiles.withColumn("r", span(size)).withColumn("c", span(size))
    moved = grid.withColumn("sr", F.col("r") + F.floor((F.col("h") - size) / 2).cast("int")).withColumn("sc", F.col("c") + F.floor((F.col("w") - size) / 2).cast("int"))
    source = pixels.select("tile_id", F.col("r").alias("sr"), F.col("c").alias("sc"), value)
    return moved.join(source, ["tile_id", "sr", "sc"], "left").select(*PIXEL, F.coalesce(value, F.lit(0)).alias(value))


def pixel_id(width: int = 1 << 20) -> Column:
    return F.col("tile_id") * (width * width) + F.col("r") * width + F.col("c")


def region_table(labelled: DataFrame, least: int = 1) -> DataFrame:
    """(tile_id, region, area, box) of regions of at least ``least`` pixels."""
    own = labelled.groupBy("tile_id", "region").agg(F.count("*").alias("area"), F.min("r").alias("top"), F.min("c").alias("left"), F.max("r").alias("bottom"), F.max("c").alias("right"))
    return own.where(F.col("area") >= least)


def edge_spans(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(key, r, lo, hi) of the columns inside on each row of rings (key, edges)."""
    whole = lambda x: np.clip(np.nan_to_num(np.ceil(x - 0.5), nan=0.0), -1, size + 1).astype(np.int64)
    for batch in batches:
        edges = batch.column(1)
        polygon, parts = pc.list_parent_indices(edges).to_numpy(), pc.list_flatten(edges).flatten()
        held = np.logical_and.reduce([p.is_valid().to_numpy(zero_copy_only=False) for p in parts])
        x1, y1, x2, y2 = (p.to_numpy(zero_copy_only=False)[held] for p in parts)
        # a row's centre line is cut if one end is above it (half-open); an end that is no number cuts none
        lo, hi = np.maximum(whole(np.fmin(y1, y2)), 0), np.minimum(whole(np.maximum(y1, y2)), size)
        n = np.maximum(hi - lo, 0)
        i = np.repeat(np.arange(len(n)), n)
        r = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
        x = (x2[i] - x1[i]) * (r + 0.5 - y1[i]) / (y2[i] - y1[i]) + x1[i]
        line = polygon[held][i] * np.int64(size) + r
        order = np.lexsort((x, line))
        line, x = line[order], x[order]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
        nth = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        odd = np.flatnonzero((nth[:-1] % 2 == 0) & (line[1:] == line[:-1]))
        start, stop = np.maximum(whole(x[odd]), 0), np.minimum(whole(x[odd + 1]), size) - 1
        odd, start, stop = (v[start <= stop] for v in (odd, start, stop))
        key = batch.column(0).take(pa.array(line[odd] // size))
        yield pa.RecordBatch.from_arrays([key, *[pa.array(v.astype(np.int32)) for v in (line[odd] % size, start, stop)]], [batch.schema.names[0], "r", "lo", "hi"])


def rasterise(polygons: DataFrame, key: str, size: int) -> DataFrame:
    """(key, r, c) of every pixel of a size x size raster whose centre lies inside the polygon (key, ord, px, py).

    By rows: an edge cuts the centre lines of the rows that it spans (half-open), and what
    lies between an odd cut of a row and the next is inside, so work grows with rows and
    pixels inside, not with the raster. A ring is one row, whose cuts are ordered where it
    is: nothing is grouped again.
    """
    from .joins import polygon_edges

    rings = polygon_edges(polygons.withColumns({c: F.col(c).cast("double") for c in ("px", "py")}), key).select(key, "edges")
    kind = polygons.schema[key].dataType.simpleString()
    inside = rings.mapInArrow(lambda b: edge_spans(b, size), f"`{key}` {kind}, r int, lo int, hi int")
    return inside.select(key, "r", F.explode(F.sequence("lo", "hi")).alias("c"))


def background_ring(labelled: DataFrame, pixels: DataFrame, inner: int = 3, outer: int = 12) -> DataFrame:
    """(tile_id, region, r, c, ...) of pixels at an L1 distance in (inner, outer] of a region and in none.

    What lies within a distance of a run of columns is an interval on each row near it, so a
    run is spread over 2 * outer + 1 rows and not over every pixel around every pixel; the
    intervals of a row then give its columns once.
    """
    row = Window.partitionBy("tile_id", "region", "r").orderBy("c")
    runs = labelled.select("tile_id", "region", "r", "c", (F.col("c") - F.row_number().over(row)).alias("run"))
    runs = runs.groupBy("tile_id", "region", "r", "run").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    reach = lambda d: F.when(F.abs("dr") <= d, F.struct((F.col("lo") - d + F.abs("dr")).alias("lo"), (F.col("hi") + d - F.abs("dr")).alias("hi")))
    spread = runs.withColumn("dr", F.explode(F.sequence(F.lit(-outer), F.lit(outer)))).select("tile_id", "region", (F.col("r") + F.col("dr")).alias("r"), reach(outer).alias("far"), reach(inner).alias("close"))
    rows = spread.groupBy("tile_id", "region", "r").agg(F.collect_set("far").alias("far"), F.collect_set("close").alias("close"))
    columns = lambda spans: F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["lo"], s["hi"]))))
    near = rows.select("tile_id", "region", "r", F.explode(F.array_except(columns("far"), columns("close"))).alias("c"))
    # what is spread out here is far more than its source, by which Spark would choose to broadcast it
    return near.join(labelled.select(*PIXEL).hint("shuffle_merge"), PIXEL, "left_anti").join(pixels.hint("shuffle_merge"), PIXEL)


#: What is done with a region or patch whose contrast passes the threshold.
MODES = ("keep_high_rfi", "remove_high_rfi")


def decided(high: Column, mode: str) -> Column:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    return high if mode == "keep_high_rfi" else ~high


def region_contrast(labelled: DataFrame, pixels: DataFrame, threshold: float, region: str = "mean", background: str = "median", least: int = 1, inner: int = 3, outer: int = 12, mode: str = "keep_high_rfi") -> DataFrame:
    """(tile_id, region, area, db, keep): contrast of each region with its ring, and whether the mode keeps it.

    A region without a ring, or without power, has neither contrast nor a place in the mask, in either mode.
    """
    from ..functions.columns import contrast_db
    from .aggregates import background_stat

    table = region_table(labelled, least)
    inside = background_stat(labelled.join(pixels.hint("shuffle_merge"), PIXEL).where(F.col("power").isNotNull() & ~F.isnan(F.col("power").cast("double"))), ["tile_id", "region"], "power", region).withColumnRenamed("background", "signal")
    ring = ring_stats(labelled, pixels, "power", background, inner, outer)
    own = table.join(inside, ["tile_id", "region"], "left").join(ring, ["tile_id", "region"], "left")
    known = F.col("signal").isNotNull() & F.col("background").isNotNull()
    own = own.withColumn("db", F.when(known, contrast_db(F.col("signal"), F.col("background"))))
    return own.withColumn("keep", F.when(known, decided(F.col("db") > threshold, mode)).otherwise(F.lit(False)))


def patch_contrast(pixels: DataFrame, threshold: float, mode: str = "keep_high_rfi") -> DataFrame:
    """(tile_id, db, kept): mean power of mask pixels against the median of the others.

    A tile without mask pixels is not kept; one that is all mask has no contrast and is kept, in either mode.
    """
    from ..functions.columns import contrast_db
    from .aggregates import group_quantiles

    signal = pixels.groupBy("tile_id").agg(F.avg(F.when(F.col("is_mask"), F.col("power"))).alias("signal"))
    others = group_quantiles(pixels.where(~F.col("is_mask")), ["tile_id"], "power", background=0.5)
    own = signal.join(others, "tile_id", "left")
    db = F.when(F.col("signal").isNotNull() & F.col("background").isNotNull(), contrast_db(F.col("signal"), F.col("background")))
    kept = F.when(F.col("signal").isNull(), F.lit(False)).when(F.col("background").isNull(), F.lit(True)).otherwise(decided(F.col("db") > threshold, mode))
    return own.withColumn("db", db).withColumn("kept", kept)


def keep_summary(decisions: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: kept, rejected and failed (expected without a decision)."""
    joined = expected.select("tile_id").join(decisions.select("tile_id", "kept"), "tile_id", "left")
    return joined.agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if(F.col("kept").isNull()).alias("failed"))


def any_positive(pixels: DataFrame, windows: DataFrame, scale: float) -> DataFrame:
    """(tile_id, window, label): 1 if any mask pixel lies in a window (top, left, bottom, right) scaled by ``scale``.

    A window meets pixels by its rows, so the join is an equality on (tile_id, r).
    """
    edge = lambda c: F.floor(F.col(c) * scale).cast("int")
    lines = windows.withColumn("r", F.explode(F.sequence(edge("top"), edge("bottom")))).withColumn("lo", edge("left")).withColumn("hi", edge("right"))
    hit = lines.join(pixels.where("is_mask"), ["tile_id", "r"]).where(F.col("c").between(F.col("lo"), F.col("hi"))).select("tile_id", "window").distinct().withColumn("hit", F.lit(1))
    return windows.select("tile_id", "window").join(hit, ["tile_id", "window"], "left").select("tile_id", "window", F.coalesce("hit", F.lit(0)).alias("label"))


def resample_nearest(pixels: DataFrame, tiles: DataFrame, size: int, value: str) -> DataFrame:
    """Tiles (tile_id, h, w) at size x size: the pixel under each centre."""
    grid = tiles.withColumn("r", span(size)).withColumn("c", span(size))
    at = grid.withColumn("sr", F.floor((F.col("r") + 0.5) * F.col("h") / size).cast("int")).withColumn("sc", F.floor((F.col("c") + 0.5) * F.col("w") / size).cast("int"))
    return at.join(pixels.select("tile_id", F.col("r").alias("sr"), F.col("c").alias("sc"), value), ["tile_id", "sr", "sc"]).select(*PIXEL, value)


def multilook(pixels: DataFrame, m: int, n: int, height: int, width: int, value: str) -> DataFrame:
    """Block averages; rows and columns beyond whole blocks are left out."""
    kept = pixels.where((F.col("r") < height // m * m) & (F.col("c") < width // n * n))
    return kept.groupBy("tile_id", F.expr(f"r div {m}").alias("r"), F.expr(f"c div {n}").alias("c")).agg(F.avg(value).alias(value))


def sinc_resample(samples: DataFrame, keys: list[str], n_in: int, n_out: int, half: int = 8) -> DataFrame:
    """Lines (keys, s, value) of n_in samples at n_out positions: Hann-windowed sinc over 2 * half neighbours, weights summing to 1.

    Each sample goes to the positions that it is a neighbour of, so nothing is joined.
    """
    x = F.col("x") - F.col("s")
    pi = 3.141592653589793
    sinc = F.when(F.abs(x) < 1e-12, 1.0).otherwise(F.sin(x * pi) / (x * pi))
    weight = sinc * (0.5 + 0.5 * F.cos(x * pi / half))
    # one position more on either side than the division gives, as its rounding may be off; the places decide
    first, last = F.floor((F.col("s") - half) * n_out / n_in).cast("int") - 1, F.ceil((F.col("s") + half) * n_out / n_in).cast("int") + 1
    near = samples.where(F.col("s").between(0, n_in - 1)).withColumn("lo", F.greatest(F.lit(0), first)).withColumn("hi", F.least(F.lit(n_out - 1), last)).where("lo <= hi")
    met = near.withColumn("o", F.explode(F.sequence("lo", "hi"))).withColumn("x", F.col("o") * n_in / n_out)
    met = met.where((F.col("s") > F.floor("x") - half) & (F.col("s") <= F.floor("x") + half)).withColumn("wt", weight)
    return met.groupBy(*keys, "o").agg((F.sum(F.col("wt") * F.col("value")) / F.sum("wt")).alias("value"))


def sub_window(pixels: DataFrame, windows: DataFrame, extent: tuple[int, int]) -> DataFrame:
    """Pixels of windows (tile_id, window, top, left, height, width) in window coordinates, clipped to the extent, with a warning where clipped."""
    h, w = extent
    clip = windows.withColumn("truncated", (F.col("top") < 0) | (F.col("left") < 0) | (F.col("top") + F.col("height") > h) | (F.col("left") + F.col("width") > w))
    lines = clip.withColumn("r", F.explode(F.sequence(F.greatest(F.lit(0), F.col("top")), F.least(F.lit(h), F.col("top") + F.col("height")) - 1)))
    met = lines.join(pixels, ["tile_id", "r"]).where((F.col("c") >= F.col("left")) & (F.col("c") < F.col("left") + F.col("width")))
    return met.withColumn("wr", F.col("r") - F.col("top")).withColumn("wc", F.col("c") - F.col("left"))


def crop_to_valid(mask: DataFrame, margin: int = 2) -> DataFrame:
    """Pixels of the box around a tile's set pixels, drawn in by ``margin`` on each side."""
    box = mask.where("is_mask").groupBy("tile_id").agg((F.min("r") + margin).alias("r0"), (F.max("r") - margin).alias("r1"), (F.min("c") + margin).alias("c0"), (F.max("c") - margin).alias("c1"))
    return mask.join(box, "tile_id").where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))).drop("r0", "r1", "c0", "c1")


def projected_bounds(corners: DataFrame, key: str, ax: tuple[float, float, float], ay: tuple[float, float, float], width: int, height: int) -> DataFrame:
    """Bounds of corners (key, px, py) on another grid under two planes (constant, by x, by y), clamped, at least one pixel."""
    x = F.lit(ax[0]) + ax[1] * F.col("px") + ax[2] * F.col("py")
    y = F.lit(ay[0]) + ay[1] * F.col("px") + ay[2] * F.col("py")
    at = lambda c, hi: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(hi - 1)).cast("int")
    own = corners.groupBy(key).agg(at(F.min(x), width).alias("x0"), at(F.max(x), width).alias("x1"), at(F.min(y), height).alias("y0"), at(F.max(y), height).alias("y1"))
    return own.withColumn("x1", F.greatest("x1", F.col("x0") + 1)).withColumn("y1", F.greatest("y1", F.col("y0") + 1))
