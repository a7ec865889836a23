"""Rasters by blocks of rows: what is inside a block is done in arrays, and only its edges meet its neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import saved
from .components import connected_components

#: Rows of a block.
ROWS = 256
BIG = 1 << 32


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], list[np.ndarray]]]:
    """(key, columns) of the groups of sorted batches whose first ``keys`` columns are whole numbers."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for c in columns[:keys]:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(new), n)
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(int(c[a]) for c in columns[:keys])
            if key is not None and own != key:
                yield key, [np.concatenate(x) for x in zip(*held)]
                held = []
            key = own
            held.append([c[a:b] for c in columns[keys:]])
    if held:
        yield key, [np.concatenate(x) for x in zip(*held)]


def table(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names.split())


# ------------------------------------------------------------------ regions
def pixel_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile_id, r, lo, hi) of neighbouring pixels (tile_id, r, c) of a batch, whatever their order."""
    for batch in batches:
        tile, r, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
        if len(tile):
            order = np.lexsort((c, r, tile))
            tile, r, c = tile[order], r[order], c[order]
            first = np.concatenate([[True], (tile[1:] != tile[:-1]) | (r[1:] != r[:-1]) | (c[1:] > c[:-1] + 1)])
            last = np.append(first[1:], True)
            yield table("tile_id r lo hi", tile[first], r[first], c[first], c[last])


def overlapping(a_row: np.ndarray, a_lo: np.ndarray, a_hi: np.ndarray, b_row: np.ndarray, b_lo: np.ndarray, b_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of runs i of a and j of b that share a row and a column; runs of b are sorted and apart."""
    first = np.searchsorted(b_row * BIG + b_hi, a_row * BIG + a_lo, "left")
    end = np.searchsorted(b_row * BIG + b_lo, a_row * BIG + a_hi, "right")
    n = np.maximum(end - first, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def label_block(r: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """(r, lo, hi, root r, root c) of the whole runs of a block, whose parts are sorted by (r, lo)."""
    reach = np.maximum.accumulate(r * BIG + hi)
    first = np.flatnonzero(np.concatenate([[True], r[1:] * BIG + lo[1:] > reach[:-1] + 1]))
    r, lo, hi = r[first], lo[first], np.maximum.reduceat(hi, first)
    root = list(range(len(r)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, j in zip(*(x.tolist() for x in overlapping(r + 1, lo, hi, r, lo, hi))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    at = np.array([find(i) for i in range(len(r))], np.int64)  # the first run has the first pixel
    return r, lo, hi, r[at], lo[at]


def label_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (tile, _), (r, lo, hi) in grouped(batches, 2):
        own = label_block(r, lo, hi)
        yield table("tile_id r lo hi rr rc", np.full(len(own[0]), tile), *own)


def seam_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile_id, ar, ac, br, bc): roots that meet across a seam, from runs (tile_id, seam, below, lo, hi, rr, rc) in that order."""
    for (tile, _), (below, lo, hi, rr, rc) in grouped(batches, 2):
        a, b = below == 0, below == 1
        same = np.zeros(len(lo), np.int64)
        i, j = overlapping(same[a], lo[a], hi[a], same[b], lo[b], hi[b])
        if len(i):
            links = np.unique(np.stack([rr[a][i], rc[a][i], rr[b][j], rc[b][j]]), axis=1)
            yield table("tile_id ar ac br bc", np.full(links.shape[1], tile), *links)


def regions(mask: DataFrame, width: int | None = None, rows: int = ROWS) -> DataFrame:
    """(tile_id, r, c, region) of set pixels (tile_id, r, c), 4-neighbours; region is the smallest pixel number r * width + c of its tile.

    Pixels become runs before they are shuffled. Runs of a block of rows are joined inside a
    task; the roots of two blocks that touch are links of ``connected_components``, so what
    is joined grows with the seams. ``width`` is by default the least power of two that holds
    all columns, from 16,384 on. Null places are left out, repeated pixels count once.
    """
    places = mask.select(*[F.col(c).cast("bigint").alias(c) for c in ("tile_id", "r", "c")]).dropna()
    block = F.floor(F.col("r") / rows)
    runs = places.mapInArrow(pixel_runs, "tile_id bigint, r bigint, lo bigint, hi bigint").withColumn("block", block)
    runs = runs.repartition("tile_id", "block").sortWithinPartitions("tile_id", "block", "r", "lo").select("tile_id", "block", "r", "lo", "hi")
    labelled = saved(runs.mapInArrow(label_blocks, "tile_id bigint, r bigint, lo bigint, hi bigint, rr bigint, rc bigint"), "region-runs")
    at_seam = [F.struct((block + k).alias("seam"), F.lit(below).alias("below")) for k, below in ((1, 0), (0, 1))]
    edge = F.array_compact(F.array(F.when(F.pmod("r", F.lit(rows)) == rows - 1, at_seam[0]), F.when(F.pmod("r", F.lit(rows)) == 0, at_seam[1])))
    seams = labelled.select("tile_id", F.explode(edge).alias("e"), "lo", "hi", "rr", "rc").select("tile_id", "e.seam", "e.below", "lo", "hi", "rr", "rc")
    seams = seams.repartition("tile_id", "seam").sortWithinPartitions("tile_id", "seam", "below", "lo")
    met = seams.mapInArrow(seam_links, "tile_id bigint, ar bigint, ac bigint, br bigint, bc bigint")
    node = lambda r, c: F.struct("tile_id", F.col(r).alias("r"), F.col(c).alias("c"))
    roots = connected_components(met.select(node("ar", "ac").alias("a"), node("br", "bc").alias("b")))
    own = labelled.withColumn("root", node("rr", "rc")).join(roots, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("component", "root"))
    if width is None:
        widest = labelled.agg(F.max("hi").alias("c")).first().c or 0
        width = max(1 << 14, 1 << int(widest).bit_length())
    kinds = {f.name: f.dataType for f in mask.schema}
    pixels = own.select("tile_id", "r", F.explode(F.sequence("lo", "hi")).alias("c"), (F.col("root.r") * width + F.col("root.c")).alias("region"))
    return pixels.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("tile_id", "r", "c")], "region")


# ------------------------------------------------------------ local filters
#: States of a place of a block.
ABSENT, NULL, HELD = 0, 1, 2
BLOCK = "tile_id bigint, block bigint, v binary, s binary, first_v binary, first_s binary, last_v binary, last_s binary"


def dense_blocks(batches: Iterator[pa.RecordBatch], rows: int, height: int, width: int) -> Iterator[pa.RecordBatch]:
    for (tile, block), (r, c, value) in grouped(batches, 2):
        n = min(rows, height - block * rows)
        v, s = np.zeros((n, width)), np.zeros((n, width), np.uint8)
        at = (r - block * rows).astype(np.int64), c.astype(np.int64)
        value = value.astype(np.float64)
        v[at], s[at] = np.where(np.isnan(value), 0, value), np.where(np.isnan(value), NULL, HELD)
        parts = (v, s, v[0], s[0], v[-1], s[-1])
        yield pa.RecordBatch.from_arrays([pa.array([tile]), pa.array([block]), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], [x.split()[0] for x in BLOCK.split(", ")])


def local_moments(v: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of the nine values around each place of a block that has a row more on either side; columns repeat at the edges."""
    v, held = (np.pad(x, ((0, 0), (1, 1)), mode="edge") for x in (v, (s == HELD).astype(np.float64)))
    h, w = v.shape[0] - 2, v.shape[1] - 2
    around = [(v[a : a + h, b : b + w], held[a : a + h, b : b + w]) for a in range(3) for b in range(3)]
    n = np.maximum(sum(k for _, k in around), 1)
    mean = sum(x * k for x, k in around) / n
    return mean, sum(k * (x - mean) ** 2 for x, k in around) / n


def block_moments(batches: Iterator[pa.RecordBatch], rows: int, height: int, width: int) -> Iterator[pa.RecordBatch]:
    names = ["tile_id", "block", "v", "s", "mean", "var", "noise", "n"]
    for batch in batches:
        for row in batch.to_pylist():
            v, s = np.frombuffer(row["v"]).reshape(-1, width), np.frombuffer(row["s"], np.uint8).reshape(-1, width)
            edges = []
            for side, at_border, own in (("above", row["block"] == 0, 0), ("below", row["block"] * rows + len(v) == height, -1)):
                if at_border:
                    edges.append((v[own], s[own]))
                else:
                    ev, es = row[f"{side}_v"], row[f"{side}_s"]
                    edges.append((np.frombuffer(ev), np.frombuffer(es, np.uint8)) if ev is not None else (np.zeros(width), np.zeros(width, np.uint8)))
            mean, var = local_moments(*(np.vstack([edges[0][k], (v, s)[k], edges[1][k]]) for k in (0, 1)))
            there = s != ABSENT
            yield pa.RecordBatch.from_pylist([{"tile_id": row["tile_id"], "block": row["block"], "v": row["v"], "s": row["s"], "mean": mean.tobytes(), "var": var.tobytes(), "noise": float(var[there].sum()), "n": int(there.sum())}], schema=pa.schema([(n, pa.binary() if n in ("v", "s", "mean", "var") else pa.float64() if n == "noise" else pa.int64()) for n in names]))


def filtered_pixels(batches: Iterator[pa.RecordBatch], rows: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            v, mean, var = (np.frombuffer(row[k]).reshape(-1, width) for k in ("v", "mean", "var"))
            s, noise = np.frombuffer(row["s"], np.uint8).reshape(-1, width), row["noise"]
            gain = np.where(var > 0, np.maximum(var - noise, 0) / np.maximum(np.maximum(var, noise), 1e-300), 0)
            r, c = np.nonzero(s != ABSENT)
            out = (mean + gain * (v - mean))[r, c]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), row["tile_id"])), pa.array(r + row["block"] * rows), pa.array(c), pa.array(out, mask=(s[r, c] == NULL))], ["tile_id", "r", "c", "filtered"])


def adaptive_filter(pixels: DataFrame, value: str, height: int, width: int, rows: int = ROWS) -> DataFrame:
    """(tile_id, r, c, filtered): local mean plus the share of local variance above the tile's noise times the deviation from it.

    Local is 3 x 3, beyond an edge the edge counts; noise is the mean local variance. A block
    gets one row of values from the block above and one from that below; missing places and
    null values count nowhere, and a null value gives null.
    """
    places = pixels.select(F.col("tile_id").cast("bigint").alias("tile_id"), F.floor(F.col("r") / rows).alias("block"), F.col("r").cast("bigint").alias("r"), F.col("c").cast("bigint").alias("c"), F.col(value).cast("double").alias("value"))
    places = places.repartition("tile_id", "block").sortWithinPartitions("tile_id", "block", "r", "c")
    blocks = saved(places.mapInArrow(lambda b: dense_blocks(b, rows, height, width), BLOCK), "filter-blocks")
    edge = lambda side, step, name: blocks.select("tile_id", (F.col("block") + step).alias("block"), F.col(f"{side}_v").alias(f"{name}_v"), F.col(f"{side}_s").alias(f"{name}_s"))
    met = blocks.select("tile_id", "block", "v", "s").join(edge("last", 1, "above"), ["tile_id", "block"], "left").join(edge("first", -1, "below"), ["tile_id", "block"], "left")
    schema = "tile_id bigint, block bigint, v binary, s binary, mean binary, var binary, noise double, n bigint"
    local = saved(met.mapInArrow(lambda b: block_moments(b, rows, height, width), schema), "filter-moments")
    noise = local.groupBy("tile_id").agg((F.sum("noise") / F.sum("n")).alias("noise"))
    kinds = {f.name: f.dataType for f in pixels.schema}
    own = local.select("tile_id", "block", "v", "s", "mean", "var").join(noise, "tile_id").mapInArrow(lambda b: filtered_pixels(b, rows, width), "tile_id bigint, r bigint, c bigint, filtered double")
    return own.select(*[F.col(c).cast(kinds[c]).alias(c) for c in ("tile_id", "r", "c")], "filtered")


# -------------------------------------------------------------------- rings
#: Cells of distances that are computed from a region's pixels at once; larger regions are widened step by step.
NEAR_CELLS = 1 << 18
#: Pixels and extent up to which a region is done with others of its shape, and shapes that a task remembers.
SHAPE, SHAPES = 64, 4096


def distance_rings(r: np.ndarray, c: np.ndarray, shape: tuple[int, int], inner: int, outer: int) -> np.ndarray:
    """Which cells of a window lie at an L1 distance in (inner, outer] of its pixels (r, c)."""
    if len(r) * shape[0] * shape[1] <= NEAR_CELLS:
        y, x = np.arange(shape[0])[:, None], np.arange(shape[1])[:, None]
        far = (np.abs(y - r)[:, None, :] + np.abs(x - c)[None, :, :]).min(-1)
        return (far > inner) & (far <= outer)
    grown = np.zeros(shape, bool)
    grown[r, c] = True
    close = grown
    for k in range(1, outer + 1):
        wide = grown.copy()
        wide[1:] |= grown[:-1]
        wide[:-1] |= grown[1:]
        wide[:, 1:] |= grown[:, :-1]
        wide[:, :-1] |= grown[:, 1:]
        grown = wide
        close = grown if k == inner else close
    return grown & ~close


def stat_of(values: np.ndarray, method: str, trim: float = 0.1) -> float:
    """Mean, median, p90 or trimmed mean, as ``aggregates.list_stat`` has them."""
    if method == "mean":
        return float(values.mean())
    own, n = np.sort(values), len(values)
    if method == "trimmed_mean":
        cut = int(n * trim)
        return float(own[cut : n - cut].mean())
    at = {"median": 0.5, "p90": 0.9}[method] * (n - 1)
    lo = int(at)
    return float(own[lo] if lo == at else own[lo] * (lo + 1 - at) + own[lo + 1] * (at - lo))


def ring_of(y: np.ndarray, x: np.ndarray, inner: int, outer: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ring of a shape whose pixels (y, x) begin at 0, row by row."""
    dy, dx = np.nonzero(distance_rings(y + outer, x + outer, (int(y.max()) + 1 + 2 * outer, int(x.max()) + 1 + 2 * outer), inner, outer))
    return dy - outer, dx - outer


def stats_of(values: np.ndarray, held: np.ndarray, n: np.ndarray, method: str) -> np.ndarray:
    """``stat_of`` of the n held values of each row, at least one."""
    if method not in ("median", "p90"):
        return np.array([stat_of(v[h], method) for v, h in zip(values, held)])
    own, row = np.sort(np.where(held, values, np.nan), axis=1), np.arange(len(n))  # NaN comes last, held or not
    at = {"median": 0.5, "p90": 0.9}[method] * (n - 1)
    lo = at.astype(np.int64)
    with np.errstate(invalid="ignore"):
        between = own[row, lo] * (lo + 1 - at) + own[row, np.minimum(lo + 1, n - 1)] * (at - lo)
    return np.where(lo == at, own[row, lo], between)


def block_rings(batches: Iterator[pa.RecordBatch], rows: int, inner: int, outer: int, method: str | None = None) -> Iterator[pa.RecordBatch]:
    """(tile_id, region, background, values): what the rings of regions hold on the rows of a block, from rows (tile_id, block, r, c, value, region, held).

    With a method, a ring that lies in the block alone is its statistic, and has no values;
    ``total`` gives rows (tile_id, region, n, total) instead, with the number and sum of the values.
    Small regions of one shape have one ring, which is found once and laid on all of them;
    others are done one by one.
    """
    known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
    for (tile, block), (r, c, value, region, held) in grouped(batches, 2):
        r, c, region, held = r.astype(np.int64), c.astype(np.int64), region.astype(np.int64), held.astype(bool)
        inside = region >= 0
        if not inside.any():
            continue
        top, left = block * rows, int(c.min())
        r, c, width = r - top, c - left, int(c.max()) - left + 1  # rows of the block itself are 0 to rows - 1
        low, wide = min(0, int(r.min())), width + 2 * outer
        power_all, free_all = np.zeros((rows + 4 * outer, wide)), np.zeros((rows + 4 * outer, wide), bool)  # with room for any ring
        power, free = (x[2 * outer : 2 * outer + rows, outer : outer + width] for x in (power_all, free_all))
        own = held & (r >= 0) & (r < rows)
        power[r[own], c[own]] = value[own]
        free[r[own], c[own]] = True
        marked = inside & (r >= 0) & (r < rows)
        free[r[marked], c[marked]] = False
        power_at, free_at = power_all.ravel(), free_all.ravel()
        order = np.lexsort((c[inside], r[inside], region[inside]))
        rr, cc, names = r[inside][order], c[inside][order], region[inside][order]
        cuts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1], [True]]))
        names, size = names[cuts[:-1]], np.diff(cuts)
        y0, y1, x0, x1 = (f.reduceat(v, cuts[:-1]) for v in (rr, cc) for f in (np.minimum, np.maximum))
        alone = ((y0 >= outer) | (block == 0)) & (y1 + outer < rows) & (method not in (None, "total"))
        small = (size <= SHAPE) & (y1 - y0 < SHAPE) & (x1 - x0 < SHAPE)
        at = ((rr - np.repeat(y0, size)) * SHAPE + cc - np.repeat(x0, size)).astype(np.int32)
        shapes: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(small).tolist():
            shapes.setdefault(at[cuts[i] : cuts[i + 1]].tobytes(), []).append(i)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # regions, statistics, numbers of values, values
        for shape, like in shapes.items():
            if shape not in known:
                if len(known) >= SHAPES:
                    known.clear()
                known[shape] = ring_of(*np.divmod(np.frombuffer(shape, np.int32).astype(np.int64), SHAPE), inner, outer)
            dy, dx = known[shape]
            together = max(1, NEAR_CELLS // max(1, len(dy)))
            for k in range(0, len(like), together):
                own = np.array(like[k : k + together])
                places = ((y0[own] + 2 * outer) * wide + x0[own] + outer)[:, None] + (dy * wide + dx)[None, :]
                on = free_at[places]
                n = on.sum(axis=1)
                if not n.all():
                    own, places, on, n = own[n > 0], places[n > 0], on[n > 0], n[n > 0]
                held_alone = alone[own]
                stats, open_ = np.full(len(own), np.nan), ~held_alone
                if held_alone.any():
                    stats[held_alone] = stats_of(power_at[places[held_alone]], on[held_alone], n[held_alone], method)
                found.append((own, stats, np.where(held_alone, 0, n), power_at[places[open_][on[open_]]]))
        for i in np.flatnonzero(~small).tolist():
            y, x = rr[cuts[i] : cuts[i + 1]], cc[cuts[i] : cuts[i + 1]]
            t, b = max(low, int(y0[i]) - outer), min(rows + outer, int(y1[i]) + outer + 1)
            l, e = max(0, int(x0[i]) - outer), min(width, int(x1[i]) + outer + 1)  # noqa: E741
            f0, f1 = max(t, 0), min(b, rows)
            if f1 > f0:
                ring = distance_rings(y - t, x - l, (b - t, e - l), inner, outer)
                values = power[f0:f1, l:e][ring[f0 - t : f1 - t] & free[f0:f1, l:e]]
                if len(values):
                    found.append((np.array([i]), np.array([stat_of(values, method) if alone[i] else np.nan]), np.array([0 if alone[i] else len(values)]), values[:0] if alone[i] else values))
        who, stats, n, values = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
        if len(who) and method == "total":
            yield table("tile_id region n total", np.full(len(who), tile), names[who], n, np.add.reduceat(values, np.cumsum(n) - n))
        elif len(who):
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), tile)), pa.array(names[who]), pa.array(stats, pa.float64(), mask=~alone[who]), lists], ["tile_id", "region", "background", "values"])


def ring_rows(labelled: DataFrame, pixels: DataFrame, value: str, inner: int, outer: int, rows: int, method: str | None) -> DataFrame:
    places = lambda df, v, region, held: df.select(*[F.col(k).cast("bigint").alias(k) for k in ("tile_id", "r", "c")], v.alias("value"), region.alias("region"), F.lit(held).alias("held"))
    both = places(pixels.where(F.col(value).isNotNull()), F.col(value).cast("double"), F.lit(-1).cast("bigint"), 1).unionByName(places(labelled, F.lit(0.0), F.col("region").cast("bigint"), 0))
    block = F.explode(F.sequence(F.floor((F.col("r") - outer) / rows), F.floor((F.col("r") + outer) / rows)))
    dealt = both.dropna().withColumn("block", block).repartition("tile_id", "block").sortWithinPartitions("tile_id", "block")
    out = "n bigint, total double" if method == "total" else "background double, values array<double>"
    return dealt.select("tile_id", "block", "r", "c", "value", "region", "held").mapInArrow(lambda b: block_rings(b, rows, inner, outer, method), f"tile_id bigint, region bigint, {out}")


def ring_values(labelled: DataFrame, pixels: DataFrame, value: str, inner: int = 3, outer: int = 12, rows: int = ROWS) -> DataFrame:
    """(tile_id, region, values): the values of the pixels at an L1 distance in (inner, outer] of a region and in none, in parts by blocks of rows.

    A block also gets the ``outer`` rows before and after it, so a row is sent to two blocks
    near a border and else to one. Pixels without a value are left out.
    """
    return ring_rows(labelled, pixels, value, inner, outer, rows, None).drop("background")


def ring_totals(labelled: DataFrame, pixels: DataFrame, value: str, inner: int = 3, outer: int = 12, rows: int = ROWS) -> DataFrame:
    """(tile_id, region, n, total): number and sum of what ``ring_values`` has; the values themselves do not leave their block."""
    parts = ring_rows(labelled, pixels, value, inner, outer, rows, "total")
    return parts.groupBy("tile_id", "region").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def ring_stats(labelled: DataFrame, pixels: DataFrame, value: str, method: str, inner: int = 3, outer: int = 12, rows: int = ROWS) -> DataFrame:
    """(tile_id, region, background): a statistic of each ring. Only rings that reach over blocks are put together from their values."""
    from .aggregates import parts_stat

    parts = saved(ring_rows(labelled, pixels, value, inner, outer, rows, method), "rings")
    own = parts.where("background IS NOT NULL").select("tile_id", "region", "background")
    return own.unionByName(parts_stat(parts.where("background IS NULL"), ["tile_id", "region"], "values", method))
