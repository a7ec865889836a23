"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors within an angle are within a distance eps. They are projected on leading
principal dimensions (a projection never lengthens a distance), sorted by the grid cells of
width eps on those, and cut into blocks: intervals of the sequence, each with a bounding
box over the projections and the length of what is left beside them (two such lengths differ
by no more than the vectors do). Interval pairs are joined recursively, from whole labels
down to blocks and inside a task from blocks to leaves of a few rows; a pair whose boxes are
further apart than eps is skipped with all below it. What is left is compared exactly, in
double precision.

Equal vectors of a label are one vector with a weight, so a group of copies of any size is a
single row. A hot label only has more blocks. Block pairs are dealt in cells of ``CELL`` by
``CELL`` blocks, and a cell gets each block that it needs once. A block pair returns a row for
each vector with a link (its number of links and the root of its local component), never the
pairs themselves.

Edge cases: vectors that are null, zero or hold null or non-finite components, and rows
with a null label, link with nothing; vectors of other lengths never link; a null vec_id
is a vector that names no component; rows with one vec_id are vectors of their own; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from ..plans.storage import saved

#: Vectors in a block and in a leaf; dimensions of the grid and of boxes; intervals of one level in one of the next; blocks to a side of a cell.
BLOCK, LEAF, DIMS, BOX, FAN, CELL = 1024, 32, 6, 16, 8, 8
#: Principal directions are found for so many vector lengths (those of most rows), up to so many components; the rest use their first components.
LENGTHS, WIDEST = 16, 512
#: What rounding may add to a distance.
SLACK = 1e-6


def usable(vector: str = "embedding"):
    """Null-free and finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def units(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal(rows: DataFrame) -> dict[int, np.ndarray]:
    """Leading principal directions (dim x BOX) of the unit vectors, by length, from sums over all rows."""
    lengths = [r.dim for r in rows.where(F.col("dim") <= WIDEST).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS).collect()]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim")["embedding"]:
                x = units(part)
                x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
                total[dim] = total.get(dim, 0) + x.T @ x
        for dim, m in total.items():
            yield pd.DataFrame({"dim": dim, "place": np.arange(m.size), "v": m.ravel()})

    found: dict[int, np.ndarray] = {}
    for r in rows.where(F.col("dim").isin(lengths)).select("dim", "embedding").mapInPandas(sums, "dim int, place int, v double").groupBy("dim", "place").agg(F.sum("v").alias("v")).collect():
        found.setdefault(r.dim, np.zeros((r.dim + 1) ** 2))[r.place] = r.v
    out = {}
    for dim, m in found.items():
        m = m.reshape(dim + 1, dim + 1)
        mean = m[-1, :-1] / m[-1, -1]
        _, axes = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[dim] = axes[:, ::-1][:, :BOX]
    return out


def coordinates(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """(n, BOX + 1): projections of unit vectors and the length of the rest; points are never further apart than the vectors."""
    axis = axes.get(x.shape[1])
    at = x @ axis if axis is not None else x[:, :BOX]
    rest = np.sqrt(np.maximum(0, 1 - (at * at).sum(axis=1)))
    return np.concatenate([np.pad(at, ((0, 0), (0, BOX - at.shape[1]))), rest[:, None]], axis=1)


def blocks_of(rows: DataFrame, axes: dict[int, np.ndarray], eps: float) -> DataFrame:
    """Blocks (label, dim, place, uids, weights, vectors, lo, hi) of vectors in grid order; place numbers them within (label, dim)."""
    cells = [f"c{i}" for i in range(DIMS)]

    def gridded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("dim"):
                at = np.floor(coordinates(units(part["embedding"]), axes) / eps).astype(np.int32)
                yield part.assign(**{c: at[:, i] for i, c in enumerate(cells)})

    order = ["label", "dim", *cells, "uid"]
    own = ["uid", "label", "dim", "weight", "embedding"]
    kinds = {c: rows.schema[c].dataType.simpleString() for c in own}
    placed = rows.select(*own).mapInPandas(gridded, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", " + ", ".join(f"{c} int" for c in cells))
    placed = saved(placed, "grid")
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def block() -> pd.DataFrame:
            part = pd.concat(held)
            x = np.array([np.asarray(v, np.float64) for v in part["embedding"]])
            at = coordinates(units(x), axes)
            fine = np.lexsort(np.floor(at[:, :DIMS] * 4 / eps).T[::-1])  # rows of a leaf lie close together
            part, x = part.iloc[fine], x[fine]
            return pd.DataFrame({"label": [part["label"].iloc[0]], "dim": [part["dim"].iloc[0]], "uids": [part["uid"].to_numpy(np.int64).tobytes()], "weights": [part["weight"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "lo": [at.min(axis=0)], "hi": [at.max(axis=0)]})

        for batch in batches:
            for _, part in batch.groupby(["label", "dim"], sort=False):
                for at in range(0, len(part), BLOCK):
                    piece = part.iloc[at : at + BLOCK]
                    if held and (sum(map(len, held)) + len(piece) > BLOCK or (held[0]["label"].iloc[0], held[0]["dim"].iloc[0]) != (piece["label"].iloc[0], piece["dim"].iloc[0])):
                        yield block()
                        held = []
                    held.append(piece)
        if held:
            yield block()

    made = ordered.select(*own).mapInPandas(cut, f"label {kinds['label']}, dim int, uids binary, weights binary, vectors binary, lo array<double>, hi array<double>")
    made = saved(made.withColumn("seq", F.monotonically_increasing_id()), "grid-blocks")
    places = made.select("label", "dim", "seq", (F.row_number().over(Window.partitionBy("label", "dim").orderBy("seq")) - 1).alias("place"))  # a row a block
    return made.join(places.select("seq", "place"), "seq").drop("seq")


def interval_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(label, dim, i, j), i <= j: blocks whose boxes are within eps, by recursion over intervals of FAN ** level blocks."""
    boxes = saved(blocks.select("label", "dim", "place", "lo", "hi"), "grid-boxes")
    top = boxes.agg(F.max("place")).first()[0] or 0
    levels = [boxes]
    least = lambda a: F.array(*[F.min(F.col(a)[i]) for i in range(BOX + 1)])
    most = lambda a: F.array(*[F.max(F.col(a)[i]) for i in range(BOX + 1)])
    while top:
        top //= FAN
        up = levels[-1].groupBy("label", "dim", F.floor(F.col("place") / FAN).cast("int").alias("place")).agg(least("lo").alias("lo"), most("hi").alias("hi"))
        levels.append(saved(up, "grid-intervals"))
    pairs = levels[-1].select("label", "dim", F.col("place").alias("i"), F.col("place").alias("j"))
    apart = F.zip_with(F.zip_with("x.lo", "y.hi", lambda a, b: a - b), F.zip_with("y.lo", "x.hi", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b))
    gap = F.aggregate(apart, F.lit(0.0), lambda a, g: a + g * g)
    for level in reversed(levels[:-1]):
        kids = F.sequence(F.lit(0), F.lit(FAN - 1))
        pairs = pairs.select("label", "dim", "i", "j", F.explode(kids).alias("a")).select("label", "dim", "i", "j", "a", F.explode(kids).alias("b"))
        pairs = pairs.select("label", "dim", (F.col("i") * FAN + F.col("a")).alias("i"), (F.col("j") * FAN + F.col("b")).alias("j")).where("i <= j")
        x, y = level.alias("x"), level.alias("y")
        met = pairs.alias("p").join(x, (F.col("p.label") == F.col("x.label")) & (F.col("p.dim") == F.col("x.dim")) & (F.col("p.i") == F.col("x.place")))
        met = met.join(y, (F.col("p.label") == F.col("y.label")) & (F.col("p.dim") == F.col("y.dim")) & (F.col("p.j") == F.col("y.place")))
        pairs = saved(met.where(gap <= (eps + SLACK) ** 2).select("p.label", "p.dim", "p.i", "p.j"), "grid-pairs")
    return pairs


def leaf_boxes(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.arange(0, len(at), LEAF)
    return np.minimum.reduceat(at, cuts), np.maximum.reduceat(at, cuts)


def near_of(a: np.ndarray, b: np.ndarray, at: np.ndarray, to: np.ndarray, threshold: float, eps: float, tally: dict[str, int]) -> np.ndarray | None:
    """Which rows of two blocks of unit vectors are near, leaf by leaf; None if their boxes are too far apart. at, to: their coordinates."""
    gap = np.maximum(0, np.maximum(at.min(axis=0) - to.max(axis=0), to.min(axis=0) - at.max(axis=0)))
    tally["blocks"] = tally.get("blocks", 0) + 1
    if (gap * gap).sum() > (eps + SLACK) ** 2:
        tally["blocks_skipped"] = tally.get("blocks_skipped", 0) + 1
        return None
    (lo, hi), (low, high) = leaf_boxes(at), leaf_boxes(to)
    met = np.zeros((len(lo), len(low)))
    for k in range(lo.shape[1]):
        g = np.maximum(0, np.maximum(lo[:, None, k] - high[None, :, k], low[None, :, k] - hi[:, None, k]))
        met += g * g
    close = met <= (eps + SLACK) ** 2
    tally["leaves"] = tally.get("leaves", 0) + close.size
    if close.mean() > 0.5:  # one product is quicker
        return a @ b.T >= threshold
    tally["leaves_skipped"] = tally.get("leaves_skipped", 0) + int((~close).sum())
    near = np.zeros((len(a), len(b)), bool)
    for i in np.flatnonzero(close.any(axis=1)):
        rows = slice(i * LEAF, (i + 1) * LEAF)
        cols = np.flatnonzero(np.repeat(close[i], LEAF)[: len(b)])
        near[rows, cols] = a[rows] @ b[cols].T >= threshold
    return near


def linked(near: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, weights: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, links, root) of the vectors of a block pair with a link; near: left x right. same: both are one block."""
    fresh_l, fresh_r = near.any(axis=1), near.any(axis=0)
    uids, links, roots = [left[fresh_l]], [near[fresh_l] @ weights[1]], np.full(len(left), -1)
    if same:  # a vector is on both sides: the walk steps from one to the other
        near = near | np.diag(fresh_l)
    other = np.full(len(right), -1)
    for i in np.flatnonzero(fresh_l):
        if roots[i] >= 0:
            continue
        edge, roots[i] = np.array([i]), i
        while len(edge):
            met = np.flatnonzero(near[edge].any(axis=0) & (other < 0))
            other[met] = i
            edge = np.flatnonzero(near[:, met].any(axis=1) & (roots < 0)) if len(met) else met
            roots[edge] = i
    ends = [left[roots[fresh_l]]]
    if not same:
        uids.append(right[fresh_r])
        links.append(weights[0] @ near[:, fresh_r])
        ends.append(left[other[fresh_r]])
    return np.concatenate(uids), np.concatenate(links), np.concatenate(ends)


def cell_links(blocks: dict[int, tuple[np.ndarray, ...]], i: int, j: int, axes: dict[int, np.ndarray], threshold: float, tally: dict[str, int] | None = None) -> Iterator[pd.DataFrame]:
    """Links of the block pairs of a cell: blocks whose place is in interval i against those in interval j. blocks: place -> (uids, weights, vectors)."""
    eps = float(np.sqrt(2 - 2 * threshold))
    tally = {} if tally is None else tally
    unit = {p: units(x) for p, (_, _, x) in blocks.items()}
    at = {p: coordinates(x, axes) for p, x in unit.items()}
    for p in sorted(blocks):
        for r in sorted(blocks):
            if p // CELL == i and r // CELL == j and p <= r:
                near = near_of(unit[p], unit[r], at[p], at[r], threshold, eps, tally)
                if near is None:
                    continue
                if p == r:
                    np.fill_diagonal(near, False)
                if near.any():
                    uid, links, root = linked(near, blocks[p][0], blocks[r][0], p == r, (blocks[p][1], blocks[r][1]))
                    yield pd.DataFrame({"uid": uid, "links": links.astype(np.int64), "root": root})


def near_components(embeddings: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    eps = float(np.sqrt(2 - 2 * threshold))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    good = usable() & F.col("label").isNotNull() & F.exists("embedding", lambda x: x != 0)
    key = F.when(good, F.sha2(F.concat(F.col("label").cast("string"), F.lit(":"), F.col("embedding").cast("string")), 256))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "embedding", key.alias("key")), "grid-rows")
    # equal vectors of a label become one, with their number
    once = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("uid").alias("uid"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    once = saved(once.withColumn("dim", F.size("embedding")), "grid-distinct")
    axes = principal(once)
    blocks = saved(blocks_of(once, axes, eps), "grid-placed")
    pairs = interval_pairs(blocks, eps)
    inside = lambda c: F.floor(F.col(c) / CELL).cast("int")
    needed = pairs.select("label", "dim", inside("i").alias("ci"), inside("j").alias("cj"), F.explode(F.array("i", "j")).alias("place")).distinct()
    work = needed.join(blocks.select("label", "dim", "place", "uids", "weights", "vectors"), ["label", "dim", "place"])
    cell = ["label", "dim", "ci", "cj"]
    work = work.repartition(*cell).sortWithinPartitions(*cell)

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[np.ndarray, ...]] = {}
        last = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if (now := (r.label, r.dim, r.ci, r.cj)) != last:
                    if held:
                        yield from cell_links(held, last[2], last[3], axes, threshold)
                    held, last = {}, now
                held[r.place] = (np.frombuffer(r.uids, np.int64), np.frombuffer(r.weights, np.int64), np.frombuffer(r.vectors, np.float64).reshape(-1, r.dim))
        if held:
            yield from cell_links(held, last[2], last[3], axes, threshold)

    found = saved(work.select(*cell, "place", "uids", "weights", "vectors").mapInPandas(compared, "uid bigint, links bigint, root bigint"), "grid-links")
    counts = found.groupBy("uid").agg(F.sum("links").alias("n_links"))
    parts = connected_components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    linked_ = once.select("key", "uid", "weight").join(counts, "uid", "left").join(parts, F.col("uid") == F.col("node"), "left")
    linked_ = saved(linked_.select("key", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "uid").alias("part")), "grid-linked")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("uid").alias("part"))
    named = saved(rows.where("key IS NOT NULL").select("vec_id", "key").join(linked_, "key").select("vec_id", "n_links", "part").union(alone), "grid-named")
    least = saved(named.groupBy("part").agg(F.min("vec_id").alias("component_id")), "grid-least")
    return named.join(least, "part").select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
