"""Exact top-k inner products by no-random-access aggregation.

A candidate block has a sorted list for each dimension, which is read from both ends inwards,
all lists in step. What has been read is known; an unread entry lies between the two
frontiers of its list. So every candidate has a lower and an upper bound of its score, and a
candidate whose upper bound is below the k-th best lower bound of a query is closed for that
query. Once few candidates are open, or no query has more than it may return, reading stops
and the final scores are resolved for the open ones alone. Where the bounds close little
(vectors without structure), the lists are read to their end.

Query and candidate blocks are dealt in cells of ``CELL`` by ``CELL`` blocks. A cell gets each
of its blocks once and gives k rows a query; the k best of all cells are ranked by a window
over those.

Arithmetic is exact: in double precision below 2 ** 51; where products may be larger, the
candidates that rounding cannot decide are scored in whole numbers of any length. A score
beyond a long counts as the largest (or smallest) long.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part;
vectors of other lengths than the query's score nothing; a null vec_id is a candidate (last
among ties) but no query; rows with one vec_id are candidates of their own, and a query
meets every row but itself; fewer than k candidates give all of them; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.storage import saved
from .eps_grid import usable

#: Vectors in a block; queries that read the lists together; shares of a list read from either end before bounds are looked at.
BLOCK, ROUND, DEPTHS = 2048, 256, (0.0625, 0.25, 0.375, 0.4375)
#: Blocks to a side of a cell.
CELL = 4
#: Share of open pairs from which on they are resolved singly; products up to here are exact in double precision.
FEW, EXACT = 0.1, 2.0**51
NONE = np.iinfo(np.int64).max


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks (dim, block, uids, ids, vectors) of rows (uid, vec_id, dim, x): each task packs its own rows; block numbers them by dim."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}

        def block(dim: int) -> pd.DataFrame:
            part = pd.concat(held.pop(dim))
            whole = np.array([NONE if pd.isna(i) else int(i) for i in part["vec_id"]], np.int64)
            return pd.DataFrame({"dim": [dim], "uids": [part["uid"].to_numpy(np.int64).tobytes()], "ids": [whole.tobytes()], "vectors": [np.array([np.asarray(v, np.float64) for v in part["x"]]).tobytes()]})

        for batch in batches:
            for dim, part in batch.groupby("dim"):
                for at in range(0, len(part), size):
                    piece = part.iloc[at : at + size]
                    if dim in held and sum(map(len, held[dim])) + len(piece) > size:
                        yield block(dim)
                    held.setdefault(dim, []).append(piece)
        for dim in list(held):
            yield block(dim)

    made = saved(rows.mapInPandas(pack, "dim int, uids binary, ids binary, vectors binary").withColumn("seq", F.monotonically_increasing_id()), "topk-blocks")
    places = made.select("seq", F.row_number().over(Window.partitionBy("dim").orderBy("seq")).alias("block"))
    return made.join(places, "seq").drop("seq")


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row, as a column."""
    return -np.partition(-values, k - 1, axis=1)[:, k - 1 : k]


def open_pairs(q: np.ndarray, x: np.ndarray, line: np.ndarray, rank: np.ndarray, open_: np.ndarray, k: int, tally: dict[str, int]) -> None:
    """Reads the lists inwards and takes out of ``open_`` (queries x candidates) what the bounds close."""
    n, dims = x.shape
    live, done = np.arange(len(q)), 0
    for depth in DEPTHS:
        t = int(n * depth)
        if t <= done or not len(live):
            continue
        top, bottom = line[n - t], line[t - 1]  # the frontiers: what is not read lies between
        unread = (rank >= t) & (rank < n - t)
        middle, reach = np.where(unread, (top + bottom) / 2, x), np.where(unread, (top - bottom) / 2, 0)
        cols = np.flatnonzero(open_[live].any(axis=0))
        about, off = q[live] @ middle[cols].T, np.abs(q[live]) @ reach[cols].T
        tally["read"] = tally.get("read", 0) + 2 * (t - done) * dims * len(live)
        done = t
        mine = open_[np.ix_(live, cols)]
        lower = np.where(mine, about - off, -np.inf)
        mine &= about + off >= (kth(lower, k) if len(cols) >= k else -np.inf)
        open_[np.ix_(live, cols)] = mine
        live = live[mine.sum(axis=1) > max(k, FEW / 4 * n)]  # the others stop here
    tally["pairs"] = tally.get("pairs", 0) + open_.size


def resolved(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Exact scores of single pairs, as longs."""
    out = np.zeros(len(row), np.int64)
    for at in range(0, len(row), 1 << 16):
        part = slice(at, at + (1 << 16))
        out[part] = np.einsum("ij,ij->i", q[row[part]], x[col[part]]).astype(np.int64)
    return out


def wide_scores(q: np.ndarray, x: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, score) of what may be among the k best where products leave the doubles' whole numbers."""
    big = max(np.abs(q).max(), np.abs(x).max())
    unit = 2.0 ** np.ceil(np.log2(big))
    about = (q / unit) @ (x / unit).T
    off = (np.abs(q / unit) @ np.abs(x / unit).T) * (x.shape[1] + 2) * 2.0**-52
    ends = 2.0**63 / unit / unit  # beyond a long all scores are alike
    lower = np.where(barred, -np.inf, np.clip(about - off, -ends, ends))
    row, col = np.nonzero(~barred & (np.clip(about + off, -ends, ends) >= kth(lower, k)))
    whole_q, whole_x = {i: [int(v) for v in q[i]] for i in np.unique(row)}, {j: [int(v) for v in x[j]] for j in np.unique(col)}
    scores = [sum(a * b for a, b in zip(whole_q[i], whole_x[j])) for i, j in zip(row, col)]
    return row, col, np.array([min(max(v, -(2**63)), 2**63 - 1) for v in scores], np.int64)


def best_of_block(q: np.ndarray, own: np.ndarray, x: np.ndarray, uids: np.ndarray, ids: np.ndarray, k: int, tally: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in a candidate block, ties to the smaller id.

    tally: gets the entries read (``read`` by the lists, ``resolved`` besides) and the pairs.
    """
    n, dims = x.shape
    tally = {} if tally is None else tally
    order = np.argsort(x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None].repeat(dims, axis=1), axis=0)
    line = np.take_along_axis(x, order, axis=0)
    k, found = min(k, n), []
    for at in range(0, len(q), ROUND):
        part, barred = q[at : at + ROUND], own[at : at + ROUND, None] == uids[None, :]
        with np.errstate(over="ignore"):
            wide = not (np.abs(part).max(axis=1, initial=0) * np.abs(x).max(initial=0) * dims < EXACT).all()
        if wide:
            row, col, score = wide_scores(part, x, barred, k)
        else:
            open_ = ~barred
            open_pairs(part, x, line, rank, open_, k, tally)
            if open_.mean() > FEW:  # the lists are read to their end
                rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
                every = np.where(open_[np.ix_(rows, cols)], part[rows] @ x[cols].T, -np.inf)
                hit = (every >= kth(every, min(k, len(cols)))) & (every > -np.inf)
                r, c = np.nonzero(hit)
                row, col, score = rows[r], cols[c], every[r, c].astype(np.int64)
                tally["resolved"] = tally.get("resolved", 0) + len(rows) * len(cols) * dims
            else:
                row, col = np.nonzero(open_)
                score = resolved(part, x, row, col)
                tally["resolved"] = tally.get("resolved", 0) + len(row) * dims
        by = np.lexsort((ids[col], ~score, row))  # ~ turns the order of longs round without overflow
        row, col, score = row[by], col[by], score[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[keep] + at, col[keep], score[keep]))
    return tuple(np.concatenate(m) for m in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): queries are the rows whose id is divisible by ``every``, against all other rows."""
    scaled = lambda x: x.cast("double") * scale
    whole = F.transform(F.col("v"), lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).where(usable("v"))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.size("v").alias("dim"), whole.alias("x")), "topk-rows")
    blocks = packed(rows, BLOCK)
    asked = saved(packed(rows.where(F.pmod("vec_id", F.lit(every)) == 0), BLOCK), "topk-queries")
    group = F.floor((F.col("block") - 1) / CELL).cast("int")
    groups = lambda df: df.groupBy("dim").agg(F.max(group).alias("last"))
    cell = ["dim", "c", "q"]

    def sent(own: DataFrame, to: DataFrame, mine: str, other: str, kind: int) -> DataFrame:
        """Each block once to every group of the other side's blocks of its length."""
        spread = own.join(groups(to), "dim").withColumn(mine, group).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("last"))))
        return spread.select(*cell, F.lit(kind).alias("kind"), "block", "uids", "ids", "vectors")

    work = sent(asked, blocks, "q", "c", 0).union(sent(blocks, asked, "c", "q", 1))
    work = work.repartition(*cell).sortWithinPartitions(*cell, "kind", "block")

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries: list[tuple[np.ndarray, ...]] = []
        found: list[pd.DataFrame] = []
        last = None

        def best() -> pd.DataFrame:
            every = pd.concat(found).sort_values(["query", "score", "vec_id"], ascending=[True, False, True], na_position="last")
            return every[every.groupby("query").cumcount() < k]

        for batch in batches:
            for r in batch.itertuples(index=False):
                if (now := (r.dim, r.c, r.q)) != last:
                    if found:
                        yield best()
                    queries, found, last = [], [], now
                own = (np.frombuffer(r.uids, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.vectors, np.float64).reshape(-1, r.dim))
                if r.kind == 0:  # queries come before candidates
                    queries.append(own)
                    continue
                uids, ids, x = own
                for asking, names, q in queries:
                    row, col, score = best_of_block(q, asking, x, uids, ids, k)
                    named = pd.Series(ids[col]).astype("Int64").mask(ids[col] == NONE)
                    found.append(pd.DataFrame({"query": asking[row], "query_id": names[row], "vec_id": named, "score": score.astype(np.int64)}))
        if found:
            yield best()

    found = work.select(*cell, "kind", "uids", "ids", "vectors").mapInPandas(searched, "query bigint, query_id bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
