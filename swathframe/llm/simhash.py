"""SimHash near-duplicates by bit-sliced comparison.

A text is lower-cased (A-Z), cut into words at ASCII white space and into word shingles;
a fingerprint bit is set if it is set in over half of the shingles' hashes. Distinct
fingerprints are compared in blocks: bit planes lie vertically, 64 candidates to a machine
word, and carry-save counters update all distances of a block plane by plane. The counters
start so that passing the radius carries out of the top. A block is one fingerprint against
64 later ones; it is abandoned once every lane has passed the radius, and the counters then
go on over the blocks that are left.

Which fingerprints meet is decided by Spark: for small radii the pigeonhole keys of
``band_keys`` (no pair within the radius is missed), for similarity thresholds the smallest
shingle hashes of ``sketch_keys``. A key's rows are dealt out in bounded chunks, every pair
of chunks meets in a cell of its own, and a cell only returns a spanning forest of its
links, so that a group of m copies gives m - 1 rows and not m * m.

Edge cases: a null text is an empty text; a text without words has fingerprint zero and is
linked like any other; one with fewer words than a shingle is hashed as a whole; repeated
rows share a fingerprint and hence a component; a null doc_id is kept, but names no
component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.storage import saved
from .words import free_names

SEED = 42
#: Rows of one key that meet in a cell, and fingerprints compared in one go.
CHUNK, BLOCK, STRIP = 1024, 4096, 256
#: Bytes of shingle sets that are compared in one go, and hashes of them that are sorted at once.
SET_BYTES, SORTED = 1 << 26, 1 << 20


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= width:
        return np.array([h(join(words), SEED)], np.uint64)
    if width == 3:
        grams = map(join, zip(words, words[1:], words[2:]))
    else:
        grams = map(join, zip(*(words[i:] for i in range(width))))
    return np.fromiter((h(g, SEED) for g in grams), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray, lanes: int) -> bytes:
    """The fingerprint, most significant bit first: 64 bits a lane; lanes after the first remix the hash."""
    n, sums = len(hashes), np.zeros(64 * lanes, np.int64)
    for at in range(0, n, 16320):
        part = hashes[at : at + 16320]
        wide = np.empty((len(part), lanes), np.uint64)
        for k in range(lanes):
            x = part
            if k:
                x = part + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                x = x ^ (x >> np.uint64(31))
            wide[:, k] = x
        bits = np.unpackbits(wide.astype(">u8").view(np.uint8).reshape(len(part), -1), axis=1)
        full = len(bits) // 255 * 255  # sums of 255 bits fit a byte, which keeps the inner loop narrow
        if full:
            sums += bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        sums += bits[full:].sum(axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n).tobytes()


def fingerprint(text: Column, width: int = 3, lanes: int = 1, distinct: bool = False) -> Column:
    """Fingerprint as lowercase hex, 16 digits a lane. distinct: each shingle counts once."""

    @F.pandas_udf("string")
    def hexed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = (shingle_hashes(t, width) for t in batch)
            yield pd.Series([majority_bits(np.unique(x) if distinct else x, lanes).hex() for x in found], dtype=object)

    return hexed(text)


def sketched(text: Column, width: int, lanes: int, keys: int) -> Column:
    """struct(fp, sketch, n): fingerprint over distinct shingles, their ``keys`` smallest hashes and their number."""

    @F.pandas_udf("fp string, sketch array<bigint>, n bigint")
    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [np.unique(shingle_hashes(t, width)) for t in batch]
            yield pd.DataFrame({"fp": [majority_bits(x, lanes).hex() for x in found], "sketch": [x[:keys].view(np.int64) for x in found], "n": [len(x) for x in found]})

    return both(text)


def band_keys(fps: DataFrame, radius: int, hot: int = 32_768) -> DataFrame:
    """(key, fp) for 64-bit fingerprints: two within ``radius`` agree on one of radius + 1 bands.

    The rows of a band value held by over ``hot`` fingerprints are keyed again, by as many
    bands of the remaining bits: those too must agree on one of them.
    """
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    # 16 hex digits to a bigint: two halves, as conv() to decimal overflows a signed long
    value = F.shiftleft(F.conv(F.substring("fp", 1, 8), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(F.substring("fp", 9, 8), 16, 10).cast("bigint"))
    mask = lambda lo, hi: (((1 << (hi - lo)) - 1) << lo) - (1 << 64 if hi == 64 else 0)
    bits = lambda lo, hi: F.col("v").bitwiseAND(F.lit(mask(lo, hi)).cast("bigint"))
    banded = fps.select("fp", value.alias("v")).select("fp", "v", F.posexplode(F.array(*[bits(a, b) for a, b in zip(cuts, cuts[1:])])).alias("band", "part"))
    banded = saved(banded.select("fp", "v", "band", F.xxhash64("band", "part").alias("key")), "simhash-bands")
    large = saved(banded.groupBy("key").count().where(F.col("count") > hot).select("key"), "simhash-hot")
    plain = banded.join(large, "key", "left_anti").select("key", "fp")
    again = banded.join(large, "key", "left_semi")
    for i in range(n):  # the rest of the bits, as one string, cut into n bands
        rest = [x for x in range(64) if not cuts[i] <= x < cuts[i + 1]]
        parts = []
        for j in range(n):
            own = rest[len(rest) * j // n : len(rest) * (j + 1) // n]
            held = sum(1 << x for x in own)
            parts.append(F.xxhash64("key", F.lit(j), F.col("v").bitwiseAND(F.lit(held - (1 << 64) if held >= 1 << 63 else held).cast("bigint"))))
        plain = plain.union(again.where(F.col("band") == i).select(F.explode(F.array(*parts)).alias("key"), "fp"))
    return plain


def sketch_keys(fps: DataFrame) -> DataFrame:
    """(key, fp, n): a row for each of a fingerprint's smallest shingle hashes, which are distinct.

    Two sets with Jaccard similarity J share none of their k smallest with a chance near
    (1 - J) ** k: under 3 in a million for 0.8 and k = 8.
    """
    return fps.select(F.explode("sketch").alias("key"), "fp", "n")


def near_rows(fps: np.ndarray, radius: int, tally: dict[str, int] | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Packed links of some fingerprints: bit j of row i is set if i and j are not the same and differ in ``radius`` bits at most.

    fps: (m, bytes) of uint8, any m. Each row meets the lanes after it, with ``ends`` only
    those before its end; planes on which all rows agree add nothing and are left out.
    tally: gets the blocks begun, those abandoned, and the planes read of them.
    """
    m, width = len(fps), fps.shape[1] * 8
    ends = np.full(m, m) if ends is None else ends
    words = -(-m // 64)
    own = np.unpackbits(fps, axis=1)  # (m, width)
    lanes = np.zeros((words * 64, width), np.uint8)
    lanes[:m] = own
    planes = np.packbits(np.ascontiguousarray(lanes.T), axis=1, bitorder="little").view(np.uint64)  # (width, words)
    used = np.flatnonzero((own != own[:1]).any(axis=0)) if m else np.zeros(0, np.int64)
    depth, ones, out = int(radius).bit_length(), np.uint64(2**64 - 1), np.zeros((m, words), np.uint64)
    start = (1 << depth) - 1 - radius
    tally = tally if tally is not None else {}
    for at in range(0, m, STRIP):
        rows, first = own[at : at + STRIP].astype(bool), at // 64
        lane = np.arange(first * 64, words * 64)
        barred = (lane[None, :] <= np.arange(at, at + len(rows))[:, None]) | (lane[None, :] >= ends[at : at + STRIP, None])
        over = np.packbits(barred, axis=1, bitorder="little").view(np.uint64)
        row, word = np.nonzero(over != ones)  # the blocks that are still counted
        over = over[row, word]
        begun = len(row)
        tally["blocks"] = tally.get("blocks", 0) + begun
        count = [np.full(begun, ones if start >> i & 1 else 0, np.uint64) for i in range(depth)]
        for seen, p in enumerate(used):
            carry = planes[p][first + word] ^ np.where(rows[:, p], ones, np.uint64(0))[row]
            for c in count:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
            tally["planes"] = tally.get("planes", 0) + len(row)
            if seen >= radius and seen % 4 == 3:
                open_ = over != ones
                if not open_.all():
                    row, word, over, count = row[open_], word[open_], over[open_], [c[open_] for c in count]
                    if not len(row):
                        break
        tally["abandoned"] = tally.get("abandoned", 0) + begun - len(row)
        out[at + row, first + word] = ~over
    for at in range(0, m, STRIP):  # mirrored strip by strip, as near copies have links by the square of their number
        bits = np.unpackbits(out[at : at + STRIP].view(np.uint8), axis=1, bitorder="little")[:, :m].T
        back = np.zeros((m, -(-bits.shape[1] // 64) * 64), np.uint8)
        back[:, : bits.shape[1]] = bits
        back = np.packbits(back, axis=1, bitorder="little").view(np.uint64)
        out[:, at // 64 : at // 64 + back.shape[1]] |= back
    return out


def size_ends(sizes: np.ndarray, least: float) -> np.ndarray:
    """Of ascending set sizes, the place after the last that a set can have a similarity of ``least`` with: no smaller part than that of the larger one."""
    return np.searchsorted(sizes, np.floor(sizes / least + 1e-9), side="right")


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(root, member) for each member of each component of the packed links."""
    m = len(near)
    fresh = np.ones(m, bool)
    found = []
    linked = np.flatnonzero(near.any(axis=1))
    for root in linked:
        if not fresh[root]:
            continue
        fresh[root], edge = False, np.array([root])
        while len(edge):
            met = np.unpackbits(np.bitwise_or.reduce(near[edge], axis=0).view(np.uint8), bitorder="little")[:m].astype(bool) & fresh
            edge = np.flatnonzero(met)
            fresh[edge] = False
            found += [(int(root), int(x)) for x in edge]
    return found


def compare(batches: Iterator[pa.RecordBatch], radius: int, least: float = 0.0) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the rows (cell, fp, n), which come sorted by cell; a cell may span batches. With ``least``, sets of n that are too unlike in size do not meet."""

    def links(fps: list[tuple[int, str]]) -> pa.RecordBatch:
        rows = sorted(set(fps))
        names = [fp for _, fp in rows]
        raw = np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), -1)
        pairs = forest(near_rows(raw, radius, ends=size_ends(np.array([n for n, _ in rows]), least) if least else None))
        return pa.RecordBatch.from_pydict({"a": pa.array([names[i] for i, _ in pairs], pa.string()), "b": pa.array([names[j] for _, j in pairs], pa.string())})

    whole: list[tuple[int, str]] = []  # of ended cells; a block takes several, as links across cells are links too
    cell: list[tuple[int, str]] = []
    last = None
    for batch in batches:
        for key, fp, n in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                if len(whole) + len(cell) > BLOCK and whole:
                    yield links(whole)
                    whole = []
                whole, cell, last = whole + cell if cell else whole, [], key
            cell.append((n, fp))
    if len(whole) + len(cell) > BLOCK and whole and cell:
        yield links(whole)
        whole = []
    if whole or cell:
        yield links(whole + cell)


def near_links(keyed: DataFrame, radius: int, chunk: int = CHUNK, least: float = 0.0) -> DataFrame:
    """Links (a, b) that span the components of fingerprints meeting under a key of ``keyed`` (key, fp), distinct rows, within ``radius`` bits; with ``least``, also of sets whose sizes n allow such a similarity."""
    keyed = saved(keyed, "simhash-keys")
    sizes = saved(keyed.groupBy("key").count().where("count > 1"), "simhash-sizes")
    parts = F.ceil(F.col("count") / chunk).cast("int")
    met = keyed.join(sizes, "key").select("key", "fp", F.col("n") if least else F.lit(0).alias("n"), parts.alias("k"), F.pmod(F.xxhash64("fp", "key"), parts).cast("int").alias("c"))
    cells = met.select("key", "fp", "n", "c", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("o"))
    cells = cells.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("cell"), "fp", "n")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(lambda b: compare(b, radius, least), "a string, b string").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row a document, linked at ``radius`` or fewer differing bits."""
    own = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), width).alias("fingerprint")), "simhash-docs")
    fps = saved(own.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    return own.join(fp_components(fps, near_links(band_keys(fps.select("fp"), radius).distinct(), radius)), own.fingerprint == F.col("fp")).select("doc_id", "fingerprint", "component_id")


def fp_components(fps: DataFrame, links: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest document id of each fingerprint's component. fps: (fp, least)."""
    roots = connected_components(links)
    rooted = saved(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "simhash-rooted")
    least = saved(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    return rooted.join(least, "root").select("fp", "component_id")


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Similarity of every two of some sorted sets of hashes, by ranges of hashes; hashes that one set alone has only count in its size."""
    n, size, both = len(sets), np.array([len(x) for x in sets], np.float64), np.zeros((len(sets), len(sets)))
    parts = max(1, -(-int(size.sum()) // SORTED))
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    cuts = np.array([[0, *np.searchsorted(x, edges), len(x)] for x in sets])
    for k in range(parts):
        owner = np.repeat(np.arange(n), cuts[:, k + 1] - cuts[:, k])
        _, column, count = np.unique(np.concatenate([x[a:b] for x, a, b in zip(sets, cuts[:, k], cuts[:, k + 1])]), return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        held = count[column] > 1
        owner, column = owner[held], shared[column[held]]
        for at in range(0, int(shared[-1]) + 1 if len(shared) else 0, BLOCK):
            own = (column >= at) & (column < at + BLOCK)
            part = np.zeros((n, BLOCK), np.float32)
            part[owner[own], column[own] - at] = 1
            both += part @ part.T
    union = size[:, None] + size[None, :] - both
    return np.divide(both, union, out=np.ones((n, n)), where=union > 0)


def verify(batches: Iterator[pa.RecordBatch], radius: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows (cell, fp, shingles), sorted by cell, whose sets have a similarity of ``least`` or more.

    Fingerprints within the radius and of like size make groups by bit-sliced comparison; sets are compared inside those.
    """

    def links(rows: dict[str, bytes]) -> pa.RecordBatch:
        names = sorted(rows, key=lambda fp: (len(rows[fp]), fp))
        raw = np.frombuffer(bytes.fromhex("".join(names)), np.uint8).reshape(len(names), -1)
        ends = size_ends(np.array([len(rows[fp]) // 8 for fp in names]), least)
        groups: dict[int, list[int]] = {}
        for root, member in forest(near_rows(raw, radius, ends=ends)):
            groups.setdefault(root, [root]).append(member)
        pairs = []
        for own in groups.values():
            alike = jaccard([np.frombuffer(rows[names[i]], np.uint64) for i in own]) >= least
            n = len(own)
            bits = np.zeros((n, -(-n // 64) * 64), np.uint8)
            bits[:, :n] = alike
            pairs += [(names[own[i]], names[own[j]]) for i, j in forest(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))]
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs], pa.string()), "b": pa.array([b for _, b in pairs], pa.string())})

    rows: dict[str, bytes] = {}  # several small cells together: links across cells are links too
    cell: dict[str, bytes] = {}
    held = own = 0  # bytes of both
    last = None
    for batch in batches:
        for key, fp, shingles in zip(*(c.to_pylist() for c in batch.columns)):
            if key != last:
                if rows and (len(rows) + len(cell) > CHUNK or held + own > SET_BYTES):
                    yield links(rows)
                    rows, held = {}, 0
                rows, held, cell, own, last = rows | cell, held + own, {}, 0, key
            cell[fp] = shingles
            own += len(shingles)
    if rows and cell and (len(rows) + len(cell) > CHUNK or held + own > SET_BYTES):
        yield links(rows)
        rows = {}
    if rows or cell:
        yield links(rows | cell)


def shingle_set(text: Column, width: int) -> Column:
    """The distinct shingle hashes of a text, sorted, as 64-bit words."""

    @F.pandas_udf("binary")
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([np.unique(shingle_hashes(t, width)).tobytes() for t in batch], dtype=object)

    return packed(text)


def row_key(df: DataFrame) -> Column:
    """SHA-256 over all columns. Each value stands with its length, and a null as a mark of its own, so only equal rows share a key."""
    parts = []
    for field in df.schema:
        own = F.col(f"`{field.name}`")
        text = F.to_json(F.struct(own)) if field.dataType.typeName() in ("array", "struct", "map", "variant") else own.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), F.when(own.isNotNull(), text)), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def dealt(n: Column, size: Column) -> Column:
    """In how many chunks so many members with so many bytes of shingles are dealt."""
    return F.greatest(F.ceil(n / (CHUNK // 2)), F.ceil(size / (SET_BYTES // 2))).cast("int")


def group_sizes(members: DataFrame) -> DataFrame:
    """(group, k, leader) of (group, fp, n): in how many chunks a group is dealt, by its members and by their shingles, and its first fingerprint."""
    return members.groupBy("group").agg(dealt(F.count("*"), F.sum(8 * F.col("n"))).alias("k"), F.min("fp").alias("leader"))


def alike_links(sets: DataFrame, members: DataFrame, sizes: DataFrame, radius: int, least: float) -> DataFrame:
    """Links (a, b) that span the components of similar sets inside each group. sets: (group, k, leader, fp, shingles), members: (group, fp, sketch, n), sizes: (group, k, leader).

    A group is dealt in chunks, and its first member is in each of them. Where all members
    turn out to hang together with that one, which is so in a group of copies, the work and
    the bytes moved are linear in the group. Of other groups, members go that can be like no
    other (``alone``). Those left outside the first one's part meet all others that are left,
    in cells of the whole group or, where that moves fewer rows, under the hashes of their
    sketches, as near copies share one; only hashes at which parts meet that do not hang
    together yet are looked at.
    """
    at = lambda parts: F.pmod(F.xxhash64("fp"), parts).cast("int")
    every = lambda parts: F.sequence(F.lit(0), parts - 1)

    def met(cells: DataFrame) -> DataFrame:
        own = cells.repartition("cell").sortWithinPartitions("cell")
        return saved(own.mapInArrow(lambda b: verify(b, radius, least), "a string, b string"), "simhash-alike")

    chunks = F.when(F.col("fp") == F.col("leader"), every(F.col("k"))).otherwise(F.array(at(F.col("k"))))
    links = met(sets.select("group", "fp", "shingles", F.explode(chunks).alias("j")).select(F.xxhash64("group", "j").alias("cell"), "fp", "shingles"))
    large = sizes.where("k > 1").select("group", "leader")
    if large.isEmpty():
        return links
    parts = connected_components(links)
    own = members.join(large, "group").join(parts, F.col("fp") == F.col("node"), "left").select("group", "fp", "leader", "sketch", "n", F.coalesce("component", "fp").alias("part"))
    own = saved(own.join(alone(sets.where("k > 1"), least), "fp", "left_anti"), "simhash-large")
    first = large.join(parts, F.col("leader") == F.col("node"), "left").select("group", F.coalesce("component", "leader").alias("main"))
    own = own.join(first, "group").withColumn("rest", F.col("part") != F.col("main"))
    keyed = saved(own.select("group", "fp", "n", "part", "rest", F.explode("sketch").alias("key")), "simhash-parts")
    outer = lambda c: F.when(F.col("rest"), c)
    shares = [dealt(F.count(outer(F.lit(1))), F.sum(outer(8 * F.col("n")))).alias("r"), dealt(F.count("*"), F.sum(8 * F.col("n"))).alias("k")]
    rows = (F.count("*") * shares[0] + F.count(outer(F.lit(1))) * shares[1]).alias("rows")
    apart = saved(keyed.groupBy("group", "key").agg(*shares, rows, F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").drop("a", "b"), "simhash-apart")
    if apart.isEmpty():
        return links
    by_key = apart.groupBy("group").agg(F.sum("rows").alias("by_key"))
    whole = saved(own.groupBy("group").agg(*shares, rows).join(by_key, "group").where("rows < by_key").select("group", "r", "k"), "simhash-whole")
    again = keyed.join(apart.join(whole, "group", "left_anti"), ["group", "key"]).select("group", "key", "fp", "rest", "r", "k")
    again = again.union(own.join(whole, "group").select("group", F.lit(None).cast("bigint"), "fp", "rest", "r", "k"))
    everyone = again.select("group", "key", "fp", F.explode(every(F.col("r"))).alias("i"), at(F.col("k")).alias("j"))
    outside = again.where("rest").select("group", "key", "fp", at(F.col("r")).alias("i"), F.explode(every(F.col("k"))).alias("j"))
    cells = everyone.union(outside).select("fp", F.xxhash64("group", "key", "i", "j").alias("cell")).distinct()
    return links.union(met(sets.select("fp", "shingles").join(cells, "fp").select("cell", "fp", "shingles")))


def alone(sets: DataFrame, least: float) -> DataFrame:
    """(fp) of sets (group, fp, shingles) that no other of their group can be like: so many of their hashes occur in no other that the rest is too small a part."""

    @F.pandas_udf("array<bigint>")
    def unpacked(packed: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(x, np.int64) for x in packed], dtype=object)

    held = sets.select("group", "fp", (F.length("shingles") / 8).alias("n"), F.explode(unpacked("shingles")).alias("hash"))
    own = held.groupBy("group", "hash").agg(F.count("*").alias("sets"), F.min("fp").alias("fp"), F.min("n").alias("n")).where("sets = 1")
    return own.groupBy("fp").agg(F.count("*").alias("own"), F.min("n").alias("n")).where((F.col("n") - F.col("own")) / F.col("n") < least - 1e-9).select("fp")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = 88, lanes: int = 4, keys: int = 8) -> DataFrame:
    """``docs`` with one row of each group of near copies, all columns kept.

    Near copies have distinct-shingle sets of ``width`` words with a Jaccard similarity of
    ``least`` or more. They meet under one of their ``keys`` smallest shingle hashes and make
    coarse groups by fingerprint; an exact comparison of the sets decides inside those. Two
    sets of similarity 0.8 share none of their smallest hashes with a chance under 3 in a
    million (none if they have at most ``keys`` shingles), and differ in most bits when they
    have 4 and 5 shingles: 48 of 256 on average, in more than 88 with a chance of one in 10^9.
    The document with the smallest id (nulls last) and then the smallest row key stays; of
    identical rows, one stays; texts without words are copies of each other.
    """
    (row,) = free_names(docs.columns, "row")
    held = docs.withColumn(row, row_key(docs))
    marks = held.select("doc_id", F.col(row).alias("row"), sketched(F.col("text"), width, lanes, keys).alias("s"))
    marks = saved(marks.select("doc_id", "row", "s.fp", "s.sketch", "s.n"), "simhash-docs")
    first = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")
    fps = saved(marks.groupBy("fp").agg(F.min(first).alias("best"), F.min("sketch").alias("sketch"), F.min("n").alias("n")), "simhash-distinct")
    coarse = connected_components(near_links(sketch_keys(fps), radius, least=least))
    near = saved(fps.join(coarse, fps.fp == coarse.node).select("fp", F.col("best.row").alias("row"), F.col("component").alias("group"), "sketch", "n"), "simhash-near")
    sizes = saved(group_sizes(near), "simhash-sizes")
    once = held.select(F.col(row).alias("row"), "text").join(near.drop("sketch").join(sizes, "group"), "row").dropDuplicates(["row"])
    sets = saved(once.select("group", "k", "leader", "fp", shingle_set(F.col("text"), width).alias("shingles")), "simhash-sets")
    roots = connected_components(alike_links(sets, near, sizes, radius, least))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("best", F.coalesce("component", "fp").alias("root"))
    chosen = saved(rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row)).distinct(), "simhash-chosen")
    # copies of a whole row are combined on the map side before they meet
    kept = held.dropDuplicates([row]).join(chosen, row, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
