"""Phrase collocations by set-oriented relational mining.

The occurrences of phrases of each length are a relation (block, position, group), persisted
in the shared folder and sorted by position. A block is some texts of one language; its
positions run on through their words and skip one at the end of a piece, so that positions
one apart are neighbours in one piece. A length is mined in three steps:

* the relation is merge-joined with itself at the next position: a phrase and the one that
  begins a word later make one that is a word longer, in the same piece. Groups are counted
  block by block, and leave a block as sorted lists, one for each bucket of groups;
* a bucket merges the lists of all blocks. It numbers the groups of at least ``least``
  occurrences and tells each block which of its groups they are;
* the relation is semi-joined with these before it is extended again.

Relations and lists are compressed columns of numbers: a block's positions as steps, its
groups in the width that they need. However often a phrase occurs, it is one entry a block,
so no bucket gets more than its share of groups times blocks; buckets grow in number with
the shuffle's partitions. Blocks hold about ``BLOCK`` bytes, or one text.

Scores are exact (decimals of 38 digits). Edge cases: a null text is an empty one, a null
language is ``und`` (and so one with rows that say so); repeated rows count again; an empty
table gives an empty table; ties are ordered by the phrase's bytes; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import saved
from .words import batches_of, slices

#: Bytes of text in a block, rows of lists or relations in an Arrow batch, buckets a shuffle partition, and how Parquet is told that its rows are large.
BLOCK, TOGETHER, BUCKETS = 5_000_000, 4, 1
LARGE_ROWS = {"parquet.block.size.row.check.min": "4", "parquet.page.size.row.check.min": "4", "compression": "zstd"}
#: Fixed: 1 ends a word, 2 also ends a piece.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 2
LISTS = "array<struct<bucket:bigint,start:bigint,first:binary,second:binary,n:binary>>"
RELATION = f"block bigint, lang string, at binary, of binary, words bigint, lists {LISTS}"
FREQUENT = "id bigint, first bigint, second bigint, lang string, word string, f bigint, block bigint, places binary, ids binary"


#: Marks numbers whose first bytes come before all second bytes.
PLANES = 128


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 as compressed bytes, in the width that they need; byte by byte where that is shorter, as high bytes are alike."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    plain = numbers.astype(f"<u{width}")
    out = struct.pack("<BI", width, len(numbers)) + pa.compress(plain.tobytes(), "zstd", asbytes=True)
    if width > 1:
        planes = np.ascontiguousarray(plain.view(np.uint8).reshape(-1, width).T)
        out = min(out, struct.pack("<BI", width | PLANES, len(numbers)) + pa.compress(planes.tobytes(), "zstd", asbytes=True), key=len)
    return out


def unpacked(raw: bytes) -> np.ndarray:
    kind, n = struct.unpack_from("<BI", raw)
    width = kind & ~PLANES
    held = pa.decompress(raw[5:], width * n, "zstd", asbytes=True)
    if kind & PLANES:
        held = np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(width, n).T).tobytes()
    return np.frombuffer(held, f"<u{width}").astype(np.int64)


def packed_steps(ascending: np.ndarray) -> bytes:
    """Ascending numbers as the steps between them."""
    return packed(np.diff(ascending, prepend=0))


def unpacked_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw))


def packed_words(words: list[str]) -> bytes:
    """Words, none of which has a line end."""
    raw = "\n".join(words).encode()
    return struct.pack("<I", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def unpacked_words(raw: bytes) -> list[str]:
    return pa.decompress(raw[4:], struct.unpack_from("<I", raw)[0], "zstd", asbytes=True).decode().split("\n")


def lists_of(bucket: np.ndarray, columns: list[Callable[[slice], bytes]]) -> list[dict]:
    """A list for each bucket of groups that are sorted by it. columns: what packs a slice of first, second and n."""
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    return [{"bucket": int(bucket[a]), "start": int(a), **{k: pack(slice(a, b)) for k, pack in zip(("first", "second", "n"), columns)}} for a, b in zip(cuts, cuts[1:])]


def relation_row(block: int, lang: str, at: np.ndarray, of: np.ndarray, lists: list[dict]) -> pa.RecordBatch:
    kinds = pa.struct([("bucket", pa.int64()), ("start", pa.int64()), ("first", pa.binary()), ("second", pa.binary()), ("n", pa.binary())])
    columns = [pa.array([block], pa.int64()), pa.array([lang], pa.string()), pa.array([packed_steps(at)], pa.binary()), pa.array([packed(of)], pa.binary()), pa.array([len(at)], pa.int64()), pa.array([lists], pa.list_(kinds))]
    return pa.RecordBatch.from_arrays(columns, ["block", "lang", "at", "of", "words", "lists"])


def occurrences(text: bytes) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """(distinct words, positions, word number at each position) of a block of UTF-8 texts."""
    raw = np.frombuffer(text.lower(), np.uint8)  # bytes know only A-Z as capitals
    kind = KIND[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = kind == 0
    first, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    piece = np.cumsum(kind == 2, dtype=np.int32)[first] if len(first) else first
    skipped = np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw[inside[1:-1]])).dictionary_encode()
    return words.dictionary, np.arange(len(first)) + skipped, words.indices.to_numpy(zero_copy_only=False)


def word_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """The relation of single words: a row a block, with its positions, the number of the word at each, and lists of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[str]] = {}
        size, made = 0, TaskContext.get().partitionId() << 32

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, texts in held.items():
                distinct, at, of = occurrences("\n".join(texts).encode())
                if len(at):
                    words = np.array(distinct.to_pylist(), object)
                    bucket = pd.util.hash_array(words, categorize=False) % np.uint64(buckets)
                    order = np.argsort(bucket, kind="stable")
                    number = np.empty(len(order), np.int64)
                    number[order] = np.arange(len(order))
                    of, words = number[of], words[order]
                    n = np.bincount(of, minlength=len(order))
                    yield relation_row(made, lang, at, of, lists_of(bucket[order], [lambda s: packed_words(words[s].tolist()), lambda s: b"", lambda s: packed(n[s])]))
                    made += 1

        for batch in slices(batches, BLOCK):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    held.setdefault(lang, []).append(text)
                    size += len(text)
                    if size >= BLOCK:
                        yield from out()
                        held, size = {}, 0
                        pa.default_memory_pool().release_unused()
        yield from out()

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(run, RELATION)


def bucket_of(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(buckets)


def extended(relation: DataFrame, frequent: DataFrame, buckets: int) -> DataFrame:
    """The relation of phrases a word longer. frequent: (block, places, ids) of the groups that go on."""
    kept = frequent.where("block IS NOT NULL").groupBy("block").agg(F.collect_list(F.struct("places", "ids")).alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at, of = unpacked_steps(row["at"]), unpacked(row["of"])
                places = np.concatenate([unpacked_steps(x["places"]) for x in row["kept"]])
                ids = np.concatenate([unpacked(x["ids"]) for x in row["kept"]])
                new = np.full(of.max() + 1, -1, np.int64)
                new[places] = np.arange(len(places))
                stays = new[of] >= 0  # the semi-join
                at, group = at[stays], new[of[stays]]
                meets = np.flatnonzero(at[1:] == at[:-1] + 1)  # the merge-join at the next position
                if len(meets):
                    pairs, place, n = np.unique(group[meets] * len(ids) + group[meets + 1], return_inverse=True, return_counts=True)
                    first, second = ids[pairs // len(ids)], ids[pairs % len(ids)]
                    bucket = bucket_of(first, second, buckets)
                    order = np.lexsort((second, first, bucket))
                    number = np.empty(len(order), np.int64)
                    number[order] = np.arange(len(order))
                    first, second, n = first[order], second[order], n[order]
                    yield relation_row(row["block"], row["lang"], at[meets], number[place], lists_of(bucket[order], [lambda s: packed_steps(first[s]), lambda s: packed(second[s]), lambda s: packed(n[s])]))

    return relation.select("block", "lang", "at", "of").join(kept, "block").mapInArrow(run, RELATION)


def merged(lists: list[dict], single: bool, least: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Frequent groups of a bucket, and for each block which of its groups they are."""
    bucket, n = lists[0]["bucket"], np.concatenate([unpacked(x["n"]) for x in lists])
    if single:
        held = [unpacked_words(x["first"]) for x in lists]
        size = [len(x) for x in held]
        every = pa.array([f"{x['lang']}\n{w}" for x, words in zip(lists, held) for w in words], pa.large_string()).dictionary_encode()
        code, distinct = every.indices.to_numpy(zero_copy_only=False), every.dictionary
    else:
        firsts = [unpacked_steps(x["first"]) for x in lists]
        size, first, second = [len(x) for x in firsts], np.concatenate(firsts), np.concatenate([unpacked(x["second"]) for x in lists])
        (a, i), (b, j) = np.unique(first, return_inverse=True), np.unique(second, return_inverse=True)
        distinct, code = np.unique(i * len(b) + j, return_inverse=True)
    f = np.zeros(len(distinct), np.int64)
    np.add.at(f, code, n)
    able = np.flatnonzero(f >= least)
    if not len(able):
        return
    ids = np.full(len(distinct), -1, np.int64)
    ids[able] = np.arange(len(able)) * buckets + bucket  # no other bucket has these
    if single:
        lang, word = zip(*(x.split("\n", 1) for x in distinct.take(pa.array(able)).to_pylist()))
        columns = {"id": ids[able], "lang": lang, "word": word, "f": f[able]}
    else:
        columns = {"id": ids[able], "first": a[distinct[able] // len(b)], "second": b[distinct[able] % len(b)], "f": f[able]}
    yield frequent_rows(len(able), columns)
    told = {"block": [], "places": [], "ids": []}
    for x, own in zip(lists, np.split(ids[code], np.cumsum(size)[:-1])):
        places = np.flatnonzero(own >= 0)
        if len(places):
            for k, v in (("block", x["block"]), ("places", packed_steps(x["start"] + places)), ("ids", packed(own[places]))):
                told[k].append(v)
    yield frequent_rows(len(told["block"]), told)


def frequent_rows(n: int, columns: dict) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in FREQUENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[k], kinds[t]) if k in columns else pa.nulls(n, kinds[t]) for k, t in fields], [k for k, _ in fields])


def frequent_groups(relation: DataFrame, single: bool, least: int, buckets: int) -> DataFrame:
    """Rows of ``FREQUENT``: a row (id, first, second or lang, word, f) a frequent group, and (block, places, ids) for blocks and buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from merged(held, single, least, buckets)
                    held = []
                held.append(row)
        if held:
            yield from merged(held, single, least, buckets)

    lists = relation.select("block", "lang", F.explode("lists").alias("x")).select("x.bucket", "block", "lang", "x.start", "x.first", "x.second", "x.n")
    return lists.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, FREQUENT)


def frequent_phrases(docs: DataFrame, least: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, m, f) of phrases of up to ``longest`` words that occur ``least`` times, (lang, n) with the words of each language)."""
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with batches_of(spark, 1000):
        relation = saved(word_blocks(docs, buckets), "phrase-words", **LARGE_ROWS)
    totals = relation.groupBy("lang").agg(F.sum("words").alias("n"))
    found = names = None
    for m in range(1, longest + 1):
        if m > 1:
            with batches_of(spark, TOGETHER):
                relation = saved(extended(relation, frequent, buckets), f"phrase-{m}", **LARGE_ROWS)
        with batches_of(spark, 300):
            frequent = saved(frequent_groups(relation, m == 1, least, buckets), "phrase-frequent")
        own = frequent.where("id IS NOT NULL")
        if m == 1:
            own = own.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f")
        else:
            begin, end = names.select(F.col("id").alias("first"), "lang", "phrase"), names.select(F.col("id").alias("second"), "last")
            own = own.select("id", "first", "second", "f").join(begin, "first").join(end, "second").select("id", "lang", F.concat("phrase", F.lit(" "), "last").alias("phrase"), "last", "f")
        names = saved(own, "phrase-names")
        own = names.select("lang", "phrase", F.lit(m).alias("m"), "f")
        found = own if found is None else found.unionByName(own)
    return found, totals


def part(words: str, start, length) -> F.Column:
    return F.array_join(F.slice(words, start, length), " ")


def phrases(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two words or more by the score of their weakest cut."""
    spark = docs.sparkSession
    found, totals = frequent_phrases(docs, least, longest)
    several = found.where("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))

    # phrases that a longer one holds, as often as they occur
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("m") - k + 1), lambda s: part("words", s, k))))
    inner = several.where("m > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    own = saved(several.join(inner, ["lang", "phrase"], "left").where("longer IS NULL OR 100 * longer < 100 * a").drop("longer"), "phrase-candidates")

    cuts = own.select("lang", "phrase", "m", "a", "words", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part("words", F.lit(1), F.col("k")).alias("first"), part("words", F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    cuts = cuts.join(found.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a language may hold most phrases
    salted = totals.select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    wide = {c: F.col(c).cast("decimal(20,0)") for c in "alrn"}
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")).join(salted, ["lang", "salt"])
    score = F.call_function("div", wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)"), wide["l"] * wide["r"])
    weakest = cuts.groupBy("lang", "salt", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x")).select("lang", "salt", "phrase", "a", "x.l", "x.r", "n", "x.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    near = weakest.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {order})")).where(F.col("rank") <= best).drop("rank")
    return near.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).where(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
