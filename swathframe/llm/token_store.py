"""Token ids on disk: canonical length-limited Huffman code from global counts.

A store is a folder of two Parquet tables. ``code``: one row, the code length of each id
(the canonical code follows from the lengths alone). ``blocks``: rows of whole documents in
ascending id order, each with its documents, their token counts, the coded bits and
checkpoints: the bit offset of every ``STEP``-th symbol. A checkpoint starts an independent
run, so a reader can begin at any of them; the decoder follows all runs of a block side by
side with one table look-up per symbol and run.

Documents with ids that tie (repeated rows, nulls, which come first) are ordered by a hash
of the text, so reruns agree. A null text is an empty text: its only id is the end id.
An empty table gives an empty store. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import saved
from .words import LETTERS, PLAIN, WordTable, slices

#: Longest code in bits; symbols between checkpoints; symbols in a block (a longer document has a block of its own).
LIMIT, STEP, BLOCK = 16, 512, 1 << 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Length of each symbol's code (0: unused), optimal among codes of at most ``limit`` bits: package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols have no code of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight, n = counts[used].astype(np.float64), len(used)
    # a level's list: singles and packages of two of the level below, by weight; picks goes back down
    levels, packs = [], np.zeros(0)
    for _ in range(limit):
        every = np.concatenate([weight, packs])
        order = np.argsort(every, kind="stable")
        levels.append(order < n)
        ordered = every[order]
        packs = ordered[: len(ordered) // 2 * 2].reshape(-1, 2).sum(axis=1)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for single in reversed(levels):
        singles = int(single[:take].sum())
        length[:singles] += 1
        take = 2 * (take - singles)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each id, table of ids, table of lengths): the tables are indexed by the next LIMIT bits."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    span = np.int64(1) << (LIMIT - lengths[used].astype(np.int64))
    first = np.cumsum(span) - span
    codes = np.zeros(len(lengths), np.int64)
    codes[used] = first >> (LIMIT - lengths[used].astype(np.int64))
    ids, steps = np.zeros(1 << LIMIT, np.uint32), np.ones(1 << LIMIT, np.uint8)
    end = int(span.sum())
    ids[:end], steps[:end] = np.repeat(used, span), np.repeat(lengths[used], span)
    return codes, ids, steps


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bits, bit offset of every STEP-th symbol). Each code is split over two 32-bit words at most."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    start = ends - size
    words = np.zeros((int(ends[-1]) >> 5) + 3 if len(ids) else 2, np.uint64)
    spot = start >> 5
    shifted = codes[ids].astype(np.uint64) << (64 - (start & 31) - size).astype(np.uint64)
    # codes share no bit, so sums are unions
    heads = np.flatnonzero(np.diff(spot, prepend=-1))
    if len(ids):
        high = np.add.reduceat(shifted >> np.uint64(32), heads)
        low = np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), heads)
        words[spot[heads]] += high
        words[spot[heads] + 1] += low
    return words.astype(">u4").tobytes(), start[::STEP]


def unpack(bits: bytes, marks: np.ndarray, n: int, table: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The n ids: all runs advance together, a symbol at a time."""
    raw = np.frombuffer(bits, ">u4").astype(np.uint64)
    wide = (raw[:-1] << np.uint64(32)) | raw[1:]
    at, out = marks.astype(np.int64).copy(), np.zeros((STEP, len(marks)), np.uint32)
    last = len(wide) - 1
    for i in range(min(STEP, n)):
        word = np.minimum(at >> 5, last)  # a run that has ended reads on in the padding
        peek = (wide[word] >> (64 - LIMIT - (at & 31)).astype(np.uint64)) & np.uint64((1 << LIMIT) - 1)
        peek = peek.astype(np.int64)
        out[i] = table[peek]
        at += steps[peek]
    return out.T.reshape(-1)[:n]


class LibraryWords:
    """Ids of whole texts by the tokenizers library, which meets each word of a plain text once."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.odd = re.compile(f"[^{PLAIN}]|<\\|")
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+").findall
        self.words = WordTable(self.encode_words, np.uint32)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words in a call, as the library takes each apart from the others; the last id of a word ends in </w>."""
        flat, size = [], []
        for i in range(0, len(words), 2000):
            part = words[i : i + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(part) or len(ids) != ends[-1] + 1:
                found = [x.ids for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids, ends = np.array([y for x in found for y in x], np.uint32), np.cumsum([len(x) for x in found]) - 1
            flat.append(ids)
            size.append(np.diff(ends, prepend=-1))
        return np.concatenate(flat), np.concatenate(size)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        plain = [not self.odd.search(t) for t in texts]
        quick = iter(self.words.texts(self.cut(t.lower()) for t, ok in zip(texts, plain) if ok))
        return [next(quick) if ok else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for t, ok in zip(texts, plain)]


_libraries: dict[str, LibraryWords] = {}


def library(path: str) -> LibraryWords:
    if path not in _libraries:
        _libraries[path] = LibraryWords(path)
    return _libraries[path]


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, ids): ids as little-endian unsigned 16- or 32-bit integers, the end id last."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = library(tokenizer_path)
        for batch in slices(batches):
            ids = [np.append(x, end_id).astype("<u4" if len(own.ends) > 1 << 16 else "<u2").tobytes() for x in own.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary())], ["doc_id", "tie", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie")).mapInArrow(run, f"doc_id {kind}, tie bigint, ids binary")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    """Tokenize ``docs`` and write them to the folder ``path``.

    The ids are kept in a compressed table between the count and the coding, so texts are
    tokenized once. Only the counts, one row an id of the vocabulary, reach the driver.
    """
    spark = docs.sparkSession
    tokens = saved(tokenized(docs, tokenizer_path, end_id), "token-ids")
    width = "<u4" if len(library(tokenizer_path).ends) > 1 << 16 else "<u2"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), width))
            own[: len(total)] += total[: len(own)] if len(own) >= len(total) else 0
            if len(own) < len(total):
                total[: len(own)] += own
            else:
                total = own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in rows], default=0) + 1, np.int64)
    for r in rows:
        counts[r.id] = r.n
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), width)], "lengths binary, width string").coalesce(1).write.parquet(f"{path}/code")
    held = lengths.tobytes()
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.frombuffer(held, np.uint8)
        codes, _, _ = canonical(sizes)
        ids, docs_of, n = [], [], 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            bits, marks = pack(flat, codes, sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([[x for x, _ in docs_of]], pa.list_(out_type)), pa.array([[k for _, k in docs_of]], pa.list_(pa.int64())), pa.array([len(flat)], pa.int64()), pa.array([marks], pa.list_(pa.int64())), pa.array([bits], pa.binary())],
                ["doc_ids", "sizes", "n", "checkpoints", "bits"],
            )

        for batch in batches:
            out_type = batch.column(0).type
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, width)
                if n and n + len(own) > BLOCK:
                    yield block()
                    ids, docs_of, n = [], [], 0
                ids.append(own)
                docs_of.append((key, len(own)))
                n += len(own)
        if n:
            yield block()

    # range partitions in ascending document order; a block's place is (file order of its first document)
    ordered = tokens.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    blocks = ordered.mapInArrow(coded, f"doc_ids array<{kind}>, sizes array<bigint>, n bigint, checkpoints array<bigint>, bits binary")
    blocks.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"), "*").write.parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of each document, decoded: start counts the ids of all documents before it.

    A block's start is a running sum over the per-partition totals (one row a partition)
    and, within a partition, over its blocks; both are sums over block headers, not texts.
    """
    code = spark.read.parquet(f"{path}/code").first()
    held, width = bytes(code.lengths), code.width
    blocks = spark.read.parquet(f"{path}/blocks")
    headers = blocks.select("part", "place", "n")
    totals = headers.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.selectExpr("part", "sum(n) OVER (ORDER BY part) - n AS before")
    begun = headers.join(before, "part").selectExpr("place", "before + sum(n) OVER (PARTITION BY part ORDER BY place) - n AS start")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, steps = canonical(np.frombuffer(held, np.uint8))
        for batch in batches:
            for row in range(batch.num_rows):
                start, keys, sizes, n, marks, bits = (batch.column(i)[row].as_py() if i not in (1, 4) else batch.column(i)[row].values for i in range(6))
                ids = unpack(bits, marks.to_numpy(zero_copy_only=False), n, table, steps).astype("<u4")
                ends = np.cumsum(sizes)
                parts = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - np.array(sizes), pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], ["doc_id", "start", "ids"])

    held_blocks = blocks.select("place", "doc_ids", "sizes", "n", "checkpoints", "bits").join(begun, "place")
    return held_blocks.select("start", "doc_ids", "sizes", "n", "checkpoints", "bits").mapInArrow(decoded, f"doc_id {kind}, start bigint, ids binary")
