"""Byte-level BPE by merge replay.

The distinct words of the corpus are counted, copies combined before the shuffle. Those of
each partition are laid out side by side, one node a byte. An inverted index holds, for
every token pair that is a vocabulary entry, the positions where it stands; merges are
applied to all their positions at once, in rank order, and only the neighbours of what was
merged are looked up again and put back into the index. Words are independent, so the global
order gives each word just what merging it alone would give.

Texts are then gathered from the words where they lie, without a shuffle. For that the
``TABLE`` most frequent words of the corpus, a bounded table, go to every task; rarer words
and long ones are replayed by the task that meets them, a slice of its texts at a time, and
remembered.

Edge cases: a null text is an empty text with no ids; lone surrogates cannot occur in a
Spark string; repeated rows are encoded like any other; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import saved
from .words import LETTERS, PLAIN, WordTable, slices

#: Bytes of text in a slice and words that a worker remembers: what bounds its memory.
SLICE, HELD = 1 << 22, 400_000
#: Words of the corpus that every task gets, and the characters of the longest of them.
TABLE, LONGEST = 150_000, 32
#: Unicode white space, as the tokenizer's \s means it.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Replay:
    """Encodes words by replaying the merges of a tiktoken rank file over all of them together."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = []  # every way in which two entries make a third
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs.append((a << 20 | b, rank))
        pairs.sort()
        self.pairs = np.array([x for x, _ in pairs], np.int64)
        self.made = np.array([r for _, r in pairs], np.int32)
        self.pattern = pattern
        self.words = WordTable(self.encode_words, np.uint32, HELD)
        self.odd = re.compile(f"[^{PLAIN}]")
        # on texts without odd characters these classes are the pattern's own, and re is faster
        self.quick = re.compile(pattern.replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9").replace(f" ?{LETTERS}+", f" ?[{LETTERS}]+").replace(" ?0-9+", " ?[0-9]+"))
        self.exact = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))

    def cut(self, text: str) -> list[str]:
        return (self.exact if self.odd.search(text) else self.quick).findall(text)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it makes no entry; negative tokens are gaps between words."""
        keys = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.pairs, keys)
        at[at == len(self.pairs)] = 0
        return np.where((self.pairs[at] == keys) & (a >= 0) & (b >= 0), self.made[at], -1)

    def one_word(self, word: bytes) -> list[int]:
        """A single word, smallest rank and then leftmost first."""
        parts = [self.ranks[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            ranks = self.pair_ranks(np.array(parts[:-1]), np.array(parts[1:]))
            able = np.flatnonzero(ranks >= 0)
            if not len(able):
                break
            i = able[np.argmin(ranks[able])]
            parts[i : i + 2] = [int(ranks[i])]
        return parts

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids a word)."""
        raw = [w.encode("utf-8") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        first = np.cumsum(size + 1) - size  # a gap before each word and one at the end
        end = int(size.sum() + len(raw))
        token = np.full(end + 1, -1, np.int32)
        inside = np.ones(end + 1, bool)
        inside[first - 1] = inside[end] = False
        token[inside] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        nxt, prv = np.arange(1, end + 2, dtype=np.int32), np.arange(-1, end, dtype=np.int32)
        nxt[end] = end
        rank = np.append(self.pair_ranks(token[:-1], token[1:]), -1).astype(np.int32)
        for i in [k for k, w in enumerate(raw) if w in self.ranks]:  # an entry stands for itself
            rank[first[i] : first[i] + size[i]] = -1
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(at: np.ndarray) -> None:
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            cuts = np.flatnonzero(np.diff(rank[at])) + 1
            for part in np.split(at, cuts) if len(cuts) else [at]:
                r = int(rank[part[0]])
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(queue, r)

        able = np.flatnonzero(rank >= 0)
        if len(able):
            put(able)
        late: list[np.ndarray] = []
        while queue:
            r = heapq.heappop(queue)
            held = index.pop(r)
            at = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            at = at[rank[at] == r]
            if not len(at):
                continue
            after = nxt[at]
            if (clash := after[:-1] == at[1:]).any():  # overlapping pairs: the left one first
                keep, i = np.ones(len(at), bool), 0
                for i in np.flatnonzero(clash):
                    keep[i + 1] = not keep[i]
                at, after = at[keep], after[keep]
            beyond = nxt[after]
            token[at], token[after], rank[after] = r, -2, -1
            nxt[at], prv[beyond] = beyond, at
            before = prv[at]
            touched = np.concatenate([before, at])
            own = self.pair_ranks(token[touched], token[nxt[touched]])
            rank[touched] = own
            if (early := (own >= 0) & (own <= r)).any():  # a smaller rank than its parts': those words are done singly
                late.append(touched[early])
            fresh = touched[own > r]
            if len(fresh):
                put(np.unique(fresh))
        starts = first
        alive = token >= 0
        if late:
            for i in np.unique(np.searchsorted(starts, np.concatenate(late), side="right") - 1):
                ids = self.one_word(raw[i])
                span = slice(starts[i], starts[i] + size[i])
                alive[span] = False
                alive[starts[i] : starts[i] + len(ids)] = True
                token[starts[i] : starts[i] + len(ids)] = ids
        for i in [k for k, w in enumerate(raw) if w in self.ranks]:
            alive[starts[i] : starts[i] + size[i]] = False
            alive[starts[i]] = True
            token[starts[i]] = self.ranks[raw[i]]
        count = np.add.reduceat(alive, starts - 1) if len(raw) else np.zeros(0, np.int64)
        return token[alive], count.astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.words.texts(self.cut(t or "") for t in texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_replays: dict[tuple[str, str], Replay] = {}


def replay(path: str, pattern: str) -> Replay:
    """The worker's own, with the words that it has met."""
    if (path, pattern) not in _replays:
        _replays[path, pattern] = Replay(path, pattern)
    return _replays[path, pattern]


def word_counts(docs: DataFrame, pattern: str) -> DataFrame:
    """(word, n): the distinct words of at most ``LONGEST`` characters of all texts; docs: (doc_id, text).

    Texts are cut by the JVM, which is quicker. Where its classes of characters differ from
    the tokenizer's, a word is counted that no text is cut into, or one is missing from the
    table; texts themselves are always cut by ``Replay.cut``.
    """
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def corpus_table(docs: DataFrame, ranks_path: str, pattern: str, most: int = TABLE) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, ids of all of them, ids a word) of the most frequent words of the corpus, ``most`` of them at the most.

    How often a word must occur is read off a histogram of counts with 16 steps to a doubling.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    counts = saved(word_counts(docs, pattern), "bpe-words")
    held, least = 0, 1 << 30
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        held += r["count"]
        if held > most:
            break
        least = r.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for batch in batches for w in batch.column(0).to_pylist()]  # a share of at most TABLE words
        if words:
            flat, size = replay(ranks_path, pattern).encode_words(words)
            parts = np.split(flat.astype("<u4"), np.cumsum(size)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([x.tobytes() for x in parts], pa.binary())], ["word", "ids"])

    rows = saved(counts.where(step >= least).select("word").mapInArrow(run, "word string, ids binary"), "bpe-table").collect()
    return [r.word for r in rows], np.frombuffer(b"".join(r.ids for r in rows), "<u4"), np.array([len(r.ids) // 4 for r in rows], np.int64)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): ids as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
    kind = docs.schema[id_col].dataType.simpleString()
    own_docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, *corpus_table(own_docs, ranks_path, pattern)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = replay(ranks_path, pattern)
        own.words.begin_with(*table.value)
        for batch in slices(batches, SLICE):
            ids = own.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([own.decode(x) for x in ids], pa.binary())],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    return own_docs.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids binary, decoded binary")
