"""SentencePiece encoding (BPE models with byte fallback) by vectorised merge rounds, and decoding.

A text is normalised, cut into words where no entry of the vocabulary can reach across, and
its words are laid out as one flat numpy array of symbols. In each round every word finds
its best pair by a segmented minimum of pair ranks and merges all places where it stands,
the left one first where two overlap; words without a pair leave the array, which is
compacted, until none is left. Merging one place after the other gives the same unless a
merge makes a pair that ranks before the one just merged; such words, and words of over
``LONG`` symbols, are merged one place at a time from a heap.

Texts stay where they lie: a task encodes the words of a slice of its texts together and
remembers a bounded number of them, so nothing is shuffled and memory is that of a slice.

Edge cases: a null text is an empty text with no ids; repeated rows are encoded like any
other; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import WordTable, slices

#: Bytes of text in a slice; words that a worker remembers, and ids of theirs: what bounds its memory.
SLICE, HELD, HELD_IDS = 1 << 22, 400_000, 8_000_000
#: Symbols of the longest word that is merged in rounds.
LONG = 1_000
SPACE = "▁"
NONE = np.int32(2**31 - 1)


class MergeRounds:
    """Encodes and decodes as the sentencepiece library does with the model at ``path``."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(lib.get_piece_size())
        special = [i for i in every if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)]
        if any(map(lib.is_unused, every)) or sum(lib.is_byte(i) for i in special) != 256:
            raise ValueError("only models with byte fallback and without unused pieces are supported")
        plain = sorted(set(every) - set(special))
        if sum(lib.get_score(i) == 0 for i in plain) > 1:
            raise ValueError("models with user-defined pieces are not supported")
        ids = {lib.id_to_piece(i): i for i in plain}
        # letters that stand in pieces only as parts get numbers beyond the vocabulary
        parts = sorted({c for piece in ids for c in piece} - set(ids))
        symbol = ids | {c: len(every) + k for k, c in enumerate(parts)}
        self.size = len(every)
        self.letter = np.full(0x110000, -1, np.int32)
        for text, i in symbol.items():
            if len(text) == 1:
                self.letter[ord(text)] = i
        self.part = np.array([ord(c) for c in parts], np.int64)
        order = {score: k for k, score in enumerate(sorted({lib.get_score(i) for i in plain}, reverse=True))}
        pairs = []  # every way in which two symbols make a piece
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = symbol.get(piece[:k]), symbol.get(piece[k:])
                if a is not None and b is not None:
                    pairs.append((a << 20 | b, order[lib.get_score(i)], i))
        keys, ranks, made = zip(*sorted(pairs))
        self.keys, self.ranks, self.made = np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32)
        self.pairs = dict(zip(keys, zip(ranks, made)))
        self.byte = np.array([lib.piece_to_id(f"<0x{i:02X}>") for i in range(256)], np.int32)
        surface = [b""] * len(every)
        for i in plain:
            surface[i] = lib.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            surface[i] = bytes([b])
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_size = np.array([len(x) for x in surface], np.int64)
        self.surface_start = np.array([0, *accumulate(len(x) for x in surface)][:-1], np.int64)
        self.opens = np.array([lib.id_to_piece(i).startswith(SPACE) for i in every])
        # no piece has a space sign after another letter: words end before the next one begins
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(SPACE in p.lstrip(SPACE) for p in ids) else "(?s).+")
        probe = "ﬁ①Å \t\n  İ  b "
        self.as_is = lib.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.words = WordTable(self.encode_words, np.int32, HELD)

    def normalised(self, text: str) -> str:
        if not self.as_is:
            return self.library.normalize(text)
        return SPACE + text.replace(" ", SPACE) if text else ""

    def pair_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) that each pair makes; NONE where it makes none."""
        keys = a.astype(np.int64) << 20 | b
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        able = (self.keys[at] == keys) & (a >= 0) & (b >= 0)
        return np.where(able, self.ranks[at], NONE), self.made[at]

    def one_place_at_a_time(self, symbols: np.ndarray) -> np.ndarray:
        """Smallest rank, then leftmost, from a heap of pairs."""
        token, end = symbols.tolist(), len(symbols)
        nxt, prv = list(range(1, end + 1)), list(range(-1, end - 1))
        rank, made = self.pair_of(symbols[:-1], symbols[1:])
        heap = [(int(rank[i]), i, token[i], token[i + 1], int(made[i])) for i in np.flatnonzero(rank != NONE)]
        heapq.heapify(heap)

        def put(i: int, j: int) -> None:
            if token[i] >= 0 and token[j] >= 0 and (found := self.pairs.get(token[i] << 20 | token[j])):
                heapq.heappush(heap, (found[0], i, token[i], token[j], found[1]))

        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = nxt[i]
            if token[i] != a or j == end or token[j] != b:
                continue
            token[i], token[j] = piece, None
            nxt[i] = after = nxt[j]
            if after < end:
                prv[after] = i
                put(i, after)
            if prv[i] >= 0:
                put(prv[i], i)
        return np.array([t for t in token if t is not None], np.int32)

    def rounds(self, token: np.ndarray, word: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """([(word, symbol) of words that are through], words whose order of merges matters); the symbols of a word lie together."""
        through, late = [], []
        rank, made = np.full(len(token), NONE), np.zeros(len(token), np.int32)

        def look_up(at: np.ndarray) -> None:
            rank[at] = NONE
            at = at[at + 1 < len(token)]
            at = at[word[at] == word[at + 1]]
            rank[at], made[at] = self.pair_of(token[at], token[at + 1])

        look_up(np.arange(len(token)))
        while len(token):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(token)))
            least = np.minimum.reduceat(rank, first)
            if (over := least == NONE).any():
                leaves = np.repeat(over, size)
                through.append((word[leaves], token[leaves]))
                token, word, rank, made = (x[~leaves] for x in (token, word, rank, made))
                least, size = least[~over], size[~over]
                if not len(token):
                    break
            own = np.repeat(least, size)
            hit = np.flatnonzero(rank == own)
            if (follows := hit[1:] == hit[:-1] + 1).any():  # overlapping places: the left one first
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(np.concatenate([[True], ~follows]), place, 0))
                hit = hit[(place - run) % 2 == 0]
            merged = own[hit]
            token[hit] = made[hit]
            stays = np.ones(len(token), bool)
            stays[hit + 1] = False
            token, word, rank, made = (x[stays] for x in (token, word, rank, made))
            hit = hit - np.arange(len(hit))
            look_up(np.concatenate([hit, hit[hit > 0] - 1]))
            several = np.zeros(len(hit), bool)
            several[1:] = word[hit[1:]] == word[hit[:-1]]
            several[:-1] |= several[1:]
            before = np.maximum(hit - 1, 0)
            early = several & ((rank[hit] <= merged) | ((word[before] == word[hit]) & (before < hit) & (rank[before] <= merged)))
            if early.any():
                late.append(np.unique(word[hit[early]]))
                leaves = np.isin(word, late[-1])
                token, word, rank, made = (x[~leaves] for x in (token, word, rank, made))
        return through, np.concatenate(late) if late else np.zeros(0, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids a word)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        token = self.letter[points]
        token = np.where(token < 0, -1 - points, token).astype(np.int32)  # a letter that no piece has is its own negative
        word = np.repeat(np.arange(len(words)), size)
        short = np.repeat(size <= LONG, size)
        through, late = self.rounds(token[short], word[short])
        for i in np.concatenate([late, np.flatnonzero(size > LONG)]):
            ids = self.one_place_at_a_time(token[start[i] : start[i] + size[i]])
            through.append((np.full(len(ids), i), ids))
        word, token = (np.concatenate(x) for x in zip(*through)) if through else (word, token)
        order = np.argsort(word, kind="stable")
        word, token = word[order], token[order]
        beyond = token >= self.size
        token[beyond] = -1 - self.part[token[beyond] - self.size]
        if (odd := np.flatnonzero(token < 0)).size:  # byte fallback
            raw = [chr(-1 - t).encode() for t in token[odd].tolist()]
            times = np.ones(len(token), np.int64)
            times[odd] = [len(x) for x in raw]
            place = np.repeat(token < 0, times)
            token, word = np.repeat(token, times), np.repeat(word, times)
            token[place] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return token, np.bincount(word, minlength=len(words)).astype(np.int64)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.words.flat) > HELD_IDS:
            self.words.reset()
        return self.words.texts(self.word.findall(self.normalised(t or "")) for t in texts)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each row of ids. Runs of byte pieces that are no UTF-8 are left to the library."""
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        size, start = self.surface_size[flat], self.surface_start[flat]
        count = np.array([len(x) for x in ids], np.int64)
        begin = (np.cumsum(count) - count)[count > 0]
        drop = begin[self.opens[flat[begin]]]  # the space before the first word goes
        start[drop] += 1
        size[drop] -= 1
        end = np.cumsum(size)
        raw = self.surface[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cuts = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(count)])].tolist()
        found = []
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            try:
                found.append(raw[a:b].decode())
            except UnicodeDecodeError:
                found.append(self.library.decode(ids[k].tolist()))
        return found


_coders: dict[str, MergeRounds] = {}


def coder(path: str) -> MergeRounds:
    """The worker's own, with the words that it has met."""
    if path not in _coders:
        _coders[path] = MergeRounds(path)
    return _coders[path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text and the text that they decode to."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(model_path)
        for batch in slices(batches, SLICE):
            ids = own.encode(batch.column(1).to_pylist())
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(own.decode(ids), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
