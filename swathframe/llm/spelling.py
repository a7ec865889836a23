"""Spelling variants by finite-state composition.

Words within one inserted, deleted or replaced letter of each other are what the
composition of a vocabulary acceptor, a one-edit transducer and the acceptor again accepts.
A path of it takes equal letters on both sides, one edit, and equal letters to the end. It
is enumerated for each partition of the initial state by itself: a partition is given by
letters that both words have in common at the start (a state that both sides have reached)
or at the end, and holds the words with those letters and the length of the longer word or
one less. Of the letters outside the edit at least half lie on one side of it, so a pair
meets in the partition of its first or of its last half; which of the two follows from the
length of what the words have in common at the start, so that no pair is found twice.

Partitions of over ``CROWD`` words or with more than ``DEEP`` open letters are cut by the
same rule again, as often as it takes: in the end a partition has one open letter, and as
many words as there are letters. So no task gets an unbounded group, however many words
begin alike. The acceptor of a partition is minimised while its sorted words are read.

Edge cases: null texts have no words, a null id counts as an empty text in the hash;
repeated rows count again; an empty table gives an empty table; other columns are ignored.
Equal counts choose the smallest word in code-point order. A form is at least ``ratio``
times as frequent, so that chains of forms end.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import saved

#: Words of the largest partition, and open letters of its longest word.
CROWD, DEEP = 5_000, 64
RUN = r"[A-Za-zÀ-ÿ]+"


def word_counts(docs: DataFrame, every: int | None = None, shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of runs of letters with A-Z lower-cased, of ``shortest`` letters and ``least`` occurrences; docs: (doc_id, text).

    Where ``every`` divides the CRC-32 of ``<doc_id>:<word>``, the letter at that value modulo the word's length is left out first.
    """
    run = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    words = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    words = words.where(F.length("run") >= shortest).select("id", run.alias("run"))
    if every:
        words = words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        words = words.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("run"))
    counts = words.where(F.length("run") >= shortest).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least)


class Acceptor:
    """A minimal acyclic acceptor, built from sorted distinct words. ``arcs[q]`` has the letters of a state, ``accepts[q]`` the words that it ends."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        self.below: list[int] = []
        open_arcs: list[dict[str, int]] = [{}]
        open_final = [False]
        before = ""
        for word in words:
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            self.close(open_arcs, open_final, before, same)
            for _ in range(len(word) - same):
                open_arcs.append({})
                open_final.append(False)
            open_final[-1] = True
            before = word
        self.close(open_arcs, open_final, before, 0)
        self.start = self.state(open_arcs[0], open_final[0])

    def close(self, arcs: list, final: list, word: str, keep: int) -> None:
        """States below depth ``keep`` get no more arcs: each becomes the one that equals it."""
        while len(arcs) > keep + 1:
            q = self.state(arcs.pop(), final.pop())
            arcs[-1][word[len(arcs) - 1]] = q

    def state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.below.append(final + sum(self.below[q] for q in arcs.values()))
        return self.known[key]

    def number(self, q: int) -> list[tuple[str, int, int]]:
        """(letter, next state, words that sort before those of the arc) of the arcs of a state."""
        found, n = [], int(self.final[q])
        for letter, r in self.arcs[q].items():
            found.append((letter, r, n))
            n += self.below[r]
        return found


class Composition:
    """Pairs (i, j) of a word i of ``a`` and a word j of ``b`` that one edit turns into each other, after fewer than ``within`` equal letters.

    With the same acceptor twice the edit replaces a letter, i < j; else the words of ``a`` are a letter longer and it
    deletes one. ``after`` is what follows all the words: a last letter equal to its first one is not the place of the edit.
    """

    def __init__(self, a: Acceptor, b: Acceptor):
        self.a, self.b = a, b
        self.rest: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def common(self, q: int, r: int) -> list[tuple[int, int]]:
        """What both states accept: the places of each such string among the words of either."""
        if (q, r) not in self.rest:
            if self.a is self.b and q == r:
                found = [(i, i) for i in range(self.a.below[q])]
            else:
                found = [(0, 0)] if self.a.final[q] and self.b.final[r] else []
                other = {letter: (s, n) for letter, s, n in self.b.number(r)}
                for letter, s, n in self.a.number(q):
                    if letter in other:
                        t, m = other[letter]
                        found += [(n + i, m + j) for i, j in self.common(s, t)]
            self.rest[q, r] = found
        return self.rest[q, r]

    def pairs(self, within: int, after: str) -> Iterator[tuple[int, int]]:
        todo = [(self.a.start, self.b.start, 0, 0, 0)]  # both sides have read the same letters
        while todo:
            q, r, at, of, depth = todo.pop()
            left, right = self.a.number(q), self.b.number(r)
            if self.a is self.b:
                for k, (_, s, n) in enumerate(left):
                    for _, t, m in left[k + 1 :]:
                        yield from ((at + n + i, at + m + j) for i, j in self.common(s, t))
            else:
                for letter, s, n in left:  # of equal neighbours the last is the one deleted
                    if self.a.final[s] and self.b.final[r] and letter != after[:1]:
                        yield at + n, of
                    for first, t, m in right:
                        if first != letter and first in self.a.arcs[s]:
                            skip = next(k for x, _, k in self.a.number(s) if x == first)
                            yield from ((at + n + skip + i, of + m + j) for i, j in self.common(self.a.arcs[s][first], t))
            if depth + 1 < within:
                other = {letter: (t, m) for letter, t, m in right}
                todo += [(s, other[x][0], at + n, of + other[x][1], depth + 1) for x, s, n in left if x in other]


def near_words(words: list[tuple[str, int]], longer: int, within: int, after: str) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    """Near pairs of a partition: (open letters, ...) rows of ``longer`` letters or one less, sorted."""
    long, short = [w for w in words if len(w[0]) == longer], [w for w in words if len(w[0]) < longer]
    if not long:
        return
    a = Acceptor([w[0] for w in long])
    yield from ((long[i], long[j]) for i, j in Composition(a, a).pairs(within, after))
    if short:
        b = Acceptor([w[0] for w in short])
        yield from ((long[i], short[j]) for i, j in Composition(a, b).pairs(within, after))


def left(word: Column | str, n: Column) -> Column:
    return F.substring(word, F.lit(1), n)


def from_end(word: Column | str, n: Column) -> Column:
    return F.substring(word, F.length(word) - n + 1, n)


def halved(rows: DataFrame) -> DataFrame:
    """Each row in the partitions of its next half: more fixed letters at the start (p, head), or at the end (s, tail)."""
    open_letters = F.col("c") - F.length("head") - F.length("tail")
    first = F.floor(open_letters / 2).cast("int")
    last = open_letters - first
    at_start = F.struct(F.concat("head", left("open", first)).alias("head"), F.col("tail").alias("tail"), F.substring("open", first + 1, F.length("open")).alias("open"), (F.col("within") - first).alias("within"))
    at_end = F.struct(F.col("head").alias("head"), F.concat(from_end("open", last), "tail").alias("tail"), left("open", F.length("open") - last).alias("open"), F.least("within", first).alias("within"))
    return rows.select("word", "n", "c", F.explode(F.array(at_start, at_end)).alias("x")).select("word", "n", "c", "x.*").where("within > 0")


def near_pairs(vocabulary: DataFrame, crowd: int = CROWD, deep: int = DEEP) -> DataFrame:
    """(a, a_n, b, b_n): every pair of near words of (word, n) once."""
    c = F.explode(F.array(F.length("word"), F.length("word") + 1))
    rows = vocabulary.select("word", "n", c.alias("c")).select("*", F.lit("").alias("head"), F.lit("").alias("tail"), F.col("word").alias("open"), F.col("c").alias("within"))
    key = ["c", "head", "tail"]
    ready, rows = None, halved(rows)
    while True:
        rows = saved(rows, "spelling-words")
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size"))
        open_letters = F.col("c") - F.length("head") - F.length("tail")
        large = (open_letters > 1) & ((F.col("size") > crowd) | (open_letters > deep))
        again = saved(sizes.where(large).select(*key), "spelling-large")
        last = again.isEmpty()
        fit = rows if last else rows.join(again, key, "left_anti")
        ready = fit if ready is None else ready.unionByName(fit)
        if last:
            break
        rows = halved(rows.join(again, key))
    groups = ready.groupBy(*key, "within").agg(F.sort_array(F.collect_list(F.struct("open", "word", "n"))).alias("words")).where(F.size("words") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for longer, within, after, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for x, y in near_words([(w["open"], w["word"], w["n"]) for w in words], longer, within, after):
                    for column, value in zip(found, (x[1], x[2], y[1], y[2])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["a", "a_n", "b", "b_n"])

    return groups.select(open_letters.alias("longer"), "within", left("tail", F.lit(1)), "words").mapInArrow(run, "a string, a_n bigint, b string, b_n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): each word's last form, by doubling the steps until none moves."""
    at = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = at.select(F.col("word").alias("from"), F.col("root").alias("to"))
        moved = saved(at.join(on, F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return at


def variants(vocabulary: DataFrame, ratio: int = 5, crowd: int = CROWD) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of (word, n), words distinct."""
    words = saved(vocabulary, "spelling-vocabulary")
    pairs = saved(near_pairs(words, crowd), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    near = saved(words.join(best, "word", "left").withColumn("has", F.coalesce(-F.col("best.minus") >= ratio * F.col("n"), F.lit(False))).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best.form")).alias("form"), F.when(F.col("has"), -F.col("best.minus")).alias("form_n")
    ), "spelling-near")
    ends = roots(near.where("form IS NOT NULL").select("word", "form"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
