"""A worker's table of words it has encoded, and the gathering of whole texts from it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc

#: Every character of a text outside this set sends that text to the plain path, letter by letter exact.
PLAIN = r"\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ"
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"


class WordTable(dict):
    """word -> its place; ids of place i are ``flat[start[i] : start[i] + size[i]]``. Beyond ``held`` words it starts afresh, with those it was given."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, held: int = 1_000_000):
        self.encode, self.dtype, self.held = encode, dtype, held
        self.given: tuple = (None, [], np.zeros(0, dtype), np.zeros(0, np.int64))
        self.reset()

    def begin_with(self, name: str, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        """Words with their ids, known by a name: what the table starts with from now on."""
        if name != self.given[0]:
            self.given = (name, words, flat.astype(self.dtype), size)
            self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        _, words, self.flat, self.size = self.given
        self.update(zip(words, range(len(words))))
        self.start = np.cumsum(self.size) - self.size

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.fresh.append(word)
        return place

    def texts(self, cut: Iterable[list[str]]) -> list[np.ndarray]:
        """The ids of each text, which comes as the list of its words."""
        if len(self) > self.held:
            self.reset()
        places = [np.fromiter(map(self.__getitem__, words), np.int32, len(words)) for words in cut]
        if self.fresh:
            flat, size = self.encode(self.fresh)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
            self.fresh = []
        if not places:
            return []
        every = np.concatenate(places)
        size = self.size[every]
        ends = np.cumsum(size)
        at = np.repeat(self.start[every] - (ends - size), size)
        at += np.arange(len(at))
        ids = self.flat[at]
        count = np.cumsum([len(x) for x in places])
        bounds = np.concatenate([[0], ends])[count]
        return np.split(ids, bounds[:-1])


def slices(batches, chars: int = 1 << 24):
    """Arrow batches cut into slices of at most about so many bytes of text, each row whole. Column 1 is the text."""
    for batch in batches:
        at, held = 0, 0
        if batch.nbytes <= chars:
            yield batch
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for i, n in enumerate(sizes):
            held += n
            if held > chars:
                yield batch.slice(at, i + 1 - at)
                at, held = i + 1, 0
        if at < batch.num_rows:
            yield batch.slice(at)


def small_batches(spark, rows: int = 1000) -> None:
    """Arrow batches of fewer rows, as whole texts may be long: a worker's memory is that of a few batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


@contextmanager
def batches_of(spark, rows: int):
    """Arrow batches of so many rows for what is run inside, where single rows are large; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores as it takes to be none of the columns."""
    taken, found = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
