"""Phrases, SentencePiece and spelling variants against brute force and the library, with every awkward case."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from swathframe.llm import collocations, pieces, spelling

DOCS = "doc_id bigint, text string, lang string, word string, n string, ids string, block string, phrase string, decoded string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, text, lang, *"uvwxyz") for i, text, lang in rows], DOCS)


# -------------------------------------------------------------------- phrases
def brute_phrases(rows, least, longest, best):
    n, f = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, " ".join(w[i : i + m])) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    able = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    found = collections.defaultdict(list)
    for (lang, phrase), a in able.items():
        if any(k[0] == lang and len(k[1]) > len(phrase) and f" {phrase} " in f" {k[1]} " and 100 * b >= 100 * a for k, b in able.items()):
            continue
        w = phrase.split(" ")
        score, _, l, r = min((1000 * a * n[lang] // ((l := f[lang, " ".join(w[:k])]) * (r := f[lang, " ".join(w[k:])])), k, l, r) for k in range(1, len(w)))
        found[lang].append((-score, -a, phrase.encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, held in found.items() for i, (s, a, p, l, r) in enumerate(sorted(held)[:best], 1))


@pytest.mark.parametrize("block", [collocations.BLOCK, 40])
def test_phrases(spark, monkeypatch, block):
    monkeypatch.setattr(collocations, "BLOCK", block)
    rng = random.Random(5)
    texts = [" ".join(rng.choices(["a", "b", "c", "dé", "É", "É,", "x.", "\tY"], [9, 5, 4, 3, 1, 1, 1, 1], k=rng.randint(0, 60))) for _ in range(60)]
    texts += ["a b c a b c a b c", "a a a a a a", None, "", " \t ", ".;:", "New York City", "new york city!new york", "\x1c odd \x85 a b\x0b a b\xa0"] * 3 + ["p q r s t u " * 2000]
    rows = [(i if i != 3 else None, t, [None, "und", "fr", "fr"][i % 4]) for i, t in enumerate(texts)]
    for least, best in ((3, 1000), (3, 5)):
        assert sorted(map(tuple, collocations.phrases(docs_of(spark, rows), least, 5, best).collect())) == brute_phrases(rows, least, 5, best)
    assert collocations.phrases(docs_of(spark, []), 3).count() == 0


def test_scores_pass_64_bits(spark, monkeypatch):
    found = spark.createDataFrame([("en", "a b", 2, 3 * 10**12), ("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**13)], "lang string, phrase string, m int, f bigint")
    totals = spark.createDataFrame([("en", 10**14 + 1)], "lang string, n bigint")
    monkeypatch.setattr(collocations, "frequent_phrases", lambda *_: (found, totals))
    row = collocations.phrases(found).first()
    assert row.score == 1000 * row.a * row.n // (row.l * row.r) and row.a * row.n > 2**63


def test_a_block_sends_an_entry_a_group(spark):
    relation = collocations.word_blocks(docs_of(spark, [(i, "of the " * 500, "en") for i in range(40)]).repartition(4), 3)
    rows = relation.collect()
    assert sum(r.words for r in rows) == 40_000 and len(rows) <= 4
    entries = [collocations.unpacked(x.n) for r in rows for x in r.lists]
    assert sum(len(x) for x in entries) == 2 * len(rows) and sum(int(x.sum()) for x in entries) == 40_000
    assert sum(len(r["at"]) + len(r.of) for r in rows) < 2000
    frequent = collocations.frequent_groups(relation, True, 20_000, 3).collect()
    assert sorted((r.word, r.f) for r in frequent if r.id is not None) == [("of", 20_000), ("the", 20_000)]
    assert len({r.id for r in frequent if r.id is not None}) == 2


def test_packed_numbers():
    for most in (0, 255, 256, 65535, 65536, 2**31 - 1, 2**40):
        numbers = np.array([0, most, 1, most])
        assert collocations.unpacked(collocations.packed(numbers)).tolist() == numbers.tolist()
    assert len(collocations.unpacked(collocations.packed(np.zeros(0, np.int64)))) == 0


def test_high_bytes_are_packed_together():
    """Ids of groups were packed number by number, constant high bytes among bytes that differ."""
    rng = np.random.default_rng(0)
    for numbers in (rng.integers(0, 1 << 16, 50_000) + (1 << 20), np.sort(rng.integers(0, 300, 50_000)), rng.integers(0, 1 << 40, 1000)):
        raw = collocations.packed(numbers)
        assert (collocations.unpacked(raw) == numbers).all()
    assert len(collocations.packed(rng.integers(0, 1 << 16, 50_000) + (1 << 20))) < 2.05 * 50_000


# -------------------------------------------------------------- sentencepiece
@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def test_sentencepiece_in_spark(spark, library):
    texts = [None, "", " ", "▁", "  a  b ", "one", "Ünï cödé 日本 🙂", "ﬁ①Å \t\n İ", "\0 nul", "word " * 30_000, "ab" * 30_000, "=" * 5000, "<s> </s> <unk> <0x41>", "٣ ½"]
    rows = docs_of(spark, [(i if i != 3 else None, t, None) for i, t in enumerate(texts)] + [(0, None, None), (5, "one", None)])
    found = collections.Counter((r.doc_id, tuple(r.ids), r.decoded) for r in pieces.encode_decode(rows, P.path("piece_bpe_32k.model")).collect())
    wanted = [(r.doc_id, library.encode(r.text or "")) for r in rows.collect()]
    assert found == collections.Counter((i, tuple(ids), library.decode(ids)) for i, ids in wanted)
    assert pieces.encode_decode(rows.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("long", [pieces.LONG, 6])
def test_rounds_equal_the_library(library, monkeypatch, long):
    monkeypatch.setattr(pieces, "LONG", long)
    own, rng = pieces.MergeRounds(P.path("piece_bpe_32k.model")), random.Random(7)
    alphabets = ["aab bcà é\n\t ▁ 日本語ñ①😀\0.,-=_ABab01", "etaoin shrdlu", "=-_*#/ ", "aA bB"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 150))) for _ in range(3000)]
    ids = own.encode(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert own.decode(ids) == library.decode(library.encode(texts))
    odd = [np.array(rng.choices([259, 260, 13, 5, 200, 201, 230, 1000, 31000], k=rng.randint(0, 9)), np.int32) for _ in range(500)]
    assert own.decode(odd) == [library.decode(x.tolist()) for x in odd]


# ------------------------------------------------------------------- spelling
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=5):
    nears = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, held in nears.items():
        best = min(held, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), counts[w], len(nears[w]), counts.get(form[w])) for w in counts)


@pytest.mark.parametrize("crowd", [spelling.CROWD, 30, 1])
def test_variants(spark, crowd):
    rng, counts = random.Random(3), {}
    while len(counts) < 400:
        counts["".join(rng.choices("abé", k=rng.randint(6, 8)))] = rng.choice([5, 6, 30, 31, 200, 1000])
    for _ in range(3):  # beyond the open letters of a partition
        word = "".join(rng.choices("ab", k=200))
        counts |= {word: 900, word[:100] + word[101:]: 7, word[:100] + "x" + word[101:]: 7, word + word[-1]: 7}
    counts |= {"aaaaaa" + x: 5 for x in "bcdefgh"} | {"aaaaaa": 5, "aaaaaaa": 5, "aaaaaaaa": 5}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert sorted(map(tuple, spelling.variants(vocabulary, 5, crowd).collect())) == brute_variants(counts)
    assert spelling.variants(vocabulary.limit(0)).count() == 0


def test_word_counts(spark):
    rng = random.Random(9)
    texts = [None, "", "short a bc", "Éléphant éléphant ELEPHANT×elephant", "A" * 100_000] + [" ".join(rng.choices(["Letters", "lëtters", "number", "numbers1numbers", "×÷ßÿÀÁ", "wordsÀ"], k=200)) for _ in range(20)]
    rows = [(i if i != 3 else None, t, None) for i, t in enumerate(texts)] * 2
    want = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 3 == 0 else run] += 1
    got = {r.word: r.n for r in spelling.word_counts(docs_of(spark, rows), every=3, shortest=6, least=2).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 2}


def test_acceptor_is_minimal():
    words = sorted({a + b + c for a in "abc" for b in "xy" for c in ("tion", "ting", "t")})
    acceptor = spelling.Acceptor(words)
    assert len(acceptor.arcs) == 8 and acceptor.below[acceptor.start] == len(words)  # the start, after one letter and two, after t, ti, tio, tin, and the end


def test_partitions_split_a_hot_beginning(spark):
    words = [(f"beginning{a}{b}{c}", 5) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    pairs = spelling.near_pairs(spark.createDataFrame(words, "word string, n bigint"), crowd=20)
    assert pairs.count() == 512 * 21 // 2 == pairs.distinct().count()
