"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon is learned from labelled rows (words and word beginnings that toxic rows hold
far more often) beside a short fixed one. Dense features of a whole text: lexicon densities,
hits near a second-person word, capitals, punctuation and obfuscation rates. The trees and
the calibration are MLlib's; scoring is a JVM expression over the feature vector.

Bounds: lexicon, trees and calibration are each fitted on at most ``sample`` labelled rows,
chosen by a hash of the id out of disjoint folds (crc32 of the id mod 5: 1 and 2, 3, 4;
fold 0 is held out). Scoring covers all rows and whole texts.

Edge cases: a null text is an empty text and gets a score like any other; a null label is
no label, and of several labels of an id the largest holds; a null doc_id is in no fold;
without both classes in a fold the fixed lexicon alone decides; repeated rows get equal
scores; an empty table gives an empty table; columns other than id and text are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import saved
from .words import free_names

# Common insults, second-person words and look-alike characters.
INSULTS = "idiot idiots moron morons stupid dumb loser losers pathetic scum worthless trash clown disgusting imbecile fool dumbass asshole bitch bastard idiote imbécile connard stupide crétin salaud dummkopf arschloch trottel idiota imbécil estúpido estúpida cabrón tonto gilipollas".split()
SECOND = "you your yours yourself ur u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti usted ustedes vosotros vuestro".split()
LOOKALIKE = str.maketrans("013457@$!|*€", "oieastasii e")

FEATURES = ["words", "hits", "density", "best", "weight", "kinds", "fixed", "hidden", "near_you", "you", "capitals", "shouted", "exclaim", "question", "symbols", "runs", "mixed"]
_word = re.compile(r"[^\W_]+")
_shout = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_runs = re.compile(r"[!?*#$%&@]{2,}")
_mixed = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$!|*€]+|(?:[.\-_][^\W\d_](?=[.\-_]))+[.\-_])[^\W\d_]+")
_you = re.compile(r"\b(?:" + "|".join(SECOND) + r")\b")


class Features:
    """Features of a text under a lexicon {entry: weight}; an entry that ends in ``*`` is the beginning of a word."""

    def __init__(self, lexicon: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        every = {w: (w, 1, 0.0) for w in INSULTS}
        every |= {e.rstrip("*"): (e, int(e in INSULTS), w) for e, w in lexicon.items()}
        for key, value in every.items():
            self.automaton.add_word(key, value)
        self.automaton.make_automaton()

    def hits(self, low: str) -> list[tuple[int, str, int, float]]:
        found = []
        for end, (entry, fixed, weight) in self.automaton.iter(low):
            start = end + 1 - len(entry.rstrip("*"))
            if (start and low[start - 1].isalnum()) or (not entry.endswith("*") and end + 1 < len(low) and low[end + 1].isalnum()):
                continue
            found.append((start, entry, fixed, weight))
        return found

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        low = text.lower()
        n, chars = low.count(" ") + low.count("\n") + 1, len(text) + 1
        found = self.hits(low)
        mixed = _mixed.findall(text)
        hidden = sum(len(self.hits(re.sub(r"[.\-_]", "", m).translate(LOOKALIKE).replace(" ", "").lower())) for m in mixed)
        near = 0
        for start, *_ in found:
            near += bool(_you.search(low, max(0, start - 40), start + 40))
        you = len(_you.findall(low)) if found else 0
        capitals = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbols = sum(map(text.count, "!?*#$%&@"))
        weights = [w for _, _, _, w in found]
        return [np.log1p(n), np.log1p(len(found)), 1000 * len(found) / n, max(weights, default=0.0), 1000 * sum(weights) / n, len({e for _, e, _, _ in found}), sum(f for _, _, f, _ in found), hidden, near, 1000 * you / n, capitals / chars, 1000 * len(_shout.findall(text)) / n, 1000 * text.count("!") / chars, 1000 * text.count("?") / chars, 1000 * symbols / chars, 1000 * len(_runs.findall(text)) / n, 1000 * len(mixed) / n]


def features(text: Column, lexicon: dict[str, float]) -> Column:
    @F.pandas_udf("array<double>")
    def dense(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Features(lexicon)
        for texts in batches:
            yield pd.Series([own.of(t) for t in texts], dtype=object)

    return dense(text)


def fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(-1))


def learn_lexicon(rows: DataFrame, entries: int = 400) -> dict[str, float]:
    """Entry -> log odds, the strongest of those that toxic rows (text, toxic) hold: words, and beginnings of 4 to 6 letters.

    Counts are of documents. Entries need support in three toxic rows and eight times the
    share of other rows; a smoothed ratio of counts keeps rare ones down.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = Counter(), Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = {w for w in _word.findall((text or "").lower()) if len(w) >= 3}
                sides[int(toxic)].update(words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k})
            keys = list(sides[0].keys() | sides[1].keys())
            yield pd.DataFrame({"entry": keys, "clean": [sides[0][k] for k in keys], "bad": [sides[1][k] for k in keys]})

    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return {}
    counts = rows.select("text", "toxic").mapInPandas(counted, "entry string, clean bigint, bad bigint").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = F.log((F.col("bad") + 0.5) / n[1]) - F.log((F.col("clean") + 0.5) / n[0])
    best = counts.where("bad >= 3").select("entry", "bad", odds.alias("odds")).where("odds > 2.1").orderBy(F.desc(F.col("odds") * F.sqrt("bad")), "entry").limit(entries)
    return {r.entry: float(r.odds) for r in best.collect()}


class ToxicityModel:
    """A fitted lexicon, trees and calibration."""

    def __init__(self, lexicon: dict[str, float], trees: GBTClassificationModel | None, isotonic: IsotonicRegressionModel | None):
        self.lexicon, self.trees, self.isotonic = lexicon, trees, isotonic

    def score(self, docs: DataFrame, text_col: str = "text", out: str = "score") -> DataFrame:
        """``docs`` with a column of scores from 0 to 1."""
        x, own = free_names(docs.columns, "x", out)  # the score takes the place of a column of its name at the end
        held = docs.withColumn(x, features(F.col(text_col), self.lexicon))
        if self.trees is None:
            fixed = F.col(x)[FEATURES.index("fixed")]
            found = held.withColumn(own, fixed / (fixed + 1.0))
        elif self.isotonic is None:
            found = self.raw(held, x, own)
        else:
            p, c = free_names([*docs.columns, x, own], "p", "c")
            calibrated = self.isotonic.copy({self.isotonic.featuresCol: p, self.isotonic.predictionCol: c}).transform(self.raw(held, x, p))
            found = calibrated.withColumn(own, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c))))
        return found.select(*[F.col(f"`{k}`") for k in docs.columns if k != out], F.col(own).alias(out))

    def raw(self, held: DataFrame, x: str = "__x", out: str = "__p") -> DataFrame:
        """``held`` with the trees' probability of label 1; ``x`` has the features, and goes."""
        v, k, r, q = free_names([*held.columns, out], "v", "k", "r", "q")
        names = {"featuresCol": v, "predictionCol": k, "rawPredictionCol": r, "probabilityCol": q}
        model = self.trees.copy({getattr(self.trees, param): name for param, name in names.items()})
        scored = model.transform(held.withColumn(v, array_to_vector(x)))
        return scored.withColumn(out, vector_to_array(q)[1]).drop(x, v, k, r, q)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, rounds: int = 20, depth: int = 4) -> ToxicityModel:
    """Fit on rows of ``docs`` (doc_id, text) with labels (doc_id, toxic); see the bounds above."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(fold() > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)  # bounded, so it can be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one row an id
    texts = saved(chosen.withColumn("fold", fold()), "toxicity-sample")
    lexicon = learn_lexicon(texts.where("fold IN (1, 2)"))
    rows = texts.where("fold IN (3, 4)").select("fold", F.col("toxic").cast("double").alias("label"), features(F.col("text"), lexicon).alias("__x"))
    rows = saved(rows, "toxicity-features")
    seen = {(r.fold, r.label) for r in rows.select("fold", "label").distinct().collect()}
    if not {(3, 0.0), (3, 1.0)} <= seen:
        return ToxicityModel(lexicon, None, None)
    train = rows.where("fold = 3").select("label", array_to_vector("__x").alias("__v")).repartition(2)
    trees = GBTClassifier(featuresCol="__v", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7, minInstancesPerNode=5, checkpointInterval=-1).fit(train)
    model = ToxicityModel(lexicon, trees, None)
    if {(4, 0.0), (4, 1.0)} <= seen:
        held = model.raw(rows.where("fold = 4"))
        model.isotonic = IsotonicRegression(featuresCol="__p", labelCol="label").fit(held.select("label", "__p"))
    return model
