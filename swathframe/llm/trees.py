"""Trees of a fitted MLlib gradient-boosted classifier as arrays, for scoring inside Arrow tasks."""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import GBTClassificationModel


def arrays(model: GBTClassificationModel) -> list[tuple[np.ndarray, ...]]:
    """(feature, threshold, left, right, value) of each tree, read from the model's printed form; feature -1 is a leaf."""
    out = []
    line = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE+]+|NaN)\)|( *)Predict: ([-\d.eE+]+)")
    for tree, weight in zip(model.trees, model.treeWeights):
        feature, threshold, left, right, value = [], [], [], [], []
        parsed = [m for m in map(line.match, tree.toDebugString.splitlines()[1:]) if m]

        def node(at: int) -> tuple[int, int]:
            me, m = len(feature), parsed[at]
            for x, y in ((feature, -1), (threshold, 0.0), (left, me), (right, me), (value, 0.0)):
                x.append(y)
            if m[6] is not None:
                value[me] = float(m[6]) * weight
                return me, at + 1
            feature[me], threshold[me] = int(m[2]), float(m[4])
            left[me], at = node(at + 1)
            right[me], at = node(at + 1)  # the line of its Else
            return me, at

        node(0)
        out.append(tuple(np.array(x) for x in (feature, threshold, left, right, value)))
    return out


def probability(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each row of ``x``."""
    margin = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        while len(feature) > 1 and (feature[at] >= 0).any():
            go = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(go, left[at], right[at])
        margin += value[at]
    return 1 / (1 + np.exp(-2 * margin))
