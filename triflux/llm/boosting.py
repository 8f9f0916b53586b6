"""Gradient-boosted trees over cells: distinct rows of small integer features with counts.

The cells of a corpus are few however many rows fall into them, so trees are
fitted to their counts, and a fitted model is a Column expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TREES = 20
DEPTH = 2
STEP = 0.3
PENALTY = 1.0


@dataclass
class Node:
    """A leaf has a value; an inner node sends ``feature <= at`` to ``low``, others to ``high``."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    low: Node | None = None
    high: Node | None = None

    def score(self, cells: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(cells), self.value)
        goes_low = cells[:, self.feature] <= self.at
        return np.where(goes_low, self.low.score(cells), self.high.score(cells))

    def column(self, feature: Callable[[int], Column]) -> Column:
        if self.low is None or self.high is None:
            return F.lit(self.value)
        goes_low = feature(self.feature) <= self.at
        return F.when(goes_low, self.low.column(feature)).otherwise(self.high.column(feature))


def _grow(cells: np.ndarray, pull: np.ndarray, weight: np.ndarray, depth: int) -> Node:
    def gain(mask: np.ndarray) -> float:
        return float(pull[mask].sum() ** 2 / (weight[mask].sum() + PENALTY))

    everything = np.ones(len(cells), bool)
    best, choice = gain(everything) + 1e-9, None
    if depth:
        for feature in range(cells.shape[1]):
            for at in np.unique(cells[:, feature])[:-1].tolist():
                low = cells[:, feature] <= at
                if (found := gain(low) + gain(~low)) > best:
                    best, choice = found, (feature, at, low)
    if choice is None:
        return Node(float(STEP * pull.sum() / (weight.sum() + PENALTY)))
    feature, at, low = choice
    return Node(
        feature=feature,
        at=at,
        low=_grow(cells[low], pull[low], weight[low], depth - 1),
        high=_grow(cells[~low], pull[~low], weight[~low], depth - 1),
    )


def boost(cells: np.ndarray, total: np.ndarray, positive: np.ndarray) -> list[Node]:
    """Trees for the log odds of being positive; ``total`` and ``positive`` count each cell's rows."""
    trees: list[Node] = []
    score = np.zeros(len(cells))
    for _ in range(TREES if len(cells) else 0):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(cells, positive - total * p, total * p * (1 - p), DEPTH)
        score += tree.score(cells)
        trees.append(tree)
    return trees


def score_column(trees: list[Node], feature: Callable[[int], Column]) -> Column:
    """The sum of the trees, rounded so that it compares equal to the one on cells."""
    total = F.lit(0.0)
    for tree in trees:
        total = total + tree.column(feature)
    return F.round(total, 9)


def scores(trees: list[Node], cells: np.ndarray) -> np.ndarray:
    total = np.zeros(len(cells))
    for tree in trees:
        total += tree.score(cells)
    return np.round(total, 9)


def threshold(
    score: np.ndarray, total: np.ndarray, positive: np.ndarray, precision: float
) -> float | None:
    """The lowest score such that, from every score above it on, enough rows are positive.

    None if no score is high enough.
    """
    lowest = None
    for at in np.unique(score)[::-1].tolist():
        taken = score >= at
        if positive[taken].sum() < precision * total[taken].sum():
            break
        lowest = at
    return lowest
