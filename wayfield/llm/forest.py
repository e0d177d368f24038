"""A small random forest, grown on a bounded sample and applied as a Spark expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: (feature, threshold, left, right), or the share of positives at a leaf. Left: value <= threshold.
Tree = tuple | float


def _gini_split(x: np.ndarray, y: np.ndarray, least: int) -> tuple[float, float] | None:
    """(impurity, threshold) of the best cut of one feature."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    n = len(y)
    left = np.arange(1, n)
    ones = np.cumsum(y)[:-1]
    rest = y.sum() - ones
    impurity = ones * (1 - ones / left) + rest * (1 - rest / (n - left))
    allowed = (x[1:] > x[:-1]) & (left >= least) & (n - left >= least)
    if not allowed.any():
        return None
    at = int(np.argmin(np.where(allowed, impurity, np.inf)))
    return float(impurity[at]), float((x[at] + x[at + 1]) / 2)


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, tries: int, least: int = 2) -> Tree:
    """One tree; each node looks at ``tries`` features drawn at random."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return round(share, 4)
    best = None
    for f in rng.permutation(x.shape[1])[:tries]:
        found = _gini_split(x[:, f], y, least)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], int(f), found[1])
    if best is None:
        return round(share, 4)
    _, f, cut = best
    low = x[:, f] <= cut
    if low.all() or not low.any():  # neighbouring values whose middle is one of them
        return round(share, 4)
    return f, cut, grow(x[low], y[low], rng, depth - 1, tries, least), grow(x[~low], y[~low], rng, depth - 1, tries, least)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 21, depth: int = 6, seed: int = 7) -> list[Tree]:
    """Trees on bootstrap samples in which both classes weigh the same."""
    rng = np.random.default_rng(seed)
    if len(set(y.tolist())) < 2:
        return [float(y[0])] if len(y) else [0.0]
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    size = min(1500, max(map(len, sides)))
    tries = max(1, round(np.sqrt(x.shape[1])) + 1)
    out = []
    for _ in range(trees):
        rows = np.concatenate([rng.choice(s, size) for s in sides])
        out.append(grow(x[rows], y[rows], rng, depth, tries))
    return out


def score(forest: list[Tree], feature: Callable[[int], Column]) -> Column:
    """Mean vote of the trees; ``feature(i)`` is the i-th feature's column."""

    def vote(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, cut, low, high = tree
        return F.when(feature(f) <= cut, vote(low)).otherwise(vote(high))

    total = vote(forest[0])
    for tree in forest[1:]:
        total = total + vote(tree)
    return total / len(forest)
