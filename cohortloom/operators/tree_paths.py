"""Leaf paths of a fitted tree ensemble and their Shapley contributions.

Path-dependent tree attribution (Lundberg et al., 2018) written per leaf. A leaf is
reached by a subset S of known features with probability
prod_{j in S} hit_j * prod_{j not in S} share_j, where hit_j says whether the row
takes the leaf's branches on feature j and share_j is the training share of those
branches. The Shapley value of that game only needs the sums of products by subset
size, which are built up feature by feature and are vectorised over rows.
"""

from __future__ import annotations

from math import factorial
from typing import NamedTuple

import numpy as np


class LeafPath(NamedTuple):
    """One leaf: its value and, per feature on the way, the open-closed range and share."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def _walk(node, value_of, scale: float, paths: list[LeafPath], seen: dict) -> None:
    if node.subtreeDepth() == 0:
        names = sorted(seen)
        low, high, share = (np.array([seen[f][i] for f in names]) for i in range(3))
        paths.append(LeafPath(value_of(node) * scale, np.array(names, int), low, high, share))
        return
    split = node.split()
    feature, threshold = split.featureIndex(), split.threshold()
    total = node.impurityStats().count()
    for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
        low, high, share = seen.get(feature, (-np.inf, np.inf, 1.0))
        bounds = (low, min(high, threshold)) if is_left else (max(low, threshold), high)
        part = child.impurityStats().count() / total
        _walk(child, value_of, scale, paths, {**seen, feature: (*bounds, share * part)})


def leaf_paths(model) -> tuple[list[LeafPath], float]:
    """All leaf paths of a boosted or random forest classifier, and the expected value."""
    boosted = "GBT" in type(model).__name__
    weights = model.treeWeights
    trees = model.trees

    def margin(node) -> float:
        return node.prediction()

    def class_one(node) -> float:
        stats = node.impurityStats()
        return stats.stats()[1] / sum(stats.stats())

    paths: list[LeafPath] = []
    for tree, weight in zip(trees, weights):
        scale = weight if boosted else 1.0 / len(trees)
        _walk(tree._java_obj.rootNode(), margin if boosted else class_one, scale, paths, {})
    base = float(sum(p.value * np.prod(p.share) for p in paths))
    return paths, base


def path_contributions(paths: list[tuple], rows: np.ndarray, size: int) -> np.ndarray:
    """Contribution of each feature for each row, summed over all leaves (as plain tuples).

    Per leaf, the sums by subset size are the coefficients of prod_i (share_i + hit_i z). They are
    built once; dividing by one factor gives the sums over the other features, for all features at once.
    """
    phi = np.zeros((len(rows), size))
    for value, features, low, high, share in paths:
        m = len(features)
        if m == 0:
            continue
        x = rows[:, features]
        hit = (x > low) & (x <= high)
        weight = [factorial(s) * factorial(m - 1 - s) / factorial(m) for s in range(m)]
        whole = np.zeros((len(rows), m + 1))
        whole[:, 0] = 1.0
        for i in range(m):
            grown = whole * share[i]
            grown[:, 1:] += whole[:, :-1] * hit[:, [i]]
            whole = grown
        others = np.empty((len(rows), m, m))
        others[:, :, m - 1] = whole[:, [m]]
        for k in range(m - 1, 0, -1):
            others[:, :, k - 1] = whole[:, [k]] - share * others[:, :, k]
        # a factor that the row misses is only its share
        others = np.where(hit[:, :, None], others, whole[:, None, :m] / np.asarray(share)[:, None])
        phi[:, features] += value * (hit - share) * (others @ weight)
    return phi
