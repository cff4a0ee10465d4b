"""A small decision tree, grown by the Gini index."""

from __future__ import annotations

import numpy as np

from motorlens.functions.shipping import by_value

by_value(__name__)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 6, least: int = 2) -> tuple:
    """``(share of label 1,)`` for a leaf, else ``(column, limit, tree up to the limit, tree above it)``."""
    share = float(labels.mean())
    if depth == 0 or len(labels) < least or share in (0.0, 1.0):
        return (share,)
    best = None
    for column in range(rows.shape[1]):
        values = np.unique(rows[:, column])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, column] <= limit
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, column, float(limit), low)
    if best is None:
        return (share,)
    _, column, limit, low = best
    return column, limit, grow(rows[low], labels[low], depth - 1, least), grow(rows[~low], labels[~low], depth - 1, least)


def share_of(tree: tuple, row: tuple | list) -> float:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]
