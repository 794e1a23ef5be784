"""Per-task helpers of the isolation forest (Liu, Ting & Zhou, 2008).

Only NumPy and pandas are imported, so Python workers start fast. Spark decides
which rows each tree sees and which batches are scored where.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

_EULER_GAMMA = 0.5772156649015329

MODEL_SCHEMA = "tree int, node int, feature int, threshold double, below int, above int, path double"


def grow_tree(rows: pd.DataFrame, features: str, seed: int) -> pd.DataFrame:
    """Random axis cuts down to single rows or the depth limit; at most 511 nodes."""
    rows = rows.sort_values("key")
    tree = int(rows["tree"].iloc[0])
    points = np.stack(rows[features].to_numpy())
    depth_limit = int(np.ceil(np.log2(max(len(points), 2))))
    rng = np.random.default_rng([seed, tree])
    nodes: list[list] = []
    waiting = [(np.arange(len(points)), 0, None)]
    while waiting:
        members, depth, parent = waiting.pop()
        here = len(nodes)
        if parent is not None:
            nodes[parent[0]][parent[1]] = here
        spans = points[members].max(axis=0) - points[members].min(axis=0)
        splittable = np.flatnonzero(spans > 0)
        if depth >= depth_limit or len(members) < 2 or not len(splittable):
            nodes.append([tree, here, -1, 0.0, here, here, depth + float(mean_path(len(members)))])
            continue
        feature = int(rng.choice(splittable))
        column = points[members, feature]
        threshold = float(rng.uniform(column.min(), column.max()))
        goes_below = column <= threshold
        if goes_below.all():  # the draw rounded up to the largest value
            threshold = float(column.min())
            goes_below = column <= threshold
        nodes.append([tree, here, feature, threshold, -1, -1, 0.0])
        waiting.append((members[~goes_below], depth + 1, (here, 5)))
        waiting.append((members[goes_below], depth + 1, (here, 4)))
    return pd.DataFrame(nodes, columns=[c.split()[0] for c in MODEL_SCHEMA.split(", ")])


def mean_path(size):
    """Average depth of an unsuccessful search in a binary tree of ``size`` rows."""
    size = np.asarray(size, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        path = 2.0 * (np.log(size - 1.0) + _EULER_GAMMA) - 2.0 * (size - 1.0) / size
    return np.where(size > 2, path, np.where(size == 2, 1.0, 0.0))


class Forest:
    """A node table laid out for scoring batches of vectors."""

    def __init__(self, nodes: pd.DataFrame, sample_size: int) -> None:
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        self.roots = np.flatnonzero(nodes["node"].to_numpy() == 0)
        base = np.repeat(self.roots, np.diff(np.append(self.roots, len(nodes))))
        self.feature = nodes["feature"].to_numpy()
        self.threshold = nodes["threshold"].to_numpy()
        self.below = nodes["below"].to_numpy() + base
        self.above = nodes["above"].to_numpy() + base
        self.path = nodes["path"].to_numpy()
        self.scale = float(mean_path(sample_size)) or 1.0

    def score(self, vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype="float64")
        points = np.stack(vectors.to_numpy())
        rows = np.arange(len(points))
        depth = np.zeros(len(points))
        for root in self.roots:
            at = np.full(len(points), root)
            while True:
                cut = self.feature[at]
                moving = cut >= 0
                if not moving.any():
                    break
                goes_below = points[rows, np.maximum(cut, 0)] <= self.threshold[at]
                at = np.where(moving, np.where(goes_below, self.below[at], self.above[at]), at)
            depth += self.path[at]
        return pd.Series(2.0 ** (-(depth / len(self.roots)) / self.scale))
