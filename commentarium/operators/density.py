"""Density clusters with a hierarchy: which groups of rows stay dense the longest.

Rows are linked by mutual reachability, the greatest of their distance and of both rows' core
distances (to the k-th neighbour), over a table of nearest neighbours. A minimum spanning
forest keeps one link a row. Cutting the forest at a distance leaves its dense parts; the parts
at falling distances form a tree, in which only parts of at least ``min_rows`` rows count: a part
lives on while smaller pieces drop off, and ends where it splits in two that count. The parts
with the greatest stability (rows x density range, summed) are the clusters, none inside
another, and rows outside them are noise (Campello et al., 2013).

The forest is found by Boruvka rounds, joins and aggregates over all links. Distances are rounded
up to ``LEVELS`` cuts that share the forest's links evenly; the parts at all cuts are then found side by side
in one run. A cut has at most rows / min_rows parts that count, so the tree that the driver sees
has a few hundred nodes, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.operators.components import connected_components, joined_ends  # noqa: F401
from commentarium.operators.joins import lookup_join
from commentarium.operators.neighbours import NEIGHBOURS, nearest
from commentarium.operators.storage import staged_columns
from commentarium.operators.topics import NOISE, drop_small_clusters, min_cluster_rows

LEVELS = 32
BINS = 4_096
LEAST_DISTANCE = 1e-9  # equal rows are this far apart: densities stay finite


def reachability(near: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(src, dst, w), src < dst: the mutual reachability of neighbours. ``near`` is ``neighbours.nearest``."""
    core = near.groupBy("src").agg(F.max("d").alias("core"))  # the k-th neighbour's; the last one's where there are fewer
    own, others = core.withColumnRenamed("core", "a"), core.select(F.col("src").alias("dst"), F.col("core").alias("b"))
    weighed = near.join(own, "src").join(others, "dst")
    w = F.greatest("d", "a", "b", F.lit(LEAST_DISTANCE))
    return weighed.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w")).distinct()


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(src, dst, w): the minimum spanning forest of ``edges``, ties by the ends' ids.

    Every round each part picks its least link to another part; parts linked so become one.
    The picks form trees with one pair that picked each other, so following them upwards, with doubled
    steps, leads to a common part. Parts at least halve each round, and links inside a part vanish.
    Rounds read files of the round before: a checkpoint would keep Spark's estimate of the joins' size, which squares each step.
    """
    links = staged_columns(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.struct("w", "src", "dst").alias("e")), "links")
    chosen: DataFrame | None = None
    while links.limit(1).count():
        both = links.select("a", "b", "e").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        pick = staged_columns(both.groupBy("a").agg(F.min(F.struct("e", F.col("b").alias("to"))).alias("m")).select("a", "m.to", "m.e"), "picks")
        picked = pick.select("e.src", "e.dst", "e.w").distinct()
        chosen = picked if chosen is None else chosen.unionByName(picked)
        back = pick.select(F.col("a").alias("to"), F.col("to").alias("back"))
        top = (F.col("back") == F.col("a")) & (F.col("a") < F.col("to"))
        up = pick.join(back, "to").select("a", F.when(top, F.col("a")).otherwise(F.col("to")).alias("to"))
        while True:
            above = up.select(F.col("a").alias("to"), F.col("to").alias("above"))
            stepped = staged_columns(up.join(above, "to").select("a", "to", "above"), "steps")
            up = stepped.select("a", F.col("above").alias("to"))
            if not stepped.where("to <> above").limit(1).count():
                break
        left, right = (up.select(F.col("a").alias(end), F.col("to").alias(f"{end}_up")) for end in ("a", "b"))
        moved = links.join(left, "a").join(right, "b").where("a_up <> b_up")
        links = moved.groupBy(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).agg(F.min("e").alias("e"))
        links = staged_columns(links, "links")
    return edges.limit(0) if chosen is None else chosen.select("src", "dst", "w")


def cut_levels(forest: DataFrame, levels: int = LEVELS) -> list[float]:
    """Up to ``levels`` rising distances, the last beyond all links, that share the links about evenly.

    They are upper ends of bins of the distances' logarithms, so one pass of counts finds them.
    """
    ends = forest.agg(F.min("w").alias("low"), F.max("w").alias("high")).first()
    if ends["low"] is None:
        return []
    low, step = float(np.log(ends["low"])), float(np.log(ends["high"]) - np.log(ends["low"])) / BINS
    if step <= 0:
        return [ends["high"]]
    at = F.least(F.floor((F.log("w") - F.lit(low)) / F.lit(step)), F.lit(BINS - 1)).cast("int")
    counts = np.zeros(BINS, dtype=np.int64)
    for r in forest.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect():
        counts[max(r["bin"], 0)] += r["n"]
    reached = np.cumsum(counts)
    bins = {int(np.searchsorted(reached, reached[-1] * (k + 1) / levels)) for k in range(levels)}
    return sorted({float(np.round(np.exp(low + (b + 1) * step), 12)) for b in bins if b < BINS - 1} | {ends["high"]})


def parts_at(forest: DataFrame, cuts: list[float], least: int = 1) -> DataFrame:
    """(level, node, part): for every cut the part of each row that has a link no longer than it; parts are named by their least row.

    Parts of fewer than ``least`` rows are left out.
    """
    level = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda n, c: n + F.when(c < F.col("w"), 1).otherwise(0))
    spread = F.explode(F.sequence(level, F.lit(len(cuts) - 1))).alias("level")
    found = joined_ends(forest.select(spread, "src", "dst"))
    named = found.groupBy("level", "to").agg(F.min("node").alias("part"), F.count("*").alias("n")).where(F.col("n") >= least)
    return lookup_join(found, named.select("level", "to", "part"), ["level", "to"], "inner", spread_by="node", small=True).select("level", "node", "part")


@dataclass
class Branch:
    """A part while it counts: from ``top`` down to ``low``, with its rows at each level."""

    part: int
    top: int
    low: int
    sizes: dict[int, int] = field(default_factory=dict)
    children: list["Branch"] = field(default_factory=list)

    def stability(self, cuts: list[float]) -> float:
        density = [1.0 / c for c in cuts] + [0.0]
        return sum(n * (density[level] - density[level + 1]) for level, n in self.sizes.items())


def branches(counted: list[tuple[int, int, int, int | None]]) -> list[Branch]:
    """The tree of parts from rows (level, part, size, the part that holds it one level up)."""
    by_level: dict[int, list[tuple[int, int, int | None]]] = {}
    for level, part, size, outer in counted:
        by_level.setdefault(level, []).append((part, size, outer))
    roots: list[Branch] = []
    open_at: dict[tuple[int, int], Branch] = {}
    for level in sorted(by_level, reverse=True):
        inside: dict[int | None, list[tuple[int, int]]] = {}
        for part, size, outer in sorted(by_level[level], key=lambda r: r[0]):
            inside.setdefault(outer if (level + 1, outer) in open_at else None, []).append((part, size))
        for outer, held in inside.items():
            parent = open_at.get((level + 1, outer)) if outer is not None else None
            for part, size in held:
                if parent is not None and len(held) == 1:
                    branch = parent
                else:
                    branch = Branch(part, level, level)
                    (roots if parent is None else parent.children).append(branch)
                branch.low, branch.sizes[level] = level, size
                open_at[level, part] = branch
    return roots


def stable(roots: list[Branch], cuts: list[float], single: bool = False) -> list[Branch]:
    """The branches whose stability is not passed by that of the branches within them.

    A lone root is no cluster unless ``single``.
    """

    def best(branch: Branch, may: bool) -> tuple[float, list[Branch]]:
        below = [best(child, True) for child in branch.children]
        inner, own = sum(s for s, _ in below), branch.stability(cuts)
        if may and round(own, 9) >= round(inner, 9):
            return own, [branch]
        return inner, [b for _, found in below for b in found]

    return [b for root in roots for b in best(root, single or len(roots) > 1)[1]]


def cluster_density(
    df: DataFrame,
    features: str = "components",
    row_id: str = "row_id",
    k: int = NEIGHBOURS,
    min_rows: int | None = None,
    single: bool = False,
) -> DataFrame:
    """(row_id, topic_id): the most stable dense parts, largest first; rows outside them are noise.

    Vectors are compared by Euclidean distance; null vectors are noise. Rows need distinct ids. Clusters have at
    least ``min_rows`` rows, a tenth of all (10 at least) unless said otherwise.
    """
    given = staged_columns(df.select(F.col(row_id), F.xxhash64(row_id).alias("key"), F.col(features).cast("array<double>").alias("v")), "points")
    points = given.where("v IS NOT NULL").select("key", "v")
    least = min_rows if min_rows is not None else min_cluster_rows(points.count())
    near = staged_columns(nearest(points, k), "near")
    forest = staged_columns(spanning_forest(reachability(near, k)), "forest")
    cuts = cut_levels(forest)
    if not cuts:
        return given.select(row_id, F.lit(NOISE).alias("topic_id"))
    parts = staged_columns(parts_at(forest, cuts, least), "parts")
    sizes = staged_columns(parts.groupBy("level", "part").agg(F.count("*").alias("n")), "sizes")
    # The part that holds a part one level up holds the row that it is named after, and counts if that one does.
    above = parts.select((F.col("level") - 1).alias("level"), F.col("node").alias("part"), F.col("part").alias("outer"))
    above = lookup_join(above, sizes.select("level", "part"), ["level", "part"], "left_semi", spread_by="outer", small=True)
    counted = sizes.join(above, ["level", "part"], "left").select("level", "part", "n", "outer").collect()  # few: see above
    found = stable(branches([tuple(r) for r in counted]), cuts, single)
    if not found:
        return given.select(row_id, F.lit(NOISE).alias("topic_id"))
    names = df.sparkSession.createDataFrame([(b.top, b.part, i) for i, b in enumerate(found)], "level int, part bigint, cluster int")
    held = lookup_join(parts, names, ["level", "part"], "inner", spread_by="node", small=True).select(F.col("node").alias("key"), "cluster")
    marked = given.select(row_id, "key").join(held, "key", "left")
    marked = staged_columns(marked.select(row_id, F.coalesce("cluster", F.lit(NOISE)).alias("cluster")), "marked")
    return drop_small_clusters(marked, least).select(row_id, "topic_id")
