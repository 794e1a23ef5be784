"""Nearest neighbours of vectors by repeated random-projection trees.

Every tree cuts the rows into slices along a random direction, each slice along the next one,
until slices hold about ``leaf_rows`` rows; rows of one leaf are compared with each other. Trees
differ in their directions, so near rows that one tree parts meet in another. Leaves
are of bounded size whatever the data: rows with equal vectors are told apart by a hash. Up to
``leaf_rows`` rows make one leaf, and the answer is then exact.

Directions, cuts and ties come from hashes of the rows' ids, so the answer does not hang on the
partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentarium.functions.keys import SEED
from commentarium.functions.vectors import SCORE_DIGITS
from commentarium.operators.joins import lookup_join
from commentarium.operators.storage import staged_columns

NEIGHBOURS = 15
LEAF_ROWS = 1_024
TREES = 8
FANOUT = 4
SAMPLED = 1_024  # rows of a slice that set its cuts

_TINY = 1e-9  # parts rows with equal projections


def _projected(points: DataFrame, trees: int, levels: int, seed: int) -> DataFrame:
    """(key, tree, places array<double>): the row's place along each level's direction."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = None
        for batch in batches:
            column = batch.column("v")
            rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            if directions is None:
                directions = np.random.default_rng(seed).standard_normal((rows.shape[1], trees * levels))
            places = np.round(rows @ directions, SCORE_DIGITS).reshape(len(rows) * trees, levels)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(batch.column("key").to_numpy(), trees)),
                    pa.array(np.tile(np.arange(trees), len(rows))),
                    pa.array(list(places), pa.list_(pa.float64())),
                ],
                ["key", "tree", "places"],
            )

    return points.select("key", "v").mapInArrow(project, "key bigint, tree bigint, places array<double>")


def leaves(points: DataFrame, count: int, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = SEED) -> DataFrame:
    """(key, tree, node): the leaf of every row in every tree. ``count`` is the number of rows."""
    levels, held = 0, count
    while held > leaf_rows:
        levels, held = levels + 1, held / FANOUT
    placed = _projected(points, trees, max(levels, 1), seed).withColumn("node", F.lit(0).cast("bigint"))
    if not levels:
        return placed.select("key", "tree", "node")
    placed = staged_columns(placed, "projected")
    share = float(count)
    for level in range(levels):
        noise = F.pmod(F.xxhash64(F.lit(seed + level), "tree", "key"), F.lit(1 << 20)) * (_TINY / (1 << 20))
        placed = placed.withColumn("at", F.col("places")[level] + noise)
        # A fixed part of the rows, by hash: about SAMPLED of every slice.
        every = max(1, int(share / SAMPLED))
        drawn = placed.where(F.pmod(F.xxhash64(F.lit(seed - 1 - level), "tree", "key"), F.lit(every)) == 0)
        bounds = drawn.groupBy("tree", "node").agg(F.percentile("at", [k / FANOUT for k in range(1, FANOUT)]).alias("bounds"))
        joined = lookup_join(placed, bounds, ["tree", "node"], "left", spread_by="key")
        part = F.coalesce(F.size(F.filter("bounds", lambda b: b < F.col("at"))), F.lit(0))
        placed = staged_columns(joined.select("key", "tree", "places", (F.col("node") * FANOUT + part).alias("node")), "leaves")
        share /= FANOUT
    return placed.select("key", "tree", "node")


def nearest(
    points: DataFrame,
    k: int = NEIGHBOURS,
    trees: int = TREES,
    leaf_rows: int = LEAF_ROWS,
    seed: int = SEED,
) -> DataFrame:
    """(src, dst, d, place): up to ``k`` nearest other rows of every row by Euclidean distance, ties to the smaller key.

    ``points(key bigint, v array<double>)`` with distinct keys and vectors of one length. A row shuffles its vector
    once a tree.
    """
    count = points.count()
    meet = points.join(leaves(points, count, trees if count > leaf_rows else 1, leaf_rows, seed), "key")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key", ignore_index=True)
        keys, rows = group["key"].to_numpy(), np.stack(group["v"].to_numpy())
        found = []
        for start in range(0, len(rows), 256):
            part = rows[start : start + 256]
            gaps = np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in part]).round(SCORE_DIGITS)
            gaps[np.arange(len(part)), start + np.arange(len(part))] = np.inf
            best = np.argsort(gaps, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
            found.append(
                pd.DataFrame(
                    {
                        "src": np.repeat(keys[start : start + len(part)], best.shape[1]),
                        "dst": keys[best].ravel(),
                        "d": np.take_along_axis(gaps, best, axis=1).ravel(),
                    }
                )
            )
        return pd.concat(found)

    pairs = meet.groupBy("tree", "node").applyInPandas(compare, "src bigint, dst bigint, d double")
    merged = pairs.groupBy("src", "dst").agg(F.min("d").alias("d"))
    order = Window.partitionBy("src").orderBy("d", "dst")
    return merged.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
