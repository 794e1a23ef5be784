"""Connected components: by repeated minimum-label joins, and of many graphs at once by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.operators.storage import staged_columns

ONE_TASK_EDGES = 200_000  # so many edges are joined by one task


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component.

    ``nodes(node)`` and ``edges(src, dst)``, in either direction or both. Each
    round takes the least label among neighbours, then jumps to that label's own
    label, so paths halve and the rounds are logarithmic. Every round is written
    to the shared folder, which keeps plans short and survives lost executors. Rounds read
    files, whose sizes are known: a checkpoint would keep Spark's estimate of the joins' size,
    a number that gets three times as many digits each round and fills the driver.
    """
    both = staged_columns(
        edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(),
        "edges",
    )
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    while True:
        seen = (
            both.join(labels.select(F.col("node").alias("dst"), F.col("component").alias("near")), "dst")
            .groupBy(F.col("src").alias("node"))
            .agg(F.min("near").alias("near"))
        )
        stepped = labels.join(seen, "node", "left").select(
            "node", "component", F.least("component", F.coalesce("near", "component")).alias("best")
        )
        jump = labels.select(F.col("node").alias("best"), F.col("component").alias("far"))
        stepped = staged_columns(
            stepped.join(jump, "best", "left").select(
                "node", "component", F.least("best", F.coalesce("far", "best")).alias("next")
            ),
            "components",
        )
        changed = stepped.where(F.col("next") != F.col("component")).limit(1).count()
        labels = stepped.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, node, to) of all ends of a few edges (level, src, dst): ``to`` is the least node that the node reaches at its level."""
    tables = [[batch.column(c).to_numpy() for c in ("level", "src", "dst")] for batch in batches if batch.num_rows]
    if not tables:
        return
    level, src, dst = (np.concatenate(c) for c in zip(*tables, strict=True))
    ends = np.empty(2 * len(level), dtype=[("level", np.int32), ("node", np.int64)])
    ends["level"], ends["node"] = np.tile(level, 2), np.concatenate([src, dst])
    nodes, place = np.unique(ends, return_inverse=True)
    up = list(range(len(nodes)))

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for one, other in zip(place[: len(level)].tolist(), place[len(level) :].tolist(), strict=True):
        one, other = top(one), top(other)
        up[max(one, other)] = min(one, other)
    to = nodes["node"][[top(k) for k in range(len(nodes))]]
    yield pa.RecordBatch.from_arrays([pa.array(nodes["level"]), pa.array(nodes["node"]), pa.array(to)], ["level", "node", "to"])


def joined_ends(edges: DataFrame) -> DataFrame:
    """(level, node, to): for every end of ``edges(level int, src bigint, dst bigint)`` one node that stands for its component at that level.

    Every round each node joins the neighbour (or itself) that comes first in a fresh random order. What was
    joined is left, edges within it vanish, and the graph shrinks by about half whatever its shape, so
    all rounds together move a few times the edges. ``ONE_TASK_EDGES`` or fewer are joined in one task. The rounds' maps are then
    followed from the last to the first. Levels do not touch each other.
    """
    left = staged_columns(edges.select("level", "src", "dst"), "edges")
    maps: list[DataFrame] = []
    while left.count() > ONE_TASK_EDGES:
        both = left.select("level", F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
            left.select("level", F.col("dst").alias("node"), F.col("src").alias("other"))
        )
        turn, own = (F.xxhash64(F.lit(len(maps)), "level", c) for c in ("other", "node"))
        best = both.groupBy("level", "node").agg(F.min_by("other", turn).alias("other"), F.min(turn).alias("turn"))
        maps.append(staged_columns(best.select("level", "node", F.when(F.col("turn") < own, F.col("other")).otherwise(F.col("node")).alias("to")), "joined"))
        a, b = (maps[-1].select("level", F.col("node").alias(end), F.col("to").alias(f"{end}_to")) for end in ("src", "dst"))
        moved = left.join(a, ["level", "src"]).join(b, ["level", "dst"]).where("src_to <> dst_to")
        ends = F.least("src_to", "dst_to").alias("src"), F.greatest("src_to", "dst_to").alias("dst")
        left = staged_columns(moved.select("level", *ends).distinct(), "edges")
    found = staged_columns(left.coalesce(1).mapInArrow(_joined, "level int, node bigint, to bigint"), "ends")
    for earlier in reversed(maps):
        later = found.select("level", F.col("node").alias("to"), F.col("to").alias("end"))
        found = staged_columns(earlier.join(later, ["level", "to"], "left").select("level", "node", F.coalesce("end", "to").alias("to")), "ends")
    return found
