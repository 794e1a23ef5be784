"""Concept search: cosine of every row to a phrase vector, and the best rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentarium.functions.keys import content_hash
from commentarium.functions.vectors import SCORE_DIGITS, cosine_to
from commentarium.operators.storage import cut_lineage

# Fixed values.
TOP_N = 5
DEFAULT_CONCEPT = "precio valor costo"
PREVIEW_CHARS = 200
CONCEPT_BLOCK = 1_000


def add_similarity(
    df: DataFrame, concept: Sequence[float], vector: str = "embedding", out: str = "concept_similarity"
) -> DataFrame:
    """The concept vector is a literal: a projection, no join. Empty frames keep the column."""
    return df.withColumn(out, cosine_to(F.col(vector), concept))


def top_per_concept(
    df: DataFrame,
    concepts: DataFrame,
    n: int = TOP_N,
    vector: str = "embedding",
    row_id: str = "row_id",
    block: int = CONCEPT_BLOCK,
) -> DataFrame:
    """(concept, row_id, concept_similarity, place): the ``n`` best rows of every row of ``concepts(concept, target)``.

    Concepts come as a table of any length and go through the data in blocks of
    ``block``, one scan each. A task scores its rows against a block by matrix products and
    keeps ``n`` rows a concept, so no pair with a vector is ever made. Ties go
    to the lower row. Rows and concepts without a vector do not take part.
    """
    numbered = concepts.where(F.col("target").isNotNull()).select("concept", F.col("target").cast("array<double>")).orderBy("concept")
    kind = df.schema[row_id].dataType.simpleString()
    rows = df.where(F.col(vector).isNotNull()).select(row_id, F.col(vector).cast("array<double>").alias("v"))
    schema = f"concept string, {row_id} {kind}, concept_similarity double"
    parts = []
    held: list = []

    def scan(block_rows: list) -> DataFrame:
        names = [r["concept"] for r in block_rows]
        targets = np.array([r["target"] for r in block_rows])
        lengths = np.sqrt((targets * targets).sum(axis=1, keepdims=True))
        targets = targets / np.where(lengths > 0, lengths, 1.0)

        def best(batches):
            kept: list[list[tuple[float, object]]] = [[] for _ in names]
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(row_id).to_pylist()
                x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
                scores = np.round((x / np.where(norms > 0, norms, 1.0)) @ targets.T, SCORE_DIGITS)
                for c in range(len(names)):
                    column = scores[:, c]
                    floor = np.partition(column, -n)[-n] if len(column) > n else -np.inf
                    some = [(float(column[k]), ids[k]) for k in np.flatnonzero(column >= floor)]
                    kept[c] = sorted(kept[c] + some, key=lambda t: (-t[0], t[1]))[:n]
            out = [(names[c], i, s) for c in range(len(names)) for s, i in kept[c]]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                ["concept", row_id, "concept_similarity"],
            )

        return rows.withColumn(row_id, F.col(row_id).cast("bigint")).mapInArrow(best, schema.replace(f"{row_id} {kind}", f"{row_id} bigint"))

    for r in numbered.toLocalIterator():  # a block of concepts at a time
        held.append(r)
        if len(held) == block:
            parts.append(scan(held))
            held = []
    if held or not parts:
        parts.append(scan(held) if held else df.sparkSession.createDataFrame([], schema))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("concept").orderBy(F.desc("concept_similarity"), row_id)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def top_similar(df: DataFrame, n: int = TOP_N, score: str = "concept_similarity", row_id: str = "row_id") -> DataFrame:
    """The ``n`` best rows, ties by row; fewer when there are fewer. No full sort."""
    return df.orderBy(F.desc(score), row_id).limit(n)


def top_similar_texts(
    df: DataFrame,
    n: int = TOP_N,
    text: str = "clean_text",
    score: str = "concept_similarity",
    row_id: str = "row_id",
    carry: Sequence[str] = ("sentiment",),
    preview: int = PREVIEW_CHARS,
) -> DataFrame:
    """The ``n`` best among distinct texts; the first row speaks for its copies.

    Copies meet on the text's hash, with numbers alone: a text held by a third of
    all rows is one line per map task. Only the ``n`` winners fetch their text.
    """
    first = df.groupBy(content_hash(F.col(text)).alias("_h")).agg(
        F.min(row_id).alias(row_id), F.min_by(score, row_id).alias(score)
    )
    winners = cut_lineage(first.orderBy(F.desc(score), row_id).limit(n).select(row_id))
    kept = df.select(row_id, text, score, *carry).join(F.broadcast(winners), row_id, "left_semi")
    return kept.orderBy(F.desc(score), row_id).withColumn(text, F.substring(text, 1, preview))


def similarity_spread(df: DataFrame, score: str = "concept_similarity") -> DataFrame:
    return df.agg(
        F.count(score).alias("n"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("std"),
    )
