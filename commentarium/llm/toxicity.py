"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each counted once: its words, its words' beginnings, pairs of
neighbouring words, and pairs with one or two words between (skip-grams), hashed
to 2^20 coordinates. FTRL-proximal gives every coordinate its own learning rate,
and its L1 term leaves most weights at exactly zero, so the model is a few thousand
(coordinate, weight) pairs: at most 2^20 of them, 8 MB, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentarium.llm.common import bounded_batches, mixed, odd_constants, plain, set_aside, texts_of, written

COORDINATES_LOG2 = 20
ROWS_PER_CLASS = 6_000  # bound of the training sample: of each class, those first by hash of their id
EPOCHS = 5
ALPHA, BETA, L2 = 1.0, 1.0, 1.0
L1_LEAST, L1_NOISE = 1.0, 0.2  # L1 is the least plus this times the root of the number of rows: what chance adds up to
TOXIC_WEIGHT = 3.0  # of a toxic row's gradient; toxic rows are few
THRESHOLD = 0.7
_BIAS = 1 << COORDINATES_LOG2  # the coordinate after the hashed ones
_EDGES = b".,;:!?\"'()[]{}<>-_*`"
_BEGINNING = 5


class _Hashes(dict):
    """Hashes of lower-cased words without punctuation at their ends, remembered up to a bound."""

    def __init__(self, letters: int | None, limit: int = 200_000):
        super().__init__()
        self.letters, self.limit = letters, limit

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(_EDGES)
        if self.letters is not None:
            bare = b"^" + bare.decode("utf-8", "replace")[: self.letters].encode("utf-8")
        value = xxhash.xxh3_64_intdigest(bare)
        if len(self) < self.limit:
            self[word] = value
        return value


class Features:
    """Hashed coordinates of texts; one per task."""

    def __init__(self):
        self.words, self.beginnings = _Hashes(None), _Hashes(_BEGINNING)
        self.factors = odd_constants(8, seed=11)

    def of(self, text: bytes) -> np.ndarray:
        """Coordinates, with repeats."""
        words = text.lower().split()
        count = len(words)
        w = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=count)
        parts = [w, np.fromiter(map(self.beginnings.__getitem__, words), dtype=np.uint64, count=count)]
        for gap in (1, 2, 3):
            if count > gap:
                parts.append(mixed(w[:-gap] * self.factors[2 * gap] + w[gap:] * self.factors[2 * gap + 1]))
        return (np.concatenate(parts) >> np.uint64(64 - COORDINATES_LOG2)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for about ``rows`` rows: per-coordinate rates, L1 and L2; L1 spares the bias."""

    def __init__(self, rows: int):
        self.z = np.zeros(_BIAS + 1)
        self.n = np.zeros(_BIAS + 1)
        self.l1 = L1_LEAST + L1_NOISE * np.sqrt(rows)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == _BIAS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row; ``at`` holds distinct coordinates, the bias among them."""
        w = self.weights(at)
        gradient = (TOXIC_WEIGHT if label else 1.0) * (sigmoid(w.sum()) - label)
        n = self.n[at]
        more = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(more) - np.sqrt(n)) / ALPHA * w
        self.n[at] = more


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero coordinates and weights, learned from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The sample is bounded by ``rows_per_class`` rows of each class, chosen and ordered
    by a hash of the id, so the fit is the same every time. Null ids and labels
    do not take part; an id with several labels takes the highest; without rows the
    model is empty.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    wanted = (
        plain(labels, doc_id="doc_id", toxic="toxic")
        .where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .withColumn("turn", F.xxhash64("doc_id", F.lit(9)))
        .join(plain(docs, doc_id="doc_id").distinct(), "doc_id", "left_semi")
    )
    sample = wanted.where("toxic = 1").orderBy("turn", "doc_id").limit(rows_per_class)
    sample = sample.unionByName(wanted.where("toxic = 0").orderBy("turn", "doc_id").limit(rows_per_class))
    rows = plain(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id")  # bounded: 2 * rows_per_class

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [np.unique(features.of(t)).astype(np.int32).tobytes() for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("toxic"), pa.array(found, pa.binary())], ["turn", "toxic", "at"]
            )

    seen = written(rows.select("text", "turn", "toxic").mapInArrow(extract, "turn bigint, toxic int, at binary"), "features")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, int]] = []
        for batch in batches:
            held += zip(batch.column("at").to_pylist(), batch.column("toxic").to_pylist(), strict=True)
        model = Ftrl(len(held))
        for _ in range(EPOCHS if held else 0):
            for blob, label in held:
                model.learn(np.append(np.frombuffer(blob, dtype=np.int32).astype(np.int64), _BIAS), label)
        weights = model.weights(np.arange(_BIAS + 1))
        at = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(weights[at])], ["at", "weight"])

    # One learner on a bounded sample: FTRL takes its rows in turn.
    model = seen.repartition(1).sortWithinPartitions("turn", "at").mapInArrow(train, "at bigint, weight double").collect()
    return np.array([r["at"] for r in model], dtype=np.int64), np.array([r["weight"] for r in model])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text_column: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with ``into double``: from 0 to 1, higher where toxic is likelier.

    Whole texts; null and empty ones get the model's bias alone. All other columns
    stay (one named ``into`` is replaced).
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(into)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weights = shared.value
        table = np.zeros(_BIAS + 1)
        table[at] = weights
        features = Features()
        for batch in batches:
            sums = []
            for text in texts_of(batch.column(text_column)):
                here = features.of(text)
                here = np.unique(here[table[here] != 0.0])
                sums.append(table[here].sum() + table[_BIAS])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sigmoid(np.array(sums, dtype=float)))], [*batch.schema.names, into]
            )

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; learned from the labelled rows not held out."""
    model = fit(docs, labels.where(~held_out()))
    scored = score(docs.drop("held_out", "predicted"), model)
    return scored.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not find toxic, with the columns of ``docs``, whatever their names.

    Each row is judged by its own text, so rows that repeat an id may part; texts
    that are null or empty get the bias alone.
    """
    kept = classify(set_aside(docs, "doc_id", "text"), labels, threshold).where("predicted = 0")
    return kept.drop("score", "held_out", "predicted").toDF(*docs.columns)
