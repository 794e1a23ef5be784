"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the rows is never formed. A block Q of directions is multiplied by V in
one pass over the rows: every task centres its rows X, adds up Xᵀ(XQ) and sends one small
matrix, and the sums are merged. A Chebyshev polynomial of V, evaluated by its three-term
recurrence (one pass a degree), stays within [-1, 1] on the unwanted spectrum and grows steeply
above it, so the filtered block turns towards the wanted eigenvectors. Then QR makes
the block orthonormal, and Rayleigh-Ritz on its small projection gives eigenvalues and
vectors, with their residuals ||Vq - eq||. The passes go on until all wanted residuals are
at the level of rounding; a last pass over the rows measures the covariance of the
whitened rows against the identity.

Entries are fixed point: x = floor(64 c) + 1000000 as a whole number, so sums and deviations
are exact and do not hang on the order of rows. Only matrices of dimensions x block reach
the driver, however many rows there are.

Edges. Left out: null vectors, vectors with null or non-finite entries (an entry beyond 2^52
counts as such) and vectors of another length than the most frequent one (of equally
frequent ones the greater). Null ids stay; repeated rows count and are returned each. Extra columns
are ignored. Directions without variance have no whitened coordinate and are not returned, so
one row, or equal rows, give no result rows; so does an empty table. ``deviation`` is null where
it passes 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentarium.llm.common import plain, written

# Fixed values of the contract.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32

GUARD = 16  # directions beyond the wanted ones: the filter needs a gap
DEGREE = 10
CERTIFIED = 2e-14  # residual against the greatest eigenvalue
FLAT = 1e-13  # an eigenvalue below this share of the greatest is no variance
_LARGEST = float(1 << 52)
_ROWS = 4_096  # rows multiplied together


@dataclass(frozen=True)
class Spectrum:
    """Eigenpairs of the covariance: ``vectors`` has one column each."""

    rows: int
    sums: np.ndarray  # whole numbers
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float  # greatest of the wanted pairs, against the greatest eigenvalue
    passes: int


def fixed_point(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(row_id, x array<bigint>) of the rows that take part."""
    taken = plain(df, row_id=row_id, v=vector)
    usable = F.forall("v", lambda c: F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False)))
    taken = taken.where(F.col("v").isNotNull() & (F.size("v") > 0) & usable)
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))
    points = written(taken.select("row_id", x.alias("x")), "points")
    widths = points.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n"))
    common = widths.orderBy(F.desc("n"), F.desc("width")).limit(2).collect()
    return points.where(F.size("x") == common[0]["width"]) if len(common) > 1 else points


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of batches with their whole numbers as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            column = part.column("x")
            yield part, column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n: the numerator n*x - S is a whole number, exact unless it passes 64 bits."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61:
        return (n * x - sums) / n
    return x - sums / n


def _totals(points: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, exact sum of every dimension)."""

    def add(batches):
        n, sums = 0, None
        for _, x in _blocks(batches):
            n += len(x)
            part = x.sum(axis=0)
            sums = part if sums is None else sums + part
        if n:
            table = np.append(n, sums)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(table)), pa.int64()), pa.array(table)], ["d", "s"])

    found = points.select("x").mapInArrow(add, "d bigint, s bigint").groupBy("d").agg(F.sum("s").alias("s")).orderBy("d").collect()
    table = np.array([r["s"] for r in found], dtype=np.int64)
    return (int(table[0]), table[1:]) if len(table) else (0, table)


def _summed(points: DataFrame, product) -> np.ndarray:
    """The sum over all tasks of the matrix that ``product`` makes of a task's centred blocks, row by row."""

    def add(batches):
        total = None
        for _, x in _blocks(batches):
            part = product(x)
            total = part if total is None else total + part
        if total is not None:
            rows = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), rows], ["i", "v"])

    merged = points.select("x").mapInArrow(add, "i bigint, v array<double>").groupBy("i")
    found = merged.agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).orderBy("i").collect()
    return np.array([r["v"] for r in found])


class _Covariance:
    """Products of the covariance with a block of directions, one pass over the rows each."""

    def __init__(self, points: DataFrame, n: int, sums: np.ndarray):
        self.points, self.n, self.sums, self.passes = points, n, sums, 0

    def trace(self) -> float:
        n, sums = self.n, self.sums

        def squares(x):
            z = _centred(x, n, sums)
            return np.array([[(z * z).sum()]])

        return float(_summed(self.points, squares)[0, 0]) / n

    def __matmul__(self, block: np.ndarray) -> np.ndarray:
        n, sums = self.n, self.sums

        def product(x):
            z = _centred(x, n, sums)
            return z.T @ (z @ block)

        self.passes += 1
        return _summed(self.points, product) / n


def _filtered(v: _Covariance, block: np.ndarray, image: np.ndarray, unwanted: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of degree ``DEGREE`` on [0, unwanted] applied to ``block``; ``image`` is V block.

    Scaled so that it is about 1 at ``top`` (Zhou & Saad, 2007).
    """
    half = unwanted / 2
    scale = half / (half - top)
    ratio = scale
    now, before = (image - half * block) * (ratio / half), block
    for _ in range(DEGREE - 1):
        after = 1.0 / (2.0 / scale - ratio)
        now, before = (v @ now - half * now) * (2.0 * after / half) - before * (ratio * after), now
        ratio = after
    return now


def spectrum(points: DataFrame, components: int = COMPONENTS, guard: int = GUARD, seed: int = 11) -> Spectrum | None:
    """The greatest eigenpairs of the rows' covariance (divisor: number of rows); None without rows."""
    n, sums = _totals(points)
    if not n:
        return None
    v = _Covariance(points, n, sums)
    trace = v.trace()
    width = len(sums)
    wanted = min(components, width)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, wanted + guard))))[0]
    if trace <= 0:
        return Spectrum(n, sums, 0.0, np.zeros(0), np.zeros((width, 0)), 0.0, v.passes)
    best = None
    stalled = 0
    while True:
        image = v @ block
        values, turn = np.linalg.eigh((block.T @ image + image.T @ block) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        gaps = np.linalg.norm(image - block * values, axis=0)[:wanted]
        residual = float(gaps.max() / values[0])
        if best is None or residual < best.residual:
            stalled = 0 if best is None or residual < best.residual / 2 else stalled + 1
            kept = values[:wanted] > FLAT * values[0]
            best = Spectrum(n, sums, trace, values[:wanted][kept], block[:, :wanted][:, kept], residual, v.passes)
        else:
            stalled += 1
        # Rounding sets the floor of the residuals: two rounds that no longer halve them have met it.
        if residual <= CERTIFIED or (stalled >= 2 and best.residual <= 1e-9):
            return best
        unwanted = float(values[-1])
        if unwanted > FLAT * values[0] and unwanted < values[0]:
            block = _filtered(v, block, image, unwanted, float(values[0]))
        else:
            block = image  # all that is left out has no variance: one multiplication removes it
        block = np.linalg.qr(block)[0]


def whiten(points: DataFrame, found: Spectrum) -> DataFrame:
    """(row_id, n, deviation, whitened array<double>): every row's coordinates, one per eigenpair.

    ``deviation`` is the exact sum of (n*x - S)^2 over the dimensions.
    """
    n, sums = found.rows, found.sums
    project = found.vectors / np.sqrt(found.values)

    def add(batches):
        for part, x in _blocks(batches):
            bound = n * (int(np.abs(x).max(initial=0)) + 1)
            if bound < 1 << 61 and int(np.abs(n * x - sums).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
                gap = n * x - sums
                exact = (gap * gap).sum(axis=1).tolist()
            else:
                gap = n * x.astype(object) - sums.astype(object)
                exact = [e if e < 1 << 63 else None for e in (gap * gap).sum(axis=1).tolist()]
            rows = list(_centred(x, n, sums) @ project)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row_id"),
                    pa.array([n] * len(x), pa.int64()),
                    pa.array(exact, pa.int64()),
                    pa.array(rows, pa.list_(pa.float64())),
                ],
                ["row_id", "n", "deviation", "whitened"],
            )

    fields = [points.schema["row_id"], *T._parse_datatype_string("n bigint, deviation bigint, whitened array<double>").fields]
    return points.mapInArrow(add, T.StructType(fields))


def identity_error(points: DataFrame, found: Spectrum) -> float:
    """The greatest entry, in size, of the whitened rows' covariance minus the identity; one pass."""
    n, sums = found.rows, found.sums
    project = found.vectors / np.sqrt(found.values)
    if not project.shape[1]:
        return 0.0

    def product(x):
        w = _centred(x, n, sums) @ project
        return np.vstack([w.T @ w, w.sum(axis=0)])  # the last row: sums, for the means

    total = _summed(points, product) / n
    covariance = total[:-1] - np.outer(total[-1], total[-1])
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whitened_components(df: DataFrame, row_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error, residual)."""
    points = fixed_point(df, row_id, vector)
    found = spectrum(points, components)
    if found is None:
        found = Spectrum(0, np.zeros(0, dtype=np.int64), 0.0, np.zeros(0), np.zeros((0, 0)), 0.0, 0)
        rows = whiten(points.limit(0), found)
        error = 0.0
    else:
        rows, error = whiten(points, found), identity_error(points, found)
    share = F.lit([float(e / found.trace) for e in found.values]).cast("array<double>")
    listed = rows.select("*", F.posexplode("whitened").alias("at", "value"))
    return listed.select(
        F.col("row_id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("value").alias("whitened"),
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.lit(found.residual).alias("residual"),
    )
