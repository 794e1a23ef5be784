"""Places in the plane that keep neighbours: rows that are near as vectors stay near.

A bounded number of landmark rows, drawn by hash from all rows, is laid out as a whole: places are
moved until their likeness under a heavy-tailed kernel follows the likeness of the vectors
(van der Maaten & Hinton, 2008), starting from the two widest axes. Every other row starts at its
nearest landmark. Then, for a few rounds over the table of nearest neighbours of all rows, rows
are pulled to their neighbours and pushed by the landmarks, which stand for the rows around them and
stay where they are. A round shuffles ``k`` narrow links a row.

Up to ``landmarks`` rows all are landmarks. Draws and ties come from hashes of ids and places
are rounded, so the answer does not hang on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.functions.keys import SEED
from commentarium.functions.vectors import SCORE_DIGITS
from commentarium.operators.neighbours import NEIGHBOURS, nearest
from commentarium.operators.storage import staged_columns

LANDMARKS = 1_024
ROUNDS = 5
PLACE_DIGITS = 6

_EARLY, _LATE = 150, 350  # steps of the landmarks' layout; early ones pull harder, so that groups form
_EARLY_PULL = 12.0
_ROWS_AT_ONCE = 512

_PLACES = "key bigint, x double, y double, fixed boolean"


def _squared_gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T, 0.0).round(SCORE_DIGITS)


def _likeness(rows: np.ndarray, k: int) -> np.ndarray:
    """Symmetric weights of landmarks and their ``k`` nearest others, summing to 1: for a row, they fall with the
    squared distance beyond its nearest one, in units of the mean of that."""
    gaps = _squared_gaps(rows, rows)
    np.fill_diagonal(gaps, np.inf)
    at = np.argsort(gaps, axis=1, kind="stable")[:, :k]
    beyond = np.take_along_axis(gaps, at, axis=1)
    beyond = beyond - beyond[:, :1]
    unit = beyond.mean(axis=1, keepdims=True)
    weights = np.exp(-beyond / np.where(unit > 0, unit, 1.0))
    likeness = np.zeros_like(gaps)
    np.put_along_axis(likeness, at, weights / weights.sum(axis=1, keepdims=True), axis=1)
    return (likeness + likeness.T) / (2 * len(rows))


def _two_axes(rows: np.ndarray) -> np.ndarray:
    """The rows along their two widest axes, each with its greatest loading positive."""
    centred = rows - rows.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    peaks = np.abs(axes).argmax(axis=1)
    axes = axes * np.where(axes[np.arange(len(axes)), peaks] < 0, -1.0, 1.0)[:, None]
    places = np.zeros((len(rows), 2))
    places[:, : len(axes)] = centred @ axes.T
    return places


def lay_out(rows: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Places of a bounded number of rows, by gradient steps with momentum; one row is in the middle."""
    n = len(rows)
    if n < 2:
        return np.zeros((n, 2))
    likeness, places = _likeness(rows, min(k, n - 1)), _two_axes(rows)
    places *= 0.01 / max(float(places[:, 0].std()), 1e-12)
    step = np.zeros_like(places)
    for turn in range(_EARLY + _LATE):
        early = turn < _EARLY
        kernel = 1.0 / (1.0 + _squared_gaps(places, places))
        np.fill_diagonal(kernel, 0.0)
        force = (likeness * (_EARLY_PULL if early else 1.0) - kernel / kernel.sum()) * kernel
        slope = 4.0 * (force.sum(axis=1)[:, None] * places - force @ places)
        rate = max(n / 12.0, 20.0) if early else max(n / 4.0, 50.0)
        step = (0.5 if early else 0.8) * step - rate * slope
        places = places + step
        places -= places.mean(axis=0)
    return places.round(PLACE_DIGITS)


def _at_nearest(points: DataFrame, keys: np.ndarray, rows: np.ndarray, places: np.ndarray) -> DataFrame:
    """(key, x, y, fixed): landmarks at their places, other rows at that of the nearest landmark, ties to the smaller key."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("key").to_numpy()
            column = batch.column("v")
            given = column.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            found = [_squared_gaps(given[s : s + _ROWS_AT_ONCE], rows).argmin(axis=1) for s in range(0, len(own), _ROWS_AT_ONCE)]
            at = np.concatenate(found) if found else np.zeros(0, dtype=int)
            seat = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            fixed = keys[seat] == own
            at = np.where(fixed, seat, at)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(places[at, 0]), pa.array(places[at, 1]), pa.array(fixed)], ["key", "x", "y", "fixed"])

    return points.select("key", "v").mapInArrow(place, _PLACES)


def _links(near: DataFrame, keys: np.ndarray) -> DataFrame:
    """(src, dst, w): rows that are no landmarks and their neighbours, weights as among landmarks, 1 a row."""
    fixed = near.sparkSession.createDataFrame([(int(key),) for key in keys], "src bigint")  # as many rows as landmarks
    free = near.join(F.broadcast(fixed), "src", "left_anti")
    squared = F.col("d") * F.col("d")
    unit = F.aggregate("held", F.lit(0.0), lambda s, h: s + (h["q"] - F.col("held")[0]["q"])) / F.size("held")
    held = free.groupBy("src").agg(F.sort_array(F.collect_list(F.struct(squared.alias("q"), "dst"))).alias("held"))  # k at most
    beyond = held.withColumn("unit", F.when(unit > 0, unit).otherwise(1.0))
    weighed = beyond.withColumn("ws", F.transform("held", lambda h: F.exp((F.col("held")[0]["q"] - h["q"]) / F.col("unit"))))
    total = F.aggregate("ws", F.lit(0.0), lambda s, w: s + w)
    each = F.transform(F.arrays_zip("held", "ws"), lambda z: F.struct(z["held"]["dst"].alias("dst"), (z["ws"] / total).alias("w")))
    return weighed.select("src", F.explode(each).alias("e")).select("src", "e.dst", "e.w")


def _pull(axis: str) -> Column:
    def part(total: Column, n: Column) -> Column:
        dx, dy = n["x"] - F.col("x"), n["y"] - F.col("y")
        return total + n["w"] * (n[axis] - F.col(axis)) / (1.0 + dx * dx + dy * dy)

    return F.aggregate("near", F.lit(0.0), part)


def _moved(placed: DataFrame, links: DataFrame, landmarks: np.ndarray) -> DataFrame:
    """One round: ``placed`` (key, x, y, fixed) with all but the landmarks moved by pull and push."""
    ends = placed.select(F.col("key").alias("dst"), "x", "y")
    near = links.join(ends, "dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("w", "x", "y"))).alias("near"))  # k at most
    pulled = placed.join(near.withColumnRenamed("src", "key"), "key", "left")
    pulled = pulled.select("key", "x", "y", "fixed", *[F.coalesce(_pull(a), F.lit(0.0)).alias(f"pull_{a}") for a in ("x", "y")])

    def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pull = (np.stack([batch.column(c).to_numpy() for c in pair], axis=1) for pair in (("x", "y"), ("pull_x", "pull_y")))
            fixed, moved = batch.column("fixed").to_numpy(zero_copy_only=False), own.copy()
            for s in range(0, len(own), _ROWS_AT_ONCE):
                part = slice(s, s + _ROWS_AT_ONCE)
                kernel = 1.0 / (1.0 + _squared_gaps(own[part], landmarks))
                force = kernel * kernel / kernel.sum(axis=1, keepdims=True)
                away = force.sum(axis=1)[:, None] * own[part] - force @ landmarks
                moved[part] = (own[part] + pull[part] + away).round(PLACE_DIGITS)
            moved = np.where(fixed[:, None], own, moved)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(moved[:, 0]), pa.array(moved[:, 1]), batch.column("fixed")], ["key", "x", "y", "fixed"])

    return pulled.mapInArrow(push, _PLACES)


def neighbour_layout(
    df: DataFrame,
    features: str = "components",
    row_id: str = "row_id",
    k: int = NEIGHBOURS,
    landmarks: int = LANDMARKS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """(row_id, x, y): a place for every row, never null.

    Rows need distinct ids and vectors of one length; rows whose vector is null or holds null or
    non-finite parts are in the middle, (0, 0), and move no other row.
    """
    vector = F.col(features).cast("array<double>")
    finite = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    given = staged_columns(df.select(F.col(row_id), F.xxhash64(row_id).alias("key"), F.when(finite, vector).alias("v")), "points")
    points = given.where("v IS NOT NULL").select("key", "v")
    drawn = points.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(landmarks).collect()
    drawn.sort(key=lambda r: r["key"])
    if not drawn:
        return given.select(row_id, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    keys, rows = np.array([r["key"] for r in drawn], dtype=np.int64), np.array([r["v"] for r in drawn], dtype=float)
    places = lay_out(rows, k)
    placed = _at_nearest(points, keys, rows, places)
    if len(keys) == landmarks and rounds:
        links = staged_columns(_links(nearest(points, k, seed=seed), keys), "links")
        placed = staged_columns(placed, "placed")
        for _ in range(rounds):
            placed = staged_columns(_moved(placed, links, places), "placed")
    return given.select(row_id, "key").join(placed, "key", "left").select(
        row_id, F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")
    )


def kept_neighbours(points: DataFrame, places: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(key, n_kept): how many of a row's ``k`` nearest rows by ``points`` are among its ``k`` nearest by ``places``.

    Both are (key, v); ``nearest`` gives the neighbours.
    """
    near = nearest(points, k).select("src", "dst")
    both = near.join(nearest(places, k).select("src", "dst", F.lit(1).alias("kept")), ["src", "dst"], "left")
    return both.groupBy(F.col("src").alias("key")).agg(F.count("kept").alias("n_kept"))
