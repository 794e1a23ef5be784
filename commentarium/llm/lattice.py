"""Near-duplicate vectors by E8 lattice hashing.

In every table a random projection takes the unit vector to eight dimensions,
scaled and shifted, where the nearest point of the E8 lattice is its cell. A vector
is filed under its own cell and under the neighbouring cells nearest to it, so two
vectors meet when any of these agree. Whatever meets is verified by cosine in
double precision.

A cell with many vectors is compared in blocks, every two blocks in a task, so no
cell is capped. A pair that meets in several cells counts in the smallest cell
they have in common. Tasks report counts and a forest of links per vector, not
pairs. Equal vectors are one point with a number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.llm.common import bounded_batches, components, grouped, mixed, odd_constants, plain, runs, written
from commentarium.operators.joins import join_on_content, lookup_join

COSINE = 0.95
TABLES = 8
PROBES = 3  # neighbouring cells a vector is filed under, besides its own
SCALE = 1.25  # multiplies the projection; larger: smaller cells
BLOCK = 1_024  # vectors of a cell compared with each other at once
SEED = 10


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            pairs.append(v)
    halves = [np.array(s) / 2 for s in product((1.0, -1.0), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point of every row: E8 is D8 together with D8 + 1/2."""

    def nearest_d8(y: np.ndarray) -> np.ndarray:
        whole = np.round(y)
        odd = np.flatnonzero(whole.sum(axis=1) % 2 != 0)
        gap = y[odd] - whole[odd]
        worst = np.abs(gap).argmax(axis=1)
        rows = np.arange(len(odd))
        whole[odd, worst] += np.where(gap[rows, worst] >= 0, 1.0, -1.0)
        return whole

    one, other = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    nearer = ((x - one) ** 2).sum(axis=1) <= ((x - other) ** 2).sum(axis=1)
    return np.where(nearer[:, None], one, other)


class Lattices:
    """The tables' projections; the same in every task."""

    def __init__(self, width: int, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.projections = draw.standard_normal((tables, width, 8)) * scale
        self.shifts = draw.random((tables, 8))
        self.probes, self.near = probes, _neighbours()
        self.factors, self.marks = odd_constants(8, seed=21), odd_constants(tables, seed=22)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """Cell numbers of every row, tables by 1 + probes."""
        out = []
        for t in range(len(self.shifts)):
            x = unit @ self.projections[t] + self.shifts[t]
            home = nearest_e8(x)
            # |x - home - v|^2 falls as (x - home) . v grows: all v have length sqrt(2).
            lean = (x - home) @ self.near.T
            first = np.argpartition(-lean, self.probes, axis=1)[:, : self.probes]
            points = np.concatenate([home[:, None, :], home[:, None, :] + self.near[first]], axis=1)
            codes = np.round(points * 2).astype(np.int64).view(np.uint64)
            out.append(mixed((codes * self.factors).sum(axis=2) + self.marks[t]))
        return np.stack(out, axis=1).view(np.int64)


def points_of(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, digest, unit binary, cells): unit vectors in double precision and their cells.

    All null for vectors that are null, empty, zero or hold null or non-finite
    components. Vectors of other widths have tables of their own.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Lattices] = {}
        for batch in batches:
            given = batch.column("vector").to_pylist()
            count = len(given)
            digests, units, cells = [None] * count, [None] * count, [None] * count
            by_width: dict[int, list[int]] = {}
            for i, v in enumerate(given):
                if v and None not in v:
                    by_width.setdefault(len(v), []).append(i)
            for width, rows in by_width.items():
                x = np.array([given[i] for i in rows], dtype=np.float64)
                with np.errstate(all="ignore"):
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                good = np.isfinite(unit).all(axis=1)
                unit = unit[good] + 0.0
                if width not in tables:
                    tables[width] = Lattices(width)
                for i, u, c in zip(np.array(rows)[good], unit, tables[width].cells(unit), strict=True):
                    units[i] = u.tobytes()
                    digests[i] = xxhash.xxh3_128_digest(units[i])
                    cells[i] = np.unique(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(units, pa.binary()), pa.array(cells, pa.list_(pa.int64()))],
                ["vec_id", "digest", "unit", "cells"],
            )

    bounded_batches(vectors.sparkSession, 2000)
    given = plain(vectors, vec_id=id_column, vector=vector_column).withColumn("vec_id", F.col("vec_id").cast("long"))
    return given.mapInArrow(make, "vec_id bigint, digest binary, unit binary, cells array<bigint>")


def _meeting_cells(points: DataFrame) -> DataFrame:
    """(cell, block, id): the cells that at least two points share, their points in blocks of ``BLOCK``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, at = None, None, 0
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for c, i in zip(batch.column("cell").to_pylist(), batch.column("id").to_pylist(), strict=True):
                if c != cell:
                    cell, held, at = c, i, 1
                    continue
                if held is not None:
                    out.append((c, 0, held))
                    held = None
                out.append((c, at // BLOCK, i))
                at += 1
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())],
                ["cell", "block", "id"],
            )

    rows = points.select("id", F.explode("cells").alias("cell"))
    return rows.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(meet, "cell bigint, block int, id bigint")


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (first, other) that tie together what a square link matrix ties together."""
    seen = np.zeros(len(links), dtype=bool)
    pairs = []
    for root in range(len(links)):
        if seen[root]:
            continue
        seen[root] = True
        frontier = np.array([root])
        while len(frontier):
            reached = links[frontier].any(axis=0) & ~seen
            seen |= reached
            frontier = np.flatnonzero(reached)
            pairs += [(root, int(i)) for i in frontier]
    return pairs


def _verify(units: DataFrame) -> DataFrame:
    """(id, n, src, dst) from ``units(cell, a, b, block, id, copies, unit, cells)``: counts of links and links, by task."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "cell", "a", "b"):
            cell, a, b = (group[k][0].as_py() for k in ("cell", "a", "b"))
            ids = group["id"].to_numpy()
            side = group["block"].to_numpy()
            copies = group["copies"].to_numpy()
            x = np.stack([np.frombuffer(u, dtype=np.float64) for u in group["unit"].to_pylist()])
            links = (x @ x.T) >= COSINE
            np.fill_diagonal(links, False)
            if a != b:
                links &= side[:, None] != side[None, :]
            if not links.any():
                continue
            # A pair belongs to the smallest cell that both are filed under.
            cells = group["cells"].to_pylist()
            one, other = np.nonzero(np.triu(links))
            before = [frozenset(c for c in own if c < cell) for own in cells]
            mine = np.fromiter((before[i].isdisjoint(before[j]) for i, j in zip(one.tolist(), other.tolist(), strict=True)), bool, len(one))
            n = np.bincount(one[mine], copies[other[mine]], len(ids)) + np.bincount(other[mine], copies[one[mine]], len(ids))
            some = np.flatnonzero(n)
            pairs = _forest(links)
            empty = [None] * len(pairs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[some].tolist() + empty, pa.int64()),
                    pa.array(n[some].astype(np.int64).tolist() + empty, pa.int64()),
                    pa.array([None] * len(some) + [ids[i] for i, _ in pairs], pa.int64()),
                    pa.array([None] * len(some) + [ids[i] for _, i in pairs], pa.int64()),
                ],
                ["id", "n", "src", "dst"],
            )

    wanted = units.select("cell", "a", "b", "block", "id", "copies", "unit", "cells")
    return grouped(wanted, "cell", "a", "b").mapInArrow(check, "id bigint, n bigint, src bigint, dst bigint")


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors that ``points_of`` cannot place have no links and are their own component.
    Rows that repeat an id are points of their own that count under that id; a row
    without an id links with nothing and has no component. Other columns are not
    looked at.
    """
    points = written(points_of(vectors, id_column, vector_column), "points")
    classes = written(
        points.where("digest IS NOT NULL AND vec_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")),
        "vector-classes",
    )
    heads = points.withColumnRenamed("vec_id", "id").join(classes, ["digest", "id"]).dropDuplicates(["digest"])
    heads = written(heads.select("id", "copies", "unit", "cells"), "vector-heads")
    meeting = written(_meeting_cells(heads), "meeting-cells")
    blocks = meeting.groupBy("cell").agg((F.max("block") + 1).alias("blocks")).where("blocks > 1")
    split = lookup_join(meeting, blocks, "cell", "left", spread_by="id").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    units = split.select("cell", "block", "id", other).select(
        "cell", "block", "id", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")
    )
    found = written(_verify(units.join(heads, "id")), "vector-links")
    counts = found.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    links = found.where("src IS NOT NULL").select("src", "dst").distinct()
    reached = components(links)
    named = classes.join(counts, "id", "left").join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "digest",
        "copies",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
    )
    out = join_on_content(points.select("vec_id", "digest"), written(named, "vectors-named"), "digest", "copies", spread_by="vec_id")
    placed = F.col("vec_id").isNotNull()
    component = F.when(placed, F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id",
        F.when(placed, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
