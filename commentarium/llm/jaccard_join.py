"""Exact Jaccard join of word-shingle sets in the Jaccard metric space.

Jaccard distance d = 1 - |A n B| / |A u B| is a metric, so pivots and the triangle
inequality bound it. Unrelated documents lie at distance 1 from every pivot,
though, where no window is narrow; so the join descends in three steps:

1. *Singleton pivots.* Under a random order of all shingles, a set's nearest
   singleton pivot {s} is its first shingle; five orders together give one Voronoi
   diagram, and its cells are regions. Two sets within 0.2 fall in one cell of a
   diagram with probability 0.8^5 at least, so 56 diagrams miss such a pair with
   probability (1 - 0.8^5)^56 < 3e-10: less than what 64-bit hashing risks over a
   corpus. Cells that share a set are joined to one region.
2. *Document pivots* split a region of more than ``REGION_SHINGLES`` by nearest
   pivot; documents within the window d(x, p) <= d(x, nearest) + 2 * 0.2 are copied
   to p's region too, so every link lies whole in some region. A pivot is compared
   with all of its region there and leaves; documents in its ball of radius 0.2 are
   linked to it and stay only where they may reach one outside the ball.
3. *In a task*, a bounded region is joined exactly by the same ball rule.

Equal sets are one class throughout, so thousands of copies are one point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.llm.common import (
    WordHashes,
    bounded_batches,
    components,
    grouped,
    mixed,
    odd_constants,
    plain,
    runs,
    shingle_hashes,
    texts_of,
    written,
)
from commentarium.operators.joins import fits_broadcast, join_on_content, lookup_join

PERCENT = 80
ORDERS, DIAGRAMS = 5, 56
FIRST_DIAGRAMS = 4  # their cells are joined first, so that close copies are one label in the others
REGION_SHINGLES = 2_000_000  # of a region joined in one task: 16 MB of hashes
PIVOTS = 16
ROUNDS = 4  # of document pivots, before what is still larger is compared in blocks
GROWTH = 2  # copies a document that a round may make; beyond it, pivots do not separate the region and blocks are cheaper
_EPS = 1.0 - PERCENT / 100.0
_SLACK = 1e-9


def _links(shared, one, other):
    """Whether two sets of the given sizes link, in whole numbers."""
    return 100 * shared >= PERCENT * (one + other - shared)


# Step 1 -------------------------------------------------------------------


def _signer():
    factors = (odd_constants(ORDERS * DIAGRAMS, seed=6) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    offsets = (odd_constants(ORDERS * DIAGRAMS, seed=7) >> np.uint64(29)).astype(np.uint32)
    weights = odd_constants(ORDERS, seed=8)
    diagrams = odd_constants(DIAGRAMS, seed=9)

    def cells(shingles: np.ndarray) -> np.ndarray:
        """The set's cell in every diagram."""
        points = (shingles >> np.uint64(32)).astype(np.uint32)
        first = np.full(ORDERS * DIAGRAMS, np.uint32(0xFFFFFFFF))
        for at in range(0, len(points), 4096):
            part = np.multiply.outer(factors, points[at : at + 4096])
            part += offsets[:, None]
            np.minimum(first, part.min(axis=1), out=first)
        grid = first.reshape(DIAGRAMS, ORDERS).astype(np.uint64)
        return mixed((mixed(grid) * weights).sum(axis=1) + diagrams).view(np.int64)

    return cells


def shingle_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, cells) of every row; no words: 0 shingles, no digest, no cells."""
    bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, cells_of = WordHashes(), _signer()
        for batch in batches:
            sizes, digests, cells = [], [], []
            for text in texts_of(batch.column("text")):
                found = np.unique(shingle_hashes(text, hashes))
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                cells.append(cells_of(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(cells, pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "digest", "cells"],
            )

    given = plain(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    return given.mapInArrow(sign, "doc_id bigint, n_shingles bigint, digest binary, cells array<bigint>")


def _shared_cells(points: DataFrame) -> DataFrame:
    """(src, dst): every id of ``points(id, cells)`` tied to the first id of each cell it shares."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, first = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column("cell").to_numpy()
            ids = batch.column("id").to_numpy()
            starts = np.concatenate([[cells[0] != cell], cells[1:] != cells[:-1]])
            leads = np.where(starts, ids, 0)
            at = np.maximum.accumulate(np.where(starts, np.arange(len(ids)), -1))
            src = np.where(at >= 0, leads[np.maximum(at, 0)], first if first is not None else 0)
            cell, first = cells[-1], src[-1]
            pairs = np.unique(np.stack([src, ids])[:, src != ids], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["src", "dst"])

    rows = points.select("id", F.explode("cells").alias("cell"))
    sorted_rows = rows.repartition("cell").sortWithinPartitions("cell", "id")
    return sorted_rows.mapInArrow(stars, "src bigint, dst bigint").distinct()


def cell_regions(points: DataFrame) -> DataFrame:
    """(id, region) of the points that share a cell with another, directly or by others.

    The first diagrams join close copies to one label each; in the other diagrams
    only labels meet, so a large group of copies is not tied together again and
    again.
    """
    first = F.slice("cells", 1, FIRST_DIAGRAMS)
    close = written(components(_shared_cells(points.select("id", first.alias("cells")))), "close")
    rest = F.slice("cells", FIRST_DIAGRAMS + 1, DIAGRAMS - FIRST_DIAGRAMS)
    labelled = points.join(close.withColumnRenamed("node", "id"), "id", "left")
    labels = labelled.select(F.coalesce("component", "id").alias("id"), rest.alias("cells"))
    wide = written(components(_shared_cells(labels)), "wide")
    up = wide.select(F.col("node").alias("label"), F.col("component").alias("region"))
    inner = close.select(F.col("node").alias("id"), F.col("component").alias("label"))
    outer = wide.select(F.col("node").alias("id"), F.col("component").alias("region")).join(inner.select("id"), "id", "left_anti")
    return inner.join(up, "label", "left").select("id", F.coalesce("region", "label").alias("region")).unionByName(outer)


# Step 3 -------------------------------------------------------------------


class _Region:
    """The shingle sets of a region under dense numbers, for fast distances to a pivot."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        _, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.marks = np.zeros(int(self.codes.max()) + 1, dtype=bool)

    def shared_with(self, pivot: int) -> np.ndarray:
        own = self.codes[self.starts[pivot] : self.starts[pivot] + self.sizes[pivot]]
        self.marks[own] = True
        shared = np.add.reduceat(self.marks[self.codes].astype(np.int64), self.starts)
        self.marks[own] = False
        return shared


def join_region(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs (pivot, member) whose closure is that of all links among ``sets`` (none empty)."""
    if len(sets) < 2:
        return []
    region, found = _Region(sets), []
    active = np.arange(len(sets))
    while len(active) > 1:
        pivot, rest = active[0], active[1:]
        if len(active) * 2 < len(region.sizes):  # drop the sets that are done with
            inner = join_region([sets[i] for i in active])
            return found + [(int(active[a]), int(active[b])) for a, b in inner]
        shared = region.shared_with(pivot)[rest]
        linked = _links(shared, region.sizes[rest], region.sizes[pivot])
        found += [(int(pivot), int(x)) for x in rest[linked]]
        if linked.all():
            break
        distance = 1.0 - shared / (region.sizes[rest] + region.sizes[pivot] - shared)
        near = distance >= distance[~linked].min() - _EPS - _SLACK
        active = rest[~linked | near]
    return found


def _least_reached(pairs: list[tuple[int, int]]) -> dict[int, int]:
    """For every id in ``pairs`` that reaches a smaller one: the smallest."""
    up: dict[int, int] = {}

    def top(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in up if top(i) != i}


def _join_in_tasks(members: DataFrame, *keys: str) -> DataFrame:
    """(src, dst): in each bounded group of ``members(*keys, id, shingles)``, the smallest id of a component and the others."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, *keys):
            ids = group["id"].to_pylist()
            pairs = join_region([np.frombuffer(b, dtype=np.uint64) for b in group["shingles"].to_pylist()])
            least = _least_reached([(ids[a], ids[b]) for a, b in pairs])
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(least.values()), pa.int64()), pa.array(list(least), pa.int64())], ["src", "dst"]
            )

    rows = members.select(*keys, "id", "shingles")
    return grouped(rows, *keys).mapInArrow(join, "src bigint, dst bigint")


# Step 2 -------------------------------------------------------------------


def _pivot_round(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One descent by document pivots of ``members(region, id, shingles)``: links, and (region, id) of the new regions."""
    draw = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PIVOTS))
    chosen = members.groupBy("region", draw.alias("n")).agg(F.min("id").alias("id")).select("region", "id")
    pivots = (
        members.join(chosen, ["region", "id"], "left_semi")
        .groupBy("region")
        .agg(F.collect_list(F.struct("id", "shingles")).alias("pivots"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "shingles", "pivots")), strict=True)
            for own, blob, given in rows:
                if any(p["id"] == own for p in given):
                    continue  # its links come from the other side; pivots among each other are below
                mine = np.frombuffer(blob, dtype=np.uint64)
                gaps = []
                for p in given:
                    theirs = np.frombuffer(p["shingles"], dtype=np.uint64)
                    shared = len(np.intersect1d(mine, theirs, assume_unique=True))
                    union = len(mine) + len(theirs) - shared
                    gaps.append((1.0 - shared / union, bool(_links(shared, len(mine), len(theirs))), p["id"]))
                near = min(g for g, _, _ in gaps)
                out += [(pivot, own, g, inner) for g, inner, pivot in gaps if inner or g <= near + 2 * _EPS + _SLACK]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)],
                ["region", "id", "gap", "inner"],
            )

    joined = lookup_join(members, pivots, "region", "inner", spread_by="id").select("id", "shingles", "pivots")
    placed = written(joined.mapInArrow(place, "region bigint, id bigint, gap double, inner boolean"), "placed")
    among = _join_in_tasks(pivots.select("region", F.explode("pivots").alias("p")).select("region", "p.*"), "region")
    links = placed.where("inner").select(F.col("region").alias("src"), F.col("id").alias("dst")).unionByName(among)
    edge = placed.where("NOT inner").groupBy("region").agg(F.min("gap").alias("edge"))
    stay = lookup_join(placed, edge, "region", "inner", spread_by="id").where(f"NOT inner OR gap >= edge - {_EPS + _SLACK}")
    return links, stay.select("region", "id").distinct()


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.sum(F.octet_length("shingles") / 8).alias("weight"))


def region_components(members: DataFrame, limit: int = REGION_SHINGLES) -> DataFrame:
    """(node, component): what ``members(region, id, shingles)`` reach by links, in regions of any size."""
    links: list[DataFrame] = []
    for _ in range(ROUNDS):
        sizes = written(_sizes(members), "region-sizes")
        large = sizes.where(F.col("weight") > limit).select("region")
        if not large.limit(1).count():
            links.append(_join_in_tasks(members, "region"))
            if len(links) == 1:  # every region was joined whole in one task: nothing is left to follow
                return links[0].select(F.col("dst").alias("node"), F.col("src").alias("component"))
            break
        small = lookup_join(members, large, "region", "left_anti", spread_by="id")
        links.append(_join_in_tasks(small, "region"))
        members = written(lookup_join(members, large, "region", "left_semi", spread_by="id"), "large-regions")
        found, deeper = _pivot_round(members)
        deeper = written(deeper, "deeper")
        if deeper.count() > GROWTH * members.count():
            links.append(_join_in_blocks(members, limit))
            break
        links.append(found)
        sets = members.select("id", "shingles").dropDuplicates(["id", "shingles"])
        members = written(deeper.join(sets, "id"), "regions")
    else:
        links.append(_join_in_blocks(members, limit))
    whole = links[0]
    for more in links[1:]:
        whole = whole.unionByName(more)
    return components(whole)


def _join_in_blocks(members: DataFrame, limit: int) -> DataFrame:
    """What pivots could not split: every two blocks of a region meet in one task of bounded size."""
    sizes = _sizes(members).select("region", F.ceil(F.col("weight") / (limit / 4)).cast("int").alias("blocks"))
    rows = lookup_join(members, sizes, "region", "inner", spread_by="id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "region", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id", "shingles"
    )
    return _join_in_tasks(rows, "region", "a", "b")


# The join -------------------------------------------------------------------


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", limit: int = REGION_SHINGLES
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    ``component_id`` is the smallest id reachable by links. Texts that are null or
    without words have 0 shingles and link with nothing; a row without an id has
    no component; rows that repeat an id are joined each by its own text, and texts
    that the same id represents count as linked. Other columns are not looked at.
    """
    given = plain(docs, doc_id=id_column, text=text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    sets = written(shingle_sets(given), "shingle-sets")
    classes = written(
        sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n")),
        "classes",
    )
    heads = classes.select("digest", F.col("id").alias("doc_id"))
    points = sets.join(heads, ["digest", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "cells")
    regions = written(cell_regions(written(points, "cells")), "regions")

    @F.pandas_udf("binary")
    def shingles(texts):
        import pandas as pd

        hashes = WordHashes(50_000)
        return pd.Series([np.unique(shingle_hashes((t or "").encode("utf-8"), hashes)).tobytes() for t in texts])

    wanted = F.broadcast(regions) if fits_broadcast(regions) else regions
    members = given.join(wanted.withColumnRenamed("id", "doc_id"), "doc_id")
    members = members.select("region", F.col("doc_id").alias("id"), shingles("text").alias("shingles")).where(F.octet_length("shingles") > 0)
    reached = region_components(written(members, "members"), limit)
    named = classes.join(reached.withColumnRenamed("node", "id"), "id", "left").select(
        "digest", "copies", F.coalesce("component", "id").alias("component_id")
    )
    # Most texts have no copy and no link; only the others need a look-up.
    out = join_on_content(sets.select("doc_id", "n_shingles", "digest"), written(named, "named"), "digest", "copies", spread_by="doc_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))
