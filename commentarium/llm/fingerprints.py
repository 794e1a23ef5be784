"""One-permutation MinHash fingerprints of documents.

Every shingle hash is used once: its top bits choose a bin, the rest compete for
the bin's minimum. An empty bin takes the minimum of a filled bin chosen by
hashing (bin, attempt) until one is met, the same way for every document (optimal
densification). Of each minimum the low bits alone are stored, packed; the share
of equal bins is corrected for the chance 2^-bits that unequal minima agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.llm.common import WordHashes, bounded_batches, mixed, plain, shingle_hashes

BINS = 512
BITS = 4
_ATTEMPTS = 64


class Fingerprinter:
    """Makes and compares fingerprints; one per task."""

    def __init__(self, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two, bits 1, 2, 4 or 8.")
        self.bins, self.bits = bins, bits
        self.hashes = WordHashes()
        self.shift = np.uint64(64 - int(np.log2(bins)))
        grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(_ATTEMPTS) + np.arange(_ATTEMPTS, dtype=np.uint64)
        self.donors = (mixed(grid + np.uint64(0x51ED270B)) & np.uint64(bins - 1)).astype(np.int64)

    def of(self, text: str) -> bytes:
        """Packed low bits of every bin's minimum; empty for a text without words."""
        shingles = shingle_hashes(text.encode("utf-8"), self.hashes)
        if not len(shingles):
            return b""
        shingles.sort()
        bin_of = (shingles >> self.shift).astype(np.int64)
        first = np.concatenate([[True], bin_of[1:] != bin_of[:-1]])
        least = np.zeros(self.bins, dtype=np.uint64)
        filled = np.zeros(self.bins, dtype=bool)
        least[bin_of[first]] = shingles[first]
        filled[bin_of[first]] = True
        if not filled.all():
            least = self._densified(least, filled)
        low = (mixed(least) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        if self.bits == 8:
            return low.tobytes()
        per_byte = 8 // self.bits
        parts = low.reshape(-1, per_byte)
        packed = parts[:, 0].copy()
        for k in range(1, per_byte):
            packed |= parts[:, k] << np.uint8(k * self.bits)
        return packed.tobytes()

    def _densified(self, least: np.ndarray, filled: np.ndarray) -> np.ndarray:
        empty = np.flatnonzero(~filled)
        hits = filled[self.donors[empty]]
        choice = hits.argmax(axis=1)
        donor = self.donors[empty, choice]
        # Some bin is filled; the few whose draws all miss walk on to the next filled one.
        missed = ~hits[np.arange(len(empty)), choice]
        if missed.any():
            full = np.flatnonzero(filled)
            donor[missed] = full[np.searchsorted(full, donor[missed]) % len(full)]
        out = least.copy()
        out[empty] = least[donor]
        return out

    def likeness(self, one: bytes, other: bytes) -> float:
        """Estimated Jaccard likeness from 0 to 1; two empty fingerprints are alike, one is unlike any."""
        if not one or not other:
            return 1.0 if one == other else 0.0
        a, b = np.frombuffer(one, dtype=np.uint8), np.frombuffer(other, dtype=np.uint8)
        differ = a ^ b
        mask = np.uint8((1 << self.bits) - 1)
        equal = sum(int(np.count_nonzero((differ >> np.uint8(k)) & mask == 0)) for k in range(0, 8, self.bits))
        chance = 2.0**-self.bits
        return max(0.0, (equal / self.bins - chance) / (1.0 - chance))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first code points of the following one, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(docs: DataFrame, ranges: int) -> tuple[list[int], Column]:
    """Bounds that cut the ids into ranges of about equal count, and the range of ``doc_id`` as a column.

    The bounds are as many as the ranges, as in any sort by range; they decide the
    balance of the work only.
    """
    shares = [k / ranges for k in range(1, ranges)]
    if not shares:
        return [], F.lit(0)
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * ranges)).alias("b")).first()["b"]
    bounds = sorted(set(found or []))
    if not bounds:
        return [], F.lit(0)
    # Two looks instead of one per bound: every 64th bound first, then the 64 that follow it.
    coarse, fine = F.array(*map(F.lit, bounds[::64])), F.array(*map(F.lit, bounds))
    at = F.greatest(F.size(F.filter(coarse, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0)) * 64
    inside = F.filter(F.slice(fine, at + 1, F.lit(64)), lambda b: b <= F.col("doc_id"))
    return bounds, F.when(F.col("doc_id").isNull(), 0).otherwise(at + F.size(inside)).cast("int")


def fingerprints_with_neighbours(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    bins: int = BINS,
    bits: int = BITS,
    ranges: int | None = None,
    with_text: bool = True,
) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses; one row per row of ``docs``.

    The edited text ends in the beginning of the next row's, by ascending (id,
    text), nulls first; after the last comes the first. Null texts count as empty;
    one row is its own next. Columns: doc_id, n_chars, edited_text (null unless
    ``with_text``), edited_sha256, fingerprint, edited_fingerprint (binary),
    near_edited, near_next.

    Rows are dealt to ranges of ids and sorted there; each range also gets a copy of
    the next range's first row, so one pass over sorted rows sees every neighbour
    and texts are shuffled once.
    """
    spark = docs.sparkSession
    bounded_batches(spark, 500)
    given = plain(docs, doc_id=id_column, text=text_column)
    kind = given.schema["doc_id"].dataType.simpleString()
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    _, range_of = _ranges(given, ranges)
    dealt = given.withColumn("range", range_of)
    first_ids = dealt.groupBy("range").agg(F.min("doc_id").alias("doc_id"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    heads = sorted((r["range"], None if r["nulls"] else r["doc_id"]) for r in first_ids.collect())  # one per range
    if not heads:
        return spark.createDataFrame([], _columns(kind))
    before = {h[0]: heads[k - 1][0] for k, h in enumerate(heads)}
    wanted = spark.createDataFrame([(r, i, before[r]) for r, i in heads], f"range int, head {kind}, to int")
    copies = (
        dealt.join(F.broadcast(wanted), "range")
        .where(F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("to")
        .agg(F.min(F.struct(F.col("text").isNotNull().alias("n"), "text", "doc_id")).alias("h"))
        .select(F.col("to").alias("range"), F.col("h.doc_id").alias("doc_id"), F.col("h.text").alias("text"), F.lit(1).alias("copy"))
    )
    rows = dealt.withColumn("copy", F.lit(0)).unionByName(copies)
    in_order = rows.repartition("range").sortWithinPartitions("range", "copy", "doc_id", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        make = Fingerprinter(bins, bits)
        held = None  # the row whose next is not seen yet
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("range", "copy", "doc_id", "text")]
            for number, copy, doc_id, text in zip(*columns, strict=True):
                text = text or ""
                row = (number, doc_id, text, make.of(text))
                if held is not None and held[0] == number:
                    changed = edited(held[2], text)
                    mark = make.of(changed)
                    out.append((held[1], len(held[2]), changed if with_text else None, hashlib.sha256(changed.encode()).hexdigest(), held[3], mark,
                                make.likeness(held[3], mark), make.likeness(held[3], row[3])))
                held = None if copy else row
            names = ["doc_id", "n_chars", "edited_text", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            types = [batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
            values = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names)

    return in_order.mapInArrow(walk, _columns(kind))


def _columns(kind: str) -> str:
    return (
        f"doc_id {kind}, n_chars bigint, edited_text string, edited_sha256 string, fingerprint binary, "
        "edited_fingerprint binary, near_edited double, near_next double"
    )
