"""CSV records of large files whose quoted fields hold line breaks, read by many tasks a file.

A line break ends a record only outside quotes, and whether a split starts inside quotes
depends on all splits before it. Two passes over the lines settle that:

1. Every split is reduced to two booleans: is its end inside quotes if its start is outside, and
   if its start is inside. Such maps compose, so a prefix scan over a file's splits (one short
   row each) gives the true state at every start.
2. Every split cuts its lines into records. What opens before a split, or stays open after it,
   is a fragment; fragments of one record, at most two a split, are joined by position.

Records are written to the shared folder once. Nothing but fragments is shuffled. Line ends are
``\\n`` or ``\\r\\n``; the encoding must keep ASCII bytes (any but UTF-16 and UTF-32).
Odd input: an empty file gives no record; empty lines outside quotes are skipped; a quote
inside an unquoted field is a plain character; text after a closing quote belongs to
the field up to the next comma, as in Spark's reader; a quote that is never closed makes the
rest of the file one record, which one task then has to hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from commentarium.operators.joins import fits_broadcast
from commentarium.operators.storage import cut_lineage, staged_columns

WHOLE, OPENED, CONTINUED = 0, 1, 2  # a record's kind; the last two are fragments
BATCH_BYTES = 8 * 1024 * 1024

_MARKS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("from_outside", T.BooleanType()),
        T.StructField("from_inside", T.BooleanType()),
        T.StructField("is_utf8", T.BooleanType()),
    ]
)
_PIECES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("kind", T.IntegerType()),
        T.StructField("is_utf8", T.BooleanType()),
        T.StructField("record", T.BinaryType()),
    ]
)


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether the end of a line is inside quotes, given its start (a field's start if outside)."""
    at = 0
    if not inside:
        if not line.startswith(b'"'):
            at = line.find(b',"') + 1
            if not at:
                return False
        at += 1
    while True:
        quote = line.find(b'"', at)
        if quote < 0:
            return True
        if line[quote + 1 : quote + 2] == b'"':
            at = quote + 2
            continue
        opening = line.find(b',"', quote + 1)
        if opening < 0:
            return False
        at = opening + 2


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, n, line): lines without ``\\n``; ``n`` orders the lines of one split."""
    return spark.read.option("lineSep", "\n").text(path if isinstance(path, str) else list(path)).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").cast("binary").alias("line"),
        F.is_valid_utf8("value").alias("ok"),
    )


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    marks = []
    for (file, start), lines in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
        outside, inside, utf8 = False, True, True
        for _, _, line, ok in lines:
            utf8 = utf8 and ok
            if line is not None:
                outside, inside = ends_inside(line, outside), ends_inside(line, inside)
        marks.append((file, start, outside, inside, utf8))
    if marks:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*marks)], names=_MARKS.fieldNames())


def split_states(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, inside, is_utf8): per split, whether it starts inside quotes; per file, if it is UTF-8."""
    lines = _lines(spark, path)
    quoted = F.when(F.contains("line", F.lit(b'"')), F.col("line"))  # other lines change nothing
    marks = lines.select("file", "start", quoted.alias("line"), "ok").mapInArrow(_mark, _MARKS)
    place = Window.partitionBy("file").orderBy("start")
    through, before = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(Window.unboundedPreceding, -1)
    # A split swaps the state, keeps it or fixes it: the last fixed state, turned by the swaps since.
    swap = (F.col("from_outside") & ~F.col("from_inside")).cast("int")
    fixed = F.when(F.col("from_outside") == F.col("from_inside"), F.col("from_outside").cast("int"))
    scanned = marks.withColumn("turned", (fixed + F.sum(swap).over(through)) % 2)
    since = F.coalesce(F.last("turned", ignorenulls=True).over(before), F.lit(0))
    inside = (since + F.coalesce(F.sum(swap).over(before), F.lit(0))) % 2 == 1
    return scanned.select(
        "file", "start", inside.alias("inside"), F.min("is_utf8").over(Window.partitionBy("file")).alias("is_utf8")
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, kind) for c, kind in zip(zip(*held), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=_PIECES.fieldNames())

    for (file, start), lines in groupby(_rows(batches), key=lambda r: (r[0], r[1])):
        parts, n, kind, inside = [], 0, WHOLE, None
        for _, _, first_inside, utf8, line in lines:
            if inside is None:
                inside, kind = first_inside, CONTINUED if first_inside else WHOLE
            if not inside and line in (b"", b"\r"):
                continue
            parts.append(line)
            inside = ends_inside(line, inside)
            if inside:
                continue
            record = b"\n".join(parts)
            held.append((file, start, n, kind, utf8, record))
            parts, n, kind, size = [], n + 1, WHOLE, size + len(record)
            if size >= BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if parts:
            record = b"\n".join(parts)
            held.append((file, start, n, CONTINUED if kind == CONTINUED else OPENED, utf8, record))
            size += len(record)
    if held:
        yield batch()


def records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, start, n, is_utf8, record): each record of each file once, placed by (start, n).

    ``record`` holds the bytes without the final line end. The states are one row a split; should
    they outgrow a broadcast, lines are shuffled by split, which no file's size can make uneven.
    """
    states = cut_lineage(split_states(spark, path))
    lines = _lines(spark, path)
    if fits_broadcast(states):
        placed = lines.join(F.broadcast(states), ["file", "start"])
    else:
        placed = lines.join(states.hint("shuffle_hash"), ["file", "start"])
        placed = placed.repartition("file", "start").sortWithinPartitions("file", "start", "n")
    cut = placed.select("file", "start", "inside", "is_utf8", "line").mapInArrow(_cut, _PIECES)
    pieces = staged_columns(cut, "records")
    whole = pieces.where(F.col("kind") == WHOLE).drop("kind")
    order = Window.partitionBy("file").orderBy("start", "n")
    opening = F.when(F.col("kind") == OPENED, F.struct("start", "n"))
    places = pieces.where(F.col("kind") != WHOLE).select(
        "file", "start", "n", F.last(opening, ignorenulls=True).over(order).alias("opening")
    )
    parts = pieces.where(F.col("kind") != WHOLE).join(places, ["file", "start", "n"])
    part = F.struct("start", "n", F.col("record").cast("string").alias("text"))
    joined = parts.groupBy("file", "opening", "is_utf8").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "\n")
    stitched = joined.select("file", "opening.start", "opening.n", "is_utf8", text.cast("binary").alias("record"))
    every = whole.unionByName(stitched)
    ended = F.substring("record", -1, 1) == F.lit(b"\r")
    cut_end = F.expr("substring(record, 1, octet_length(record) - 1)")
    return every.withColumn("record", F.when(ended, cut_end).otherwise(F.col("record")))
