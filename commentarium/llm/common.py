"""Helpers that several operators of this subpackage share.

A *word* is a maximal run without ASCII white space; lower-casing touches A-Z
only. ``bytes.lower`` and ``bytes.split`` on UTF-8 do exactly that.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.operators.storage import scratch_path

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5

_MASK = (1 << 64) - 1

_WIDE_ROWS = {
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int | None = None) -> None:
    """Lower the session's Arrow batch size, in rows and (if given) in bytes, where it is larger: whole texts are wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    current = int(spark.conf.get(key))
    if current <= 0 or current > rows:
        spark.conf.set(key, str(rows))
    if size is not None:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= size:
            spark.conf.set(key, str(size))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches and Parquet reads of at most ``rows`` rows for the jobs run inside; the session's own sizes afterwards."""
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    current = {key: spark.conf.get(key) for key in keys}
    for key in keys:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        for key, value in current.items():
            spark.conf.set(key, value)


def written(df: DataFrame, name: str, compression: str | None = None, wide: bool = False) -> DataFrame:
    """Write to the shared folder as Parquet and go on from the files.

    Columns not asked for later are not read again, and a lost executor costs a
    re-read of files. ``compression`` is the session's own unless given. ``wide`` says that
    rows have several MB: the writer then looks at its size after every row, as its own
    first look comes after 100 rows, and a page or a row group holds a few rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**(_WIDE_ROWS if wide else {})).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a ``written`` frame that no later frame reads."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def plain(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns cannot clash."""
    return df.select(*[df[f"`{given}`"].alias(own) for own, given in columns.items()])


def set_aside(df: DataFrame, *own: str) -> DataFrame:
    """``df`` with all columns but ``own`` under names by place, which clash with no operator's; ``toDF(*df.columns)`` undoes it."""
    return df.toDF(*[c if c in own else f"_{k}" for k, c in enumerate(df.columns)])


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """Consecutive texts, about ``limit`` bytes at a time, so that their words fit in memory."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for at, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    yield batch.slice(start)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(count: int, seed: int) -> np.ndarray:
    """``count`` odd 64-bit factors, the same in every process."""
    return mixed(np.arange(1, count + 1, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & _MASK)) | np.uint64(1)


class WordHashes(dict):
    """64-bit hashes of words; common words are remembered, up to a bound."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_FACTORS = odd_constants(SHINGLE_WORDS, seed=5)


def shingle_hashes(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Hashes of a text's five-word shingles, repeats included.

    Fewer words than five: the whole sequence is one shingle. No word: none.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    values = hashes.of(words)
    count = len(words) - SHINGLE_WORDS + 1
    total = values[:count] * _FACTORS[0]
    for k in range(1, SHINGLE_WORDS):
        total += values[k : k + count] * _FACTORS[k]
    return mixed(total)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Groups of rows with equal ``keys`` from batches sorted by them, one at a time.

    Holds one group: callers bound the size of theirs. Nulls are not expected.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        marks = list(zip(*columns, strict=True))
        start = 0
        for i, mark in enumerate(marks):
            if mark != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, mark
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def grouped(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key together and sorted, for ``runs`` in ``mapInArrow``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def word_count(text) -> "F.Column":
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of ``edges(src, dst)`` the smallest node that it reaches.

    Every round each node joins the neighbour (or itself) that comes first in a fresh
    random order, and the graph shrinks to the nodes joined to, in expectation
    by a constant factor whatever its shape; edges within a merged node vanish. The
    rounds' maps are then followed from the last to the first.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()

    def tidy(a, b) -> list:
        return [F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")]

    left = written(edges.where("src <> dst").select(*tidy("src", "dst")).distinct(), "edges")
    maps: list[DataFrame] = []
    while left.limit(1).count():
        order = F.xxhash64(F.lit(len(maps)), "other")
        both = left.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
            left.select(F.col("dst").alias("node"), F.col("src").alias("other"))
        )
        best = both.groupBy("node").agg(F.min(F.struct(order.alias("turn"), F.col("other").alias("to"))).alias("b"))
        own = F.struct(F.xxhash64(F.lit(len(maps)), "node").alias("turn"), F.col("node").alias("to"))
        joined = written(best.select("node", F.least(F.col("b"), own)["to"].alias("to")), "joined")
        maps.append(joined)
        a, b = (joined.select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")) for end in ("src", "dst"))
        moved = left.join(a, "src").join(b, "dst").where("src_to <> dst_to")
        left = written(moved.select(*tidy("src_to", "dst_to")).distinct(), "edges")
    if not maps:
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    found = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("end"))
        found = earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    found = written(found, "ends")
    least = found.groupBy("to").agg(F.min("node").alias("component"))
    return found.join(least, "to").select("node", "component")
