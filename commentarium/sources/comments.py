"""Comment sources: CSV with encoding fallback, and parquet."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentarium.operators.joins import lookup_join
from commentarium.operators.storage import staged_columns
from commentarium.sources.records import ends_inside, records

# Cells that count as missing, matched exactly.
MISSING_VALUES = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
LATIN1 = "ISO-8859-1"


def null_if_missing(value: Column) -> Column:
    return F.when(value.isin(list(MISSING_VALUES)), F.lit(None)).otherwise(value)


def require_column(df: DataFrame, column: str) -> None:
    """Metadata only: no job runs."""
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found. Available columns: {', '.join(df.columns)}")


def require_rows(df: DataFrame, where: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"No rows remain after loading {where} and removing null texts.")
    return df


def file_layouts(spark: SparkSession, path: str | Sequence[str], encoding: str = "auto") -> DataFrame:
    """(file, is_utf8, header, n_bytes): one row per file, by one aggregate over raw lines.

    ``header`` is the file's first line, in the file's own encoding.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.is_valid_utf8("value").alias("ok"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("n"),
        F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_size").alias("n_bytes"),
    )
    files = lines.groupBy("file").agg(
        F.min("ok").alias("is_utf8"), F.min_by("line", "n").alias("line"), F.max("n_bytes").alias("n_bytes")
    )
    if encoding != "auto":
        text = F.decode("line", encoding)
    else:
        text = F.when(F.col("is_utf8"), F.decode("line", "UTF-8")).otherwise(F.decode("line", LATIN1))
    return files.select("file", "is_utf8", F.regexp_replace(text, "^\\uFEFF|\\r$", "").alias("header"), "n_bytes")


def _split_bytes(spark: SparkSession) -> int:
    return spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()


def _heads(headers: Sequence[str], columns: Sequence[str] | None) -> tuple[dict[str, list[str]], list[str]]:
    """Column names by header, and all names in order of first sight."""
    heads = {h: next(csv.reader(io.StringIO(h or "", newline="")), []) for h in headers}
    if columns:
        heads = dict.fromkeys(heads, list(columns))
    return heads, list(dict.fromkeys(n for h in heads.values() for n in h))


def _places(spark: SparkSession, heads: dict[str, list[str]], names: Sequence[str]) -> DataFrame:
    """For each header, the place of each name, from 1; null if the header lacks it."""
    return spark.createDataFrame(
        [(header, [h.index(n) + 1 if n in h else None for n in names]) for header, h in heads.items()],
        "_header string, _places array<int>",
    )


def _read_records(
    spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] | None, encoding: str
) -> DataFrame:
    """``read_csv`` by ``records``; the first record of a file is its header."""
    as_utf8 = F.make_valid_utf8(F.col("record").cast("string"))
    if encoding == "auto":
        text = F.when(F.col("is_utf8"), as_utf8).otherwise(F.decode("record", LATIN1))
    else:
        text = as_utf8 if encoding.upper() in ("UTF-8", "UTF8") else F.decode("record", encoding)
    rows = records(spark, path).select(F.col("file").alias("_file"), "start", "n", text.alias("_text"))
    # A file's first record is the first of its split; so this groups one row a split.
    first = rows.where("n = 0").groupBy("_file").agg(
        F.min("start").alias("_first"), F.min_by("_text", "start").alias("_header")
    )
    first = staged_columns(first.withColumn("_header", F.regexp_replace("_header", "^\\uFEFF", "")), "headers")
    heads, names = _heads([r[0] for r in first.select("_header").distinct().collect()], columns)
    if not names:
        names = list(columns or ["_c0"])
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in names]))
    known = first.join(F.broadcast(_places(spark, heads, names)), "_header").drop("_header")  # a row per layout
    rows = lookup_join(rows, known, "_file", "inner", spread_by="_text")
    rows = rows.where(~((F.col("n") == 0) & (F.col("start") == F.col("_first"))))
    width = max(len(h) for h in heads.values())
    schema = ", ".join(f"_p{k} string" for k in range(width))
    parsed = F.from_csv("_text", F.lit(schema), {"quote": '"', "escape": '"', "multiLine": "true"})
    cells = rows.select("_places", parsed.alias("_row")).select(
        "_places", F.array(*[F.col("_row")[f"_p{k}"] for k in range(width)]).alias("_cells")
    )
    return cells.select(
        *[F.get("_cells", F.get("_places", F.lit(k)) - 1).alias(name) for k, name in enumerate(names)]
    )


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Sequence[str] | None = None,
    encoding: str = "auto",
    multiline: bool = True,
    parallel: bool | None = None,
) -> DataFrame:
    """Headed CSV files with every column as a string; quoted fields may span lines.

    Each file's own header says which column is which: files may order their
    columns differently or lack some (then null). ``auto`` reads a file as UTF-8, or
    whole as Latin-1 if any byte of it is not UTF-8. Both take one extra pass over the
    bytes; with ``columns`` (names by place, for all files) and an ``encoding``
    there is none. Spark's own reader makes a file one split under ``multiline``, so files
    larger than a split go through ``records``, which cuts them in many tasks and
    writes them once; so do files whose header holds a line break. ``parallel``
    decides that by hand. With ``multiline`` off, every line end ends a record.
    """

    def scan(names: Sequence[str], charset: str) -> DataFrame:
        return (
            spark.read.option("header", True)
            .option("multiLine", multiline)
            .option("quote", '"')
            .option("escape", '"')
            .option("encoding", charset)
            .schema(T.StructType([T.StructField(c, T.StringType()) for c in names]))
            .csv(path if isinstance(path, str) else list(path))
        )

    if parallel:
        return _read_records(spark, path, columns, encoding)
    if columns and encoding != "auto":
        return scan(columns, encoding)
    files = staged_columns(file_layouts(spark, path, encoding), "layouts")
    # Distinct layouts, of which there are few; files stay in their table.
    layouts = files.select("is_utf8", "header").distinct().collect()
    if parallel is None and multiline and not encoding.upper().startswith(("UTF-16", "UTF-32")):
        largest = files.agg(F.max("n_bytes")).first()[0] or 0
        if largest > _split_bytes(spark) or any(ends_inside((r["header"] or "").encode(), False) for r in layouts):
            return _read_records(spark, path, columns, encoding)
    heads, names = _heads([r["header"] for r in layouts], columns)
    if not names:
        return scan(list(columns or ["_c0"]), "UTF-8").limit(0)
    alike = {r["is_utf8"] for r in layouts} if encoding == "auto" else {True}
    if len(alike) == 1 and len({tuple(h) for h in heads.values()}) == 1:
        return scan(names, encoding if encoding != "auto" else "UTF-8" if alike == {True} else LATIN1)
    # One scan of all files by place, in an encoding that keeps every byte; each row's file says the rest.
    width = max(len(h) for h in heads.values())
    places = [f"_p{k}" for k in range(width)]
    rows = scan(places, encoding if encoding != "auto" else LATIN1).select(
        F.col("_metadata.file_path").alias("_file"), F.array(*places).alias("_cells")
    )
    place_of = _places(spark, heads, names)
    known = files.select(F.col("file").alias("_file"), F.col("is_utf8").alias("_ok"), F.col("header").alias("_header"))
    known = known.join(F.broadcast(place_of), "_header").drop("_header")  # a row per layout
    rows = lookup_join(rows, known, "_file", "inner", spread_by="_cells")

    def cell(k: int) -> Column:
        value = F.get("_cells", F.get("_places", F.lit(k)) - 1)
        if encoding != "auto":
            return value
        return F.when(F.col("_ok"), F.decode(F.encode(value, LATIN1), "UTF-8")).otherwise(value)

    return rows.select(*[cell(k).alias(n) for k, n in enumerate(names)])


def standardise(df: DataFrame, text_column: str, key: str | None = None) -> DataFrame:
    """Add ``raw_text`` (the text column stays) and ``row_id``; drop missing texts.

    ``key`` names a unique column. Without one, rows are numbered by partition
    and place, which is unique and repeatable while the files stay the same.
    """
    require_column(df, text_column)
    numbered = df.withColumn("row_id", F.monotonically_increasing_id() if key is None else F.col(key))
    return numbered.withColumn("raw_text", null_if_missing(F.col(text_column).cast("string"))).na.drop(
        subset=["raw_text"]
    )


def load_comments(
    spark: SparkSession,
    path: str | Sequence[str],
    text_column: str,
    key: str | None = None,
    lang: str | None = None,
    file_format: str = "csv",
    **csv_options,
) -> DataFrame:
    """Load a comment table; ``lang`` sets one language for data without the column."""
    df = spark.read.parquet(path) if file_format == "parquet" else read_csv(spark, path, **csv_options)
    loaded = standardise(df, text_column, key)
    if lang is not None:
        loaded = loaded.withColumn("lang", F.lit(lang))
    return require_rows(loaded, str(path))
