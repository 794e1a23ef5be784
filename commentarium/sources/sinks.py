"""Result and dataset sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.operators.storage import path_exists


def write_split(df: DataFrame, path: str, column: str, file_format: str = "parquet", mode: str = "errorifexists") -> None:
    """One folder per value of ``column``, all values in one pass.

    The rebalance hint gives each value few files and lets Spark divide a value
    that holds a large part of the rows.
    """
    writer = df.hint("rebalance", F.col(column)).write.mode(mode).partitionBy(column)
    if file_format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(file_format).save(path)


def read_split(df: DataFrame, column: str, *values: str) -> DataFrame:
    """Chosen values only; on a split dataset this prunes folders."""
    return df.where(F.col(column).isin(list(values)))


def write_run(
    tables: Mapping[str, DataFrame],
    root: str,
    run_id: str,
    parameters: Mapping[str, object] | None = None,
    file_format: str = "parquet",
) -> str:
    """Write result tables under ``root/run_id=…/``; a complete run of that name is an error.

    Run parameters are stored as a one-row ``parameters`` table of strings. The
    ``complete`` table comes last: a run that broke off lacks it, and its retry writes
    over what it left.
    """
    base = f"{root.rstrip('/')}/run_id={run_id}"
    spark = next(iter(tables.values())).sparkSession
    if path_exists(spark, f"{base}/complete"):
        raise FileExistsError(f"Run {run_id!r} is complete in {root}.")
    for name, table in tables.items():
        table.write.mode("overwrite").format(file_format).save(f"{base}/{name}")
    if parameters:
        listed = spark.range(1).select(*[F.lit(str(v)).alias(k) for k, v in parameters.items()])
        listed.write.mode("overwrite").format(file_format).save(f"{base}/parameters")
    names = spark.createDataFrame([(name,) for name in tables], "table string")
    names.write.mode("overwrite").format(file_format).save(f"{base}/complete")
    return base
