"""One row per token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, items: Column | str, out: str, *carried: str, position: str | None = None) -> DataFrame:
    """(carried, [position,] out): one row per element of ``items``; none for empty arrays.

    Plain ``explode`` makes Spark infer a filter on the array's size and push it down
    to the scan, which cleans every text a second time. The outer form does not.
    """
    if position:
        rows = df.select(*carried, F.posexplode_outer(items).alias(position, out))
    else:
        rows = df.select(*carried, F.explode_outer(items).alias(out))
    return rows.where(F.col(out).isNotNull())
