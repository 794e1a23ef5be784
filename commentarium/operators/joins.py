"""Lookups of a large fact side in a dimension, with the broadcast decided by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentarium.operators.storage import cut_lineage

SMALL_ROWS = 1_000
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 32

_SALT = "_salt"


def _row_bytes(df: DataFrame) -> Column:
    """Rough width of a row, without serialising it."""
    width = F.lit(16)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width = width + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            each = 8 if isinstance(f.dataType.elementType, T.NumericType) else 32
            width = width + F.coalesce(F.size(c), F.lit(0)) * each
        else:
            width = width + F.lit(8)
    return width


def fits_broadcast(
    dim: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES
) -> bool:
    """Measure the dimension with one distributed aggregate."""
    measured = dim.agg(F.count("*").alias("n"), F.sum(_row_bytes(dim)).alias("b")).first()
    return measured["n"] <= max_rows and (measured["b"] or 0) <= max_bytes


def small_table(dim: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """The dimension as a local relation if it has at most ``max_rows`` rows."""
    rows = dim.limit(max_rows + 1).collect()
    return dim.sparkSession.createDataFrame(rows, dim.schema) if len(rows) <= max_rows else None


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    spread_by: str = "row_id",
    salts: int = SALTS,
    max_rows: int = MAX_BROADCAST_ROWS,
    small: bool = False,
) -> DataFrame:
    """Join facts to a keyed dimension (left, inner, left_semi or left_anti).

    A dimension measured to be small is broadcast. A larger one is shuffled with
    each of its rows repeated under every salt, while each fact row draws one
    salt from ``spread_by``: a key that holds a third of the facts ("the")
    becomes ``salts`` even parts, and the result is the same. The dimension is
    written to the shared folder first, so that measuring it does not compute it
    twice. ``small`` says that a few rows are likely (one per topic, say): then one
    bounded fetch both checks that and makes the table local.
    """
    on = [on] if isinstance(on, str) else list(on)
    local = small_table(dim) if small else None
    if local is not None:
        return facts.join(F.broadcast(local), on, how)
    dim = cut_lineage(dim)
    if fits_broadcast(dim, max_rows):
        return facts.join(F.broadcast(dim), on, how)
    salted_dim = dim.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = facts.withColumn(_SALT, F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts)).cast("int"))
    return salted.join(salted_dim, [*on, _SALT], how).drop(_SALT)


def join_on_content(
    facts: DataFrame,
    contents: DataFrame,
    key: str,
    copies: str,
    spread_by: str = "row_id",
    salts: int = SALTS,
    how: str = "left",
) -> DataFrame:
    """Join rows to a per-content table as large as themselves, with hot contents salted.

    ``contents`` has one row per distinct ``key`` and the number of fact rows that
    hold it in ``copies``. A content is hot when it holds over 1/1000 of all
    rows, so there are fewer than 1,000 hot keys whatever the data: that list is
    the only thing that reaches the driver. Only hot contents are repeated.
    """
    total = contents.agg(F.sum(copies)).first()[0] or 0
    hot = [
        r[0]
        for r in contents.where((F.col(copies) > total / 1000.0) & (F.col(copies) > salts))
        .select(key)
        .collect()
    ]
    contents = contents.drop(copies)
    if not hot:
        return facts.join(contents, key, how)
    is_hot = F.col(key).isin(hot)
    salted = facts.withColumn(
        _SALT,
        F.when(is_hot, F.pmod(F.xxhash64(F.col(spread_by)), F.lit(salts))).otherwise(0).cast("int"),
    )
    repeated = contents.withColumn(
        _SALT,
        F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
    )
    return salted.join(repeated, [key, _SALT], how).drop(_SALT)
