"""Resolve each row's language against the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.functions.dictionaries import LANGUAGE_CODES, language_table


def with_language(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Add the registry fields; five fixed rows, so always a broadcast."""
    registry = language_table(df.sparkSession).withColumnRenamed("lang", "_lang")
    return df.join(F.broadcast(registry), F.col(lang) == F.col("_lang"), "left").drop("_lang")


def unsupported(df: DataFrame, lang: str = "lang") -> DataFrame:
    """Rows with a language the registry does not have, for quarantine."""
    registry = language_table(df.sparkSession).select(F.col("lang").alias("_lang"))
    return df.join(F.broadcast(registry), F.col(lang) == F.col("_lang"), "left_anti")


def require_supported(df: DataFrame, lang: str = "lang") -> DataFrame:
    known = F.coalesce(F.col(lang).isin(list(LANGUAGE_CODES)), F.lit(False))
    row = df.where(~known).select(lang).first()
    if row is not None:
        raise ValueError(
            f"No language is registered as {row[0]!r}; registered are {', '.join(sorted(LANGUAGE_CODES))}."
        )
    return df
