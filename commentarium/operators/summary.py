"""Report figures: KPIs, headline topics and topic cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.operators.naming import topic_name
from commentarium.operators.topics import FALLBACK_LABEL, NOISE

CARD_CHARS = 300  # fixed value


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 when there is nothing."""
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0))


def kpi_measures(columns: Sequence[str]) -> list[Column]:
    """The KPI aggregates over the unsplit table, for whichever columns it has.

    Outliers carry no sentiment. Shares of sides are of clean rows.
    """
    has = set(columns)
    out = F.col("is_outlier") if "is_outlier" in has else F.lit(False)
    clean = ~out
    pos = F.count_if(clean & (F.col("sentiment") == "pos"))
    neg = F.count_if(clean & (F.col("sentiment") == "neg"))
    n_clean = F.count_if(clean)
    measures = [
        F.count("*").alias("n_rows"),
        n_clean.alias("n_clean"),
        F.count_if(out).alias("n_outliers"),
        pos.alias("n_pos"),
        neg.alias("n_neg"),
        share(pos, n_clean).alias("pos_share"),
        share(neg, n_clean).alias("neg_share"),
    ]
    if "sentiment_confidence" in has:
        sure = F.avg(F.when(clean, F.col("sentiment_confidence").cast("double")))
        measures.append(F.coalesce(sure, F.lit(0.0)).alias("confidence_rate"))
    else:
        measures.append(F.lit(0.0).alias("confidence_rate"))
    if "concept_similarity" in has:
        measures.append(F.max(F.when(clean, F.col("concept_similarity"))).alias("top_concept_score"))
    return measures


def kpis(df: DataFrame, *by: str) -> DataFrame:
    """One row, or one per group: a single aggregate."""
    grouped = df.groupBy(*by) if by else df.groupBy()
    return grouped.agg(*kpi_measures(df.columns))


def kpi_rollup(df: DataFrame, *levels: str) -> DataFrame:
    """The same figures for every prefix of ``levels`` and the grand total."""
    return df.rollup(*levels).agg(F.grouping_id().alias("level"), *kpi_measures(df.columns))


def breakdown(kpi: DataFrame) -> DataFrame:
    """Percent of positive, negative and outlier rows.

    ``*_pct`` is of all rows and adds up to 100; ``*_pct_of_clean`` divides by the
    clean rows only, the other base in use for this bar. No rows: 0.
    """
    whole = F.greatest(F.col("n_rows"), F.lit(1))
    clean = F.greatest(F.col("n_clean"), F.lit(1))
    picked = []
    for name in ("pos", "neg", "outliers"):
        n = F.col(f"n_{name}")
        picked += [(n / whole * 100).alias(f"{name}_pct"), (n / clean * 100).alias(f"{name}_pct_of_clean")]
    return kpi.select(*picked)


def headline_topics(topics: DataFrame) -> DataFrame:
    """(sentiment, topic): the name of each side's first topic that has keywords."""
    real = topics.where((F.col("topic_id") != NOISE) & (F.coalesce("keywords", F.lit("")) != ""))
    first = real.groupBy("sentiment").agg(F.min_by("keywords", "topic_id").alias("keywords"))
    return first.select("sentiment", topic_name(F.col("keywords")).alias("topic"))


def topic_cards(df: DataFrame, row_id: str = "row_id", text: str = "clean_text") -> DataFrame:
    """(sentiment, label, keywords, n_rows, representative), topics of one label merged.

    Keywords come from the label's first row and the text from its first
    representative. Fallback rows have no card; noise is the "General" card.
    Rows are counted per keyword list first, which a hash aggregate can do; the one
    text per card is picked from representatives only.
    """
    labelled = df.where(F.col("topic_label").isNotNull() & (F.col("topic_label") != FALLBACK_LABEL))
    keys = ["sentiment", F.col("topic_label").alias("label")]
    counted = (
        labelled.groupBy(*keys, "topic_keywords")
        .agg(F.count("*").alias("n"), F.min(row_id).alias("first_row"))
        .groupBy("sentiment", "label")
        .agg(F.sum("n").alias("n_rows"), F.min_by("topic_keywords", "first_row").alias("keywords"))
    )
    texts = (
        labelled.where("representative_doc")
        .groupBy(*keys)
        .agg(F.min_by(F.substring(text, 1, CARD_CHARS), F.col(row_id)).alias("representative"))
    )
    return counted.join(texts, ["sentiment", "label"], "left").select(
        "sentiment", "label", "keywords", "n_rows", F.coalesce("representative", F.lit("")).alias("representative")
    )
