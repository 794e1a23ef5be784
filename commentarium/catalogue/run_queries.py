"""The whole analysis, seen through three of its result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.plans.feedback import analyse


def _run(spark, sf_dir):
    return analyse(i.comments(spark, sf_dir), i.lexicon)


def kpis(spark, sf_dir):
    """Every comment of a language is positive, negative or an outlier, once."""
    by_language = _run(spark, sf_dir).kpi_by_language
    return by_language.select("lang", (F.col("n_pos") + F.col("n_neg") + F.col("n_outliers")).alias("n_rows"))


def cards(spark, sf_dir):
    """Every topic's card is named, counted and has its list of keywords; one row for all."""
    found = _run(spark, sf_dir).cards
    return found.agg(
        (F.count("*") > 0).alias("has_cards"),
        F.every(F.length("label") > 0).alias("all_named"),
        F.every(F.col("keywords").isNotNull()).alias("all_have_keywords"),
        F.every(F.col("n_rows") > 0).alias("all_have_rows"),
    )


QUERIES = {
    "run_kpis": (kpis, "SELECT lang, count(*) AS n_rows FROM documents WHERE text IS NOT NULL GROUP BY lang"),
    "run_topic_cards": (
        cards, "SELECT count(*) > 0 AS has_cards, true AS all_named, true AS all_have_keywords, true AS all_have_rows FROM documents"
    ),
}
