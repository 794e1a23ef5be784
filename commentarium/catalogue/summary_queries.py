"""Report figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.catalogue import topic_queries as tq
from commentarium.catalogue.chart_queries import _REPS, _with_representatives
from commentarium.operators import outliers, summary as sm
from commentarium.operators import topics as tp


def _flagged(spark, sf_dir):
    """Comments with sentiment; the longest are the outliers, polarity the concept score."""
    rows = i.prepared(spark, sf_dir)
    flagged = outliers.flag_outliers(rows.withColumn("outlier_score", F.size("tokens").cast("double")))
    labelled = i.labels(flagged, "lang", "source", "is_outlier")
    return labelled.withColumn("concept_similarity", F.round("polarity", 6))


_SHARES = ("pos_share", "neg_share", "confidence_rate")


def _rounded(kpi, *lead):
    counts = ("n_rows", "n_clean", "n_outliers", "n_pos", "n_neg", "top_concept_score")
    return kpi.select(*lead, *counts, *[F.round(c, 6).alias(c) for c in _SHARES])


def totals(spark, sf_dir):
    return sm.kpis(_flagged(spark, sf_dir)).select("n_clean", "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in _SHARES[:2]])


def confidence(spark, sf_dir):
    return sm.kpis(_flagged(spark, sf_dir)).select(F.round("confidence_rate", 6).alias("confidence_rate"))


def top_score(spark, sf_dir):
    return sm.kpis(_flagged(spark, sf_dir)).select("top_concept_score")


def outlier_counts(spark, sf_dir):
    return sm.kpis(_flagged(spark, sf_dir)).select("n_rows", "n_clean", "n_outliers")


def headlines(spark, sf_dir):
    return sm.headline_topics(tq._topic_table(i.with_given_topics(spark, sf_dir)))


def cards(spark, sf_dir):
    rows = _with_representatives(spark, sf_dir)
    return sm.topic_cards(tp.attach_topics(rows, tq._topic_table(rows)))


def breakdown(spark, sf_dir):
    bar = sm.breakdown(sm.kpis(_flagged(spark, sf_dir)))
    return bar.select(*[F.round(c, 6).alias(c) for c in bar.columns])


def by_language(spark, sf_dir):
    return _rounded(sm.kpis(_flagged(spark, sf_dir), "lang"), "lang")


def by_language_and_source(spark, sf_dir):
    return _rounded(sm.kpi_rollup(_flagged(spark, sf_dir), "lang", "source"), "lang", "source", "level")


_FLAGS = (
    *i.SENTIMENT,
    """flagged AS (SELECT *, len(tokens) > (SELECT quantile_cont(len(tokens)::DOUBLE, 0.95) FROM prep) AS is_outlier,
      round(polarity, 6) AS concept_similarity FROM sent)""",
)
_MEASURES = """count(*) AS n_rows, count(*) FILTER (NOT is_outlier) AS n_clean, count(*) FILTER (is_outlier) AS n_outliers,
  count(*) FILTER (NOT is_outlier AND sentiment = 'pos') AS n_pos, count(*) FILTER (NOT is_outlier AND sentiment = 'neg') AS n_neg,
  max(concept_similarity) FILTER (NOT is_outlier) AS top_concept_score,
  coalesce(round(avg((sentiment = 'pos')::INT) FILTER (NOT is_outlier), 6), 0) AS pos_share,
  coalesce(round(avg((sentiment = 'neg')::INT) FILTER (NOT is_outlier), 6), 0) AS neg_share,
  coalesce(round(avg(sentiment_confidence::INT) FILTER (NOT is_outlier), 6), 0) AS confidence_rate"""
_KPI = (*_FLAGS, f"kpi AS (SELECT {_MEASURES} FROM flagged)")

QUERIES = {
    "rpt01_totals": (totals, i.with_ctes(*_KPI, select="SELECT n_clean, n_pos, n_neg, pos_share, neg_share FROM kpi")),
    "rpt02_confidence": (confidence, i.with_ctes(*_KPI, select="SELECT confidence_rate FROM kpi")),
    "rpt03_top_concept_score": (top_score, i.with_ctes(*_KPI, select="SELECT top_concept_score FROM kpi")),
    "rpt04_outlier_counts": (outlier_counts, i.with_ctes(*_KPI, select="SELECT n_rows, n_clean, n_outliers FROM kpi")),
    "rpt05_headline_topics": (
        headlines,
        i.with_ctes(*tq.NAMED, select="SELECT sentiment, arg_min(label, topic_id) AS topic FROM named WHERE keywords <> '' GROUP BY sentiment"),
    ),
    "rpt06_topic_cards": (
        cards,
        i.with_ctes(
            *tq.NAMED, _REPS,
            """rows_named AS (SELECT m.*, coalesce(label, 'General') AS label, coalesce(keywords, '') AS keywords
              FROM marked m LEFT JOIN named USING (sentiment, topic_id))""",
            select="""SELECT sentiment, label, arg_min(keywords, row_id) AS keywords, count(*) AS n_rows,
              coalesce(arg_min(left(clean_text, 300), row_id) FILTER (representative_doc), '') AS representative FROM rows_named GROUP BY sentiment, label""",
        ),
    ),
    "rpt07_breakdown": (
        breakdown,
        i.with_ctes(
            *_KPI,
            select=", ".join(
                f"round(n_{n} / greatest(n_rows, 1) * 100, 6) AS {n}_pct, round(n_{n} / greatest(n_clean, 1) * 100, 6) AS {n}_pct_of_clean"
                for n in ("pos", "neg", "outliers")
            ).join(("SELECT ", " FROM kpi")),
        ),
    ),
    "rpt08_kpis_by_language": (by_language, i.with_ctes(*_FLAGS, select=f"SELECT lang, {_MEASURES} FROM flagged GROUP BY lang")),
    "rpt08_kpi_rollup": (
        by_language_and_source,
        i.with_ctes(
            *_FLAGS, select=f"SELECT lang, source, grouping(lang, source) AS level, {_MEASURES} FROM flagged GROUP BY ROLLUP (lang, source)"
        ),
    ),
}
