"""Concept search."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.operators import search as se
from commentarium.operators.storage import stage


def _concept(rows, row_id=0):
    return rows.where(F.col("row_id") == row_id).select("embedding").first()[0]


def _scored(spark, sf_dir):
    rows = i.vectors(spark, sf_dir)
    return se.add_similarity(rows, _concept(rows))


_SIM = "round(concept_similarity, 6) AS concept_similarity"


def similarity(spark, sf_dir):
    return _scored(spark, sf_dir).selectExpr("row_id", _SIM)


def top_rows(spark, sf_dir):
    return se.top_similar(_scored(spark, sf_dir)).selectExpr("row_id", _SIM)


def spread(spark, sf_dir):
    figures = se.similarity_spread(_scored(spark, sf_dir))
    return figures.select("n", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean", "std")])


def no_rows(spark, sf_dir):
    """An empty selection keeps the column."""
    rows = i.vectors(spark, sf_dir)
    return se.add_similarity(rows.where("row_id < 0"), _concept(rows)).select("row_id", "concept_similarity")


def similarity_by_topic(spark, sf_dir):
    """Similarity rides along on the row, so topics see it without a join."""
    scored = _scored(spark, sf_dir)
    return scored.groupBy("topic_id").agg(
        F.count("*").alias("n_rows"), F.round(F.avg("concept_similarity"), 6).alias("mean"), F.round(F.max("concept_similarity"), 6).alias("max")
    )


def top_texts(spark, sf_dir):
    """Distinct comments of highest score; the lexicon score stands in for similarity."""
    rows = stage(i.with_sentiment(i.prepared(spark, sf_dir)).select("row_id", "clean_text", "sentiment", "polarity"))
    scored = rows.withColumn("concept_similarity", F.round("polarity", 9))
    return se.top_similar_texts(scored).selectExpr("row_id", "clean_text", _SIM, "sentiment")


def many_concepts(spark, sf_dir):
    """Every twentieth vector stands in for a phrase; all rows are searched."""
    rows = i.vectors(spark, sf_dir)
    concepts = rows.where("row_id % 20 = 0").select(F.concat(F.lit("c"), "row_id").alias("concept"), F.col("embedding").alias("target"))
    return se.top_per_concept(rows, concepts).selectExpr("concept", "place", "row_id", _SIM)


_SIMS = (
    i.VECS,
    """sims AS (SELECT a.row_id, a.topic_id, q.row_id AS concept, list_cosine_similarity(a.v, q.v) AS s
      FROM vecs a, vecs q WHERE q.row_id % 20 = 0)""",
    "one AS (SELECT * FROM sims WHERE concept = 0)",
)

QUERIES = {
    "sem01_similarity": (similarity, i.with_ctes(*_SIMS, select="SELECT row_id, round(s, 6) AS concept_similarity FROM one")),
    "sem02_top_rows": (
        top_rows, i.with_ctes(*_SIMS, select="SELECT row_id, round(s, 6) AS concept_similarity FROM one ORDER BY s DESC, row_id LIMIT 5")
    ),
    "sem03_spread": (
        spread,
        i.with_ctes(
            *_SIMS,
            select="""SELECT count(*) AS n, round(min(s), 6) AS min, round(max(s), 6) AS max, round(avg(s), 6) AS mean,
              round(stddev_samp(s), 6) AS std FROM one""",
        ),
    ),
    "sem04_empty_input": (
        no_rows, i.with_ctes(*_SIMS, select="SELECT row_id, s AS concept_similarity FROM one WHERE row_id < 0")
    ),
    "sem05_similarity_by_topic": (
        similarity_by_topic,
        i.with_ctes(
            *_SIMS, select="SELECT topic_id, count(*) AS n_rows, round(avg(s), 6) AS mean, round(max(s), 6) AS max FROM one GROUP BY topic_id"
        ),
    ),
    "sem06_top_texts": (
        top_texts,
        i.with_ctes(
            *i.SENTIMENT,
            "first AS (SELECT clean_text, min(row_id) AS row_id FROM sent GROUP BY clean_text)",
            select="""SELECT row_id, left(sent.clean_text, 200) AS clean_text, round(polarity, 6) AS concept_similarity, sentiment
              FROM sent JOIN first USING (row_id) ORDER BY round(polarity, 9) DESC, row_id LIMIT 5""",
        ),
    ),
    "sem07_many_concepts": (
        many_concepts,
        i.with_ctes(
            *_SIMS,
            """ranked AS (SELECT 'c' || concept AS concept, row_id, s,
              row_number() OVER (PARTITION BY concept ORDER BY round(s, 9) DESC, row_id) AS place FROM sims)""",
            select="SELECT concept, place, row_id, round(s, 6) AS concept_similarity FROM ranked WHERE place <= 5",
        ),
    ),
}
