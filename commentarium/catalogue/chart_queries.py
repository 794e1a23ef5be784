"""Chart-ready tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.operators import charts as ch
from commentarium.operators.storage import scratch_path, staged_columns
from commentarium.sources.sinks import write_run

POINTS = 300  # below the row count of every scale, so that sampling happens


def both_sides(spark, sf_dir):
    rows = i.with_given_topics(spark, sf_dir).select("row_id", "sentiment", "topic_id")
    pos = rows.where("sentiment = 'pos'").withColumn("only_pos", F.lit(1))
    return ch.combine_sides(pos, rows.where("sentiment = 'neg'"))


def sampled(spark, sf_dir):
    return ch.sample_points(i.comments(spark, sf_dir), POINTS).select("row_id", "lang")


def _with_representatives(spark, sf_dir):
    """The first row of each source stands for it."""
    rows = i.with_given_topics(spark, sf_dir)
    first = rows.groupBy("source").agg(F.min("row_id").alias("row_id")).select("row_id", F.lit(True).alias("representative_doc"))
    marked = rows.join(first, "row_id", "left")
    return marked.withColumn("representative_doc", F.coalesce("representative_doc", F.lit(False)))


def sampled_with_representatives(spark, sf_dir):
    return ch.sample_with_representatives(_with_representatives(spark, sf_dir), POINTS).select("row_id", "representative_doc")


def few_points(spark, sf_dir):
    """Fewer places than representatives: the first of them."""
    return ch.sample_with_representatives(_with_representatives(spark, sf_dir), 7).select("row_id", "representative_doc")


def series(spark, sf_dir):
    return ch.topic_series(i.with_given_topics(spark, sf_dir))


def scatter(spark, sf_dir):
    rows = _with_representatives(spark, sf_dir).join(i.vectors(spark, sf_dir).drop("topic_id"), "row_id", "left")
    v = F.col("embedding")
    placed = rows.withColumn("x", F.get(v, F.lit(0)).cast("double")).withColumn("y", F.get(v, F.lit(1)).cast("double"))
    return ch.scatter_points(placed, POINTS).select(
        "row_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "series_idx", "shape_idx", "legend", "point_size"
    )


def _polar(spark, sf_dir):
    return i.labels(i.prepared(spark, sf_dir)).select("row_id", F.round("polarity", 6).alias("concept_similarity"))


def colour_scale(spark, sf_dir):
    return ch.colour_scale(ch.sample_points(_polar(spark, sf_dir), POINTS))


def coordinates(spark, sf_dir):
    rows = i.with_given_topics(spark, sf_dir).join(i.vectors(spark, sf_dir).drop("topic_id"), "row_id", "left")
    return ch.has_coordinates(rows.withColumn("x", F.get("embedding", F.lit(0))))


def _grams(n):
    def run(spark, sf_dir):
        return ch.ngram_counts(i.prepared(spark, sf_dir), n)

    return run


def no_grams(spark, sf_dir):
    """Nothing is both in two rows and in none: no grams, beside what the usual share gives."""
    rows = staged_columns(i.prepared(spark, sf_dir), "prepared")
    counts = [ch.ngram_counts(rows, 1, max_doc_share=s).agg(F.lit(s).alias("max_doc_share"), F.count("*").alias("n_grams")) for s in (0.0, 0.9)]
    return counts[0].unionByName(counts[1])


def clouds(spark, sf_dir):
    rows = i.with_given_topics(spark, sf_dir).withColumnRenamed("sentiment", "part")
    return ch.word_weights(rows).withColumn("weight", F.round("weight", 6))


_WORDS = """words AS (SELECT p.row_id, p.lang, lower(t.token) AS w, t.pos FROM prep p,
  LATERAL (SELECT unnest(p.tokens) AS token, generate_subscripts(p.tokens, 1) AS pos) t),
kept_words AS (SELECT row_id, w, row_number() OVER (PARTITION BY row_id ORDER BY pos) AS pos FROM words
  WHERE length(w) >= 2 AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = words.lang AND s.token = words.w))"""


def _sql_grams(n):
    gram = " || ' ' || ".join(f"lead(w, {k}) OVER o" if k else "w" for k in range(n))
    return i.with_ctes(
        *i.PREPARED, i.STOPS, _WORDS,
        f"g AS (SELECT row_id, {gram} AS gram FROM kept_words WINDOW o AS (PARTITION BY row_id ORDER BY pos))",
        select="""SELECT gram, count(*) AS n_total, count(DISTINCT row_id) AS n_docs FROM g WHERE gram IS NOT NULL GROUP BY gram
          HAVING count(DISTINCT row_id) BETWEEN 2 AND 0.9 * (SELECT count(*) FROM prep) ORDER BY n_total DESC, gram LIMIT 10""",
    )


def chart_tables(spark, sf_dir):
    """Word weights of three parts, written with a run's points and one-word counts, and read back."""
    rows = i.with_given_topics(spark, sf_dir).withColumn("is_outlier", F.length("clean_text") % 10 == 0)
    rows = staged_columns(rows.withColumn("part", ch.part_of()), "parted")
    base = write_run(
        {"weights": ch.word_weights(rows), "grams": ch.ngram_counts(rows.where("is_outlier"), 1), "points": rows.select("row_id", "part")},
        scratch_path(spark, "charts"), "charts",
    )
    points = spark.read.parquet(f"{base}/points").groupBy("part").agg(F.count("*").alias("n_points"))
    weights = spark.read.parquet(f"{base}/weights").select("part", "token", "n", F.round("weight", 6).alias("weight"), "place")
    return weights.join(F.broadcast(points), "part")  # three parts


_REPS = """firsts AS (SELECT min(row_id) AS row_id FROM given GROUP BY source),
marked AS (SELECT g.*, f.row_id IS NOT NULL AS representative_doc FROM given g LEFT JOIN firsts f USING (row_id))"""
_KEY = "md5(row_id || '|42')"
_SERIES = """series AS (SELECT sentiment, topic_id, (row_number() OVER (ORDER BY sentiment, topic_id) - 1)::INT AS series_idx,
    'Topic ' || sentiment || ' ' || topic_id AS legend FROM (SELECT DISTINCT sentiment, topic_id FROM {0} WHERE topic_id <> -1)
  UNION ALL SELECT DISTINCT sentiment, -1, -1, 'Noise (-1)' FROM {0} WHERE topic_id = -1)"""
_SHAPE = "CASE WHEN series_idx < 0 THEN -1 ELSE series_idx % 6 END AS shape_idx"


def _sql_rep_sample(source, n, where=""):
    return f"""picked AS (SELECT * FROM {source} {where} ORDER BY representative_doc DESC,
      CASE WHEN NOT representative_doc THEN {_KEY} END NULLS FIRST, row_id LIMIT {n})"""


QUERIES = {
    "viz01_both_sides": (
        both_sides,
        i.with_ctes(
            *i.GIVEN_TOPICS,
            select="SELECT row_id, sentiment, topic_id, CASE WHEN sentiment = 'pos' THEN 1 END AS only_pos FROM given",
        ),
    ),
    "viz02_sample": (
        sampled, f"SELECT doc_id AS row_id, lang FROM documents ORDER BY {_KEY.replace('row_id', 'doc_id')}, doc_id LIMIT {POINTS}"
    ),
    "viz03_sample_with_representatives": (
        sampled_with_representatives,
        i.with_ctes(*i.GIVEN_TOPICS, _REPS, _sql_rep_sample("marked", POINTS), select="SELECT row_id, representative_doc FROM picked"),
    ),
    "viz03_more_representatives_than_places": (
        few_points,
        i.with_ctes(*i.GIVEN_TOPICS, _REPS, _sql_rep_sample("marked", 7), select="SELECT row_id, representative_doc FROM picked"),
    ),
    "viz04_series": (
        series,
        i.with_ctes(
            *i.GIVEN_TOPICS, _SERIES.format("given"),
            select=f"""SELECT sentiment, topic_id, series_idx, CASE WHEN series_idx < 0 THEN -1 ELSE series_idx % 10 END AS colour_idx,
              {_SHAPE}, legend FROM series""",
        ),
    ),
    "viz05_scatter_points": (
        scatter,
        i.with_ctes(
            *i.GIVEN_TOPICS, _REPS,
            """xy AS (SELECT m.*, e.embedding[1]::DOUBLE AS x, e.embedding[2]::DOUBLE AS y FROM marked m JOIN embeddings e ON e.vec_id = m.row_id)""",
            _sql_rep_sample("xy", POINTS), _SERIES.format("picked"),
            select=f"""SELECT row_id, round(x, 6) AS x, round(y, 6) AS y, series_idx, {_SHAPE}, legend,
              CASE WHEN representative_doc THEN 10 ELSE 7 END AS point_size FROM picked JOIN series USING (sentiment, topic_id)""",
        ),
    ),
    "viz06_colour_scale": (
        colour_scale,
        i.with_ctes(
            *i.SENTIMENT, f"picked AS (SELECT round(polarity, 6) AS s FROM sent ORDER BY {_KEY}, row_id LIMIT {POINTS})",
            select="SELECT min(s) AS low, max(s) AS high, count(*) AS n_points FROM picked",
        ),
    ),
    "viz07_has_coordinates": (
        coordinates,
        i.with_ctes(
            *i.GIVEN_TOPICS,
            select="SELECT count(e.vec_id) > 0 AS has_coordinates, count(e.vec_id) AS n_points FROM given LEFT JOIN embeddings e ON e.vec_id = row_id",
        ),
    ),
    "viz08_unigrams": (_grams(1), _sql_grams(1)),
    "viz08_bigrams": (_grams(2), _sql_grams(2)),
    "viz08_trigrams": (_grams(3), _sql_grams(3)),
    "viz09_no_ngrams": (
        no_grams,
        f"SELECT 0.0::DOUBLE AS max_doc_share, 0 AS n_grams UNION ALL SELECT 0.9::DOUBLE, count(*) FROM ({_sql_grams(1)})",
    ),
    "src10_chart_tables": (
        chart_tables,
        i.with_ctes(
            *i.GIVEN_TOPICS, i.STOPS,
            """parted AS (SELECT *, CASE WHEN length(clean_text) % 10 = 0 THEN 'outliers' WHEN sentiment = 'pos' THEN 'positive'
              ELSE 'negative' END AS part FROM given)""",
            "w AS (SELECT part, lang, lower(unnest(tokens)) AS token FROM parted)",
            """n AS (SELECT part, token, count(*) AS n FROM w WHERE length(token) >= 2 AND NOT EXISTS
              (SELECT 1 FROM stops s WHERE s.lang = w.lang AND s.token = w.token) GROUP BY ALL)""",
            "r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, token) AS place FROM n)",
            "p AS (SELECT part, count(*) AS n_points FROM parted GROUP BY part)",
            select="""SELECT part, token, n, round(n / max(n) OVER (PARTITION BY part), 6) AS weight, place, n_points
              FROM r JOIN p USING (part) QUALIFY place <= 200""",
        ),
    ),
    "viz10_word_weights": (
        clouds,
        i.with_ctes(
            *i.GIVEN_TOPICS, i.STOPS,
            """w AS (SELECT sentiment AS part, lang, lower(unnest(tokens)) AS token FROM given),
            n AS (SELECT part, token, count(*) AS n FROM w WHERE length(token) >= 2 AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.lang = w.lang AND s.token = w.token) GROUP BY ALL),
            r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, token) AS place FROM n)""",
            select="SELECT part, token, n, round(n / max(n) OVER (PARTITION BY part), 6) AS weight, place FROM r QUALIFY place <= 200",
        ),
    ),
}
