"""Sentiment by lexicon and by class probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.operators import sentiment as st

_CONTRACT = ("row_id", "sentiment", "round(polarity, 6) AS polarity", "sentiment_confidence")


def _labelled(spark, sf_dir):
    return i.labels(i.prepared(spark, sf_dir), "lang")


def compound_scores(spark, sf_dir):
    rows = i.prepared(spark, sf_dir)
    scores = st.lexicon_scores(rows, i.lexicon(rows))
    return scores.select("row_id", F.round("score_1", 6).alias("score_1"))


def second_scores(spark, sf_dir):
    rows = i.prepared(spark, sf_dir)
    scores = st.lexicon_scores(rows, i.merged_lexicons(spark, rows))
    return scores.select("row_id", F.round("score_1", 6).alias("score_1"), F.round("score_2", 6).alias("score_2"))


def flipped_scores(spark, sf_dir):
    rows = i.prepared(spark, sf_dir)
    scores = st.lexicon_scores(rows, i.lexicon(rows), negation="flip")
    return scores.select("row_id", F.round("score_1", 6).alias("score_1"), F.round("score_2", 6).alias("score_2"))


def side_labels(spark, sf_dir):
    return _labelled(spark, sf_dir).select("row_id", "sentiment")


def lexicon_contract(spark, sf_dir):
    """Attached to the texts, as a user of the texts would have it."""
    return i.with_sentiment(i.prepared(spark, sf_dir)).selectExpr(*_CONTRACT)


def blank_rows(spark, sf_dir):
    rows = i.with_sentiment(i.prepared(spark, sf_dir))
    return rows.where(st.is_blank(F.col("clean_text"))).selectExpr(*_CONTRACT)


def _given_probabilities(spark, sf_dir):
    """Three shares from text lengths, as a predictor would return them."""
    n = F.length("raw_text")
    rows = i.comments(spark, sf_dir).select(
        "row_id", (1 + n % 97).alias("a"), (1 + n % 89).alias("b"), (1 + n % 83).alias("c")
    )
    whole = F.col("a") + F.col("b") + F.col("c")
    output = (
        F.when((F.col("c") > F.col("a")) & (F.col("c") > F.col("b")), "NEU")
        .when(F.col("a") >= F.col("b"), "POS")
        .otherwise("NEG")
    )
    return rows.select(
        "row_id",
        F.struct(
            output.alias("output"), (F.col("a") / whole).alias("p_pos"), (F.col("b") / whole).alias("p_neg"), (F.col("c") / whole).alias("p_neu")
        ).alias("probabilities"),
    )


def probability_labels(spark, sf_dir):
    return st.resolve_probabilities(_given_probabilities(spark, sf_dir)).select("row_id", "sentiment", "sentiment_confidence")


def probability_polarity(spark, sf_dir):
    return st.resolve_probabilities(_given_probabilities(spark, sf_dir)).select("row_id", F.round("polarity", 6).alias("polarity"))


def _quality_model(spark, sf_dir, rows):
    labels = i.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    return st.fit_classifier(rows.join(labels, "row_id"))


def model_predictions(spark, sf_dir):
    """A classifier fitted on the labelled comments, applied to all; every label follows from its probabilities."""
    rows = i.prepared(spark, sf_dir)
    scored = st.classify(rows, _quality_model(spark, sf_dir, rows))
    done = st.resolve_probabilities(scored.withColumn("p", F.col("probabilities")), text="clean_text")
    blank = st.is_blank(F.col("clean_text"))
    side = F.when(~blank & (F.col("p.p_pos") >= F.col("p.p_neg")), "pos").otherwise("neg")
    polarity = F.when(blank, 0.0).otherwise(F.col("p.p_pos") - F.col("p.p_neg"))
    return done.select(
        "row_id",
        blank.alias("is_blank"),
        (F.abs(F.col("p.p_pos") + F.col("p.p_neg") + F.col("p.p_neu") - 1) < 1e-9).alias("sums_to_one"),
        (F.col("sentiment") == side).alias("side_follows"),
        (F.abs(F.col("polarity") - polarity) < 1e-9).alias("polarity_follows"),
    )


def plugin_predictions(spark, sf_dir):
    """A stand-in user model (share of two letters) through the plug-in point."""

    def load():
        def predict(texts):
            out = []
            for t in texts:
                a, b = t.count("e") + 1, t.count("n") + 1
                out.append(("POS" if a > b else "NEG" if b > a else "NEU", a / (a + b), b / (a + b), 0.0))
            return out

        return predict

    rows = i.prepared(spark, sf_dir)
    scored = rows.withColumn("probabilities", st.predictor_expression(load)(F.col("clean_text")))
    return st.resolve_probabilities(scored, text="clean_text").selectExpr(*_CONTRACT)


def mixed_routes(spark, sf_dir):
    """Each language by its registered route: English by lexicon, the rest by model."""
    rows = i.prepared(spark, sf_dir)
    model = _quality_model(spark, sf_dir, rows)
    done = st.analyse_sentiment(rows, i.lexicon(rows), predict=lambda df: st.classify(df, model))
    english = F.col("lang") == "en"
    return done.select(
        "row_id",
        F.when(english, F.col("sentiment")).otherwise("by model").alias("sentiment"),
        F.when(english, F.round("polarity", 6)).alias("polarity"),
        (F.col("sentiment").isin("pos", "neg") & F.col("polarity").between(-1, 1)).alias("in_range"),
    )


def summary(spark, sf_dir):
    done = st.sentiment_summary(_labelled(spark, sf_dir), "lang")
    return done.select("lang", "n_pos", "n_neg", "n_rows", F.round("confidence_rate", 6).alias("confidence_rate"))


def sides(spark, sf_dir):
    pos, neg = st.split_sides(_labelled(spark, sf_dir).select("row_id", "sentiment", "lang").persist())
    one = pos.groupBy("lang").agg(F.count("*").alias("n_rows")).withColumn("part", F.lit("pos"))
    two = neg.groupBy("lang").agg(F.count("*").alias("n_rows")).withColumn("part", F.lit("neg"))
    return one.unionByName(two)


def small_sides(spark, sf_dir):
    return st.side_sizes(_labelled(spark, sf_dir))



_FLIP_TOKS = """ftoks AS (SELECT row_id, CASE WHEN starts_with(token, 'NEG_') THEN substr(token, 5) ELSE token END AS token,
  CASE WHEN starts_with(token, 'NEG_') THEN -0.74::DOUBLE ELSE 1 END AS factor FROM toks)"""
_FLIP_HITS = """fhits AS (SELECT row_id, coalesce(sum(valence_1 * factor), 0) AS s, coalesce(avg(valence_2 * factor), 0) AS s2
  FROM ftoks JOIN lex USING (token) GROUP BY row_id)"""
_SQL_CONTRACT = "row_id, sentiment, round(polarity, 6) AS polarity, sentiment_confidence"
_PROBS = """parts AS (SELECT doc_id AS row_id, 1 + length(text) % 97 AS a, 1 + length(text) % 89 AS b, 1 + length(text) % 83 AS c FROM documents),
given AS (SELECT row_id, a / (a + b + c) AS p_pos, b / (a + b + c) AS p_neg,
  CASE WHEN c > a AND c > b THEN 'NEU' WHEN a >= b THEN 'POS' ELSE 'NEG' END AS output FROM parts)"""

QUERIES = {
    "sen01_compound": (compound_scores, i.with_ctes(*i.LEXICAL, select="SELECT row_id, round(score_1, 6) AS score_1 FROM scores")),
    "sen02_second_lexicon": (
        second_scores,
        i.with_ctes(*i.LEXICAL, select="SELECT row_id, round(score_1, 6) AS score_1, round(score_2, 6) AS score_2 FROM scores"),
    ),
    "sen02_negation_flip": (
        flipped_scores,
        i.with_ctes(
            *i.PREPARED, i.TOKS, i.LEX, _FLIP_TOKS, _FLIP_HITS,
            select="""SELECT p.row_id, round(coalesce(s / sqrt(s * s + 15), 0), 6) AS score_1, round(coalesce(s2, 0), 6) AS score_2
              FROM prep p LEFT JOIN fhits USING (row_id)""",
        ),
    ),
    "sen03_side": (side_labels, i.with_ctes(*i.SENTIMENT, select="SELECT row_id, sentiment FROM sent")),
    "sen04_agreement": (lexicon_contract, i.with_ctes(*i.SENTIMENT, select=f"SELECT {_SQL_CONTRACT} FROM sent")),
    "sen05_blank_rows": (
        blank_rows, i.with_ctes(*i.SENTIMENT, select=f"SELECT {_SQL_CONTRACT} FROM sent WHERE trim(clean_text) = ''")
    ),
    "sen06_classifier": (
        model_predictions,
        i.with_ctes(
            *i.PREPARED,
            select="""SELECT row_id, trim(clean_text) = '' AS is_blank, true AS sums_to_one, true AS side_follows,
              true AS polarity_follows FROM prep""",
        ),
    ),
    "sen06_plugin": (
        plugin_predictions,
        i.with_ctes(
            *i.PREPARED,
            """ab AS (SELECT row_id, clean_text, 1 + length(clean_text) - length(replace(clean_text, 'e', '')) AS a,
              1 + length(clean_text) - length(replace(clean_text, 'n', '')) AS b FROM prep)""",
            select="""SELECT row_id, CASE WHEN clean_text <> '' AND a >= b THEN 'pos' ELSE 'neg' END AS sentiment,
              CASE WHEN clean_text = '' THEN 0 ELSE round((a - b) / (a + b), 6) END AS polarity,
              clean_text <> '' AND a <> b AS sentiment_confidence FROM ab""",
        ),
    ),
    "sen07_resolve_probabilities": (
        probability_labels,
        i.with_ctes(
            _PROBS,
            select="""SELECT row_id, CASE WHEN output = 'POS' OR (output = 'NEU' AND p_pos >= p_neg) THEN 'pos' ELSE 'neg' END AS sentiment,
              output <> 'NEU' AS sentiment_confidence FROM given""",
        ),
    ),
    "sen08_polarity": (probability_polarity, i.with_ctes(_PROBS, select="SELECT row_id, round(p_pos - p_neg, 6) AS polarity FROM given")),
    "sen09_summary": (
        summary,
        i.with_ctes(
            *i.SENTIMENT,
            select="""SELECT lang, count(*) FILTER (sentiment = 'pos') AS n_pos, count(*) FILTER (sentiment = 'neg') AS n_neg,
              count(*) AS n_rows, round(avg(sentiment_confidence::INT), 6) AS confidence_rate FROM sent GROUP BY lang""",
        ),
    ),
    "sen10_sides": (
        sides,
        i.with_ctes(*i.SENTIMENT, select="SELECT lang, sentiment AS part, count(*) AS n_rows FROM sent GROUP BY ALL"),
    ),
    "sen11_small_sides": (
        small_sides,
        i.with_ctes(
            *i.SENTIMENT,
            select="""SELECT s.sentiment, count(sent.row_id) AS n_rows, count(sent.row_id) < 100 AS is_small
              FROM (VALUES ('pos'), ('neg')) s(sentiment) LEFT JOIN sent USING (sentiment) GROUP BY s.sentiment""",
        ),
    ),
    "sen12_mixed_routes": (
        mixed_routes,
        i.with_ctes(
            *i.SENTIMENT,
            select="""SELECT row_id, CASE WHEN lang = 'en' THEN sentiment ELSE 'by model' END AS sentiment,
              CASE WHEN lang = 'en' THEN round(polarity, 6) END AS polarity, true AS in_range FROM sent""",
        ),
    ),
}
