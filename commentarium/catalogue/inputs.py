"""Inputs the registered queries share, each with its SQL twin.

Every frame here is a whole table, or derived by Spark from whole tables. The SQL
is plain DuckDB text for the correctness check; it never runs in a job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.functions.dictionaries import LANGUAGE_CODES, language, stopwords
from commentarium.functions.text import NEGATION_PREFIX
from commentarium.operators.preprocess import preprocess
from commentarium.operators.sentiment import FREQUENCY, analyse_sentiment, lexicon_labels, merge_lexicons
from commentarium.operators.storage import spread
from commentarium.operators.tokens import each

MIN_TOKEN_DOCS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL helpers -----------------------------------------------------------------


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def with_ctes(*ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select


SQL_SPACE = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
SQL_URL = rf"(https?://|www\.)[^{SQL_SPACE}]+"


def sql_no_urls(c: str) -> str:
    return f"regexp_replace({c}, '{SQL_URL}', '', 'g')"


def sql_no_digits(c: str) -> str:
    return rf"regexp_replace({c}, '\p{{Nd}}+', '', 'g')"


def sql_no_symbols(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}\p{{N}}_{SQL_SPACE}]', '', 'g')"


def sql_one_space(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SQL_SPACE}]+', ' ', 'g'))"


def sql_clean(c: str) -> str:
    return sql_one_space(f"lower(replace({sql_no_symbols(sql_no_digits(sql_no_urls(c)))}, '_', ''))")


_EN = language("en")
EN_DROPPED = [w for w in stopwords("en") if w not in _EN.negations]
_NEGATION = "|".join(_EN.negations)

DOCS = "docs AS (SELECT doc_id AS row_id, text AS raw_text, lang, source FROM documents)"
CLEANED = f"cleaned AS (SELECT row_id, lang, source, {sql_clean('raw_text')} AS full_text FROM docs)"
GATED = """gated AS (SELECT row_id, lang, source,
  CASE WHEN strpos(full_text, ' ') = 0 THEN '' ELSE full_text END AS gated_text FROM cleaned)"""
KEPT = f"""kept AS (SELECT row_id, lang, source, CASE WHEN lang = 'en' THEN
  array_to_string(list_filter(string_split(gated_text, ' '), lambda t: NOT list_contains([{quoted(EN_DROPPED)}], t)), ' ')
  ELSE gated_text END AS kept_text FROM gated)"""
PREP = f"""prep AS (SELECT row_id, lang, source, clean_text,
  CASE WHEN clean_text = '' THEN []::VARCHAR[] ELSE string_split(clean_text, ' ') END AS tokens
  FROM (SELECT row_id, lang, source, CASE WHEN lang = 'en' THEN
    ltrim(regexp_replace(regexp_replace(' ' || kept_text || ' ~ ~ ~',
      ' ({_NEGATION}) ([^ ]+) ([^ ]+) ([^ ]+)',
      ' \\1 {NEGATION_PREFIX}\\2 {NEGATION_PREFIX}\\3 {NEGATION_PREFIX}\\4', 'g'),
      ' ({NEGATION_PREFIX})?~', '', 'g'))
    ELSE kept_text END AS clean_text FROM kept))"""
PREPARED = (DOCS, CLEANED, GATED, KEPT, PREP)

TOKS = "toks AS (SELECT row_id, lang, unnest(tokens) AS token FROM prep)"
STOPS = "stops(lang, token) AS (VALUES " + ", ".join(
    f"({quoted([code, word])})" for code in LANGUAGE_CODES for word in stopwords(code)
) + ")"


# --- Comments ----------------------------------------------------------------------


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("raw_text"), "lang", "source"))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, lang, source, clean_text, tokens) over whole texts."""
    return preprocess(comments(spark, sf_dir)).select("row_id", "lang", "source", "clean_text", "tokens")


# --- Lexicons derived from the data ------------------------------------------------
# Words in at least five comments; a hex digit of the word's MD5 sets the valence.


def _digit_valence(place: int, size: float) -> Column:
    digit = F.substring(F.md5("token"), place, 1)
    return F.when(digit <= "5", size).when(digit <= "9", -size)


def lexicon(prepared_rows: DataFrame) -> DataFrame:
    words = (
        each(prepared_rows, F.array_distinct("tokens"), "token")
        .where(~F.startswith("token", F.lit(NEGATION_PREFIX)))
        .groupBy("token")
        .agg(F.count("*").alias("n_docs"))
        .where(F.col("n_docs") >= MIN_TOKEN_DOCS)
    )
    valences = _digit_valence(1, 2.0).alias("valence_1"), _digit_valence(2, 0.5).alias("valence_2")
    return words.select("token", *valences, F.col("n_docs").alias(FREQUENCY))


def _sql_digit(place: int, size: float) -> str:
    digit = f"substr(md5(token), {place}, 1)"
    return f"CASE WHEN {digit} <= '5' THEN {size} WHEN {digit} <= '9' THEN -{size} END::DOUBLE"


LEX = f"""lex AS (SELECT token, {_sql_digit(1, 2.0)} AS valence_1, {_sql_digit(2, 0.5)} AS valence_2
  FROM (SELECT token, count(DISTINCT row_id) AS n_docs FROM toks
        WHERE NOT starts_with(token, '{NEGATION_PREFIX}') GROUP BY token)
  WHERE n_docs >= {MIN_TOKEN_DOCS})"""
SCORES = """hits AS (SELECT row_id, coalesce(sum(valence_1), 0) AS s, coalesce(avg(valence_2), 0) AS score_2
  FROM toks JOIN lex USING (token) GROUP BY row_id),
scores AS (SELECT p.row_id, p.lang, p.source, p.clean_text, p.tokens,
  coalesce(s / sqrt(s * s + 15), 0) AS score_1, coalesce(score_2, 0) AS score_2
  FROM prep p LEFT JOIN hits USING (row_id))"""
SENT = """sent AS (SELECT row_id, lang, source, clean_text, tokens,
  CASE WHEN trim(clean_text) = '' OR score_1 < 0.05 THEN 'neg' ELSE 'pos' END AS sentiment,
  CASE WHEN trim(clean_text) = '' THEN 0 ELSE score_1 END AS polarity,
  trim(clean_text) <> '' AND (score_1 >= 0.05) = (score_2 >= 0.05) AS sentiment_confidence
  FROM scores)"""
LEXICAL = (*PREPARED, TOKS, LEX, SCORES)
SENTIMENT = (*LEXICAL, SENT)


def with_sentiment(prepared_rows: DataFrame) -> DataFrame:
    return analyse_sentiment(prepared_rows, lexicon(prepared_rows))


def labels(prepared_rows: DataFrame, *carry: str) -> DataFrame:
    """The same labels on narrow rows, with no join back to the texts."""
    return lexicon_labels(prepared_rows, lexicon(prepared_rows), carry)


# --- Rows with vectors, given topics and flags ---------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("row_id"), F.col("label").alias("topic_id"), "embedding")


VECS = "vecs AS (SELECT vec_id AS row_id, label AS topic_id, embedding::DOUBLE[] AS v FROM embeddings)"


def with_given_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prepared comments; topic from the vector table (none: noise), side from the labels."""
    topics = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("topic_id"))
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    rows = prepared(spark, sf_dir).join(topics, "row_id", "left").join(quality, "row_id", "left")
    return rows.select(
        "row_id", "lang", "source", "clean_text", "tokens",
        F.coalesce("topic_id", F.lit(-1)).alias("topic_id"),
        F.when(F.col("quality") == 1, "pos").otherwise("neg").alias("sentiment"),
    )


GIVEN = """given AS (SELECT p.row_id, p.lang, p.source, p.clean_text, p.tokens, coalesce(e.label, -1) AS topic_id,
  CASE WHEN l.quality = 1 THEN 'pos' ELSE 'neg' END AS sentiment
  FROM prep p LEFT JOIN embeddings e ON e.vec_id = p.row_id LEFT JOIN labels l ON l.doc_id = p.row_id)"""
GIVEN_TOPICS = (*PREPARED, GIVEN)


def merged_lexicons(spark: SparkSession, prepared_rows: DataFrame) -> DataFrame:
    """The same lexicon as two user tables (token, valence), merged."""
    both = lexicon(prepared_rows)
    first = both.where(F.col("valence_1").isNotNull()).select("token", F.col("valence_1").alias("valence"))
    second = both.where(F.col("valence_2").isNotNull()).select("token", F.col("valence_2").alias("valence"))
    return merge_lexicons(first, second)
