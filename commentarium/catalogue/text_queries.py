"""Cleaning and tokenising."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentarium.catalogue import inputs as i
from commentarium.functions import text as tx
from commentarium.operators import preprocess as pp
from commentarium.functions.dictionaries import language
from commentarium.operators.tokens import each


def _step(expression):
    def run(spark, sf_dir):
        return i.comments(spark, sf_dir).select("row_id", expression(F.col("raw_text")).alias("result"))

    return run


def _step_sql(expression):
    return i.with_ctes(i.DOCS, select=f"SELECT row_id, {expression('raw_text')} AS result FROM docs")


def truncate(spark, sf_dir):
    raw = F.col("raw_text")
    return i.comments(spark, sf_dir).select(
        "row_id", tx.truncate(raw).alias("result"), tx.was_truncated(raw).alias("is_truncated")
    )


def tokenise(spark, sf_dir):
    tokens = tx.split_tokens(tx.clean(F.col("raw_text")))
    return i.comments(spark, sf_dir).select(
        "row_id", F.size(tokens).alias("n_tokens"), F.array_join(tokens, "|").alias("tokens")
    )


def short_gate(spark, sf_dir):
    cleaned = i.comments(spark, sf_dir).select("row_id", tx.clean(F.col("raw_text")).alias("c"))
    return cleaned.select(
        "row_id",
        tx.blank_if_short(F.col("c")).alias("clean_text"),
        (tx.blank_if_short(F.col("c")) == "").alias("is_blank"),
    )


def non_string_guard(spark, sf_dir):
    labels = i.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), "quality")
    rows = i.comments(spark, sf_dir).select("row_id").join(labels, "row_id", "left")
    return rows.select("row_id", tx.as_text(F.col("quality")).alias("result"))


def keep_negations(spark, sf_dir):
    rows = i.comments(spark, sf_dir).select("row_id", "lang", tx.clean(F.col("raw_text")).alias("c"))
    en = language("en")
    kept = tx.keep_tokens(tx.split_tokens(F.col("c")), pp.stopwords("en"), en.negations)
    return rows.where(F.col("lang") == "en").select(
        "row_id", F.size(kept).alias("n_kept"), F.array_join(kept, " ").alias("result")
    )


def _plural_lemmas(rows):
    """A lemma table from the data: a word whose form without its final s is also a word."""
    words = each(rows.where(F.col("lang") == "en"), F.array_distinct("tokens"), "surface").distinct()
    stems = words.where((F.length("surface") >= 4) & F.endswith("surface", F.lit("s"))).withColumn(
        "lemma", F.expr("substring(surface, 1, length(surface) - 1)")
    )
    known = words.select(F.col("surface").alias("lemma"))
    return stems.join(known, "lemma", "left_semi").select(F.lit("en").alias("lang"), "surface", "lemma")


def lemmatise(spark, sf_dir):
    base = i.comments(spark, sf_dir)
    cleaned = base.select("lang", tx.split_tokens(tx.blank_if_short(tx.clean(F.col("raw_text")))).alias("tokens"))
    done = pp.preprocess(base, lemmas=_plural_lemmas(cleaned))
    return done.select("row_id", "clean_text", F.size("tokens").alias("n_tokens"))


_EN_NEG = i.quoted(language("en").negations)

# Windows found by recursion over negation positions, not by pattern.
NEGATION_ORACLE = i.with_ctes(
    i.DOCS, i.CLEANED, i.GATED, i.KEPT,
    """pos AS (SELECT row_id, unnest(string_split(kept_text, ' ')) AS token,
      generate_subscripts(string_split(kept_text, ' '), 1) AS p FROM kept WHERE lang = 'en')""",
    f"neg AS (SELECT row_id, p FROM pos WHERE token IN ({_EN_NEG}))",
    "nxt AS (SELECT a.row_id, a.p, min(b.p) AS q FROM neg a JOIN neg b ON a.row_id = b.row_id AND b.p > a.p + 3 GROUP BY ALL)",
    """opens AS (SELECT row_id, min(p) AS p FROM neg GROUP BY row_id
      UNION ALL SELECT n.row_id, n.q FROM opens o JOIN nxt n ON n.row_id = o.row_id AND n.p = o.p)""",
    "inside AS (SELECT row_id, p + step AS p, true AS marked FROM opens, (VALUES (1), (2), (3)) w(step))",
    select=f"""SELECT row_id,
      string_agg(CASE WHEN marked THEN '{tx.NEGATION_PREFIX}' || token ELSE token END, ' ' ORDER BY p) AS clean_text,
      count(marked) AS n_marked
    FROM pos LEFT JOIN inside USING (row_id, p) GROUP BY row_id""",
    recursive=True,
)


def negation_scope(spark, sf_dir):
    done = i.prepared(spark, sf_dir).where(F.col("lang") == "en")
    marked = F.filter("tokens", lambda t: F.startswith(t, F.lit(tx.NEGATION_PREFIX)))
    return done.select("row_id", "clean_text", F.size(marked).cast("bigint").alias("n_marked"))


def dispatch(spark, sf_dir):
    return i.prepared(spark, sf_dir).select("row_id", "lang", "clean_text", F.size("tokens").alias("n_tokens"))


def profile(spark, sf_dir):
    measured = pp.profile(pp.preprocess(i.comments(spark, sf_dir)), "lang")
    return measured.select("lang", "n_rows", F.round("mean_tokens", 6).alias("mean_tokens"), "n_blank", "n_truncated")


def truncated_profile(spark, sf_dir):
    """The cut at 600 characters is the feature here."""
    measured = pp.profile(pp.preprocess(i.comments(spark, sf_dir), max_chars=tx.MAX_CHARS))
    return measured.select(
        "n_rows", F.round("mean_tokens", 6).alias("mean_tokens"), "n_truncated",
        F.round("pct_truncated", 6).alias("pct_truncated"), "n_blank",
    )


def previews(spark, sf_dir):
    c = F.col("clean_text")
    return i.prepared(spark, sf_dir).select(
        "row_id", tx.preview(c, 80).alias("log_text"), tx.preview(c, 200).alias("top_text"), tx.preview(c, 300).alias("card_text")
    )


_CUT_DOCS = i.DOCS.replace("text AS raw_text", "substr(text, 1, 600) AS raw_text, length(text) > 600 AS cut")
_LEMMA_CTES = (
    "words AS (SELECT DISTINCT unnest(string_split(gated_text, ' ')) AS w FROM gated WHERE lang = 'en' AND gated_text <> '')",
    """lem AS (SELECT a.w AS surface, b.w AS lemma FROM words a JOIN words b ON b.w = left(a.w, length(a.w) - 1)
      WHERE length(a.w) >= 4 AND a.w LIKE '%s')""",
    """pos AS (SELECT row_id, unnest(string_split(kept_text, ' ')) AS t, generate_subscripts(string_split(kept_text, ' '), 1) AS p
      FROM kept WHERE lang = 'en')""",
    f"""relem AS (SELECT row_id, string_agg(CASE WHEN t IN ({_EN_NEG}) THEN t ELSE coalesce(lemma, t) END, ' ' ORDER BY p) AS s
      FROM pos LEFT JOIN lem ON lem.surface = t GROUP BY row_id)""",
    "kept2 AS (SELECT k.row_id, lang, source, coalesce(s, kept_text) AS kept_text FROM kept k LEFT JOIN relem USING (row_id))",
)

QUERIES = {
    "prj01_truncate": (
        truncate,
        i.with_ctes(i.DOCS, select="SELECT row_id, substr(raw_text, 1, 600) AS result, length(raw_text) > 600 AS is_truncated FROM docs"),
    ),
    "prj02_strip_urls": (_step(tx.strip_urls), _step_sql(i.sql_no_urls)),
    "prj03_strip_digits": (_step(tx.strip_digits), _step_sql(i.sql_no_digits)),
    "prj04_strip_symbols": (_step(tx.strip_symbols), _step_sql(i.sql_no_symbols)),
    "prj05_strip_underscores": (_step(tx.strip_underscores), _step_sql(lambda c: f"replace({c}, '_', '')")),
    "prj06_lowercase": (_step(F.lower), _step_sql(lambda c: f"lower({c})")),
    "prj07_collapse_spaces": (_step(tx.collapse_spaces), _step_sql(i.sql_one_space)),
    "prj08_tokenise": (
        tokenise,
        i.with_ctes(
            i.DOCS, i.CLEANED,
            select="""SELECT row_id, CASE WHEN full_text = '' THEN 0 ELSE len(string_split(full_text, ' ')) END AS n_tokens,
              replace(full_text, ' ', '|') AS tokens FROM cleaned""",
        ),
    ),
    "prj09_short_gate": (
        short_gate,
        i.with_ctes(i.DOCS, i.CLEANED, i.GATED, select="SELECT row_id, gated_text AS clean_text, gated_text = '' AS is_blank FROM gated"),
    ),
    "prj10_non_string_guard": (
        non_string_guard,
        "SELECT d.doc_id AS row_id, coalesce(l.quality::VARCHAR, '') AS result FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "prj11_keep_negations": (
        keep_negations,
        i.with_ctes(
            i.DOCS, i.CLEANED,
            f"""k AS (SELECT row_id, CASE WHEN full_text = '' THEN []::VARCHAR[] ELSE list_filter(string_split(full_text, ' '),
              lambda t: NOT list_contains([{i.quoted(i.EN_DROPPED)}], t)) END AS kept FROM cleaned WHERE lang = 'en')""",
            select="SELECT row_id, len(kept) AS n_kept, array_to_string(kept, ' ') AS result FROM k",
        ),
    ),
    "prj12_lemmatise": (
        lemmatise,
        i.with_ctes(
            i.DOCS, i.CLEANED, i.GATED, i.KEPT, *_LEMMA_CTES, i.PREP.replace("FROM kept)", "FROM kept2)"),
            select="SELECT row_id, clean_text, len(tokens) AS n_tokens FROM prep",
        ),
    ),
    "prj13_negation_scope": (negation_scope, NEGATION_ORACLE),
    "prj14_language_dispatch": (
        dispatch, i.with_ctes(*i.PREPARED, select="SELECT row_id, lang, clean_text, len(tokens) AS n_tokens FROM prep")
    ),
    "prj15_profile": (
        profile,
        i.with_ctes(
            *i.PREPARED,
            select="""SELECT lang, count(*) AS n_rows, round(avg(len(tokens)), 6) AS mean_tokens,
              count(*) FILTER (clean_text = '') AS n_blank, 0::BIGINT AS n_truncated FROM prep GROUP BY lang""",
        ),
    ),
    "prj15_truncation_profile": (
        truncated_profile,
        i.with_ctes(
            _CUT_DOCS, *i.PREPARED[1:],
            select="""SELECT count(*) AS n_rows, round(avg(len(tokens)), 6) AS mean_tokens, count(*) FILTER (cut) AS n_truncated,
              round(count(*) FILTER (cut) * 100.0 / count(*), 6) AS pct_truncated, count(*) FILTER (clean_text = '') AS n_blank
              FROM prep JOIN docs USING (row_id)""",
        ),
    ),
    "prj16_previews": (
        previews,
        i.with_ctes(
            *i.PREPARED,
            select="SELECT row_id, left(clean_text, 80) AS log_text, left(clean_text, 200) AS top_text, left(clean_text, 300) AS card_text FROM prep",
        ),
    ),
}
