"""Comment preparation: ``raw_text`` to ``clean_text`` and ``tokens``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.functions import text as tx
from commentarium.functions.dictionaries import LANGUAGES, stopwords
from commentarium.operators.joins import lookup_join
from commentarium.operators.tokens import each

# Fields the stage adds, in order.
ADDED = ("clean_text", "tokens", "is_blank", "is_truncated")


def _by_language(lang: Column, default: Column, build) -> Column:
    """``build(language)`` for rows of a lexicon language, ``default`` for the rest."""
    choice = None
    for entry in LANGUAGES:
        if entry.scorer != "lexicon":
            continue
        value = build(entry)
        choice = F.when(lang == entry.code, value) if choice is None else choice.when(lang == entry.code, value)
    return default if choice is None else choice.otherwise(default)


def kept_text(cleaned: Column, lang: Column) -> Column:
    """Stopwords out, negations kept, for lexicon languages; other languages unchanged."""
    return _by_language(
        lang,
        cleaned,
        lambda l: F.array_join(tx.keep_tokens(tx.split_tokens(cleaned), stopwords(l.code), l.negations), " "),
    )


def negated_text(kept: Column, lang: Column) -> Column:
    return _by_language(lang, kept, lambda l: tx.mark_negations(kept, l.negations) if l.marks_negation else kept)


def lemmatise(
    df: DataFrame, lemmas: DataFrame, text: str = "clean_text", lang: str = "lang", row_id: str = "row_id"
) -> DataFrame:
    """Replace each token of ``text`` by its lemma from ``lemmas(lang, surface, lemma)``.

    Negation words keep their surface form. Tokens are looked up exploded and put
    back in order per row. When the frame is hash-partitioned by ``row_id`` both
    the regrouping and the join back reuse that partitioning.
    """
    routes = [l for l in LANGUAGES if l.scorer == "lexicon"]
    codes = [l.code for l in routes]
    exploded = each(
        df.where(F.col(lang).isin(codes)), tx.split_tokens(F.col(text)), "surface", row_id, lang, position="pos"
    )
    # One lemma per surface form, whatever the table holds.
    unique = lemmas.groupBy(lang, "surface").agg(F.min("lemma").alias("lemma"))
    found = lookup_join(exploded, unique, [lang, "surface"], "left", spread_by=row_id)
    negation = F.lit(False)
    for l in routes:
        if l.negations:
            negation = negation | ((F.col(lang) == l.code) & F.col("surface").isin(list(l.negations)))
    token = F.when(negation, F.col("surface")).otherwise(F.coalesce("lemma", "surface"))
    regrouped = (
        found.groupBy(row_id)
        .agg(F.array_sort(F.collect_list(F.struct("pos", token.alias("token")))).alias("_kept"))
        .select(row_id, F.array_join(F.col("_kept.token"), " ").alias("_lemmatised"))
    )
    return (
        df.join(regrouped, row_id, "left")
        .withColumn(text, F.coalesce("_lemmatised", text))
        .drop("_lemmatised")
    )


def preprocess(
    df: DataFrame,
    text: str = "raw_text",
    lang: str = "lang",
    max_chars: int | None = None,
    any_case_urls: bool = False,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Add ``clean_text``, ``tokens``, ``is_blank`` and ``is_truncated``.

    Rows of fewer than two tokens stay, blank. The gate looks at the cleaned text
    before stopwords go, so a lexicon-language row may still end with no tokens.
    Without ``lemmas`` this is one projection: no shuffle.
    """
    raw = tx.as_text(F.col(text))
    truncated = tx.was_truncated(raw, max_chars) if max_chars is not None else F.lit(False)
    staged = df.withColumn("is_truncated", truncated).withColumn(
        "clean_text", tx.blank_if_short(tx.clean(F.col(text), max_chars, any_case_urls))
    )
    staged = staged.withColumn("clean_text", kept_text(F.col("clean_text"), F.col(lang)))
    if lemmas is not None:
        staged = lemmatise(staged, lemmas, "clean_text", lang)
    staged = staged.withColumn("clean_text", negated_text(F.col("clean_text"), F.col(lang)))
    return staged.select(
        *df.columns,
        "clean_text",
        tx.split_tokens(F.col("clean_text")).alias("tokens"),
        (F.col("clean_text") == "").alias("is_blank"),
        "is_truncated",
    )


def profile(df: DataFrame, *by: str) -> DataFrame:
    """Row count, mean token count and truncations, in one aggregate."""
    measured = df.groupBy(*by) if by else df.groupBy()
    return measured.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.avg(F.size("tokens")), F.lit(0.0)).alias("mean_tokens"),
        F.count_if("is_truncated").alias("n_truncated"),
        F.coalesce(F.count_if("is_truncated") * 100.0 / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias(
            "pct_truncated"
        ),
        F.count_if("is_blank").alias("n_blank"),
    )
