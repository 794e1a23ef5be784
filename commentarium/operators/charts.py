"""Chart-ready tables: points, n-grams and word weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentarium.functions.dictionaries import is_stopword, stopword_condition
from commentarium.functions.keys import SEED, shuffled_key
from commentarium.functions.text import ngrams
from commentarium.operators.joins import lookup_join
from commentarium.operators.storage import cut_lineage
from commentarium.operators.tokens import each
from commentarium.operators.topics import NOISE, TOPIC_KEYS

# Fixed values.
MAX_POINTS = 1000
MARK_SHAPES = 6
PALETTE_SIZE = 10
REPRESENTATIVE_SIZE = 10
NORMAL_SIZE = 7
NOISE_LEGEND = "Noise (-1)"
NGRAM_TOP_N = 10
MIN_DOCS = 2
MAX_DOC_SHARE = 0.9
CLOUD_WORDS = 200


# --- Points ------------------------------------------------------------------------


def combine_sides(pos: DataFrame, neg: DataFrame) -> DataFrame:
    return pos.unionByName(neg, allowMissingColumns=True)


def _chosen_rows(df: DataFrame, chosen: DataFrame, row_id: str) -> DataFrame:
    """The rows whose ids were chosen. ``chosen`` holds at most one chart of ids."""
    return df.join(F.broadcast(cut_lineage(chosen.select(row_id))), row_id, "left_semi")


def sample_points(df: DataFrame, n: int = MAX_POINTS, row_id: str = "row_id", seed: int = SEED) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same ones whatever the partitioning.

    Only ids and hashes compete; texts of rows not drawn never move.
    """
    ranked = df.select(row_id).orderBy(shuffled_key(F.col(row_id), seed), row_id).limit(n)
    return _chosen_rows(df, ranked, row_id)


def sample_with_representatives(
    df: DataFrame,
    n: int = MAX_POINTS,
    row_id: str = "row_id",
    representative: str = "representative_doc",
    seed: int = SEED,
) -> DataFrame:
    """At most ``n`` rows: representatives first (in row order), hashed others after."""
    rep = F.col(representative)
    key = F.when(~rep, shuffled_key(F.col(row_id), seed))
    ranked = df.select(row_id, representative).orderBy(F.desc(representative), key, row_id).limit(n)
    return _chosen_rows(df, ranked, row_id)


def topic_series(
    topics: DataFrame, keys: Sequence[str] = TOPIC_KEYS, colours: int = PALETTE_SIZE, shapes: int = MARK_SHAPES
) -> DataFrame:
    """(keys, series_idx, colour_idx, shape_idx, legend) for a topic list.

    Real topics are numbered in key order; noise has slot -1. One row per topic,
    so the unpartitioned rank sees a handful of rows.
    """
    keys = list(keys)
    listed = topics.select(*keys).distinct()
    real = listed.where(F.col(keys[-1]) != NOISE)
    ranked = real.withColumn("series_idx", (F.dense_rank().over(Window.orderBy(*keys)) - 1).cast("int"))
    noise = listed.where(F.col(keys[-1]) == NOISE).withColumn("series_idx", F.lit(NOISE))
    both = ranked.unionByName(noise)
    is_noise = F.col("series_idx") == NOISE
    return both.select(
        *keys,
        "series_idx",
        F.when(is_noise, NOISE).otherwise(F.pmod("series_idx", F.lit(colours))).cast("int").alias("colour_idx"),
        F.when(is_noise, NOISE).otherwise(F.pmod("series_idx", F.lit(shapes))).cast("int").alias("shape_idx"),
        F.when(is_noise, NOISE_LEGEND).otherwise(F.concat_ws(" ", F.lit("Topic"), *keys)).alias("legend"),
    )


def point_size(representative: Column) -> Column:
    return F.when(representative, REPRESENTATIVE_SIZE).otherwise(NORMAL_SIZE)


def has_coordinates(df: DataFrame, x: str = "x") -> DataFrame:
    """One row: whether a scatter can be drawn at all."""
    return df.agg((F.count(x) > 0).alias("has_coordinates"), F.count(x).alias("n_points"))


def scatter_points(
    df: DataFrame, n: int = MAX_POINTS, row_id: str = "row_id", keys: Sequence[str] = TOPIC_KEYS
) -> DataFrame:
    """The topic scatter: sampled points with series, shape and size. Empty without x."""
    points = sample_with_representatives(df.where(F.col("x").isNotNull()), n, row_id)
    return (
        lookup_join(points, topic_series(points, keys), list(keys), "left", small=True)
        .withColumn("point_size", point_size(F.col("representative_doc")))
    )


def colour_scale(sampled: DataFrame, score: str = "concept_similarity") -> DataFrame:
    return sampled.agg(F.min(score).alias("low"), F.max(score).alias("high"), F.count(score).alias("n_points"))


# --- N-grams -----------------------------------------------------------------------


def ngram_counts(
    df: DataFrame,
    n: int,
    top: int = NGRAM_TOP_N,
    tokens: str = "tokens",
    lang: str = "lang",
    min_docs: int = MIN_DOCS,
    max_doc_share: float = MAX_DOC_SHARE,
    n_rows: int | None = None,
) -> DataFrame:
    """(gram, n_total, n_docs): top n-grams by total count over distributed counts.

    Stopwords and one-character tokens go before n-grams form. A gram must be in
    ``min_docs`` rows and at most ``max_doc_share`` of all rows, blank ones
    included. A row's grams are sorted, and the first of each run also counts for the
    row, so both figures are plain sums: one shuffle, no count-distinct, every gram
    emitted once.
    """
    kept = F.expr(
        f"filter(transform({tokens}, t -> lower(t)), t -> length(t) >= 2 AND NOT {stopword_condition(lang, 't')})"
    )
    if n_rows is None:
        n_rows = df.count()
    grams = df.select(ngrams(kept, n).alias("g"))
    ordered = grams.select(F.array_sort("g").alias("g"))
    marked = F.transform(
        "g", lambda g, k: F.struct(g.alias("gram"), ((k == 0) | (F.get("g", k - 1) != g)).cast("int").alias("first"))
    )
    return (
        each(ordered, marked, "e")
        .groupBy(F.col("e.gram").alias("gram"))
        .agg(F.count("*").alias("n_total"), F.sum("e.first").alias("n_docs"))
        .where((F.col("n_docs") >= min_docs) & (F.col("n_docs") <= F.lit(max_doc_share * n_rows)))
        .orderBy(F.desc("n_total"), "gram")
        .limit(top)
    )


# --- Word weights ------------------------------------------------------------------


def part_of(is_outlier: str = "is_outlier", side: str = "sentiment") -> Column:
    """The part of the data a row's words are weighed in: outliers, positive or negative."""
    return F.when(F.col(is_outlier), "outliers").when(F.col(side) == "pos", "positive").otherwise("negative")


def word_weights(
    df: DataFrame,
    part: str = "part",
    tokens: str = "tokens",
    lang: str = "lang",
    top: int = CLOUD_WORDS,
    extra_stopwords: Sequence[str] = (),
) -> DataFrame:
    """(part, token, n, weight, place): the commonest words of each part of the data, of two characters or more.

    All parts in one pass. The weight is the count over the part's largest count,
    taken after the per-part limit, so no window ever spans a vocabulary.
    """
    exploded = each(df, tokens, "_t", part, lang).withColumn("token", F.lower("_t"))
    stop = is_stopword(lang, "token")
    if extra_stopwords:
        stop = stop | F.col("token").isin(list(extra_stopwords))
    counts = exploded.where(~stop & (F.length("token") >= 2)).groupBy(part, "token").agg(F.count("*").alias("n"))
    order = Window.partitionBy(part).orderBy(F.desc("n"), "token")
    kept = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    largest = F.max("n").over(Window.partitionBy(part))
    return kept.select(part, "token", "n", (F.col("n") / largest).alias("weight"), "place")
