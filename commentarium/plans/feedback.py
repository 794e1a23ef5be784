"""The whole analysis of one comment table, end to end."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.operators import charts, embed, outliers, search, sentiment, summary, topics
from commentarium.operators.density import cluster_density
from commentarium.operators.layout import neighbour_layout
from commentarium.operators.preprocess import preprocess
from commentarium.operators.storage import clear_scratch, cut_lineage, stage
from commentarium.sources.languages import require_supported
from commentarium.sources.sinks import write_run


@dataclass(frozen=True)
class Feedback:
    """The staged results: ``rows`` are the clean comments, ``outliers`` the rest.

    Every other table is derived when it is first asked for, and once.
    """

    rows: DataFrame
    outliers: DataFrame
    topics: DataFrame

    @cached_property
    def _everything(self) -> DataFrame:
        return self.rows.withColumn("is_outlier", F.lit(False)).unionByName(
            self.outliers.withColumn("is_outlier", F.lit(True)), allowMissingColumns=True
        )

    @cached_property
    def _n_outliers(self) -> int:
        return self.outliers.count()

    @cached_property
    def top_texts(self) -> DataFrame:
        return search.top_similar_texts(self.rows)

    @cached_property
    def similarity(self) -> DataFrame:
        return search.similarity_spread(self.rows)

    @cached_property
    def kpi_by_language(self) -> DataFrame:
        return summary.kpis(self._everything, "lang")

    @cached_property
    def kpi(self) -> DataFrame:
        return summary.kpis(self._everything)

    @cached_property
    def breakdown(self) -> DataFrame:
        return summary.breakdown(self.kpi)

    @cached_property
    def headlines(self) -> DataFrame:
        return summary.headline_topics(self.topics)

    @cached_property
    def cards(self) -> DataFrame:
        return summary.topic_cards(self.rows)

    @cached_property
    def topic_points(self) -> DataFrame:
        return charts.scatter_points(self.rows)

    @cached_property
    def concept_points(self) -> DataFrame:
        sampled = charts.sample_points(self.rows.where(F.col("x").isNotNull()))
        return sampled.select("row_id", "x", "y", "concept_similarity", "sentiment", "clean_text")

    @cached_property
    def concept_scale(self) -> DataFrame:
        return charts.colour_scale(self.concept_points)

    @cached_property
    def word_weights(self) -> DataFrame:
        return charts.word_weights(self._everything.withColumn("part", charts.part_of("is_outlier", "sentiment")))

    @cached_property
    def unigrams(self) -> DataFrame:
        return charts.ngram_counts(self.outliers, 1, n_rows=self._n_outliers)

    @cached_property
    def bigrams(self) -> DataFrame:
        return charts.ngram_counts(self.outliers, 2, n_rows=self._n_outliers)

    @cached_property
    def trigrams(self) -> DataFrame:
        return charts.ngram_counts(self.outliers, 3, n_rows=self._n_outliers)

    def write(self, root: str, run_id: str, parameters: dict | None = None, file_format: str = "parquet") -> str:
        return write_run({name: getattr(self, name) for name in TABLES}, root, run_id, parameters, file_format)

    def release(self) -> None:
        """Drop what this process has staged; the tables of this result cannot be read any more."""
        clear_scratch(self.rows.sparkSession)


TABLES = (
    "rows", "outliers", "topics", "top_texts", "similarity", "kpi", "kpi_by_language", "breakdown", "headlines", "cards",
    "topic_points", "concept_points", "concept_scale", "word_weights", "unigrams", "bigrams", "trigrams",
)


def _cluster_side(side: str, vectors: DataFrame, labels: DataFrame, method: str) -> DataFrame:
    cluster = {"kmeans": topics.cluster_kmeans, "density": cluster_density}[method]
    points = _side_points(side, vectors, labels)
    return cluster(points).withColumn("sentiment", F.lit(side)).select("row_id", "sentiment", "topic_id")


def _side_points(side: str, vectors: DataFrame, labels: DataFrame) -> DataFrame:
    members = labels.where(F.col("sentiment") == side).select("row_id")
    return members.join(vectors.select("row_id", "components"), "row_id")


def _name_topics(
    given: DataFrame, full: DataFrame, coded: DataFrame, merge_at: float | None, diversity: float | None
) -> tuple[DataFrame, DataFrame]:
    """(topic table, row_id with its final topic) for every clustered side at once."""
    counts = topics.topic_token_counts(full.drop("sentiment").join(given, "row_id"))
    if merge_at is not None:
        counts = cut_lineage(counts)
        mapping = topics.merge_map(topics.topic_word_weights(counts), topics.topic_sizes(given), merge_at)
        given = stage(topics.apply_merge(given, mapping), partitioned=True)
        merged = topics.apply_merge(counts, mapping, spread_by="token")
        counts = merged.groupBy(*topics.TOPIC_KEYS, "token").agg(F.sum("tf").alias("tf"))
    weights = topics.topic_word_weights(counts)
    if diversity is None:
        top = topics.top_words(weights)
    else:
        held = full.join(given.drop("sentiment"), "row_id").join(coded, "row_id")
        top = topics.diversify_words(topics.top_words(weights, topics.CANDIDATES), held, diversity=diversity)
    # A row per topic: at most ten a side.
    return cut_lineage(topics.topic_table(top, topics.topic_sizes(given)).coalesce(1)), given


def analyse(
    comments: DataFrame,
    lexicon: DataFrame | Callable[[DataFrame], DataFrame],
    *,
    concept: str = search.DEFAULT_CONCEPT,
    contamination: float = outliers.DEFAULT_CONTAMINATION,
    encode: embed.Encode | None = None,
    predict: Callable[[DataFrame], DataFrame] | None = None,
    lemmas: DataFrame | None = None,
    max_chars: int | None = None,
    outlier_method: str = "forest",
    merge_at: float | None = topics.MERGE_SIMILARITY,
    diversity: float | None = None,
    topic_method: str = "kmeans",
    layout: str = "axes",
    keys: Sequence[str] = ("token",),
    labelled: DataFrame | None = None,
    cache: str | None = None,
    cache_id: str | None = None,
) -> Feedback:
    """Analyse ``comments(row_id, lang, raw_text, …)``.

    ``lexicon`` is a table from ``merge_lexicons``, or a function of the prepared
    rows. ``encode`` adds ``embedding`` (default: hashed TF-IDF fitted here),
    ``predict`` adds ``probabilities`` for languages of the model route; with
    ``labelled(row_id, label)`` instead, the built-in classifier is fitted on those
    rows and serves it. With neither, every language takes the lexicon route.
    ``cache`` is a folder of vectors kept from run to run: each distinct text is then
    encoded once ever per ``cache_id``, which names a given ``encode`` (the built-in
    encoder is named by its fitted weights). ``topic_method`` is ``kmeans`` or ``density``;
    ``layout`` places rows by the two widest ``axes`` of all vectors, or each side
    by its ``neighbours``.

    Rows are laid out by ``row_id`` once. After that, joining scores, labels and
    topics to texts is a join of staged tables with equal buckets, and only
    words, topics and copies of a text are ever shuffled.
    """
    outliers.check_contamination(contamination)
    require_supported(comments)
    if topic_method not in ("kmeans", "density") or layout not in ("axes", "neighbours"):
        raise ValueError(f"Topics by {topic_method!r} or a layout by {layout!r} are not on offer.")

    prepared = preprocess(comments, max_chars=max_chars, lemmas=lemmas)
    if encode is None or cache is not None:
        texts = stage(prepared)
        if encode is None:
            model = embed.fit_hashed_encoder(texts)
            encode = lambda df: embed.hashed_vectors(df, model)
            cache_id = embed.model_fingerprint(model)
        elif cache_id is None:
            raise ValueError("A cache for your own encoder needs a cache_id that names it.")
        if cache is None:
            coded = stage(encode(texts).select("row_id", "embedding"), partitioned=True)
        else:
            coded = stage(embed.cached_vectors(texts, cache, cache_id, encode).select("row_id", "embedding"))
    else:
        both = stage(encode(prepared))
        texts = both.drop("embedding")
        coded = both.select("row_id", "embedding")
    if predict is None and labelled is not None:
        classifier = sentiment.fit_classifier(texts.join(labelled.select("row_id", "label"), "row_id"))
        predict = lambda df: sentiment.classify(df, classifier)

    # Outliers: two model fits over vectors, one scoring pass.
    reduction = outliers.fit_reduction(coded)
    if reduction is None:
        vectors = coded.withColumns(
            {"components": F.array(F.lit(0.0)), "outlier_score": F.lit(0.0), "is_outlier": F.lit(False)}
        )
    else:
        reduced = outliers.reduce_vectors(coded, reduction)
        if outlier_method == "forest":
            forest, sample_size = outliers.grow_forest(reduced)
            scored = outliers.forest_scores(reduced, forest, sample_size)
        else:
            scored = outliers.centroid_distances(reduced)
        scored = scored.select("row_id", "components", "outlier_score")
        vectors = outliers.flag_outliers(stage(scored, partitioned=True), contamination, stored=True)
    flags = vectors.select("row_id", "outlier_score", "is_outlier")

    # Sentiment and similarity of clean rows.
    lexicon = lexicon(texts) if callable(lexicon) else lexicon
    clean = texts.join(flags.where(~F.col("is_outlier")).select("row_id"), "row_id", "left_semi")
    if predict is None:
        labelled = sentiment.lexicon_labels(clean, lexicon, ("lang",), keys=keys)
    else:
        labelled = sentiment.analyse_sentiment(clean, lexicon, predict, keys)
    target = embed.encode_phrase(comments, concept, encode)
    similar = search.add_similarity(coded, target).select("row_id", "concept_similarity")
    labels = stage(
        labelled.select("row_id", "lang", "sentiment", "polarity", "sentiment_confidence").join(similar, "row_id"),
        partitioned=True,
    )

    # Topics, each side on its own.
    sizes = {r["sentiment"]: r["n_rows"] for r in sentiment.side_sizes(labels).collect()}
    placed = vectors.select(
        "row_id",
        F.get("components", F.lit(0)).alias("x"),
        F.coalesce(F.get("components", F.lit(1)), F.lit(0.0)).alias("y"),
    )
    full = texts.join(labels.drop("lang"), "row_id")
    large = [s for s in sentiment.SIDES if sizes[s] >= sentiment.MIN_SIDE_ROWS]
    parts = [
        topics.fallback_topics(full.where(F.col("sentiment") == s)) for s in sentiment.SIDES if s not in large
    ]
    topic_list = _no_topics(comments)
    if large:
        given = reduce(DataFrame.unionByName, [_cluster_side(s, vectors, labels, topic_method) for s in large])
        if layout == "neighbours":
            laid = [neighbour_layout(_side_points(s, vectors, labels)) for s in large]
            placed = stage(reduce(DataFrame.unionByName, laid))
        topic_list, given = _name_topics(stage(given), full, coded, merge_at, diversity)
        marked = topics.mark_representatives(given.join(coded, "row_id")).drop("embedding", "sentiment")
        named = topics.attach_topics(full.join(marked, "row_id"), topic_list)
        parts.append(named.join(placed, "row_id"))
    rows = reduce(DataFrame.unionByName, parts)

    # Every part is laid out by row_id already: writing it needs no shuffle.
    removed = texts.join(flags.where("is_outlier"), "row_id")
    return Feedback(rows=stage(rows, partitioned=True), outliers=removed, topics=topic_list)


def _no_topics(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [], "sentiment string, topic_id int, n_rows bigint, keywords string, label string"
    )
