"""Topics per sentiment side: clustering, keywords, names, representatives.

A topic's key is (sentiment, topic_id), because each side numbers its own topics
from 0; -1 is noise. There are at most ten topics a side, so a topic may hold a
large part of all rows: every per-topic figure is an algebraic aggregate merged
map-side or a top-k with a map-side limit, never a gathered group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentarium.functions.dictionaries import is_stopword
from commentarium.functions.keys import SEED
from commentarium.functions.vectors import SCORE_DIGITS, cosine, distance, literal, mean_vector, norm
from commentarium.operators.components import connected_components
from commentarium.operators.joins import lookup_join, small_table
from commentarium.operators.naming import GENERAL, SEPARATOR, topic_name
from commentarium.operators.storage import cut_lineage, staged_columns
from commentarium.operators.tokens import each

# Fixed values.
NOISE = -1
KEYWORDS = 10
FALLBACK_KEYWORDS = 20
FALLBACK_LABEL = "word_frequency_fallback"
DIVERSITY = 0.7

MERGE_SIMILARITY = 0.9

MAX_TOPICS = 10  # follows from the minimum cluster size of a tenth
CANDIDATES = 30
MAX_WANTED_WORDS = 10_000
MIN_WORD_CHARS = 2
NOISE_WIDTH = 3 * 1.4826  # three standard deviations, if distances were normal
GAP_BINS = 4_096
FIXED_POINT = float(1 << 24)
TOPIC_KEYS = ("sentiment", "topic_id")

# Decimal literals that put a whole-number id below another number.
_PACK = "1" + "0" * 20 + "BD"
_SHIFT = f"{2**63}BD"

# Columns both paths add, in order.
TOPIC_COLUMNS = ("topic_id", "topic_label", "topic_keywords", "x", "y", "representative_doc")


def topic_path(sizes: DataFrame) -> DataFrame:
    """(sentiment, n_rows, path): how each side's topics are found."""
    path = F.when(F.col("is_small"), FALLBACK_LABEL).otherwise("clusters")
    return sizes.select("sentiment", "n_rows", path.alias("path"))


def min_cluster_rows(n: int) -> int:
    return max(10, n // 10)


# --- Clustering ------------------------------------------------------------------


def drop_small_clusters(df: DataFrame, min_rows: int, cluster: str = "cluster", out: str = "topic_id") -> DataFrame:
    """Renumber clusters by size, largest first (ties: lower id); small ones are noise.

    At most ``n / min_rows`` clusters survive, which bounds the renumbering table.
    """
    sizes = df.where(F.col(cluster) != NOISE).groupBy(cluster).agg(F.count("*").alias("n"))
    kept = sizes.where(F.col("n") >= min_rows)
    ranked = kept.withColumn(out, F.row_number().over(Window.orderBy(F.desc("n"), cluster)) - 1).drop("n")
    return lookup_join(df, ranked, cluster, "left", small=True).withColumn(out, F.coalesce(out, F.lit(NOISE)).cast("int"))


def _unit_rows(batch) -> np.ndarray:
    """The batch's vectors as rows of length one; zero vectors stay zero."""
    column = batch.column("v")
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(length > 0, length, 1.0)


def _whole(values: np.ndarray) -> np.ndarray:
    """Fixed-point whole numbers: their sums do not hang on the order of rows."""
    return np.round(values * FIXED_POINT).astype(np.int64)


def _draw_seeds(points: DataFrame, count: int, seed: int) -> np.ndarray:
    """Up to ``count`` distinct points, each drawn in proportion to its squared distance from those before.

    The draw of Arthur & Vassilvitskii (2007) as a race: the least
    -ln(u) / distance wins, u being a hash of the row's id and the round. The first k
    seeds serve every k, and no partitioning changes them.
    """
    chosen: list[list[float]] = []
    for turn in range(count):
        fixed = np.array(chosen)

        def gaps(batches, fixed=fixed):
            for batch in batches:
                rows = _unit_rows(batch)
                near = np.full(len(rows), 1.0)
                if len(fixed):
                    near = np.maximum(0.0, 2.0 - 2.0 * np.round(rows @ fixed.T, SCORE_DIGITS)).min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key"), pa.array(near), pa.array(list(rows), pa.list_(pa.float64()))], ["key", "gap", "u"]
                )

        drawn = points.mapInArrow(gaps, "key bigint, gap double, u array<double>").where(F.col("gap") > 1e-6)
        unit = (F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "key"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        best = drawn.select("key", "u", (-F.log(unit) / F.col("gap")).alias("race")).orderBy("race", "key").limit(1).collect()
        if not best:
            break
        chosen.append(best[0]["u"])
    return np.array(chosen)


def _assign(rows: np.ndarray, centres: list[np.ndarray]) -> list[np.ndarray]:
    """For every number of clusters the row's nearest centre; ties go to the lower one."""
    return [np.round(rows @ c.T, SCORE_DIGITS).argmax(axis=1) for c in centres]


def _cluster_sums(points: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, summed vectors) of every cluster, for all numbers of clusters in one pass.

    A task sends one row per cluster and dimension.
    """
    width = centres[0].shape[1]

    def add(batches):
        held = [(np.zeros(len(c), dtype=np.int64), np.zeros((len(c), width), dtype=np.int64)) for c in centres]
        for batch in batches:
            rows = _unit_rows(batch)
            whole = _whole(rows)
            for (n, sums), at in zip(held, _assign(rows, centres), strict=True):
                n += np.bincount(at, minlength=len(n))
                np.add.at(sums, at, whole)
        n = np.concatenate([h[0] for h in held])
        flat = np.concatenate([h[1] for h in held])
        table = np.concatenate([n[:, None], flat], axis=1)
        cluster, d = np.divmod(np.arange(table.size), width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(d), pa.array(table.ravel())], ["c", "d", "s"])

    total = points.mapInArrow(add, "c bigint, d bigint, s bigint").groupBy("c", "d").agg(F.sum("s").alias("s"))
    table = np.zeros((sum(len(c) for c in centres), width + 1), dtype=np.int64)
    for r in total.collect():  # clusters times dimensions
        table[r["c"], r["d"]] = r["s"]
    ends = np.cumsum([len(c) for c in centres])[:-1]
    return [(t[:, 0], t[:, 1:] / FIXED_POINT) for t in np.split(table, ends)]


def _spread(n: np.ndarray, sums: np.ndarray) -> float:
    """Summed squared distances of unit vectors from their clusters' means."""
    return float((n - (sums * sums).sum(axis=1) / np.maximum(n, 1)).sum())


def _best_centres(points: DataFrame, max_topics: int, seed: int, max_iter: int) -> np.ndarray | None:
    """Centres of the number of clusters with the best variance ratio (Calinski & Harabasz, 1974), seen on all rows."""
    seeds = _draw_seeds(points, max_topics, seed)
    centres = [seeds[:k] for k in range(2, len(seeds) + 1)]
    if not centres:
        return None
    for _ in range(max_iter):
        moved = []
        for c, (_, sums) in zip(centres, _cluster_sums(points, centres), strict=True):
            length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
            moved.append(np.where(length > 0, np.round(sums / np.maximum(length, 1e-12), SCORE_DIGITS), c))
        settled = all(np.array_equal(m, c) for m, c in zip(moved, centres, strict=True))
        centres = moved
        if settled:
            break
    found = []
    for c, (n, sums) in zip(centres, _cluster_sums(points, centres), strict=True):
        k, rows = len(c), int(n.sum())
        if rows > k:
            within = max(_spread(n, sums), 1e-9)
            total = _spread(np.array([rows]), sums.sum(axis=0, keepdims=True))
            found.append((round((total - within) / (k - 1) / (within / (rows - k)), SCORE_DIGITS), -k, c))
    return max(found, key=lambda f: f[:2])[2] if found else None  # ties: fewer topics


def _noise_bounds(placed: DataFrame, width: float) -> dict[int, float]:
    """For every cluster the distance beyond which its rows are noise: median + ``width`` median deviations.

    Both come from one histogram of the distances per cluster, so at most
    ``GAP_BINS`` rows a cluster reach the driver.
    """
    bins = placed.groupBy("cluster", F.floor(F.col("gap") * (GAP_BINS / 2)).alias("bin")).agg(F.count("*").alias("n"))
    by_cluster: dict[int, list[tuple[float, int]]] = {}
    for r in bins.collect():
        by_cluster.setdefault(r["cluster"], []).append(((r["bin"] + 0.5) * 2 / GAP_BINS, r["n"]))

    def median(pairs: list[tuple[float, int]]) -> float:
        pairs = sorted(pairs)
        counts = np.cumsum([n for _, n in pairs])
        return pairs[int(np.searchsorted(counts, (counts[-1] + 1) // 2))][0]

    bounds = {}
    for cluster, pairs in by_cluster.items():
        middle = median(pairs)
        deviation = median([(abs(gap - middle), n) for gap, n in pairs])
        bounds[cluster] = middle + width * max(deviation, 2 / GAP_BINS)
    return bounds


def cluster_kmeans(
    df: DataFrame,
    features: str = "components",
    row_id: str = "row_id",
    max_topics: int = MAX_TOPICS,
    noise_width: float = NOISE_WIDTH,
    seed: int = SEED,
    max_iter: int = 10,
) -> DataFrame:
    """(row_id, topic_id) by spherical k-means, the number of topics chosen on all rows.

    All numbers of topics are fitted side by side, one pass over the rows per
    iteration. Seeds are drawn by hash and sums are of whole numbers, so neither
    the number of rows nor their partitioning changes how an answer is found. Rows
    farther from their centre than their cluster's median distance plus
    ``noise_width`` median deviations are noise (there may be none), and so are
    clusters under the minimum size.
    """
    points = staged_columns(
        df.select(F.col(row_id), F.xxhash64(row_id).alias("key"), F.col(features).cast("array<double>").alias("v")), "points"
    )
    n = points.count()
    centres = _best_centres(points, max_topics, seed, max_iter)
    if centres is None:
        return points.select(row_id, F.lit(NOISE).alias("topic_id"))

    def place(batches):
        for batch in batches:
            rows = _unit_rows(batch)
            near = np.round(rows @ centres.T, SCORE_DIGITS)
            at = near.argmax(axis=1)
            gap = np.round(np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near[np.arange(len(at)), at])), SCORE_DIGITS)
            yield pa.RecordBatch.from_arrays([batch.column(row_id), pa.array(at, pa.int32()), pa.array(gap)], [row_id, "cluster", "gap"])

    kind = points.schema[row_id].dataType.simpleString()
    placed = staged_columns(points.mapInArrow(place, f"{row_id} {kind}, cluster int, gap double"), "placed")
    bounds = _noise_bounds(placed, noise_width)
    limit = F.get(literal([bounds.get(c, 2.0) for c in range(len(centres))]), F.col("cluster"))
    near = placed.withColumn("cluster", F.when(F.col("gap") > limit, NOISE).otherwise(F.col("cluster")))
    return drop_small_clusters(near, min_cluster_rows(n)).select(row_id, "topic_id")


def cluster_grid(
    df: DataFrame,
    x: str = "x",
    y: str = "y",
    row_id: str = "row_id",
    cells: int = 32,
    min_cell_rows: int = 1,
    min_rows: int | None = None,
) -> DataFrame:
    """Add ``topic_id`` by joining dense neighbouring cells of a ``cells`` x ``cells`` grid.

    Rows touch the data twice (bounds, counts); everything between works on at
    most ``cells ** 2`` cells, whatever the row count. Neighbours are found by an
    equi-join on eight shifted keys.
    """
    seen = df.agg(
        F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.count("*").alias("n")
    ).first()
    if not seen["n"] or seen["x0"] is None:
        return df.withColumn("topic_id", F.lit(NOISE))

    def place(value: str, low: float, high: float) -> Column:
        if high == low:
            return F.lit(0).cast("bigint")
        step = (high - low) / cells
        return F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(step)), F.lit(cells - 1)).cast("bigint")

    column = place(x, seen["x0"], seen["x1"])
    line = place(y, seen["y0"], seen["y1"])
    placed = df.withColumn("_cell", line * cells + column)
    # Few cells: one small partition keeps the label rounds cheap.
    dense = cut_lineage(
        placed.groupBy("_cell").agg(F.count("*").alias("n")).where(F.col("n") >= min_cell_rows).coalesce(1)
    )
    shifts = F.explode(
        F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])
    )
    at_line, at_column = F.floor(F.col("src") / cells), F.pmod("src", F.lit(cells))
    shifted = (
        dense.select(F.col("_cell").alias("src"), shifts.alias("s"))
        .select("src", (at_line + F.col("s.dy")).alias("ln"), (at_column + F.col("s.dx")).alias("cl"))
        .where(F.col("cl").between(0, cells - 1) & F.col("ln").between(0, cells - 1))
        .select("src", (F.col("ln") * cells + F.col("cl")).alias("dst"))
    )
    edges = shifted.join(dense.select(F.col("_cell").alias("dst")), "dst")
    parts = connected_components(dense.select(F.col("_cell").alias("node")), edges)
    sizes = (
        dense.join(parts, dense["_cell"] == parts["node"])
        .groupBy("component")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= (min_rows if min_rows is not None else min_cluster_rows(seen["n"])))
    )
    ranked = sizes.withColumn("topic_id", (F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1).cast("int"))
    by_cell = parts.join(ranked, "component").select(F.col("node").alias("_cell"), "topic_id")
    # At most cells ** 2 rows.
    return (
        placed.join(F.broadcast(by_cell), "_cell", "left")
        .withColumn("topic_id", F.coalesce("topic_id", F.lit(NOISE)))
        .drop("_cell")
    )


# --- Topic words -------------------------------------------------------------------


def topic_token_counts(df: DataFrame, keys: Sequence[str] = TOPIC_KEYS, tokens: str = "tokens") -> DataFrame:
    """(keys, token, tf): one shuffle, after a map-side count."""
    return (
        each(df, tokens, "_t", *keys)
        .select(*keys, F.lower("_t").alias("token"))
        .where(F.length("token") >= MIN_WORD_CHARS)
        .groupBy(*keys, "token")
        .agg(F.count("*").alias("tf"))
    )


def topic_word_weights(counts: DataFrame, keys: Sequence[str] = TOPIC_KEYS) -> DataFrame:
    """Class TF-IDF (Grootendorst, 2022): share in the topic x ln(1 + A / count overall).

    ``A`` is the mean number of words per topic. Topics (noise too) are the
    classes; with keys (sentiment, topic_id) each side is a corpus of its own.
    """
    keys = list(keys)
    corpus = keys[:-1]
    counts = cut_lineage(counts)  # read three times below; far smaller than the texts
    totals = counts.groupBy(*keys).agg(F.sum("tf").alias("words"))
    per_corpus = totals.groupBy(*corpus).agg(F.avg("words").alias("mean_words"))
    if corpus:
        sizes = totals.join(per_corpus, corpus)
    else:
        sizes = totals.withColumn("mean_words", F.avg("words").over(Window.partitionBy(F.lit(0))))
    # A token's rows are one per topic: tiny window partitions, even for "the".
    overall = F.sum("tf").over(Window.partitionBy(*corpus, "token"))
    weighted = lookup_join(counts.withColumn("overall", overall), sizes, keys, "inner", spread_by="token", small=True)
    weight = F.col("tf") / F.col("words") * F.log1p(F.col("mean_words") / F.col("overall"))
    return weighted.select(*keys, "token", "tf", F.round(weight, SCORE_DIGITS + 3).alias("weight"))


def top_words(weights: DataFrame, n: int = KEYWORDS, keys: Sequence[str] = TOPIC_KEYS) -> DataFrame:
    """(keys, token, weight, place): the best ``n`` per topic, ties by word.

    Spark limits each map task to ``n`` rows per topic before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "token")
    return weights.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def topic_table(top: DataFrame, sizes: DataFrame, keys: Sequence[str] = TOPIC_KEYS) -> DataFrame:
    """(keys, keywords, label, n_rows), noise left out. One row per topic."""
    keys = list(keys)
    words = (
        top.where(F.col(keys[-1]) != NOISE)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("place", "token"))).alias("w"))
        .select(*keys, F.array_join(F.col("w.token"), SEPARATOR).alias("keywords"))
    )
    listed = sizes.where(F.col(keys[-1]) != NOISE).join(words, keys, "left")
    listed = listed.withColumn("keywords", F.coalesce("keywords", F.lit("")))
    return listed.withColumn("label", topic_name(F.col("keywords")))


def topic_sizes(df: DataFrame, keys: Sequence[str] = TOPIC_KEYS) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"))


def diversify_words(
    candidates: DataFrame,
    rows: DataFrame,
    keys: Sequence[str] = TOPIC_KEYS,
    n: int = KEYWORDS,
    diversity: float = DIVERSITY,
    vector: str = "embedding",
    tokens: str = "tokens",
) -> DataFrame:
    """Re-rank each topic's candidate words by maximal marginal relevance.

    A word's vector is the mean vector of the rows that hold it. Only candidate
    words are looked up (at most ``CANDIDATES`` per topic), and their vectors are
    merged map-side. The greedy choice then sees at most ``CANDIDATES`` rows.
    """
    keys = list(keys)
    listed = candidates.where(F.col("place") <= CANDIDATES)
    wanted = listed.select("token").distinct()
    lowered = F.transform(tokens, lambda t: F.lower(t))
    local = small_table(wanted, MAX_WANTED_WORDS)
    if local is not None:  # ten topics a side have a few hundred words: tokens that are not wanted never leave their row
        words = F.lit([r["token"] for r in local.collect()]).cast("array<string>")
        held = each(rows, F.array_intersect(lowered, words), "token", vector)
    else:
        held = each(rows, F.array_distinct(lowered), "token", vector)
        held = lookup_join(held, wanted, "token", "inner", spread_by="token")
    vectors = held.where(F.col("token").isNotNull()).groupBy("token").agg(mean_vector(F.col(vector)).alias("v"))
    pool = listed.join(vectors, "token").select(*keys, "token", "weight", "place", "v")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("place", ignore_index=True)
        points = np.stack(group["v"].to_numpy())
        lengths = np.linalg.norm(points, axis=1, keepdims=True)
        points = points / np.where(lengths == 0, 1.0, lengths)
        centre = points.mean(axis=0)
        relevance = np.round(points @ (centre / (np.linalg.norm(centre) or 1.0)), SCORE_DIGITS)
        likeness = np.round(points @ points.T, SCORE_DIGITS)
        picked = [int(relevance.argmax())]
        while len(picked) < min(n, len(group)):
            score = (1 - diversity) * relevance - diversity * likeness[:, picked].max(axis=1)
            score[picked] = -np.inf
            picked.append(int(score.argmax()))
        out = group.iloc[picked].copy()
        out["place"] = range(1, len(picked) + 1)
        return out[[*keys, "token", "weight", "place"]]

    schema = candidates.select(*keys, "token", "weight", F.col("place").cast("int").alias("place")).schema
    return pool.groupBy(*keys).applyInPandas(choose, schema)


# --- Merging similar topics ---------------------------------------------------------


def topic_similarities(weights: DataFrame, keys: Sequence[str] = TOPIC_KEYS) -> DataFrame:
    """(corpus, a, b, similarity) of topic pairs a < b that share words.

    Meets on the word. A word's group holds one entry per topic, never rows of the
    data: ten a side at most, so 45 products per word, summed map-side.
    """
    keys = list(keys)
    corpus, topic = keys[:-1], keys[-1]
    real = weights.where(F.col(topic) != NOISE)
    norms = real.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    pairs = (
        real.groupBy(*corpus, "token")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(topic).alias("t"), F.col("weight").alias("w")))).alias("held"))
        .where(F.size("held") > 1)
        .select(*corpus, F.posexplode("held").alias("i", "a"), "held")
        .select(*corpus, "a", F.explode(F.expr("slice(held, i + 2, size(held))")).alias("b"))
        .groupBy(*corpus, F.col("a.t").alias("a"), F.col("b.t").alias("b"))
        .agg(F.sum(F.col("a.w") * F.col("b.w")).alias("dot"))
    )
    left = norms.select(*corpus, F.col(topic).alias("a"), F.col("norm").alias("norm_a"))
    right = norms.select(*corpus, F.col(topic).alias("b"), F.col("norm").alias("norm_b"))
    joined = pairs.join(left, [*corpus, "a"]).join(right, [*corpus, "b"])
    return joined.select(
        *corpus, "a", "b", F.round(F.col("dot") / (F.col("norm_a") * F.col("norm_b")), SCORE_DIGITS).alias("similarity")
    )


def merge_map(
    weights: DataFrame, sizes: DataFrame, threshold: float = MERGE_SIMILARITY, keys: Sequence[str] = TOPIC_KEYS
) -> DataFrame:
    """(keys, merged_id): topics linked by similarity >= threshold become one.

    Merged topics are renumbered by size, largest first. With fewer than two
    topics on a side there are no pairs and only the renumbering is left.
    """
    keys = list(keys)
    corpus, topic = keys[:-1], keys[-1]
    real = cut_lineage(sizes.where(F.col(topic) != NOISE).coalesce(1))

    def node(column: str) -> Column:
        return F.concat_ws("|", *corpus, F.lpad(F.col(column).cast("string"), 10, "0"))

    links = topic_similarities(weights, keys).where(F.col("similarity") >= threshold)
    edges = links.select(node("a").alias("src"), node("b").alias("dst"))
    parts = connected_components(real.select(node(topic).alias("node")), edges)
    members = real.withColumn("node", node(topic)).join(parts, "node")
    merged = members.groupBy(*corpus, "component").agg(F.sum("n_rows").alias("n"))
    order = Window.partitionBy(*corpus).orderBy(F.desc("n"), "component") if corpus else Window.orderBy(F.desc("n"), "component")
    merged = merged.withColumn("merged_id", (F.row_number().over(order) - 1).cast("int"))
    return members.join(merged.drop("n"), [*corpus, "component"]).select(*keys, "merged_id")


def apply_merge(
    df: DataFrame, mapping: DataFrame, keys: Sequence[str] = TOPIC_KEYS, spread_by: str = "row_id"
) -> DataFrame:
    keys = list(keys)
    joined = lookup_join(df, mapping, keys, "left", spread_by=spread_by, small=True)
    return joined.withColumn(keys[-1], F.coalesce("merged_id", F.col(keys[-1])).cast("int")).drop("merged_id")


# --- Back to rows -------------------------------------------------------------------


def attach_topics(df: DataFrame, topics: DataFrame, keys: Sequence[str] = TOPIC_KEYS) -> DataFrame:
    """Add ``topic_label`` and ``topic_keywords``; noise rows are "General" with none."""
    named = topics.select(*keys, F.col("label").alias("topic_label"), F.col("keywords").alias("topic_keywords"))
    return lookup_join(df, named, list(keys), "left", small=True).withColumns(
        {
            "topic_label": F.coalesce("topic_label", F.lit(GENERAL)),
            "topic_keywords": F.coalesce("topic_keywords", F.lit("")),
        }
    )


def topic_centroids(df: DataFrame, vector: str = "embedding", keys: Sequence[str] = TOPIC_KEYS) -> DataFrame:
    return df.where(F.col(keys[-1]) != NOISE).groupBy(*keys).agg(mean_vector(F.col(vector)).alias("centroid"))


def representatives(
    df: DataFrame, vector: str = "embedding", row_id: str = "row_id", keys: Sequence[str] = TOPIC_KEYS
) -> DataFrame:
    """(keys, row_id, similarity): the row nearest its topic's centroid; ties: first row."""
    keys = list(keys)
    near = lookup_join(
        df.where(F.col(keys[-1]) != NOISE).select(*keys, row_id, vector),
        topic_centroids(df, vector, keys),
        keys,
        "inner",
        spread_by=row_id,
        small=True,
    ).select(*keys, row_id, F.round(cosine(F.col(vector), F.col("centroid")), SCORE_DIGITS).alias("similarity"))
    if not _is_whole(near, row_id):
        best = near.groupBy(*keys).agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col(row_id).alias("r"))).alias("b"))
        return best.select(*keys, F.col("b.r").alias(row_id), (-F.col("b.s")).alias("similarity"))
    # (distance from 1, row) as one decimal, for the same reason as in _first_use.
    far = F.round((1 - F.col("similarity")) * 10**SCORE_DIGITS).cast("decimal(17,0)")
    packed = (far * F.expr(_PACK) + F.col(row_id) + F.expr(_SHIFT)).cast("decimal(38,0)")
    best = near.groupBy(*keys).agg(F.min(packed).alias("b"))
    row = F.expr(f"cast(b % {_PACK} - {_SHIFT} as bigint)")
    gap = F.expr(f"cast(b div {_PACK} as double)")
    return best.select(*keys, row.alias(row_id), (1 - gap / 10**SCORE_DIGITS).alias("similarity"))


def mark_representatives(
    df: DataFrame, vector: str = "embedding", row_id: str = "row_id", keys: Sequence[str] = TOPIC_KEYS
) -> DataFrame:
    """Add ``representative_doc``: one True per topic, none for noise."""
    chosen = representatives(df, vector, row_id, keys).select(row_id, F.lit(True).alias("representative_doc"))
    return lookup_join(df, chosen, row_id, "left", spread_by=row_id, small=True).withColumn(
        "representative_doc", F.coalesce("representative_doc", F.lit(False))
    )


# --- Small sides: word frequency ----------------------------------------------------


def frequent_words(
    df: DataFrame,
    n: int = FALLBACK_KEYWORDS,
    tokens: str = "tokens",
    row_id: str = "row_id",
    lang: str | None = "lang",
) -> DataFrame:
    """(token, n): the most frequent lowercased non-stopwords, ties by first use."""
    carried = [row_id] + ([lang] if lang else [])
    exploded = each(df, tokens, "_t", *carried, position="pos").withColumn("token", F.lower("_t"))
    if lang:
        exploded = exploded.where(~is_stopword(lang, "token"))
    return (
        exploded.groupBy("token")
        .agg(F.count("*").alias("n"), F.min(_first_use(exploded, row_id)).alias("first_use"))
        .orderBy(F.desc("n"), "first_use")
        .limit(n)
    )


def _is_whole(df: DataFrame, row_id: str) -> bool:
    return df.schema[row_id].dataType.typeName() in ("long", "integer", "short", "byte")


def _first_use(df: DataFrame, row_id: str) -> Column:
    """(row, position) as one ordered value.

    For whole-number ids it is a decimal, which a hash aggregate can hold; a struct
    would make Spark sort all tokens instead.
    """
    if _is_whole(df, row_id):
        packed = F.col(row_id).cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)")
        return (packed + F.col("pos")).cast("decimal(38,0)")
    return F.struct(F.col(row_id), F.col("pos"))


def fallback_topics(df: DataFrame, row_id: str = "row_id", lang: str | None = "lang") -> DataFrame:
    """The six topic columns for a side too small to cluster: same words on every row."""
    found = frequent_words(df, row_id=row_id, lang=lang).collect()  # twenty rows
    keywords = SEPARATOR.join(r["token"] for r in found)
    return df.withColumns(
        {
            "topic_id": F.lit(NOISE),
            "topic_label": F.lit(FALLBACK_LABEL),
            "topic_keywords": F.lit(keywords),
            "x": F.lit(None).cast("double"),
            "y": F.lit(None).cast("double"),
            "representative_doc": F.lit(False),
        }
    )
