"""Outlier detection on comment vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, ElementwiseProduct, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentarium.functions.forest import MODEL_SCHEMA, Forest, grow_tree
from commentarium.functions.keys import SEED
from commentarium.functions.vectors import SCORE_DIGITS, distance, literal, mean_vector
from commentarium.operators.quantiles import exact_quantile, quantile_of_sketches, sketch
from commentarium.operators.storage import cut_lineage, staged_columns

# Fixed values.
MIN_CONTAMINATION = 0.01
MAX_CONTAMINATION = 0.15
DEFAULT_CONTAMINATION = 0.05
MAX_COMPONENTS = 50
TREES = 100
ROWS_PER_TREE = 256


def check_contamination(share: float) -> float:
    if not MIN_CONTAMINATION <= share <= MAX_CONTAMINATION:
        raise ValueError(f"{share} is no share of outliers to look for; allowed: {MIN_CONTAMINATION} to {MAX_CONTAMINATION}.")
    return share


# --- Dimension reduction -----------------------------------------------------


def fit_reduction(df: DataFrame, vector: str = "embedding", components: int = MAX_COMPONENTS) -> PipelineModel | None:
    """Centred PCA with ``min(components, n - 1, width)`` components, None if n < 2.

    The driver holds one width x width covariance; rows stay distributed. Each
    component's sign is fixed so that its largest loading is positive.
    """
    vectors = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    first = df.select(F.size(vector).alias("width")).first()
    if first is None:
        return None
    n = df.select(F.lit(1)).limit(components + 1).count()  # only min(n, components + 1) matters
    k = min(components, n - 1, first["width"])
    if k < 1:
        return None
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_centred").fit(vectors)
    pca = PCA(k=k, inputCol="_centred", outputCol="_pc").fit(centre.transform(vectors))
    loadings = pca.pc.toArray()
    peaks = np.abs(loadings).argmax(axis=0)
    signs = np.where(loadings[peaks, np.arange(k)] < 0, -1.0, 1.0)
    flip = ElementwiseProduct(scalingVec=Vectors.dense(signs), inputCol="_pc", outputCol="_signed")
    return PipelineModel(stages=[centre, pca, flip])


def explained_variance(model: PipelineModel) -> float:
    return float(sum(model.stages[1].explainedVariance.toArray()))


def reduce_vectors(df: DataFrame, model: PipelineModel, vector: str = "embedding", out: str = "components") -> DataFrame:
    staged = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return (
        model.transform(staged).withColumn(out, vector_to_array("_signed")).drop("_v", "_centred", "_pc", "_signed")
    )


# --- Isolation forest ----------------------------------------------------------


def _deal_rows(df: DataFrame, features: str, row_id: str, n: int, trees: int, per_tree: int, seed: int) -> DataFrame:
    """(tree, key, features): ``per_tree`` rows for each tree, without replacement.

    Every tree draws from all rows, by the lowest hashes of (tree, row id). Hashes
    beyond a cut-off that some twice ``per_tree`` rows pass cannot win, so only rows
    that may win leave their task; should a tree be short of them, the draw is
    done again without the cut-off, with the same winners.
    """
    rows = df.select(row_id, features)
    share = min(1.0, (2.0 * per_tree + 64) / max(n, 1))
    numbers = F.sequence(F.lit(0), F.lit(trees - 1))

    def drawn(cutoff: int) -> DataFrame:
        keyed = F.transform(
            numbers, lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(row_id)).alias("key"))
        )
        kept = F.filter(keyed, lambda d: d["key"] <= F.lit(cutoff))
        return rows.select(row_id, F.explode(kept).alias("d")).select(row_id, "d.tree", "d.key")

    candidates = cut_lineage(drawn(int(-(2**63) + share * (2**64 - 1)) if share < 1.0 else 2**63 - 1))
    if share < 1.0:
        held = candidates.groupBy("tree").count().agg(F.count("*").alias("trees"), F.min("count").alias("least")).first()
        if held["trees"] < trees or held["least"] < per_tree:
            candidates = drawn(2**63 - 1)
    order = Window.partitionBy("tree").orderBy("key", row_id)
    winners = candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_tree).drop("place")
    # At most trees * per_tree narrow rows.
    return rows.join(F.broadcast(winners), row_id).select("tree", "key", features)


def grow_forest(
    df: DataFrame,
    features: str = "components",
    row_id: str = "row_id",
    trees: int = TREES,
    per_tree: int = ROWS_PER_TREE,
    seed: int = SEED,
) -> tuple[DataFrame, int]:
    """An isolation forest as a node table, and the rows each tree saw.

    One bounded group (``per_tree`` rows) per tree, grown in parallel.
    """
    n = df.count()
    dealt = _deal_rows(df, features, row_id, n, trees, per_tree, seed)
    model = dealt.groupBy("tree").applyInPandas(lambda rows: grow_tree(rows, features, seed), MODEL_SCHEMA)
    return model, min(per_tree, n)


def forest_scores(
    df: DataFrame, model: DataFrame, sample_size: int, features: str = "components", out: str = "outlier_score"
) -> DataFrame:
    """Add ``2 ** (-mean depth / c(sample))``: near 1 is isolated early.

    The node table has at most ``trees * (2 * rows per tree - 1)`` rows (51,100 by
    default), so it travels with the task. Rows are scored a batch at a time.
    """
    forest = Forest(model.toPandas(), sample_size)

    @F.pandas_udf("double")
    def score(vectors: pd.Series) -> pd.Series:
        return forest.score(vectors)

    return df.withColumn(out, score(features))


# --- Scores to flags -------------------------------------------------------------


def centroid_distances(df: DataFrame, vector: str = "embedding", out: str = "outlier_score") -> DataFrame:
    """Distance of every row to the mean vector, which is one row for the driver."""
    centre = df.agg(mean_vector(F.col(vector)).alias("c")).first()["c"]
    if centre is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    return df.withColumn(out, distance(F.col(vector), literal([float(x) for x in centre])))


def store_scores(df: DataFrame, folder: str, batch: str | int, score: str = "outlier_score") -> None:
    """Keep a sketch of a batch's scores, one row of some 25 kB; the same batch stored again replaces its own."""
    sketch(df, F.round(score, SCORE_DIGITS)).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={batch}")


def stored_cut(spark: SparkSession, folder: str, contamination: float = DEFAULT_CONTAMINATION) -> float | None:
    """The cut over all stored batches, without reading a score again; its share of rows is off by 0.13 % of them at most
    99 times in 100. It is one of the scores, not a value between two; None without any."""
    check_contamination(contamination)
    sketches = spark.read.schema("n bigint, sketch binary").parquet(f"{folder.rstrip('/')}/batch=*")
    return quantile_of_sketches(sketches, 1.0 - contamination)


def flag_above(df: DataFrame, cut: float | None, score: str = "outlier_score") -> DataFrame:
    """Add ``is_outlier`` by a given cut (``stored_cut``): a later batch needs no pass of its own.

    Scores that are not finite are outliers, missing ones are not; without a cut no finite score is one.
    """
    rounded = df.withColumn(score, F.round(score, SCORE_DIGITS))
    odd = F.isnan(score) | (F.abs(score) == float("inf"))
    limit = F.lit(float("inf") if cut is None else cut)
    return rounded.withColumn("is_outlier", F.coalesce(odd | (F.col(score) > limit), F.lit(False)))


def flag_outliers(
    df: DataFrame, contamination: float = DEFAULT_CONTAMINATION, score: str = "outlier_score", stored: bool = False
) -> DataFrame:
    """Add ``is_outlier``: scores strictly above the ``1 - contamination`` quantile.

    Scores are rounded to 9 digits first, so that ties do not hang on summation noise.
    The quantile is that of the finite scores: a score that is not a number or infinite
    (a vector with such parts) is an outlier itself and moves no other row's flag.
    Rows without a score are not flagged. The quantile may take several passes, which
    read eight bytes a row: ``stored`` says that ``df`` is in columnar files already.
    """
    check_contamination(contamination)
    scores = df.select(F.round(score, SCORE_DIGITS).alias(score))
    cut = exact_quantile(scores if stored else staged_columns(scores, "scores"), score, 1.0 - contamination)
    return flag_above(df, cut, score)


def detect_outliers(
    df: DataFrame,
    contamination: float = DEFAULT_CONTAMINATION,
    vector: str = "embedding",
    method: str = "forest",
    row_id: str = "row_id",
) -> DataFrame:
    """Add ``outlier_score`` and ``is_outlier`` to rows with vectors.

    ``df`` is read several times; persist it first. At most one row: an inlier.
    """
    check_contamination(contamination)
    if method == "centroid":
        return flag_outliers(centroid_distances(df, vector), contamination)
    if method != "forest":
        raise ValueError(f"Unknown outlier method: {method!r}")
    reduction = fit_reduction(df, vector)
    if reduction is None:
        return df.withColumn("outlier_score", F.lit(0.0)).withColumn("is_outlier", F.lit(False))
    reduced = reduce_vectors(df, reduction, vector)
    # Reduced once and scored once: the deal, the scoring and the cut read what is written.
    reduced = staged_columns(reduced, "reduced")
    model, sample_size = grow_forest(reduced, row_id=row_id)
    scored = staged_columns(forest_scores(reduced, model, sample_size), "scored")
    return flag_outliers(scored, contamination, stored=True)


def split_outliers(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clean, outliers): complementary filters on one flagged frame."""
    return flagged.where(~F.col("is_outlier")), flagged.where(F.col("is_outlier"))


def outlier_share(flagged: DataFrame, *by: str) -> DataFrame:
    grouped = flagged.groupBy(*by) if by else flagged.groupBy()
    return grouped.agg(
        F.count_if("is_outlier").alias("n_outliers"),
        F.count("*").alias("n_rows"),
        F.coalesce(F.count_if("is_outlier") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("outlier_share"),
    )
