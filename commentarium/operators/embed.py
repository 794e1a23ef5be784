"""Text vectors: a built-in encoder, a plug-in point, and a content-keyed cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentarium.functions.keys import content_hash
from commentarium.functions.text import clean, split_tokens
from commentarium.operators.joins import join_on_content
from commentarium.operators.storage import cut_lineage, path_exists

VECTOR_WIDTH = 384  # fixed value
ENCODE_BATCH = 32  # fixed value

# A model factory runs once per Python task and returns texts -> vectors.
TextModel = Callable[[Sequence[str]], Sequence[Sequence[float]]]
Encode = Callable[[DataFrame], DataFrame]


def encoder_expression(load_model: Callable[[], TextModel], batch: int = ENCODE_BATCH) -> Callable[[Column], Column]:
    """A column function that runs a user's model over Arrow batches.

    The model is loaded once per task, and rows stay where they are: the vector
    comes back as a column, so no join is needed to attach it.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            vectors: list[np.ndarray] = []
            for start in range(0, len(texts), batch):
                chunk = texts.iloc[start : start + batch].tolist()
                vectors.extend(np.asarray(model(chunk), dtype="float32"))
            yield pd.Series(vectors)

    return encode


def fit_hashed_encoder(df: DataFrame, tokens: str = "tokens", width: int = VECTOR_WIDTH) -> PipelineModel:
    """The built-in encoder: hashed term counts, IDF weights, unit length.

    One pass over the tokens; the model is ``width`` numbers.
    """
    stages = [
        HashingTF(inputCol=tokens, outputCol="_tf", numFeatures=width),
        IDF(inputCol="_tf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(df.select(tokens))


def hashed_vectors(df: DataFrame, model: PipelineModel, out: str = "embedding") -> DataFrame:
    return (
        model.transform(df)
        .withColumn(out, vector_to_array("_unit", "float32"))
        .drop("_tf", "_tfidf", "_unit")
    )


def encode_phrase(df: DataFrame, phrase: str, encode: Encode) -> list[float]:
    """The vector of one concept phrase, by the encoder that served the comments."""
    session = df.sparkSession
    row = session.createDataFrame([(0, phrase)], "row_id bigint, clean_text string")
    row = row.withColumn("tokens", split_tokens(clean(F.col("clean_text"))))
    return [float(x) for x in encode(row).select("embedding").first()[0]]


def dataset_fingerprint(df: DataFrame, text: str = "clean_text") -> DataFrame:
    """One row that changes when the set of texts changes; row order does not matter."""
    # The first 60 bits of a digest that other engines have as well.
    h = F.conv(F.substring(content_hash(F.coalesce(F.col(text), F.lit(""))), 1, 15), 16, 10).cast("bigint")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.pmod(h, F.lit(2**31))), F.lit(0)).alias("sum_hash"),
    )


def model_fingerprint(model: PipelineModel) -> str:
    """A name for a fitted built-in encoder: other weights, another name."""
    weights = model.stages[1].idf.toArray()
    return "hashed-" + hashlib.sha256(weights.round(12).tobytes()).hexdigest()[:16]


def _read_cache(df: DataFrame, path: str, model_id: str) -> DataFrame | None:
    """The model's part of the cache; None if nothing is cached yet. Other faults of the store are not hidden."""
    spark = df.sparkSession
    if not path_exists(spark, path):
        return None
    schema = "content_hash string, embedding array<float>, model_id string"
    return spark.read.schema(schema).parquet(path).where(F.col("model_id") == model_id).select("content_hash", "embedding")


def cached_vectors(
    df: DataFrame,
    path: str,
    model_id: str,
    encode: Encode,
    text: str = "clean_text",
    row_id: str = "row_id",
) -> DataFrame:
    """Attach vectors, encoding each distinct text the cache does not hold, once.

    The cache is a parquet table keyed by the SHA-256 of the text and split by
    model. A changed text has a new key; a model fitted on other data must have
    another ``model_id`` (``model_fingerprint`` for the built-in one), so nothing is
    ever stale, and a missing piece is simply encoded again. Only the hashes asked for
    leave the cache. ``encode`` gets ``(row_id, clean_text, tokens)`` of distinct texts and
    adds ``embedding``.
    """
    keyed = df.withColumn("content_hash", content_hash(F.col(text)))
    # Hashes only: texts move just for rows that must be encoded.
    contents = cut_lineage(
        keyed.groupBy("content_hash").agg(F.count("*").alias("copies"), F.min(row_id).alias(row_id))
    )
    cached = _read_cache(df, path, model_id)
    missing = contents if cached is None else contents.join(cached, "content_hash", "left_anti")
    misses = (
        missing.select("content_hash", row_id)
        .join(df.select(row_id, F.col(text).alias("clean_text")), row_id)
        .withColumn("tokens", split_tokens(F.col("clean_text")))
    )
    (
        encode(misses)
        .select("content_hash", "embedding", F.lit(model_id).alias("model_id"))
        .write.mode("append")
        .partitionBy("model_id")
        .parquet(path)
    )
    # Two runs at once may both append a text: one vector per key is enough.
    written = _read_cache(df, path, model_id)
    if written is None:  # no rows at all
        return keyed.withColumn("embedding", F.lit(None).cast("array<float>"))
    asked = contents.select("content_hash", "copies")
    held = written.join(asked.select("content_hash"), "content_hash", "left_semi")
    vectors = held.groupBy("content_hash").agg(F.min("embedding").alias("embedding"))
    needed = asked.join(vectors, "content_hash")
    return join_on_content(keyed, needed, "content_hash", "copies", spread_by=row_id)
