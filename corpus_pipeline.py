"""A training corpus from raw documents, stage by stage.

Toxic documents go, repeated lines stay in one document only, one document of every
near-duplicate group stays, sources are mixed to their target weights, and texts are
encoded. Each stage works on all rows that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentarium.llm import byte_bpe, jaccard_join, line_dedup, mixing, toxicity
from commentarium.llm.common import set_aside, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, learned from ``labels``, does not find toxic; null and empty texts stay."""
    return toxicity.reject_toxic(spark, docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines they lose; ``n_chars`` follows where a text has lost some.

    Rows that repeat an id are one document. A text that loses all its lines stays as an empty one.
    """
    kept = line_dedup.deduplicate_lines(set_aside(docs, "doc_id", "text"))
    changed = F.col("n_dropped") > 0

    def column(place: int, name: str) -> Column:
        if name == "text":
            return F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text")
        own = F.col("doc_id" if name == "doc_id" else f"_{place}")
        if name == "n_chars":
            return F.when(changed, F.length("kept_text")).otherwise(own).cast(docs.schema[name].dataType).alias(name)
        return own.alias(name)

    return kept.select(*[column(k, c) for k, c in enumerate(docs.columns)])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A document is all rows of one id: they stay or go together, equal or not. Rows without an id and
    texts without words are in no group and stay.
    """
    joined = jaccard_join.near_duplicates(docs)
    gone = joined.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows taken as the mix plans it, each repeated row by its own plan; rows without words add none."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded_sha256) of every row: token ids, and the digest of what they decode to.

    Null and empty texts have no ids; other columns are left out.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(docs.select("doc_id", "source", "text"), path, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded.drop("text"), path)
    return decoded.select(
        "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # no stage but line dedup can be said in SQL; tests compare each with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
