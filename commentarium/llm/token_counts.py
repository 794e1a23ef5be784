"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of the corpus's frequent pre-tokens and their numbers
of tokens, broadcast to every worker. Tier two is each worker's own bounded
cache, filled by the tokenizer library for what tier one misses. No pre-token is
ever shuffled: only each task's short list of frequent ones is.

A pre-token is a run without ASCII white space. The tokenizer must split at
white space and drop it, so that counts add up over pre-tokens; this is checked
on the loaded tokenizer.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentarium.llm.common import bounded_batches, chunks, plain, texts_of

TABLE_ENTRIES = 50_000  # bound of the broadcast table
PRETOKEN_BYTES = 64  # longer pre-tokens stay out of it: at most about 3.5 MB
TASK_COUNTERS = 100_000  # bound of a task's counters while it looks for frequent pre-tokens
CACHE_ENTRIES = 600_000  # bound of a worker's cache


def load_tokenizer(path: str):
    """The tokenizer, without truncation or padding; special strings as its default has them."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    probe = "ab cd\tab\ncd"
    parts = sum(len(tokenizer.encode(p, add_special_tokens=False).ids) for p in probe.split())
    if len(tokenizer.encode(probe, add_special_tokens=False).ids) != parts:
        raise ValueError(f"{path}: counts do not add up over white space; this operator cannot use it.")
    return tokenizer


@lru_cache(maxsize=1)
def _worker(path: str) -> tuple:
    """The tokenizer and the cache of this worker process, kept from task to task."""
    return load_tokenizer(path), {}


def _lengths(tokenizer, words: list[bytes]) -> list[int]:
    texts = [w.decode("utf-8") for w in words]
    return [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def frequent_pretokens(docs: DataFrame, text: str = "text", entries: int = TABLE_ENTRIES) -> DataFrame:
    """(word, n): at most ``entries`` frequent pre-tokens, counted over all texts.

    Every task counts all its pre-tokens with bounded counters (when they are full,
    those below the mean count go) and reports those above a hundred-thousandth
    of what it saw, so a task sends at most 100,000 rows and mostly far fewer. The
    list decides speed only, never a result.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in batches:
            for t in texts_of(batch.column(0)):
                words = t.split()
                total += len(words)
                seen.update(words)
            if len(seen) > TASK_COUNTERS:
                floor = sum(seen.values()) / len(seen)
                seen = Counter({w: n for w, n in seen.items() if n > floor})
        kept = [(w, n) for w, n in seen.items() if n * 100_000 >= total and len(w) <= PRETOKEN_BYTES]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in kept], pa.binary()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"]
        )

    found = plain(docs, text=text).mapInArrow(count, "word binary, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(entries)


def token_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", entries: int = TABLE_ENTRIES
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``, as the tokenizer at ``path`` gives them.

    Whole texts, without added begin or end tokens. A null or empty text has 0
    bytes and 0 tokens; null and repeated ids are kept row by row; other columns
    are not looked at.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    given = plain(docs, doc_id=id_column, text=text_column)
    words = [bytes(r["word"]) for r in frequent_pretokens(given, entries=entries).select("word").collect()]
    lengths = _lengths(load_tokenizer(path), words)
    # One blob of words and two small arrays: workers unpickle it quickly.
    compact = spark.sparkContext.broadcast(
        (b" ".join(words), np.asarray(lengths, dtype=np.int32).tobytes())
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, sizes = compact.value
        tiers = _Tiers(zip(blob.split(b" "), np.frombuffer(sizes, dtype=np.int32).tolist(), strict=False) if sizes else ())
        tokenizer, tiers.cache = _worker(path)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            totals: list[int] = []
            for chunk in chunks(texts):
                split = [t.split() for t in chunk]
                missing = list({w for words in split for w in words}.difference(tiers, tiers.cache))
                found = dict(zip(missing, _lengths(tokenizer, missing), strict=True))
                # Common words come early and stay; a word without room is encoded when it comes again.
                if len(tiers.cache) + len(found) <= CACHE_ENTRIES:
                    tiers.cache.update(found)
                tiers.extra = found
                totals += [sum(map(tiers.__getitem__, words)) for words in split]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(totals, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")


class _Tiers(dict):
    """The broadcast table first, then the worker's cache, then what found no room in it for a while."""

    def __init__(self, table):
        super().__init__(table)
        self.cache: dict[bytes, int] = {}
        self.extra: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        count = self.cache.get(word)
        return self.extra[word] if count is None else count
