"""Content keys and order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42  # fixed value


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def shuffled_key(row_id: Column, seed: int = SEED) -> Column:
    """A repeatable pseudo-random sort key: the same row gets the same key always.

    Unlike ``rand(seed)`` it does not depend on how the frame is partitioned.
    """
    return F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed))))
