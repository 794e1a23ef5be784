"""Readable topic names from keyword lists."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from commentarium.functions.dictionaries import TOPIC_NAMES

GENERAL = "General"  # fixed value
SEPARATOR = ", "  # fixed value


def topic_name(keywords: Column, names: Sequence[tuple[str, str]] = TOPIC_NAMES) -> Column:
    """Name a topic from its keywords joined by ``", "``.

    A keyword votes for the first dictionary entry whose pattern contains it or is
    contained in it. Most votes win, the earliest vote breaks ties. With no votes
    the first two keywords, title-cased, are the name. An expression over a
    literal dictionary: topic tables are named without a join.
    """
    entries = F.from_json(
        F.lit(json.dumps([{"pattern": p, "name": n} for p, n in names])), "array<struct<pattern: string, name: string>>"
    )
    split = F.filter(
        F.transform(F.split(F.coalesce(keywords, F.lit("")), ","), lambda k: F.lower(F.trim(k))), lambda k: k != ""
    )

    def vote(keyword: Column) -> Column:
        fitting = F.filter(
            entries, lambda e: F.contains(keyword, e["pattern"]) | F.contains(e["pattern"], keyword)
        )
        return F.get(fitting, F.lit(0))["name"]

    votes = F.filter(F.transform(split, vote), lambda v: v.isNotNull())
    ranked = F.transform(
        F.array_distinct(votes),
        lambda name: F.struct(
            (-F.size(F.filter(votes, lambda v: v == name))).alias("fewer"),
            F.array_position(votes, name).alias("first_at"),
            name.alias("name"),
        ),
    )
    fallback = F.array_join(F.transform(F.slice(split, 1, 2), lambda k: F.initcap(k)), " / ")
    return (
        F.when(F.size(split) == 0, F.lit(GENERAL))
        .when(F.size(votes) == 0, fallback)
        .otherwise(F.array_min(ranked)["name"])
    )
