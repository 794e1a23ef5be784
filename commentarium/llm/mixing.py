"""Mixing sources to target weights by Sainte-Lague apportionment.

Each source's target is its weight's share of all words, but at most three times
what it holds; what is above flows back by weight (a water level, found in one
pass over the sources). Targets become blocks of equal token counts: Sainte-Lague
gives every next block to the source with the highest quotient
target / (2 * blocks + 1), and each source's blocks to its shards the same way. In a
shard, documents are laid end to end in seeded order and a seeded permutation of
the shard's blocks says which are taken in the last, partial round.

Highest quotients are found without listing all blocks: a divisor above gives what
is certain, a divisor below what is possible, and the few between are ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commentarium.llm.common import plain, set_aside, word_count, written
from commentarium.operators.joins import lookup_join

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_DOCS = 2_000
SEED = 17
_STRIDE = 2_147_483_647  # a prime above any shard's number of blocks: a permutation of them


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``; one row per source.

    Sources by code point, null last, weigh ``weights`` in turn. The windows below see
    one row per source, never a row per document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    named = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("long"))
    named = named.withColumn("cap", F.col("source_size") * repeats)
    everything = Window.partitionBy()
    by_fill = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    filled = named.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_fill), F.lit(0))).alias("left"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0))).alias("heft"),
    )
    wide = "decimal(19,0)"
    full = F.col("cap").cast(wide) * F.col("heft").cast(wide) <= F.col("left").cast(wide) * F.col("weight").cast(wide)
    filled = filled.withColumn("full", full)
    # The water level is what is left for the sources that are not full.
    level = filled.select(
        "source", "source_size", "weight", "cap", "full",
        F.max(F.when(~F.col("full"), F.col("left"))).over(everything).alias("left"),
        F.max(F.when(~F.col("full"), F.col("heft"))).over(everything).alias("heft"),
    )
    share = (F.col("weight") * F.col("left")).cast("double") / F.col("heft")
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return level.select("source", "source_size", "weight", target.alias("target"))


def sainte_lague(parties: DataFrame, group: str, party: str) -> DataFrame:
    """``parties(group, party, votes double, blocks long)`` with ``won``: blocks by highest quotients within the group.

    ``blocks`` is the group's number, the same in each of its rows. Ties go to the
    smaller party. Parties without votes win nothing.
    """
    whole = Window.partitionBy(group)
    n, total = F.count_if(F.col("votes") > 0).over(whole), F.sum("votes").over(whole)
    sized = parties.withColumn("_n", n).withColumn("_total", total)
    # With divisor d a party gets floor(votes / d + 1/2) blocks, and all parties total / d within n / 2.
    sure = F.when(F.col("blocks") > F.col("_n") / 2 + 1, F.floor(F.col("votes") * (F.col("blocks") - F.col("_n") / 2 - 1) / F.col("_total") + 0.5))
    possible = F.floor(F.col("votes") * (F.col("blocks") + F.col("_n") / 2 + 1) / F.col("_total") + 0.5)
    some = (F.col("votes") > 0) & (F.col("blocks") > 0)
    sized = sized.withColumn("_sure", F.when(some, F.coalesce(sure, F.lit(0))).otherwise(0).cast("long"))
    sized = sized.withColumn("_possible", F.when(some, possible).otherwise(0).cast("long"))
    open_blocks = sized.withColumn("_open", F.col("blocks") - F.sum("_sure").over(whole))
    between = F.when(F.col("_possible") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_possible")))
    ranked = open_blocks.select("*", F.explode_outer(between).alias("_k"))
    quotient = F.col("votes") / (2 * F.col("_k") - 1)
    order = Window.partitionBy(group).orderBy(quotient.desc_nulls_last(), F.col(party).asc_nulls_last(), "_k")
    ranked = ranked.withColumn("_rank", F.row_number().over(order))
    extra = F.count_if(F.col("_k").isNotNull() & (F.col("_rank") <= F.col("_open")))
    keys = [c for c in parties.columns]
    return ranked.groupBy(*keys, "_sure").agg(extra.alias("_extra")).select(*keys, (F.col("_sure") + F.col("_extra")).alias("won"))


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _overlaps() -> Column:
    """(from, to) word ranges of a document that the last, partial round takes; positions in the shard."""
    block = F.lit(BLOCK_WORDS).cast("long")

    def taken(b: Column) -> Column:
        whole = b < F.col("full_blocks")
        turn = F.pmod(b * F.lit(_STRIDE).cast("long") + F.col("offset"), F.greatest(F.col("full_blocks"), F.lit(1)))
        before = F.when(whole, turn).otherwise(F.col("full_blocks")) * block
        words = F.least(F.greatest(F.col("rest") - before, F.lit(0)), block)
        return F.struct(
            F.greatest(F.col("start"), b * block).alias("from"),
            F.least(F.col("start") + F.col("size"), b * block + words).alias("to"),
        )

    blocks = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    ranges = F.filter(F.transform(blocks, taken), lambda s: s["to"] > s["from"])
    return F.when((F.col("size") > 0) & (F.col("rest") > 0), ranges).otherwise(
        F.array().cast("array<struct<from:bigint,to:bigint>>")
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every row: doc_id, text_hash, source, size, source_size, target, repeats, spans, taken.

    ``repeats`` whole copies, then the word ranges ``spans`` (start, length; words
    from 0) once more; ``taken`` counts the words, 0 for rows without words, null texts
    among them, which are repeated as their shard is; null sources are one source, the last; rows
    that repeat an id count each by itself. Equal calls give equal results.
    """
    size = word_count(F.col("text"))
    given = plain(docs, doc_id=id_column, text=text_column, source=source_column)
    rows = written(
        given.select("doc_id", F.xxhash64("text").alias("text_hash"), "source", _key(F.col("source")).alias("key"), size.alias("size")),
        "mix-sizes",
    )
    held = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    aims = written(
        targets(held.select("source", "source_size")).join(held.select(F.col("source").alias("s"), "docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s"),
        "mix-targets",
    )
    total = F.sum("source_size").over(Window.partitionBy())
    seats = sainte_lague(
        aims.select(F.lit(0).alias("all"), _key(F.col("source")).alias("key"), F.col("target").alias("votes"), F.round(total / BLOCK_WORDS).cast("long").alias("blocks")),
        "all",
        "key",
    ).select("key", F.col("won").alias("source_blocks"))
    by_source = aims.select(
        _key(F.col("source")).alias("key"), "source_size", "target", F.ceil(F.col("docs") / SHARD_DOCS).cast("long").alias("shards")
    ).join(seats, "key")
    dealt = lookup_join(rows, by_source, "key", "inner", spread_by="doc_id")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    in_order = Window.partitionBy("key", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size", "text_hash")
    laid = dealt.withColumn("start", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    laid = written(laid, "mix-laid")
    shards = laid.groupBy("key", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("blocks"))
    won = sainte_lague(
        shards.select("key", "shard", F.col("shard_size").cast("double").alias("votes"), "blocks"), "key", "shard"
    )
    quota = F.least(F.col("won") * BLOCK_WORDS, F.col("votes").cast("long") * MAX_REPEATS)
    shard_size = F.col("votes").cast("long")
    plans = won.select(
        "key",
        "shard",
        F.when(shard_size > 0, F.floor(quota / F.greatest(shard_size, F.lit(1)))).otherwise(0).cast("long").alias("repeats"),
        F.when(shard_size > 0, F.pmod(quota, F.greatest(shard_size, F.lit(1)))).otherwise(0).alias("rest"),
        F.floor(shard_size / BLOCK_WORDS).alias("full_blocks"),
        F.pmod(F.xxhash64("key", "shard", F.lit(seed)), F.lit(1 << 30)).alias("offset"),
    )
    done = laid.join(plans, ["key", "shard"]).withColumn("ranges", _overlaps())
    spans = F.transform("ranges", lambda r: F.struct((r["from"] - F.col("start")).alias("start"), (r["to"] - r["from"]).alias("length")))
    once_more = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + (r["to"] - r["from"]))
    return done.select(
        "doc_id",
        "text_hash",
        "source",
        "size",
        "source_size",
        "target",
        "repeats",
        spans.alias("spans"),
        (F.col("repeats") * F.col("size") + once_more).alias("taken"),
    )


def _row_key() -> Column:
    """What tells rows apart, without nulls: id, text and source."""

    def never_null(c: str) -> list[Column]:
        return [F.coalesce(F.col(c).cast("string"), F.lit("")), F.isnull(c)]

    return F.struct(*[c.alias(f"k{n}") for n, c in enumerate([*never_null("doc_id"), F.col("text_hash"), *never_null("source")])])


def apply_mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed collection, with the columns of ``docs``: a row per whole copy and one for the words taken once more.

    Rows without repeats and spans are absent; a partial row's text is its words, joined by
    blanks. ``n_chars`` follows the text where that column exists.
    Rows equal in id, text and source get one plan each, so that together they give
    the words that ``mix`` takes of them. Other columns stay, whatever their names.
    """
    plan = written(mix(docs, seed=seed).select(_row_key().alias("_key"), "repeats", "spans"), "mix-plan")
    rows = set_aside(docs, "doc_id", "text", "source")
    given = rows.columns
    rows = rows.withColumn("text_hash", F.xxhash64("text")).withColumn("_key", _row_key()).drop("text_hash")
    on = ["_key"]
    if plan.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        on.append("_turn")
        plan = plan.withColumn("_turn", F.row_number().over(Window.partitionBy("_key").orderBy("repeats", "spans")))
        rows = rows.withColumn("_turn", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*given))))
    rows = rows.join(plan, on)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    part = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["length"].cast("int")))), " ")
    copies = F.when(F.col("repeats") > 0, F.array_repeat(F.lit(None).cast("string"), F.col("repeats").cast("int"))).otherwise(F.array().cast("array<string>"))
    pieces = F.concat(copies, F.when(F.size("spans") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("_piece", F.explode(pieces)).withColumn("text", F.coalesce("_piece", "text"))
    out = out.select(given).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
