"""Chat formatting with typed content parts, as column expressions.

A message's content is a list of parts: text, image, audio or document. One visit
per kind turns a part into text: a text part is escaped, an attachment becomes a
numbered placeholder and is recorded with its reference and the number of tokens
the placeholder stands for. Turns are marked with control strings; in texts,
roles and references the characters that control strings are made of are escaped,
so no text can forge one, and unescaping gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
TURN_OPEN, ROLE_END, TURN_CLOSE = '<turn role="', '">', "</turn>\n"
# What is escaped, in order; unescaping goes backwards.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
PATCH = 14  # pixels a side of an image token
AUDIO_TOKENS_PER_SECOND = 25
PAGE_TOKENS = 256


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A text as content: one text part; null counts as empty."""
    empty = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(
        F.lit("text").alias("kind"),
        F.coalesce(text, F.lit("")).alias("text"),
        *[F.lit(None).cast(kind).alias(name) for name, kind in empty.items()],
    )
    return F.array(part)


def expanded_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder stands for; unknown sizes count as one unit."""

    def units(size: Column, unit: int) -> Column:
        return F.greatest(F.ceil(F.coalesce(size, F.lit(1)) / F.lit(unit)), F.lit(1)).cast("long")

    return (
        F.when(part["kind"] == "image", units(part["width"], PATCH) * units(part["height"], PATCH))
        .when(part["kind"] == "audio", F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(1.0)) * AUDIO_TOKENS_PER_SECOND), F.lit(1)).cast("long"))
        .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)).cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0).cast("long"))
    )


def _visited(parts: Column) -> Column:
    """(written, n) of a message's parts: the written content and its number of attachments.

    Attachments are numbered from 0 within the message, in order of their parts. A
    null part is skipped; a part of unknown kind is an attachment without tokens.
    """
    start = F.struct(F.lit("").alias("written"), F.lit(0).alias("n"))

    def visit(done: Column, part: Column) -> Column:
        attached = F.coalesce(part["kind"], F.lit("text")) != "text"
        placeholder = F.concat(
            F.lit("<"), escape(part["kind"]), F.lit(' id="'), done["n"].cast("string"),
            F.lit('" ref="'), escape(F.coalesce(part["ref"], F.lit(""))), F.lit('"/>'),
        )
        piece = F.when(attached, placeholder).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
        return F.struct(
            F.concat(done["written"], piece).alias("written"), (done["n"] + attached.cast("int")).alias("n")
        )

    return F.aggregate(F.filter(parts, lambda p: p.isNotNull()), start, visit)


def format_conversations(
    messages: DataFrame,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    parts_column: str = "parts",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``messages`` has a row per turn with its ``parts`` (``PART``). Turns come in
    order; rows that repeat a turn follow by role and content; null turns come
    first, null roles are empty, null content has no parts; conversations with a
    null id are one. ``loss_spans`` are (start, length) in code points of
    ``formatted`` covering the content of the turns whose role is in
    ``loss_roles``. ``attachments`` lists (turn position, number, kind, ref, tokens).
    """
    rows = messages.select(
        messages[f"`{conv_column}`"].alias("conv_id"),
        messages[f"`{turn_column}`"].alias("turn"),
        F.coalesce(messages[f"`{role_column}`"], F.lit("")).alias("role"),
        F.coalesce(messages[f"`{parts_column}`"], F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    visited = rows.select(
        "conv_id",
        F.struct(
            "turn",
            "role",
            _visited(F.col("parts"))["written"].alias("content"),
            F.transform(
                F.filter("parts", lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"),
                lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens")),
            ).alias("attached"),
        ).alias("t"),
    )
    whole = visited.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(TURN_OPEN), escape(t["role"]), F.lit(ROLE_END))

    pieces = F.transform("turns", lambda t: F.concat(head(t), t["content"], F.lit(TURN_CLOSE)))
    blank = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def mark(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(head(t))
        size = F.length(t["content"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        spans = F.when(t["role"].isin(*loss_roles), F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((start + size + len(TURN_CLOSE)).alias("at"), spans.alias("spans"))

    attachments = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(
                t["attached"],
                lambda a, k: F.struct(
                    i.alias("position"), k.alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")
                ),
            ),
        )
    )
    out = whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(pieces, "").alias("formatted"),
        F.aggregate("turns", blank, mark)["spans"].alias("loss_spans"),
        attachments.alias("attachments"),
    )
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"])
    return out.withColumn("expanded_tokens", tokens)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss array<string>, formatted) read from the formatted text alone.

    ``text`` keeps placeholders as they are written; ``loss`` are the texts under the
    mask, unescaped.
    """
    pieces = F.slice(F.split("formatted", F.lit(TURN_CLOSE)), F.lit(1), F.size(F.split("formatted", F.lit(TURN_CLOSE))) - 1)

    def parsed(piece: Column) -> Column:
        end = F.instr(piece, F.lit(ROLE_END))
        role = F.substring(piece, F.lit(len(TURN_OPEN) + 1), end - F.lit(len(TURN_OPEN) + 1))
        text = F.substring(piece, end + F.lit(len(ROLE_END)), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    spoken = F.transform(
        "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    )
    return formatted.select("conv_id", "formatted", F.transform(pieces, parsed).alias("turns"), spoken.alias("loss"))
