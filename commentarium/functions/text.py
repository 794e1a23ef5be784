"""Column expressions that clean, tokenise and mark up a comment.

Everything here is a pure expression over one row: no action, no shuffle, no
Python worker. The same expressions therefore serve batch and streaming frames.

Whole texts are processed. ``truncate`` exists because cutting a comment is a
feature users may ask for (``max_chars``); nothing calls it unasked.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MAX_CHARS = 600
MIN_TOKENS = 2
NEGATION_PREFIX = "NEG_"
NEGATION_WINDOW = 3

# Whitespace as Unicode defines it, plus the four ASCII separators that
# Java's White_Space property leaves out.
_SPACE = r"\s\x1c-\x1f"
URL_PATTERN = rf"(?U)(?:https?://|www\.)[^{_SPACE}]+"
URL_PATTERN_ANY_CASE = rf"(?Ui)(?:https?://|www\.)[^{_SPACE}]+"
DIGITS_PATTERN = r"\p{Nd}+"
# Letters and every kind of number stay; combining marks do not.
SYMBOLS_PATTERN = rf"(?U)[^\p{{L}}\p{{N}}_{_SPACE}]+"
SPACES_PATTERN = rf"(?U)[{_SPACE}]+"
# Digits, symbols and underscores in one pass: all that is left are letters,
# non-decimal numbers and whitespace.
DROPPED_PATTERN = rf"(?U)[^\p{{L}}\p{{Nl}}\p{{No}}{_SPACE}]+"


def as_text(value: Column) -> Column:
    """A string for every row; null becomes the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def truncate(text: Column, max_chars: int = MAX_CHARS) -> Column:
    return F.substring(text, 1, max_chars)


def was_truncated(text: Column, max_chars: int = MAX_CHARS) -> Column:
    return F.length(text) > max_chars


def strip_urls(text: Column, any_case: bool = False) -> Column:
    return F.regexp_replace(text, URL_PATTERN_ANY_CASE if any_case else URL_PATTERN, "")


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, DIGITS_PATTERN, "")


def strip_symbols(text: Column) -> Column:
    return F.regexp_replace(text, SYMBOLS_PATTERN, "")


def strip_underscores(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(""))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES_PATTERN, " "))


def clean(text: Column, max_chars: int | None = None, any_case_urls: bool = False) -> Column:
    """Drop URLs, digits, symbols and underscores; lowercase; single spaces.

    Equal to chaining the single steps above in that order. The three character
    deletions commute once URLs are gone, so they run as one regex pass.
    """
    text = as_text(text)
    if max_chars is not None:
        text = truncate(text, max_chars)
    return collapse_spaces(
        F.lower(F.regexp_replace(strip_urls(text, any_case_urls), DROPPED_PATTERN, ""))
    )


def split_tokens(text: Column) -> Column:
    """Tokens of a cleaned text; the empty text has none.

    Like the gate below it names its input once: Spark may inline an expression
    wherever it is named, and this one carries all of the cleaning.
    """
    return F.array_remove(F.split(text, " "), "")


def blank_if_short(cleaned: Column) -> Column:
    """Blank a cleaned text of fewer than two tokens (no inner space); keep the row."""
    return F.regexp_replace(cleaned, r"\A[^ ]*\z", "")


def keep_tokens(tokens: Column, stopwords: Iterable[str], always: Iterable[str] = ()) -> Column:
    """Remove stopwords, except those in ``always``.

    A literal ``isin`` over more than ten values becomes a hash-set probe.
    """
    kept = set(always)
    dropped = sorted(w for w in set(stopwords) if w not in kept)
    if not dropped:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(dropped))


def mark_negations(
    text: Column,
    negations: Iterable[str],
    prefix: str = NEGATION_PREFIX,
    window: int = NEGATION_WINDOW,
) -> Column:
    """Prefix the ``window`` tokens after each negation.

    A negation inside an open window is prefixed like any token and opens no
    window of its own, which is what non-overlapping left-to-right regex matches
    give. Sentinel tokens pad the end so that every match has a full window.
    Linear in the text, unlike an array fold that copies its accumulator.
    """
    words = sorted(set(negations), key=lambda w: (-len(w), w))
    if not words:
        return text
    sentinel = "\x01"
    padded = F.concat(F.lit(" "), text, F.lit(f" {sentinel}" * window))
    pattern = f" ({'|'.join(words)})" + " ([^ ]+)" * window
    replacement = " $1" + "".join(f" {prefix}${i + 2}" for i in range(window))
    marked = F.regexp_replace(padded, pattern, replacement)
    return F.ltrim(F.regexp_replace(marked, f" (?:{prefix})?{sentinel}", ""))


def ngrams(tokens: Column, n: int) -> Column:
    """Adjacent n-grams joined by a space; empty when there are too few tokens."""
    if n == 1:
        return tokens
    grams = tokens
    for step in range(1, n):
        # Shift by one and zip; the shorter side ends the array.
        rest = F.slice(tokens, step + 1, F.greatest(F.size(tokens) - step, F.lit(0)))
        head = F.slice(grams, 1, F.size(rest))
        grams = F.zip_with(head, rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)
