"""Collocations: phrases of two to four words that hold together, by language.

Texts are cut into shards of bounded length, and every shard gets an FM-index over word
ids: the Burrows-Wheeler transform of its sequence of words and that of the
reversed sequence, both sorted to the depth of the longest phrase. A phrase is an
interval in either one; one step extends all intervals at hand by every word that stands to
their left (or right) and keeps both intervals in step. Shards send the phrases that they meet with
their counts, which are summed across shards.

Phrases grow level by level: right, left, right. A phrase can be frequent only if both phrases
without its first or last word are, so a shard extends just those intervals whose phrase
passes a filter of the frequent phrases of the level before. The filter is a bitmap
of bounded size: it lets all frequent phrases pass and few others, whose true
counts then decide. So the rows shuffled are those of phrases made of frequent ones, not of
all word sequences. Pairs of words, most of which are rare, are first summed by a short hash alone.

Edges. Null texts have no words; a null language is ``und``. Repeated rows count each. Extra columns
are ignored. Very long texts are spread over shards piece by piece (a piece ends at
punctuation; one piece is never cut, so it must fit in memory). An empty table, or one without
frequent phrases, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentarium.llm.common import batch_rows, bounded_batches, discard, mixed, odd_constants, plain, written

# Fixed values of the contract.
LONGEST = 4
LEAST_COUNT = 30
SCORE_SCALE = 2_000_000
CONTAINED_PERCENT = 80
TOP = 2_000
NO_LANGUAGE = "und"

SHARD_WORDS = 400_000
_CHUNK = 1 << 20
_EMIT_ROWS = 20_000
_FILTER_BITS = (1 << 16, 1 << 27)  # least and most: 16 MB are broadcast at most
_BITS_A_PHRASE = 16
_PACKED = "zstd"  # word ids and transforms are most of the disk
_BREAK, _BLANK = 0, -1

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes.maketrans(_ENDS + b"\t", b"\n" * len(_ENDS) + b" ")
_FACTORS = odd_constants(LONGEST, seed=12)


# --- Shards ------------------------------------------------------------------------


class _Ids(dict):
    """Numbers of a language's words in a shard, given out as words come."""

    def __init__(self, words: list[bytes], lang: int, langs: list[int]):
        super().__init__({b"": _BLANK, b"\n": _BREAK})
        self.words, self.lang, self.langs = words, lang, langs

    def __missing__(self, word: bytes) -> int:
        self.words.append(word)
        self.langs.append(self.lang)
        self[word] = at = len(self.words)
        return at


class _Shard:
    def __init__(self):
        self.words: list[bytes] = []
        self.lang_of: list[int] = []
        self.langs: dict[str, _Ids] = {}
        self.parts: list[np.ndarray] = [np.zeros(1, dtype=np.int32)]
        self.size = 1

    def add(self, lang: str, text: bytes) -> None:
        """Words of a text, with a break around every piece."""
        ids = self.langs.get(lang)
        if ids is None:
            ids = self.langs[lang] = _Ids(self.words, len(self.langs), self.lang_of)
        parts = text.lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(ids.__getitem__, parts), dtype=np.int32, count=len(parts))
        found = np.append(found[found != _BLANK], np.int32(_BREAK))
        stays = found != _BREAK
        stays[1:] |= found[:-1] != _BREAK
        found = found[stays]
        self.parts.append(found)
        self.size += len(found)

    def row(self) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids, minlength=len(self.words) + 1)[1:]
        columns = {
            "ids": [ids.tobytes()],
            "langs": [list(self.langs)],
            "words": [[w.decode("utf-8") for w in self.words]],
            "lang_of": [self.lang_of],
            "counts": [counts.tolist()],
        }
        return pa.RecordBatch.from_pydict(columns, schema=_SHARD_ARROW)


_SHARD_ARROW = pa.schema(
    [
        ("ids", pa.binary()),
        ("langs", pa.list_(pa.string())),
        ("words", pa.list_(pa.string())),
        ("lang_of", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int64())),
    ]
)
_SHARD = "ids binary, langs array<string>, words array<string>, lang_of array<int>, counts array<bigint>"


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``_CHUNK`` bytes, cut between pieces only."""
    while len(text) > _CHUNK:
        cut = next((i for i in range(_CHUNK, len(text)) if text[i] in _ENDS), len(text))
        yield text[:cut]
        text = text[cut:]
    yield text


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Word ids and vocabulary of every shard; texts stay in the task that reads them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            waiting: dict[str, list[bytes]] = {}
            sizes: dict[str, int] = {}
            langs = batch.column("lang").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for at, (lang, text) in enumerate(zip(langs, texts, strict=True)):
                for part in _pieces(text or b""):
                    waiting.setdefault(lang, []).append(part)
                    sizes[lang] = sizes.get(lang, 0) + len(part)
                    if sizes[lang] >= _CHUNK or at == len(texts) - 1:
                        for ready in [lang] if at < len(texts) - 1 else list(waiting):
                            shard.add(ready, b"\n".join(waiting.pop(ready)))
                            sizes[ready] = 0
                            if shard.size >= shard_words:
                                yield shard.row()
                                shard = _Shard()
        if shard.words:
            yield shard.row()

    bounded_batches(docs.sparkSession)
    given = plain(docs, lang="lang", text="text").select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    return given.mapInArrow(cut, _SHARD)


def word_counts(cut: DataFrame) -> DataFrame:
    """(lang, phrase, f) of all single words."""
    at = F.explode(F.arrays_zip("words", "lang_of", "counts")).alias("w")
    return (
        cut.select("langs", at)
        .select(F.get("langs", F.col("w.lang_of")).alias("lang"), F.col("w.words").alias("phrase"), F.col("w.counts").alias("f"))
        .groupBy("lang", "phrase")
        .agg(F.sum("f").alias("f"))
    )


# --- Filters -----------------------------------------------------------------------


def _word_hashes(words: list[str], langs: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    pairs = zip(langs, words, strict=True)
    return np.fromiter((digest(f"{lang}\0{word}") for lang, word in pairs), dtype=np.uint64, count=len(words))


def _phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases from their words' hashes, one array per place."""
    total = columns[0] * _FACTORS[0]
    for factor, column in zip(_FACTORS[1:], columns[1:], strict=False):
        total = total + column * factor
    return mixed(total)


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mask = np.uint64(bits - 1)
    return [(hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)]


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    inside = np.ones(len(hashes), dtype=bool)
    for place in _places(hashes, len(bitmap) * 8):
        inside &= (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return inside


def _bitmap(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray]) -> Broadcast:
    """A bitmap that the hashes of all rows pass, at most 16 MB whatever their number."""
    bits, most = _FILTER_BITS
    count = rows.count()
    while bits < most and bits < count * _BITS_A_PHRASE:
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.unique(np.concatenate(_places(hashes_of(batch), bits)))
            slots, first = np.unique(place >> 6, return_index=True)
            marks = np.left_shift(np.uint64(1), (place & 63).astype(np.uint64))
            merged = np.bitwise_or.reduceat(marks, first).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(merged)], ["slot", "marks"])

    marked = rows.mapInArrow(mark, "slot bigint, marks bigint")
    table = marked.groupBy("slot").agg(F.bit_or("marks").alias("marks")).toArrow()  # at most two million slots
    bitmap = np.zeros(bits // 64, dtype=np.int64)
    bitmap[table.column("slot").to_numpy()] = table.column("marks").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(bitmap.view(np.uint8))


def frequent_filter(frequent: DataFrame) -> Broadcast:
    """A bitmap that all phrases of ``frequent(lang, phrase)`` pass; they have equally many words."""

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        langs, split = batch.column("lang").to_pylist(), [p.split(" ") for p in batch.column("phrase").to_pylist()]
        return _phrase_hashes([_word_hashes([s[k] for s in split], langs) for k in range(len(split[0]))])

    return _bitmap(frequent.select("lang", "phrase"), hashes)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The 32 bits of a phrase's hash that candidates are counted by."""
    return hashes & np.uint64(0xFFFFFFFF)


def candidate_filter(counted: DataFrame) -> Broadcast:
    """A bitmap that all phrases pass whose short hash is among ``counted(h)``."""
    return _bitmap(counted.select("h"), lambda batch: mixed(batch.column("h").to_numpy().astype(np.uint64)))


# --- FM-index ----------------------------------------------------------------------


def transform(sequence: np.ndarray, symbols: int) -> np.ndarray:
    """The Burrows-Wheeler transform of a sequence of numbers below ``symbols``, sorted by ``LONGEST`` symbols.

    The sequence starts and ends with a break, so the transform has the same symbols. Intervals of patterns up to that length are those of the full transform.
    """
    padded = np.concatenate([sequence, np.zeros(LONGEST, dtype=sequence.dtype)]).astype(np.uint64)
    pairs = padded[:-1] * np.uint64(symbols) + padded[1:]
    if symbols <= 1 << 16:
        unit = np.uint64(symbols * symbols)  # four symbols are one number
    else:
        known, pairs = np.unique(pairs, return_inverse=True)
        unit = len(known)
    order = np.argsort(pairs[: len(sequence)] * unit + pairs[2 : len(sequence) + 2])
    return np.concatenate([[_BREAK], sequence])[order].astype(np.int32)


class _Half:
    """One transform with what backward steps need: where symbols start, and how often one stands before a place."""

    def __init__(self, bwt: np.ndarray, symbols: int):
        self.bwt, self.symbols = bwt, symbols
        self.counts = np.bincount(bwt, minlength=symbols)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]])

    @cached_property
    def places(self) -> np.ndarray:
        """Symbols with their places, in order."""
        return np.sort(self.bwt.astype(np.int64) * (len(self.bwt) + 1) + np.arange(len(self.bwt)))

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first row of ``symbol`` followed by the pattern whose rows start at ``at``."""
        return np.searchsorted(self.places, symbol * (len(self.bwt) + 1) + at)

    def before(self, low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(interval, symbol, count, count of smaller symbols) of all symbols before the rows of every interval."""
        rows = np.repeat(low - np.cumsum(size) + size, size)
        rows += np.arange(len(rows))
        width = np.uint32 if len(low) * self.symbols < 1 << 32 else np.int64
        keys = np.repeat((np.arange(len(low)) * self.symbols).astype(width), size)
        keys += self.bwt[rows].astype(width)
        del rows
        keys, counts = np.unique(keys, return_counts=True)
        interval, symbol = np.divmod(keys.astype(np.int64), self.symbols)
        done = np.cumsum(counts) - counts
        starts = np.searchsorted(interval, np.arange(len(low)))
        smaller = done - done[np.minimum(starts, max(len(done) - 1, 0))][interval] if len(done) else done
        return interval, symbol, counts, smaller


@dataclass
class Intervals:
    """Phrases of one length: their words, and their rows in the transforms of the text and of the reversed text."""

    words: np.ndarray  # one row a phrase
    forward: np.ndarray
    backward: np.ndarray
    size: np.ndarray


@dataclass
class Neighbours:
    """Words beside phrases on one side: the phrase, the longer phrase, its count and the count of smaller words there."""

    parent: np.ndarray
    words: np.ndarray
    size: np.ndarray
    smaller: np.ndarray

    def where(self, kept: np.ndarray) -> "Neighbours":
        return Neighbours(self.parent[kept], self.words[kept], self.size[kept], self.smaller[kept])


class Index:
    """A bidirectional FM-index of one shard; symbol 0 breaks phrases."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, symbols: int):
        self.forward, self.backward = _Half(forward, symbols), _Half(backward, symbols)

    def single(self) -> Intervals:
        words = np.arange(1, self.forward.symbols)
        return Intervals(words[:, None], self.forward.starts[1:], self.backward.starts[1:], self.forward.counts[1:])

    def neighbours(self, given: Intervals, left: bool) -> Neighbours:
        """All phrases of one more word, on the left or on the right, that occur."""
        own, low = (self.forward, given.forward) if left else (self.backward, given.backward)
        parent, word, size, smaller = own.before(low, given.size)
        kept = word != _BREAK
        parent, word, held = parent[kept], word[kept], given.words[parent[kept]]
        return Neighbours(parent, np.column_stack([word, held] if left else [held, word]), size[kept], smaller[kept])

    def extend(self, given: Intervals, found: Neighbours, left: bool) -> Intervals:
        """The intervals of longer phrases: a backward step in one transform, a shift in the other."""
        if left:
            forward = self.forward.step(found.words[:, 0], given.forward[found.parent])
            return Intervals(found.words, forward, given.backward[found.parent] + found.smaller, found.size)
        backward = self.backward.step(found.words[:, -1], given.backward[found.parent])
        return Intervals(found.words, given.forward[found.parent] + found.smaller, backward, found.size)


def _width(symbols: int) -> type:
    """The narrowest numbers that hold a shard's symbols."""
    return np.uint16 if symbols <= 1 << 16 else np.int32


_INDEX = "forward binary, backward binary, langs array<string>, words array<string>, lang_of array<int>, hashes binary"


def indexes(cut: DataFrame, words: Broadcast) -> DataFrame:
    """The FM-index of every shard over the words that can be in a phrase; all others break phrases."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, langs, names, lang_of = (batch.column(c)[row] for c in ("ids", "langs", "words", "lang_of"))
                langs, names, lang_of = langs.as_py(), names.values.to_pylist(), lang_of.values.to_numpy()
                hashes = _word_hashes(names, [langs[k] for k in lang_of])
                inside = _passes(words.value, _phrase_hashes([hashes]))
                number = np.zeros(len(names) + 1, dtype=np.int64)
                number[1:][inside] = np.arange(1, int(inside.sum()) + 1)
                sequence = number[np.frombuffer(ids.as_py(), dtype=np.int32)]
                stays = sequence != _BREAK
                stays[1:] |= sequence[:-1] != _BREAK
                stays[0] = True  # a shard starts and ends with a break
                sequence = sequence[stays]
                symbols = int(inside.sum()) + 1
                kept = np.flatnonzero(inside)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([transform(sequence, symbols).astype(_width(symbols)).tobytes()], pa.binary()),
                        pa.array([transform(sequence[::-1], symbols).astype(_width(symbols)).tobytes()], pa.binary()),
                        pa.array([langs], pa.list_(pa.string())),
                        pa.array([[names[k] for k in kept]], pa.list_(pa.string())),
                        pa.array([lang_of[kept].tolist()], pa.list_(pa.int32())),
                        pa.array([hashes[kept].tobytes()], pa.binary()),
                    ],
                    ["forward", "backward", "langs", "words", "lang_of", "hashes"],
                )

    return cut.select("ids", "langs", "words", "lang_of").mapInArrow(build, _INDEX)


def _found(index: DataFrame, length: int, filters: dict[int, Broadcast], emit: Callable, schema: str) -> DataFrame:
    """What ``emit(words, counts, hashes, names, langs)`` makes of every shard's phrases of ``length`` words.

    ``filters`` has the filter of every length below (those of single words are in the index).
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                names, lang_of = batch.column("words")[row].values, batch.column("lang_of")[row].values
                if not len(names):
                    continue
                width = _width(len(names) + 1)
                stored = (np.frombuffer(batch.column(c)[row].as_py(), dtype=width) for c in ("forward", "backward"))
                forward, backward = (half.astype(np.int32) for half in stored)
                langs = batch.column("langs")[row].values.take(lang_of)
                hashes = np.concatenate([[np.uint64(0)], np.frombuffer(batch.column("hashes")[row].as_py(), dtype=np.uint64)])
                index = Index(forward, backward, len(names) + 1)
                held = index.single()
                for words in range(2, length + 1):
                    left = words % 2 == 1
                    found = index.neighbours(held, left)
                    if words > 2:  # the part that does not come from the shorter phrase
                        other = found.words[:, :-1] if left else found.words[:, 1:]
                        found = found.where(_passes(filters[words - 1].value, _phrase_hashes([hashes[c] for c in other.T])))
                    if words < length:
                        found = found.where(_passes(filters[words].value, _phrase_hashes([hashes[c] for c in found.words.T])))
                        held = index.extend(held, found, left)
                for start in range(0, len(found.size), _EMIT_ROWS):
                    part = found.words[start : start + _EMIT_ROWS]
                    yield emit(part, found.size[start : start + _EMIT_ROWS], _phrase_hashes([hashes[c] for c in part.T]), names, langs)

    return index.mapInArrow(find, schema)


def phrase_hashes(index: DataFrame, length: int, filters: dict[int, Broadcast]) -> DataFrame:
    """(h, f): short hashes of phrases and their counts, a row for each shard and phrase."""

    def emit(words, counts, hashes, names, langs):
        columns = [pa.array(_short(hashes).astype(np.int64)), pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["h", "f"])

    return _found(index, length, filters, emit, "h bigint, f bigint")


def phrases(index: DataFrame, length: int, filters: dict[int, Broadcast], candidates: Broadcast | None = None) -> DataFrame:
    """(lang, phrase, f): phrases (that pass ``candidates``) and their counts, a row for each shard that holds one."""

    def emit(words, counts, hashes, names, langs):
        if candidates is not None:
            kept = _passes(candidates.value, mixed(_short(hashes)))
            words, counts = words[kept], counts[kept]
        words = words - 1
        phrase = pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in words.T], " ")
        columns = [langs.take(pa.array(words[:, 0])), phrase, pa.array(counts, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "f"])

    return _found(index, length, filters, emit, "lang string, phrase string, f bigint")


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, dict[int, DataFrame]]:
    """(words of every language, frequent phrases by length): (lang, n) and, for each length from 1, (lang, phrase, f)."""
    spark = docs.sparkSession

    def saved(df: DataFrame, name: str, compression: str | None = None, wide: bool = False) -> DataFrame:
        with batch_rows(spark, 1):  # a row read is a shard of several MB
            return written(df, name, compression, wide)

    cut = written(shards(docs, shard_words), "shards", _PACKED, wide=True)
    words = saved(word_counts(cut), "words")
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    found = {1: words.where(F.col("f") >= least)}
    filters = {1: frequent_filter(found[1])}
    index = saved(indexes(cut, filters[1]), "fm-index", _PACKED, wide=True)
    discard(cut)
    filters[1].unpersist()
    for length in range(2, LONGEST + 1):
        candidates = None
        if length == 2:
            # Most pairs of words are rare. Their hashes are summed first, at half the shuffle; sums of pairs that share a
            # hash are too great, never too small, and the pairs left are then counted by their words.
            hashed = phrase_hashes(index, length, filters).groupBy("h").agg(F.sum("f").alias("f"))
            candidates = candidate_filter(saved(hashed.where(F.col("f") >= least), "hashes"))
        counted = phrases(index, length, filters, candidates).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found[length] = saved(counted.where(F.col("f") >= least), f"phrases-{length}")
        if candidates is not None:
            candidates.unpersist()
        if length < LONGEST:
            filters[length] = frequent_filter(found[length])
    discard(index)
    for used in filters.values():
        used.unpersist()
    return sizes, found


# --- Scores ------------------------------------------------------------------------


def _part(start: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", start, length), " ")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of every language's best phrases.

    A phrase's score is that of the cut into two parts where the parts predict it worst.
    Phrases that mostly occur inside a longer frequent one are left out. It suffices to look
    at phrases with one more word: those with two more contain one of them that is no rarer.
    """
    sizes, found = frequent_phrases(docs, least, shard_words)
    longer = found[2].unionByName(found[3]).unionByName(found[4])
    everything = found[1].unionByName(longer)
    listed = longer.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    size = F.size("words")

    cuts = listed.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, size).alias("rest")
    )
    counted = cuts.join(everything.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(
        everything.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]
    )
    score = F.expr(f"cast(cast(a AS decimal(20,0)) * {SCORE_SCALE} div (cast(l AS decimal(20,0)) + r) AS bigint)")
    best = counted.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    within = (
        listed.where(size > 2)
        .select("lang", F.col("a").alias("outer"), F.explode(F.array(_part(F.lit(1), size - 1), _part(F.lit(2), size - 1))).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("outer").alias("outer"))
    )
    swallowed = within.join(longer.select("lang", "phrase", "f"), ["lang", "phrase"]).where(
        _wide("outer") * 100 >= _wide("f") * CONTAINED_PERCENT
    )
    kept = best.join(swallowed.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
