"""Byte-level BPE by merge replay over a corpus of distinct pre-tokens.

The pre-tokens that a task has not met yet form a small corpus of distinct words.
An index keeps the rank of every pair of adjacent tokens in that corpus and gives
the positions of the pair that each word merges next. Applying the merges visits
those positions only and updates just the two neighbours of each, in the corpus
and in the index. Corpus and index are arrays, so a round of merges is a few numpy
operations. Texts are then put together from the words' ids.

Workers remember words up to a bound, so common words are replayed once; nothing
is shuffled, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentarium.llm.common import bounded_batches, byte_slices

CACHE_WORDS = 400_000
REPLAY_WORDS = 20_000  # words replayed together
REPLAY_BYTES = 200  # longer words, which would ask for as many rounds, are replayed on their own
_SHIFT = 24  # a pair of tokens as one number
_NONE = 1 << 40  # beyond all ranks: no pair
_GONE = -1  # no token: merged into its left neighbour


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of the token that two tokens make, for every pair that makes one; see ``_pair``."""
    found = {}
    for token, rank in ranks.items():
        for at in range(1, len(token)):
            left, right = ranks.get(token[:at]), ranks.get(token[at:])
            if left is not None and right is not None:
                found[left << _SHIFT | right] = rank
    return found


class PairTable:
    """Ranks of many pairs at once: the pairs' keys in order, and of two single bytes a square table."""

    def __init__(self, ranks: dict[bytes, int], pairs: dict[int, int]):
        self.rank_of = pairs.get
        self.bytes_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        self.unknown = frozenset(np.flatnonzero(self.bytes_ids < 0).tolist())
        # One key beyond all others, so that every search ends at an entry.
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order], _NONE)
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.square = self.look_up(self.bytes_ids[left], self.bytes_ids[right])

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, ``_NONE`` where it makes none."""
        wanted = left << _SHIFT | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)


def replay(words: list[bytes], ranks: dict[bytes, int], pairs: PairTable | None = None) -> list[list[int]]:
    """Token ids of every word: all merges in rank order, as a tokenizer with these ranks does one by one.

    ``pairs`` is ``PairTable(ranks, pair_ranks(ranks))``. A word that is itself a token is that token.
    Within a word the lowest rank goes first and of equal ranks the leftmost. Should a
    merge create a pair of no higher rank than its own (vocabularies need not
    be closed under their merges), that word is finished on its own, in the same
    order.
    """
    pairs = PairTable(ranks, pair_ranks(ranks)) if pairs is None else pairs
    return [np.frombuffer(ids, dtype=np.int32).tolist() for ids in replayed(words, ranks, pairs)]


def replayed(words: list[bytes], ranks: dict[bytes, int], pairs: PairTable) -> list[bytes]:
    """The ids of ``replay`` as native 32-bit numbers.

    The corpus is one array of tokens, the index one of ranks beside it: entry i is the rank of
    the pair at i. Words do not touch each other, so a round applies to every word the merge that is
    next in that word, at all positions of its pair at once; only the entries at
    those positions and before them are looked up anew.
    """
    done: list[bytes | None] = [None] * len(words)
    corpus: list[int] = []  # words to replay together
    for w, word in enumerate(words):
        if word in ranks:
            done[w] = _ids([ranks[word]])
        elif len(word) > REPLAY_BYTES or (pairs.unknown and not pairs.unknown.isdisjoint(word)):
            done[w] = _ids(_finish(pairs.bytes_ids[list(word)].tolist(), pairs.rank_of))
        elif word:
            corpus.append(w)
        else:
            done[w] = b""
    number = np.array(corpus, dtype=np.int64)  # of each word that is left, its place in ``words``
    length = np.fromiter((len(words[w]) for w in corpus), dtype=np.int64, count=len(corpus))
    raw = np.frombuffer(b"".join([words[w] for w in corpus]), dtype=np.uint8).astype(np.int64)
    token = pairs.bytes_ids[raw]
    start = np.cumsum(length) - length
    rank = np.full(len(token), _NONE)
    rank[:-1] = pairs.square[raw[:-1] << 8 | raw[1:]]
    rank[start + length - 1] = _NONE  # no pair leads out of its word
    alone = np.zeros(len(words), dtype=bool)  # words that must be finished on their own
    while len(number):
        lowest = np.minimum.reduceat(rank, start)
        more = (lowest < _NONE) & ~alone[number]
        if not more.all():
            blob, ends = token.astype(np.int32).tobytes(), (start + length) * 4
            for w, a, b in zip(number[~more].tolist(), (start[~more] * 4).tolist(), ends[~more].tolist(), strict=True):
                done[w] = blob[a:b]
            left = np.repeat(more, length)
            token, rank = token[left], rank[left]
            number, length, lowest = number[more], length[more], lowest[more]
            start = np.cumsum(length) - length
            if not len(number):
                break
        places = np.flatnonzero(rank == np.repeat(lowest, length))
        if (touching := np.diff(places) == 1).any():
            # Of positions that overlap, the first, the third and so on from the left.
            step = np.arange(len(places))
            first = np.maximum.accumulate(np.where(np.append(True, ~touching), step, 0))
            places = places[(step - first) % 2 == 0]
        merged = rank[places]
        # Pairs that are gone when the round ends: between a merged pair and the next one before that is merged.
        close = np.flatnonzero(np.diff(places) == 2)
        word = np.searchsorted(start, places, side="right") - 1
        close = close[word[close] == word[close + 1]]
        passing = pairs.look_up(merged[close], token[places[close] + 2])
        alone[number[word[close[passing <= merged[close]]]]] = True
        # The merges.
        token[places], rank[places] = merged, _NONE
        inner, led = places + 2 < (start + length)[word], places > start[word]
        kept = np.ones(len(token), dtype=bool)
        kept[places + 1] = False
        token, rank = token[kept], rank[kept]
        length = length - np.bincount(word, minlength=len(length))
        start = np.cumsum(length) - length
        places = places - np.arange(len(places))
        # The index: pairs at the merged tokens, and those that lead to them.
        for of, at in ((inner, places[inner]), (led, places[led] - 1)):
            fresh = pairs.look_up(token[at], token[at + 1])
            rank[at] = fresh
            alone[number[word[of][fresh <= merged[of]]]] = True
    for w in np.flatnonzero(alone).tolist():
        done[w] = _ids(_finish(pairs.bytes_ids[list(words[w])].tolist(), pairs.rank_of))
    return done


def _ids(numbers: list[int]) -> bytes:
    return array("i", numbers).tobytes()


def _finish(parts: list[int], rank_of) -> list[int]:
    """One word's merges, lowest rank first and of equal ranks the leftmost; n log n in its length."""
    count = len(parts)
    follows, leads = list(range(1, count + 1)), list(range(-1, count - 1))
    heap = [(r, i) for i in range(count - 1) if (r := rank_of(parts[i] << _SHIFT | parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, at = heapq.heappop(heap)
        after = follows[at]
        if parts[at] == _GONE or after >= count or rank_of(parts[at] << _SHIFT | parts[after]) != rank:
            continue  # a neighbour has changed since
        parts[at], parts[after] = rank, _GONE
        follows[at] = beyond = follows[after]
        before = leads[at]
        if beyond < count:
            leads[beyond] = at
            if (r := rank_of(rank << _SHIFT | parts[beyond])) is not None:
                heapq.heappush(heap, (r, at))
        if before >= 0 and (r := rank_of(parts[before] << _SHIFT | rank)) is not None:
            heapq.heappush(heap, (r, before))
    return [p for p in parts if p != _GONE]


class _Known(dict):
    """Ids of remembered words; those that found no room are in ``extra`` for a while."""

    def __init__(self):
        super().__init__()
        self.extra: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.extra[word]


class Encoder:
    """Encodes texts with a bounded memory of words; one per worker process, kept from task to task."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern).findall
        self.pairs = PairTable(self.ranks, pair_ranks(self.ranks))
        self.table = {i: w for w, i in self.ranks.items()}
        self.known = _Known()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as native 32-bit numbers."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size > 1 << 20:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        missing = list({w for words in split for w in words}.difference(self.known))
        found: dict[str, bytes] = {}
        for at in range(0, len(missing), REPLAY_WORDS):
            part = missing[at : at + REPLAY_WORDS]
            found.update(zip(part, replayed([w.encode("utf-8") for w in part], self.ranks, self.pairs), strict=True))
        # Common words come early and stay; a word without room is replayed when it comes again.
        if len(self.known) + len(found) <= CACHE_WORDS:
            self.known.update(found)
        self.known.extra = found
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


@lru_cache(maxsize=1)
def _worker(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def _table(path: str) -> dict[int, bytes]:
    return {i: w for w, i in load_ranks(path).items()}


def encode(
    docs: DataFrame, path: str, pattern: str, text_column: str = "text", into: str = "ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with the column ``into array<int>``: the token ids of every whole text.

    No special tokens: their strings are ordinary text. A null or empty text has no
    ids. All other columns stay (one named ``into`` is replaced). ``decoded`` names a further
    binary column for the bytes that the ids stand for, made from the ids in the same pass.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(into, *([decoded] if decoded else []))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(path, pattern)
        for whole in batches:
            for batch in byte_slices(whole, text_column):
                texts = ["" if t is None else t for t in batch.column(text_column).to_pylist()]
                blobs = encoder.encode(texts)
                ends = np.cumsum([0] + [len(b) // 4 for b in blobs], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), dtype=np.int32)))
                out = pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, into])
                if decoded:
                    read = [encoder.decode(np.frombuffer(b, dtype=np.int32).tolist()) for b in blobs]
                    out = out.append_column(decoded, pa.array(read, pa.binary()))
                yield out

    fields = [*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.BinaryType()))
    return docs.mapInArrow(add, T.StructType(fields))


def decode(docs: DataFrame, path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the column ``into binary``: the bytes that the ids stand for.

    Null ids give null; ids outside the vocabulary fail. All other columns stay.
    """
    docs = docs.drop(into)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = _table(path).__getitem__
        for batch in batches:
            ids = batch.column(ids_column)
            out = [None if i is None else b"".join(map(get, i.tolist())) for i in _arrays(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, into])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(into, T.BinaryType())]))


def _arrays(column: pa.ListArray):
    """The lists of a column as numpy arrays (None for null)."""
    values = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_numpy()
    valid = column.is_valid().to_pylist()
    for i, ok in enumerate(valid):
        yield values[ends[i] : ends[i + 1]] if ok else None


def joined_ids(ids: Column) -> Column:
    """The ids in decimal, joined by commas."""
    return F.coalesce(F.array_join(F.transform(ids, lambda i: i.cast("string")), ","), F.lit(""))
