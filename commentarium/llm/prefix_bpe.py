"""BPE by dynamic programming over prefixes.

For every prefix of a word its encoding ends with one certain token. That token ends
at the prefix's end, so the suffix automaton of the vocabulary (a trie with suffix links)
lists the candidates, longest first. The right one is the one whose pair with the
last token of the shorter prefix is *compatible*: merging the two side by
side leaves the border between them alone. Last tokens are stored for every prefix; the
pointers back from the word's end give the ids. One pass over a word, whatever its length.

Two neighbouring tokens are incompatible if a merge across their border would come before
the merges on either side of it. Only tokens on the right edge of the left token's merge
tree and on the left edge of the right one's can meet at the border, so the test compares
the ranks along these two edges.

Edges. A null or empty text has no ids and decodes to an empty text. Repeated rows are
encoded each. A column named like a result is replaced, all others stay. Very long words
cost time and memory in proportion to their length. Strings of added tokens inside texts
become those tokens, as the library does by default.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from commentarium.llm.common import bounded_batches, byte_slices

CACHE_WORDS = 400_000
CACHE_PAIRS = 1_000_000
_NONE = -1
_NEVER = 1 << 60
_SHIFT = 24  # two ids as one number

# Fixed value: how byte-level vocabularies cut a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, and its byte.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the suffix automaton of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model, cut = given["model"], given["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        split = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        if not plain or not split or given["normalizer"]:
            raise ValueError("Only byte-level BPE files without normalizer, prefix space or options of the model are known.")
        letters = byte_letters()
        self.bytes: dict[int, bytes] = {i: bytes(map(letters.__getitem__, token)) for token, i in model["vocab"].items()}
        self.ids = {token: i for i, token in self.bytes.items()}
        self.added: dict[str, int] = {}
        for token in given["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("Added tokens must be plain strings.")
            self.added[token["content"]] = token["id"]
        self._read_merges(model["merges"], letters)
        self._build_automaton()
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._pairs: dict[int, bool] = {}
        self._reached: dict[int, bool] = {}

    def _read_merges(self, merges: list, letters: dict[str, int]) -> None:
        self.rank: dict[int, int] = {}  # a pair of ids -> its place among the merges
        self.made: dict[int, int] = {}  # the place of a merge -> the token that it makes
        first: dict[int, int] = {}  # token -> its first merge
        for rank, merge in enumerate(merges):
            a, b = (bytes(map(letters.__getitem__, side)) for side in (merge.split(" ") if isinstance(merge, str) else merge))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            if max(first.get(left, -1), first.get(right, -1)) >= rank or (len(a) > 1 and left not in first) or (len(b) > 1 and right not in first):
                raise ValueError("A merge must come after the merges that make its parts.")
            self.rank.setdefault(left << _SHIFT | right, rank)
            self.made[rank] = whole
            first.setdefault(whole, rank)

    def _build_automaton(self) -> None:
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError("Every byte must be a token.")
        step: dict[int, int] = {}  # state and byte -> state
        ends = [_NONE]  # the token that a state's string is
        parents = [(0, 0)]
        for token, i in self.ids.items():
            state = 0
            for b in token:
                key = state << 8 | b
                if key not in step:
                    step[key] = len(ends)
                    ends.append(_NONE)
                    parents.append((state, b))
                state = step[key]
            ends[state] = i
        # Suffix links, states by depth: the longest proper suffix of a state's string that is a state.
        depth = [0] * len(ends)
        for state in range(1, len(ends)):
            depth[state] = depth[parents[state][0]] + 1
        link = [0] * len(ends)
        longest = list(ends)  # the longest token that a state's string ends with
        top = max(self.bytes) + 1
        self.shorter = [_NONE] * top  # by token: the longest shorter token that it ends with
        for state in sorted(range(1, len(ends)), key=depth.__getitem__):
            parent, b = parents[state]
            if parent:
                at = link[parent]
                while at and (at << 8 | b) not in step:
                    at = link[at]
                link[state] = step.get(at << 8 | b, 0)
            below = longest[link[state]] if link[state] else _NONE
            if ends[state] == _NONE:
                longest[state] = below
            else:
                self.shorter[ends[state]] = below
        self.step, self.link, self.longest = step, link, longest
        self.length = [0] * top
        for i, token in self.bytes.items():
            self.length[i] = len(token)

    def _tree(self, token: int) -> list[tuple[int, int, int, int]]:
        """The merges (rank, left, right, whole) that make a token from its bytes; none if they don't lead to it."""
        parts = [self.ids[bytes([b])] for b in self.bytes[token]]
        done = []
        while len(parts) > 1:
            options = [(self.rank.get(parts[i] << _SHIFT | parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)]
            rank, i = min(options)
            if rank == _NEVER:
                return []
            done.append((rank, parts[i], parts[i + 1], self.made[rank]))
            parts[i : i + 2] = [self.made[rank]]
        return done

    def _edges(self, token: int) -> None:
        """Tokens on both edges of a token's merge tree, each with the rank of the merge that takes it."""
        by_whole = {whole: (rank, a, b) for rank, a, b, whole in self._tree(token)}
        for side, found in ((1, self._left), (2, self._right)):
            at, edge = token, [(token, _NEVER)]
            while at in by_whole:
                rank = by_whole[at][0]
                at = by_whole[at][side]
                edge.append((at, rank))
            found[token] = edge

    def reachable(self, token: int) -> bool:
        """Whether the token's own bytes encode to it."""
        known = self._reached.get(token)
        if known is None:
            known = self._reached[token] = self.length[token] == 1 or bool(self._tree(token))
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes, side by side, encode to just these two."""
        key = left << _SHIFT | right
        known = self._pairs.get(key)
        if known is None:
            known = self._test(left, right)
            if len(self._pairs) < CACHE_PAIRS:
                self._pairs[key] = known
        return known

    def _test(self, left: int, right: int) -> bool:
        for token in (left, right):
            if token not in self._left:
                self._edges(token)
            if not self.reachable(token):
                return False
        for a, a_taken in self._right[left]:
            for b, b_taken in self._left[right]:
                across = self.rank.get(a << _SHIFT | b, _NEVER)
                # Of equal ranks the leftmost merge goes first.
                if across < a_taken and across <= b_taken and across != _NEVER:
                    return False
        return True

    def encode_word(self, word: bytes) -> list[int]:
        step, pair = self.step.get, self._pairs.get
        link, longest, shorter, length = self.link, self.longest, self.shorter, self.length
        last = [_NONE] * (len(word) + 1)
        state = 0
        for end, b in enumerate(word, 1):
            found = step(state << 8 | b)
            while found is None:
                state = link[state]
                found = step(state << 8 | b)
            state = found
            token = longest[state]
            while True:
                start = end - length[token]
                if start:
                    before = last[start]
                    fits = pair(before << _SHIFT | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                else:
                    fits = self.reachable(token)
                if fits:
                    break
                token = shorter[token]
            last[end] = token
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= length[last[end]]
        out.reverse()
        return out


class Encoder:
    """Encodes and decodes texts; one per worker process, with a bounded memory of words."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(WORD_PATTERN).findall
        added = self.vocabulary.added
        longest_first = sorted(added, key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.known: dict[str, bytes] = {}
        self.table = dict(self.vocabulary.bytes) | {i: text.encode("utf-8") for text, i in added.items()}

    def _words(self, words: list[str]) -> bytes:
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        out = []
        for word in words:
            ids = known.get(word)
            if ids is None:
                ids = array("i", self.vocabulary.encode_word(word.encode("utf-8"))).tobytes()
                if len(known) < CACHE_WORDS:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids as native 32-bit numbers."""
        if self.specials is None or not any(special in text for special in self.vocabulary.added):
            return self._words(self.split(text))
        added = self.vocabulary.added
        parts = self.specials.split(text)
        return b"".join(array("i", [added[p]]).tobytes() if i % 2 else self._words(self.split(p)) for i, p in enumerate(parts))

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.table.__getitem__, ids)).decode("utf-8", errors="replace")


@lru_cache(maxsize=1)
def _worker(path: str) -> Encoder:
    return Encoder(path)


def _with_ids(batch: pa.RecordBatch, blobs: list[bytes], into: str) -> pa.RecordBatch:
    ends = np.cumsum([0] + [len(b) // 4 for b in blobs], dtype=np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), dtype=np.int32)))
    return pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, into])


def encode(docs: DataFrame, path: str, text_column: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``into array<int>``: the ids of every whole text, by the byte-level BPE file at ``path``.

    ``decoded`` names a further column for the text that the ids decode to, made from the ids
    in the same pass.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(into, *([decoded] if decoded else []))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(path)
        for whole in batches:
            for batch in byte_slices(whole, text_column):
                blobs = [encoder.encode(t) if t else b"" for t in batch.column(text_column).to_pylist()]
                out = _with_ids(batch, blobs, into)
                if decoded:
                    texts = [encoder.decode(np.frombuffer(b, dtype=np.int32).tolist()) for b in blobs]
                    out = out.append_column(decoded, pa.array(texts, pa.string()))
                yield out

    fields = [*docs.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    return docs.mapInArrow(add, T.StructType(fields))


def decode(docs: DataFrame, path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with ``into string``: the text of the ids. Null gives null; ids outside the vocabulary fail."""
    docs = docs.drop(into)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(path)
        for batch in batches:
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column(ids_column).to_pylist()]
            yield batch.append_column(into, pa.array(texts, pa.string()))

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(into, T.StringType())]))
