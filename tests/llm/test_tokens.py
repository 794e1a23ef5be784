import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from commentarium.llm import byte_bpe, token_counts
from commentarium.llm.byte_bpe import decode, encode, load_ranks, replay
from commentarium.llm.queries import byte_bpe_query

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    "", None, " ", "\n\n\n", "a", "Hello, world's END", "<|endoftext|>", "x<|startoftext|>y <|endoftext|>", "ÀÉÎ ıİ ß ΣΑΣ", "é ́x",
    " nbsp em\x85nel\x1cfs", "日本語のテキスト", "👩‍👩‍👧 emoji 👍🏽", "12345 6,789.00", "a" * 5000, "word " * 30_000, "\t\tdef f(x):\r\n    return x", "don't we'll I'M",
    "ﬁ ﬂ ½ ²", "﻿bom", "aaaaaaab" * 40,
]


@pytest.fixture(scope="module")
def reference():
    ranks = load_ranks(MULTI)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(3)
    pool = "abcdeé ß\n\t .,!?'0123 <|>漢字🙂́‍ "
    return ["".join(rng.choice(pool) for _ in range(rng.randint(1, 200))) for _ in range(300)]


def test_counts_like_the_library(spark, documents):
    texts = TEXTS + odd_texts() + [d["text"] for d in documents.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for entries in (0, 50, token_counts.TABLE_ENTRIES):
        rows = {r["doc_id"]: r for r in token_counts.token_counts(docs, WORD_BPE, entries=entries).collect()}
        for i, t in enumerate(texts):
            assert rows[i]["n_bytes"] == len((t or "").encode())
            assert rows[i]["n_tokens"] == len(tokenizer.encode(t or "", add_special_tokens=False).ids), t


def test_counts_with_small_bounds(spark, documents, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 20)
    monkeypatch.setattr(token_counts, "TASK_COUNTERS", 30)
    docs = spark.createDataFrame([(i, d["text"]) for i, d in documents.items()], "doc_id bigint, text string")
    tokenizer = Tokenizer.from_file(WORD_BPE)
    for r in token_counts.token_counts(docs, WORD_BPE, entries=10).collect():
        assert r["n_tokens"] == len(tokenizer.encode(documents[r["doc_id"]]["text"] or "", add_special_tokens=False).ids)


def test_counts_of_null_ids_and_empty_tables(spark):
    schema = "doc_id bigint, text string, n_tokens string"
    assert token_counts.token_counts(spark.createDataFrame([], schema), WORD_BPE).count() == 0
    rows = token_counts.token_counts(spark.createDataFrame([(None, "a b", "x"), (1, "a", "x"), (1, "a", "x")], schema), WORD_BPE).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [(0, 2), (1, 1), (1, 1)]


def test_ids_like_the_library(spark, reference, documents):
    texts = TEXTS + odd_texts() + [d["text"] for d in documents.values()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    encoded = encode(docs, MULTI, public_tokenizers.PATTERN)
    for r in decode(encoded, MULTI).collect():
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == reference.encode_ordinary(text), text
        assert bytes(r["decoded"]) == text.encode()


def test_query(spark, reference, documents):
    for r in byte_bpe_query(spark, "/root/testdata/sf0.001").collect():
        text = documents[r["doc_id"]]["text"] or ""
        ids = reference.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def merged_one_by_one(word, ranks):
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        options = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
        if not options:
            return [ranks[p] for p in parts]
        _, i = min(options)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_replay_with_vocabularies_not_closed_under_merges():
    rng = random.Random(7)
    for _ in range(200):
        tokens = [b"a", b"b", b"c"] + list({bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(12)})
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        words = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12))) for _ in range(20)})
        assert replay(words, ranks) == [merged_one_by_one(w, ranks) for w in words]
    assert replay([], {}) == [] and replay([b""], {}) == [[]]


def test_memory_bound_and_clashing_columns(spark, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 5)
    monkeypatch.setattr(byte_bpe, "REPLAY_WORDS", 3)
    docs = spark.createDataFrame([(1, "some words and some more words here", 5, "k"), (None, None, 6, "k")], "doc_id bigint, text string, ids int, known string")
    rows = encode(docs, MULTI, public_tokenizers.PATTERN).collect()
    assert {(r["doc_id"], tuple(r["ids"]), r["known"]) for r in rows} == {(1, tuple(reference.encode_ordinary("some words and some more words here")), "k"), (None, (), "k")}
    assert encode(docs.limit(0), MULTI, public_tokenizers.PATTERN).count() == 0
    nulls = decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), MULTI).first()
    assert nulls["decoded"] is None


def test_one_very_long_word(spark, reference):
    long = "ab" * 100_000
    docs = spark.createDataFrame([(1, long), (2, "z" * 200_000)], "doc_id bigint, text string")
    for r in encode(docs, MULTI, public_tokenizers.PATTERN, decoded="read").collect():
        assert bytes(r["read"]).decode() == (long if r["doc_id"] == 1 else "z" * 200_000)
    word = b"abcab" * 30_000
    ranks = {b"a": 0, b"b": 5, b"c": 6, b"ab": 3, b"abc": 2, b"bc": 4, b"ca": 1}  # not closed: abc before ab
    assert b"".join({i: t for t, i in ranks.items()}[i] for i in replay([word], ranks)[0]) == word
    short = b"abcab" * 30
    assert replay([short], ranks)[0] == merged_one_by_one(short, ranks)


def test_words_are_replayed_together(monkeypatch):
    rng = random.Random(11)
    ranks = load_ranks(MULTI)
    table = byte_bpe.PairTable(ranks, byte_bpe.pair_ranks(ranks))
    words = ["".join(rng.choice("etaoin shrdluéßü漢'") for _ in range(rng.randint(1, 12))).encode() for _ in range(3000)]
    calls = []
    monkeypatch.setattr(byte_bpe.PairTable, "look_up", lambda self, a, b, f=byte_bpe.PairTable.look_up: calls.append(len(a)) or f(self, a, b))
    found = replay(words, ranks, table)
    assert len(calls) <= 3 * max(map(len, words)) and sum(calls) <= 3 * sum(map(len, words))
    assert found == [merged_one_by_one(w, ranks) for w in words]


def test_replay_with_any_bound_on_long_words_and_bytes_without_token(monkeypatch):
    rng = random.Random(13)
    for _ in range(300):
        tokens = [b"a", b"b", b"c"] + list({bytes(rng.choice(b"ab") for _ in range(rng.randint(2, 6))) for _ in range(15)})
        rng.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        words = [bytes(rng.choice(b"aab") for _ in range(rng.randint(1, 60))) for _ in range(20)]
        expected = [merged_one_by_one(w, ranks) for w in words]
        for bound in (0, 30, 200):
            monkeypatch.setattr(byte_bpe, "REPLAY_BYTES", bound)
            assert replay(words, ranks) == expected
            assert replay([b"a?a", b"?"], ranks) == [[ranks[b"a"]] * 2, []]
