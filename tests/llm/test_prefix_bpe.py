import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from commentarium.llm import prefix_bpe
from commentarium.llm.prefix_bpe import Encoder, decode, encode
from commentarium.llm.queries import prefix_bpe_query

from .test_tokens import TEXTS, odd_texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return prefix_bpe.Vocabulary(PATH)


def test_ids_and_texts_like_the_library(spark, library, documents):
    texts = TEXTS + odd_texts() + [d["text"] for d in documents.values()]
    texts += ["<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endoftext|", "a" * 200_000, "ab" * 3_000 + " the" * 3_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for r in decode(encode(docs, PATH, decoded="same"), PATH).collect():
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == r["same"] == library.decode(want, skip_special_tokens=False)


def test_every_code_point(library):
    for low, high in ((0, 0xD800), (0xE000, 0x30000)):
        text = "".join(map(chr, range(low, high)))
        assert memoryview(Encoder(PATH).encode(text)).cast("i").tolist() == library.encode(text, add_special_tokens=False).ids


def merged(vocabulary, word):
    """Ids by the plain rule: the lowest merge first, the leftmost of equal ones."""
    parts = [vocabulary.ids[bytes([b])] for b in word]
    while True:
        ranks = [(vocabulary.rank[key], i) for i in range(len(parts) - 1) if (key := parts[i] << 24 | parts[i + 1]) in vocabulary.rank]
        if not ranks:
            return parts
        rank, i = min(ranks)
        parts[i : i + 2] = [vocabulary.made[rank]]


def test_every_prefix_has_the_last_token_of_its_own_encoding(vocabulary):
    rng = random.Random(5)
    for _ in range(40):
        word = "".join(rng.choice("aaeinrst") for _ in range(rng.randint(1, 40))).encode()
        for end in range(1, len(word) + 1):
            assert vocabulary.encode_word(word[:end]) == merged(vocabulary, word[:end])


def test_pairs_are_compatible_where_merging_leaves_them_alone(vocabulary):
    rng = random.Random(6)
    tokens = sorted(vocabulary.bytes)
    common = tokens[:1500]
    for _ in range(4_000):
        a, b = rng.choice(common), rng.choice(common)
        assert vocabulary.compatible(a, b) == (merged(vocabulary, vocabulary.bytes[a] + vocabulary.bytes[b]) == [a, b])


def test_query(spark, library, documents):
    rows = prefix_bpe_query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(documents)
    for r in rows:
        ids = library.encode(documents[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_nulls_repeats_empty_tables_and_clashing_columns(spark, monkeypatch, library):
    monkeypatch.setattr(prefix_bpe, "CACHE_WORDS", 2)
    schema = "doc_id bigint, text string, ids string, known int"
    rows = [(None, None, "x", 1), (1, "", "x", 2), (2, "some words here and here", "x", 3), (2, "some words here and here", "x", 3)]
    want = tuple(library.encode("some words here and here").ids)
    found = encode(spark.createDataFrame(rows, schema), PATH).collect()
    assert sorted((r["known"], tuple(r["ids"])) for r in found) == [(1, ()), (2, ()), (3, want), (3, want)]
    assert encode(spark.createDataFrame([], schema), PATH, decoded="known").count() == 0
    assert decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>"), PATH).first()["decoded"] is None


def test_bytes_that_are_no_text_decode_as_in_the_library(spark, library):
    ids = [[3, 200, 201, 255, 198], [188, 176, 9]]
    found = decode(spark.createDataFrame(list(enumerate(ids)), "n int, ids array<int>"), PATH).collect()
    assert [r["decoded"] for r in sorted(found)] == [library.decode(i, skip_special_tokens=False) for i in ids]
