import hashlib

import numpy as np

from commentarium.llm.fingerprints import Fingerprinter, edited, fingerprints_with_neighbours

from .plain import shingles


def likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_all_documents_against_plain_version(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r for r in fingerprints_with_neighbours(docs, ranges=7).collect()}
    ids = sorted(documents)
    assert sorted(rows) == ids
    errors = []
    for i, after in zip(ids, ids[1:] + ids[:1], strict=True):
        text, following = documents[i]["text"] or "", documents[after]["text"] or ""
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        row = rows[i]
        assert row["n_chars"] == len(text) and row["edited_text"] == changed
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        errors += [row["near_edited"] - likeness(text, changed), row["near_next"] - likeness(text, following)]
    errors = np.array(errors)
    assert np.abs(errors).max() < 0.15 and np.sqrt((errors**2).mean()) < 0.04


def test_ranges_do_not_change_the_result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    results = [sorted(map(tuple, fingerprints_with_neighbours(docs.repartition(p), ranges=r).collect())) for p, r in ((1, 1), (3, 40), (5, 200))]
    assert results[0] == results[1] == results[2]


def test_nulls_ties_and_single_rows(spark):
    schema = "doc_id bigint, text string, range int, copy int"
    rows = fingerprints_with_neighbours(spark.createDataFrame([], schema)).collect()
    assert rows == []
    one = fingerprints_with_neighbours(spark.createDataFrame([(4, "a b c d e f", 1, 1)], schema)).first()
    assert one["edited_text"] == "a b c a b c"[: 11] and one["near_next"] == 1.0
    many = spark.createDataFrame(
        [(None, None, 0, 0), (None, "x y z", 0, 0), (3, "b", 0, 0), (3, "a", 0, 0), (3, "a", 0, 0), (9, "", 0, 0), (10, "w " * 60_000, 0, 0)], schema
    )
    rows = fingerprints_with_neighbours(many, ranges=3).collect()
    assert len(rows) == 7
    by_text = {(r["doc_id"], r["n_chars"]): r for r in rows}
    assert by_text[(9, 0)]["fingerprint"] == b"" and by_text[(9, 0)]["near_edited"] == 1.0
    assert by_text[(10, 120_000)]["edited_text"] == "w " * 30_000 + ""


def test_densification_and_bias():
    make = Fingerprinter()
    words = [f"w{i}" for i in range(400)]
    for size, shared in ((30, 20), (400, 200), (400, 0), (60, 0)):
        got, want = [], []
        for shift in range(12):
            a = [f"{shift}{w}" for w in words[:size]]
            b = a[:shared] + [f"{shift}x{i}" for i in range(size - shared)]
            got.append(make.likeness(make.of(" ".join(a)), make.of(" ".join(b))))
            want.append(likeness(" ".join(a), " ".join(b)))
        assert abs(np.mean(got) - np.mean(want)) < 0.04
    assert make.of("") == b"" and len(make.of("one")) == 256
    assert make.likeness(make.of("A b c"), make.of("a  B\tc")) == 1.0
    assert edited("abcde", "xyz") == "abcxy" and edited("abcdef", "x") == "abcx" and edited("", "x") == ""
