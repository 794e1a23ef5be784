import math
import random

import numpy as np
import pytest

from commentarium.llm import jaccard_join, lattice
from commentarium.llm.jaccard_join import join_region, near_duplicates
from commentarium.llm.lattice import near_vectors, nearest_e8

from .plain import components, near_pairs, shingles


def checked(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    rows = {r["doc_id"]: r for r in near_duplicates(docs, **options).collect()}
    want = components(texts, near_pairs(texts))
    assert {i: r["component_id"] for i, r in rows.items()} == want
    assert {i: r["n_shingles"] for i, r in rows.items()} == {i: len(shingles(t)) for i, t in texts.items()}
    return want


def variants(seed, groups=12, size=14):
    """Texts in groups whose members differ by chains of small and larger edits."""
    rng = random.Random(seed)
    texts = {}
    for g in range(groups):
        words = [f"g{g}w{rng.randint(0, 10**6)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(size):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = f"e{rng.randint(0, 10**9)}"
            texts[len(texts)] = " ".join(own)
            if rng.random() < 0.4:
                words = own
    return texts


def test_small_table(spark, documents):
    want = checked(spark, {i: d["text"] for i, d in documents.items()})
    assert len(set(want.values())) < len(want)


def test_chains_and_exact_threshold(spark):
    texts = variants(1)
    base = [f"b{i}" for i in range(94)]  # 90 shingles; ten lost at the end: 80 of 90 shared, and so on
    texts |= {1000: " ".join(base), 1001: " ".join(base[:-18]), 1002: " ".join(base[:-19]), 1003: None, 1004: "", 1005: " \n", 1006: "two words", 1007: "TWO\tWords"}
    checked(spark, texts)


@pytest.mark.parametrize(("rounds", "pivots", "limit"), [(4, 4, 2500), (4, 16, 6000), (0, 4, 2500)])
def test_large_regions_are_split(spark, monkeypatch, rounds, pivots, limit):
    """By document pivots and then by blocks; by blocks alone."""
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "GROWTH", 2 if pivots == 4 else 20)
    texts = variants(2, groups=2, size=24)
    docs = list(texts.items())
    sets = {i: np.array(sorted(hash(s) & (1 << 60) - 1 for s in shingles(t)), dtype=np.uint64) for i, t in docs}
    rows = [(0, i, bytearray(v.tobytes())) for i, v in sets.items()]
    members = spark.createDataFrame(rows, "region bigint, id bigint, shingles binary")
    found = {r["node"]: r["component"] for r in jaccard_join.region_components(members, limit).collect()}
    want = components(texts, near_pairs(texts))
    assert {i: found.get(i, i) for i in texts} == want


def test_region_join_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
        sets = []
        for _ in range(25):
            own = base[rng.random(40) > rng.choice([0.05, 0.15, 0.5])]
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 1 << 60, rng.integers(1, 6)).astype(np.uint64)])))
        plain = [
            (a, b) for a in range(25) for b in range(a)
            if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))
        ]
        assert components(range(25), join_region(sets)) == components(range(25), plain)


def test_null_ids_repeats_and_clashing_columns(spark):
    text = "one two three four five six seven"
    rows = [(None, text, 1), (5, text, 1), (5, text, 1), (7, text, 1), (8, "w " * 60_000, 1), (9, None, 1)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, cells int")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in out) == [(0, 3, 0), (5, 3, 5), (5, 3, 5), (7, 3, 5), (8, 1, 8), (9, 0, 9)]
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_nearest_e8():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 2, (300, 8))
    found = nearest_e8(x)
    doubled = found * 2
    assert (doubled == np.round(doubled)).all() and ((doubled % 2).sum(axis=1) % 8 == 0).all() and (found.sum(axis=1) % 2 == 0).all()
    gap = ((x - found) ** 2).sum(axis=1)
    assert (gap <= 1 + 1e-9).all()  # the covering radius of E8
    for v in lattice._neighbours():
        assert (((x - found - v) ** 2).sum(axis=1) >= gap - 1e-9).all()


def cosine_links(vectors):
    good = {i: v for i, v in vectors.items() if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    ids = list(good)
    x = np.array([good[i] for i in ids], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    return [(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(s >= 0.95, 1)), strict=True)]


def planted(seed, count=400):
    rng = np.random.default_rng(seed)
    vectors = {}
    for _ in range(count // 8):
        centre = rng.normal(size=64)
        centre /= np.linalg.norm(centre)
        for wide in rng.choice([0.0, 0.1, 0.2, 0.3, 0.4], 8):
            noise = rng.normal(size=64)
            noise /= np.linalg.norm(noise)
            vectors[len(vectors)] = [float(c) for c in np.float32((centre + wide * noise) * rng.choice([1, 1, 5]))]
    return vectors


def run_vectors(spark, vectors):
    frame = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<float>").repartition(4)
    return {r["vec_id"]: r for r in near_vectors(frame).collect()}


def test_vectors_recall_and_precision(spark):
    vectors = planted(6) | {900: None, 901: [0.0] * 64, 902: [float("nan")] * 64, 903: [1.0, None] * 32, 904: [float("inf")] * 64, 905: []}
    rows, links = run_vectors(spark, vectors), cosine_links(vectors)
    degree = dict.fromkeys(vectors, 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(rows[i]["n_links"] <= degree[i] for i in vectors)
    assert sum(r["n_links"] for r in rows.values()) >= 0.98 * 2 * len(links)
    want = components(vectors, links)
    assert np.mean([rows[i]["component_id"] == want[i] for i in vectors]) >= 0.98
    assert all(r["kept"] == (r["component_id"] == i) for i, r in rows.items())
    assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] for i in range(900, 906))


def test_small_blocks_give_the_same(spark, monkeypatch):
    vectors = planted(7, 160)
    before = {i: tuple(r) for i, r in run_vectors(spark, vectors).items()}
    monkeypatch.setattr(lattice, "BLOCK", 3)
    assert {i: tuple(r) for i, r in run_vectors(spark, vectors).items()} == before


def test_vector_copies_and_repeats(spark):
    one, two = [1.0] + [0.0] * 63, [0.0, 1.0] + [0.0] * 62
    frame = spark.createDataFrame(
        [(3, one, 1), (1, one, 1), (2, two, 1), (4, one, 1), (None, one, 1), (4, one, 1)], "vec_id bigint, embedding array<float>, cells int"
    )
    out = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0) for r in near_vectors(frame).collect())
    assert out == [(0, 0, 0), (1, 3, 1), (2, 0, 2), (3, 3, 1), (4, 3, 1), (4, 3, 1)]
    assert near_vectors(frame.limit(0)).count() == 0
