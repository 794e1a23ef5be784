from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from commentarium.llm.mixing import apply_mix, mix, sainte_lague, targets

from .plain import words


def plain_targets(sizes):
    """Targets by rounds: cap what is above three times its size, share the rest anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped, left = {}, Fraction(sum(sizes.values()))
    while True:
        free = [s for s in names if s not in capped]
        heft = sum(weight[s] for s in free)
        above = [s for s in free if heft and left * weight[s] / heft > 3 * sizes[s]]
        if not above:
            return capped | {s: left * weight[s] / heft for s in free}
        for s in above:
            capped[s] = Fraction(3 * sizes[s])
            left -= capped[s]


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 100, "b": 5, "c": 7, "d": 1000, None: 3, "é": 50, "z": 0},
        {"a": 10},
        {"a": 0, "b": 0},
        {"a": 1, "b": 1, "c": 10_000},
    ],
)
def test_targets(spark, sizes):
    rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = plain_targets(sizes)
    assert {r["source"]: r["target"] for r in rows} == pytest.approx({s: float(t) for s, t in want.items()})


def plain_sainte_lague(votes, blocks):
    won = dict.fromkeys(votes, 0)
    for _ in range(blocks if any(votes.values()) else 0):
        best = min((p for p in votes if votes[p] > 0), key=lambda p: (-votes[p] / (2 * won[p] + 1), p))
        won[best] += 1
    return won


@pytest.mark.parametrize("blocks", [0, 1, 2, 7, 100, 1003])
def test_sainte_lague(spark, blocks):
    votes = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 24.0, "f": 0.001, "g": 900.5}
    rows = [("x", p, v, blocks) for p, v in votes.items()] + [("y", "a", 1.0, 3)]
    given = spark.createDataFrame(rows, "g string, p string, votes double, blocks bigint")
    won = sainte_lague(given, "g", "p").collect()
    assert {r["p"]: r["won"] for r in won if r["g"] == "x"} == plain_sainte_lague(votes, blocks)
    assert [r["won"] for r in won if r["g"] == "y"] == [3]


def test_whole_table(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = mix(docs).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(documents)
    held = {}
    for r in rows:
        text = documents[r["doc_id"]]["text"]
        assert r["size"] == len(words(text))
        assert 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["repeats"] * r["size"] + sum(s["length"] for s in r["spans"])
        assert all(0 <= s["start"] and s["start"] + s["length"] <= r["size"] for s in r["spans"])
        held.setdefault(r["source"], []).append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in held.items()}
    want = plain_targets(sizes)
    for s, rs in held.items():
        assert {r["source_size"] for r in rs} == {sizes[s]}
        assert rs[0]["target"] == pytest.approx(float(want[s]))
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 100
    again = mix(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_many_shards_meet_the_target(spark, monkeypatch):
    monkeypatch.setattr("commentarium.llm.mixing.SHARD_DOCS", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("source", F.lit("one"))
    rows = mix(docs).collect()
    assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 100


def test_nulls_repeats_and_clashing_columns(spark):
    schema = "doc_id bigint, text string, source string, size string, shard int"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c", None, "x", 1), (1, None, "s", "x", 1), (1, "", "s", "x", 1), (2, "d e", "s", "x", 1), (2, "d e", "s", "x", 1), (3, "w " * 70_000, "t", "x", 1)]
    out = mix(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in out) == [(0, 3), (1, 0), (1, 0), (2, 2), (2, 2), (3, 70_000)]
    assert all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert {r["source"]: r["source_size"] for r in out} == {None: 3, "s": 4, "t": 70_000}


def test_applied(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = {r["doc_id"]: r["taken"] for r in mix(docs).collect()}
    out = apply_mix(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == {i: t for i, t in plan.items() if t}


def test_no_python_in_the_plan(spark):
    plan = mix(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
