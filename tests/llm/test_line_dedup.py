import numpy as np
import pytest

from commentarium.llm.line_dedup import CuckooFilter, LineIndex, deduplicate_lines, line_key

from .plain import kept_lines, line_key as plain_key

TEXTS = {
    1: "a line of some length\nshort\nA LINE of some length  \nonly here, long enough",
    2: "\tA line of some length\nshort\nanother shared line\n\n",
    3: "another shared line\nanother shared line\nA Line Of Some Length",
    4: None,
    5: "",
    6: "äöüäöüäöüä\nÄÖÜÄÖÜÄÖÜÄ",
    7: "äöüäöüäöüä\näöüäöüäöü",
    8: ("long " * 40_000) + "\nanother shared line",
}
SCHEMA = "doc_id bigint, text string"


def decisions(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in df.collect()}


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), SCHEMA)


def test_keys():
    for line in ("x" * 9, "x" * 10, "é" * 9, "é" * 10, "  Abcdefghij\x0b", " abcdefghi", ""):
        assert (line_key(line.encode()) is None) == (plain_key(line) is None)
    assert line_key(b" Hello World \r") == line_key(b"hello world")


def test_one_pass(spark):
    assert decisions(deduplicate_lines(frame(spark, TEXTS))) == kept_lines(TEXTS)


def test_batches_deletions_and_return(spark):
    docs = frame(spark, TEXTS)
    index = LineIndex(spark, shards=3)
    index.insert(docs.where("doc_id > 2"))
    later = {i: t for i, t in TEXTS.items() if i > 2}
    assert decisions(index.kept(docs.where("doc_id > 2"))) == kept_lines(later)
    index.insert(docs)  # 3 and more are there already
    assert decisions(index.kept(docs)) == kept_lines(TEXTS)
    index.delete(docs.where("doc_id IN (1, 3)"))
    left = {i: t for i, t in TEXTS.items() if i not in (1, 3)}
    assert decisions(index.kept(docs.where("doc_id NOT IN (1, 3)"))) == kept_lines(left)
    index.delete(docs.where("doc_id = 99"))
    index.insert(docs.where("doc_id IN (1, 3)"))
    assert decisions(index.kept(docs)) == kept_lines(TEXTS)


def test_counts_follow_insertions_and_deletions(spark):
    index = LineIndex(spark, shards=2)
    docs = frame(spark, TEXTS)
    index.insert(docs)
    before = {(bytes(r["key"]), r["docs"], r["first_doc"]) for r in index.counts().collect()}
    index.delete(docs.where("doc_id = 2"))
    index.insert(docs.where("doc_id = 2"))
    assert {(bytes(r["key"]), r["docs"], r["first_doc"]) for r in index.counts().collect()} == before


def test_null_ids_repeats_and_clashing_columns(spark):
    docs = spark.createDataFrame(
        [(None, "a line of some length", 1), (1, "a line of some length", 2), (1, "a line of some length", 3), (2, "a line of some length", 4)],
        "doc_id bigint, text string, keys int",
    )
    rows = deduplicate_lines(docs).collect()
    assert {(r["doc_id"], r["n_dropped"], r["keys"]) for r in rows} == {(None, 0, 1), (1, 0, 2), (1, 0, 3), (2, 1, 4)}


def test_empty_table(spark):
    assert deduplicate_lines(frame(spark, {})).count() == 0


@pytest.mark.parametrize("count", [1, 50, 5000])
def test_cuckoo_filter(count):
    rng = np.random.default_rng(count)
    inside, outside = rng.integers(0, 1 << 63, (2, count)).astype(np.uint64)
    cuckoo = CuckooFilter()
    for part in np.array_split(inside, 3):
        cuckoo.add(part)
    cuckoo = CuckooFilter.load(cuckoo.dump())
    assert cuckoo.has(inside).all()
    assert cuckoo.has(outside).mean() < 0.01 + 1 / count * (count < 100)
    cuckoo.remove(inside[: count // 2])
    assert cuckoo.has(inside[count // 2 :]).all()
    if count >= 50:
        assert cuckoo.has(inside[: count // 2]).mean() < 0.05


def test_few_texts_at_once(spark):
    """Texts pass to Python in batches bounded by bytes, and only those that lose lines."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    try:
        kept = deduplicate_lines(frame(spark, TEXTS))
        assert int(spark.conf.get(key)) <= 1 << 20
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert "CASE WHEN isnotnull(keys" in plan.split("keep(")[1]
        assert decisions(kept) == kept_lines(TEXTS)
        spark.conf.set(key, "1000b")  # a smaller size stays
        deduplicate_lines(frame(spark, TEXTS))
        assert spark.conf.get(key) == "1000b"
    finally:
        spark.conf.set(key, before)
