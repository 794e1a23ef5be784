import public_tokenizers
import tiktoken

import corpus_pipeline
from commentarium.llm.byte_bpe import load_ranks
from commentarium.llm.common import written
from commentarium.llm.mixing import apply_mix, mix

from .plain import components, kept_lines, near_pairs, words

SF = "/root/testdata/sf0.001"


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5

    docs = written(stages["toxicity"](spark, docs, SF), "t")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and left.items() <= seen.items()
    assert all(labels.get(i) != 0 for i in set(seen) - set(left))

    docs = written(stages["line dedup"](spark, docs, SF), "t")
    want = {i: t for i, (_, _, t) in kept_lines(left).items()}
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and left == want
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())

    docs = written(stages["n-gram Jaccard join"](spark, docs, SF), "t")
    want = {i: left[i] for i, c in components(left, near_pairs(left)).items() if c == i}
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == columns and left == want

    docs = written(stages["mixing sources to target weights"](spark, docs, SF), "t")
    rows = docs.collect()
    assert docs.columns == columns
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words(r["text"]))
        assert set(words(r["text"])) <= set(words(left[r["doc_id"]]))
    assert all(n <= 3 * len(words(left[i])) for i, n in taken.items())

    tokens = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    out = stages["byte-level BPE encoding and decoding"](spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in out) == sorted((r["doc_id"], tokens.encode_ordinary(r["text"])) for r in rows)


def test_run_is_repeatable(spark):
    first, again = (sorted(map(str, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert first == again and first


CLASHING = "score double, held_out string, predicted int, n_lines bigint, n_dropped bigint, kept_text string, spans string, repeats bigint, _id bigint, _key string, size bigint, component_id bigint, n_shingles bigint, ids string, `a.b` string"
VALUES = (42.0, "x", 7, -5, -6, "own", "s", 9, -1, "k", -2, -3, -4, "i", "dot")
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"


def odd_rows():
    """Null, empty, repeated, tied and very long rows."""
    long = " ".join(f"word{k % 977}x{k % 31}" for k in range(40_000))
    texts = [
        (1, None, "a"), (2, "", "a"), (3, "one", "b"), (4, "one two three four five six seven", "b"), (4, "one two three four five six seven", "b"),
        (5, "a line that is shared by two\nand one of its own here", "b"), (6, "a line that is shared by two\nanother one of its own", None),
        (7, long, "c"), (8, long, "c"), (None, "a row without an id at all, kept as it is", "a"), (9, "same id, one text of some length", "a"),
        (9, "same id, but quite another text here", "a"), (10, " \t\n ", "b"), (11, "A line that is shared by two", "a"),
        (12, long + " end", "c"),
    ]
    return [(i, t, "en", s, -9 if t is None else len(t), *VALUES) for i, t, s in texts]


def by_stage(spark, rows):
    """The rows after each stage but the last, and what the last returns."""
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), "t")
        assert docs.columns == spark.createDataFrame([], SCHEMA).columns
        out[name] = [tuple(r) for r in docs.collect()]
        assert all(r[5:] == VALUES for r in out[name])
    name, stage = corpus_pipeline.STAGES[-1]
    out[name] = stage(spark, docs, SF).collect()
    return out


def test_odd_rows_and_clashing_names(spark):
    rows = odd_rows()
    out = by_stage(spark, rows)
    first = out["toxicity"]
    assert sorted(map(str, first)) == sorted(map(str, rows))  # none of them is toxic
    lined = {(r[0], r[1]) for r in out["line dedup"]}
    assert {(1, None), (2, ""), (10, " \t\n "), (11, ""), (6, "another one of its own"), (None, rows[9][1])} <= lined
    assert (5, rows[5][1]) in lined and all(r[4] == len(r[1]) for r in out["line dedup"] if r[0] in (5, 6, 11))
    assert [r[4] for r in out["line dedup"] if r[0] == 1] == [-9]
    kept = [r[0] for r in out["n-gram Jaccard join"]]
    assert (8, "") in lined and 12 not in kept and {7, 8} <= set(kept)  # a copy loses its only line, a near copy goes
    assert kept.count(4) == 2 and kept.count(9) == 2 and kept.count(None) == 1 and {1, 2, 10} <= set(kept)
    copies = [r[0] for r in out["mixing sources to target weights"]]
    assert set(copies) <= set(kept) and max(map(copies.count, (1, 2, 3, 7, 8))) <= 4
    assert all(r["n_tokens"] == len(r["ids"]) for r in out["byte-level BPE encoding and decoding"])


def test_empty_table(spark):
    assert all(found == [] for found in by_stage(spark, []).values())


def test_repeated_rows_are_mixed_each_by_its_own_plan(spark):
    text = " ".join(f"w{k}" for k in range(27))
    rows = [(1, text, "en", "a", len(text), *VALUES)] * 5 + [(2, "x " * 300, "en", "b", 600, *VALUES)]
    docs = spark.createDataFrame(rows, SCHEMA)
    planned = {}
    for r in mix(docs).collect():
        planned[r["doc_id"]] = planned.get(r["doc_id"], 0) + r["taken"]
    held = {}
    for r in apply_mix(docs).collect():
        held[r["doc_id"]] = held.get(r["doc_id"], 0) + len(words(r["text"]))
    assert held == {i: n for i, n in planned.items() if n}


def test_a_document_is_all_rows_of_its_id(spark):
    text = "the very same words stand here in both of these rows"
    rows = [(1, text), (2, text), (2, "something else that is like nothing around it at all")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t), *VALUES) for i, t in rows], SCHEMA)
    assert [r["doc_id"] for r in dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, SF).collect()] == [1]
