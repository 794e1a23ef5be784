import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from commentarium.llm import collocations as module
from commentarium.llm import common
from commentarium.llm.collocations import Index, collocations, frequent_phrases, transform

from .plain import LOWER

SCHEMA = "doc_id bigint, lang string, text string, f int, n string"


def plain_counts(rows):
    """lang -> (words, counts of phrases of one to four words)."""
    found = {}
    for lang, text in rows:
        n, counts = found.setdefault(lang or "und", [0, Counter()]), None
        counts = n[1]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[0] += len(words)
            for m in range(1, 5):
                counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return found


def plain_version(rows, least=30, top=2000):
    out = []
    for lang, (n, counts) in plain_counts(rows).items():
        frequent = {p: f for p, f in counts.items() if f >= least}
        scored = []
        for p, a in frequent.items():
            if len(p) == 1:
                continue
            inside = any(
                len(q) > len(p) and 100 * f >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, f in frequent.items()
            )
            if not inside:
                cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, 0, "x") for i, (lang, text) in enumerate(rows)], SCHEMA)


def random_rows(seed, count=300):
    rng = random.Random(seed)
    words = ["the", "The", "new", "york", "city", "of", "é", "日本", "zu", "x\x1cy", "a b"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!"]
    rows = []
    for _ in range(count):
        lang = rng.choice(["en", "en", "en", "fr", None])
        text = "".join(w + rng.choice(marks) for w in rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60)))
        rows.append((lang, rng.choice([text, text, "new york city " * 5 + text])))
    return rows + [("en", None), ("fr", ""), ("de", "einmal nur"), ("en", "ha " * 200)]


@pytest.mark.parametrize("shard_words", [50, 3_000, 2_000_000])
def test_against_the_plain_version(spark, shard_words, monkeypatch):
    monkeypatch.setattr(module, "_CHUNK", 400)
    rows = random_rows(1)
    found = collocations(frame(spark, rows).repartition(3), shard_words=shard_words).collect()
    assert sorted(map(tuple, found)) == plain_version(rows)


def test_phrases_inside_longer_ones_and_fewer_rows(spark):
    rows = random_rows(2) + [("en", "alpha beta gamma delta")] * 40 + [("en", "beta gamma")] * 9
    found = collocations(frame(spark, rows), least=12, top=7).collect()
    assert sorted(map(tuple, found)) == plain_version(rows, 12, 7)
    assert "alpha beta gamma" not in {r["phrase"] for r in found}


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(module, "_FILTER_BITS", (64, 64))
    rows = random_rows(3, 150)
    assert sorted(map(tuple, collocations(frame(spark, rows)).collect())) == plain_version(rows)


def test_counts_of_all_lengths(spark):
    rows = random_rows(4)
    sizes, found = frequent_phrases(frame(spark, rows), shard_words=400)
    want = plain_counts(rows)
    assert {r["lang"]: r["n"] for r in sizes.collect()} == {lang: n for lang, (n, _) in want.items() if n}
    for length, table in found.items():
        got = {(r["lang"], r["phrase"]): r["f"] for r in table.collect()}
        assert got == {(lang, " ".join(p)): f for lang, (_, c) in want.items() for p, f in c.items() if len(p) == length and f >= 30}


def test_intervals_of_both_directions_agree():
    rng = np.random.default_rng(2)
    sequence = np.concatenate([[0], rng.integers(0, 6, 500), [0]])
    index = Index(transform(sequence, 6), transform(sequence[::-1], 6), 6)
    for sides in ([True, True, True], [False, False, False], [False, True, False], [True, False, True]):
        held = index.single()
        for left in sides:
            held = index.extend(held, index.neighbours(held, left), left)
            length = held.words.shape[1]
            seen = Counter(tuple(w) for i in range(len(sequence) - length + 1) if 0 not in (w := sequence[i : i + length].tolist()))
            assert {tuple(w): n for w, n in zip(held.words.tolist(), held.size.tolist(), strict=True)} == seen
            assert (held.forward + held.size <= len(sequence)).all() and (held.backward + held.size <= len(sequence)).all()


def test_empty_tables_and_tables_without_phrases(spark):
    for rows in ([], [("en", None)], [(None, "a b c"), ("en", "a b c")]):
        assert collocations(frame(spark, rows)).collect() == []


def test_a_very_long_text(spark):
    rows = [("en", "one two three. " * 40_000), ("en", "word " * 150_000)]
    found = {r["phrase"]: r for r in collocations(frame(spark, rows), shard_words=20_000).collect()}
    assert found["one two three"]["a"] == 40_000 and found["word word word word"]["a"] == 149_997


def test_shards_and_indexes_are_packed(spark, monkeypatch):
    files = []
    monkeypatch.setattr(module, "discard", lambda df, f=module.discard: (files.extend(df.inputFiles()), f(df)))
    rows = random_rows(5)
    assert sorted(map(tuple, collocations(frame(spark, rows)).collect())) == plain_version(rows)
    assert {"shards", "fm-index"} <= {f.split("/")[-2].rsplit("-", 1)[0] for f in files}
    assert all(f.endswith(".zstd.parquet") for f in files)


def test_shards_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    """A file's row groups and the reader's batches do not grow with the number of shards in it."""
    groups, sizes = [], {}
    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)

    def looked(df, name, *rest, f=module.written, **named):
        sizes[name] = spark.conf.get(key)
        return f(df, name, *rest, **named)

    def counted(df, f=module.discard):
        found = [pq.read_metadata(file.removeprefix("file://")) for file in df.inputFiles()]
        groups.append((sum(m.num_rows for m in found), [m.row_group(k).num_rows for m in found for k in range(m.num_row_groups)]))
        f(df)

    monkeypatch.setattr(module, "written", looked)
    monkeypatch.setattr(module, "discard", counted)
    monkeypatch.setattr(common, "_WIDE_ROWS", common._WIDE_ROWS | {"parquet.block.size": "64"})
    monkeypatch.setattr(module, "_CHUNK", 400)
    rows = random_rows(6)
    assert sorted(map(tuple, collocations(frame(spark, rows).coalesce(1), shard_words=200).collect())) == plain_version(rows)
    assert len(groups) == 2 and all(n > 5 and set(held) == {1} for n, held in groups)
    assert {sizes[name] for name in ("words", "fm-index", "hashes", "phrases-2", "phrases-3", "phrases-4")} == {"1"}
    assert spark.conf.get(key) == before
