import random
import re

import pytest
from pyspark.sql import functions as F

from commentarium.functions import text as tx
from commentarium.functions.dictionaries import LANGUAGE_CODES, language, stopwords
from commentarium.operators.preprocess import lemmatise, preprocess, profile


def one(spark, expression, value):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expression(F.col("c"))).first()[0]


CASES = [
    ("Look: https://w.org/7 has 12 rooms!", "look has rooms"),
    ("HELLO WORLD", "hello world"),
    ("HTTP://upper.example stays", "httpupperexample stays"),
    ("www.example.com/a?b=1 gone", "gone"),
    ("snake_case and __", "snakecase and"),
    ("café café", "café cafe"),
    ("x² ٤٥ ½", "x² ½"),
    ("tab\tand\x1cseparator nbsp em", "tab and separator nbsp em"),
    ("https://a.b c d", "c d"),
    ("", ""),
    ("!!! ???", ""),
]


@pytest.mark.parametrize("raw,expected", CASES)
def test_clean(spark, raw, expected):
    assert one(spark, tx.clean, raw) == expected


def test_clean_equals_single_steps(spark):
    rng = random.Random(7)
    alphabet = "aBéß_ 9٤²́! \n\x1d/.:w" + "中\U0001f600"
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) + " http://q.r/s" for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    c = F.col("c")
    chain = tx.collapse_spaces(
        F.lower(tx.strip_underscores(tx.strip_symbols(tx.strip_digits(tx.strip_urls(c)))))
    )
    assert df.where(tx.clean(c) != chain).count() == 0


def test_clean_equals_python_rules(spark):
    rng = random.Random(8)
    alphabet = "aBé_ 9٤²́! \n\x1d/.:w௰"
    texts = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "c string").select(tx.clean(F.col("c"))).collect()]
    for raw, cleaned in zip(texts, got):
        kept = re.sub(r"[^\w\s]|\d|_", "", re.sub(r"(?:https?://|www\.)\S+", "", raw))
        assert cleaned == " ".join(kept.lower().split())


def test_truncation_is_opt_in(spark):
    long = "palabra " * 200
    assert len(one(spark, lambda c: tx.clean(c, max_chars=600), long)) <= 600
    assert len(one(spark, tx.clean, long)) == len(long) - 1


def test_null_becomes_empty(spark):
    assert one(spark, tx.clean, None) == ""


def by_window(words, negations, window=3):
    out, left = [], 0
    for w in words:
        if left:
            out.append("NEG_" + w)
            left -= 1
        else:
            out.append(w)
            left = window if w in negations else 0
    return out


def test_negation_window_against_a_counter(spark):
    rng = random.Random(3)
    negations = language("en").negations
    vocabulary = ["a", "b", "c", "knot", "nots", *negations]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r[0] for r in df.select(tx.mark_negations(F.col("c"), negations)).collect()]
    assert got == [" ".join(by_window(t.split(), negations)) for t in texts]


def test_negation_example(spark):
    df = spark.createDataFrame([(1, "en", "never nice quiet rooms")], "row_id bigint, lang string, raw_text string")
    row = preprocess(df).first()
    assert row["clean_text"] == "never NEG_nice NEG_quiet NEG_rooms"
    assert row["tokens"] == ["never", "NEG_nice", "NEG_quiet", "NEG_rooms"]


@pytest.mark.parametrize("code", LANGUAGE_CODES)
def test_short_rows_stay_blank(spark, code):
    rows = [(1, code, "word"), (2, code, "!!"), (3, code, "zwei worte"), (4, code, None)]
    done = preprocess(spark.createDataFrame(rows, "row_id bigint, lang string, raw_text string")).orderBy("row_id").collect()
    assert [r["is_blank"] for r in done] == [True, True, False, True]
    assert done[0]["tokens"] == []


def test_other_languages_pass_through(spark):
    df = spark.createDataFrame([(1, "es", "No es nada bueno")], "row_id bigint, lang string, raw_text string")
    assert preprocess(df).first()["clean_text"] == "no es nada bueno"


def test_all_stopwords_leave_no_tokens(spark):
    df = spark.createDataFrame([(1, "en", "the and of")], "row_id bigint, lang string, raw_text string")
    row = preprocess(df).first()
    assert (row["clean_text"], row["tokens"]) == ("", [])


def test_lemmas_spare_negations(spark):
    df = spark.createDataFrame(
        [(1, "en", "rooms never rooms"), (2, "es", "rooms rooms"), (3, "en", "x")], "row_id bigint, lang string, raw_text string"
    )
    lemmas = spark.createDataFrame(
        [("en", "rooms", "room"), ("en", "never", "nev")], "lang string, surface string, lemma string"
    )
    done = {r["row_id"]: r["clean_text"] for r in preprocess(df, lemmas=lemmas).collect()}
    assert done == {1: "room never NEG_room", 2: "rooms rooms", 3: ""}


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"],), (["a"],), ([],)], "t array<string>")
    got = [tuple(r) for r in df.select(tx.ngrams(F.col("t"), 2), tx.ngrams(F.col("t"), 3)).collect()]
    assert got == [(["a b", "b c", "c d"], ["a b c", "b c d"]), ([], []), ([], [])]


def test_profile(spark):
    rows = [(1, "es", "uno dos tres"), (2, "es", "x" * 700 + " y"), (3, "es", "")]
    df = spark.createDataFrame(rows, "row_id bigint, lang string, raw_text string")
    p = profile(preprocess(df, max_chars=600)).first()
    assert (p["n_rows"], p["n_truncated"], p["n_blank"]) == (3, 1, 2)
    empty = profile(preprocess(df.where("row_id < 0"))).first()
    assert (empty["n_rows"], empty["mean_tokens"], empty["pct_truncated"]) == (0, 0.0, 0.0)


def test_registry():
    assert {c: language(c).scorer for c in LANGUAGE_CODES} == {
        "en": "lexicon", "es": "model", "fr": "model", "de": "model", "pt": "model"
    }
    with pytest.raises(ValueError, match="No language is registered"):
        language("xx")
    assert "dont" in stopwords("en") and "the" in stopwords("en")
    assert stopwords("xx") == ()


def test_row_stages_take_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, "en", "not a good room")], "row_id bigint, lang string, raw_text string").write.parquet(str(source))
    stream = spark.readStream.schema("row_id bigint, lang string, raw_text string").parquet(str(source))
    query = preprocess(stream).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("cleaned").first()["clean_text"] == "not NEG_good NEG_room"
