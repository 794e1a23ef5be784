import pytest
from pyspark.sql import functions as F

from commentarium.operators import charts as ch
from commentarium.operators import search as se
from commentarium.operators import summary as sm


def vectors(spark, n):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding")
    )


@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (2, 2), (20, 10)])
def test_top_n_is_clamped(spark, n, expected):
    scored = se.add_similarity(vectors(spark, n), [1.0, 0.0])
    top = se.top_similar(scored, 10).collect()
    assert [r["row_id"] for r in top] == list(range(expected))
    assert "concept_similarity" in scored.columns


def test_distinct_texts_keep_the_first_row(spark):
    rows = [(1, "same", 0.9, "pos"), (2, "same", 0.9, "neg"), (3, "x" * 300, 0.5, "pos"), (4, "low", 0.1, "neg")]
    df = spark.createDataFrame(rows, "row_id bigint, clean_text string, concept_similarity double, sentiment string").repartition(3)
    top = se.top_similar_texts(df, 2).collect()
    assert [(r["row_id"], r["sentiment"], len(r["clean_text"])) for r in top] == [(1, "pos", 4), (3, "pos", 200)]


@pytest.mark.parametrize("n,limit,expected", [(50, 1000, 50), (1100, 1000, 1000)])
def test_sample_size_is_exact_and_stable(spark, n, limit, expected):
    df = spark.range(n).withColumnRenamed("id", "row_id")
    first = {r[0] for r in ch.sample_points(df, limit).collect()}
    again = {r[0] for r in ch.sample_points(df.repartition(5), limit).collect()}
    assert len(first) == expected and first == again


@pytest.mark.parametrize("reps,expected", [(5, 5), (1010, 1000)])
def test_representatives_survive_sampling(spark, reps, expected):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") < reps).alias("representative_doc"))
    done = ch.sample_with_representatives(df).collect()
    assert len(done) == 1000
    assert sum(r["representative_doc"] for r in done) == expected
    if reps > 1000:
        assert {r["row_id"] for r in done} == set(range(1000))


def grams(spark, rows, n, **options):
    df = spark.createDataFrame([(k, "en", t) for k, t in enumerate(rows)], "row_id bigint, lang string, tokens array<string>")
    return [tuple(r) for r in ch.ngram_counts(df, n, **options).collect()]


def test_ngram_rules(spark):
    rows = [["pool", "x", "bar", "pool"], ["pool", "the", "bar"], ["NEG_pool"], []]
    assert grams(spark, rows, 1) == [("pool", 3, 2), ("bar", 2, 2)]
    assert grams(spark, rows, 2) == [("pool bar", 2, 2)]
    assert grams(spark, rows, 3) == []
    assert grams(spark, [["pool", "bar"]] * 2, 1) == []  # in every row: over the share


def test_word_weights(spark):
    rows = [("pos", "en", ["pool", "pool", "the", "bar"]), ("neg", "en", ["the"])]
    df = spark.createDataFrame(rows, "part string, lang string, tokens array<string>")
    assert [tuple(r) for r in ch.word_weights(df).orderBy("place").collect()] == [("pos", "pool", 2, 1.0, 1), ("pos", "bar", 1, 0.5, 2)]


def test_scatter_without_coordinates(spark):
    df = spark.createDataFrame(
        [(1, "pos", -1, None, None, False)],
        "row_id bigint, sentiment string, topic_id int, x double, y double, representative_doc boolean",
    )
    assert ch.scatter_points(df).count() == 0
    assert ch.has_coordinates(df).first()["has_coordinates"] is False


def report(spark):
    rows = [
        (1, "a", "pos", True, 0.9, False), (2, "b", "pos", False, 0.4, False), (3, "c", "neg", True, 0.2, False),
        (4, "d", None, None, None, True),
    ]
    return spark.createDataFrame(
        rows,
        "row_id bigint, clean_text string, sentiment string, sentiment_confidence boolean, concept_similarity double, is_outlier boolean",
    )


def test_kpis(spark):
    k = sm.kpis(report(spark)).first()
    assert (k["n_rows"], k["n_clean"], k["n_outliers"], k["n_pos"], k["n_neg"]) == (4, 3, 1, 2, 1)
    assert k["pos_share"] == pytest.approx(2 / 3) and k["confidence_rate"] == pytest.approx(2 / 3)
    assert k["top_concept_score"] == 0.9
    bar = sm.breakdown(sm.kpis(report(spark))).first()
    assert bar["pos_pct"] + bar["neg_pct"] + bar["outliers_pct"] == pytest.approx(100)
    assert bar["outliers_pct_of_clean"] == pytest.approx(100 / 3)


def test_empty_report(spark):
    empty = report(spark).where("false")
    k = sm.kpis(empty).first()
    assert (k["n_rows"], k["pos_share"], k["confidence_rate"], k["top_concept_score"]) == (0, 0.0, 0.0, None)
    assert sm.breakdown(sm.kpis(empty)).first()["pos_pct"] == 0.0
    few = empty.select("clean_text", "sentiment")
    assert sm.kpis(few).first()["confidence_rate"] == 0.0


def test_cards(spark):
    rows = [
        (1, "pos", "first", "Pricing", "precio", False), (2, "pos", "best", "Pricing", "costo", True),
        (3, "pos", "odd", "General", "", False), (4, "neg", "few", "word_frequency_fallback", "x", False), (5, "neg", "none", None, None, False),
    ]
    df = spark.createDataFrame(
        rows, "row_id bigint, sentiment string, clean_text string, topic_label string, topic_keywords string, representative_doc boolean"
    )
    assert {tuple(r) for r in sm.topic_cards(df).collect()} == {
        ("pos", "Pricing", "precio", 2, "best"), ("pos", "General", "", 1, "")
    }
