"""The whole analysis on small inputs: row conservation, contracts and both topic paths."""

import random

import pytest
from pyspark.sql import functions as F

from commentarium.operators import sentiment as st
from commentarium.operators.topics import TOPIC_COLUMNS
from commentarium.plans.feedback import analyse

TALK = {
    "pos": ["great room lovely view", "good clean pool garden", "great staff good service"],
    "neg": ["bad room dirty floor", "bad noise awful night", "dirty pool bad smell"],
}


@pytest.fixture(scope="module")
def lexicon(spark):
    words = [("great", 3.0), ("good", 2.0), ("bad", -2.0), ("dirty", -2.0), ("awful", -3.0)]
    table = spark.createDataFrame(words, "token string, valence double")
    return st.merge_lexicons(table, table)


def comments(spark, n_pos, n_neg):
    rng = random.Random(5)
    extra = "table lamp window street beach morning coffee garden music towel".split()
    rows = []
    for k in range(n_pos + n_neg):
        text = rng.choice(TALK["pos" if k < n_pos else "neg"])
        rows.append((k, "en", f"{text} {rng.choice(extra)} {rng.choice(extra)}"))
    return spark.createDataFrame(rows, "row_id bigint, lang string, raw_text string")


def check_contract(result, n):
    rows = result.rows.cache()
    assert rows.count() + result.outliers.count() == n
    assert rows.select("row_id").distinct().count() == rows.count()
    assert set(TOPIC_COLUMNS) <= set(rows.columns)
    assert rows.where("concept_similarity not between -1.000001 and 1.000001").count() == 0
    kpi = result.kpi.first()
    assert kpi["n_rows"] == n and kpi["n_pos"] + kpi["n_neg"] == kpi["n_clean"]
    assert result.outliers.count() <= 0.05 * n + 1
    return rows


def test_small_sides_fall_back(spark, lexicon, tmp_path):
    result = analyse(comments(spark, 30, 20), lexicon, concept="clean pool")
    rows = check_contract(result, 50)
    assert rows.select("topic_label").distinct().collect()[0][0] == "word_frequency_fallback"
    assert result.topics.count() == 0 and result.cards.count() == 0 and result.topic_points.count() == 0
    top = result.top_texts.collect()
    assert len(top) == 5 and "pool" in top[0]["clean_text"]
    base = result.write(str(tmp_path), "r1", {"concept": "clean pool"})
    assert spark.read.parquet(f"{base}/kpi").first()["n_rows"] == 50


def test_large_side_is_clustered(spark, lexicon):
    result = analyse(comments(spark, 240, 40), lexicon)
    rows = check_contract(result, 280)
    pos = rows.where("sentiment = 'pos'")
    assert pos.where("x is null or y is null").count() == 0
    chosen = pos.where("representative_doc").groupBy("topic_id").count().collect()
    topics = {r["topic_id"] for r in pos.where("topic_id >= 0").select("topic_id").distinct().collect()}
    assert topics and {tuple(r) for r in chosen} == {(t, 1) for t in topics}
    assert {r["topic_id"] for r in result.topics.collect()} == topics
    assert rows.where("sentiment = 'neg' and topic_label <> 'word_frequency_fallback'").count() == 0
    assert result.topic_points.count() > 0
    assert result.headlines.count() == 1


def test_density_topics_and_neighbour_layout(spark, lexicon):
    rows = check_contract(analyse(comments(spark, 160, 120), lexicon, topic_method="density", layout="neighbours"), 280)
    assert rows.where("x is null or y is null").count() == 0
    assert rows.select("x", "y").distinct().count() > 20
    assert rows.where("topic_id < -1").count() == 0
    with pytest.raises(ValueError, match="not on offer"):
        analyse(comments(spark, 5, 5), lexicon, layout="circle")


def test_given_encoder_and_predictor(spark, lexicon):
    df = comments(spark, 30, 20).withColumn("lang", F.when(F.col("row_id") % 2 == 0, "en").otherwise("fr"))

    def encode(rows):
        return rows.withColumn("embedding", F.transform(F.array(*[F.lit(w) for w in ("pool", "room", "bad")]), lambda w: F.contains("clean_text", w).cast("float")))

    def predict(rows):
        sure = F.struct(F.lit("NEG").alias("output"), F.lit(0.2).alias("p_pos"), F.lit(0.7).alias("p_neg"), F.lit(0.1).alias("p_neu"))
        return rows.withColumn("probabilities", sure)

    result = analyse(df, lexicon, encode=encode, predict=predict, outlier_method="centroid", concept="pool")
    rows = check_contract(result, 50)
    assert rows.where("lang = 'fr' and sentiment <> 'neg'").count() == 0
    assert rows.where("lang = 'en' and sentiment = 'pos'").count() > 0


def test_cache_and_fitted_classifier(spark, lexicon, tmp_path):
    df = comments(spark, 30, 20).withColumn("lang", F.when(F.col("row_id") % 2 == 0, "en").otherwise("fr"))
    labelled = df.select("row_id", (F.col("row_id") < 30).cast("int").alias("label"))
    path = str(tmp_path / "vectors")
    first = analyse(df, lexicon, labelled=labelled, cache=path)
    french = first.rows.where("lang = 'fr'")
    assert french.where((F.col("sentiment") == "pos") != (F.col("row_id") < 30)).count() <= 2
    stored = spark.read.parquet(path).count()
    assert 0 < stored <= 50
    again = analyse(df, lexicon, labelled=labelled, cache=path)
    assert again.rows.count() == first.rows.count()
    assert spark.read.parquet(path).count() == stored
    with pytest.raises(ValueError, match="cache_id"):
        analyse(df, lexicon, encode=lambda rows: rows, cache=path)
