import numpy as np
import pytest
from pyspark.sql import functions as F

from commentarium.operators import topics as tp
from commentarium.operators.components import connected_components
from commentarium.operators.naming import topic_name


@pytest.mark.parametrize(
    "keywords,name",
    [
        ("", "General"),
        (None, "General"),
        ("precio, caro, hotel", "Pricing"),
        ("hotel zzz, mmm", "Hotel Zzz / Mmm"),
        ("room, staff", "Room"),
        ("staff, room, chambre", "Room"),
        ("clean", "Cleanliness"),
        ("qqq", "Qqq"),
        ("wif, pool, room", "Amenities"),
    ],
)
def test_names(spark, keywords, name):
    df = spark.createDataFrame([(keywords,)], "k string")
    assert df.select(topic_name(F.col("k"))).first()[0] == name


def test_components(spark):
    nodes = spark.createDataFrame([(k,) for k in range(12)], "node bigint")
    edges = spark.createDataFrame([(k, k + 1) for k in range(7)] + [(10, 9)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(nodes, edges).collect()}
    assert got == {**{k: 0 for k in range(8)}, 8: 8, 9: 9, 10: 9, 11: 11}


def planted(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for c, n in enumerate(sizes):
        for _ in range(n):
            centre = np.zeros(6)
            centre[c] = 10
            rows.append((k, c, [float(x) for x in centre + rng.normal(scale=0.3, size=6)], [f"w{c}", f"w{c}x", "common"]))
            k += 1
    return spark.createDataFrame(rows, "row_id bigint, planted int, components array<double>, tokens array<string>")


def test_kmeans_finds_planted_clusters(spark):
    df = planted(spark, [80, 60, 60])
    done = df.join(tp.cluster_kmeans(df), "row_id").cache()
    assert done.count() == 200
    pairs = done.where("topic_id >= 0").groupBy("planted").agg(F.count_distinct("topic_id").alias("n")).collect()
    assert [r["n"] for r in pairs] == [1, 1, 1]
    assert done.where("topic_id >= 0").select("topic_id").distinct().count() == 3
    assert done.where("topic_id = -1").count() <= 10


def test_kmeans_does_not_hang_on_the_layout(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("components")
    )
    found = [sorted(map(tuple, tp.cluster_kmeans(df.repartition(p)).collect())) for p in (1, 2, 8)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 500


def test_kmeans_edges(spark):
    schema = "row_id bigint, components array<double>"
    assert tp.cluster_kmeans(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(30)], schema)
    assert {r["topic_id"] for r in tp.cluster_kmeans(same).collect()} == {-1}


def test_grid_finds_blobs_and_drops_small_ones(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(230):
        c = 0 if k < 120 else 1 if k < 215 else 2
        x, y = rng.normal(scale=0.2, size=2) + [20 * c, 5 * c]
        rows.append((k, c, float(x), float(y)))
    df = spark.createDataFrame(rows, "row_id bigint, c int, x double, y double")
    got = {(r["c"], r["topic_id"]) for r in tp.cluster_grid(df, cells=16).collect()}
    assert got == {(0, 0), (1, 1), (2, -1)}
    assert tp.cluster_grid(df.where("false")).count() == 0


def given(spark):
    rows = []
    for k in range(100):
        topic = -1 if k >= 90 else k // 30
        vector = [float(topic == t) + 0.01 * (k % 7) for t in range(3)]
        rows.append((k, "pos", topic, [f"word{topic}", "shared", "a"], f"text {k}", vector))
    return spark.createDataFrame(
        rows, "row_id bigint, sentiment string, topic_id int, tokens array<string>, clean_text string, embedding array<double>"
    )


def test_words_labels_and_representatives(spark):
    rows = given(spark)
    top = tp.top_words(tp.topic_word_weights(tp.topic_token_counts(rows)))
    table = tp.topic_table(top, tp.topic_sizes(rows))
    keywords = {r["topic_id"]: r["keywords"] for r in table.collect()}
    assert keywords == {t: f"word{t}, shared" for t in range(3)}
    done = tp.mark_representatives(tp.attach_topics(rows, table)).cache()
    assert done.count() == 100
    noise = done.where("topic_id = -1").select("topic_label", "topic_keywords").distinct().collect()
    assert [tuple(r) for r in noise] == [("General", "")]
    chosen = done.where("representative_doc").groupBy("topic_id").count().collect()
    assert sorted(map(tuple, chosen)) == [(0, 1), (1, 1), (2, 1)]


def test_all_noise(spark):
    rows = given(spark).withColumn("topic_id", F.lit(-1))
    table = tp.topic_table(tp.top_words(tp.topic_word_weights(tp.topic_token_counts(rows))), tp.topic_sizes(rows))
    done = tp.mark_representatives(tp.attach_topics(rows, table))
    assert table.count() == 0
    assert done.where("representative_doc or topic_label <> 'General'").count() == 0


def test_similar_topics_merge(spark):
    base = given(spark).where("topic_id >= 0")
    rows = base.withColumn("tokens", F.when(F.col("topic_id") < 2, F.array(F.lit("same"), F.lit("pair"))).otherwise(F.col("tokens")))
    mapping = tp.merge_map(tp.topic_word_weights(tp.topic_token_counts(rows)), tp.topic_sizes(rows), 0.9)
    assert {(r["topic_id"], r["merged_id"]) for r in mapping.collect()} == {(0, 0), (1, 0), (2, 1)}
    assert tp.apply_merge(rows, mapping).groupBy("topic_id").count().orderBy("topic_id").collect()[0]["count"] == 60


def test_diverse_words(spark):
    rows = given(spark)
    weights = tp.topic_word_weights(tp.topic_token_counts(rows))
    chosen = tp.diversify_words(tp.top_words(weights, tp.CANDIDATES), rows, n=2).collect()
    assert {r["place"] for r in chosen} == {1, 2}
    assert len({(r["topic_id"], r["token"]) for r in chosen}) == len(chosen)


def test_fallback_contract(spark):
    rows = spark.createDataFrame(
        [(1, "en", ["The", "Room", "room"]), (2, "en", ["pool", "and", "room"]), (3, "en", [])],
        "row_id bigint, lang string, tokens array<string>",
    )
    done = tp.fallback_topics(rows)
    assert done.columns == [*rows.columns, "topic_id", "topic_label", "topic_keywords", "x", "y", "representative_doc"]
    for r in done.collect():
        assert (r["topic_id"], r["topic_label"], r["topic_keywords"]) == (-1, "word_frequency_fallback", "room, pool")
        assert r["x"] is None and r["representative_doc"] is False
    assert tp.fallback_topics(rows.where("row_id = 3")).first()["topic_keywords"] == ""
    assert set(tp.fallback_topics(rows.where("false")).columns) == set(done.columns)


def test_frequent_words_break_ties_by_first_use(spark):
    rows = spark.createDataFrame([(2, ["late", "b", "a"]), (1, ["b", "a"])], "row_id bigint, tokens array<string>")
    assert [r["token"] for r in tp.frequent_words(rows, lang=None).collect()] == ["b", "a", "late"]
