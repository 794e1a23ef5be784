import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from commentarium.operators import charts as ch
from commentarium.operators import sentiment as st
from commentarium.operators import topics as tp
from commentarium.operators.storage import cut_lineage, shared_dir, spread, stage


def plan(df):
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def rows(spark, n=200):
    return spark.range(n).select(
        F.col("id").alias("row_id"), F.lit("en").alias("lang"), F.array(F.lit("good"), F.lit("room")).alias("tokens"),
        F.when(F.col("id") % 2 == 0, "pos").otherwise("neg").alias("part"),
    )


def test_staged_tables_meet_without_a_shuffle(spark, no_broadcast):
    texts = stage(rows(spark))
    other = stage(texts.select("row_id", F.size("tokens").alias("n")), partitioned=True)
    joined = texts.join(other, "row_id")
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    assert joined.count() == 200


def test_labels_of_staged_texts_need_no_shuffle(spark, no_broadcast):
    texts = stage(rows(spark))
    lexicon = spark.createDataFrame([("good", 2.0, 0.5)], "token string, valence_1 double, valence_2 double")
    labels = st.lexicon_labels(texts, lexicon, ("lang",))
    assert "Exchange hashpartitioning" not in plan(labels)
    assert labels.where("sentiment = 'pos'").count() == 200


def test_top_k_is_limited_before_the_shuffle(spark):
    p = plan(ch.word_weights(rows(spark)))
    assert p.index("Final") < p.index("Partial")
    assert p.count("WindowGroupLimit") == 2
    weights = tp.topic_word_weights(
        tp.topic_token_counts(rows(spark).withColumn("sentiment", F.lit("pos")).withColumn("topic_id", F.lit(0)))
    )
    assert plan(tp.top_words(weights)).count("WindowGroupLimit") == 2


def test_counts_are_hash_aggregates(spark):
    p = plan(tp.frequent_words(rows(spark)))
    assert "SortAggregate" not in p and "TakeOrderedAndProject" in p


def test_spread_only_helps_narrow_inputs(spark):
    assert spread(rows(spark).coalesce(1)).rdd.getNumPartitions() == 8
    wide = rows(spark).repartition(20)
    assert spread(wide) is wide


def test_cut_lineage_keeps_rows(spark):
    cut = cut_lineage(rows(spark))
    assert cut.count() == 200 and "Scan ExistingRDD" in plan(cut)


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_the_named_folder_is_used():
    seen = []
    context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=seen.append, master="yarn")
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: "hdfs:///shared"))
    assert shared_dir(session) == "hdfs:///shared" and seen == ["hdfs:///shared"]
