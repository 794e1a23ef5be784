import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from commentarium.functions.vectors import cosine, cosine_to
from commentarium.operators import embed, outliers
from commentarium.operators.joins import join_on_content, lookup_join
from commentarium.operators import joins
from commentarium.operators.quantiles import exact_quantile


def frame(spark, points, parts=3):
    rows = [(k, [float(x) for x in p]) for k, p in enumerate(points)]
    return spark.createDataFrame(rows, "row_id bigint, embedding array<float>").repartition(parts)


def blob(n, width=8, seed=0, far=()):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, width))
    for k in far:
        points[k] += 40
    return points


def test_cosine_matches_numpy(spark):
    points = blob(20)
    points[3] = 0
    target = points[5]
    got = {r[0]: r[1] for r in frame(spark, points).select("row_id", cosine_to(F.col("embedding"), target)).collect()}
    for k, p in enumerate(points.astype("float32").astype(float)):
        length = np.linalg.norm(p) * np.linalg.norm(target)
        assert got[k] == pytest.approx(0.0 if length == 0 else p @ target / length, abs=1e-9)
    same = frame(spark, points).select(cosine(F.col("embedding"), F.col("embedding")).alias("c")).where("c > 1.0000001").count()
    assert same == 0


@pytest.mark.parametrize("slack, small", [(None, 10_000), (0.004, 10_000), (0.004, 4), (-0.02, 4), (-0.02, 10_000)])
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, monkeypatch, q, slack, small):
    """From the sketch alone; by a bracket; by one that holds too many values; by one that misses the rank."""
    from commentarium.operators import quantiles

    if slack is not None:
        monkeypatch.setattr(quantiles, "_HELD", 0)
        monkeypatch.setattr(quantiles, "_SLACK", slack)
    monkeypatch.setattr(quantiles, "_SMALL", small)
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=400), np.full(300, 0.25), [1e6, -1e6]])
    df = spark.createDataFrame([(float(v),) for v in values], "s double").repartition(3)
    assert exact_quantile(df, "s", q) == pytest.approx(np.percentile(values, 100 * q), rel=1e-12)


def test_exact_quantile_beyond_what_a_sketch_holds(spark):
    df = spark.range(0, 300_000, 1, 8).select(F.pow(F.rand(7), 3).alias("s")).persist()
    values = np.array([r[0] for r in df.collect()])
    for q in (0.001, 0.5, 0.95, 0.9999):
        assert exact_quantile(df, "s", q) == pytest.approx(np.percentile(values, 100 * q), rel=1e-12)
    df.unpersist()


def test_stored_sketches_give_the_cut_of_all_batches(spark, tmp_path):
    scores = np.random.default_rng(3).normal(size=60_000)
    df = spark.createDataFrame(pd.DataFrame({"k": range(60_000), "outlier_score": scores}))
    for batch in (0, 1, 1):  # a batch stored twice counts once
        outliers.store_scores(df.where(F.col("k") % 2 == batch), str(tmp_path), batch)
    outliers.store_scores(df.limit(0), str(tmp_path), "none")
    cut = outliers.stored_cut(spark, str(tmp_path))
    assert abs((scores > cut).mean() - 0.05) < 0.003
    odd = spark.createDataFrame([(1, 99.0), (2, -99.0), (3, float("nan")), (4, None)], "k int, outlier_score double")
    flags = {r["k"]: r["is_outlier"] for r in outliers.flag_above(odd, cut).collect()}
    assert flags == {1: True, 2: False, 3: True, 4: False}
    outliers.store_scores(df.limit(0), str(tmp_path / "empty"), 0)
    assert outliers.stored_cut(spark, str(tmp_path / "empty")) is None


def test_quantile_of_nothing(spark):
    assert exact_quantile(spark.createDataFrame([], "s double"), "s", 0.5) is None


@pytest.mark.parametrize("share", [-1.0, 0.0, 0.009, 0.151, 0.4, 2.0])
def test_bad_contamination(spark, share):
    with pytest.raises(ValueError, match="share of outliers"):
        outliers.check_contamination(share)


@pytest.mark.parametrize("share", [0.01, 0.05, 0.15])
def test_good_contamination(share):
    assert outliers.check_contamination(share) == share


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_tiny_inputs_keep_rows(spark, n):
    done = outliers.detect_outliers(frame(spark, blob(n)))
    assert done.count() == n
    if n <= 1:
        assert done.where("is_outlier").count() == 0


def test_far_rows_are_found_whatever_the_partitions(spark):
    points = blob(200, far=(7, 90))
    flags = []
    for parts in (1, 8):
        done = outliers.detect_outliers(frame(spark, points, parts), 0.01)
        flags.append({r["row_id"] for r in done.where("is_outlier").collect()})
    assert flags[0] == flags[1] == {7, 90}


def test_share_is_bounded_and_rows_conserved(spark):
    flagged = outliers.detect_outliers(frame(spark, blob(300)), 0.1).cache()
    clean, out = outliers.split_outliers(flagged)
    assert clean.count() + out.count() == 300
    assert 0 < out.count() <= 30
    share = outliers.outlier_share(flagged).first()
    assert share["n_outliers"] == out.count()
    assert outliers.outlier_share(flagged.where("row_id < 0")).first()["outlier_share"] == 0.0


def test_dealing_from_many_rows(spark):
    """The hash cut-off path: every tree gets its rows, no row twice."""
    rows = spark.range(5000).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("components"))
    dealt = outliers._deal_rows(rows, "components", "row_id", 5000, trees=10, per_tree=16, seed=42).collect()
    assert len(dealt) == 160 and len({r["key"] for r in dealt}) == 160
    assert {r["tree"] for r in dealt} == set(range(10))
    again = outliers._deal_rows(rows.repartition(7), "components", "row_id", 5000, 10, 16, 42).collect()
    assert {(r["tree"], r["key"]) for r in dealt} == {(r["tree"], r["key"]) for r in again}


def test_identical_vectors(spark):
    done = outliers.detect_outliers(frame(spark, np.ones((20, 4))))
    assert done.count() == 20 and done.where("is_outlier").count() == 0


def counting_encoder(seen):
    def encode(df):
        rows = df.select("clean_text").collect()
        seen.extend(r[0] for r in rows)
        return df.withColumn("embedding", F.array(F.length("clean_text").cast("float")))

    return encode


def test_cache_encodes_each_text_once(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []
    rows = [(k, "same" if k < 70 else f"text {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "row_id bigint, clean_text string")
    first = embed.cached_vectors(df, path, "m", counting_encoder(seen))
    assert first.count() == 100 and first.where("embedding is null").count() == 0
    assert sorted(seen) == sorted({t for _, t in rows})
    changed = df.withColumn("clean_text", F.when(F.col("row_id") == 99, "new words").otherwise(F.col("clean_text")))
    seen.clear()
    second = embed.cached_vectors(changed, path, "m", counting_encoder(seen))
    assert seen == ["new words"] and second.count() == 100
    seen.clear()
    embed.cached_vectors(df, path, "other", counting_encoder(seen))
    assert len(seen) == 31


def test_fingerprint_sees_content_not_order(spark):
    df = spark.createDataFrame([("ab",), ("c",), ("d",)], "clean_text string")
    same = embed.dataset_fingerprint(df.orderBy(F.desc("clean_text"))).first()
    assert embed.dataset_fingerprint(df).first() == same
    other = spark.createDataFrame([("a",), ("bc",), ("d",)], "clean_text string")
    assert embed.dataset_fingerprint(other).first() != same


@pytest.mark.parametrize("how", ["left", "inner", "left_anti", "left_semi"])
def test_salted_lookup_equals_broadcast(spark, monkeypatch, how):
    facts = spark.createDataFrame([(k, "hot" if k % 3 else f"t{k % 11}") for k in range(300)], "row_id bigint, token string")
    dim = spark.createDataFrame([("hot", 1.0), ("t3", 2.0), ("t9", 3.0)], "token string, valence double")
    wide = lookup_join(facts, dim, "token", how)
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    salted = lookup_join(facts, dim, "token", how)
    assert "BroadcastHashJoin" in wide._jdf.queryExecution().toString()
    assert sorted(map(tuple, wide.collect()), key=repr) == sorted(map(tuple, salted.select(wide.columns).collect()), key=repr)


def test_broadcast_is_measured(spark):
    dim = spark.range(100).select(F.col("id"), F.expr("repeat('x', 1000)").alias("s"))
    assert joins.fits_broadcast(dim, 100, 200_000)
    assert not joins.fits_broadcast(dim, 99, 200_000)
    assert not joins.fits_broadcast(dim, 100, 50_000)


def test_hot_contents_are_salted(spark):
    facts = spark.createDataFrame([(k, "hot" if k < 500 else f"c{k}") for k in range(900)], "row_id bigint, content_hash string")
    contents = facts.groupBy("content_hash").agg(F.count("*").alias("copies")).withColumn("v", F.length("content_hash"))
    joined = join_on_content(facts, contents, "content_hash", "copies")
    assert joined.count() == 900 and joined.where("v is null or v <> length(content_hash)").count() == 0
    assert joined.columns == ["content_hash", "row_id", "v"]
