import numpy as np
import pytest
from pyspark.sql import functions as F

from commentarium.operators import layout
from commentarium.operators.layout import kept_neighbours, lay_out, neighbour_layout


def frame(spark, rows, partitions=4):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "row_id bigint, components array<double>").repartition(partitions)


def given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["embedding"] for r in rows], dtype=float)


def places(df):
    return np.array([(r["x"], r["y"]) for r in sorted(df.collect(), key=lambda r: r["row_id"])])


def gaps(rows):
    return np.array([((rows - r) ** 2).sum(axis=1) for r in rows])


def trustworthiness(rows, laid, k=10):
    """1 less the rows that are near in the plane alone, weighed by how far down they rank (Venna & Kaski, 2001)."""
    n, far, near = len(rows), gaps(rows), gaps(laid)
    np.fill_diagonal(far, -1.0)
    np.fill_diagonal(near, np.inf)
    rank = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
    found = np.argsort(near, axis=1, kind="stable")[:, :k]
    beyond = np.maximum(np.take_along_axis(rank, found, axis=1) - k, 0).sum()
    return 1 - 2 * beyond / (n * k * (2 * n - 3 * k - 1))


@pytest.mark.parametrize("landmarks", [1024, 200])
def test_given_vectors_keep_neighbours_better_than_two_axes(spark, landmarks):
    rows = given_vectors(spark)
    laid = places(neighbour_layout(frame(spark, rows), landmarks=landmarks))
    centred = rows - rows.mean(axis=0)
    axes = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert trustworthiness(rows, laid) > trustworthiness(rows, axes) + 0.05


def test_partitioning_does_not_matter(spark):
    rows = np.concatenate([given_vectors(spark)[:260], given_vectors(spark)[:20]])
    one, eight = (places(neighbour_layout(frame(spark, rows, p), landmarks=60)) for p in (1, 8))
    assert (one == eight).all()


def test_rounds_against_a_plain_version(spark):
    rows, k, rounds = given_vectors(spark)[:150], 5, 2
    df = frame(spark, rows)
    keys = [r[0] for r in df.orderBy("row_id").select(F.xxhash64("row_id")).collect()]
    start = places(neighbour_layout(df, k=k, landmarks=40, rounds=0))
    order = sorted(df.select("row_id", F.xxhash64(F.lit(layout.SEED), F.xxhash64("row_id")).alias("h")).collect(), key=lambda r: r["h"])
    held = sorted((r["row_id"] for r in order[:40]), key=lambda i: keys[i])
    fixed = lay_out(rows[held], k)
    far = gaps(rows)
    for i in range(len(rows)):  # everyone begins at the nearest landmark
        at = held.index(i) if i in held else int(np.argmin(far[i, held].round(9)))
        assert np.allclose(start[i], fixed[at])
    now = start
    for _ in range(rounds):
        moved = now.copy()
        for i in set(range(len(rows))) - set(held):
            near = sorted((far[i, j], j) for j in range(len(rows)) if j != i)[:k]
            beyond = np.array([d - near[0][0] for d, _ in near])
            w = np.exp(-beyond / beyond.mean())
            pull = sum(w[a] / w.sum() * (now[j] - now[i]) / (1 + ((now[j] - now[i]) ** 2).sum()) for a, (_, j) in enumerate(near))
            kernel = 1 / (1 + ((now[i] - fixed) ** 2).sum(axis=1))
            push = ((kernel**2 / kernel.sum())[:, None] * (now[i] - fixed)).sum(axis=0)
            moved[i] = now[i] + pull + push
        now = moved
    assert np.allclose(places(neighbour_layout(df, k=k, landmarks=40, rounds=rounds)), now, atol=1e-4)


def test_far_groups_stay_apart(spark):
    rng = np.random.default_rng(3)
    groups = np.repeat(np.arange(3), 60)
    rows = rng.standard_normal((180, 6)) + 30 * np.eye(6)[groups]
    laid = places(neighbour_layout(frame(spark, rows), landmarks=50))
    near = gaps(laid)
    np.fill_diagonal(near, np.inf)
    assert (groups[np.argsort(near, axis=1)[:, :5]] == groups[:, None]).all()


def test_odd_rows(spark):
    assert neighbour_layout(frame(spark, [])).collect() == []
    assert places(neighbour_layout(frame(spark, [[1, 2]]))).tolist() == [[0, 0]]
    odd = [None, [float("nan"), 1.0], [float("inf"), 1.0]]
    assert places(neighbour_layout(frame(spark, odd))).tolist() == [[0, 0]] * 3
    rows = [[1.0, 1.0]] * 20 + [[9.0, 9.0]] * 25
    assert np.array_equal(places(neighbour_layout(frame(spark, odd + rows)))[:3], np.zeros((3, 2)))
    for landmarks in (1024, 10):
        laid = places(neighbour_layout(frame(spark, rows), landmarks=landmarks))
        assert np.isfinite(laid).all() and not np.allclose(laid[:20].mean(axis=0), laid[20:].mean(axis=0))
    line = places(neighbour_layout(frame(spark, [[float(k)] for k in range(30)])))
    assert np.isfinite(line).all() and (line[:, 1] == 0).all()


def test_kept_neighbours_counts_the_overlap(spark):
    rows = np.random.default_rng(5).standard_normal((60, 4))
    points = frame(spark, rows).select(F.col("row_id").alias("key"), F.col("components").alias("v"))
    flat = frame(spark, rows[:, :2]).select(F.col("row_id").alias("key"), F.col("components").alias("v"))
    far, near = gaps(rows), gaps(rows[:, :2])
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(near, np.inf)
    want = {i: len(set(np.argsort(far[i])[:7]) & set(np.argsort(near[i])[:7])) for i in range(60)}
    assert {r["key"]: r["n_kept"] for r in kept_neighbours(points, flat, 7).collect()} == want
