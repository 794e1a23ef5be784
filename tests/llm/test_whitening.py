import numpy as np
import pytest

from commentarium.llm import whitening
from commentarium.llm.queries import whitening_query
from commentarium.llm.whitening import fixed_point, spectrum, whitened_components

SCHEMA = "vec_id bigint, embedding array<float>, n string, deviation int"


def plain_version(vectors):
    """(whole numbers, eigenvalues, eigenvectors) by forming the covariance."""
    x = np.floor(np.array(vectors, dtype=np.float64) * 64).astype(np.int64) + 1_000_000
    z = (len(x) * x - x.sum(axis=0)) / len(x)
    values, directions = np.linalg.eigh(z.T @ z / len(x))
    return x, z, values[::-1], directions[:, ::-1]


def test_query_against_the_plain_version(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    given = [r for r in given if r["embedding"] is not None and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    x, z, values, directions = plain_version([r["embedding"] for r in given])
    rows = whitening_query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 32 * len(given)
    place = {r["vec_id"]: i for i, r in enumerate(given)}
    exact = [sum(int(len(x) * a - s) ** 2 for a, s in zip(v, x.sum(axis=0), strict=True)) for v in x]
    want = z @ directions[:, :32] / np.sqrt(values[:32])
    got = np.zeros_like(want)
    for r in rows:
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["n"] == len(x) and r["deviation"] == exact[place[r["vec_id"]]]
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-10
        assert r["identity_error"] < 1e-9 and r["residual"] < 1e-12
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-8


def test_filter_separates_close_eigenvalues_without_the_whole_space(spark):
    rng = np.random.default_rng(3)
    scales = np.concatenate([np.linspace(3.0, 2.0, 8), np.linspace(1.9, 0.1, 92)])
    vectors = (rng.standard_normal((1500, 100)) * scales).tolist()
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(vectors)], SCHEMA).repartition(5)
    points = fixed_point(df)
    found = spectrum(points, components=8, guard=6)
    x, _, values, directions = plain_version(np.array(vectors, dtype=np.float32))
    assert found.passes > 10 and found.vectors.shape == (100, 8)  # a block of 14 of 100 dimensions, filtered
    assert np.allclose(found.values, values[:8], rtol=1e-12)
    assert np.allclose(np.abs((found.vectors * directions[:, :8]).sum(axis=0)), 1, atol=1e-11)
    assert np.array_equal(found.sums, x.sum(axis=0))


def test_fewer_directions_than_components(spark):
    vectors = [[1.0, 2.0, 3.0], [2.0, 4.0, 3.0], [0.5, 1.0, 3.0], [0.5, 1.0, 3.0]]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(vectors)], SCHEMA)
    rows = whitened_components(df).collect()
    assert {r["component"] for r in rows} == {1} and len(rows) == 4  # one line in space
    assert abs(rows[0]["explained"] - 1) < 1e-12 and rows[0]["identity_error"] < 1e-12
    equal = [r["whitened"] for r in rows if r["vec_id"] in (2, 3)]
    assert equal[0] == equal[1]


def test_rows_that_do_not_take_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), float(i * i), 1.0], "x", 0) for i in range(6)]
    odd = [(10, None, "x", 0), (11, [1.0, None, 2.0], "x", 0), (12, [1.0, nan, 0.0], "x", 0), (13, [inf, 0.0, 0.0], "x", 0), (14, [1.0], "x", 0), (15, [], "x", 0), (16, [3e38, 0.0, 0.0], "x", 0)]
    rows = whitened_components(spark.createDataFrame(good + odd + [(None, [9.0, 1.0, 1.0], "x", 0)], SCHEMA)).collect()
    assert {r["vec_id"] for r in rows} == {0, 1, 2, 3, 4, 5, None}
    assert {r["n"] for r in rows} == {7} and {r["component"] for r in rows} == {1, 2}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], "x", 0)], [(1, [1.0, 2.0], "x", 0)] * 3, [(1, None, "x", 0)]])
def test_no_variance_no_rows(spark, rows):
    found = whitened_components(spark.createDataFrame(rows, SCHEMA))
    assert found.columns[:2] == ["vec_id", "component"] and found.count() == 0


def test_deviations_beyond_64_bits_are_null(spark):
    far = float(2**40)
    rows = [(i, [far * (i % 2), float(i)], "x", 0) for i in range(8)]
    found = whitened_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["deviation"] is None for r in found) and found[0]["identity_error"] < 1e-4


def test_blocks_of_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_ROWS", 3)
    vectors = np.random.default_rng(1).standard_normal((50, 4)).tolist()
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in enumerate(vectors)], SCHEMA)
    _, _, values, _ = plain_version(np.array(vectors, dtype=np.float32))
    assert np.allclose(spectrum(fixed_point(df.repartition(3))).values, values, rtol=1e-12)
