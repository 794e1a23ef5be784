import random

import pytest

from commentarium.llm.common import components

from .plain import components as plain_components


@pytest.mark.parametrize("shape", ["path", "stars", "random", "loops", "empty"])
def test_components(spark, shape):
    rng = random.Random(5)
    edges = {
        "path": [(i, i + 1) for i in range(200)],
        "stars": [(i % 3, i) for i in range(60)] + [(7, 1000)],
        "random": [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(120)],
        "loops": [(1, 1), (2, 3), (3, 2), (2, 3)],
        "empty": [],
    }[shape]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    ids = {i for e in edges if e[0] != e[1] for i in e}
    assert found == plain_components(ids, [e for e in edges if e[0] != e[1]])
