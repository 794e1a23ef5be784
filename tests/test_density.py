import numpy as np
import pytest
from pyspark.sql import functions as F

from commentarium.operators import components, density, neighbours
from commentarium.operators.density import Branch, branches, cluster_density, cut_levels, reachability, spanning_forest, stable
from commentarium.operators.neighbours import nearest


def frame(spark, rows, partitions=4):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(rows)], "row_id bigint, components array<double>").repartition(partitions)


def blobs(seed=4, width=5):
    rng = np.random.default_rng(seed)
    centres = np.array([[0] * width, [12] * width, [12, -12] + [0] * (width - 2), [13.5, -12] + [2] * (width - 2)])
    rows = np.concatenate([rng.normal(c, s, (n, width)) for c, s, n in zip(centres, (1, 0.5, 0.3, 0.3), (150, 90, 60, 60), strict=True)])
    return np.concatenate([rows, rng.uniform(-40, 40, (40, width)), np.repeat(rows[:1], 20, axis=0)])


def plain_edges(keys, rows, k):
    """Mutual reachability over the k nearest neighbours, by all pairs."""
    gaps = np.round([np.sqrt(((rows - r) ** 2).sum(axis=1)) for r in rows], 9)
    near = [sorted((gaps[i, j], keys[j], j) for j in range(len(rows)) if j != i)[:k] for i in range(len(rows))]
    core = [n[-1][0] for n in near]
    return {
        (min(keys[i], keys[j]), max(keys[i], keys[j])): max(g, core[i], core[j], density.LEAST_DISTANCE) for i, n in enumerate(near) for g, _, j in n
    }


class Sets:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def top(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def plain_forest(edges):
    sets = Sets({x for e in edges for x in e})
    return {(a, b, w) for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()) if sets.join(a, b)}


def plain_clusters(keys, forest, cuts, least):
    """key -> cluster, by cutting the forest at every level and walking down from the top."""

    def parts(members, level):
        sets = Sets(members)
        for a, b, w in forest:
            if w <= cuts[level] and a in sets.up and b in sets.up:
                sets.join(a, b)
        found = {}
        for m in members:
            found.setdefault(sets.top(m), []).append(m)
        return [p for p in found.values() if len(p) >= least]

    def walk(members, level):
        """(stability, clusters) of the best choice for a part that begins at ``level``."""
        born, total = list(members), 0.0
        while True:
            upper = 1 / cuts[level + 1] if level + 1 < len(cuts) else 0.0
            total += len(members) * (1 / cuts[level] - upper)
            inner = parts(members, level - 1) if level else []
            if len(inner) != 1:
                break
            members, level = inner[0], level - 1
        below = [walk(p, level - 1) for p in inner]
        if round(total, 9) >= round(sum(s for s, _ in below), 9):
            return total, [born]
        return sum(s for s, _ in below), [c for _, found in below for c in found]

    top = parts(keys, len(cuts) - 1)
    if len(top) > 1:
        return [c for p in top for c in walk(p, len(cuts) - 1)[1]]
    level, members = len(cuts) - 1, top[0]
    while level:  # a lone root is no cluster
        inner = parts(members, level - 1)
        if len(inner) != 1:
            return [c for p in inner for c in walk(p, level - 1)[1]]
        members, level = inner[0], level - 1
    return []


def keys_of(spark, df):
    return [r[0] for r in df.orderBy("row_id").select(F.xxhash64("row_id")).collect()]


def check_against_plain(spark, rows, least):
    df = frame(spark, rows)
    keys = keys_of(spark, df)
    points = df.select(F.xxhash64("row_id").alias("key"), F.col("components").alias("v"))
    edges = plain_edges(keys, rows, neighbours.NEIGHBOURS)
    found = reachability(nearest(points)).cache()
    assert {(r["src"], r["dst"]): r["w"] for r in found.collect()} == edges
    forest = spanning_forest(found).cache()
    assert {tuple(r) for r in forest.collect()} == plain_forest(edges)
    want = plain_clusters(keys, plain_forest(edges), cut_levels(forest), least)
    got = {}
    for r in cluster_density(df, min_rows=least).collect():
        if r["topic_id"] >= 0:
            got.setdefault(r["topic_id"], set()).add(keys[r["row_id"]])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    return got


def test_blobs_against_all_pairs(spark):
    found = check_against_plain(spark, blobs(), 30)
    assert len(found) == 4  # two of them so close that a single distance would not part them from the wide one


def test_given_vectors_against_all_pairs(spark):
    rows = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()], dtype=float)
    check_against_plain(spark, rows[:300], 10)


def test_partitioning_does_not_matter(spark):
    rows = blobs(9)
    one, eight = (sorted(map(tuple, cluster_density(frame(spark, rows, p), min_rows=30).collect())) for p in (1, 8))
    assert one == eight and {t for _, t in one} == {-1, 0, 1, 2, 3}


def test_trees_find_most_neighbours(spark, monkeypatch):
    rows = np.random.default_rng(2).standard_normal((3000, 8))
    rows[:400] = rows[0]  # many equal rows: leaves stay small
    points = frame(spark, rows).select(F.col("row_id").alias("key"), F.col("components").alias("v"))
    placed = neighbours.leaves(points, 3000, trees=4, leaf_rows=300)
    assert max(r["count"] for r in placed.groupBy("tree", "node").count().collect()) <= 600
    found = {}
    for r in nearest(points, k=10, trees=8, leaf_rows=300).collect():
        found.setdefault(r["src"], []).append(r["d"])
    hit = 0
    for i in range(400, 3000, 20):
        gaps = np.sort(np.round(np.sqrt(((rows - rows[i]) ** 2).sum(axis=1)), 9))[1:11]
        hit += sum(d <= gaps[-1] for d in found[i])
    assert hit / (10 * len(range(400, 3000, 20))) > 0.85


def test_small_and_odd_tables(spark):
    assert cluster_density(frame(spark, [])).collect() == []
    assert [r["topic_id"] for r in cluster_density(frame(spark, [[1, 2]])).collect()] == [-1]
    rows = [None] + [[1.0, 1.0]] * 20 + [[9.0, 9.0]] * 25
    found = {r["row_id"]: r["topic_id"] for r in cluster_density(frame(spark, rows)).collect()}
    assert found == {0: -1} | dict.fromkeys(range(1, 21), 1) | dict.fromkeys(range(21, 46), 0)
    equal = cluster_density(frame(spark, [[1.0, 1.0]] * 12))
    assert {r["topic_id"] for r in equal.collect()} == {-1}  # one part from top to bottom
    single = cluster_density(frame(spark, [[1.0, 1.0]] * 12), single=True)
    assert {r["topic_id"] for r in single.collect()} == {0}


def test_the_more_stable_of_outer_and_inner_parts():
    cuts = [1.0, 2.0, 4.0]
    rows = [(2, 1, 100, None), (1, 1, 40, 1), (1, 50, 45, 1), (0, 1, 15, 1), (0, 7, 15, 1), (0, 50, 44, 50)]
    roots = branches(rows)
    assert [(b.part, b.top, b.low, [c.part for c in b.children]) for b in roots] == [(1, 2, 2, [1, 50])]
    left, right = roots[0].children
    assert (left.stability(cuts), right.stability(cuts)) == (40 * 0.25, 45 * 0.25 + 44 * 0.5)
    assert [(b.part, b.top) for b in stable(roots, cuts)] == [(1, 0), (7, 0), (50, 1)]
    assert stable([Branch(1, 0, 0, {0: 5})], [1.0], single=True)[0].part == 1


def test_rounds_do_not_carry_the_estimate_of_their_joins(spark):
    def bits(df):
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()

    path = [(i, i + 1) for i in range(60)]
    nodes = spark.createDataFrame([(i,) for i in range(61)], "node bigint")
    found = density.connected_components(nodes, spark.createDataFrame(path, "src bigint, dst bigint"))
    assert {r["component"] for r in found.collect()} == {0} and bits(found) < 100
    forest = spanning_forest(spark.createDataFrame([(a, b, 1.0 + a) for a, b in path], "src bigint, dst bigint, w double"))
    assert forest.count() == 60 and bits(forest) < 100


@pytest.mark.parametrize("one_task", [8, 200_000])
def test_parts_at_all_cuts_shrink_as_they_are_joined(spark, monkeypatch, one_task):
    """Rounds move what is left of the links, not every row at every cut; self links keep their row."""
    rng = np.random.default_rng(5)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 80)]
    tree = [(2000 + int(rng.integers(0, k)), 2000 + k) for k in range(1, 120)]
    links = [(a, b, float(rng.integers(1, 7))) for a, b in path + star + tree] + [(5000, 5000, 1.0)]
    cuts = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    staged = []

    def looked(df, name, f=components.staged_columns):
        out = f(df, name)
        staged.append((name, out.count()))
        return out

    monkeypatch.setattr(components, "staged_columns", looked)
    monkeypatch.setattr(components, "ONE_TASK_EDGES", one_task)
    want = {}
    for level, cut in enumerate(cuts):
        inside = [(a, b) for a, b, w in links if w <= cut]
        sets = Sets({x for e in inside for x in e})
        for a, b in inside:
            sets.join(a, b)
        want |= {(level, x): sets.top(x) for x in sets.up}
    forest = spark.createDataFrame(links, "src bigint, dst bigint, w double").repartition(3)
    assert {(r["level"], r["node"]): r["part"] for r in density.parts_at(forest, cuts).collect()} == want
    edges = [n for name, n in staged if name == "edges"]
    assert edges[-1] <= one_task and all(b <= 0.8 * a for a, b in zip(edges, edges[1:], strict=False) if a > 100)
    assert sum(n for _, n in staged) < 8 * edges[0]

    counts = {}
    for (level, _), part in want.items():
        counts[level, part] = counts.get((level, part), 0) + 1
    large = {(level, x): part for (level, x), part in want.items() if counts[level, part] >= 20}
    assert {(r["level"], r["node"]): r["part"] for r in density.parts_at(forest, cuts, 20).collect()} == large
