import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sheetlark.llm import centroids
from sheetlark.llm.common import MOST_UNITS

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, dim=64, scale=64, k=16, rounds=3):
    """(id, cluster, distance) and the final centroids, by plain loops."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centers = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(own[j]) for x in zip(*own[j], strict=True)] if j in own else c for j, c in enumerate(centers)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centers


def held(df):
    return sorted(((r.vec_id, r.cluster, r.distance) for r in df.collect()), key=str)


def vectors(n, dim=64, seed=3, spread=0.05):
    g = random.Random(seed)
    middles = [[g.uniform(-1, 1) for _ in range(dim)] for _ in range(7)]
    return [(i, [x + g.gauss(0, spread) for x in middles[i % 7]], "x") for i in range(n)]


def test_brute_force_with_odd_rows(spark):
    rows = vectors(600)
    rows += rows[:40] + [(i + 5000, [0.25] * 64, None) for i in range(300)]  # repeated rows, and a hot group of equal vectors
    rows += [(9001, None, "x"), (9002, [0.1] * 63, "x"), (9003, [0.1] * 63 + [None], "x"), (9004, [0.1] * 63 + [float("nan")], "x"), (9005, [float("inf")] * 64, "x"), (9006, [], "x"), (None, [0.5] * 64, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want, centers = brute(rows)
    got = centroids.cluster(df, block=100)
    assert held(got) == sorted(want, key=str)
    sums = {}
    for _, c, d in want:
        sums[c] = sums.get(c, 0) + d
    for r in got.collect():
        assert r.cluster_inertia == sums[r.cluster] and r.inertia == sum(sums.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()
    assert held(centroids.cluster(df, block=7)) == held(got)


def test_few_large_and_none(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert centroids.cluster(spark.createDataFrame([(1, None, "x")], SCHEMA)).count() == 0
    few = [(i, [i / 10] * 64, "x") for i in range(3)] + [(7, [3e38] * 64, "x")]
    got = held(centroids.cluster(spark.createDataFrame(few, SCHEMA)))
    assert [(i, d) for i, _, d in got] == [(0, 0), (1, 0), (2, 0), (7, None)] and {c for _, c, _ in got} == {0, 1, 2, None}
    assert [tuple(r) for r in centroids.cluster(spark.createDataFrame(few[3:], SCHEMA)).collect()] == [(7, None, None, None, None, None)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 400), st.integers(1, 9), st.sampled_from([1, 3, 40, MOST_UNITS]))
def test_tree_assigns_like_a_plain_search(seed, n, k, most):
    """Small ranges make ties between centroids, which the lesser number wins."""
    g = np.random.default_rng(seed)
    points, centers = g.integers(-most, most + 1, (n, 5)).astype(np.int32), g.integers(-most, most + 1, (k, 5))
    tree = centroids.Tree.build(points)
    d = ((points.astype(np.int64)[:, None] - centers[None]) ** 2).sum(2)
    cluster, distance = centroids.assigned(tree, centers)
    assert (cluster == d.argmin(1)[tree.order]).all() and (distance == d.min(1)[tree.order]).all()
    counts, sums = np.zeros(k, np.int64), np.zeros((k, 5), np.int64)
    centroids.totals(tree, centers, counts, sums)
    assert (counts == np.bincount(d.argmin(1), minlength=k)).all()
    assert all((sums[c] == points[d.argmin(1) == c].sum(0, dtype=np.int64)).all() for c in range(k))
    again = centroids.Tree.of_row(tree.row(), 5)
    assert (again.points == tree.points).all() and (again.sums == tree.sums).all() and (again.high == tree.high).all()


def test_nodes_are_assigned_whole():
    """Clusters far apart: no leaf is searched."""
    g = np.random.default_rng(1)
    points = np.concatenate([g.integers(0, 20, (2000, 8)) + 1000 * i for i in range(4)]).astype(np.int32)
    tree = centroids.Tree.build(points)
    centers = np.array([[1000 * i + 10] * 8 for i in range(4)])
    met = list(centroids.walk(tree, centers))
    assert all(at is None for _, at, _ in met) and sum(len(n) for n, _, _ in met) < 20
