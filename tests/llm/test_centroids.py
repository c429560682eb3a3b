"""Centroid clustering against brute force in Python integers."""

import hashlib
import math
import random

import pytest

from tidewater.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v string, id string, cluster string, distance string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", None) for i, v in rows], SCHEMA)


def by_brute_force(rows, k, rounds, dims, seed=2):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    mids = [v for _, v in order[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(mids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        mids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(mids)]
    placed = [(i, *place(v)) for i, v in kept]
    total = sum(d for _, d, _ in placed)
    return [(i, n, d, sum(e for _, e, m in placed if m == n), total, mids[n]) for i, d, n in placed]


def key(rows):
    return sorted(rows, key=lambda t: (t[0] is None, t[0] or 0, t[1:]))


@pytest.mark.parametrize("k,rounds", [(7, 5), (3, 0), (40, 2)])
def test_clusters(spark, k, rounds):
    r = random.Random(k)
    rows = [(i, [r.uniform(-2, 2) for _ in range(8)]) for i in range(150)]
    rows = [(i, [float(x) for x in map(lambda v: round(v * 1024) / 1024, v)]) for i, v in rows]  # exact as floats
    hot = [0.25] * 8
    rows += [(1000 + i, hot) for i in range(80)]  # ties and a vector in a third of all rows
    rows += [(5, rows[5][1]), (5, hot), (None, hot), (None, [1.0] * 8), (-7, [-0.001] * 8)]
    bad = [(900, None), (901, []), (902, [1.0] * 7), (903, [1.0] * 9), (904, [None] + [1.0] * 7),
           (905, [float("nan")] * 8), (906, [float("inf")] + [0.0] * 7), (907, [-float("inf")] + [0.0] * 7)]
    got = centroids.cluster(vectors(spark, rows + bad), k=k, rounds=rounds, dims=8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert key(tuple(x) for x in got.collect()) == key(by_brute_force(rows + bad, k, rounds, 8))


def test_equally_near_centroids_take_the_smaller_number(spark):
    v = spark.createDataFrame([(1, [0, 0], 0)], "vec_id long, v array<long>, square long")
    assert centroids.assign(v, [[5, 0], [0, 3], [3, 0], [-3, 0]]).first()["cluster"] == 1


def test_an_empty_centroid_stays(spark):
    v = spark.createDataFrame([(1, [0, 0], 0), (2, [-1, 1], 2)], "vec_id long, v array<long>, square long")
    assert centroids.means(v, [[0, 0], [900, 900]]) == [[-1, 0], [900, 900]]


def test_no_vectors(spark):
    got = centroids.cluster(vectors(spark, [(1, None), (2, [1.0])]), k=4, dims=8)
    assert got.collect() == [] and [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint", "bigint", "array<bigint>"]
    assert centroids.cluster(vectors(spark, []), k=4, dims=8).count() == 0


def test_a_component_that_cannot_be_squared_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, [1e30] * 8)]), dims=8).collect()
