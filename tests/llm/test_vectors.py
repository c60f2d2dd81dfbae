import numpy as np
from pyspark.sql import functions as F

from strandweave.llm import hash_forest as H
from strandweave.llm.linkage import contracted, distances, linked, similarity_clusters
from strandweave.llm.similar import exact_neighbours, near_pairs, nearest_vectors, recall
from strandweave.llm import vectors as V
from strandweave.llm.vectors import usable_vectors

SCHEMA = "vec_id long, vec array<double>"


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids if ids is not None else range(len(x)), x)], SCHEMA)


def test_usable(spark):
    rows = [(1, "[1, 2]"), (1, "[1, 2]"), (2, " ( 1.5e-1 ,-2 ) "), (3, "[1, nan]"), (4, "[1]"), (5, None), (6, ""), (7, "[1, inf]"), (8, "[1,,2]"), (None, "[1, 2]"), (9, "[1, x]"), (10, "1 2")]
    df = spark.createDataFrame(rows, "vec_id long, correlation_achieved string").withColumn("t", F.lit(1)).withColumn("vec", F.lit("x"))
    got = {r.vec_id: r.vec for r in usable_vectors(df, dims=2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.15, -2.0], 10: [1.0, 2.0]}


def test_stretches_ascend_to_enough(spark):
    rng = np.random.default_rng(0)
    h = np.sort(rng.integers(0, 1 << 62, 5000))
    parts = H.stretches(h, 300, 100)
    assert sorted(i for a, b, _, _ in parts for i in range(a, b)) == list(range(5000))
    assert all(lo <= a and b <= hi and hi - lo >= 100 for a, b, lo, hi in parts)
    same = H.stretches(np.zeros(1000, np.int64), 300, 100)
    assert same == [(0, 1000, 0, 1000)]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([c + 0.1 * rng.normal(size=(60, 8)) for c in rng.normal(size=(30, 8))])
    got = nearest_vectors(frame(spark, x), 10, leaf=256, least=64).collect()
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :10]
    hit = {(r.vec_id, r.other_id): r.distance for r in got}
    assert sum((i, j) in hit for i in range(len(x)) for j in want[i]) / want.size > 0.95
    assert all(abs(d[i, j] - v) < 1e-12 for (i, j), v in hit.items()) and len(got) == 10 * len(x)


def test_exact_neighbours_and_recall(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 4)), 2)
    x[200:] = x[:100]
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    df = frame(spark, x)
    got = {(r.vec_id, r["rank"]): (r.other_id, r.distance) for r in exact_neighbours(df, df.where("vec_id % 10 = 0"), 5, portion=7).collect()}
    assert len(got) == 150
    for i in range(0, 300, 10):
        want = sorted((round(v, 9), j) for j, v in enumerate(d[i]))[:5]
        assert [(round(got[i, k + 1][1], 9), got[i, k + 1][0]) for k in range(5)] == want
    found = nearest_vectors(df, 5)
    assert recall(found, exact_neighbours(df, df, 5)).first().recall == 1.0
    assert exact_neighbours(df, df.limit(0)).count() == 0


def test_copies_ties_and_small_collections(spark):
    x = [[0.0, 0.0]] * 30 + [[1.0, 0.0], [3.0, 0.0]]
    got = {}
    for r in nearest_vectors(frame(spark, x), 10).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append((r.other_id, r.distance))
    assert [i for i, _ in got[0]] == list(range(1, 11)) and [i for i, _ in got[29]] == list(range(10))
    assert got[30] == [(i, 1.0) for i in range(10)] and got[31][0] == (30, 2.0)
    assert nearest_vectors(frame(spark, [[1.0, 2.0]])).count() == 0
    assert nearest_vectors(frame(spark, [])).count() == 0
    assert sorted(map(tuple, near_pairs(nearest_vectors(frame(spark, [[0.0], [0.05], [1.0]], [5, 3, 9]))).collect())) == [(3, 5)]


def average_linkage(d, limit, n):
    """One pair at a time, the nearest first."""
    groups = [[i] for i in range(len(d))]
    mean = lambda a, b: sum(n[i] * n[j] * d[i, j] for i in a for j in b) / (sum(n[i] for i in a) * sum(n[j] for j in b))
    while len(groups) > 1:
        v, i, j = min((mean(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        if v > limit:
            break
        groups[i] += groups.pop(j)
    out = np.empty(len(d), int)
    for g in groups:
        out[g] = min(g)
    return out


def test_linkage_equals_brute_force_where_groups_touch():
    rng = np.random.default_rng(2)
    for spread in (0.1, 0.3, 0.6, 1.0):
        x = np.vstack([c + spread * rng.normal(size=(9, 3)) for c in rng.normal(size=(5, 3))])
        n = rng.integers(1, 4, len(x))
        assert (linked(distances(x), n, 0.8) == average_linkage(distances(x), 0.8, n)).all()


def test_contracted():
    x = np.array([[0.0], [5.0], [0.7], [1.4], [5.1], [9.0], [2.1]])
    assert contracted(x, 0.8).tolist() == [0, 1, 0, 0, 1, 5, 0]


def test_packing_is_exact():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.integers(-900, 900, (5, 6)) / 1000, rng.integers(-9000, 9000, (4, 6)) / 10000, rng.normal(size=(3, 6)), [[1e300, -0.0, 5e-324, 1, 2, 3]]])
    assert (V.unpacked(V.packed(x)) == x).all() and len(V.packed(x)[0].as_py()) == 13 and V.unpacked(V.packed(x).slice(7, 4)).tolist() == x[7:11].tolist()
    assert V.fingerprints(np.array([[0.0, 1.0]])).equals(V.fingerprints(np.array([[-0.0, 1.0]])))


def clustered(spark, x, **kw):
    people, _ = similarity_clusters(frame(spark, x), **kw)
    own = {r.vec_id: r.first_vec_id for r in people.collect()}
    return np.array([own[i] for i in range(len(x))])


def test_touching_groups_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.round(np.vstack([c + 0.25 * rng.normal(size=(12, 3)) for c in rng.normal(size=(8, 3))]), 3)
    assert (clustered(spark, x) == average_linkage(distances(x), 0.8, np.ones(len(x)))).all()


def test_components_beyond_the_bound(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([c + 0.03 * rng.normal(size=(k, 6)) for c, k in zip(3 * rng.normal(size=(4, 6)), (300, 90, 5, 1))])
    x = np.vstack([x, x[:2]])
    d = distances(x) <= 0.8
    people, clusters = similarity_clusters(frame(spark, x), bound=40, leaf=64)
    assert all(r.first_vec_id == int(np.flatnonzero(d[r.vec_id])[0]) and r.size == d[r.vec_id].sum() for r in people.collect())
    c = {r.first_vec_id: r for r in clusters.collect()}
    assert sorted(r["size"] for r in c.values()) == [1, 5, 90, 302] and all(len(r.typical) == min(3, r["size"]) for r in c.values())


def test_clusters(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([c + 0.03 * rng.normal(size=(k, 6)) for c, k in zip(3 * rng.normal(size=(12, 6)), (1, 2, 3, 200, 40, 9, 9, 9, 5, 5, 300, 17))])
    x = np.vstack([x, x[:1], x[:1]])
    people, clusters = similarity_clusters(frame(spark, x), leaf=64)
    own = {r.vec_id: r.first_vec_id for r in people.collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.8
    assert all(own[i] == int(np.flatnonzero(d[i])[0]) for i in range(len(x)))
    c = {r.first_vec_id: r for r in clusters.collect()}
    assert c[0]["size"] == 3 and c[0].typical == [0, 600, 601] and c[0].spread == 0
    assert sum(r["size"] for r in c.values()) == len(x)
    people, clusters = similarity_clusters(frame(spark, []))
    assert people.count() == clusters.count() == 0
