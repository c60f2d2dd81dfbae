import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import generate, quality, segments, ticc
from strandweave.operators.describe import describe, min_max_scaled


def test_interval_join_against_brute_force(spark):
    rng = random.Random(1)
    obs = [(f"s{i % 3}", i) for i in range(600)]
    seg = [(f"s{rng.randrange(3)}", k, a, a + rng.randrange(-3, 300)) for k in range(40) for a in [rng.randrange(600)]] + [("s0", 99, None, 5)]
    o = spark.createDataFrame(obs, "subject_id string, obs_idx long")
    s = spark.createDataFrame(seg, "subject_id string, segment_id int, start_idx int, end_idx int")
    got = sorted((r.subject_id, r.obs_idx, r.segment_id) for r in segments.interval_join(o, s).collect())
    assert got == sorted((a, i, k) for a, i in obs for b, k, x, y in seg if a == b and x is not None and x <= i <= y)
    half = segments.interval_join(o, s, "left_semi")
    assert half.columns == ["subject_id", "obs_idx"] and half.count() == len({(a, i) for a, i, _ in got})


def test_sparsified_keeps_exactly(spark):
    o = spark.createDataFrame([(f"s{i % 2}", i // 2) for i in range(2001)], "subject_id string, obs_idx long")
    x = segments.sparsified(o, 0.3)
    n = {r[0]: r[1] for r in x.groupBy("subject_id").count().collect()}
    assert n == {"s0": round(0.7 * 1001), "s1": round(0.7 * 1000)}
    r = x.where("subject_id = 's0'").orderBy("old_idx").collect()
    assert [q.obs_idx for q in r] == list(range(len(r)))


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, None, 1, 1, 2, None])], "g string, segment_id long, v int")
    got = [tuple(r) for r in segments.runs_to_segments(df, ["g"], ["segment_id"], "v", "segment_id").orderBy("start_idx").collect()]
    assert got == [("a", 0, None, 0, 1, 2), ("a", 1, 1, 2, 3, 2), ("a", 2, 2, 4, 4, 1), ("a", 3, None, 5, 5, 1)]


def test_agreement_with_itself_is_one(spark):
    s = spark.createDataFrame([("a", 0, 1499, 1), ("a", 1500, 5000, 2)], "subject_id string, start_idx int, end_idx int, cluster_id int")
    r = quality.agreement(s, s.withColumn("p", F.lit("x")), ["p"]).first()
    assert (r.n, r.agree) == (5001, 5001)


ROWS = [([0.1, 0.2, 0.8], 1, 1, 2), ([-0.2, 0.0, 0.99], 1, 1, 1), ([0.0, 0.3, 0.71], 1, 2, 2), ([-1.0, 0.1, 0.0], 2, 2, 1), ([-0.5, 0.5, 0.1], 2, 2, 2)]


def test_quality_orders_partitions(spark):
    long = [(name, i, r[0], r[k]) for k, name in ((1, "gt"), (2, "ok"), (3, "bad")) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(long, "g string, row int, vec array<double>, c int")
    s = {r.g: r.swc for r in quality.silhouette_index(df, ["g"], "row", "c", "vec", chunk=2).collect()}
    assert s["gt"] > s["ok"] > s["bad"]
    cen, all_ = quality.mean_vectors(df, ["g", "c"], "vec", "centroid"), quality.mean_vectors(df, ["g"], "vec", "overall")
    q = {r.g: r for r in quality.centroid_indices(df, cen, all_, ["g"], "c", "l1").collect()}
    assert q["gt"].dbi < q["ok"].dbi < q["bad"].dbi and q["gt"].vrc > q["ok"].vrc > q["bad"].vrc and q["gt"].pbm > q["ok"].pbm > q["bad"].pbm


def test_silhouette_edges(spark):
    df = spark.createDataFrame([("one", 1, [0.0], 1), ("own", 1, [0.0], 1), ("own", 2, [1.0], 2), ("same", 1, [0.0], 1), ("same", 2, [0.0], 1), ("same", 3, [0.0], 2)], "g string, row int, vec array<double>, c int")
    s = {r.g: r.swc for r in quality.silhouette_index(df, ["g"], "row", "c", "vec").collect()}
    assert s == {"one": None, "own": None, "same": 0.0}
    assert quality.silhouette_index(df.limit(0), ["g"], "row", "c", "vec").count() == 0


def test_describe_leaves_out_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", None)], "g string, v double")
    r = {x.g: x for x in describe(df, ["g"], "v").collect()}
    assert (r["a"]["count"], r["a"].mean, r["a"].std, r["b"]["count"]) == (1, 1.0, None, 0)
    assert {x.v for x in min_max_scaled(spark.createDataFrame([("a", 3.0), ("a", 3.0)], "g string, v double"), ["g"], ["v"]).collect()} == {0.0}


def test_generator(spark):
    from strandweave.sources import tables as S
    p = S.patterns_to_model(spark, "/root/testdata/sf0.001")
    assert p.count() == 23
    x = generate.generated_segments(spark, p, 1, 12, 5)
    assert x.where("stage = 'correlated'").count() == x.where("stage = 'raw'").count() > 0
    rng = np.random.default_rng(0)
    order = generate.pattern_order([1, 2, 3], 31, rng)
    assert all(a != b for a, b in zip(order, order[1:])) and max(map(order.count, (1, 2, 3))) - min(map(order.count, (1, 2, 3))) <= 1
    with pytest.raises(ValueError):
        generate.pattern_order([1], 3, rng)
    z = generate.stages(20000, np.array([0.7, 0.0, 0.7]), 1, {"iob": (0.05, 2.0, 1.5), "cob": (1.2, 0.08), "ig": (-0.1, 120.0, 35.0)})
    c = np.corrcoef(z["correlated"].T)
    assert abs(c[0, 1] - 0.7) < 0.03 and abs(c[0, 2]) < 0.03 and (z["nonnormal"][:, 1] >= 0).all()


def test_chunked_path_equals_whole_path(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.multivariate_normal([0, 0], [[1, r], [r, 1]], 150) for r in (0.9, -0.9, 0.9)])
    model, a = ticc.fit_matrix(x, 2, 2, penalty=20.0, iterations=4)
    assert all(np.allclose(m, m.T) and np.allclose(m[:2, :2], m[2:, 2:], atol=1e-4) for m in model.inverses) and np.isfinite(model.bic)
    df = spark.createDataFrame([("s", i, float(u), float(v)) for i, (u, v) in enumerate(x)], "subject_id string, obs_idx long, a double, b double")
    got = [r.cluster for r in ticc.predict(df, model, ("a", "b"), chunk=64).orderBy("obs_idx").collect()]
    c = model.costs(ticc.stacked_windows(x, 2))
    want = ticc.best_path(c, model.penalty)
    total = lambda p: sum(c[i, k] for i, k in enumerate(p)) + model.penalty * sum(p[i] != p[i - 1] for i in range(1, len(p)))
    assert total(got) == pytest.approx(total(want))
    e = ticc.edges(spark, model)
    assert ticc.asymmetric_edges(e).count() == 0 and ticc.centralities(e).where("degree < 1").count() == 0


def test_toeplitz_fit_sees_all_subjects(spark):
    rng = np.random.default_rng(5)
    regime = lambda r, n: rng.multivariate_normal([0, 0], [[1, r], [r, 1]], n)
    series = {"a": regime(0.95, 60), "b": np.vstack([regime(0.95, 300), regime(-0.95, 400)]), "c": regime(-0.95, 200)}
    df = spark.createDataFrame([(k, i, float(u), float(v)) for k, x in series.items() for i, (u, v) in enumerate(x)], "subject_id string, obs_idx long, a double, b double")
    model = ticc.fit(df, 2, 2, penalty=20.0, chunk=64)
    got = {k: [r.cluster for r in ticc.predict(df.where(F.col("subject_id") == k), model, ("a", "b"), chunk=64).orderBy("obs_idx").collect()] for k in series}
    b = got["b"]
    assert len({*b[:290]}) == 1 and len({*b[310:690]}) == 1 and b[0] != b[500]
    assert {*got["a"][:55]} == {b[0]} and {*got["c"][:190]} == {b[500]} and np.isfinite(model.bic)


def test_degraded_partitions_tile_and_relabel(spark):
    seg = [("a", i, 100 * i, 100 * i + 99, i % 4, 100) for i in range(8)]
    df = spark.createDataFrame(seg, "subject_id string, segment_id int, start_idx int, end_idx int, cluster_id int, length int")
    rows = segments.degraded(df, n=5, leave=20).collect()
    own = {i: c for _, i, _, _, c, _ in seg}
    moves = []
    for name in {r.clustering_desc for r in rows}:
        p = sorted((r for r in rows if r.clustering_desc == name), key=lambda r: r.start_idx)
        assert sum(r.length for r in p) == 800 and p[0].start_idx == 0 and p[-1].end_idx == 799
        moved = p[1].start_idx - 100
        assert all(r.start_idx - 100 * r.segment_id == moved for r in p[1:])
        wrong = sum(r.cluster_id != own[r.segment_id] for r in p)
        assert (moved == 0) == name.startswith("wrong-clusters") and (wrong == 0) == name.startswith("shifted-end-idx")
        moves.append(moved)
    assert len(moves) == 15 and max(moves) == 80


def test_wrong_clusters_of_large_segment_ids(spark):
    ids = [5, 271_172, 900_000, 2**31 - 2]  # times 7919 they pass 32 bits
    df = spark.createDataFrame([("a", i, 1 + i % 3) for i in ids], "subject_id string, segment_id int, cluster_id int")
    got = {r.segment_id: r.cluster_id for r in segments.wrong_clusters(df, ["subject_id"], 3, F.array(*map(F.lit, (1, 2, 3)))).collect()}
    first = sorted(ids, key=lambda i: ((i + 1) * 7919 % 10007, i))[:3]
    assert got == {i: (1 + i % 3) % 3 + 1 if i in first else 1 + i % 3 for i in ids}


def test_toeplitz_seeds_where_chunks_draw_nothing(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(f"s{i % 200}", i // 200, float(u), float(v)) for i, (u, v) in enumerate(rng.normal(size=(1000, 2)))], "subject_id string, obs_idx long, a double, b double")
    _, s, a = ticc.seeds(ticc.packed(df, ("a", "b"), 64, 2), 2, 2, 2, 1, about=60)  # most of the 200 chunks draw no window
    assert 20 < len(s) < 120 and len(a) == len(s)
