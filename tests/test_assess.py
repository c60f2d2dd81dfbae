"""Statistics, assessment, distributions, names and generation against known values and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.functions import names as N
from strandweave.functions import numeric
from strandweave.operators import assess, distributions, generate, segments, ticc
from strandweave.plans import run_queries


def test_sample_sizes():
    assert numeric.n_for_correlation(0.05, 0.8, 0.5) == pytest.approx(3 + ((1.959964 + 0.841621) / math.atanh(0.5)) ** 2, abs=1e-4)
    assert numeric.n_for_correlation(0.05, 0.2, 0.5) < numeric.n_for_correlation(0.05, 0.8, 0.5) < numeric.n_for_correlation(0.05, 0.8, 0.5, c2=1.06)
    n = numeric.n_for_correlation(0.05, 0.8, 0.4, 0.1, two_tailed=False)
    assert numeric.alpha_for_correlation(n, 0.8, 0.4, 0.1) == pytest.approx(0.05)
    assert numeric.n_for_z_power(0.5) == pytest.approx(62.72) and numeric.z_power(0.5, 62.72) == pytest.approx(0.8, abs=1e-3)
    assert numeric.p_from_interval(1.0, 1.96) == pytest.approx(0.0496, abs=1e-3) and numeric.p_from_interval(1.0, -1.0) > 1
    assert numeric.combinations_of_two(6) == 15
    m, lo, hi = numeric.mean_interval(np.array([1.0, 2, 3, 4, 5]))
    assert (m, round(lo, 4), round(hi, 4)) == (3.0, 1.0368, 4.9632)
    assert numeric.n_for_power(0.5) == 34


def test_normal_table():
    x = np.linspace(-7, 7, 501) + 0.00037
    assert max(abs(numeric.normal_cdf(x) - [numeric.PHI.cdf(v) for v in x])) < 1e-12


def test_signed_rank_forms_agree():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=50).round(2), rng.normal(0.3, 1, 50).round(2)
    exact = numeric.signed_rank(x, y)
    old, numeric.EXACT = numeric.EXACT, 10
    try:
        near = numeric.signed_rank(x, y)
    finally:
        numeric.EXACT = old
    assert exact[0] == near[0] and exact[1] == pytest.approx(near[1], abs=0.01)


def test_p_in_columns(spark):
    rows = [(t, n) for t in (0.0, 0.5, -2.2, 7.0) for n in (1, 2, 3, 8, 29, 64)]
    df = spark.createDataFrame(rows, "t double, n long").withColumn("p", C.t_two_sided(F.col("t"), F.col("n")))
    assert all(r.p == pytest.approx(numeric.t_two_sided(r.t, r.n), abs=1e-12) for r in df.collect())


def test_segment_lengths():
    for n, long in ((6, 2), (8, 2), (14, 4), (100, 25)):
        x = generate.segment_lengths(n, np.random.default_rng(0), unit=1)
        assert len(x) == n and sum(v in generate.LONG for v in x) == long


def test_cholesky_generation():
    rng = np.random.default_rng(3)
    x = generate.cholesky_correlated(rng.normal(size=(40_000, 3)), np.array([0.7, 0.2, -0.3]))
    assert np.corrcoef(x.T)[np.triu_indices(3, 1)] == pytest.approx([0.7, 0.2, -0.3], abs=0.03)
    assert np.isfinite(generate.cholesky_correlated(rng.normal(size=(100, 3)), np.array([1.0, 1.0, 1.0]))).all()


def test_relaxed_and_names(spark):
    v = {tuple(r.v): r.x for r in spark.createDataFrame([([1.0, -1.0, 0.0],), ([0.0, 1.0, 1.0],), ([1.0, 1.0, 1.0],), ([-1.0, 0.0, 0.0],)], "v array<double>").withColumn("x", C.relaxed(F.col("v"))).collect()}
    assert v == {(1, -1, 0): [0.71, -0.70, 0.0], (0, 1, 1): [0.0, 0.71, 0.70], (1, 1, 1): None, (-1, 0, 0): None}
    df = spark.createDataFrame([("resampled_1min", "p30"), ("raw", ""), ("odd", "")], "s string, e string")
    got = [tuple(r) for r in df.select(N.stage_key(F.col("s")), N.stage_display(F.col("s")), N.variation_name(F.col("s"), F.col("e")), N.rule_of(F.col("s"))).collect()]
    assert got == [("RS", "Downsampled", "RS p30 1min", "1min"), ("RAW", "Raw", "RAW", "raw"), ("odd", "odd", "odd", "odd")]
    one = spark.range(1).select(N.irregular_extension(F.lit("a/irregular_p30")), N.distribution_name(F.lit("<scipy.stats._continuous_distns.genextreme_gen object>")), N.frequency_code(F.lit(90)), N.custom_order(F.lit("b"), ["a", "b"]), N.custom_order(F.lit("z"), ["a"])).first()
    assert tuple(one) == ("p30", "genextreme", "1min", 2, None)
    assert N.shown_measure("PMB") == "PBM" and N.compared("l1", "l2") == "l1 vs l2" and N.file_safe("A (b) c") == "a-b-c"


def test_stepwise_stops_at_a_worse_group(spark):
    rng = np.random.default_rng(5)
    base = {"a": 0.0, "b": 0.0, "c": -1.0, "d": -2.0}
    rows = [(f"r{i}", m, "swc", float(v + 0.01 * rng.normal())) for i in range(20) for m, v in base.items()] + [(f"r{i}", m, "dbi", float(-v + 0.01 * rng.normal())) for i in range(20) for m, v in base.items()]
    t = assess.stepwise_signed_ranks(assess.ranked_by_index(spark.createDataFrame(rows, "run string, measure string, index string, value double"), "run"), "run").collect()
    for index in ("swc", "dbi"):
        own = [r for r in t if r["index"] == index]
        assert {r.grp for r in own} <= {1, 2, 3} and all(r.effect > 0 for r in own if {r.a, r.b} & {"c", "d"})
        last = max(r.grp for r in own)
        assert all(r.significant for r in own if r.grp == last) and not any(r.b == "d" for r in own)


def test_greedy_matching(spark):
    rows = [("m", 1, 7, 10), ("m", 1, 8, 9), ("m", 2, 7, 8), ("m", 2, 8, 1), ("m", 3, 9, 4)]
    r = assess.greedy_matching(spark.createDataFrame(rows, "measure string, cluster_id int, predicted int, n long"), ["measure"]).first()
    assert r.matches == 3 and r.f1 == pytest.approx((2 * 10 / (19 + 18) + 2 * 1 / (9 + 10) + 1) / 3, abs=1e-6)


def test_distributions_recover_parameters(spark):
    rng = np.random.default_rng(7)
    data = {"n": rng.normal(5, 2, 20_000), "e": 1 + rng.exponential(3, 20_000), "g": 2 - 1.5 * np.log(-np.log(rng.random(20_000))), "x": generate.gev_quantile(rng.random(20_000), 0.25, 10, 2)}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("one", 1.0), ("one", 1.0)], "k string, v double")
    fits = distributions.fitted(df, ["k"], "v")
    best = {r.k: r for r in distributions.best(fits, ["k"]).collect()}
    assert set(best) == {"n", "e", "g", "x"} and best["e"].family == "expon" and best["x"].family == "genextreme"
    by = {(r.k, r.family): r for r in fits.collect()}
    assert (by["n", "norm"]["loc"], by["n", "norm"].scale) == pytest.approx((5, 2), abs=0.06) and by["n", "norm"].nll < by["n", "gumbel_r"].nll
    assert (by["g", "gumbel_r"]["loc"], by["g", "gumbel_r"].scale) == pytest.approx((2, 1.5), abs=0.06)
    assert (best["x"].shape, best["x"]["loc"], best["x"].scale) == pytest.approx((0.25, 10, 2), abs=0.07)
    q = [r for r in distributions.quantile_pairs(df, distributions.best(fits, ["k"]), ["k"], "v").collect() if r.k == "x"]
    assert len(q) == 99 and max(abs(r.data - r.fit) for r in q) < 0.3
    b = {r.k: r for r in distributions.density_bounds(df, ["k"], "v").collect()}
    assert b["n"].top == pytest.approx(0.2, abs=0.03) and b["n"].lo < 0.5 < 9 < b["n"].hi


def test_degraded_counts(spark):
    lab = spark.createDataFrame([("s", i, 200 * i, 200 * i + 199, i % 3, 200) for i in range(30)] + [("t", 0, 0, 9, 1, 10)], "subject_id string, segment_id int, start_idx int, end_idx int, cluster_id int, length int")
    x = segments.degraded(lab).cache()
    n = {r.subject_id: r.n for r in x.groupBy("subject_id").agg(F.count_distinct("clustering_desc").alias("n")).collect()}
    assert n["s"] == 66 and n["t"] >= 3
    truth = lab.select("subject_id", "segment_id", F.col("cluster_id").alias("c"), F.col("end_idx").alias("e"))
    per = x.where("subject_id = 's'").join(truth, ["subject_id", "segment_id"]).groupBy("clustering_desc").agg(F.count_if(F.col("cluster_id") != F.col("c")).alias("wrong"), F.max(F.col("end_idx") - F.col("e")).alias("moved"), F.sum("length").alias("all")).collect()
    wrong = sorted((int(r.clustering_desc.rsplit("-", 1)[1]), r.wrong) for r in per if r.clustering_desc.startswith("wrong"))
    assert [w for _, w in wrong] == sorted({w for _, w in wrong}) and wrong[-1][1] == 30
    assert all(r.all == 6000 for r in per) and max(r.moved for r in per if r.clustering_desc.startswith("shifted-end")) == 100
    assert segments.degraded(lab.limit(0)).count() == 0


def test_clusterer_labels_and_evaluation(spark):
    rng = np.random.default_rng(1)
    idx = np.arange(400)
    a = (idx // 100) % 2
    base = rng.normal(size=400)
    rows = [("s", int(i), float(base[i]), float(base[i] * (1 if a[i] else -1) + 0.05 * rng.normal()), float(rng.normal())) for i in idx]
    obs = spark.createDataFrame(rows, "subject_id string, obs_idx long, iob double, cob double, ig double")
    lab = run_queries.clusterer_labels(spark.createDataFrame([("s", int(i), int(a[i]) + 5) for i in idx], "subject_id string, obs_idx long, cluster int"), obs)
    got = [(r.cluster_id, r.start_idx, r.end_idx, r.length, round(r.achieved[0])) for r in lab.orderBy("segment_id").collect()]
    assert got == [(5, 0, 99, 100, -1), (6, 100, 199, 100, 1), (5, 200, 299, 100, -1), (6, 300, 399, 100, 1)]
    truth = spark.createDataFrame([("s", 0, 0, 99, 1, 100), ("s", 1, 100, 199, 2, 100), ("s", 2, 200, 299, 1, 100), ("s", 3, 300, 399, 2, 100)], "subject_id string, segment_id int, start_idx int, end_idx int, cluster_id int, length int")
    means = spark.createDataFrame([("s", 1, [-1.0, 0.0, 0.0]), ("s", 2, [1.0, 0.0, 0.0])], "subject_id string, pattern_id int, gt_vec array<double>")
    pats = spark.createDataFrame([(1, [-0.98, 0.0, 0.0]), (2, [0.98, 0.0, 0.0])], "pattern_id int, relaxed array<double>")
    r = run_queries.evaluated(lab, truth, means, pats).first()
    assert (r.discovered, r.specific, r.jaccard, r.count_ratio) == (100.0, 100.0, 1.0, 1.0) and r.swc > 0.8 and r.mean_mae < 0.2


def test_temporal_centralities(spark):
    e = spark.createDataFrame([(0, 0, 1, 0, 1.0), (0, 1, 0, 0, 1.0), (1, 0, 1, 0, 1.0), (1, 1, 0, 0, 1.0), (1, 1, 2, 0, 1.0), (1, 2, 1, 0, 1.0)], "cluster int, i int, j int, lag int, v double")
    r = {(x.step, x.node): x for x in ticc.temporal_centralities(e).collect()}
    assert r[0, 2].degree == 0 and r[1, 1].betweenness == 1 and r[None, 1].degree == 1.5 and r[None, 1].betweenness == 0.5


def test_blocks_and_shapes():
    m = np.arange(36).reshape(6, 6)
    assert [b.tolist() for b in numeric.lower_block_diagonal(m, 3, 1)] == [m[2:4, 0:2].tolist(), m[4:6, 2:4].tolist()]
    for bad in ((m[:5], 3, 0), (m, 4, 0), (m, 3, 3)):
        with pytest.raises(ValueError):
            numeric.lower_block_diagonal(*bad)
    assert numeric.same_matrices([[1.000000001]], [[1.0]]) and not numeric.same_matrices([[1.1]], [[1.0]])
    a, b = numeric.upper_halves(np.array([[1, 0.5], [0.5, 1]]), np.eye(2))
    assert a.tolist() == [0.5] and b.tolist() == [0.0]
    with pytest.raises(ValueError):
        numeric.upper_halves(np.eye(2), np.eye(3))


def test_exact_percentiles_and_ranks_in_pieces(spark):
    from strandweave.operators.correlation import average_ranks, ranked
    from strandweave.operators.describe import describe, exact_percentiles
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-6, 6, 300), np.zeros(20), np.repeat(3.25, 30), [5e-324, -5e-324, 1e300, -1e300]])
    df = spark.createDataFrame([("a" if i % 3 else None, float(x)) for i, x in enumerate(v)] + [("one", 2.0), ("none", None)], "k string, v double")
    got = {r.k: r.q for r in exact_percentiles(df, ["k"], "v", (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    for k in ("a", None):
        own = np.array([x for i, x in enumerate(v) if (i % 3 > 0) == (k == "a")])
        assert got[k] == pytest.approx(np.percentile(own, [0, 25, 50, 90, 100]).tolist(), rel=1e-12)
    assert got["one"] == [2.0] * 5 and "none" not in got
    one, two = (sorted(map(str, describe(df.where("abs(v) < 1e3 or v is null"), ["k"], "v", large=large).collect())) for large in (False, True))
    assert one == two
    some = df.where("k = 'a'")
    assert sorted(r.v for r in average_ranks(some, ["k"], ("v",)).collect()) == sorted(r.v for r in ranked(some, ["k"], ("v",)).collect())


def test_runs_over_chunks(spark):
    rng = np.random.default_rng(12)
    rows = [("a" if i % 5 else "b", i, [None, "x", "x", "y"][rng.integers(4)]) for i in range(300)] + [("c", 500, None), ("c", 501, None)]
    df = spark.createDataFrame(rows, "k string, i long, v string")
    whole = sorted(map(str, segments.runs_to_segments(df, ["k"], ["i"], "v", "i").collect()))
    for size in (1, 7, 64):
        assert sorted(map(str, segments.runs_to_segments(df, ["k"], ["i"], "v", "i", F.floor(F.col("i") / size)).collect())) == whole
    n = {(r.k, r.i): r.n for r in segments.numbered(df, ["k"], F.floor(F.col("i") / 9), ["i"], "n").collect()}
    for k in "abc":
        assert [n[x, i] for x, i in sorted(n) if x == k] == list(range(sum(x == k for x, _ in n)))
