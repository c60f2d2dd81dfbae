"""Indices of all partitions of a subject in one task, against the shuffled form for large subjects and brute force."""

import numpy as np
import pytest

from strandweave.operators import quality
from strandweave.plans import model_queries as M
from strandweave.sources import tables as S

D = "/root/testdata/sf0.001"


def test_pooled_observations_are_never_written(spark, monkeypatch):
    b = S.bad_labels(spark, D)
    want = {(r.subject_id, r.clustering_desc, r.measure): r for r in M.large_centroid_quality(M.complete(spark, D), b, ("l1", "linf_dot")).collect()}

    def fails(*_):
        raise AssertionError("a table is written")

    monkeypatch.setattr(M, "written", fails)
    monkeypatch.setattr(M, "scratch", fails)
    got = M.centroid_quality(spark, D, b, ("l1", "linf_dot")).collect()
    assert len(got) == sum(r.e is None or not r.e <= 1e-6 for r in want.values()) > 10
    for r in got:
        w = want[r.subject_id, r.clustering_desc, r.measure]
        for c in ("dbi", "vrc", "pbm"):
            assert (r[c] is None) == (w[c] is None) and (r[c] is None or r[c] == pytest.approx(w[c], abs=1e-4, rel=1e-4, nan_ok=True))


def test_large_subjects_go_by_shuffles(spark, monkeypatch):
    b = S.bad_labels(spark, D)
    rows = lambda: sorted(map(str, M.centroid_quality(spark, D, b, ("l1",)).collect()))
    want = rows()
    monkeypatch.setattr(M, "LARGE", 1500)
    assert rows() == want


def test_one_subject_with_overlaps_and_gaps():
    rng = np.random.default_rng(2)
    obs = {"obs_idx": rng.permutation(np.arange(0, 400, 2)), **{c: np.round(rng.normal(size=200), 1) for c in "abc"}}
    seg = {"partition": np.array(["p"] * 6 + ["q"], object), "cluster": np.array([1, 2, 1, 2, 3, 1, 1]), "start_idx": np.array([0, 100, 90, 200, np.nan, 401, 0.0]), "end_idx": np.array([99, 199, 120, 399, 5, 450, 399.0]),
           "vec": np.round(rng.uniform(-0.9, 0.9, (7, 3)), 3), "usable": np.array([True, True, True, True, True, False, True])}
    got = {x[0]: x for x in quality.subject_indices(obs, seg, ("a", "b", "c"), ("l1",))}
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    def centre(bounds):
        at = np.concatenate([np.flatnonzero((obs["obs_idx"] >= a) & (obs["obs_idx"] <= b)) for a, b in bounds])
        r = np.corrcoef([ranks(obs[c][at]) for c in "abc"])[np.triu_indices(3, 1)]
        return np.trunc(np.round(r, 9) * 1000 + np.sign(r) * 1e-6) / 1000

    cen, all_ = {1: centre([(0, 99), (90, 120), (401, 450)]), 2: centre([(100, 199), (200, 399)])}, centre([(0, 399)])
    own = [np.abs(seg["vec"][i] - cen[seg["cluster"][i]]).sum() for i in range(4)]  # the fifth has no observation, the sixth no vector
    apart = np.abs(cen[1] - cen[2]).sum()
    assert got["p"][2] == pytest.approx(((own[0] + own[2]) / 2 + (own[1] + own[3]) / 2) / apart)
    assert got["p"][3] == pytest.approx(sum(2 * np.abs(cen[c] - all_).sum() ** 2 for c in cen) * 2 / sum(x * x for x in own))
    assert got["p"][4] == pytest.approx((apart * sum(np.abs(seg["vec"][i] - all_).sum() for i in range(4)) / (4 * sum(own))) ** 2)
    assert got["q"][2] is None and got["q"][3] is None and got["q"][4] is None


@pytest.mark.parametrize("measure", ["l5", "l3_ref", "foerstner", "log_frobenius"])
def test_silhouettes_in_pieces(spark, measure):
    rng = np.random.default_rng(3)
    n = 90
    x, k, row = np.round(rng.uniform(-0.5, 0.5, (n, 3)), 3), rng.integers(0, 4, n), np.arange(n)
    row[50:52] = 50  # a name that comes twice, in one cluster
    k[51] = k[50]
    df = spark.createDataFrame([("g", int(r), int(c), v.tolist()) for r, c, v in zip(row, k, x)] + [("h", i, i, [0.1, 0.2, 0.3]) for i in range(3)], "g string, row int, c int, vec array<double>")
    d = quality.block_distances(x, x, measure)
    if measure == "foerstner":
        d = np.where(row[:, None] < row[None], d, d.T)
    s = []
    for r in np.unique(row):
        at, others = np.flatnonzero(row == r), row != r
        mean = {c: d[np.ix_(at, np.flatnonzero(others & (k == c)))].mean() for c in np.unique(k)}
        a = mean.pop(k[at[0]])
        s.append((min(mean.values()) - a) / max(min(mean.values()), a))
    for chunk in (7, 512):
        got = {r.g: r.swc for r in quality.silhouette_index(df, ["g"], "row", "c", "vec", measure, chunk=chunk).collect()}
        assert got["g"] == pytest.approx(np.mean(s), abs=2e-6) and got["h"] is None
