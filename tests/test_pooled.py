"""Centroids of degraded partitions against pooled observations, by brute force."""

import numpy as np
import pandas as pd

from strandweave.plans import model_queries as M
from strandweave.sources import tables as S

D = "/root/testdata/sf0.001"


def _spearman(x: pd.DataFrame) -> np.ndarray:
    r = x.rank().corr().to_numpy()[np.triu_indices(3, 1)]
    return np.where(np.isnan(r), r, np.trunc(np.round(r, 9) * 1000 + np.sign(r) * 1e-6) / 1000)


def test_partition_indices_take_pooled_centroids(spark):
    o = S.observations(spark, D, S.VARIATES).toPandas()
    b = M._bad_rows(spark, D).toPandas()
    got = M.centroid_indices_by_partition(spark, D).toPandas().set_index(["subject_id", "clustering_desc"])
    every = S.bad_labels(spark, D).where("cluster_id is not null").toPandas()
    checked = 0
    for key, g in b.groupby(["subject_id", "clustering_desc"]):
        own = o[o.subject_id == key[0]]
        cut = lambda rows: pd.concat([own[own.obs_idx.between(r.start_idx, r.end_idx)] for r in rows.itertuples()])[["iob", "cob", "ig"]]  # noqa: B023, E731
        e = every[(every.subject_id == key[0]) & (every.clustering_desc == key[1])].dropna(subset=["start_idx", "end_idx"])
        if key not in got.index:
            continue
        cen = {c: _spearman(cut(e[e.cluster_id == c])) for c in g.cluster_id.unique()}
        if len(cen) < 2 or any(np.isnan(v).any() for v in cen.values()):
            continue
        sigma = {c: np.mean([np.abs(np.array(v) - cen[c]).sum() for v in x.achieved]) for c, x in g.groupby("cluster_id")}
        dbi = np.mean([max((sigma[c] + sigma[k]) / max(np.abs(cen[c] - cen[k]).sum(), 1e-15) for k in cen if k != c) for c in cen])
        assert abs(got.loc[key, "dbi"] - dbi) <= 1e-4
        all_ = _spearman(own[["iob", "cob", "ig"]])  # the whole is all of the subject's data
        n, k = len(g), len(cen)
        between = sum((g.cluster_id == c).sum() * np.abs(cen[c] - all_).sum() ** 2 for c in cen)
        within = sum(np.abs(np.array(r.achieved) - cen[r.cluster_id]).sum() ** 2 for r in g.itertuples())
        if n > k:
            assert abs(got.loc[key, "vrc"] - between * (n - k) / (within * (k - 1))) <= 1e-3 * max(1, got.loc[key, "vrc"])
        checked += 1
    assert checked > 3
