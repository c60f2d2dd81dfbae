"""The assessment of internal indices covers those of centroids."""

import numpy as np

from strandweave.plans import evaluation_queries as E
from strandweave.plans import model_queries as M

D = "/root/testdata/sf0.001"


def test_centroid_indices_are_correlated_with_jaccard(spark):
    got = {(r.subject_id, r["index"]): r.r for r in E.index_against_jaccard(spark, D).collect()}
    assert {"dbi", "vrc", "pbm", "swc", "mae", "n_outside"} == {i for _, i in got}
    x = M.summary(spark, D).select(*E.BY, "jaccard").join(M.centroid_indices_by_partition(spark, D), E.BY).toPandas()
    for s, g in x.groupby("subject_id"):
        for c in ("dbi", "vrc", "pbm"):
            h = g[[c, "jaccard"]].dropna()
            if len(h) > 2 and h.std(ddof=0).min() > 1e-6:
                assert abs(got[s, c] - np.corrcoef(h[c].astype(float), h["jaccard"])[0, 1]) < 1.1e-3
