"""Distances of blocks against single pairs, and the indices by matrix measures against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.functions import numeric
from strandweave.operators import measures, quality


def test_blocks_equal_columns(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(-0.5, 0.5, (6, 3)), rng.uniform(-0.5, 0.5, (4, 3))
    df = spark.createDataFrame([(i, j, x.tolist(), y.tolist()) for i, x in enumerate(a) for j, y in enumerate(b)], "i int, j int, a array<double>, b array<double>")
    for m in measures.RANKED:
        d = quality.block_distances(a, b, m)
        for r in df.withColumn("d", C.distance(m)(F.col("a"), F.col("b"))).collect():
            assert r.d == pytest.approx(d[r.i, r.j], rel=1e-9), m
    assert quality.block_distances(a, b, "foerstner")[1, 2] == pytest.approx(numeric.foerstner(a[1], b[2]))
    assert np.isnan(quality.block_distances(np.zeros((1, 3)), b, "cosine")).all()
    with pytest.raises(ValueError):
        quality.block_distances(a, b, "l1_odd")
    with pytest.raises(ValueError):
        C.distance("l1_odd")


@pytest.mark.parametrize("measure", ["log_frobenius", "foerstner"])
def test_matrix_measures_in_indices(spark, measure):
    rng = np.random.default_rng(1)
    x, k = np.round(rng.uniform(-0.5, 0.5, (14, 3)), 3), np.arange(14) % 3
    df = spark.createDataFrame([("g", i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, k))], "g string, row int, c int, vec array<double>")
    d = np.array([[getattr(numeric, measure)(x[min(i, j)], x[max(i, j)]) if i != j else 0.0 for j in range(14)] for i in range(14)])  # the earlier row first
    s = []
    for i in range(14):
        own = [d[i, j] for j in range(14) if j != i and k[j] == k[i]]
        far = min(np.mean([d[i, j] for j in range(14) if k[j] == c]) for c in range(3) if c != k[i])
        s.append((far - np.mean(own)) / max(far, np.mean(own)))
    assert quality.silhouette_index(df, ["g"], "row", "c", "vec", measure, chunk=5).first().swc == pytest.approx(np.mean(s), abs=2e-6)
    cen = {c: x[k == c].mean(0) for c in range(3)}
    all_ = x.mean(0)
    f = getattr(numeric, measure)
    own = np.array([f(v, cen[c]) for v, c in zip(x, k)])
    sig = {c: own[k == c].mean() for c in range(3)}
    dbi = np.mean([max((sig[a] + sig[b]) / f(cen[a], cen[b]) for b in range(3) if b != a) for a in range(3)])
    vrc = sum((k == c).sum() * f(cen[c], all_) ** 2 for c in range(3)) * (14 - 3) / ((own**2).sum() * 2)
    pbm = (max(f(cen[a], cen[b]) for a in range(3) for b in range(3) if a != b) * sum(f(v, all_) for v in x) / (14 * own.sum())) ** 2
    centroids = spark.createDataFrame([("g", c, v.tolist()) for c, v in cen.items()], "g string, c int, centroid array<double>")
    got = quality.centroid_indices(df.select("g", "c", "vec"), centroids, spark.createDataFrame([("g", all_.tolist())], "g string, overall array<double>"), ["g"], "c", measure).first()
    # distances are not symmetric where the measure is not
    assert got.vrc == pytest.approx(vrc, rel=1e-6) and got.pbm == pytest.approx(pbm, rel=1e-6) and got.dbi == pytest.approx(dbi, rel=1e-6)
