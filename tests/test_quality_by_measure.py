"""Indices by every measure that SQL can express, on inputs where some are easily left out."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

from strandweave.operators import quality
from strandweave.operators.measures import MEASURES, RANKED
from strandweave.plans import registry
from strandweave.sources import tables as S
from tools.compare import canonical

NAME = "quality_by_measure"


def sql(d):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in Path(d).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con.sql(registry.ORACLES[NAME]).df()


def spearman(x):
    r = np.argsort(np.argsort(x, axis=0), axis=0)
    return quality.cut3(np.corrcoef(r.T)[np.triu_indices(3, 1)])


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Four segments that lie at the centroids of their four clusters; a partition in two clusters, one of its vectors null."""
    d = str(tmp_path_factory.mktemp("quality"))
    x = np.random.default_rng(3).normal(size=(40, 3))
    spark.createDataFrame([("s", i, "2020-01-01T00:00:00Z", *map(float, v), None) for i, v in enumerate(x)], S.OBSERVATIONS).write.parquet(f"{d}/observations.parquet")
    text = lambda v: str([float(z) for z in v])
    row = lambda i, c, v: (i, 10 * i, 10 * i + 9, 10, c, text(v), text(v), "[True, True, True]", 0.1, 0.1)
    own = [spearman(x[10 * i : 10 * i + 10]) for i in range(4)]
    spark.createDataFrame([("s", *row(i, i, v)) for i, v in enumerate(own)], S.LABELS).write.parquet(f"{d}/segment_labels.parquet")
    spark.createDataFrame([("s", "bad", *row(i, i // 2, v if i else np.zeros(3))) for i, v in enumerate(own)], S.BAD_LABELS).write.parquet(f"{d}/bad_labels.parquet")
    return d


def test_no_measure_and_no_index_is_left_out(spark, data):
    got = registry.QUERIES[NAME](spark, data).toPandas()
    assert {p: set(x) for p, x in got.groupby("clustering_desc")["measure"]} == {p: set(MEASURES) for p in ("truth", "bad")}
    a, b = canonical(got), canonical(sql(data))
    assert list(a.columns) == list(b.columns) and a.equals(b)
    truth = got[(got.clustering_desc == "truth") & (got.measure != "cosine")]
    assert (truth["dbi"] == 0).all() and truth[["swc", "vrc", "pbm"]].isna().all().all()
    assert got[(got.clustering_desc == "bad") & (got.measure == "cosine")]["swc"].notna().all()


def test_query_equals_sql_by_all_measures(spark):
    d = "/root/testdata/sf0.001"
    a, b = canonical(registry.QUERIES[NAME](spark, d).toPandas()), canonical(sql(d))
    assert set(a["measure"]) == set(MEASURES) and a.equals(b)


@pytest.mark.parametrize("twice", [False, True])
def test_silhouettes_of_all_measures_are_those_of_pairs(twice):
    rng = np.random.default_rng(4)
    x, own = np.round(rng.uniform(-0.5, 0.5, (30, 3)), 3), rng.integers(0, 4, 30)
    rows = np.sort(rng.integers(0, 12, 30)) if twice else np.arange(30)
    own = own[rows] if twice else own
    got = dict(quality.silhouette_values(rows, own, x, 0, 30, RANKED))
    stacked = {m: s[0] for m, s, _ in quality.stacked_silhouettes(np.unique(own, return_inverse=True)[1][None], x[None], MEASURES)}
    for m in RANKED:
        d = quality.block_distances(x, x, m)
        if m in quality.ONE_WAY:
            d = np.where(np.arange(30)[:, None] < np.arange(30), d, d.T)
        want = []
        for r in np.unique(rows):
            here = rows == r
            mean = {c: d[np.ix_(here, (own == c) & ~here)] for c in np.unique(own)}
            mean = {c: v.mean() for c, v in mean.items() if v.size}
            c = own[here][0]
            b = min(v for k, v in mean.items() if k != c)
            want.append((b - mean[c]) / max(mean[c], b) if c in mean else 0.0)
        np.testing.assert_allclose(got[m], want, atol=1e-9)
        if not twice and m in MEASURES:
            np.testing.assert_allclose(stacked[m], want, atol=1e-9)


def test_a_row_with_an_undefined_distance_has_no_silhouette():
    x, own = np.random.default_rng(5).uniform(-0.5, 0.5, (8, 3)), np.arange(8) % 2
    x[3] = np.nan
    for m, s in quality.silhouette_values(np.arange(8), own, x, 0, 8, ("l1", "log_frobenius")):
        assert np.isnan(s).all(), m  # each row has a distance to the fourth
