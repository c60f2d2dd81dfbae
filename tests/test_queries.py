"""The registered queries against their SQL on the smallest tables, and the driver's contract."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandweave.plans import registry
from tools.compare import canonical

D = "/root/testdata/sf0.001"
NAMES = ["labels_parsed", "first_partitions", "recalculated_labels", "cluster_centroids", "overlap_argmax", "sparsified_p30", "shifted_boundaries", "partition_agreement", "silhouette_by_partition",
         "centroid_indices_by_partition", "level_sets", "nearest_pattern_scores", "cluster_mapping", "pattern_discovery", "streamed_hourly_mean", "p2_found", "p2_minute_grid"]


@pytest.fixture(scope="module")
def con():
    from pathlib import Path
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for p in Path(D).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    a, b = canonical(registry.QUERIES[name](spark, D).toPandas()), canonical(con.sql(registry.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_contract(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
