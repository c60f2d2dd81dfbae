"""Queries keep every reading that they use, whatever else the row lacks."""

import pytest
from pyspark.sql import functions as F

from strandweave.plans import registry

ROWS = [("s", 0, "2024-01-01T00:00:00Z", 1.0, 1.0, 5.0), ("s", 1, "2024-01-01T00:00:20Z", None, 1.0, 7.0), ("s", 2, "2024-01-01T00:00:40Z", 1.0, float("nan"), 9.0),
        ("s", 3, "2024-01-01T00:01:00Z", 3.0, 1.0, None), ("s", 4, "2024-01-01T00:01:20Z", 1.0, 1.0, 11.0)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("t"))
    spark.createDataFrame(ROWS, "subject_id string, obs_idx long, datetime string, iob double, cob double, ig double").write.parquet(f"{d}/observations.parquet")
    return d


def test_readings_of_ig_alone(spark, folder):
    run = lambda name: registry.QUERIES[name](spark, folder)
    assert [(r.n, r.ig) for r in run("calendar_means").collect()] == [(4, 8.0)]
    for name in ("hourly_aggregates", "quarter_hour_aggregates"):
        assert [(r.n, r["mean"]) for r in run(name).collect()] == [(4, 8.0)]
    assert [r.n for r in run("streamed_hourly_mean").collect()] == [4]
    assert run("entropy_of_scaled").select(F.round("entropy", 3)).first()[0] == 2.0


def test_times_and_minutes_of_all_rows(spark, folder):
    g = registry.QUERIES["time_gap_stats"](spark, folder).first()
    assert (g["count"], g["max"]) == (4, 20.0)
    assert sum(r.n for r in registry.QUERIES["gap_histogram"](spark, folder).collect()) == 4
    m = {r.bucket % 120: (r.n, r.ig, r.iob) for r in registry.QUERIES["tumbling_minute_mean"](spark, folder).collect()}
    assert m == {0: (3, 7.0, 1.0), 60: (2, 11.0, 2.0)}
