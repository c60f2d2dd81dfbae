"""Level statistics come from counted values: distances are never shuffled as rows."""

import pytest

from strandweave.operators import measures
from strandweave.operators.describe import describe


def test_counted_description_equals_description(spark):
    rows = [("m", 0, float(v)) for v in (0.1, 0.1, 0.3, 0.7, "nan", 0.2)] + [("m", 1, 0.5), ("m", 2, float("nan")), ("k", 0, 0.25), ("k", 0, 0.75), ("k", 0, None)]
    df = spark.createDataFrame(rows, "measure string, level int, d double")
    got, want = (sorted(map(tuple, x.collect())) for x in (measures.level_statistics(df, ["measure"]), describe(df, ["measure", "level"], "d", 3)))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(a == pytest.approx(b, abs=1e-12) if b is not None else a is None for g, w in zip(got, want) for a, b in zip(g[3:], w[3:]))


def test_distances_are_counted_before_any_exchange(spark):
    df = spark.range(1000).selectExpr("concat('m', id % 2) AS measure", "int(id % 3) AS level", "double(id % 50) AS d")
    plan = measures.level_statistics(measures.normalised(df, ["measure"], few=True), ["measure"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "percentile" not in plan and "BroadcastHashJoin" in plan
