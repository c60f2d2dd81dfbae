from strandweave.operators.gridding import regular_grid, slots_without_value

T = "2020-01-01T00:0{}:{:02d}Z"
SCHEMA = "subject_id string, obs_idx long, datetime string, iob double, cob double, ig double, v0 string"


def grid(spark, rows, **k):
    return {(r.variate, r.slot): (r.value, r.status, r.n_readings) for r in regular_grid(spark.createDataFrame(rows, SCHEMA), **k).collect()}


def test_gap_is_filled_or_marked(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", 0, T.format(0, 30), 1.0, nan, 5.0, "x"), ("a", 0, "2020-01-01 02:00:30+02:00", 1.0, nan, 5.0, "x"), ("a", 1, T.format(0, 30), 3.0, inf, 5.0, None), ("a", 2, T.format(2, 30), 6.0, None, 7.0, None),
            ("a", 3, "NaT", 9.0, 9.0, 9.0, None), ("a", 4, None, 9.0, 9.0, 9.0, None), (None, 5, T.format(1, 0), 9.0, 9.0, 9.0, None), ("a", None, T.format(4, 0), None, None, 1.0, None)]
    g = grid(spark, rows, max_gap_s=120)
    day = 1577836800
    assert g["iob", day] == (2.0, "observed", 2)
    assert g["iob", day + 60][1] == "filled" and 3.0 <= g["iob", day + 60][0] <= 5.0
    assert g["cob", day + 60] == (None, "missing", 0)
    assert g["iob", day + 180] == (None, "missing", 0)
    assert g["ig", day + 180][1] == "filled" and abs(g["ig", day + 180][0] - (7 - 6 * 60 / 90)) < 1e-9
    assert len(g) == 15
    assert len(grid(spark, rows, max_gap_s=0)) == 15


def test_neighbours_over_midnight(spark):
    rows = [("a", 0, "2020-01-01T23:58:30Z", 1.0, None, 1.0, None), ("a", 1, "2020-01-02T00:01:30Z", 4.0, None, None, None), ("a", 2, "2020-01-02T00:00:10Z", None, None, 1.0, None), ("a", 3, "2020-01-01T23:59:10Z", None, None, 1.0, None)]
    g = grid(spark, rows)
    filled = sorted(v for (k, _), (v, s, _) in g.items() if k == "iob" and s == "filled")
    assert [round(x, 6) for x in filled] == [2.0, 3.0]
    assert {s for (k, _), (_, s, _) in g.items() if k == "cob"} == {"missing"}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert regular_grid(df).count() == 0 and slots_without_value(regular_grid(df)).columns == ["subject_id", "variate", "slot"]
