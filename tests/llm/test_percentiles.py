import math
import random

import pytest
from pyspark.sql import functions as F

from strandweave.llm import percentiles as P

NAMES = ["p05", "p25", "p50", "p75", "p95", "p99"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def brute(v, p):
    v = sorted(v)
    return v[max(1, len(v) - math.floor(len(v) - len(v) * p)) - 1]


def test_codes_keep_order_and_value(spark):
    v = [-math.inf, -1e300, -2.5, -1e-310, -0.0, 0.0, 5e-324, 1.0, 1.5, 1e300]
    df = spark.createDataFrame([(x,) for x in v], "v double").select("v", P.order_code(F.col("v")).alias("c"))
    rows = [(r.v, r.c) for r in df.collect()]
    assert [c for _, c in rows] == sorted(c for _, c in rows) and rows[4][1] == rows[5][1]
    assert [r[0] for r in df.select(P.order_value(F.col("c"))).collect()] == [x + 0.0 for x in v]


@pytest.mark.parametrize("bits,digits", [(52, 16), (52, 11), (10, 11), (10, 5)])
def test_against_sorting(spark, bits, digits):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([rng.gauss(0, 50), float(rng.randrange(5)), -3.25, None, math.nan, math.inf]), "z") for _ in range(3000)] + [("c", None, "z"), ("d", 7.0, "z")]
    df = spark.createDataFrame(rows, "g string, v double, n string")
    state = P.digit_state(df, ["g"], "v", bits)
    got = {r.g: r for r in P.select_percentiles(state, ["g"], mantissa_bits=bits, digit_bits=digits).collect()}
    assert set(got) == {"a", "b", None, "d"}
    for g, r in got.items():
        v = [x for k, x, _ in rows if k == g and x is not None and math.isfinite(x)]
        assert r.n == len(v)
        for name, p in zip(NAMES, PROBS):
            want = brute(v, p)
            assert r[name] == pytest.approx(want, rel=0 if bits == 52 else 2.0**-11, abs=0 if bits == 52 else 1e-300)


def test_states_of_portions_join(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("day"), F.lit("x").alias("g"), F.sqrt("id").alias("v"))
    whole = P.select_percentiles(P.digit_state(df, ["g"], "v"), ["g"]).collect()
    parts = P.merged_states(P.digit_state(df, ["g", "day"], "v"), ["g"])
    assert P.select_percentiles(parts, ["g"]).collect() == whole
    none = P.digit_state(df.limit(0), ["g"], "v")
    assert P.select_percentiles(none, ["g"]).count() == 0
