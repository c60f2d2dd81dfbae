import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.functions import matrices, numeric

A, B = "array(1.0D, 0.0D, 0.0D)", "array(0.0D, 1.0D, 0.0D)"
GOLDEN = {"l1": 2, "l2": 1.414, "l5": 1.149, "l10": 1.072, "l50": 1.014, "l100": 1.007, "linf": 1,
          "l1_ref": 6.309, "l2_ref": 2.6, "l5_ref": 1.554, "l10_ref": 1.329, "l50_ref": 1.187, "l100_ref": 1.171, "linf_ref": 1.155, "cosine": 0}


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_distances_of_unit_vectors(spark):
    cols = [F.bround(C.distance(n)(F.expr(A), F.expr(B)), 3).alias(n) for n in GOLDEN]
    assert spark.range(1).select(*cols).first().asDict() == pytest.approx(GOLDEN)
    with pytest.raises(ValueError):
        C.distance("l7")


def test_matrix_distances():
    a, b = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    assert round(numeric.foerstner(a, b), 3) == 23.036
    assert round(numeric.log_frobenius(a, b), 3) == 28.495
    assert numeric.is_psd(np.array([0.7, 0.7, 0.9])) and not numeric.is_psd(np.array([-1, -1, -1.0]))


def test_matrix_udfs_take_nulls(spark):
    df = spark.createDataFrame([([1.0, 0.0, 0.0], [0.0, 1.0, 0.0]), (None, [0.0, 1.0, 0.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(matrices.foerstner("a", "b")).collect()]
    assert round(got[0], 3) == 23.036 and got[1] is None


def test_zero_vectors_and_large_powers(spark):
    z = F.expr("array(0.0D, 0.0D, 0.0D)")
    assert one(spark, C.lp(z, z, 100)) == 0
    assert math.isnan(one(spark, C.cosine(z, F.expr(A))))
    assert one(spark, C.lp(F.expr("array(1e-5D, 0D)"), F.expr("array(0D, 0D)"), 100)) == pytest.approx(1e-5)


def test_truncation_and_rounding(spark):
    got = spark.sql("select -0.1089D a, 0.9996D b, -0.1D c, double('nan') d").select(*[C.trunc3(F.col(c)).alias(c) for c in "abcd"]).first()
    assert (got.a, got.b, got.c) == (-0.108, 0.999, -0.1) and math.isnan(got.d)
    assert one(spark, C.mean_abs_error(F.expr("array(0.0025D)"), F.expr("array(0.0D)"))) == 0.002


def test_parsing(spark):
    df = spark.createDataFrame([("[0.1, -1.0, 2]", "[True, False]"), ("(1, 0, x)", ""), (None, None), ("[]", "[True]")], "v string, f string")
    got = [(r[0], r[1]) for r in df.select(C.vector("v"), C.flags("f")).collect()]
    assert got == [([0.1, -1.0, 2.0], [True, False]), ([1.0, 0.0, None], None), (None, None), (None, [True])]


def test_tolerance(spark):
    got = one(spark, C.within_strength(F.expr("array(1.0D, 0.0D, 0.5D, -1.0D)"), F.expr("array(0.7D, 0.21D, 0.5D, 0.9D)")))
    assert got == [True, False, False, True]
    a, b = F.expr("array(0.5D)"), F.expr("array(-0.5D)")
    assert one(spark, C.close_to(a, b, 0.0)) and not one(spark, C.close_to(a, b, 0.0, lenient=False))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1, 1), min_size=3, max_size=3), st.lists(st.floats(-1, 1), min_size=3, max_size=3))
def test_matrix_of_is_symmetric(a, b):
    m = numeric.matrix_of(np.array(a))
    assert (m == m.T).all() and (np.diag(m) == 1).all() and (m[np.triu_indices(3, 1)] == a).all()
    d = numeric.log_frobenius(np.array(a), np.array(b))
    assert d >= 0 and d == pytest.approx(numeric.log_frobenius(np.array(b), np.array(a)))
