"""The ranking covers all measures and criteria of the reference."""

import numpy as np
import pytest

from strandweave.functions import numeric
from strandweave.operators import measures
from strandweave.plans import model_queries as M
from strandweave.sources import tables as S

D = "/root/testdata/sf0.001"


def test_criteria_cover_matrix_measures_and_levels(spark):
    c = {(r.measure, r.criterion): r.value for r in M.measure_criteria(spark, D).collect()}
    assert {"l3_ref", "log_frobenius", "foerstner"} <= {m for m, _ in c}
    s = {}
    for r in M.level_intervals(spark, D).collect():
        s.setdefault(r.measure, []).append(r.relation == "lower")
    assert {m: c[m, "all_lower"] for m in s} == {m: float(all(v)) for m, v in s.items()}
    assert not measures.LOW_IS_GOOD["all_lower"]


def test_matrix_measures_against_patterns(spark):
    labels, pats = S.labels(spark, D), S.patterns_to_model(spark, D)
    pat = {r.pattern_id: r.relaxed for r in pats.collect()}
    one = labels.limit(1).collect()[0]
    got = measures.pattern_distances(labels.where(labels.subject_id == one.subject_id).where(labels.segment_id == one.segment_id), pats, ("log_frobenius", "foerstner")).collect()
    assert len(got) == 2 * len(pat)
    for r in got:
        want = getattr(numeric, r.measure)(np.array(one.achieved), np.array(pat[r.pattern_id]))
        assert (np.isnan(want) and np.isnan(r.d)) or r.d == pytest.approx(want, abs=1e-5)
