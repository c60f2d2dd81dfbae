from itertools import product

import numpy as np
import pytest

from strandweave.functions import numeric as N
from strandweave.operators.correlation import tau_b


def test_t_distribution():
    assert N.t_cdf(2.262157, 9) == pytest.approx(0.975, abs=1e-6)
    assert N.t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert N.t_cdf(1.0, 1) == pytest.approx(0.75, abs=1e-9)
    assert N.t_quantile(0.975, 9) == pytest.approx(2.262157, abs=1e-5)


def test_power_of_paired_t():
    assert N.t_power(0.5, 34) == pytest.approx(0.808, abs=2e-3)
    assert N.n_for_power(0.5) == 34


def test_signed_rank_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(20):
        d = np.round(rng.normal(0.3, 1, 8), 1)
        d = d[d != 0]
        _, p, n, _ = N.signed_rank(d, np.zeros(len(d)))
        ranks = np.array([(np.abs(d) < abs(x)).sum() + ((np.abs(d) == abs(x)).sum() + 1) / 2 for x in d])
        w = ranks[d > 0].sum()
        all_ = np.array([sum(r for r, s in zip(ranks, signs) if s) for signs in product((0, 1), repeat=len(d))])
        want = min(1, 2 * min((all_ <= w + 1e-9).mean(), (all_ >= w - 1e-9).mean()))
        assert p == pytest.approx(want) and n == len(d)
    assert N.signed_rank(np.ones(3), np.ones(3)) == (0.0, 1.0, 0, 0)


def test_kendall_against_all_pairs():
    rng = np.random.default_rng(2)
    for n in (2, 3, 10, 57):
        x, y = rng.integers(0, 6, n).astype(float), rng.integers(0, 6, n).astype(float)
        i, j = np.triu_indices(n, 1)
        s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        base = np.sqrt((x[i] != x[j]).sum() * (y[i] != y[j]).sum())
        got = tau_b(x, y)
        assert (np.isnan(got) and base == 0) or got == pytest.approx(s.sum() / base)
    assert np.isnan(tau_b(np.ones(1), np.ones(1)))
