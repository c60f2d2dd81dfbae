"""Distribution functions and tests on small aggregated samples, on numpy alone."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

PHI = NormalDist()
EXACT = 50


def normal_critical(alpha: float, two_tailed: bool = True) -> float:
    return PHI.inv_cdf(1 - alpha / 2 if two_tailed else 1 - alpha)


def adjusted_critical(alpha: float, n_tests: int) -> float:
    """The critical z at a Bonferroni-adjusted level."""
    return normal_critical(alpha / n_tests)


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function of an array: a table of the exact one, interpolated by cubic Hermite pieces (error below 1e-12)."""
    x = np.clip(np.asarray(x, float), -8.9, 8.9)
    grid, value = _normal_table()
    step = grid[1] - grid[0]
    i = np.minimum(((x - grid[0]) / step).astype(int), len(grid) - 2)
    t = (x - grid[i]) / step
    slope = np.exp(-grid * grid / 2) / math.sqrt(2 * math.pi) * step
    return ((1 + 2 * t) * (1 - t) ** 2) * value[i] + t * (1 - t) ** 2 * slope[i] + t * t * (3 - 2 * t) * value[i + 1] + t * t * (t - 1) * slope[i + 1]


@lru_cache
def _normal_table() -> tuple[np.ndarray, np.ndarray]:
    grid = np.linspace(-9, 9, 9001)
    return grid, np.array([PHI.cdf(v) for v in grid])


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by Gauss-Legendre quadrature of the substituted integral."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    f = lambda num, d: 1 / d if abs(d) > 1e-300 else 1e300
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # continued fraction, modified Lentz
    c, d = 1.0, f(0, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = f(0, 1 + num * d)
            c = 1 + num / c if abs(c) > 1e-300 else 1e300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_cdf(t: float, df: float) -> float:
    if math.isinf(t):
        return float(t > 0)
    tail = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return 1 - tail if t > 0 else tail


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, df: float) -> float:
    lo, hi = -1e3, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def t_power(effect: float, n: int, alpha: float = 0.05, two_sided: bool = True) -> float:
    """Power of a paired t test: the non-central t by quadrature over the sample deviation."""
    df, delta = n - 1, abs(effect) * math.sqrt(n)
    crit = t_quantile(1 - alpha / 2 if two_sided else 1 - alpha, df)
    s = np.linspace(1e-6, 1 + 12 / math.sqrt(2 * df), 8001)
    logs = (df - 1) * np.log(s) - df * s * s / 2
    w = np.exp(logs - logs.max())
    w /= w.sum()
    cdf = normal_cdf
    upper = 1 - cdf(crit * s - delta)
    return float((w * (upper + (cdf(-crit * s - delta) if two_sided else 0))).sum())


def n_for_power(effect: float, power: float = 0.8, alpha: float = 0.05, two_sided: bool = True, most: int = 1_000_000) -> int:
    """The smallest sample of a paired t test that reaches the power."""
    lo, hi = 2, 4
    while hi < most and t_power(effect, hi, alpha, two_sided) < power:
        lo, hi = hi, hi * 2
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if t_power(effect, mid, alpha, two_sided) >= power else (mid + 1, hi)
    return lo


def n_for_z_power(effect: float, z_alpha: float = 1.96, z_beta: float = 0.84) -> float:
    """Sample size of each of two groups for an effect."""
    return 2 * ((z_alpha + z_beta) / effect) ** 2


def z_power(d: float, n: float, alpha: float = 0.05, two_tailed: bool = True) -> float:
    return PHI.cdf(d * math.sqrt(n / 2) - normal_critical(alpha, two_tailed))


def p_from_interval(se: float, difference: float) -> float:
    """The approximate p of a difference from its standard error; of negative differences by the same formula, so it may exceed 1."""
    z = difference / se
    return math.exp(-0.717 * z - 0.416 * z * z)


def n_for_correlation(alpha: float, power: float, rho1: float, rho0: float = 0.0, b: float = 3.0, c2: float = 1.0, two_tailed: bool = True) -> float:
    """Sample size to tell rho1 from rho0, by Fisher's z; b and c2 depend on the coefficient (3 and 1: product-moment)."""
    z = normal_critical(alpha, two_tailed) + normal_critical(1 - power, False)
    return b + c2 * (z / (math.atanh(rho1) - math.atanh(rho0))) ** 2


def alpha_for_correlation(n: float, power: float, rho1: float, rho0: float = 0.0, b: float = 3.0, c2: float = 1.0) -> float:
    """The one-tailed level reached by a given sample: the inverse of `n_for_correlation`."""
    return 1 - PHI.cdf(math.sqrt((n - b) / c2) * (math.atanh(rho1) - math.atanh(rho0)) - normal_critical(1 - power, False))


def combinations_of_two(n: int) -> float:
    return n * (n - 1) / 2


def mean_interval(x: np.ndarray, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) by Student's t."""
    x = np.asarray(x, float)
    m, n = float(x.mean()), len(x)
    h = t_quantile((1 + level) / 2, n - 1) * float(x.std(ddof=1)) / math.sqrt(n) if n > 1 else float("nan")
    return m, m - h, m + h


def signed_rank(x: np.ndarray, y: np.ndarray, non_zero: float = 0.0, alternative: str = "two-sided") -> tuple[float, float, int, int]:
    """Wilcoxon: (statistic, p, pairs, sign of the median difference); without differences (0, 1).

    Up to `EXACT` pairs the null distribution is exact over the ranks at hand (ties get average ranks,
    doubled to be whole); beyond, the normal form with its correction for ties.
    """
    d = np.asarray(x, float) - np.asarray(y, float)
    d = d[np.abs(d) > non_zero]
    n = len(d)
    if not n:
        return 0.0, 1.0, 0, 0
    _, inv, cnt = np.unique(np.round(np.abs(d), 12), return_inverse=True, return_counts=True)
    twice = (2 * np.cumsum(cnt) - cnt + 1)[inv]
    plus, all_ = int(twice[d > 0].sum()), int(twice.sum())
    if n > EXACT:
        z = (plus / 2 - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ((cnt**3 - cnt).sum()) / 48)
        p = {"two-sided": 2 * PHI.cdf(-abs(z)), "greater": 1 - PHI.cdf(z), "less": PHI.cdf(z)}[alternative]
        return float((min(plus, all_ - plus) if alternative == "two-sided" else plus) / 2), float(p), n, int(np.sign(np.median(d)))
    ways = np.zeros(all_ + 1)
    ways[0] = 1
    for r in twice:
        nxt = ways.copy()
        nxt[r:] += ways[: all_ + 1 - r]
        ways = nxt / 2
    low, high = ways[: plus + 1].sum(), ways[plus:].sum()
    p = {"two-sided": min(1.0, 2 * min(low, high)), "greater": high, "less": low}[alternative]
    stat = (min(plus, all_ - plus) if alternative == "two-sided" else plus) / 2
    return float(stat), float(p), n, int(np.sign(np.median(d)))


def effect_size(p: float, n: int, sign: int, two_sided: bool = True) -> float:
    """r = z / sqrt(n), with the sign of the difference."""
    if not n or p >= 1:
        return 0.0
    return sign * abs(PHI.inv_cdf(max(p, 1e-300) / (2 if two_sided else 1))) / math.sqrt(n)


def matrix_of(v: np.ndarray) -> np.ndarray:
    """The symmetric matrix with unit diagonal of an upper triangle."""
    return matrices_of(np.asarray(v, float)[None])[0]


def matrices_of(v: np.ndarray) -> np.ndarray:
    """Symmetric matrices with unit diagonals of upper triangles, one a row."""
    n = round(math.sqrt(2 * v.shape[1] + 0.25) + 0.5)
    if n * (n - 1) // 2 != v.shape[1]:
        raise ValueError("a vector must hold the upper triangle of a matrix")
    m = np.broadcast_to(np.eye(n), (len(v), n, n)).copy()
    i, j = np.triu_indices(n, 1)
    m[:, i, j] = v
    m[:, j, i] = v
    return m


def upper_half(m: np.ndarray) -> np.ndarray:
    """The upper triangle of a matrix row by row; a vector stays as it is."""
    m = np.asarray(m, float)
    return m[np.triu_indices(len(m), 1)] if m.ndim == 2 else m


def upper_halves(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices or vectors of equal shape as vectors."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if a.shape != b.shape:
        raise ValueError("shapes differ")
    return upper_half(a), upper_half(b)


def same_matrices(a: np.ndarray, b: np.ndarray, digits: int = 8) -> bool:
    a, b = np.asarray(a, float), np.asarray(b, float)
    return a.shape == b.shape and bool((np.round(a, digits) == np.round(b, digits)).all())


def lower_block_diagonal(m: np.ndarray, blocks: int, k: int) -> list[np.ndarray]:
    """The blocks of the k-th diagonal below the main one (0: the main one) of a square matrix of blocks x blocks blocks."""
    m = np.asarray(m)
    if m.ndim != 2 or m.shape[0] != m.shape[1] or m.shape[0] % blocks:
        raise ValueError("the matrix must be square and divisible into blocks")
    if not 0 <= k < blocks:
        raise ValueError("no such diagonal")
    n = len(m) // blocks
    return [m[(i + k) * n : (i + k + 1) * n, i * n : (i + 1) * n] for i in range(blocks - k)]


def matrix_logs(v: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Matrix logarithms (complex where an eigenvalue is negative) of the matrices of upper triangles; rows with missing values give NaN."""
    ok = np.isfinite(v).all(1)
    m = matrices_of(np.where(ok[:, None], v, 0))
    w, q = np.linalg.eigh(m + eps * np.eye(m.shape[1]))
    out = (q * np.log(w.astype(complex))[:, None, :]) @ q.transpose(0, 2, 1)
    out[~ok] = np.nan
    return out


def log_frobenius_batch(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Frobenius norm of the difference of the matrix logarithms, row by row."""
    return np.linalg.norm(matrix_logs(a) - matrix_logs(b), axis=(1, 2))


def foerstner_batch(a: np.ndarray, b: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Root of the summed squares of log(1 + eigenvalue) of the generalised problem, row by row; NaN below -1 and for missing values."""
    ok = np.isfinite(a).all(1) & np.isfinite(b).all(1)
    ma, mb = (matrices_of(np.where(ok[:, None], v, 0)) for v in (a, b))
    e = eps * np.eye(ma.shape[1])
    w = np.linalg.eigvals(np.linalg.solve(mb + e, ma + e)).real
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.sqrt((np.log1p(w) ** 2).sum(1))
    return np.where(ok, out, np.nan)


def psd_batch(v: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    ok = np.isfinite(v).all(1)
    return ok & (np.linalg.eigvalsh(matrices_of(np.where(ok[:, None], v, 0))) > -tol).all(1)


def is_psd(v: np.ndarray, tol: float = 1e-10) -> bool:
    return bool(psd_batch(np.asarray(v, float)[None], tol)[0])


def log_frobenius(a: np.ndarray, b: np.ndarray) -> float:
    return float(log_frobenius_batch(np.asarray(a, float)[None], np.asarray(b, float)[None])[0])


def foerstner(a: np.ndarray, b: np.ndarray) -> float:
    return float(foerstner_batch(np.asarray(a, float)[None], np.asarray(b, float)[None])[0])
