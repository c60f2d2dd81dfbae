"""Distributions fitted to grouped columns, the best of several, and quantiles of data and fit side by side.

Each group is counted into `bins` equal bins first (map-side); fits run on these counts, so a group of any
size costs one small row set. A fit maximises the likelihood of the binned values.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions.columns import r6
from strandweave.functions.numeric import normal_cdf

EULER = 0.5772156649015329


def _gev_log_density(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    shape, loc, scale = p
    z = (x - loc) / scale
    if abs(shape) < 1e-9:
        return -z - np.exp(-z) - math.log(scale)
    t = 1 - shape * z
    with np.errstate(invalid="ignore", divide="ignore"):
        y = np.log(t) / shape
        return np.where(t > 0, (1 - shape) * y - np.exp(y) - math.log(scale), -np.inf)


def _normal(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return -0.5 * ((x - p[1]) / p[2]) ** 2 - math.log(p[2]) - 0.5 * math.log(2 * math.pi)


def _exponential(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.where(x >= p[1] - 1e-12, -(x - p[1]) / p[2] - math.log(p[2]), -np.inf)


def _gumbel(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return _gev_log_density(x, np.array([0.0, p[1], p[2]]))


#: Family: (log density of (shape, loc, scale), whether shape is free, quantile function).
FAMILIES: dict[str, tuple[Callable, bool, Callable]] = {
    "norm": (_normal, False, lambda q, p: p[1] + p[2] * _normal_quantile(q)),
    "expon": (_exponential, False, lambda q, p: p[1] - p[2] * np.log1p(-q)),
    "gumbel_r": (_gumbel, False, lambda q, p: p[1] - p[2] * np.log(-np.log(q))),
    "genextreme": (_gev_log_density, True, lambda q, p: p[1] + p[2] * ((1 - (-np.log(q)) ** p[0]) / p[0] if abs(p[0]) > 1e-9 else -np.log(-np.log(q)))),
}


def _normal_quantile(q: np.ndarray) -> np.ndarray:
    lo, hi = np.full(len(q), -9.0), np.full(len(q), 9.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = normal_cdf(mid) < q
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def simplex_minimum(f: Callable[[np.ndarray], float], start: np.ndarray, step: np.ndarray, most: int = 600, tol: float = 1e-9) -> tuple[np.ndarray, bool]:
    """(point, whether it converged) of a minimum by a moving simplex (reflect, expand, contract, shrink)."""
    pts = np.vstack([start, start + np.diag(step)])
    val = np.array([f(p) for p in pts])
    for _ in range(most):
        o = np.argsort(val, kind="stable")
        pts, val = pts[o], val[o]
        if np.isfinite(val[-1]) and val[-1] - val[0] <= tol * (abs(val[0]) + tol):
            return pts[0], True
        mid = pts[:-1].mean(0)
        tries = {k: mid + k * (mid - pts[-1]) for k in (1.0, 2.0, 0.5, -0.5)}
        r = f(tries[1.0])
        if r < val[0]:
            e = f(tries[2.0])
            pts[-1], val[-1] = (tries[2.0], e) if e < r else (tries[1.0], r)
        elif r < val[-2]:
            pts[-1], val[-1] = tries[1.0], r
        else:
            k = 0.5 if r < val[-1] else -0.5
            c = f(tries[k])
            if c < min(r, val[-1]):
                pts[-1], val[-1] = tries[k], c
            else:
                pts[1:] = pts[0] + (pts[1:] - pts[0]) / 2
                val[1:] = [f(p) for p in pts[1:]]
    return pts[int(val.argmin())], False


def fit_family(name: str, x: np.ndarray, n: np.ndarray) -> tuple[bool, float | None, float, float, float]:
    """(success, shape, loc, scale, negative log likelihood) of a family on values x that occur n times."""
    density, shaped, _ = FAMILIES[name]
    total = n.sum()
    m = float((x * n).sum() / total)
    sd = math.sqrt(max(float((n * (x - m) ** 2).sum() / total), 1e-18))
    if name == "norm":
        p, ok = np.array([0.0, m, sd]), True
    elif name == "expon":
        p, ok = np.array([0.0, float(x.min()), max(m - float(x.min()), 1e-9)]), True
    else:
        b = sd * math.sqrt(6) / math.pi
        start = np.array([*([-0.05] if shaped else []), m - EULER * b, math.log(b)])
        full = lambda v: np.array([v[0] if shaped else 0.0, v[-2], math.exp(min(v[-1], 700))])

        def loss(v: np.ndarray) -> float:
            g = density(x, full(v))
            return float("inf") if not np.isfinite(g[n > 0]).all() else float(-(n * g).sum() / total)

        v, ok = simplex_minimum(loss, start, np.array([*([0.1] if shaped else []), b / 2, 0.3]))
        p = full(v)
    g = density(x, p)
    nll = float(-(n * g).sum()) if np.isfinite(g[n > 0]).all() else float("inf")
    return ok and math.isfinite(nll), (float(p[0]) if shaped else None), float(p[1]), float(p[2]), nll


def fitted(df: DataFrame, by: list[str], value: str, bins: int = 1000, coarse: int = 100) -> DataFrame:
    """`<by>, family, success, shape, loc, scale, nll, square_error, place`: families by success, likelihood and squared error of the density.

    The squared error is over a histogram of `coarse` bins against the density at their left edges.
    Groups with fewer than two different values have no fit.
    """
    ext = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where("_hi > _lo")
    x = df.join(ext, by).withColumn("_b", F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)))
    h = x.groupBy(*by, "_lo", "_hi", "_b").agg(F.count(F.lit(1)).alias("_n"))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", family string, success boolean, shape double, loc double, scale double, nll double, square_error double, place int"

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        lo, hi = float(g["_lo"].iloc[0]), float(g["_hi"].iloc[0])
        wide = (hi - lo) / bins
        at, n = g["_b"].to_numpy(), g["_n"].to_numpy().astype(float)
        mid = lo + (at + 0.5) * wide
        dense = np.bincount((at * coarse // bins).astype(int), n, minlength=coarse) / n.sum() / ((hi - lo) / coarse)
        left = lo + np.arange(coarse) * (hi - lo) / coarse
        rows = []
        for name, (density, _, _) in FAMILIES.items():
            ok, shape, loc, scale, nll = fit_family(name, mid, n)
            err = float(((np.exp(density(left, np.array([shape or 0.0, loc, scale]))) - dense) ** 2).sum())
            rows.append((*key, name, ok, None if shape is None else round(shape, 4), round(loc, 4), round(scale, 4), round(nll, 3), round(err, 6)))
        rows.sort(key=lambda r: (not r[len(key) + 1], r[-2], r[-1]))
        return pd.DataFrame([(*r, i + 1) for i, r in enumerate(rows)], columns=[*by, "family", "success", "shape", "loc", "scale", "nll", "square_error", "place"])

    return h.groupBy(*by).applyInPandas(run, schema)


def best(fits: DataFrame, by: list[str]) -> DataFrame:
    """The first family of each group, if its fit succeeded."""
    return fits.where("place = 1 and success").drop("place")


def quantile_pairs(df: DataFrame, best_: DataFrame, by: list[str], value: str, n: int = 99) -> DataFrame:
    """`<by>, share, data, fit`: quantiles of the data (to about 1/10,000 of rank) beside those of the best fit."""
    shares = [(i + 1) / (n + 1) for i in range(n)]
    q = df.groupBy(*by).agg(F.percentile_approx(value, shares, 10_000).alias("q")).join(best_, by)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(frames):  # noqa: ANN001, ANN202
        for f in frames:
            for r in f.itertuples(index=False):
                x = dict(zip(f.columns, r))
                fit = FAMILIES[x["family"]][2](np.array(shares), np.array([x["shape"] if x["shape"] == x["shape"] and x["shape"] is not None else 0.0, x["loc"], x["scale"]]))
                yield pd.DataFrame({**{c: x[c] for c in by}, "share": shares, "data": np.asarray(x["q"], float), "fit": np.round(fit, 4)})

    return q.select(*by, "q", "family", "shape", "loc", "scale").mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", share double, data double, fit double")


def density_bounds(df: DataFrame, by: list[str], value: str, bins: int = 100, shares: tuple[float, float] = (0.005, 0.995)) -> DataFrame:
    """`<by>, lo, hi, top`: the range of values that a plot shows, and the highest density in a histogram of that many bins."""
    e = df.groupBy(*by).agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.percentile_approx(value, list(shares), 10_000).alias("_q"), F.count(value).alias("_n")).where("_b > _a")
    h = df.join(e, by).groupBy(*by, "_a", "_b", "_q", "_n", F.least(F.floor((F.col(value) - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).alias("_i")).agg(F.count(F.lit(1)).alias("_c"))
    top = F.max(F.col("_c") / F.col("_n") / ((F.col("_b") - F.col("_a")) / bins))
    return h.groupBy(*by, "_q").agg(top.alias("t")).select(*by, r6(F.get("_q", F.lit(0))).alias("lo"), r6(F.get("_q", F.lit(1))).alias("hi"), r6(F.col("t")).alias("top"))
