"""Synthetic segmented series: correlated normals moved to the marginals of each variate.

The plan (a row per segment) is made on the driver; the observations of each segment are made where
the row lies, from a seed of its own, so the result does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.numeric import matrix_of, normal_cdf

SHORT, LONG = (15, 20, 30, 60), (120, 300, 480)
START = "2017-06-23T00:00:00Z"


def segment_lengths(n: int, rng: np.random.Generator, unit: int = 60, short: tuple[int, ...] = SHORT, long: tuple[int, ...] = LONG) -> np.ndarray:
    """Three quarters short and one quarter long durations, each in near-equal numbers, shuffled."""
    n_long = n - round(3 * n / 4)
    pick = lambda kinds, k: np.resize(rng.permutation(np.array(kinds)), k)
    out = np.concatenate([pick(short, n - n_long), pick(long, n_long)]) * unit
    return rng.permutation(out)


def pattern_order(patterns: list[int], n: int, rng: np.random.Generator) -> list[int]:
    """n patterns in near-equal numbers and random order, no two neighbours equal."""
    if len(set(patterns)) < 2 and n > 1:
        raise ValueError("no order without repetition exists")
    left = {p: n // len(patterns) for p in patterns}
    for p in rng.permutation(patterns)[: n % len(patterns)]:
        left[int(p)] += 1
    out: list[int] = []
    while len(out) < n:
        rest = n - len(out)
        free = [p for p, k in left.items() if k and (not out or p != out[-1])]
        must = [p for p in free if left[p] > rest // 2]  # one that would be left over with itself
        p = int(rng.choice(must or free))
        out.append(p)
        left[p] -= 1
    return out


def correlated(normal: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Independent columns given the correlations of the vector; negative eigenvalues are clipped."""
    w, q = np.linalg.eigh(matrix_of(vector))
    return normal @ (q * np.sqrt(np.maximum(w, 0))).T


def cholesky_correlated(data: np.ndarray, vector: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Columns given the covariances that the vector and their own deviations make; a matrix that is not positive definite gets the ridge once."""
    sd = data.std(axis=0)
    cov = matrix_of(vector) * np.outer(sd, sd)
    if not (np.linalg.eigvalsh(cov) > 0).all():
        cov = cov + ridge * np.eye(len(cov))
    return data @ np.linalg.cholesky(cov).T


def gev_quantile(u: np.ndarray, c: float, loc: float, scale: float) -> np.ndarray:
    y = -np.log(u)
    return loc + scale * ((1 - y**c) / c if abs(c) > 1e-12 else -np.log(y))


def negative_binomial_quantile(u: np.ndarray, n: float, p: float) -> np.ndarray:
    """The smallest count whose distribution function reaches u."""
    pmf, cdf, terms, k = p**n, p**n, [p**n], 0
    while cdf < min(u.max(), 1 - 1e-12) and k < 1_000_000:
        k += 1
        pmf *= (n + k - 1) / k * (1 - p)
        cdf += pmf
        terms.append(cdf)
    return np.searchsorted(np.array(terms), u).astype(float)


def stages(length: int, vector: np.ndarray, seed: int, margins: dict) -> dict[str, np.ndarray]:
    """The raw, correlated and non-normal values of one segment, each rounded to three decimals."""
    raw = np.random.default_rng(seed).normal(size=(length, 3))
    cor = np.round(correlated(raw, vector), 3)
    u = np.clip(normal_cdf(cor), 1e-9, 1 - 1e-9)
    non = np.stack([gev_quantile(u[:, 0], *margins["iob"]), negative_binomial_quantile(u[:, 1], *margins["cob"]), gev_quantile(u[:, 2], *margins["ig"])], 1)
    return {"raw": np.round(raw, 3), "correlated": cor, "nonnormal": np.round(non, 3)}


def generated_segments(
    spark: SparkSession, patterns: DataFrame, n_subjects: int, n_segments: int, seed: int, unit: int = 1, margins: dict | None = None,
) -> DataFrame:
    """`subject_id, segment_id, pattern_id, stage, obs_idx, second, iob, cob, ig, datetime` of n_subjects x n_segments segments in three stages."""
    margins = margins or {"iob": (0.05, 2.0, 1.5), "cob": (1.2, 0.08), "ig": (-0.1, 120.0, 35.0)}
    known = {r["pattern_id"]: list(r["relaxed"]) for r in patterns.collect()}  # the catalogue, 27 rows at most
    rows = []
    for s in range(n_subjects):
        rng = np.random.default_rng([seed, s])
        at = 0
        for i, (n, p) in enumerate(zip(segment_lengths(n_segments, rng, unit), pattern_order(sorted(known), n_segments, rng))):
            rows.append((f"generated-{s}", i, p, at, int(n), int(seed + 100_003 * s + i), known[p]))
            at += int(n)
    plan = spark.createDataFrame(rows, "subject_id string, segment_id int, pattern_id int, start long, length long, seed long, vec array<double>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                idx = r.start + np.arange(r.length)
                for name, x in stages(r.length, np.asarray(r.vec, float), r.seed, margins).items():
                    yield pd.DataFrame({"subject_id": r.subject_id, "segment_id": r.segment_id, "pattern_id": r.pattern_id, "stage": name, "obs_idx": idx, "second": idx, "iob": x[:, 0], "cob": x[:, 1], "ig": x[:, 2]})

    return plan.repartition("subject_id", "segment_id").mapInPandas(run, "subject_id string, segment_id int, pattern_id int, stage string, obs_idx long, second long, iob double, cob double, ig double").withColumn(
        "datetime", F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + F.col("second")))
