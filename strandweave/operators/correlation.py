"""Rank, product-moment and concordance correlations of groups of observations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.columns import trunc3
from strandweave.operators.describe import cumulative_counts


def _corr(a: str, b: str) -> Column:
    """Pearson from sums of columns centred before; NaN where a column is constant or has one row."""
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((va > 0) & (vb > 0), F.covar_pop(a, b) / F.sqrt(va * vb)).otherwise(float("nan"))


def pearson(df: DataFrame, by: list[str], columns: tuple[str, ...], digits: int | None = 3) -> DataFrame:
    """`<by>, n, correlation array<double>` in order of the upper triangle, cut to three decimals, or whole without digits."""
    cut = trunc3 if digits == 3 else lambda c: c
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*[cut(_corr(a, b)) for a, b in combinations(columns, 2)]).alias("correlation"))


def average_ranks(df: DataFrame, by: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Columns replaced by their average ranks within the group.

    Per column, values are counted first (map-side), ranked by cumulative counts in pieces of a group,
    and looked up; ties shrink the ranked table. Rows without a null in any column are expected.
    """
    out = df
    for c in columns:
        ranks = cumulative_counts(df, by, c).select(*by, c, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(f"_r_{c}"))
        out = out.join(ranks, [*by, c])
    return out.select(*by, *[F.col(f"_r_{c}").alias(c) for c in columns])


def ranked(df: DataFrame, by: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Average ranks by windows: one shuffle for all columns, for groups that fit a task (segments)."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2.0
    return df.select(*by, *[rank(c).alias(c) for c in columns])


def spearman(df: DataFrame, by: list[str], columns: tuple[str, ...], large_groups: bool = False) -> DataFrame:
    """As `pearson`, of average ranks. `large_groups` ranks by counted values instead of by windows."""
    return pearson((average_ranks if large_groups else ranked)(df, by, columns), by, columns)


def tau_b(x: np.ndarray, y: np.ndarray) -> float:
    """Kendall's tau-b in O(n log n): discordant pairs are the exchanges of a merge sort."""
    n = len(x)
    if n < 2:
        return float("nan")
    o = np.lexsort((y, x))
    x, y = x[o], y[o]
    pairs = lambda c: float((c * (c - 1) // 2).sum())
    tx, ty = pairs(np.unique(x, return_counts=True)[1]), pairs(np.unique(y, return_counts=True)[1])
    txy = pairs(np.unique(np.stack([x, y]), axis=1, return_counts=True)[1])
    r = np.unique(y, return_inverse=True)[1]
    swaps, width = 0, 1
    while width < n:
        nxt = r.copy()
        for a in range(0, n - width, 2 * width):
            left, right = r[a : a + width], r[a + width : a + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, side="right")).sum())
            nxt[a : a + len(left) + len(right)] = np.sort(r[a : a + 2 * width], kind="stable")
        r, width = nxt, 2 * width
    all_ = n * (n - 1) / 2
    base = np.sqrt((all_ - tx) * (all_ - ty))
    return float("nan") if base == 0 else float((all_ - tx - ty + txy - 2 * swaps) / base)


def kendall(df: DataFrame, by: list[str], columns: tuple[str, ...]) -> DataFrame:
    """As `pearson`, Kendall's tau-b; a group must fit a task (segments do)."""
    pairs = list(combinations(columns, 2))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        t = [tau_b(g[a].to_numpy(), g[b].to_numpy()) for a, b in pairs]
        return pd.DataFrame([[*key, len(g), t]], columns=[*by, "n", "correlation"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", n long, correlation array<double>"
    out = df.select(*by, *columns).groupBy(*by).applyInPandas(run, schema)
    return out.withColumn("correlation", F.transform("correlation", trunc3))
