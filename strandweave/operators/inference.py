"""Statistics over runs: index against agreement, Fisher-transformed paired tests, intervals, signed ranks."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import numeric
from strandweave.functions.columns import fisher_z, interval_relation, r6, ratio, t_two_sided


def index_correlations(df: DataFrame, by: list[str], indices: list[str], external: str) -> DataFrame:
    """`<by>, index, n, r`: Pearson correlation of each index with the external one over partitions, to three decimals.

    Pairs with a null or NaN are left out. Both constant: 1; one constant: 0; no pair: NaN.
    """
    x = df.select(*by, F.col(external).cast("double").alias("_e"), *[F.col(i).cast("double").alias(i) for i in indices]).unpivot([*by, "_e"], indices, "index", "v")
    x = x.where("v is not null and _e is not null and not isnan(v) and not isnan(_e)")
    x = x.groupBy(*by, "index").agg(F.count(F.lit(1)).alias("n"), F.var_pop("v").alias("a"), F.var_pop("_e").alias("b"), F.covar_pop("v", "_e").alias("c"))
    flat = lambda c: F.col(c) <= 1e-18
    r = F.when(flat("a") & flat("b"), 1.0).when(flat("a") | flat("b"), 0.0).otherwise(F.col("c") / F.sqrt(F.greatest("a", F.lit(1e-300)) * F.greatest("b", F.lit(1e-300))))
    return x.select(*by, "index", "n", r6(r, 3).alias("r"))


def with_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Adds the two-sided `p` of each correlation of n pairs; 1 where r is NaN or n is below 3."""
    x, k = F.col(r), F.col(n)
    p = F.when(F.isnan(x) | x.isNull() | (k < 3), 1.0).when(F.abs(x) >= 1, 0.0).otherwise(t_two_sided(x * F.sqrt((k - 2) / (1 - x * x)), k - 2))
    return df.withColumn("p", F.round(p, 6))


def paired_differences(df: DataFrame, run: str, label: str, value: str, fisher: bool = True) -> DataFrame:
    """`a, b, n, mean, std, t, cohens_d` for each pair of labels over runs that have both; infinite values are left out.

    Labels are few (indices or measures): the pairs come from one wide row per run, not from a join.
    """
    v = fisher_z(F.col(value)) if fisher else F.col(value).cast("double")
    names = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # a handful of measures
    wide = df.groupBy(run).agg(*[F.max(F.when(F.col(label) == n, v)).alias(f"v{i}") for i, n in enumerate(names)])
    pairs = [(i, j) for i, j in combinations(range(len(names)), 2)]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, n long, mean double, std double, t double, cohens_d double")
    x = wide.select(F.explode(F.array(*[F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), (F.col(f"v{i}") - F.col(f"v{j}")).alias("d")) for i, j in pairs])).alias("s")).select("s.*")
    x = x.where("d is not null and not isnan(d) and abs(d) < double('infinity')").groupBy("a", "b").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("std"))
    d = F.when(F.col("std") > 1e-12, F.col("mean") / F.col("std")).when(F.abs("mean") < 1e-12, 0.0)
    return x.select("a", "b", "n", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"), r6(d * F.sqrt(F.col("n"))).alias("t"), r6(d).alias("cohens_d"))


def tested(pairs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Adds `p` and `power` of the paired t tests, on the driver: there is a row per pair of labels."""
    rows = []
    for r in pairs.orderBy("a", "b").collect():
        ok = r["n"] > 1 and r["t"] is not None
        rows.append((r["a"], r["b"], r["n"], r["t"], r["cohens_d"], round(numeric.t_two_sided(r["t"], r["n"] - 1), 6) if ok else 1.0, round(numeric.t_power(r["cohens_d"], r["n"], alpha), 6) if ok else 0.0))
    return pairs.sparkSession.createDataFrame(rows, "a string, b string, n long, t double, cohens_d double, p double, power double")


def mean_difference_intervals(df: DataFrame, label: str, value: str, z: float = 1.959964) -> DataFrame:
    """`a, b, difference, lo, hi, relation, standardised` for each pair of labels. A table of one row per label is joined with itself."""
    s = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(label).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    o = s.select(F.col(label).alias("b"), F.col("n").alias("n2"), F.col("m").alias("m2"), F.col("s").alias("s2"))
    x = s.join(F.broadcast(o), F.col(label) < F.col("b"))
    se = F.sqrt(F.col("s") ** 2 / F.col("n") + F.col("s2") ** 2 / F.col("n2"))
    diff = F.col("m") - F.col("m2")
    return x.select(F.col(label).alias("a"), "b", r6(diff).alias("difference"), r6(diff - z * se).alias("lo"), r6(diff + z * se).alias("hi"), interval_relation(diff - z * se, diff + z * se).alias("relation"), r6(F.coalesce(ratio(diff, se), F.lit(0.0))).alias("standardised"))


def signed_rank_tests(df: DataFrame, run: str, label: str, value: str, non_zero: float = 0.0, alpha: float = 0.05) -> DataFrame:
    """Wilcoxon tests of all pairs of labels over runs: one task per pair, on one value per run.

    `a, b, statistic, p, n_nonzero, effect, significant` with a Bonferroni-adjusted level. The exact
    null needs whole ranks, so a pair's runs (tens to thousands) must fit a task.
    """
    names = [r[0] for r in df.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]  # a handful of measures
    n_tests = max(1, len(names) * (len(names) - 1) // 2)
    wide = df.groupBy(run).agg(*[F.max(F.when(F.col(label) == n, F.col(value).cast("double"))).alias(f"v{i}") for i, n in enumerate(names)])
    pairs = [F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y")) for i, j in combinations(range(len(names)), 2)]
    schema = "a string, b string, statistic double, p double, n_nonzero long, effect double, significant boolean"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    long = wide.select(F.explode(F.array(*pairs)).alias("s")).select("s.*").where("x is not null and y is not null and not isnan(x) and not isnan(y)")

    def test(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        stat, p, n, sign = numeric.signed_rank(g["x"].to_numpy(), g["y"].to_numpy(), non_zero)
        return pd.DataFrame([[*key, stat, round(p, 6), n, round(numeric.effect_size(p, n, sign), 6), bool(p < round(alpha / n_tests, 4))]], columns=["a", "b", "statistic", "p", "n_nonzero", "effect", "significant"])

    return long.groupBy("a", "b").applyInPandas(test, schema)
