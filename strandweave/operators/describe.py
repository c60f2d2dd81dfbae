"""Descriptive statistics of grouped columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.columns import histogram_bin, r6

STATS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def piece(v: Column) -> Column:
    """A whole number that rises with the value: its sign, exponent and a 64th of an octave. Values of one piece are within about 1 % of one another."""
    return F.when(v == 0, F.lit(0).cast("long")).otherwise(F.signum(v).cast("long") * (F.floor(F.log2(F.abs(v)) * 64) + 70_000))


def cumulative_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """`<by>, <value>, _n, _upto`: each value's count and the number of values up to it in its group; nulls are left out, null keys are keys.

    Values are counted first. Numbers run within a piece of the group (see `piece`), and pieces add the
    totals before them, so no task holds a group.
    """
    counts = df.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", piece(F.col("_v")))
    counts = counts.withColumn("_in", F.sum("_n").over(Window.partitionBy(*by, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    total = counts.groupBy(*by, "_k").agg(F.max("_in").alias("_t"))
    total = total.withColumn("_base", F.sum("_t").over(Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")).drop("_t")
    return same_keys(counts, total, [*by, "_k"]).select(*by, F.col("_v").alias(value), "_n", (F.col("_in") + F.col("_base")).alias("_upto"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where all keys agree, nulls with nulls; without keys, with the one row on the right."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    other = right.select(*[F.col(c).alias(f"_o_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_o_{k}" for k in keys])


def exact_percentiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...], name: str = "q") -> DataFrame:
    """`<by>, <name>`: an array of interpolated percentiles, exact, for groups of any size."""
    c = cumulative_counts(df, by, value)
    n = c.groupBy(*by).agg(F.max("_upto").alias("_all"))
    x = same_keys(c, n, by)
    rank = lambda p: 1 + F.lit(float(p)) * (F.col("_all") - 1)
    at = lambda r: F.max(F.when((F.col("_upto") - F.col("_n") < r) & (r <= F.col("_upto")), F.col(value)))
    ends = x.groupBy(*by).agg(F.max("_all").alias("_all"), *[a for i, p in enumerate(shares) for a in (at(F.floor(rank(p) + 1e-9)).alias(f"_l{i}"), at(F.ceil(rank(p) - 1e-9)).alias(f"_h{i}"))])
    line = lambda i, p: F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.greatest(F.lit(0.0), rank(p) - F.floor(rank(p) + 1e-9))
    return ends.select(*by, F.array(*[line(i, p) for i, p in enumerate(shares)]).alias(name))


def describe(df: DataFrame, by: list[str], value: str | Column, digits: int = 6, large: bool = False) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles (interpolated); nulls and NaN are left out.

    A group of one has a null deviation, a group without values only its count of 0. Quartiles of
    plain groups keep their different values in one task; `large` groups are cut into pieces.
    """
    v = F.col(value) if isinstance(value, str) else value
    x = F.when(~F.isnan(v.cast("double")), v.cast("double"))
    if large:
        x = df.select(*by, x.alias("_x"))
        m = x.groupBy(*by).agg(F.count("_x").alias("count"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"))
        q = same_keys(m, exact_percentiles(x, by, "_x", (0.25, 0.5, 0.75)), by, "left")
    else:
        q = _plain(df, by, x)
    return q.select(*by, "count", *[r6(F.col(c), digits).alias(c) for c in ("mean", "std", "min")],
                    *[r6(F.get("q", F.lit(i)), digits).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], r6(F.col("max"), digits).alias("max"))


def _plain(df: DataFrame, by: list[str], x: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.max(x).alias("max"))


def entropy(df: DataFrame, by: list[str], value: str, lo: float = 0.0, hi: float = 1.0, bins: int = 50) -> DataFrame:
    """Shannon entropy (base 2) of the finite values' histogram; a group without values has none."""
    h = df.withColumn("bin", histogram_bin(F.col(value), lo, hi, bins)).where("bin is not null").groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return h.withColumn("p", p).groupBy(*by).agg(r6(-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))


def min_max_scaled(df: DataFrame, by: list[str], columns: list[str], lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Each column scaled to [lo, hi] within its group; a constant column becomes lo, a null stays null.

    The extremes come from a small aggregate that is joined back, so no group is sorted or gathered.
    """
    ext = df.groupBy(*by).agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(f"_{c}") for c in columns])
    x = df.join(ext, by)
    for c in columns:
        a, b = F.col(f"_{c}.a"), F.col(f"_{c}.b")
        x = x.withColumn(c, lo + F.when(F.col(c).isNotNull(), F.when(b > a, (F.col(c) - a) / (b - a)).otherwise(0.0)) * (hi - lo))
    return x.drop(*[f"_{c}" for c in columns])
