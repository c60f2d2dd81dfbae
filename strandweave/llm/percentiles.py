"""Percentiles of very large numeric columns by radix selection over mergeable digit histograms.

A double maps to a 64-bit integer of the same order. Its leading bits (sign, exponent and
`mantissa_bits` of the mantissa) are its code; a state holds how often each code occurs in each
group. States of days, files or partitions join by adding counts. The selection histograms
successive digits of the codes and follows only the digit that contains each target rank.

How it scales: the counts combine map-side, so a group that holds a third of all rows sends at most
one row per code and map task; everything after is over states, whose size per group is bounded by
the number of codes (2**mantissa_bits for each power of two in the data), not by the rows. No step
sorts values or holds a group's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX = 0x7FFFFFFFFFFFFFFF


def order_code(value: Column) -> Column:
    """The order-preserving integer of a double; -0.0 counts as 0.0."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value + F.lit(0.0)).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(MAX))).otherwise(bits)


def order_value(code: Column) -> Column:
    """The double of an order-preserving integer."""
    bits = F.when(code < 0, code.bitwiseXOR(F.lit(MAX))).otherwise(code)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def digit_state(df: DataFrame, groups: list[str], value: str, mantissa_bits: int = 10) -> DataFrame:
    """Mergeable state `<groups>, code, n` of the finite values of each group.

    With m mantissa bits a percentile is off by at most 2**-(m+1) of its size; 52 makes it exact.
    Null, NaN and infinite values are left out; a null group is a group; groups without any finite
    value have no state; other columns are ignored.
    """
    if not 0 <= mantissa_bits <= 52:
        raise ValueError("mantissa_bits must be in 0..52")
    v = F.col(value).cast("double")
    finite = df.select(*groups, v.alias("_v")).where("_v is not null and not isnan(_v) and abs(_v) < double('infinity')")
    return finite.select(*groups, F.shiftright(order_code(F.col("_v")), 52 - mantissa_bits).alias("code")).groupBy(*groups, "code").agg(F.count(F.lit(1)).alias("n"))


def merged_states(states: DataFrame, groups: list[str]) -> DataFrame:
    """Join states into those of coarser groups (longer spans, all portions): counts add up."""
    return states.groupBy(*groups, "code").agg(F.sum("n").alias("n"))


def select_percentiles(
    states: DataFrame, groups: list[str], probs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99),
    mantissa_bits: int = 10, digit_bits: int = 11,
) -> DataFrame:
    """One row per group: `<groups>, n, p05, p25, ...` from states of that many mantissa bits.

    A percentile p is the value of rank ceil(p n) (at least 1), as the middle of its code's range,
    or exactly if mantissa_bits is 52. Each pass histograms the next `digit_bits` bits of the codes
    and goes on with those codes alone whose digit contains a target's rank. An empty state gives
    no rows. `states` is read once per pass; write it first where it is dear to compute.
    """
    bits = 12 + mantissa_bits
    unsigned = F.col("code") + F.lit(1 << (bits - 1)) if bits < 64 else F.col("code").bitwiseXOR(F.lit(-(1 << 63)))
    rest = states.select(*groups, F.lit(0).cast("long").alias("prefix"), unsigned.alias("u"), "n")
    keys = [*groups, "prefix"]
    goals, shift = None, bits
    while shift > 0:
        shift -= min(digit_bits, shift)
        hist = rest.groupBy(*keys, F.shiftrightunsigned("u", shift).alias("digits")).agg(F.sum("n").alias("n"))
        w = Window.partitionBy(*keys)
        hist = hist.withColumn("upto", F.sum("n").over(w.orderBy("digits").rowsBetween(Window.unboundedPreceding, 0)))
        if goals is None:
            hist = hist.withColumn("total", F.sum("n").over(w))
            rank = lambda p: F.greatest(F.lit(1), F.col("total") - F.floor(F.col("total") - F.col("total") * F.lit(float(p)))).cast("long")
            hist = hist.withColumn("goals", F.array(*[F.struct(F.lit(i).alias("i"), rank(p).alias("rank")) for i, p in enumerate(probs)]))
        else:
            hist = matched(hist, goals, keys)
        inside = F.filter("goals", lambda g: (F.col("upto") - F.col("n") < g["rank"]) & (g["rank"] <= F.col("upto")))
        goals = hist.select(*groups, F.col("digits").alias("prefix"), "total", F.transform(inside, lambda g: F.struct(g["i"].alias("i"), (g["rank"] - F.col("upto") + F.col("n")).alias("rank"))).alias("goals")).where(F.size("goals") > 0)
        if shift > 0:
            narrowed = rest.select(*groups, F.shiftrightunsigned("u", shift).alias("prefix"), "u", "n")
            rest = matched(narrowed, goals.select(*keys), keys, "left_semi")
    code = F.col("prefix") - F.lit(1 << (bits - 1)) if bits < 64 else F.col("prefix").bitwiseXOR(F.lit(-(1 << 63)))
    drop = 52 - mantissa_bits
    t = goals.withColumn("value", order_value(F.shiftleft(code.cast("long"), drop) + F.lit((1 << (drop - 1)) if drop else 0)))
    names = [f"p{round(p * 100):02d}" if round(p * 1000) % 10 == 0 else f"p{round(p * 1000):03d}" for p in probs]
    return t.groupBy(*groups).agg(
        F.max("total").alias("n"), *[F.max(F.when(F.array_contains(F.transform("goals", lambda g: g["i"]), F.lit(i)), F.col("value"))).alias(name) for i, name in enumerate(names)])


def matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join where all keys agree, nulls with nulls; the right side's keys are dropped."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])
