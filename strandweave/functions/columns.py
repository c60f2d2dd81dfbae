"""Column builders: correlation vectors, distances, errors, rounding. All stay in the JVM.

A correlation vector is the upper triangle of a correlation matrix, row by row. Null vectors give
null; vectors of unequal length give null elements and so null results.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, with ties pushed up, so that engines agree."""
    return F.round(c + 1e-9, digits)


def vector(text: Column | str) -> Column:
    """`array<double>` of a list or tuple text; an unreadable element is null, a null or empty text is null."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(c, r"[\[\]()\s]", "")
    return F.when(bare != "", F.transform(F.split(bare, ","), lambda x: x.try_cast("double")))


def flags(text: Column | str) -> Column:
    """`array<boolean>` of a list text of True and False."""
    c = F.col(text) if isinstance(text, str) else text
    bare = F.lower(F.regexp_replace(c, r"[\[\]()\s]", ""))
    return F.when(bare != "", F.transform(F.split(bare, ","), lambda x: x.try_cast("boolean")))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def lp(a: Column, b: Column, p: float) -> Column:
    """Minkowski distance; the largest difference is factored out, so large p don't underflow."""
    d = minus(a, b)
    if p == 1:
        return total(d)
    most = F.array_max(d)
    if math.isinf(p):
        return most
    return F.when(most == 0, 0.0).otherwise(most * F.pow(total(F.transform(d, lambda x: F.pow(x / most, F.lit(float(p))))), F.lit(1.0 / p)))


def reference(a: Column) -> Column:
    """The vector of the same length with norm 1 and equal elements."""
    return F.transform(a, lambda _: 1.0 / F.sqrt(F.size(a).cast("double")))


def lp_ref(a: Column, b: Column, p: float) -> Column:
    """Minkowski distance times the two vectors' distances from the reference vector."""
    return lp(a, b, p) * (lp(a, reference(a), p) + lp(b, reference(b), p))


def dotted(a: Column) -> Column:
    """The vector with its projection on the reference vector, scaled to [0, 1], as one more element."""
    return F.concat(a, F.array((total(a) / F.sqrt(F.size(a).cast("double")) + 1) / 2))


def lp_dot(a: Column, b: Column, p: float) -> Column:
    return lp(dotted(a), dotted(b), p)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity (sic, it serves as a measure among the distances); NaN for a null vector."""
    norms = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(norms == 0, float("nan")).otherwise(F.try_divide(total(F.zip_with(a, b, lambda x, y: x * y)), norms))


DISTANCES: dict[str, Callable[[Column, Column], Column]] = {
    **{f"l{n}": (lambda a, b, p=p: lp(a, b, p)) for n, p in (("1", 1), ("2", 2), ("3", 3), ("5", 5), ("10", 10), ("50", 50), ("100", 100), ("inf", math.inf))},
    **{f"l{n}_ref": (lambda a, b, p=p: lp_ref(a, b, p)) for n, p in (("1", 1), ("2", 2), ("3", 3), ("5", 5), ("10", 10), ("50", 50), ("100", 100), ("inf", math.inf))},
    **{f"l{n}_dot": (lambda a, b, p=p: lp_dot(a, b, p)) for n, p in (("1", 1), ("2", 2), ("inf", math.inf))},
    "cosine": cosine,
}


def distance(name: str) -> Callable[[Column, Column], Column]:
    """A measure by name. The two matrix measures run in Arrow batches, all others in the JVM."""
    from strandweave.functions.matrices import MATRIX

    known = DISTANCES | MATRIX
    if name not in known:
        raise ValueError(f"unknown distance {name}; one of {', '.join(known)}")
    return known[name]


def trunc3(c: Column) -> Column:
    """Cut to three decimals towards zero, so that 0.9999 never becomes 1; NaN stays."""
    x = F.round(c, 9)
    return F.when(F.isnan(c), c).otherwise(F.signum(x) * F.floor(F.round(F.abs(x) * 1000, 6)) / 1000)


def mean_abs_error(a: Column, b: Column) -> Column:
    """Half-even rounded to three decimals."""
    return F.bround(F.round(total(minus(a, b)) / F.size(a), 9), 3)


def within_strength(model: Column, achieved: Column, strong: float = 0.7, weak: float = 0.2) -> Column:
    """Per element: strong stays strong, absent stays absent; anything between is False; signs don't count."""
    return F.zip_with(model, achieved, lambda m, a: F.when(F.abs(m) >= strong, F.abs(a) >= strong).when(F.abs(m) <= weak, F.abs(a) <= weak).otherwise(F.lit(False)))


def all_true(a: Column) -> Column:
    return F.coalesce(F.forall(a, lambda x: x), F.lit(False))


def close_to(a: Column, b: Column, tolerance: float, lenient: bool = True) -> Column:
    """All differences within the tolerance; the lenient form, which published figures use, adds 1 to it."""
    return F.forall(minus(a, b), lambda d: d <= tolerance + (1.0 if lenient else 0.0))


def psd3(v: Column) -> Column:
    """Whether a vector of three makes a positive semi-definite matrix: entries within 1, determinant not negative."""
    a, b, c = (F.element_at(v, i) for i in (1, 2, 3))
    inside = reduce(Column.__and__, [F.abs(x) <= 1 + 1e-10 for x in (a, b, c)])
    return inside & (1 + 2 * a * b * c - (a * a + b * b + c * c) >= -1e-10)


def triangle(v: Column) -> Column:
    """1 + abc >= (a2 + b2 + c2) / 2: weaker than psd3."""
    a, b, c = (F.element_at(v, i) for i in (1, 2, 3))
    return 1 + a * b * c >= (a * a + b * b + c * c) / 2


def two_strong(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: F.abs(x) == 1)) == 2


def relaxed(v: Column) -> Column:
    """A vector of three with exactly two strong elements (of size 1): the first strong one by 0.71, the second by 0.70; null for others."""
    a, b, c = (F.element_at(v, i) for i in (1, 2, 3))
    strong = lambda x: F.abs(x) == 1
    out = F.array(F.when(strong(a), 0.71 * a).otherwise(a), F.when(strong(b), F.when(strong(a), 0.70).otherwise(0.71) * b).otherwise(b), F.when(strong(c), 0.70 * c).otherwise(c))
    return F.when(two_strong(v), F.transform(out, lambda x: F.round(x, 6)))


def histogram_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """0-based bin of n equal bins on [lo, hi]; hi falls in the last; outside and non-finite values in none."""
    return F.when((x >= lo) & (x <= hi), F.least(F.floor((x - lo) / ((hi - lo) / n)), F.lit(n - 1)))


def fisher_z(r: Column) -> Column:
    """atanh, infinite at -1 and 1."""
    return F.when(r == 1, float("inf")).when(r == -1, float("-inf")).otherwise(F.atanh(r))


def interval_relation(lo: Column, hi: Column) -> Column:
    return F.when(F.isnan(lo) | F.isnan(hi), None).when((lo <= 0) & (hi >= 0), "overlap").when(hi < 0, "lower").when(lo > 0, "higher")


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with whole degrees of freedom (at least 1), by the finite series of the angle atan(t / sqrt(df))."""
    angle = F.atan(F.abs(t) / F.sqrt(df.cast("double")))
    c, s, odd = F.cos(angle), F.sin(angle), df % 2
    terms = F.floor((df - odd) / 2).cast("int")
    start = F.struct(F.lit(0.0).alias("sum"), F.when(odd == 1, c).otherwise(F.lit(1.0)).alias("term"))

    def step(a: Column, j: Column) -> Column:
        k = 2.0 * j
        return F.struct((a["sum"] + a["term"]).alias("sum"), (a["term"] * c * c * F.when(odd == 1, k / (k + 1)).otherwise((k - 1) / k)).alias("term"))

    series = F.when(terms > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(terms, F.lit(1))), start, step, lambda a: a["sum"])).otherwise(0.0)
    inside = F.when(odd == 1, (angle + s * series) * (2 / math.pi)).otherwise(s * series)
    return F.greatest(F.lit(0.0), 1 - inside)
