"""Evaluation of distance measures: level sets, distances to patterns, criteria, ranks, nearest patterns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.columns import histogram_bin, interval_relation, minus, r6, ratio, total
from strandweave.functions.numeric import adjusted_critical
from strandweave.operators.quality import block_distances
from strandweave.runtime import scratch, written

MEASURES = ("l1", "l2", "l3", "l5", "l10", "l50", "l100", "linf", "l1_ref", "l2_ref", "l3_ref", "l5_ref", "l10_ref", "l50_ref", "l100_ref", "linf_ref", "l1_dot", "l2_dot", "linf_dot", "cosine")
#: With those that SQL can't express.
RANKED = (*MEASURES, "log_frobenius", "foerstner")
#: Whether a low value of a criterion is good.
LOW_IS_GOOD = {"level0_mean": True, "all_lower": False, "rate": False, "entropy": False, "level_entropy": True, "f1": False}


def level_sets(patterns: DataFrame) -> DataFrame:
    """`px, py, level` for px <= py: the level is the summed, rounded difference of the canonical vectors. For catalogues of fixed size."""
    a = patterns.select(F.col("pattern_id").alias("px"), F.col("canonical").alias("a"))
    b = patterns.select(F.col("pattern_id").alias("py"), F.col("canonical").alias("b"))
    x = a.join(F.broadcast(b), F.col("px") <= F.col("py"))
    return x.select("px", "py", total(F.transform(minus(F.col("a"), F.col("b")), lambda v: F.bround(v, 0))).cast("int").alias("level"))


def pattern_distances(labels: DataFrame, patterns: DataFrame, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """`subject_id, segment_id, cluster_id, pattern_id, level, measure, d`: every segment against every pattern of the (fixed, small) catalogue.

    Segments whose cluster is not in the catalogue are left out; a null or incomplete vector has null
    distances. All measures of a batch are computed at once as matrices: expressions on arrays would be
    interpreted element by element.
    """
    rows = patterns.select("pattern_id", "canonical", "relaxed").orderBy("pattern_id").collect()  # the catalogue: 27 rows at most
    ids = np.array([r["pattern_id"] for r in rows])
    relaxed, canonical = (np.array([r[c] for r in rows], float).reshape(len(rows), -1) for c in ("relaxed", "canonical"))
    levels = np.rint(np.abs(canonical[:, None] - canonical[None])).sum(2).astype(int)
    place = {int(v): i for i, v in enumerate(ids)}
    names = ["subject_id", "segment_id", "cluster_id", "pattern_id", "level", "measure", "d"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["cluster_id"].isin(place.keys())]
            if not len(f):
                continue
            whole = np.array([v is not None and len(v) == relaxed.shape[1] and not any(x is None for x in v) for v in f["achieved"]])
            a = np.full((len(f), relaxed.shape[1]), np.nan)
            if whole.any():
                a[whole] = np.array([np.asarray(v, float) for v in f["achieved"][whole]])
            n = len(ids)
            base = {c: np.repeat(f[c].to_numpy(), n) for c in names[:3]}
            level = levels[[place[int(c)] for c in f["cluster_id"]]].ravel()
            for m in measures:
                yield pd.DataFrame({**base, "pattern_id": np.tile(ids, len(f)), "level": level, "measure": m, "d": block_distances(a, relaxed, m).ravel(), "_ok": np.repeat(whole, n)})

    tasks = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a row becomes hundreds: small inputs must not end in one task
    x = labels.select("subject_id", "segment_id", F.col("cluster_id").cast("int"), "achieved").repartition(tasks, "subject_id", "segment_id").mapInPandas(run, "subject_id string, segment_id int, cluster_id int, pattern_id int, level int, measure string, d double, _ok boolean")
    return x.select(*names[:-1], r6(F.when(F.col("_ok"), F.coalesce("d", F.lit(float("nan"))))).alias("d"))  # Arrow gives NaN back as null


def normalised(distances: DataFrame, by: list[str], few: bool = False) -> DataFrame:
    """Distances scaled to [0, 1] per measure by its extremes (a small table), to three decimals. `few`: a row per measure, broadcast, so that distances aren't shuffled."""
    ext = distances.where("not isnan(d)").groupBy(*by).agg(F.min("d").alias("_a"), F.max("d").alias("_b"))
    return distances.join(F.broadcast(ext) if few else ext, by).withColumn("d", r6(F.coalesce(ratio(F.col("d") - F.col("_a"), F.col("_b") - F.col("_a")), F.lit(0.0)), 3)).drop("_a", "_b")


def level_statistics(distances: DataFrame, by: list[str]) -> DataFrame:
    """As `describe` of normalised distances by level. They have three decimals, so that they are counted first: at most a thousand values of each group are ever sorted."""
    return counted_description(distances.groupBy(*by, "level", "d").agg(F.count(F.lit(1)).alias("n")), [*by, "level"], 3)


def counted_description(counts: DataFrame, by: list[str], digits: int = 6) -> DataFrame:
    """As `describe`, of values `d` that occur `n` times each. A group of different values must fit a task."""
    w = Window.partitionBy(*by)
    ok = F.col("d").isNotNull() & ~F.isnan("d")
    x = counts.withColumn("n", F.when(ok, F.col("n")).otherwise(0)).withColumn("d", F.when(ok, F.col("d")))
    x = x.withColumn("_all", F.sum("n").over(w)).withColumn("_m", F.try_divide(F.sum(F.col("n") * F.col("d")).over(w), F.col("_all")))
    x = x.withColumn("_upto", F.sum("n").over(w.orderBy(F.asc_nulls_first("d")).rowsBetween(Window.unboundedPreceding, 0)))
    rank = lambda p: 1 + F.lit(p) * (F.col("_all") - 1)
    at = lambda r: F.max(F.when((F.col("_upto") - F.col("n") < r) & (r <= F.col("_upto")), F.col("d")))
    shares = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))
    g = x.groupBy(*by).agg(
        F.sum("n").alias("count"), F.max("_all").alias("_all"), F.max("_m").alias("mean"), F.sum(F.col("n") * (F.col("d") - F.col("_m")) * (F.col("d") - F.col("_m"))).alias("_q"), F.min("d").alias("min"), F.max("d").alias("max"),
        *[a for c, p in shares for a in (at(F.floor(rank(p))).alias(f"_l{c}"), at(F.ceil(rank(p))).alias(f"_h{c}"))])
    line = lambda c, p: F.col(f"_l{c}") + (F.col(f"_h{c}") - F.col(f"_l{c}")) * (rank(p) - F.floor(rank(p)))
    return g.select(*by, "count", r6(F.col("mean"), digits).alias("mean"), r6(F.sqrt(F.try_divide("_q", F.col("count") - 1)), digits).alias("std"), r6(F.col("min"), digits).alias("min"),
                    *[r6(line(c, p), digits).alias(c) for c, p in shares], r6(F.col("max"), digits).alias("max"))


def level_intervals(stats: DataFrame, by: list[str], alpha: float = 0.05, n_levels: int = 6) -> DataFrame:
    """For each level and the next: difference of means, its interval at the adjusted level, and how it lies to 0."""
    z = adjusted_critical(alpha, n_levels - 1)
    w = Window.partitionBy(*by).orderBy("level")
    x = stats.select(*by, "level", *[F.col(c) for c in ("count", "mean", "std")], *[F.lead(c).over(w).alias(f"n_{c}") for c in ("level", "count", "mean", "std")]).where("n_level is not null")
    diff = F.col("mean") - F.col("n_mean")
    se = F.sqrt(F.coalesce(F.col("std"), F.lit(0.0)) ** 2 / F.col("count") + F.coalesce(F.col("n_std"), F.lit(0.0)) ** 2 / F.col("n_count"))
    return x.select(*by, "level", F.col("n_level").alias("next_level"), r6(diff).alias("difference"), r6(diff - z * se).alias("lo"), r6(diff + z * se).alias("hi"),
                    interval_relation(diff - z * se, diff + z * se).alias("relation"), r6(F.abs(diff)).alias("rate"))


def nearest_patterns(distances: DataFrame, by: list[str]) -> DataFrame:
    """For each segment and measure the nearest pattern, ties to the smaller id: 1-nearest-neighbour prediction."""
    best = F.min(F.struct(F.col("d"), F.col("pattern_id")))
    keys = list(dict.fromkeys([*by, "subject_id", "segment_id", "cluster_id"]))
    return distances.where("not isnan(d)").groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.pattern_id").alias("predicted"), F.col("b.d").alias("d"))


def classification_scores(predicted: DataFrame, by: list[str], truth: str = "cluster_id", guess: str = "predicted") -> DataFrame:
    """Accuracy and macro precision, recall and F1 over the union of labels; an undefined ratio counts as 0."""
    c = predicted.groupBy(*by, truth, guess).agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(*by, F.explode(F.array(
        F.struct(F.col(truth).alias("k"), F.lit(1).alias("t"), F.lit(0).alias("p"), F.col(truth).eqNullSafe(F.col(guess)).cast("int").alias("hit")),
        F.struct(F.col(guess).alias("k"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("s"), "n")
    k = sides.groupBy(*by, "s.k").agg(*[F.sum(F.col(f"s.{x}") * F.col("n")).alias(x) for x in ("t", "p", "hit")])
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    k = k.withColumn("precision", zero(F.col("hit"), F.col("p"))).withColumn("recall", zero(F.col("hit"), F.col("t"))).withColumn("f1", zero(2 * F.col("hit"), F.col("t") + F.col("p")))
    return k.groupBy(*by).agg(r6(F.sum("hit") / F.sum("t")).alias("accuracy"), *[r6(F.avg(x)).alias(x) for x in ("precision", "recall", "f1")])


def level_counts(distances: DataFrame, by: list[str]) -> DataFrame:
    """`<by>, level, d, n`: how often each normalised distance (three decimals, so few values) occurs, NaN left out."""
    return normalised(distances, by).where("not isnan(d)").groupBy(*by, "level", "d").agg(F.count(F.lit(1)).alias("n"))


def counted_entropy(counts: DataFrame, by: list[str], bins: int = 50) -> DataFrame:
    """As `describe.entropy` on [0, 1], from counted values."""
    h = counts.withColumn("bin", histogram_bin(F.col("d"), 0.0, 1.0, bins)).where("bin is not null").groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    t = h.groupBy(*by).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return t.select(*by, r6(F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


def counted_moments(counts: DataFrame, by: list[str], digits: int = 3) -> DataFrame:
    """`<by>, level, count, mean, std` from counted values."""
    s = counts.groupBy(*by, "level").agg(F.sum("n").alias("count"), F.sum(F.col("n") * F.col("d")).alias("s"), F.sum(F.col("n") * F.col("d") * F.col("d")).alias("q"))
    var = F.try_divide(F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("count")), F.col("count") - 1)
    return s.select(*by, "level", "count", r6(F.col("s") / F.col("count"), digits).alias("mean"), r6(F.sqrt(var), digits).alias("std"))


def criteria(distances: DataFrame, by: list[str]) -> DataFrame:
    """`<by>, criterion, value`: mean of level 0, whether every level lies below the next (1 or 0), rate of increase, entropies, macro F1, number of NaN and infinite distances.

    `distances` is read three times: write it first. Everything but F1 comes from counted values, a
    table whose size does not depend on the number of rows.
    """
    counts = level_counts(distances, by)
    with scratch(counts) as counts:
        one = lambda df, name, c: df.select(*by, F.lit(name).alias("criterion"), c.cast("double").alias("value"))
        stats = counted_moments(counts, by)
        level_e = counted_entropy(counts, [*by, "level"]).groupBy(*by).agg(r6(F.avg("entropy")).alias("v"))
        between = level_intervals(stats, by).groupBy(*by).agg(r6(F.avg("rate")).alias("rate"), F.bool_and(F.col("relation") == "lower").cast("int").alias("lower"))
        odd = distances.groupBy(*by).agg(F.count_if(F.isnan("d") | (F.abs("d") == float("inf"))).alias("v"))
        parts = [one(stats.where("level = 0"), "level0_mean", F.col("mean")), one(between, "all_lower", F.col("lower")), one(between, "rate", F.col("rate")), one(counted_entropy(counts, by), "entropy", F.col("entropy")),
                 one(level_e, "level_entropy", F.col("v")), one(classification_scores(nearest_patterns(distances, by), by), "f1", F.col("f1")), one(odd, "odd", F.col("v"))]
        return written(reduce(DataFrame.unionByName, parts))


def ranks(criteria_: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Dense rank of the measures per criterion, by each criterion's direction; `odd` is not ranked."""
    by = by or []
    sign = F.when(F.col("criterion").isin([c for c, low in LOW_IS_GOOD.items() if low]), F.col("value")).otherwise(-F.col("value"))
    x = criteria_.where(F.col("criterion").isin(list(LOW_IS_GOOD)))
    return x.withColumn("rank", F.dense_rank().over(Window.partitionBy(*by, "criterion").orderBy(sign)))


def best_labels(ranked: DataFrame, by: list[str], value: str = "rank", label: str = "measure") -> DataFrame:
    """The labels of the lowest value of each group, joined by commas in order of name."""
    low = ranked.groupBy(*by).agg(F.min(value).alias("_m"))
    x = ranked.join(low, by).where(F.col(value) == F.col("_m"))
    return x.groupBy(*by).agg(F.array_join(F.sort_array(F.collect_list(label)), ",").alias("best"))


def top_and_bottom(df: DataFrame, value: Column, label: str, x: int) -> DataFrame:
    """The x lowest and x highest labels, ties by name, each joined by commas. For tables of one row per label."""
    a = df.select(F.struct(value.alias("v"), F.col(label).alias("l")).alias("s")).agg(F.sort_array(F.collect_list("s")).alias("s"))
    names = lambda s: F.array_join(F.transform(s, lambda y: y["l"]), ",")
    return a.select(names(F.slice("s", 1, x)).alias("top"), names(F.reverse(F.slice("s", -F.least(F.size("s"), F.lit(x)), x))).alias("bottom"))
