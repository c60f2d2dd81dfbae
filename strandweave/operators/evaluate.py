"""Evaluation of a clustering against the patterns: mapping, discovery, specificity, ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.columns import close_to, distance, mean_abs_error, r6, ratio
from strandweave.operators.quality import agreement


def cluster_mapping(clusters: DataFrame, truth: DataFrame, patterns: DataFrame, by: list[str], on: list[str], measure: str = "l1", tolerance: float = 0.1) -> DataFrame:
    """Each result cluster with its nearest true clusters, all ties kept.

    `clusters` has `<by>, cluster_id, vec` (mean correlations of a result cluster's segments), `truth`
    has `<on>, pattern_id, gt_vec` (those of the true clusters), `patterns` the catalogue. Result:
    `<by>, cluster_id, vec, pattern_id, gt_vec, d, mae, gt_mae, within, gt_within`: the distance
    (rounded to three decimals first, which makes ties), the errors of the result's and of the true
    cluster's vector against the relaxed pattern, and whether the result lies within tolerance of the
    true cluster, and that of its pattern. The tolerance is the lenient one of the published figures.
    True clusters are patterns, so few; vectors with missing or NaN elements map to nothing.
    """
    ok = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v))
    all_ = truth.where(ok("gt_vec")).join(patterns.select("pattern_id", "relaxed"), "pattern_id", "left")
    x = clusters.where(ok("vec")).join(all_, on).withColumn("d", F.bround(F.round(distance(measure)(F.col("vec"), F.col("gt_vec")), 9), 3))
    least = x.withColumn("_m", F.min("d").over(Window.partitionBy(*by, "cluster_id"))).where(F.col("d") == F.col("_m"))
    vec, gt, relaxed = F.col("vec"), F.col("gt_vec"), F.col("relaxed")
    return least.select(*by, "cluster_id", "vec", "pattern_id", "gt_vec", "d", mean_abs_error(vec, relaxed).alias("mae"), mean_abs_error(gt, relaxed).alias("gt_mae"),
                        close_to(vec, gt, tolerance).alias("within"), close_to(gt, relaxed, tolerance).alias("gt_within"))


def mapping_errors(mapping: DataFrame, by: list[str]) -> DataFrame:
    """`<by>, cluster_id, mae, gt_mae`: the errors of each result cluster's first nearest true cluster, in order of id."""
    return mapping.groupBy(*by, "cluster_id").agg(F.min_by("mae", "pattern_id").alias("mae"), F.min_by("gt_mae", "pattern_id").alias("gt_mae"))


def relabelled_agreement(segments: DataFrame, mapping: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Agreement of a clusterer's result with the truth, each result cluster read as its first nearest true cluster: `subject_id, <by>, n, agree`."""
    first = mapping.groupBy("subject_id", *by, "cluster_id").agg(F.min("pattern_id").alias("_p"))
    x = segments.join(first, ["subject_id", *by, "cluster_id"], "left").withColumn("cluster_id", F.col("_p"))
    return agreement(truth, x, by)


def discovery(mapping: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """`<by>, discovered, specific`: percentages of true patterns found, and of result clusters that alone map to one pattern alone.

    `truth` has `<by>, pattern_id`, each once. Percentages are rounded to three decimals.
    """
    n = truth.groupBy(*by).agg(F.count_distinct("pattern_id").alias("n_truth"))
    found = mapping.where("within").select(*by, "pattern_id").distinct().join(truth, [*by, "pattern_id"], "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n_found"))
    k = mapping.groupBy(*by).agg(F.count_distinct("cluster_id").alias("k"))
    single = mapping.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "cluster_id"))).where("_n = 1")
    alone = single.withColumn("_g", F.count(F.lit(1)).over(Window.partitionBy(*by, "pattern_id"))).where("_g = 1 and within").groupBy(*by).agg(F.count(F.lit(1)).alias("n_alone"))
    x = n.join(k, by, "left").join(found, by, "left").join(alone, by, "left").na.fill(0, ["n_found", "n_alone"])
    return x.select(*by, r6(100 * ratio(F.col("n_found"), F.col("n_truth")), 3).alias("discovered"), r6(100 * ratio(F.col("n_alone"), F.col("k")), 3).alias("specific"))


def missed(mapping: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """True patterns that no result cluster maps to within tolerance."""
    return truth.join(mapping.where("within"), [*by, "pattern_id"], "left_anti")


def segmentation_ratios(result: DataFrame, truth: DataFrame, by: list[str], on: list[str]) -> DataFrame:
    """`<by>, count_ratio, length_ratio`: segments of the result to those of the truth, and their median lengths."""
    agg = lambda df, keys, p: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{p}n"), F.percentile("length", 0.5).alias(f"{p}l"))
    x = agg(result, by, "r").join(agg(truth, on, "t"), on)
    return x.select(*by, r6(ratio(F.col("rn"), F.col("tn"))).alias("count_ratio"), r6(ratio(F.col("rl"), F.col("tl"))).alias("length_ratio"))
