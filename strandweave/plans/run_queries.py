"""Queries that treat each subject as a run of its own: criteria and ranks of measures over runs, distributions, clusterer results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions.columns import r6
from strandweave.operators import correlation, distributions, inference, measures, quality, segments, ticc
from strandweave.operators.describe import describe
from strandweave.plans import evaluation_queries as E
from strandweave.plans import model_queries as M
from strandweave.plans import views as V
from strandweave.runtime import scratch, written
from strandweave.sources import tables as S
from strandweave.sources.tables import VARIATES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


RUN = ["subject_id"]


def run_ranks(spark: SparkSession, d: str, names: tuple[str, ...] = measures.RANKED) -> DataFrame:
    """`subject_id, measure, criterion, value, rank`: criteria of the measures for each subject by itself, ranked within it."""
    x = measures.pattern_distances(S.labels(spark, d), S.patterns_to_model(spark, d), names)
    with scratch(x) as x:
        return written(measures.ranks(measures.criteria(x, [*RUN, "measure"]), RUN))


@query()
def criteria_by_run(spark: SparkSession, d: str) -> DataFrame:
    return run_ranks(spark, d)


# the same of the measures that SQL can express: SQL that groups by measure groups by run too where the run stands in the measure's name
_RUNS = V.with_(V.SEG, V.PAT, M._pattern_sql(measures.MEASURES).replace("pd AS (", "pd0 AS (")) + ", pd AS (SELECT * REPLACE (subject_id || '|' || measure AS measure) FROM pd0)" + M._RANK.replace("OVER (PARTITION BY criterion ORDER", "OVER (PARTITION BY split_part(measure, '|', 1), criterion ORDER")
_RUNS += ", rr AS (SELECT split_part(measure, '|', 1) AS subject_id, split_part(measure, '|', 2) AS measure, criterion, value, rank FROM rn)"


@query(_RUNS + " SELECT * FROM rr")
def column_criteria_by_run(spark: SparkSession, d: str) -> DataFrame:
    return run_ranks(spark, d, measures.MEASURES)


@query(_RUNS + f" SELECT criterion, measure, {V.r6('quantile_cont(value, 0.5)', 3)} AS median FROM rr GROUP BY ALL")
def column_median_criteria(spark: SparkSession, d: str) -> DataFrame:
    return _medians(run_ranks(spark, d, measures.MEASURES))


@query(_RUNS + f", ra AS (SELECT criterion, measure, rank::DOUBLE AS rank FROM rr UNION ALL SELECT 'average', measure, avg(rank) FROM rr GROUP BY subject_id, measure) SELECT criterion, measure, {V.describe('rank', 3)} FROM ra GROUP BY ALL")
def column_rank_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _rank_statistics(run_ranks(spark, d, measures.MEASURES))


@query(_RUNS + ", nb AS (SELECT criterion, measure, count(*) AS n_best FROM rr WHERE rank = 1 GROUP BY ALL) SELECT criterion, n_best, string_agg(measure, ',' ORDER BY measure) AS measures FROM nb WHERE n_best = (SELECT max(n_best) FROM nb o WHERE o.criterion = nb.criterion) GROUP BY ALL")
def most_frequent_best_column_measures(spark: SparkSession, d: str) -> DataFrame:
    return _most_frequent(run_ranks(spark, d, measures.MEASURES))


@query()
def median_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Median over runs of each criterion and measure; yes and no count as 1 and 0."""
    return _medians(run_ranks(spark, d))


def _medians(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("criterion", "measure").agg(r6(F.percentile("value", 0.5), 3).alias("median"))


@query()
def rank_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of each criterion and measure, and average ranks of each measure, described over runs."""
    return _rank_statistics(run_ranks(spark, d))


def _rank_statistics(r: DataFrame) -> DataFrame:
    average = r.groupBy(*RUN, "measure").agg(F.avg("rank").alias("rank")).withColumn("criterion", F.lit("average"))
    return describe(r.select("criterion", "measure", F.col("rank").cast("double").alias("rank")).unionByName(average.select("criterion", "measure", "rank")), ["criterion", "measure"], "rank", 3)


@query()
def most_frequent_best_measures(spark: SparkSession, d: str) -> DataFrame:
    """For each criterion the measures that are best in most runs, ties kept, and in how many."""
    return _most_frequent(run_ranks(spark, d))


def _most_frequent(ranks: DataFrame) -> DataFrame:
    n = ranks.where("rank = 1").groupBy("criterion", "measure").agg(F.count(F.lit(1)).alias("n_best"))
    most = n.groupBy("criterion").agg(F.max("n_best").alias("n_best"))
    return n.join(most, ["criterion", "n_best"]).groupBy("criterion", "n_best").agg(F.array_join(F.sort_array(F.collect_list("measure")), ",").alias("measures"))


@query()
def best_and_worst_for_criterion(spark: SparkSession, d: str) -> DataFrame:
    """Median ranks, a row per measure and a column per criterion, with the best and the worst measure of each in its own row."""
    r = run_ranks(spark, d).groupBy("criterion", "measure").agg(F.percentile("rank", 0.5).alias("median"))
    return r.groupBy("criterion").agg(F.min_by("measure", F.struct("median", "measure")).alias("best"), F.min("median").alias("best_rank"), F.max_by("measure", F.struct("median", "measure")).alias("worst"), F.max("median").alias("worst_rank"))


@query()
def measures_compared_by_average_rank(spark: SparkSession, d: str) -> DataFrame:
    """Wilcoxon tests of all pairs of measures on their average ranks over runs; differences up to 0.001 count as none."""
    a = run_ranks(spark, d).groupBy(*RUN, "measure").agg(F.avg("rank").alias("rank"))
    return inference.signed_rank_tests(a, "subject_id", "measure", "rank", non_zero=0.001)


# ---- distributions
@query()
def fitted_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Families of distributions fitted to the finite values of each variate of each subject, best first."""
    return distributions.fitted(_values(spark, d), ["subject_id", "variate"], "value")


@query()
def best_distributions(spark: SparkSession, d: str) -> DataFrame:
    return distributions.best(fitted_distributions(spark, d), ["subject_id", "variate"])


@query()
def distribution_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Median, least and greatest of the fitted parameters over subjects."""
    x = fitted_distributions(spark, d).where("success").unpivot(["variate", "family"], ["shape", "loc", "scale"], "parameter", "v").where("v is not null")
    return x.groupBy("variate", "family", "parameter").agg(r6(F.percentile("v", 0.5), 4).alias("median"), r6(F.min("v"), 4).alias("least"), r6(F.max("v"), 4).alias("greatest"))


@query()
def quantile_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the data beside those of the best distribution, at 99 shares."""
    return distributions.quantile_pairs(_values(spark, d), best_distributions(spark, d), ["subject_id", "variate"], "value")


def _values(spark: SparkSession, d: str) -> DataFrame:
    return S.observations(spark, d).unpivot(["subject_id"], list(VARIATES), "variate", "value").where("value is not null")


# ---- clusterer results
@query()
def ticc_labels(spark: SparkSession, d: str) -> DataFrame:
    """The clusterer's assignment as labels: runs of equal cluster with bounds and the rank correlations of their observations."""
    o = written(M.complete(spark, d))
    p = ticc.predict(o.select("subject_id", "obs_idx", *VARIATES), E._ticc_model(o.select("subject_id", "obs_idx", *VARIATES)), VARIATES)
    return M.listed(clusterer_labels(written(p), o), "achieved")


def clusterer_labels(assigned: DataFrame, obs: DataFrame) -> DataFrame:
    """`subject_id, segment_id, cluster_id, start_idx, end_idx, length, achieved` from `subject_id, obs_idx, cluster`."""
    runs = segments.runs_to_segments(assigned, ["subject_id"], ["obs_idx"], "cluster", "obs_idx", F.floor(F.col("obs_idx") / 8192)).withColumnRenamed("value", "cluster_id")
    v = correlation.spearman(segments.interval_join(obs, runs.select("subject_id", "segment_id", "start_idx", "end_idx")), ["subject_id", "segment_id"], VARIATES)
    return runs.join(v.select("subject_id", "segment_id", F.col("correlation").alias("achieved")), ["subject_id", "segment_id"], "left")


def evaluated(labels: DataFrame, truth: DataFrame, true_means: DataFrame, patterns: DataFrame) -> DataFrame:
    """`subject_id, discovered, specific, jaccard, swc, mean_mae, count_ratio` of a clusterer's labels against the truth."""
    from strandweave.operators import evaluate
    by = ["subject_id"]
    ok = M.usable(labels)
    means = quality.mean_vectors(ok.select(*by, "cluster_id", "achieved"), [*by, "cluster_id"], "achieved", "vec").withColumn("vec", F.transform("vec", lambda v: r6(v, 3)))
    m = written(evaluate.cluster_mapping(means, true_means, patterns, by, by))
    found = evaluate.discovery(m, truth.select("subject_id", F.col("cluster_id").alias("pattern_id")).distinct(), by)
    ag = evaluate.relabelled_agreement(labels, m, truth, []).select("subject_id", r6(F.try_divide(F.col("agree").cast("double"), F.col("n")), 3).alias("jaccard"))
    s = quality.silhouette_index(ok, by, "segment_id", "cluster_id", "achieved")
    e = evaluate.mapping_errors(m, by).groupBy(*by).agg(r6(F.avg("mae"), 3).alias("mean_mae"))
    ratio = evaluate.segmentation_ratios(labels, truth, by, by).select("subject_id", "count_ratio")
    out = found
    for part in (ag, s, e, ratio):
        out = out.join(part, by, "left")
    return out


_RESULTS = f"""SELECT x.subject_id || ':' || x.clustering_desc AS subject_id, discovered, specific, {V.r6('y.agree / y.n', 3)} AS jaccard, swc, mean_mae, count_ratio
FROM ({E.ORACLES['pattern_discovery']}) x LEFT JOIN ({E.ORACLES['mapped_agreement']}) y USING (subject_id, clustering_desc) LEFT JOIN ({M.ORACLES['silhouette_by_partition']}) z USING (subject_id, clustering_desc)
LEFT JOIN ({E._MAP + E._FIRST} SELECT subject_id, clustering_desc, {V.r6('avg(mae)', 3)} AS mean_mae FROM fm GROUP BY ALL) m USING (subject_id, clustering_desc) LEFT JOIN ({E.ORACLES['segmentation_ratios']}) q USING (subject_id, clustering_desc)"""


@query(_RESULTS)
def partitions_as_results(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation of a clusterer's result, of the degraded partitions taken as results of as many runs."""
    b = S.bad_labels(spark, d)
    name = F.concat_ws(":", "subject_id", "clustering_desc")
    t = S.labels(spark, d)
    runs = b.select("subject_id", "clustering_desc").distinct()
    of = lambda df: df.join(runs, "subject_id").withColumn("subject_id", name).drop("clustering_desc")
    return evaluated(written(b.withColumn("subject_id", name).drop("clustering_desc")), written(of(t)), written(of(E.true_means(spark, d))), S.patterns(spark, d))


@query()
def ticc_temporal_centralities(spark: SparkSession, d: str) -> DataFrame:
    """Centralities of the model's nodes with the clusters as steps of time, by step and over all."""
    return ticc.temporal_centralities(E.ticc_model_edges(spark, d))


