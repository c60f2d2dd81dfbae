"""Queries on evaluations: mapping to patterns, statistics over partitions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.operators import evaluate, inference, ticc
from strandweave.operators.describe import describe
from strandweave.operators.generate import generated_segments
from strandweave.operators.quality import mean_vectors
from strandweave.plans import model_queries as M
from strandweave.plans import views as V
from strandweave.runtime import written
from strandweave.sources import tables as S
from strandweave.streaming.tumbling import replayed_tumbling_mean

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


BY = ["subject_id", "clustering_desc"]


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    r = M._bad_rows(spark, d).select(*BY, "cluster_id", "achieved")
    return mean_vectors(r, [*BY, "cluster_id"], "achieved", "vec").withColumn("vec", F.transform("vec", lambda v: C.r6(v, 3)))


def true_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean correlations of the true clusters of each subject, to three decimals."""
    t = S.labels(spark, d).select("subject_id", F.col("cluster_id").alias("pattern_id"), "achieved").where(F.col("achieved").isNotNull())
    return mean_vectors(t, ["subject_id", "pattern_id"], "achieved", "gt_vec").withColumn("gt_vec", F.transform("gt_vec", lambda v: C.r6(v, 3)))


def _mapping(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.cluster_mapping(_clusters(spark, d), true_means(spark, d), S.patterns(spark, d), BY, ["subject_id"])


def _truth(spark: SparkSession, d: str) -> DataFrame:
    t = S.labels(spark, d).select("subject_id", F.col("cluster_id").alias("pattern_id")).distinct()
    return S.bad_labels(spark, d).select(*BY).distinct().join(t, "subject_id")


_HE = V.half_even("d0")
_MEAN = lambda v: f"[{', '.join(V.r6(f'avg({v}[{i}])', 3) for i in (1, 2, 3))}]"
_ERR = lambda a, b: V.half_even(f"(abs({a}[1]-{b}[1]) + abs({a}[2]-{b}[2]) + abs({a}[3]-{b}[3])) / 3")
_NEAR = lambda a, b: f"list_max(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2]))) <= 1.1::DOUBLE"
_MAP = V.with_(V.SEG, V.BAD, V.PAT, M._BADROWS, f"cl AS (SELECT subject_id, clustering_desc, c AS cluster_id, {_MEAN('v')} AS v FROM r GROUP BY ALL)", f"gm AS (SELECT subject_id, cluster_id AS pattern_id, {_MEAN('achieved')} AS g FROM seg WHERE achieved IS NOT NULL GROUP BY ALL)",
    f"ds AS (SELECT cl.*, pattern_id, g, relaxed, {V.lp('v', 'g', 1)} AS d0 FROM cl JOIN gm USING (subject_id) LEFT JOIN pat USING (pattern_id) WHERE NOT list_contains(list_transform(g, lambda z: isnan(z)), true))",
    f"mp AS (SELECT subject_id, clustering_desc, cluster_id, v, pattern_id, g, {_HE} AS d, {_ERR('v', 'relaxed')} AS mae, {_ERR('g', 'relaxed')} AS gt_mae, {_NEAR('v', 'g')} AS within, {_NEAR('g', 'relaxed')} AS gt_within FROM ds QUALIFY d = min({_HE}) OVER (PARTITION BY subject_id, clustering_desc, cluster_id))")
_TR = ", tr AS (SELECT DISTINCT b.subject_id, b.clustering_desc, s.cluster_id AS pattern_id FROM (SELECT DISTINCT subject_id, clustering_desc FROM bad) b JOIN seg s USING (subject_id))"


@query(_MAP + f" SELECT subject_id, clustering_desc, cluster_id, {M._three('vec', 'v')}, pattern_id, {M._three('gt_vec', 'g')}, d, mae, gt_mae, within, gt_within FROM mp")
def cluster_mapping(spark: SparkSession, d: str) -> DataFrame:
    return M.listed(_mapping(spark, d), "vec", "gt_vec")


_FIRST = ", fm AS (SELECT subject_id, clustering_desc, cluster_id, min_by(mae, pattern_id) AS mae, min_by(gt_mae, pattern_id) AS gt_mae, min(pattern_id) AS pattern_id FROM mp GROUP BY ALL)"


@query(_MAP + _FIRST + " " + " UNION ALL ".join(f"SELECT clustering_desc, '{c}' AS measure, {V.describe(c)} FROM fm GROUP BY ALL" for c in ("mae", "gt_mae")))
def mapped_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of mapped clusters against their relaxed patterns, of results and of the truth, described."""
    e = evaluate.mapping_errors(_mapping(spark, d), BY)
    return describe(e.unpivot(BY, ["mae", "gt_mae"], "measure", "v"), ["clustering_desc", "measure"], "v")


@query(_MAP + _FIRST + f""", rl AS (SELECT bad.* EXCLUDE (cluster_id), fm.pattern_id AS cluster_id FROM bad LEFT JOIN fm USING (subject_id, clustering_desc, cluster_id)), {M._AGREE.replace('FROM bad b', 'FROM rl b')}
SELECT subject_id, clustering_desc, n::BIGINT AS n, agree::BIGINT AS agree, {V.r6('agree / n')} AS jaccard FROM ag""")
def mapped_agreement(spark: SparkSession, d: str) -> DataFrame:
    x = evaluate.relabelled_agreement(S.bad_labels(spark, d), _mapping(spark, d), S.labels(spark, d), ["clustering_desc"])
    return x.withColumn("jaccard", C.r6(C.ratio(F.col("agree"), F.col("n"))))


@query(_MAP + _TR + """, n AS (SELECT subject_id, clustering_desc, count(*) AS n FROM tr GROUP BY ALL), f AS (SELECT subject_id, clustering_desc, count(DISTINCT pattern_id) AS f FROM mp JOIN tr USING (subject_id, clustering_desc, pattern_id) WHERE within GROUP BY ALL),
  k AS (SELECT subject_id, clustering_desc, count(DISTINCT cluster_id) AS k FROM mp GROUP BY ALL), s AS (SELECT * FROM mp QUALIFY count(*) OVER (PARTITION BY subject_id, clustering_desc, cluster_id) = 1), g AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY subject_id, clustering_desc, pattern_id) = 1),
  a AS (SELECT subject_id, clustering_desc, count(*) AS a FROM g WHERE within GROUP BY ALL)
SELECT subject_id, clustering_desc, """ + V.r6("100 * coalesce(f, 0) / n", 3) + " AS discovered, " + V.r6("100 * coalesce(a, 0) / k", 3) + " AS specific FROM n LEFT JOIN k USING (subject_id, clustering_desc) LEFT JOIN f USING (subject_id, clustering_desc) LEFT JOIN a USING (subject_id, clustering_desc)")
def pattern_discovery(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.discovery(_mapping(spark, d), _truth(spark, d), BY)


@query(_MAP + _TR + " SELECT * FROM tr WHERE NOT EXISTS (SELECT 1 FROM mp WHERE mp.subject_id = tr.subject_id AND mp.clustering_desc = tr.clustering_desc AND mp.pattern_id = tr.pattern_id AND mp.within)")
def patterns_missed(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.missed(_mapping(spark, d), _truth(spark, d), BY).select(*BY, "pattern_id")


@query(V.with_(V.SEG, V.BAD) + f"SELECT b.subject_id, b.clustering_desc, {V.r6('b.n / t.n')} AS count_ratio, {V.r6('b.l / t.l')} AS length_ratio FROM (SELECT subject_id, clustering_desc, count(*) AS n, quantile_cont(length, 0.5) AS l FROM bad GROUP BY ALL) b JOIN (SELECT subject_id, count(*) AS n, quantile_cont(length, 0.5) AS l FROM seg GROUP BY ALL) t USING (subject_id)")
def segmentation_ratios(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.segmentation_ratios(S.bad_labels(spark, d), S.labels(spark, d), BY, ["subject_id"])


# ---- statistics over partitions
_SUM = M.ORACLES["partition_summary"].replace("SELECT sm.*, n_wrong", ", su AS (SELECT sm.*, n_wrong", 1) + ")"
_SUM = _SUM.replace(" , su AS", ", su AS")


@query(_SUM + f""", st AS (SELECT *, regexp_extract(clustering_desc, '^(.*)-[0-9]+$', 1) AS strategy FROM su) """ + " UNION ALL ".join(f"SELECT strategy, '{c}' AS measure, {V.describe(f'{c}::DOUBLE')} FROM st GROUP BY ALL" for c in ("jaccard", "swc", "mae", "n_wrong", "n_shifted")))
def benchmark_summary(spark: SparkSession, d: str) -> DataFrame:
    s = M.summary(spark, d).withColumn("strategy", F.regexp_extract("clustering_desc", "^(.*)-[0-9]+$", 1))
    names = ("jaccard", "swc", "mae", "n_wrong", "n_shifted")
    return describe(s.select("strategy", *[F.col(c).cast("double").alias(c) for c in names]).unpivot("strategy", list(names), "measure", "v"), ["strategy", "measure"], "v")


def _corr_sql(c: str) -> str:
    return f"SELECT subject_id, '{c}' AS index, count(*) AS n, CASE WHEN var_pop({c}) <= 1e-18 AND var_pop(jaccard) <= 1e-18 THEN 1.0::DOUBLE WHEN var_pop({c}) <= 1e-18 OR var_pop(jaccard) <= 1e-18 THEN 0.0::DOUBLE ELSE {V.r6(f'covar_pop({c}, jaccard) / sqrt(var_pop({c}) * var_pop(jaccard))', 3)} END AS r FROM (SELECT subject_id, {c}::DOUBLE AS {c}, jaccard FROM su2 WHERE {c} IS NOT NULL AND jaccard IS NOT NULL) GROUP BY ALL"


INDICES = ("swc", "mae", "n_outside", "dbi", "vrc", "pbm")
#: CTEs that end in `ix(subject_id, index, n, r)`.
_INDEX = V.with_(V.OBS_F) + _SUM.replace("WITH ", ", ", 1) + ", " + M._ALLROWS.split("), allb AS", 1)[1].join(["allb AS", ""]) + ", " + M._centres_sql("ar", ("l1",)).replace("ix AS (", "ci1 AS (") + f""",
  su2 AS (SELECT su.*, dbi, vrc, pbm FROM su LEFT JOIN ci1 USING (subject_id, clustering_desc)), ix AS ({' UNION ALL '.join(_corr_sql(c) for c in INDICES)})"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    """Internal indices against Jaccard."""
    b = written(S.bad_labels(spark, d))
    s = M.summary(spark, d, b).join(M.centroid_quality(spark, d, b, ("l1",)).drop("measure"), BY, "left")
    return written(inference.index_correlations(s, ["subject_id"], list(INDICES), "jaccard"))


@query(_INDEX + " SELECT * FROM ix")
def index_against_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d)


@query(_INDEX + f" SELECT *, round(CASE WHEN isnan(r) OR n < 3 THEN 1 WHEN abs(r) >= 1 THEN 0 ELSE {V.t_two_sided('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)')} END, 6) AS p FROM ix")
def index_p_values(spark: SparkSession, d: str) -> DataFrame:
    return inference.with_p(_index(spark, d))


_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, x.z - y.z AS d FROM z x JOIN z y USING (subject_id) WHERE x.index = '{a}' AND y.index = '{b}' AND isfinite(x.z - y.z)" for a, b in combinations(sorted(INDICES), 2))


@query(_INDEX + f", z AS (SELECT subject_id, index, CASE WHEN r = 1 THEN 'inf'::DOUBLE WHEN r = -1 THEN '-inf'::DOUBLE ELSE atanh(r) END AS z FROM ix), df AS ({_PAIRS}), ag2 AS (SELECT a, b, count(*) AS n, avg(d) AS mean, stddev_samp(d) AS std FROM df GROUP BY ALL) SELECT a, b, n, {V.r6('mean')} AS mean, {V.r6('std')} AS std, {V.r6('mean / std * sqrt(n)')} AS t, {V.r6('mean / std')} AS cohens_d FROM ag2")
def fisher_paired_t(spark: SparkSession, d: str) -> DataFrame:
    return inference.paired_differences(_index(spark, d), "subject_id", "index", "r")


@query()
def fisher_paired_t_tested(spark: SparkSession, d: str) -> DataFrame:
    return inference.tested(fisher_paired_t(spark, d))


@query(_INDEX + f""", ms AS (SELECT index AS label, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s FROM ix GROUP BY 1), md AS (SELECT a.label AS a, b.label AS b, a.m - b.m AS diff, sqrt(a.s**2 / a.n + b.s**2 / b.n) AS se FROM ms a JOIN ms b ON a.label < b.label)
SELECT a, b, {V.r6('diff')} AS difference, {V.r6('diff - 1.959964 * se')} AS lo, {V.r6('diff + 1.959964 * se')} AS hi, CASE WHEN diff - 1.959964 * se <= 0 AND diff + 1.959964 * se >= 0 THEN 'overlap' WHEN diff < 0 THEN 'lower' ELSE 'higher' END AS relation, {V.r6('diff / se')} AS standardised FROM md""")
def mean_difference_intervals(spark: SparkSession, d: str) -> DataFrame:
    return inference.mean_difference_intervals(_index(spark, d), "index", "r")


@query()
def signed_rank_tests(spark: SparkSession, d: str) -> DataFrame:
    return inference.signed_rank_tests(_index(spark, d), "subject_id", "index", "r")


@query(_SUM + ", bw AS (SELECT subject_id, max_by(swc, (jaccard, clustering_desc)) AS best, min_by(swc, (jaccard, clustering_desc)) AS worst FROM su WHERE swc IS NOT NULL AND jaccard IS NOT NULL GROUP BY 1)" + f" SELECT {V.r6('avg(best)')} AS best_mean, {V.r6('stddev_pop(best)')} AS best_sd, {V.r6('avg(worst)')} AS worst_mean, {V.r6('stddev_pop(worst)')} AS worst_sd, count(*) AS n FROM bw")
def best_and_worst_partition(spark: SparkSession, d: str) -> DataFrame:
    s = M.summary(spark, d).where("swc is not null and jaccard is not null")
    x = s.groupBy("subject_id").agg(F.max_by("swc", F.struct("jaccard", "clustering_desc")).alias("best"), F.min_by("swc", F.struct("jaccard", "clustering_desc")).alias("worst"))
    return x.agg(*[C.r6(f(c)).alias(f"{c}_{n}") for c in ("best", "worst") for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))], F.count(F.lit(1)).alias("n"))


@query(_SUM + ", st AS (SELECT subject_id, regexp_extract(clustering_desc, '^(.*)-[0-9]+$', 1) AS strategy, jaccard FROM su) " + f"SELECT subject_id, {', '.join(V.r6(f'''avg(jaccard) FILTER (WHERE strategy = '{s}')''') + f' AS {s.replace('-', '_')}' for s in ('shifted-and-wrong-cluster', 'shifted-end-idx', 'wrong-clusters'))} FROM st GROUP BY 1")
def jaccard_by_strategy(spark: SparkSession, d: str) -> DataFrame:
    s = M.summary(spark, d).withColumn("strategy", F.regexp_replace(F.regexp_extract("clustering_desc", "^(.*)-[0-9]+$", 1), "-", "_"))
    return s.groupBy("subject_id").pivot("strategy", ["shifted_and_wrong_cluster", "shifted_end_idx", "wrong_clusters"]).agg(C.r6(F.avg("jaccard")))


# ---- generation, clustering, streaming
@query()
def generated_series(spark: SparkSession, d: str) -> DataFrame:
    return generated_segments(spark, S.patterns_to_model(spark, d), n_subjects=4, n_segments=24, seed=66)


def _ticc_model(obs: DataFrame) -> ticc.Model:
    """The settings of the reference."""
    return ticc.fit(obs, clusters=23, window=5, sparsity=0.11, penalty=400.0, iterations=10)


@query()
def ticc_predicted(spark: SparkSession, d: str) -> DataFrame:
    """A model fitted on all subjects, applied to all subjects."""
    o = M.complete(spark, d).select("subject_id", "obs_idx", *S.VARIATES)
    return ticc.predict(o, _ticc_model(o), S.VARIATES)


@query()
def ticc_model_edges(spark: SparkSession, d: str) -> DataFrame:
    o = M.complete(spark, d).select("subject_id", "obs_idx", *S.VARIATES)
    return ticc.edges(spark, _ticc_model(o))


@query()
def ticc_centralities(spark: SparkSession, d: str) -> DataFrame:
    return ticc.centralities(ticc_model_edges(spark, d))


@query(V.with_(V.OBS) + "SELECT subject_id, us // 3600000000 * 3600 AS bucket, round(avg(ig) + 1e-9, 6) AS ig, count(*) AS n FROM obs WHERE us IS NOT NULL AND ig IS NOT NULL GROUP BY ALL")
def streamed_hourly_mean(spark: SparkSession, d: str) -> DataFrame:
    o = written(S.observations(spark, d, ("ig",)).where("us is not null").select("subject_id", F.timestamp_micros("us").alias("ts"), "ig"))
    return replayed_tumbling_mean(spark, o, "ig", "1 hour")


