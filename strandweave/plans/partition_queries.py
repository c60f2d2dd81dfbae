"""Queries on whole benchmarks: degraded partitions made and described, indices by measure ranked and compared, sets, shares and errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.functions import names as N
from strandweave.operators import assess, correlation, measures, quality, segments
from strandweave.operators.describe import describe, exact_percentiles
from strandweave.plans import model_queries as M
from strandweave.plans import views as V
from strandweave.runtime import table, written
from strandweave.sources import tables as S
from strandweave.sources.tables import VARIATES

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BY = M.BY


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


# ---- description of partitions, truth first
_AGREE_ALL = M._AGREE.replace("FROM bad b", "FROM allb b")
_DESCRIBED = (
    M._ALL + ", " + M._centres_sql("ar", ("l1",)) + ", " + _AGREE_ALL + ", " + M._silhouette_sql("ar", "subject_id, clustering_desc", V.lp("a.v", "b.v", 1))
    + """, sm AS (SELECT subject_id, clustering_desc, count(DISTINCT cluster_id) AS n_patterns, count(*) AS n_segments, sum(length)::BIGINT AS n_observations, """ + V.r6("avg(relaxed_mae)", 3) + """ AS mae,
    count(*) FILTER (WHERE NOT coalesce(within[1] AND within[2] AND within[3], false)) AS n_outside FROM allb GROUP BY ALL),
  wr AS (SELECT b.subject_id, b.clustering_desc, count(*) FILTER (WHERE b.cluster_id IS DISTINCT FROM s.cluster_id) AS n_wrong, max(CASE WHEN b.segment_id = 0 THEN b.end_idx - s.end_idx END) AS n_shifted FROM allb b JOIN seg s USING (subject_id, segment_id) GROUP BY ALL),
  de AS (SELECT sm.*, n_wrong, n_shifted, """ + V.r6("agree / n", 3) + """ AS jaccard, round(swc, 3) AS swc, dbi, vrc, pbm FROM sm LEFT JOIN wr USING (subject_id, clustering_desc) LEFT JOIN ag USING (subject_id, clustering_desc)
    LEFT JOIN sw USING (subject_id, clustering_desc) LEFT JOIN ix USING (subject_id, clustering_desc))""")


@query(_DESCRIBED + " SELECT *, (row_number() OVER (PARTITION BY subject_id ORDER BY clustering_desc = 'truth' DESC, jaccard DESC NULLS LAST, clustering_desc))::INT AS place FROM de")
def partition_description(spark: SparkSession, d: str) -> DataFrame:
    """The truth and every degraded partition of each subject: counts, errors, agreement and all four indices by L1, in order of agreement, the truth first."""
    return described(spark, d)


def described(spark: SparkSession, d: str) -> DataFrame:
    p = written(M.all_partitions(spark, d))
    t = S.labels(spark, d)
    sm = p.groupBy(*BY).agg(F.count_distinct("cluster_id").alias("n_patterns"), F.count(F.lit(1)).alias("n_segments"), F.sum("length").alias("n_observations"), C.r6(F.avg("relaxed_mae"), 3).alias("mae"), F.count_if(~C.all_true(F.col("within"))).alias("n_outside"))
    truth = t.select("subject_id", "segment_id", F.col("cluster_id").alias("_c"), F.col("end_idx").alias("_e"))
    wr = p.join(truth, ["subject_id", "segment_id"]).groupBy(*BY).agg(F.count_if(~F.col("cluster_id").eqNullSafe(F.col("_c"))).alias("n_wrong"), F.max(F.when(F.col("segment_id") == 0, F.col("end_idx") - F.col("_e"))).alias("n_shifted"))
    ag = quality.agreement(t, p, ["clustering_desc"]).select(*BY, C.r6(C.ratio(F.col("agree"), F.col("n")), 3).alias("jaccard"))
    sw = quality.silhouette_index(M.usable(p), BY, "segment_id", "cluster_id", "achieved", "l1").withColumn("swc", F.round("swc", 3))
    ix = M.centroid_quality(spark, d, p, ("l1",)).drop("measure")
    x = sm
    for part in (wr, ag, sw, ix):
        x = x.join(part, BY, "left")
    w = Window.partitionBy("subject_id").orderBy(F.desc(F.col("clustering_desc") == M.TRUTH), F.desc_nulls_last("jaccard"), "clustering_desc")
    return x.withColumn("place", F.row_number().over(w))


_WORST = " AS (SELECT subject_id, max(swc) FILTER (WHERE clustering_desc = 'truth') AS gt, min_by(swc, (jaccard, clustering_desc)) AS worst FROM de WHERE jaccard IS NOT NULL AND swc IS NOT NULL GROUP BY 1)"


@query(_DESCRIBED + f""", tw{_WORST}, g AS (SELECT count(*) AS n, avg(gt) AS m1, stddev_pop(gt) AS s1, avg(worst) AS m2, stddev_pop(worst) AS s2 FROM tw WHERE gt IS NOT NULL AND worst IS NOT NULL), h AS (SELECT *, sqrt(s1**2 / n + s2**2 / n) AS se FROM g)
SELECT n, {', '.join(V.r6(c) + f' AS {a}' for c, a in (('m1', 'truth_mean'), ('s1', 'truth_sd'), ('m2', 'worst_mean'), ('s2', 'worst_sd'), ('(m1 - m2) / se', 'effect_size'), ('m1 - m2 - 1.96 * se', 'lo'), ('m1 - m2 + 1.96 * se', 'hi')))} FROM h""")
def truth_against_worst(spark: SparkSession, d: str) -> DataFrame:
    """Silhouettes of the truth and of the partition that agrees least, over subjects: means, deviations, standardised difference and its interval."""
    x = described(spark, d).where("jaccard is not null and swc is not null")
    return assess.truth_and_worst(x, "subject_id", "clustering_desc", M.TRUTH, "swc", "jaccard")


# ---- degraded partitions, made anew
LEAVE, MADE = 100, 22


def _counts_sql(most: str, name: str) -> str:
    """Per subject `n`: at most 21 numbers below `most`, by hash, and `most`, ascending, numbered from 0."""
    return f"""{name}0 AS (SELECT subject_id, {most} AS most FROM seg GROUP BY 1), {name}1 AS (SELECT subject_id, most, unnest(generate_series(1, most - 1)) AS v FROM {name}0 WHERE most > 1),
  {name}2 AS (SELECT subject_id, v FROM {name}1 QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY (v * 7919) % 10007, v) <= {MADE - 1} UNION ALL SELECT subject_id, most FROM {name}0),
  {name} AS (SELECT subject_id, v::BIGINT AS v, row_number() OVER (PARTITION BY subject_id ORDER BY v) - 1 AS p FROM {name}2)"""


_MADE = V.with_(V.OBS_F, V.SEG, V.PAT, _counts_sql("count(*)", "ns"), _counts_sql(f"greatest(min(length) - {LEAVE}, {LEAVE})", "no"),
    """sp AS (SELECT subject_id, 'wrong-clusters-' || p AS clustering_desc, p, v AS k, 0 AS s FROM ns UNION ALL SELECT subject_id, 'shifted-end-idx-' || p, p, 0, v FROM no UNION ALL SELECT subject_id, 'shifted-and-wrong-cluster-' || p, p, ns.v, no.v FROM ns JOIN no USING (subject_id, p))""",
    "cl AS (SELECT list_sort(list(DISTINCT cluster_id)) AS l FROM seg)",
    """f AS (SELECT subject_id, clustering_desc, segment_id, start_idx, end_idx, cluster_id, p, k, s, max(end_idx) OVER w2 AS n, row_number() OVER w = 1 AS first, lead(segment_id) OVER w IS NULL AS last,
      row_number() OVER (PARTITION BY subject_id, clustering_desc ORDER BY ((segment_id + 1)::BIGINT * 7919 + p * 104729) % 10007, segment_id) AS h
    FROM seg JOIN sp USING (subject_id) WINDOW w AS (PARTITION BY subject_id, clustering_desc ORDER BY start_idx, end_idx, segment_id), w2 AS (PARTITION BY subject_id, clustering_desc))""",
    """g AS (SELECT * EXCLUDE (start_idx, end_idx, cluster_id, last), CASE WHEN first THEN start_idx ELSE start_idx + s END AS start_idx, CASE WHEN last THEN end_idx ELSE least(end_idx + s, n) END AS end_idx,
      CASE WHEN h <= k AND list_position(l, cluster_id) IS NOT NULL AND len(l) > 1 THEN l[((list_position(l, cluster_id) - 1 + 1 + ((segment_id + 1)::BIGINT * 7919 + p * 31) % 10007 % (len(l) - 1)) % len(l) + 1)::BIGINT] ELSE cluster_id END AS cluster_id FROM f, cl)""",
    "k2 AS (SELECT *, lead(segment_id) OVER (PARTITION BY subject_id, clustering_desc ORDER BY start_idx, end_idx, segment_id) IS NULL AS last FROM g WHERE first OR start_idx <= n - 3)",
    "dp AS (SELECT subject_id, clustering_desc, segment_id, cluster_id, start_idx::BIGINT AS start_idx, (CASE WHEN last THEN n ELSE end_idx END)::BIGINT AS end_idx FROM k2)",
    "j AS (SELECT d.subject_id, d.clustering_desc, d.segment_id, o.iob, o.cob, o.ig FROM dp d JOIN obsf o ON o.subject_id = d.subject_id AND o.obs_idx BETWEEN d.start_idx AND d.end_idx)",
    V.spearman("j", "subject_id, clustering_desc, segment_id"), f"v AS (SELECT subject_id, clustering_desc, segment_id, {V.CORR} AS v FROM corr)")


@query(_MADE + f"""SELECT dp.*, end_idx - start_idx + 1 AS length, {M._three('model', 'canonical')}, {M._three('achieved', 'v')},
  {', '.join(f"CASE WHEN abs(canonical[{i}]) >= 0.7 THEN abs(v[{i}]) >= 0.7 WHEN abs(canonical[{i}]) <= 0.2 THEN abs(v[{i}]) <= 0.2 ELSE false END AS within_{i}" for i in (1, 2, 3))},
  round_even(round((abs(v[1]-canonical[1]) + abs(v[2]-canonical[2]) + abs(v[3]-canonical[3])) / 3, 9), 3) AS mae, round_even(round((abs(v[1]-relaxed[1]) + abs(v[2]-relaxed[2]) + abs(v[3]-relaxed[3])) / 3, 9), 3) AS relaxed_mae
FROM dp LEFT JOIN v USING (subject_id, clustering_desc, segment_id) LEFT JOIN pat ON pat.pattern_id = dp.cluster_id""")
def degraded_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Three strategies of up to 22 partitions for each subject, labels refreshed from the data: model, achieved correlations, tolerance and errors."""
    x = segments.degraded(S.labels(spark, d).select("subject_id", "segment_id", "start_idx", "end_idx", "cluster_id", "length"), MADE, LEAVE)
    return M.listed(refreshed(written(x), M.complete(spark, d), S.patterns(spark, d)), "model", "achieved", "within")


def refreshed(labels: DataFrame, obs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Labels with `model`, `achieved`, `within`, `mae` and `relaxed_mae` taken anew from cluster and data."""
    key = ["subject_id", "clustering_desc", "segment_id"]
    v = correlation.spearman(segments.interval_join(obs, labels.select(*key, "start_idx", "end_idx")), key, VARIATES).select(*key, F.col("correlation").alias("achieved"))
    x = labels.join(v, key, "left").join(F.broadcast(patterns.select(F.col("pattern_id").alias("cluster_id"), F.col("canonical").alias("model"), "relaxed")), "cluster_id", "left")  # the catalogue, 27 rows
    a, m = F.col("achieved"), F.col("model")
    return x.select(*key, "cluster_id", "start_idx", "end_idx", "length", "model", "achieved", C.within_strength(m, a).alias("within"), C.mean_abs_error(a, m).alias("mae"), C.mean_abs_error(a, F.col("relaxed")).alias("relaxed_mae"))


# ---- indices by measure: correlations, ranks, groups
_QM = M._quality_sql(M.QUALITY)
_QM = _QM[: _QM.rindex(" SELECT sw.*")]
_TRUTHS = _QM + ", tq AS (SELECT subject_id, sw.measure, u.index, u.value FROM sw LEFT JOIN ix USING (subject_id, clustering_desc, measure), LATERAL (SELECT unnest(['swc', 'dbi', 'vrc', 'pbm']) AS index, unnest([round(swc, 3), round(dbi, 3), round(vrc, 3), round(pbm, 3)]) AS value) u WHERE clustering_desc = 'truth' AND u.value IS NOT NULL)"
_RANKS = _TRUTHS + ", tr0 AS (SELECT *, (dense_rank() OVER (PARTITION BY subject_id, index ORDER BY CASE WHEN index = 'dbi' THEN value ELSE -value END))::INT AS rank FROM tq)"
_GROUPS = _RANKS + ", mr AS (SELECT index, measure, quantile_cont(rank::DOUBLE, 0.5) AS median FROM tr0 GROUP BY ALL), gr AS (SELECT index, measure, (dense_rank() OVER (PARTITION BY index ORDER BY median))::INT AS grp FROM mr)"


def truth_values(spark: SparkSession, d: str) -> DataFrame:
    """`subject_id, measure, index, value` of the true segmentations, to three decimals."""
    t = S.labels(spark, d).withColumn("clustering_desc", F.lit(M.TRUTH))
    s = quality.silhouettes_by_measure(M.usable(t), BY, "segment_id", "cluster_id", "achieved", M.QUALITY).join(M.centroid_quality(spark, d, t, M.QUALITY), [*BY, "measure"], "left")
    return s.unpivot(["subject_id", "measure"], ["swc", "dbi", "vrc", "pbm"], "index", "value").where("value is not null").withColumn("value", F.round("value", 3))


@query(_RANKS + " SELECT * FROM tr0")
def measure_ranks_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Dense rank of the measures for each subject and index of the truth; a low DBI is good, of the others a high value."""
    return assess.ranked_by_index(truth_values(spark, d), "subject_id")


@query(_RANKS + f" SELECT index, measure, 'rank' AS kind, {V.describe('rank::DOUBLE', 3)} FROM tr0 GROUP BY ALL UNION ALL SELECT index, measure, 'value' AS kind, {V.describe('value', 3)} FROM tr0 GROUP BY ALL")
def measure_rank_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Ranks and raw values of each index and measure, described over subjects."""
    r = measure_ranks_by_index(spark, d).withColumn("rank", F.col("rank").cast("double")).unpivot(["index", "measure"], ["rank", "value"], "kind", "v")
    return describe(r, ["index", "measure", "kind"], "v", 3)


@query(_GROUPS + " SELECT index, grp, string_agg(measure, ',' ORDER BY measure) AS measures FROM gr GROUP BY ALL")
def measure_groups_by_index(spark: SparkSession, d: str) -> DataFrame:
    """Measures of equal median rank as one group, numbered from the best."""
    return assess.grouped(measure_ranks_by_index(spark, d)).groupBy("index", "grp").agg(F.array_join(F.sort_array(F.collect_list("measure")), ",").alias("measures"))


@query()
def measure_groups_tested(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank tests within the best group and of it against the next ones, until a whole group is significantly worse."""
    return assess.stepwise_signed_ranks(measure_ranks_by_index(spark, d), "subject_id")


@query(_QM + f""", {_AGREE_ALL}, qj AS (SELECT sw.*, {V.r6('agree / n')} AS jaccard FROM sw JOIN ag USING (subject_id, clustering_desc) WHERE clustering_desc <> 'truth'),
  rr AS (SELECT subject_id, measure, CASE WHEN var_pop(swc) <= 1e-18 AND var_pop(jaccard) <= 1e-18 THEN 1.0::DOUBLE WHEN var_pop(swc) <= 1e-18 OR var_pop(jaccard) <= 1e-18 THEN 0.0::DOUBLE ELSE {V.r6('covar_pop(swc, jaccard) / sqrt(var_pop(swc) * var_pop(jaccard))', 3)} END AS r FROM qj WHERE swc IS NOT NULL GROUP BY ALL)
SELECT subject_id, {', '.join(f"max(r) FILTER (WHERE measure = '{m}') AS {m}" for m in M.QUALITY)} FROM rr GROUP BY 1""")
def silhouette_correlations_by_measure(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of the silhouette with the agreement, a column for each measure: what the measure changes."""
    p = written(S.bad_labels(spark, d))
    s = quality.silhouettes_by_measure(M.usable(p), BY, "segment_id", "cluster_id", "achieved", M.QUALITY)
    ag = quality.agreement(S.labels(spark, d), p, ["clustering_desc"]).select(*BY, C.r6(C.ratio(F.col("agree"), F.col("n"))).alias("jaccard"))
    from strandweave.operators.inference import index_correlations
    r = index_correlations(s.join(ag, BY), ["subject_id", "measure"], ["swc"], "jaccard")
    return r.groupBy("subject_id").pivot("measure", list(M.QUALITY)).agg(F.max("r"))


# ---- sets, order, errors
@query(V.with_(V.SEG, V.BAD) + """, r AS (SELECT DISTINCT subject_id, clustering_desc, cluster_id FROM bad WHERE cluster_id IS NOT NULL), t AS (SELECT DISTINCT d.subject_id, d.clustering_desc, s.cluster_id FROM (SELECT DISTINCT subject_id, clustering_desc FROM bad) d JOIN seg s USING (subject_id)),
  b AS (SELECT subject_id, clustering_desc, cluster_id, r.cluster_id IS NOT NULL AND t.cluster_id IS NOT NULL AS both FROM r FULL JOIN t USING (subject_id, clustering_desc, cluster_id)),
  z AS (SELECT b.subject_id, b.clustering_desc, EXISTS (SELECT 1 FROM r WHERE r.subject_id = b.subject_id AND r.clustering_desc = b.clustering_desc AND r.cluster_id = b.cluster_id) AS i, EXISTS (SELECT 1 FROM t WHERE t.subject_id = b.subject_id AND t.clustering_desc = b.clustering_desc AND t.cluster_id = b.cluster_id) AS j FROM b)
SELECT subject_id, clustering_desc, count(*) FILTER (WHERE i AND j) AS n_shared, count(*) FILTER (WHERE i AND NOT j) AS n_only_result, count(*) FILTER (WHERE j AND NOT i) AS n_only_truth FROM z GROUP BY ALL""")
def cluster_set_differences(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that a partition shares with the truth (intersection), has beyond it, and lacks (differences)."""
    b = S.bad_labels(spark, d)
    r = b.where("cluster_id is not null").select(*BY, "cluster_id").distinct().withColumn("i", F.lit(True))
    t = b.select(*BY).distinct().join(S.labels(spark, d).select("subject_id", "cluster_id").distinct(), "subject_id").withColumn("j", F.lit(True))
    x = r.join(t, [*BY, "cluster_id"], "full").na.fill(False, ["i", "j"])
    return x.groupBy(*BY).agg(F.count_if(F.col("i") & F.col("j")).alias("n_shared"), F.count_if(F.col("i") & ~F.col("j")).alias("n_only_result"), F.count_if(~F.col("i") & F.col("j")).alias("n_only_truth"))


@query(V.with_(V.SEG) + "SELECT subject_id, cluster_id, (row_number() OVER (PARTITION BY subject_id ORDER BY s, cluster_id))::INT AS place FROM (SELECT subject_id, cluster_id, min(start_idx) AS s FROM seg GROUP BY ALL)")
def patterns_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The different patterns of a subject in order of their first appearance."""
    x = S.labels(spark, d).groupBy("subject_id", "cluster_id").agg(F.min("start_idx").alias("s"))
    return x.select("subject_id", "cluster_id", F.row_number().over(Window.partitionBy("subject_id").orderBy("s", "cluster_id")).alias("place"))


_ERR = V.with_(V.SEG, f"e AS (SELECT subject_id, cluster_id, {V.r6('avg(relaxed_mae)', 3)} AS e FROM seg WHERE relaxed_mae IS NOT NULL GROUP BY ALL), m AS (SELECT subject_id, min(e) AS lo, max(e) AS hi, avg(e) AS mid FROM e GROUP BY 1)")


@query(_ERR + """SELECT subject_id, string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) FILTER (WHERE e = 0) AS zero, string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) FILTER (WHERE e = lo) AS least, string_agg(cluster_id::VARCHAR, ',' ORDER BY cluster_id) FILTER (WHERE e = hi) AS most,
  count(*) FILTER (WHERE e <= mid + 1e-9) AS n_to_mean, count(*) FILTER (WHERE e > mid + 1e-9) AS n_above_mean FROM e JOIN m USING (subject_id) GROUP BY 1""")
def error_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of each subject without error, with the least and the greatest, and how many lie up to and above the mean."""
    e = S.labels(spark, d).where("relaxed_mae is not null").groupBy("subject_id", "cluster_id").agg(C.r6(F.avg("relaxed_mae"), 3).alias("e"))
    m = e.groupBy("subject_id").agg(F.min("e").alias("lo"), F.max("e").alias("hi"), F.avg("e").alias("mid"))
    x = e.join(m, "subject_id")
    ids = lambda on: F.nullif(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(on, F.col("cluster_id")))), lambda v: v.cast("string")), ","), F.lit(""))
    return x.groupBy("subject_id").agg(ids(F.col("e") == 0).alias("zero"), ids(F.col("e") == F.col("lo")).alias("least"), ids(F.col("e") == F.col("hi")).alias("most"), F.count_if(F.col("e") <= F.col("mid") + 1e-9).alias("n_to_mean"), F.count_if(F.col("e") > F.col("mid") + 1e-9).alias("n_above_mean"))


@query(V.with_(V.SEG, "o AS (SELECT subject_id, cluster_id, count(*) FILTER (WHERE NOT coalesce(within[1] AND within[2] AND within[3], false))::DOUBLE AS n FROM seg GROUP BY ALL)") + f"SELECT cluster_id, {V.describe('n')} FROM o GROUP BY 1")
def outside_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Segments outside tolerance of each pattern, described over subjects."""
    x = S.labels(spark, d).groupBy("subject_id", "cluster_id").agg(F.count_if(~C.all_true(F.col("within"))).cast("double").alias("n"))
    return describe(x, ["cluster_id"], "n")


_VARIANT = "v AS (SELECT DISTINCT subject_id, coalesce(stage, 'none') AS stage, completeness FROM subjects)"


@query(V.with_(V.SEG, _VARIANT, "m AS (SELECT subject_id, avg(mae) AS mae, avg(relaxed_mae) AS relaxed_mae, avg(length) AS length, count(*)::DOUBLE AS segments, count(DISTINCT cluster_id)::DOUBLE AS patterns, count(*) FILTER (WHERE NOT coalesce(within[1] AND within[2] AND within[3], false))::DOUBLE AS outside FROM seg GROUP BY 1)")
       + " UNION ALL ".join(f"SELECT stage, completeness, '{c}' AS measure, {V.describe(c)} FROM m JOIN v USING (subject_id) GROUP BY ALL" for c in ("mae", "relaxed_mae", "length", "segments", "patterns", "outside")))
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    """The figures of subjects described for every variant of the data, side by side in one table."""
    v = table(spark, d, "subjects").select("subject_id", F.coalesce("stage", F.lit("none")).alias("stage"), "completeness").distinct()
    m = S.labels(spark, d).groupBy("subject_id").agg(F.avg("mae").alias("mae"), F.avg("relaxed_mae").alias("relaxed_mae"), F.avg("length").alias("length"), F.count(F.lit(1)).cast("double").alias("segments"),
                                                    F.count_distinct("cluster_id").cast("double").alias("patterns"), F.count_if(~C.all_true(F.col("within"))).cast("double").alias("outside"))
    names = [c for c in m.columns if c != "subject_id"]
    return describe(m.join(v, "subject_id").unpivot(["stage", "completeness"], names, "measure", "value"), ["stage", "completeness", "measure"], "value")


# ---- time
@query(V.with_(V.OBS, "g AS (SELECT subject_id, (us - lag(us) OVER (PARTITION BY subject_id ORDER BY us, obs_idx)) / 1e6::DOUBLE AS gap_s FROM obs WHERE us IS NOT NULL)", "m AS (SELECT subject_id, quantile_cont(gap_s, 0.5) AS step FROM g WHERE gap_s IS NOT NULL GROUP BY 1)")
       + f"SELECT subject_id, {V.r6('step')} AS step_s, CASE WHEN step >= 86400 THEN floor(step / 86400)::BIGINT || 'D' WHEN step >= 3600 THEN floor(step / 3600)::BIGINT || 'h' WHEN step >= 60 THEN floor(step / 60)::BIGINT || 'min' ELSE floor(step)::BIGINT || 's' END AS code FROM m")
def frequency_codes(spark: SparkSession, d: str) -> DataFrame:
    """The median time step of each subject and its code: whole days, hours, minutes or seconds."""
    g = exact_percentiles(segments.time_gaps(S.observations(spark, d)), ["subject_id"], "gap_s", (0.5,)).select("subject_id", F.get("q", F.lit(0)).alias("step"))
    return g.select("subject_id", C.r6(F.col("step")).alias("step_s"), N.frequency_code(F.col("step")).alias("code"))


def _daily(seconds: int) -> str:
    from strandweave.plans.variant_queries import _windows
    return _windows(seconds, 7200)


@query(_daily(86400))
def daily_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Days without inner gaps over two hours."""
    from strandweave.plans.variant_queries import _aggregated
    return _aggregated(spark, d, 86400, 7200)


_OVER = M.ORACLES["overlap_argmax"]


@query(_OVER.replace("SELECT subject_id, bucket, segment_id, shared FROM n QUALIFY", ", b AS (SELECT subject_id, bucket, segment_id, shared FROM n QUALIFY") + f"""), tm AS ({M.ORACLES['tumbling_minute_mean'].split(') SELECT', 1)[1].join(['SELECT', ''])}),
  j AS (SELECT b.subject_id, b.segment_id, tm.iob, tm.cob, tm.ig FROM b JOIN tm USING (subject_id, bucket) WHERE tm.iob IS NOT NULL AND tm.cob IS NOT NULL AND tm.ig IS NOT NULL), {V.spearman('j', 'subject_id, segment_id')} SELECT subject_id, segment_id, n, {M._three('correlation', V.CORR)} FROM corr""")
def resampled_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlations of segments over minute means, each minute in the segment that shares most of it."""
    t = segments.tumbling_mean(S.observations(spark, d), 60, VARIATES).where(" and ".join(f"{v} is not null" for v in VARIATES))
    x = t.join(M._bucket_segments(spark, d), ["subject_id", "bucket"])
    return M.listed(correlation.spearman(x, ["subject_id", "segment_id"], VARIATES), "correlation")


# ---- runs
@query(M.ORACLES["runs_to_segments"].replace("SELECT user_id,", "WITH s AS (SELECT user_id,", 1) + f""") SELECT user_id, value, count(*) AS times_used, sum(length)::BIGINT AS n_observations, {V.r6('avg(length)', 3)} AS mean_length, min(length) AS min_length, max(length) AS max_length, count(*) FILTER (WHERE length = 1) AS n_of_one FROM s GROUP BY ALL""")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    """How often each value forms a run, with the lengths of its runs."""
    return segments.run_summary(M.runs_to_segments(spark, d), ["user_id"])


# ---- sequences of two groups of subjects
_SEQ = V.with_(V.SEG, "q AS (SELECT subject_id, cluster_id, length, row_number() OVER (PARTITION BY subject_id ORDER BY start_idx, segment_id) AS i FROM seg)", "sn AS (SELECT subject_id, row_number() OVER (ORDER BY subject_id) AS k FROM (SELECT DISTINCT subject_id FROM seg))",
    "pr AS (SELECT a.subject_id, b.subject_id AS other_id, x.i, x.length AS u, y.length AS v FROM sn a JOIN sn b ON b.k = a.k + 1 JOIN q x ON x.subject_id = a.subject_id JOIN q y ON y.subject_id = b.subject_id AND y.i = x.i)",
    "rk AS (SELECT subject_id, other_id, rank() OVER (PARTITION BY subject_id ORDER BY u) + (count(*) OVER (PARTITION BY subject_id, u) - 1) / 2.0::DOUBLE AS u, rank() OVER (PARTITION BY subject_id ORDER BY v) + (count(*) OVER (PARTITION BY subject_id, v) - 1) / 2.0::DOUBLE AS v FROM pr)",
    f"co AS (SELECT subject_id, other_id, count(*) AS n, CASE WHEN var_pop(u) > 0 AND var_pop(v) > 0 THEN {V.r6('covar_pop(u, v) / sqrt(var_pop(u) * var_pop(v))')} ELSE 'nan'::DOUBLE END AS r FROM rk GROUP BY ALL)")


@query(_SEQ + f"SELECT *, round(CASE WHEN isnan(r) OR n < 3 THEN 1 WHEN abs(r) >= 1 THEN 0 ELSE {V.t_two_sided('r * sqrt((n - 2) / (1 - r * r))', '(n - 2)')} END, 6) AS p FROM co")
def sequence_independence(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of the segment lengths of each subject and the next by name, cut to the shorter, with its p."""
    return assess.sequence_correlations(S.labels(spark, d), "subject_id", ["start_idx", "segment_id"], "length")


# ---- nearest patterns
@query(M._PD + M._NN + " SELECT nn.measure, nn.subject_id, nn.segment_id, nn.cluster_id, nn.predicted, nn.d AS predicted_distance, pd.d AS correct_distance FROM nn JOIN pd ON pd.measure = nn.measure AND pd.subject_id = nn.subject_id AND pd.segment_id = nn.segment_id AND pd.cluster_id = nn.cluster_id AND pd.pattern_id = nn.cluster_id WHERE nn.predicted <> nn.cluster_id")
def misclassified_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments whose nearest pattern is another than their own, with the distances to both."""
    x = written(M._distances(spark, d))
    nn = measures.nearest_patterns(x, ["measure"]).where("predicted != cluster_id").withColumnRenamed("d", "predicted_distance")
    own = x.where("pattern_id = cluster_id").select("measure", "subject_id", "segment_id", "cluster_id", F.col("d").alias("correct_distance"))
    return nn.join(own, ["measure", "subject_id", "segment_id", "cluster_id"])


_BYSUB = M._NN + """, lb AS (SELECT measure, subject_id, cluster_id AS k FROM nn UNION SELECT measure, subject_id, predicted FROM nn), kk AS (SELECT lb.measure, lb.subject_id, k, count(*) FILTER (WHERE cluster_id = k) AS t, count(*) FILTER (WHERE predicted = k) AS p, count(*) FILTER (WHERE cluster_id = k AND predicted = k) AS h FROM lb JOIN nn ON nn.measure = lb.measure AND nn.subject_id = lb.subject_id GROUP BY ALL)
  SELECT measure, subject_id, """ + V.r6("sum(h) / sum(t)") + " AS accuracy, " + V.r6("avg(CASE WHEN p > 0 THEN h / p ELSE 0 END)") + " AS precision, " + V.r6("avg(CASE WHEN t > 0 THEN h / t ELSE 0 END)") + " AS recall, " + V.r6("avg(2 * h / (t + p))") + " AS f1, avg(2 * h / (t + p)) = 1 AS perfect FROM kk GROUP BY ALL"


@query(M._PD + _BYSUB)
def nearest_scores_by_subject(spark: SparkSession, d: str) -> DataFrame:
    """Scores of nearest patterns for every subject and measure, and whether they are perfect."""
    s = measures.classification_scores(measures.nearest_patterns(M._distances(spark, d), ["measure"]), ["measure", "subject_id"])
    return s.withColumn("perfect", F.col("f1") == 1)


@query()
def matched_scores(spark: SparkSession, d: str) -> DataFrame:
    """Macro F1 of each measure after predicted and true labels are matched greedily by their largest counts."""
    return assess.greedy_matching(M.confusion_counts(spark, d), ["measure"])


# ---- patterns, names
@query(V.with_(V.PAT) + """, s AS (SELECT pattern_id, canonical AS c, (abs(canonical[1]) = 1)::INT + (abs(canonical[2]) = 1)::INT + (abs(canonical[3]) = 1)::INT = 2 AS two FROM pat),
  r AS (SELECT pattern_id, two, CASE WHEN abs(c[1]) = 1 THEN 0.71 * c[1] ELSE c[1] END AS a, CASE WHEN abs(c[2]) = 1 THEN (CASE WHEN abs(c[1]) = 1 THEN 0.7 ELSE 0.71 END) * c[2] ELSE c[2] END AS b, CASE WHEN abs(c[3]) = 1 THEN 0.7 * c[3] ELSE c[3] END AS d FROM s)
SELECT pattern_id, CASE WHEN two THEN round(a, 6) END AS relaxed_1, CASE WHEN two THEN round(b, 6) END AS relaxed_2, CASE WHEN two THEN round(d, 6) END AS relaxed_3, CASE WHEN two THEN 1 + 2 * a * b * d - (a*a + b*b + d*d) >= -1e-10 END AS valid FROM r""")
def relaxed_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Canonical patterns with two strong correlations, weakened so that they make a valid matrix; null for the others."""
    x = S.patterns(spark, d).select("pattern_id", C.relaxed(F.col("canonical")).alias("relaxed"))
    return M.listed(x.withColumn("valid", C.psd3(F.col("relaxed"))).select("pattern_id", "relaxed", "valid"), "relaxed")


@query(V.with_(V.PAT) + "SELECT pattern_id, ideal FROM pat WHERE ideal AND 1 + 2*canonical[1]*canonical[2]*canonical[3] - (canonical[1]**2 + canonical[2]**2 + canonical[3]**2) >= -1e-10")
def ideal_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Patterns that are valid as they are."""
    return S.patterns(spark, d).where(F.col("ideal") & C.psd3(F.col("canonical"))).select("pattern_id", "ideal")


@query("""SELECT DISTINCT coalesce(stage, '') AS stage, completeness, CASE WHEN stage = 'raw' THEN 'RAW' WHEN stage = 'normal' THEN 'NC' WHEN stage = 'non_normal' THEN 'NN' WHEN contains(stage, 'resampled_') THEN 'RS' ELSE coalesce(stage, '') END AS key,
  CASE WHEN stage = 'raw' THEN 'Raw' WHEN stage = 'normal' THEN 'Correlated' WHEN stage = 'non_normal' THEN 'Non-normal' WHEN contains(stage, 'resampled_') THEN 'Downsampled' ELSE coalesce(stage, '') END AS display,
  contains(coalesce(stage, ''), 'resampled_') AS resampled, CASE completeness WHEN 'complete' THEN 1 WHEN 'partial' THEN 2 WHEN 'sparse' THEN 3 END AS place FROM subjects""")
def variant_names(spark: SparkSession, d: str) -> DataFrame:
    """Short and display names of the stages, and the place of each completeness in its own order."""
    s = F.coalesce("stage", F.lit(""))
    place = N.custom_order(F.col("completeness"), ["complete", "partial", "sparse"])
    return table(spark, d, "subjects").select(s.alias("stage"), "completeness", N.stage_key(s).alias("key"), N.stage_display(s).alias("display"), N.is_resampled(s).alias("resampled"), place.alias("place")).distinct()


