"""Queries over the observations, their segmentations and the pattern catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.functions import matrices
from strandweave.operators import correlation, measures, quality, segments
from strandweave.operators.describe import describe, entropy, min_max_scaled
from strandweave.plans import views as V
from strandweave.runtime import scratch, table, written
from strandweave.sources import tables as S
from strandweave.sources.tables import VARIATES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


def listed(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as text columns x1, x2, ... would differ between engines; as single numbers they don't."""
    for a in arrays:
        for i in range(3):
            df = df.withColumn(f"{a}_{i + 1}", F.get(a, F.lit(i)))
        df = df.drop(a)
    return df


def _three(a: str, x: str | None = None) -> str:
    return ", ".join(f"({x or a})[{i}] AS {a}_{i}" for i in (1, 2, 3))


# ---- sources, projections, lookups
@query(V.with_(V.SEG) + f"SELECT subject_id, segment_id, {_three('model')}, {_three('achieved')}, {_three('within')}, mae, relaxed_mae FROM seg")
def labels_parsed(spark: SparkSession, d: str) -> DataFrame:
    return listed(S.labels(spark, d).select("subject_id", "segment_id", "model", "achieved", "within", "mae", "relaxed_mae"), "model", "achieved", "within")


@query(V.with_(V.PAT) + f"SELECT pattern_id, {_three('canonical')}, {_three('relaxed')}, regularisation, ideal FROM pat WHERE relaxed IS NOT NULL")
def patterns_to_model(spark: SparkSession, d: str) -> DataFrame:
    return listed(S.patterns_to_model(spark, d), "canonical", "relaxed")


@query(V.with_(V.PAT) + """SELECT pattern_id, 1 + 2*canonical[1]*canonical[2]*canonical[3] - (canonical[1]**2 + canonical[2]**2 + canonical[3]**2) >= -1e-10 AS psd,
  1 + canonical[1]*canonical[2]*canonical[3] >= (canonical[1]**2 + canonical[2]**2 + canonical[3]**2) / 2 AS triangle,
  (abs(canonical[1]) = 1)::INT + (abs(canonical[2]) = 1)::INT + (abs(canonical[3]) = 1)::INT = 2 AS two_strong FROM pat""")
def pattern_validity(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("canonical")
    return S.patterns(spark, d).select("pattern_id", C.psd3(c).alias("psd"), C.triangle(c).alias("triangle"), C.two_strong(c).alias("two_strong"))


@query("""SELECT split, coalesce(stage, '') AS stage, completeness,
  CASE completeness WHEN 'complete' THEN 100 WHEN 'partial' THEN 70 WHEN 'sparse' THEN 10 END AS percent,
  concat_ws(' ', nullif(CASE completeness WHEN 'complete' THEN '' ELSE completeness END, ''), nullif(stage, '')) AS variant, count(*) AS n_subjects FROM subjects GROUP BY ALL""")
def subjects_by_variant(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("completeness")
    percent = F.when(c == "complete", 100).when(c == "partial", 70).when(c == "sparse", 10)
    variant = F.concat_ws(" ", F.when(c != "complete", c), F.when(F.col("stage") != "", F.col("stage")))
    return table(spark, d, "subjects").groupBy("split", F.coalesce("stage", F.lit("")).alias("stage"), "completeness", percent.alias("percent"), variant.alias("variant")).agg(F.count(F.lit(1)).alias("n_subjects"))


@query(V.with_(V.BAD) + "SELECT subject_id, clustering_desc, regexp_extract(clustering_desc, '^(.*)-[0-9]+$', 1) AS strategy, regexp_extract(clustering_desc, '([0-9]+)$', 1)::INT AS number, rank() OVER (PARTITION BY subject_id ORDER BY clustering_desc)::INT AS k FROM bad GROUP BY 1, 2 QUALIFY k <= 5")
def first_partitions(spark: SparkSession, d: str) -> DataFrame:
    b = S.bad_labels(spark, d).groupBy("subject_id", "clustering_desc").agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    k = F.row_number().over(Window.partitionBy("subject_id").orderBy("clustering_desc"))
    return b.withColumn("k", k).where("k <= 5").select("subject_id", "clustering_desc", F.regexp_extract("clustering_desc", "^(.*)-[0-9]+$", 1).alias("strategy"), F.regexp_extract("clustering_desc", "([0-9]+)$", 1).cast("int").alias("number"), "k")


@query(V.with_(V.OBS, V.SEG) + "SELECT o.subject_id, o.obs_idx FROM obs o WHERE EXISTS (SELECT 1 FROM seg s WHERE s.subject_id = o.subject_id AND o.obs_idx BETWEEN s.start_idx AND s.end_idx)")
def select_covered_rows(spark: SparkSession, d: str) -> DataFrame:
    return segments.interval_join(S.observations(spark, d).select("subject_id", "obs_idx"), S.labels(spark, d), "left_semi")


# ---- correlations of segments, errors, tolerance
def complete(spark: SparkSession, d: str) -> DataFrame:
    """Observations with all variates, for correlations."""
    return S.observations(spark, d, VARIATES)


def _by_segment(spark: SparkSession, d: str) -> DataFrame:
    return segments.interval_join(complete(spark, d), S.labels(spark, d).select("subject_id", "segment_id", "start_idx", "end_idx"))


_JOINED = "j AS (SELECT o.*, s.segment_id FROM obsf o JOIN seg s ON s.subject_id = o.subject_id AND o.obs_idx BETWEEN s.start_idx AND s.end_idx)"


@query(V.with_(V.OBS_F, V.SEG, V.PAT, _JOINED, V.spearman("j", "subject_id, segment_id"), f"x AS (SELECT subject_id, segment_id, n, {V.CORR} AS v FROM corr)") + f"""
SELECT x.subject_id, x.segment_id, n, {_three('v')},
  {', '.join(f"CASE WHEN abs(canonical[{i}]) >= 0.7 THEN abs(v[{i}]) >= 0.7 WHEN abs(canonical[{i}]) <= 0.2 THEN abs(v[{i}]) <= 0.2 ELSE false END AS ok_{i}" for i in (1, 2, 3))},
  round_even(round((abs(v[1]-canonical[1]) + abs(v[2]-canonical[2]) + abs(v[3]-canonical[3])) / 3, 9), 3) AS mae,
  round_even(round((abs(v[1]-relaxed[1]) + abs(v[2]-relaxed[2]) + abs(v[3]-relaxed[3])) / 3, 9), 3) AS relaxed_mae
FROM x JOIN seg USING (subject_id, segment_id) JOIN pat ON pat.pattern_id = seg.cluster_id""")
def recalculated_labels(spark: SparkSession, d: str) -> DataFrame:
    x = correlation.spearman(_by_segment(spark, d), ["subject_id", "segment_id"], VARIATES).withColumnRenamed("correlation", "v")
    x = x.join(S.labels(spark, d).select("subject_id", "segment_id", "cluster_id"), ["subject_id", "segment_id"])
    x = x.join(F.broadcast(S.patterns(spark, d).withColumnRenamed("pattern_id", "cluster_id")), "cluster_id")
    v = F.col("v")
    x = x.select("subject_id", "segment_id", "n", "v", C.within_strength(F.col("canonical"), v).alias("ok"), C.mean_abs_error(v, F.col("canonical")).alias("mae"), C.mean_abs_error(v, F.col("relaxed")).alias("relaxed_mae"))
    return listed(x, "v", "ok")


@query(V.with_(V.OBS_F, V.SEG, _JOINED, V.pearson("j", "subject_id, segment_id")) + f"SELECT subject_id, segment_id, n, {_three('correlation', V.CORR)} FROM corr")
def pearson_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return listed(correlation.pearson(_by_segment(spark, d), ["subject_id", "segment_id"], VARIATES), "correlation")


_TAU = lambda a, b: f"CASE WHEN sum(abs(sign(x.{a}-y.{a}))) > 0 AND sum(abs(sign(x.{b}-y.{b}))) > 0 THEN sum(sign(x.{a}-y.{a}) * sign(x.{b}-y.{b})) / sqrt(sum(abs(sign(x.{a}-y.{a})))::DOUBLE * sum(abs(sign(x.{b}-y.{b})))::DOUBLE) ELSE 'nan'::DOUBLE END"


@query(V.with_(V.OBS_F, V.SEG, _JOINED, f"n AS (SELECT subject_id, segment_id, count(*) AS n FROM j GROUP BY ALL), tau AS (SELECT x.subject_id, x.segment_id, {_TAU('iob', 'cob')} AS a, {_TAU('iob', 'ig')} AS b, {_TAU('cob', 'ig')} AS c FROM j x JOIN j y ON x.subject_id = y.subject_id AND x.segment_id = y.segment_id AND x.obs_idx < y.obs_idx GROUP BY ALL)",
                f"t2 AS (SELECT subject_id, segment_id, n, coalesce(a, 'nan'::DOUBLE) AS a, coalesce(b, 'nan'::DOUBLE) AS b, coalesce(c, 'nan'::DOUBLE) AS c FROM n LEFT JOIN tau USING (subject_id, segment_id))") + f"SELECT subject_id, segment_id, n, {_three('correlation', V.CORR)} FROM t2")
def kendall_by_segment(spark: SparkSession, d: str) -> DataFrame:
    return listed(correlation.kendall(_by_segment(spark, d), ["subject_id", "segment_id"], VARIATES), "correlation")


@query(V.with_(V.OBS_F, V.spearman("obsf", "subject_id")) + f"SELECT subject_id, n, {_three('correlation', V.CORR)} FROM corr")
def spearman_by_subject(spark: SparkSession, d: str) -> DataFrame:
    return listed(correlation.spearman(complete(spark, d), ["subject_id"], VARIATES, large_groups=True), "correlation")


@query(V.with_(V.OBS_F, V.SEG, "j AS (SELECT o.*, s.cluster_id FROM obsf o JOIN seg s ON s.subject_id = o.subject_id AND o.obs_idx BETWEEN s.start_idx AND s.end_idx)", V.spearman("j", "subject_id, cluster_id")) + f"SELECT subject_id, cluster_id, n, {_three('correlation', V.CORR)} FROM corr")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    return listed(_centroids(spark, d), "correlation")


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    by = ["subject_id", "cluster_id"]
    return correlation.spearman(quality.pooled(complete(spark, d), S.labels(spark, d), by, VARIATES), by, VARIATES, large_groups=True)


@query(V.with_(V.SEG) + f"SELECT subject_id, cluster_id, count(*) AS n, {', '.join(V.r6(f'avg(achieved[{i}])', 3) + f' AS mean_{i}' for i in (1, 2, 3))} FROM seg GROUP BY ALL")
def mean_cluster_correlations(spark: SparkSession, d: str) -> DataFrame:
    return S.labels(spark, d).groupBy("subject_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"), *[C.r6(F.avg(F.get("achieved", F.lit(i))), 3).alias(f"mean_{i + 1}") for i in range(3)])


# ---- descriptions
@query(V.with_(V.SEG) + f"SELECT cluster_id, {V.describe('relaxed_mae')} FROM seg GROUP BY ALL")
def mae_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    return describe(S.labels(spark, d), ["cluster_id"], "relaxed_mae")


@query(V.with_(V.SEG, "m AS (SELECT subject_id, avg(mae) AS mae, avg(relaxed_mae) AS relaxed_mae, avg(length) AS length, sum(length)::DOUBLE AS observations, count(*)::DOUBLE AS segments, count(DISTINCT cluster_id)::DOUBLE AS patterns, count(*) FILTER (WHERE NOT (within[1] AND within[2] AND within[3]))::DOUBLE AS outside FROM seg GROUP BY 1)")
       + " UNION ALL ".join(f"SELECT '{c}' AS measure, {V.describe(c)} FROM m" for c in ("mae", "relaxed_mae", "length", "observations", "segments", "patterns", "outside")))
def subjects_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per-subject figures, then described over subjects."""
    m = S.labels(spark, d).groupBy("subject_id").agg(
        F.avg("mae").alias("mae"), F.avg("relaxed_mae").alias("relaxed_mae"), F.avg("length").alias("length"), F.sum("length").cast("double").alias("observations"),
        F.count(F.lit(1)).cast("double").alias("segments"), F.count_distinct("cluster_id").cast("double").alias("patterns"), F.count_if(~C.all_true(F.col("within"))).cast("double").alias("outside"))
    names = [c for c in m.columns if c != "subject_id"]
    return describe(m.unpivot("subject_id", names, "measure", "value"), ["measure"], "value")


@query(V.with_(V.SEG, "c AS (SELECT subject_id, cluster_id, count(*)::DOUBLE AS n FROM seg GROUP BY ALL)") + f"SELECT 'pattern count' AS measure, {V.describe('n')} FROM c UNION ALL SELECT 'length', {V.describe('length::DOUBLE')} FROM seg")
def counts_described(spark: SparkSession, d: str) -> DataFrame:
    s = S.labels(spark, d)
    n = s.groupBy("subject_id", "cluster_id").agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("pattern count").alias("measure"), "v")
    return describe(n.unionByName(s.select(F.lit("length").alias("measure"), F.col("length").cast("double").alias("v"))), ["measure"], "v")


@query(V.with_(V.SEG) + f"""SELECT subject_id, cluster_id, i AS component, {V.describe('achieved[i]')}, {V.r6('avg(abs(achieved[i] - model[i]))')} AS error, count(*) FILTER (WHERE within[i]) AS n_within
FROM seg, (VALUES (1), (2), (3)) t(i) GROUP BY ALL""")
def achieved_by_pattern(spark: SparkSession, d: str) -> DataFrame:
    x = S.labels(spark, d).select("subject_id", "cluster_id", F.explode(F.arrays_zip("achieved", "model", "within", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("i"))).alias("z"))
    x = x.select("subject_id", "cluster_id", F.col("z.i").alias("component"), F.col("z.achieved").alias("v"), F.abs(F.col("z.achieved") - F.col("z.model")).alias("e"), F.col("z.within").alias("w"))
    by = ["subject_id", "cluster_id", "component"]
    more = x.groupBy(*by).agg(C.r6(F.avg("e")).alias("error"), F.count_if("w").alias("n_within"))
    return describe(x, by, "v").join(more, by)


@query(V.with_(V.OBS, "g AS (SELECT subject_id, (us - lag(us) OVER (PARTITION BY subject_id ORDER BY us, obs_idx)) / 1e6::DOUBLE AS gap_s FROM obs WHERE us IS NOT NULL)") + f"SELECT subject_id, {V.describe('gap_s')} FROM g WHERE gap_s IS NOT NULL GROUP BY ALL")
def time_gap_stats(spark: SparkSession, d: str) -> DataFrame:
    return describe(segments.time_gaps(S.observations(spark, d)), ["subject_id"], "gap_s", large=True)


@query(V.with_(V.OBS_F, V.SEG, "l AS (SELECT unnest([10, 20, 40]) AS len)", "j AS (SELECT o.*, s.segment_id, l.len FROM seg s JOIN l ON s.length >= l.len JOIN obsf o ON o.subject_id = s.subject_id AND o.obs_idx BETWEEN s.start_idx AND s.start_idx + l.len - 1)",
                V.spearman("j", "len, subject_id, segment_id"), V.PAT, f"x AS (SELECT len, subject_id, segment_id, {V.CORR} AS v FROM corr)",
                "e AS (SELECT len, (abs(v[1]-relaxed[1]) + abs(v[2]-relaxed[2]) + abs(v[3]-relaxed[3])) / 3 AS e FROM x JOIN seg USING (subject_id, segment_id) JOIN pat ON pat.pattern_id = seg.cluster_id)",
                "f AS (SELECT len, round_even(round(e, 9), 3) AS e FROM e WHERE NOT isnan(e))") + f"SELECT len, {V.describe('e')} FROM f GROUP BY ALL")
def mae_by_length(spark: SparkSession, d: str) -> DataFrame:
    """Segments cut to their first 10, 20 and 40 positions, correlated anew."""
    s = S.labels(spark, d).withColumn("len", F.explode(F.array(F.lit(10), F.lit(20), F.lit(40)))).where("length >= len")
    cut = s.select("subject_id", "segment_id", "len", "start_idx", (F.col("start_idx") + F.col("len") - 1).alias("end_idx"))
    x = correlation.spearman(segments.interval_join(complete(spark, d), cut), ["len", "subject_id", "segment_id"], VARIATES)
    x = x.join(S.labels(spark, d).select("subject_id", "segment_id", "cluster_id"), ["subject_id", "segment_id"]).join(F.broadcast(S.patterns(spark, d).withColumnRenamed("pattern_id", "cluster_id")), "cluster_id")
    return describe(x.withColumn("e", C.mean_abs_error(F.col("correlation"), F.col("relaxed"))).where("not isnan(e)"), ["len"], "e")


@query(V.with_(V.OBS, "e AS (SELECT subject_id, min(ig) AS a, max(ig) AS b FROM obs GROUP BY 1)", "x AS (SELECT subject_id, CASE WHEN b > a THEN (ig - a) / (b - a) ELSE 0 END AS v FROM obs JOIN e USING (subject_id) WHERE ig IS NOT NULL)",
                "h AS (SELECT subject_id, least(floor(v / (1.0::DOUBLE / 50)), 49) AS bin, count(*) AS n FROM x GROUP BY ALL)", "p AS (SELECT subject_id, n / sum(n) OVER (PARTITION BY subject_id) AS p FROM h)") + f"SELECT subject_id, {V.r6('-sum(p * log2(p))')} AS entropy FROM p GROUP BY 1")
def entropy_of_scaled(spark: SparkSession, d: str) -> DataFrame:
    return entropy(min_max_scaled(S.observations(spark, d, ("ig",)).select("subject_id", "ig"), ["subject_id"], ["ig"]), ["subject_id"], "ig")


@query(V.with_(V.OBS, "e AS (SELECT subject_id, min(iob) AS a, max(iob) AS b, min(cob) AS c, max(cob) AS d FROM obs GROUP BY 1)") + f"SELECT subject_id, obs_idx, {V.r6('-1 + CASE WHEN iob IS NULL THEN NULL WHEN b > a THEN (iob - a) / (b - a) ELSE 0 END * 2')} AS iob, {V.r6('-1 + CASE WHEN cob IS NULL THEN NULL WHEN d > c THEN (cob - c) / (d - c) ELSE 0 END * 2')} AS cob FROM obs JOIN e USING (subject_id)")
def min_max_scaled_observations(spark: SparkSession, d: str) -> DataFrame:
    x = min_max_scaled(S.observations(spark, d).select("subject_id", "obs_idx", "iob", "cob"), ["subject_id"], ["iob", "cob"], -1.0, 1.0)
    return x.select("subject_id", "obs_idx", C.r6(F.col("iob")).alias("iob"), C.r6(F.col("cob")).alias("cob"))


# ---- windows, resampling, variants
@query("SELECT user_id, segment_id::BIGINT AS segment_id, min(event_type) AS value, min(i)::BIGINT AS start_idx, max(i)::BIGINT AS end_idx, count(*) AS length FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS segment_id FROM (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY ALL")
def runs_to_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.runs_to_segments(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", None, F.to_date("ts"))


@query(V.with_(V.OBS) + f"SELECT subject_id, us // 60000000 * 60 AS bucket, {', '.join(f"{V.half_even(f'avg({c})')} AS {c}" for c in VARIATES)}, min(obs_idx) AS first_idx, max(obs_idx) AS last_idx, count(*) AS n FROM obs WHERE us IS NOT NULL GROUP BY ALL")
def tumbling_minute_mean(spark: SparkSession, d: str) -> DataFrame:
    return segments.tumbling_mean(S.observations(spark, d), 60, VARIATES)


@query(V.with_(V.OBS, V.SEG, "n AS (SELECT o.subject_id, o.us // 60000000 * 60 AS bucket, s.segment_id, count(*) AS shared, min(s.start_idx) AS st FROM obs o JOIN seg s ON s.subject_id = o.subject_id AND o.obs_idx BETWEEN s.start_idx AND s.end_idx WHERE o.us IS NOT NULL GROUP BY ALL)") + "SELECT subject_id, bucket, segment_id, shared FROM n QUALIFY row_number() OVER (PARTITION BY subject_id, bucket ORDER BY shared DESC, st, segment_id) = 1")
def overlap_argmax(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_segments(spark, d)


def _bucket_segments(spark: SparkSession, d: str) -> DataFrame:
    b = S.observations(spark, d).where("us is not null").select("subject_id", (F.floor(F.col("us") / 60_000_000) * 60).alias("bucket"), "obs_idx")
    return segments.best_overlap(b, S.labels(spark, d).select("subject_id", "segment_id", "start_idx", "end_idx"), ["subject_id"], ["bucket"])


@query(ORACLES["overlap_argmax"].replace("SELECT subject_id, bucket, segment_id, shared FROM n QUALIFY", ", b AS (SELECT subject_id, bucket, segment_id, shared FROM n QUALIFY") + """), i AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY bucket) - 1 AS idx FROM b),
  f AS (SELECT *, CASE WHEN lag(segment_id) OVER (PARTITION BY subject_id ORDER BY idx) IS DISTINCT FROM segment_id THEN 1 ELSE 0 END AS new FROM i), g AS (SELECT *, sum(new) OVER (PARTITION BY subject_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS run FROM f)
SELECT subject_id, run::BIGINT AS segment_id, min(segment_id) AS value, min(idx)::BIGINT AS start_idx, max(idx)::BIGINT AS end_idx, count(*) AS length FROM g GROUP BY subject_id, run""")
def resampled_labels(spark: SparkSession, d: str) -> DataFrame:
    b = _bucket_segments(spark, d).withColumnRenamed("segment_id", "value")
    return segments.runs_to_segments(b, ["subject_id"], ["bucket"], "value", None, F.floor(F.col("bucket") / 86400))


def _sparse(drop: float) -> str:
    return f"""sp AS (SELECT *, obs_idx AS old_idx, row_number() OVER (PARTITION BY subject_id ORDER BY obs_idx) - 1 AS new_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY (obs_idx * 7919) % 10007, obs_idx) AS k, count(*) OVER (PARTITION BY subject_id) AS n FROM obs) WHERE k <= round_even(round(n * {1 - drop:.1f}::DOUBLE, 6), 0))"""


@query(V.with_(V.OBS, _sparse(0.3)) + "SELECT subject_id, new_idx AS obs_idx, old_idx, ig FROM sp")
def sparsified_p30(spark: SparkSession, d: str) -> DataFrame:
    return segments.sparsified(S.observations(spark, d), 0.3).select("subject_id", "obs_idx", "old_idx", "ig")


@query(V.with_(V.OBS, V.SEG, _sparse(0.9)) + "SELECT s.subject_id, s.segment_id, s.cluster_id, min(new_idx) AS start_idx, max(new_idx) AS end_idx, count(*) AS length FROM sp o JOIN seg s ON s.subject_id = o.subject_id AND o.old_idx BETWEEN s.start_idx AND s.end_idx GROUP BY ALL HAVING count(*) >= 3")
def sparsified_p90_labels(spark: SparkSession, d: str) -> DataFrame:
    return segments.relabelled(segments.sparsified(S.observations(spark, d).select("subject_id", "obs_idx"), 0.9), S.labels(spark, d))


@query("WITH d AS (SELECT DISTINCT subject_id, segment_id, start_idx, end_idx, cluster_id FROM segment_labels), " + """f AS (SELECT *, max(end_idx) OVER (PARTITION BY subject_id) AS n, row_number() OVER w = 1 AS first, lead(segment_id) OVER w IS NULL AS last FROM d WINDOW w AS (PARTITION BY subject_id ORDER BY start_idx, end_idx, segment_id)),
  s AS (SELECT subject_id, segment_id, cluster_id, n, CASE WHEN first THEN start_idx ELSE start_idx + 20 END AS start_idx, CASE WHEN last THEN end_idx ELSE least(end_idx + 20, n) END AS end_idx, first FROM f), k AS (SELECT * FROM s WHERE first OR start_idx <= n - 3),
  e AS (SELECT *, lead(segment_id) OVER (PARTITION BY subject_id ORDER BY start_idx, end_idx, segment_id) IS NULL AS last FROM k)
SELECT subject_id, segment_id, cluster_id, start_idx, CASE WHEN last THEN n ELSE end_idx END AS end_idx, CASE WHEN last THEN n ELSE end_idx END - start_idx + 1 AS length FROM e""")
def shifted_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return segments.shifted(S.labels(spark, d).select("subject_id", "segment_id", "start_idx", "end_idx", "cluster_id"), ["subject_id"], 20).select("subject_id", "segment_id", "cluster_id", "start_idx", "end_idx", "length")


@query(V.with_(V.SEG, "c AS (SELECT list_sort(list(DISTINCT cluster_id)) AS l FROM seg)") + "SELECT subject_id, segment_id, CASE WHEN row_number() OVER (PARTITION BY subject_id ORDER BY ((segment_id + 1)::BIGINT * 7919) % 10007, segment_id) <= 3 THEN l[list_position(l, cluster_id) % len(l) + 1] ELSE cluster_id END AS cluster_id FROM seg, c")
def wrong_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = S.labels(spark, d).select("subject_id", "segment_id", F.col("cluster_id"))
    ids = F.array(*[F.lit(r[0]) for r in S.labels(spark, d).select("cluster_id").where("cluster_id is not null").distinct().orderBy("cluster_id").collect()])  # the catalogue's ids, 27 at most
    return segments.wrong_clusters(s, ["subject_id"], 3, ids)


@query(V.with_(V.SEG, V.OBS, "k AS (SELECT *, sum(length) OVER (PARTITION BY subject_id ORDER BY start_idx, segment_id ROWS UNBOUNDED PRECEDING) AS e FROM seg WHERE cluster_id < 18)") + "SELECT o.subject_id, (o.obs_idx + k.e - k.length - k.start_idx)::BIGINT AS obs_idx, o.ig, k.segment_id FROM obs o JOIN k ON k.subject_id = o.subject_id AND o.obs_idx BETWEEN k.start_idx AND k.end_idx")
def reduced_clusters(spark: SparkSession, d: str) -> DataFrame:
    s = segments.reduced(S.labels(spark, d), F.col("cluster_id") < 18)
    old = s.select("subject_id", "segment_id", F.col("old_start_idx").alias("start_idx"), (F.col("old_start_idx") + F.col("length") - 1).alias("end_idx"), (F.col("start_idx") - F.col("old_start_idx")).alias("move"))
    return segments.interval_join(S.observations(spark, d).select("subject_id", "obs_idx", "ig"), old).select("subject_id", (F.col("obs_idx") + F.col("move")).cast("long").alias("obs_idx"), "ig", "segment_id")


@query(V.with_(V.SEG) + "SELECT subject_id, cluster_id, unnest(generate_series(start_idx::BIGINT, end_idx::BIGINT)) AS obs_idx FROM seg")
def exploded_labels(spark: SparkSession, d: str) -> DataFrame:
    return segments.exploded(S.labels(spark, d), "subject_id", "cluster_id")


# ---- quality
_AGREE = "ag AS (SELECT b.subject_id, b.clustering_desc, sum(least(b.end_idx, s.end_idx) - greatest(b.start_idx, s.start_idx) + 1) AS n, coalesce(sum(CASE WHEN b.cluster_id = s.cluster_id THEN least(b.end_idx, s.end_idx) - greatest(b.start_idx, s.start_idx) + 1 END), 0) AS agree FROM bad b JOIN seg s ON s.subject_id = b.subject_id AND s.start_idx <= b.end_idx AND b.start_idx <= s.end_idx GROUP BY ALL)"


@query(V.with_(V.SEG, V.BAD, _AGREE) + f"SELECT subject_id, clustering_desc, n::BIGINT AS n, agree::BIGINT AS agree, {V.r6('agree / n')} AS jaccard FROM ag")
def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    return quality.agreement(S.labels(spark, d), S.bad_labels(spark, d), ["clustering_desc"]).withColumn("jaccard", C.r6(C.ratio(F.col("agree"), F.col("n"))))


def _silhouette_sql(rows: str, by: str, dist: str) -> str:
    """CTEs that end in `sw(<by>, swc)`; `dist` is the distance of a.v and b.v."""
    return f"""pr AS (SELECT {', '.join('a.' + c for c in by.split(', '))}, a.row, a.c AS own, b.c AS other, avg({dist}) AS d FROM {rows} a JOIN {rows} b ON {' AND '.join(f'a.{c} = b.{c}' for c in by.split(', '))} AND a.row <> b.row GROUP BY ALL),
  pz AS (SELECT * FROM pr UNION ALL SELECT {by}, row, c, c, NULL FROM {rows}),
  ab AS (SELECT {by}, row, own, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM pz GROUP BY ALL),
  si AS (SELECT {by}, own, CASE WHEN b IS NULL THEN NULL WHEN a IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab),
  sw AS (SELECT {by}, CASE WHEN count(*) > count(DISTINCT own) THEN round(avg(s) + 1e-9, 6) END AS swc FROM si GROUP BY ALL)"""


_L5 = V.lp("a.v", "b.v", 5)


@query(V.with_("r AS (SELECT 'all' AS g, vec_id AS row, label AS c, embedding::DOUBLE[] AS v FROM embeddings)", _silhouette_sql("r", "g", _L5)) + "SELECT swc FROM sw")
def silhouette_l5(spark: SparkSession, d: str) -> DataFrame:
    return quality.silhouette_index(table(spark, d, "embeddings").withColumn("g", F.lit("all")), ["g"], "vec_id", "label", "embedding").select("swc")


_BADROWS = "r AS (SELECT subject_id, clustering_desc, segment_id AS row, cluster_id AS c, achieved AS v FROM bad WHERE cluster_id IS NOT NULL AND achieved IS NOT NULL AND list_count(achieved) = 3 AND NOT list_contains(list_transform(achieved, lambda z: isnan(z)), true))"


def _bad_rows(spark: SparkSession, d: str) -> DataFrame:
    return usable(S.bad_labels(spark, d))


@query(V.with_(V.BAD, _BADROWS, _silhouette_sql("r", "subject_id, clustering_desc", _L5)) + "SELECT * FROM sw")
def silhouette_by_partition(spark: SparkSession, d: str) -> DataFrame:
    return quality.silhouette_index(_bad_rows(spark, d), ["subject_id", "clustering_desc"], "segment_id", "cluster_id", "achieved")


#: The whole benchmark: the truth under the name 'truth', and every degraded partition.
_ALLROWS = f"""{_BADROWS}, allb AS (SELECT subject_id, 'truth' AS clustering_desc, segment_id, start_idx, end_idx, length, cluster_id, achieved, within, relaxed_mae FROM seg UNION ALL SELECT subject_id, clustering_desc, segment_id, start_idx, end_idx, length, cluster_id, achieved, within, relaxed_mae FROM bad),
  ar AS (SELECT subject_id, clustering_desc, segment_id AS row, cluster_id AS c, achieved AS v FROM allb WHERE cluster_id IS NOT NULL AND achieved IS NOT NULL AND list_count(achieved) = 3 AND NOT list_contains(list_transform(achieved, lambda z: isnan(z)), true))"""
TRUTH = "truth"


def all_partitions(spark: SparkSession, d: str) -> DataFrame:
    c = ["subject_id", "clustering_desc", "segment_id", "start_idx", "end_idx", "length", "cluster_id", "achieved", "within", "relaxed_mae"]
    return S.labels(spark, d).withColumn("clustering_desc", F.lit(TRUTH)).select(*c).unionByName(S.bad_labels(spark, d).select(*c))


def usable(segments_: DataFrame) -> DataFrame:
    """Segments with a cluster and three finite correlations."""
    return segments_.where("cluster_id is not null").where((F.size("achieved") == 3) & F.forall("achieved", lambda z: z.isNotNull() & ~F.isnan(z)))


def _centres_sql(rows: str, names: tuple[str, ...], every: bool = False) -> str:
    """CTEs that end in `ix(subject_id, clustering_desc, measure, dbi, vrc, pbm)`: centroids are rank correlations of pooled observations, the whole's that of all of a subject's.

    `every` keeps partitions whose rows lie at their centroids: they have a DBI.
    """
    g = "subject_id, clustering_desc, measure"
    by = lambda a, b: "CASE measure " + " ".join(f"WHEN '{n}' THEN {measure_sql(n, a, b)}" for n in names) + " END"
    rank = V.spearman("po", "subject_id, clustering_desc, kc").replace("rk AS", "rkc AS").replace("corr AS", "corc AS").replace("FROM rk ", "FROM rkc ")
    whole = V.spearman("obsf", "subject_id").replace("rk AS", "rko AS").replace("corr AS", "coro AS").replace("FROM rk ", "FROM rko ")
    return ", ".join([
        f"me AS (SELECT unnest([{', '.join(repr(n) for n in names)}]) AS measure)",
        f"po AS (SELECT o.iob, o.cob, o.ig, s.subject_id, s.clustering_desc, s.cluster_id AS kc FROM allb s JOIN obsf o ON o.subject_id = s.subject_id AND o.obs_idx BETWEEN s.start_idx AND s.end_idx WHERE s.cluster_id IS NOT NULL)", rank, whole,
        f"ce AS (SELECT subject_id, clustering_desc, kc AS c, {V.CORR} AS m FROM corc)", f"ov AS (SELECT subject_id, {V.CORR} AS o FROM coro)",
        f"x AS (SELECT r.*, measure, {by('r.v', 'ce.m')} AS d, {by('r.v', 'ov.o')} AS da, {by('ce.m', 'ov.o')} AS db FROM {rows} r JOIN ce USING (subject_id, clustering_desc, c) JOIN ov USING (subject_id) CROSS JOIN me)",
        f"k AS (SELECT {g}, c, count(*) AS n, avg(d) AS s, sum(d) AS e, sum(d*d) AS e2, sum(da) AS e1, any_value(db) AS db FROM x GROUP BY ALL)",
        f"t AS (SELECT {g}, count(*) AS k, sum(n) AS n, sum(n * db * db) AS b, sum(e2) AS e2, sum(e) AS e, sum(e1) AS e1 FROM k GROUP BY ALL)",
        "u0 AS (SELECT k.*, ce.m FROM k JOIN ce USING (subject_id, clustering_desc, c))",
        f"pc AS (SELECT a.subject_id, a.clustering_desc, a.measure, a.c, a.s + b.s AS s, {by('a.m', 'b.m').replace('CASE measure', 'CASE a.measure')} AS d FROM u0 a JOIN u0 b ON a.subject_id = b.subject_id AND a.clustering_desc = b.clustering_desc AND a.measure = b.measure AND a.c <> b.c)",
        f"w AS (SELECT {g}, c, max(s / greatest(d, 1e-15)) AS r, max(d) AS d FROM pc GROUP BY ALL)", f"u AS (SELECT {g}, avg(r) AS dbi, max(d) AS d FROM w GROUP BY ALL)",
        f"ix AS (SELECT {g}, round(u.dbi, 4) AS dbi, round(CASE WHEN e2 * (k - 1) <> 0 THEN b * (n - k) / (e2 * (k - 1)) END, 4) AS vrc, round(CASE WHEN n * e <> 0 THEN pow(u.d * e1 / (n * e), 2) END, 4) AS pbm FROM t LEFT JOIN u USING ({g}) WHERE e > 1e-6)"
        if not every else
        f"ix AS (SELECT {g}, CASE WHEN measure = 'cosine' AND u.dbi > 1e9 THEN round(u.dbi / 1e9, 3) * 1e9 ELSE round(u.dbi, 4) END AS dbi, round(CASE WHEN abs(e) > 1e-6 AND e2 * (k - 1) <> 0 THEN b * (n - k) / (e2 * (k - 1)) END, 4) AS vrc, round(CASE WHEN abs(e) > 1e-6 THEN pow(u.d * e1 / (n * e), 2) END, 4) AS pbm FROM t LEFT JOIN u USING ({g}))"])


#: The measures of the published benchmark, which the queries on correlations and ranks of indices take; the two matrix measures stand apart, as SQL can't express them.
QUALITY = ("l1", "l1_ref", "l2", "l3", "l5", "l5_ref", "linf", "linf_dot")
QUALITY_MATRIX = ("log_frobenius", "foerstner")
BY = ["subject_id", "clustering_desc"]
_ALL = V.with_(V.OBS_F, V.SEG, V.BAD, _ALLROWS)


def centroid_quality(spark: SparkSession, d: str, partitions: DataFrame, names: tuple[str, ...], every: bool = False) -> DataFrame:
    """`<BY>, measure, dbi, vrc, pbm`; cluster centroids are rank correlations of pooled observations, the whole's that of all observations of the subject.

    Where rows lie at their centroids but for rounding, VRC and PBM are noise: such partitions are left out, with `every` only
    those two indices are null. Centroids whose cosine is not positive count as 1e-15 apart, so a DBI by cosine may be over
    1e9; it is then given to 1e6. Subjects of more than `LARGE` rows are pooled by shuffles, all others one by one in a task.
    """
    size = table(spark, d, "observations", S.OBSERVATIONS).where("subject_id is not null").groupBy("subject_id").agg(F.count(F.lit(1)).alias("n"))
    large = [r[0] for r in size.where(F.col("n") > LARGE).select("subject_id").collect()]  # as many as rows / LARGE
    ok = (F.size("achieved") == 3) & F.forall("achieved", lambda z: z.isNotNull() & ~F.isnan(z))
    p = partitions.where("cluster_id is not null").select(*BY, "cluster_id", "start_idx", "end_idx", F.col("achieved").alias("vec"), F.coalesce(ok, F.lit(False)).alias("usable"))
    o = S.observations(spark, d, VARIATES, whole=True)
    few = F.col("subject_id").isin(large)
    x = quality.pooled_indices(o.where(~few) if large else o, p.where(~few) if large else p, "clustering_desc", VARIATES, names)
    if large:
        x = x.unionByName(large_centroid_quality(complete(spark, d).where(few), partitions.where(few), names))
    if not every:
        return x.where("e > 1e-6").select(*BY, "measure", *[F.round(c, 4).alias(c) for c in ("dbi", "vrc", "pbm")])
    dbi = F.when((F.col("measure") == "cosine") & (F.col("dbi") > 1e9), F.round(F.col("dbi") / 1e9, 3) * 1e9).otherwise(F.round("dbi", 4))
    return x.select(*BY, "measure", dbi.alias("dbi"), *[F.when(F.abs("e") > 1e-6, F.round(c, 4)).alias(c) for c in ("vrc", "pbm")])


#: Rows of a subject that still go to one task: some 200 bytes each there.
LARGE = 3_000_000


def large_centroid_quality(o: DataFrame, partitions: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """As `quality.pooled_indices`, where no task holds a subject: each partition's pooled observations are rows."""
    keys = [*BY, "cluster_id"]
    with scratch(quality.pooled(o, partitions.where("cluster_id is not null"), keys, VARIATES)) as pooled:  # read for each variate
        cen = written(correlation.spearman(pooled, keys, VARIATES, large_groups=True).select(*keys, F.col("correlation").alias("centroid")))
    whole = correlation.spearman(o, ["subject_id"], VARIATES, large_groups=True).select("subject_id", F.col("correlation").alias("overall"))
    return quality.centroid_indices(usable(partitions).select(*keys, F.col("achieved").alias("vec")), cen, whole, BY, "cluster_id", names, over=["subject_id"])


def _by_measure(spark: SparkSession, d: str, names: tuple[str, ...], every: bool = False) -> DataFrame:
    p = written(all_partitions(spark, d))
    s = quality.silhouettes_by_measure(usable(p), BY, "segment_id", "cluster_id", "achieved", names)
    return s.join(centroid_quality(spark, d, p, names, every), [*BY, "measure"], "left")


def _quality_sql(names: tuple[str, ...], every: bool = False) -> str:
    dist = "CASE a.measure " + " ".join(f"WHEN '{n}' THEN {measure_sql(n, 'a.v', 'b.v')}" for n in names) + " END"
    defined = " WHERE measure <> 'cosine' OR list_dot_product(v, v) > 0" if "cosine" in names else ""
    return _ALL + ", " + _centres_sql("ar", names, every) + f", am AS (SELECT ar.*, measure FROM ar CROSS JOIN me{defined}), " + _silhouette_sql("am", "subject_id, clustering_desc, measure", dist) + " SELECT sw.*, dbi, vrc, pbm FROM sw LEFT JOIN ix USING (subject_id, clustering_desc, measure)"


def measure_sql(n: str, a: str = "a", b: str = "b") -> str:
    m = V.measure(n, a, b)
    return f"CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 'nan'::DOUBLE ELSE {m} END" if n == "cosine" else m


@query(_quality_sql(measures.MEASURES, every=True))
def quality_by_measure(spark: SparkSession, d: str) -> DataFrame:
    """Silhouette, DBI, VRC and PBM of the truth and of every degraded partition, by each measure that SQL can express: all but the two matrix measures."""
    return _by_measure(spark, d, measures.MEASURES, every=True)


@query()
def quality_by_matrix_measure(spark: SparkSession, d: str) -> DataFrame:
    """As quality_by_measure, by the two matrix measures."""
    return _by_measure(spark, d, QUALITY_MATRIX)


@query(_ALL + ", " + _centres_sql("ar", ("l1",)) + " SELECT subject_id, clustering_desc, dbi, vrc, pbm FROM ix WHERE clustering_desc <> 'truth'")
def centroid_indices_by_partition(spark: SparkSession, d: str) -> DataFrame:
    """Indices of the degraded partitions by L1."""
    return centroid_quality(spark, d, S.bad_labels(spark, d), ("l1",)).drop("measure")


_TRUTH_SW = _silhouette_sql("tr", "subject_id, clustering_desc", V.lp("a.v", "b.v", 1))


@query(_ALL + ", " + _centres_sql("ar", ("l1",)) + ", tr AS (SELECT * FROM ar WHERE clustering_desc = 'truth'), " + _TRUTH_SW + " SELECT subject_id, swc, dbi, vrc, pbm FROM sw LEFT JOIN ix USING (subject_id, clustering_desc)")
def quality_of_truth(spark: SparkSession, d: str) -> DataFrame:
    """Indices of the true segmentation by L1."""
    t = S.labels(spark, d).withColumn("clustering_desc", F.lit(TRUTH))
    s = quality.silhouette_index(usable(t), BY, "segment_id", "cluster_id", "achieved", "l1")
    return s.join(centroid_quality(spark, d, t, ("l1",)), BY, "left").drop("clustering_desc", "measure")


@query(V.with_(V.SEG, V.BAD, _AGREE, _BADROWS, _silhouette_sql("r", "subject_id, clustering_desc", _L5), f"""sm AS (SELECT subject_id, clustering_desc, count(DISTINCT cluster_id) AS n_patterns, count(*) AS n_segments, sum(length)::BIGINT AS n_observations, {V.r6('avg(relaxed_mae)')} AS mae,
  count(*) FILTER (WHERE NOT coalesce(within[1] AND within[2] AND within[3], false)) AS n_outside FROM bad GROUP BY ALL)""",
  "wr AS (SELECT b.subject_id, b.clustering_desc, count(*) FILTER (WHERE b.cluster_id IS DISTINCT FROM s.cluster_id) AS n_wrong, sum(abs(b.end_idx - s.end_idx))::BIGINT AS n_shifted FROM bad b JOIN seg s USING (subject_id, segment_id) GROUP BY ALL)")
  + f"SELECT sm.*, n_wrong, n_shifted, {V.r6('agree / n')} AS jaccard, swc FROM sm LEFT JOIN wr USING (subject_id, clustering_desc) LEFT JOIN ag USING (subject_id, clustering_desc) LEFT JOIN sw USING (subject_id, clustering_desc)")
def partition_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary(spark, d)


def summary(spark: SparkSession, d: str, b: DataFrame | None = None) -> DataFrame:
    by = ["subject_id", "clustering_desc"]
    b, t = written(S.bad_labels(spark, d)) if b is None else b, S.labels(spark, d)  # read by each part
    sm = b.groupBy(*by).agg(F.count_distinct("cluster_id").alias("n_patterns"), F.count(F.lit(1)).alias("n_segments"), F.sum("length").alias("n_observations"), C.r6(F.avg("relaxed_mae")).alias("mae"), F.count_if(~C.all_true(F.col("within"))).alias("n_outside"))
    truth = t.select("subject_id", "segment_id", F.col("cluster_id").alias("_c"), F.col("end_idx").alias("_e"))
    wr = b.join(truth, ["subject_id", "segment_id"]).groupBy(*by).agg(F.count_if(~F.col("cluster_id").eqNullSafe(F.col("_c"))).alias("n_wrong"), F.sum(F.abs(F.col("end_idx") - F.col("_e"))).alias("n_shifted"))
    ag = quality.agreement(t, b, ["clustering_desc"]).select(*by, C.r6(C.ratio(F.col("agree"), F.col("n"))).alias("jaccard"))
    sw = quality.silhouette_index(usable(b), by, "segment_id", "cluster_id", "achieved")
    return sm.join(wr, by, "left").join(ag, by, "left").join(sw, by, "left")


# ---- distance measures
def _pattern_sql(names: tuple[str, ...]) -> str:
    lvl = "(round_even(abs(c.canonical[1]-p.canonical[1]),0) + round_even(abs(c.canonical[2]-p.canonical[2]),0) + round_even(abs(c.canonical[3]-p.canonical[3]),0))::INT"
    base = f"pb AS (SELECT s.subject_id, s.segment_id, s.cluster_id, p.pattern_id, {lvl} AS level, s.achieved AS a, p.relaxed AS b FROM seg s JOIN pat c ON c.pattern_id = s.cluster_id CROSS JOIN pat p WHERE p.relaxed IS NOT NULL AND c.relaxed IS NOT NULL)"
    return base + ", pd AS (" + " UNION ALL ".join(f"SELECT subject_id, segment_id, cluster_id, pattern_id, level, '{n}' AS measure, {V.r6(measure_sql(n))} AS d FROM pb" for n in names) + ")"


_PD = V.with_(V.SEG, V.PAT, _pattern_sql(measures.MEASURES))
_NORM = ", ex AS (SELECT measure, min(d) AS a, max(d) AS b FROM pd WHERE NOT isnan(d) GROUP BY 1), nm AS (SELECT pd.* EXCLUDE (d), round(coalesce((d - a) / nullif(b - a, 0), 0) + 1e-9, 3) AS d FROM pd JOIN ex USING (measure))"
_LEVELS = _NORM + f", ls AS (SELECT measure, level, {V.describe('CASE WHEN NOT isnan(d) THEN d END', 3)} FROM nm GROUP BY ALL)"


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return measures.pattern_distances(S.labels(spark, d), S.patterns_to_model(spark, d))


@query(V.with_(V.PAT) + "SELECT a.pattern_id AS px, b.pattern_id AS py, (round_even(abs(a.canonical[1]-b.canonical[1]),0) + round_even(abs(a.canonical[2]-b.canonical[2]),0) + round_even(abs(a.canonical[3]-b.canonical[3]),0))::INT AS level FROM pat a JOIN pat b ON a.pattern_id <= b.pattern_id WHERE a.relaxed IS NOT NULL AND b.relaxed IS NOT NULL")
def level_sets(spark: SparkSession, d: str) -> DataFrame:
    return measures.level_sets(S.patterns_to_model(spark, d))


@query(_PD + "SELECT * FROM pd")
def segment_pattern_distances(spark: SparkSession, d: str) -> DataFrame:
    return _distances(spark, d)


@query(_PD + _LEVELS + " SELECT * FROM ls")
def level_statistics(spark: SparkSession, d: str) -> DataFrame:
    return measures.level_statistics(measures.normalised(_distances(spark, d), ["measure"], few=True), ["measure"])


_Z = "2.5758293035489004"
_CI = _LEVELS + f", ci AS (SELECT * FROM (SELECT measure, level, lead(level) OVER w AS next_level, mean - lead(mean) OVER w AS diff, sqrt(coalesce(std, 0)**2 / count + coalesce(lead(std) OVER w, 0)**2 / lead(count) OVER w) AS se FROM ls WINDOW w AS (PARTITION BY measure ORDER BY level)) WHERE next_level IS NOT NULL)"


@query(_PD + _CI + f" SELECT measure, level, next_level, {V.r6('diff')} AS difference, {V.r6(f'diff - {_Z} * se')} AS lo, {V.r6(f'diff + {_Z} * se')} AS hi, CASE WHEN diff - {_Z} * se <= 0 AND diff + {_Z} * se >= 0 THEN 'overlap' WHEN diff + {_Z} * se < 0 THEN 'lower' ELSE 'higher' END AS relation, {V.r6('abs(diff)')} AS rate FROM ci")
def level_intervals(spark: SparkSession, d: str) -> DataFrame:
    return measures.level_intervals(measures.level_statistics(measures.normalised(_distances(spark, d), ["measure"], few=True), ["measure"]), ["measure"])


_NN = ", nn AS (SELECT measure, subject_id, segment_id, cluster_id, pattern_id AS predicted, d FROM pd WHERE NOT isnan(d) QUALIFY row_number() OVER (PARTITION BY measure, subject_id, segment_id, cluster_id ORDER BY d, pattern_id) = 1)"


@query(_PD + _NN + " SELECT * FROM nn")
def nearest_pattern(spark: SparkSession, d: str) -> DataFrame:
    return measures.nearest_patterns(_distances(spark, d), ["measure"])


_SCORES = _NN + """, lb AS (SELECT measure, cluster_id AS k FROM nn UNION SELECT measure, predicted FROM nn), kk AS (SELECT lb.measure, k, count(*) FILTER (WHERE cluster_id = k) AS t, count(*) FILTER (WHERE predicted = k) AS p, count(*) FILTER (WHERE cluster_id = k AND predicted = k) AS h FROM lb JOIN nn ON nn.measure = lb.measure GROUP BY ALL),
  sc AS (SELECT measure, sum(h) / sum(t) AS accuracy, avg(CASE WHEN p > 0 THEN h / p ELSE 0 END) AS precision, avg(CASE WHEN t > 0 THEN h / t ELSE 0 END) AS recall, avg(2 * h / (t + p)) AS f1 FROM kk GROUP BY 1)"""


@query(_PD + _SCORES + f" SELECT measure, {', '.join(f'{V.r6(c)} AS {c}' for c in ('accuracy', 'precision', 'recall', 'f1'))} FROM sc")
def nearest_pattern_scores(spark: SparkSession, d: str) -> DataFrame:
    return measures.classification_scores(measures.nearest_patterns(_distances(spark, d), ["measure"]), ["measure"])


@query(_PD + _NN + " SELECT measure, cluster_id, predicted, count(*) AS n FROM nn GROUP BY ALL")
def confusion_counts(spark: SparkSession, d: str) -> DataFrame:
    return measures.nearest_patterns(_distances(spark, d), ["measure"]).groupBy("measure", "cluster_id", "predicted").agg(F.count(F.lit(1)).alias("n"))


def _entropy_sql(by: str, name: str) -> str:
    g = f"measure{', ' + by if by else ''}"
    return f", h{name} AS (SELECT {g}, least(floor(d / (1.0::DOUBLE / 50)), 49) AS bin, count(*) AS n FROM nm WHERE d BETWEEN 0 AND 1 GROUP BY ALL), p{name} AS (SELECT {g}, n / sum(n) OVER (PARTITION BY {g}) AS p FROM h{name}), {name} AS (SELECT {g}, {V.r6('-sum(p * log2(p))')} AS v FROM p{name} GROUP BY ALL)"


_CRIT = _CI + _entropy_sql("", "eo") + _entropy_sql("level", "el") + _SCORES + f""", cr AS (SELECT measure, 'level0_mean' AS criterion, mean AS value FROM ls WHERE level = 0 UNION ALL SELECT measure, 'rate', {V.r6('avg(round(abs(diff) + 1e-9, 6))')} FROM ci GROUP BY 1 UNION ALL SELECT measure, 'entropy', v FROM eo
  UNION ALL SELECT measure, 'level_entropy', {V.r6('avg(v)')} FROM el GROUP BY 1 UNION ALL SELECT measure, 'f1', {V.r6('f1')} FROM sc UNION ALL SELECT measure, 'all_lower', bool_and(diff + {_Z} * se < 0)::INT FROM ci GROUP BY 1 UNION ALL SELECT measure, 'odd', count(*) FILTER (WHERE NOT isfinite(d)) FROM pd GROUP BY 1)"""


def _criteria(spark: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    with scratch(measures.pattern_distances(S.labels(spark, d), S.patterns_to_model(spark, d), names)) as x:
        return measures.criteria(x, ["measure"])


_RANK = _CRIT + ", rn AS (SELECT measure, criterion, value, (dense_rank() OVER (PARTITION BY criterion ORDER BY CASE WHEN criterion IN ('level0_mean', 'level_entropy') THEN value ELSE -value END))::INT AS rank FROM cr WHERE criterion <> 'odd')"


def _averaged(criteria: DataFrame) -> DataFrame:
    a = measures.ranks(criteria).groupBy("measure").agg(C.r6(F.avg("rank"), 3).alias("average_rank"))
    return quality.ranked_groups(a.withColumn("_g", F.lit(1)), ["_g"], "average_rank", "place").drop("_g")


@query(_PD + _CRIT + " SELECT * FROM cr")
def column_measure_criteria(spark: SparkSession, d: str) -> DataFrame:
    """Of all measures that SQL can express; the queries below rank those, `measure_...` all."""
    return _criteria(spark, d, measures.MEASURES)


@query(_PD + _RANK + " SELECT * FROM rn")
def column_measure_ranks(spark: SparkSession, d: str) -> DataFrame:
    return measures.ranks(column_measure_criteria(spark, d))


@query(_PD + _RANK + f", av AS (SELECT measure, {V.r6('avg(rank)', 3)} AS average_rank FROM rn GROUP BY 1) SELECT measure, average_rank, (dense_rank() OVER (ORDER BY average_rank))::INT AS place FROM av")
def column_measure_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _averaged(column_measure_criteria(spark, d))


@query(_PD + _RANK + " SELECT criterion, string_agg(measure, ',' ORDER BY measure) AS best FROM rn WHERE rank = 1 GROUP BY 1")
def best_column_measures(spark: SparkSession, d: str) -> DataFrame:
    return measures.best_labels(measures.ranks(column_measure_criteria(spark, d)), ["criterion"])


@query()
def measure_criteria(spark: SparkSession, d: str) -> DataFrame:
    """With the two matrix measures."""
    return _criteria(spark, d, measures.RANKED)


@query()
def measure_ranks(spark: SparkSession, d: str) -> DataFrame:
    return measures.ranks(measure_criteria(spark, d))


@query()
def measure_average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _averaged(measure_criteria(spark, d))


@query()
def best_measures(spark: SparkSession, d: str) -> DataFrame:
    return measures.best_labels(measures.ranks(measure_criteria(spark, d)), ["criterion"])


@query()
def matrix_distances(spark: SparkSession, d: str) -> DataFrame:
    """Foerstner and log-Frobenius distances of every segment to its pattern, and whether its vector makes a valid matrix."""
    x = S.labels(spark, d).join(F.broadcast(S.patterns_to_model(spark, d).withColumnRenamed("pattern_id", "cluster_id")), "cluster_id")
    a, b = F.col("achieved"), F.col("relaxed")
    return x.select("subject_id", "segment_id", F.round(matrices.foerstner(a, b), 6).alias("foerstner"), F.round(matrices.log_frobenius(a, b), 6).alias("log_frobenius"), matrices.psd(a).alias("psd"))
