"""Queries on variants, calendars, gaps, degraded partitions and tables for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.functions import columns as C
from strandweave.operators import measures, segments
from strandweave.operators.describe import describe, exact_percentiles
from strandweave.plans import model_queries as M
from strandweave.plans import views as V
from strandweave.plans.evaluation_queries import _INDEX, _SUM, INDICES, _index
from strandweave.runtime import table
from strandweave.sources import tables as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


_RANKED = _SUM + ", pl AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY jaccard DESC, clustering_desc)::INT AS place FROM su WHERE jaccard IS NOT NULL)"


@query(_RANKED + f" SELECT place, {V.describe('jaccard')} FROM pl GROUP BY 1")
def jaccard_by_place(spark: SparkSession, d: str) -> DataFrame:
    """Partitions of each subject in order of agreement; each place described over subjects."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("jaccard"), "clustering_desc")
    s = M.summary(spark, d).where("jaccard is not null")
    return describe(s.withColumn("place", F.row_number().over(w)), ["place"], "jaccard")


@query(_INDEX + " SELECT subject_id, " + ", ".join(f"max(r) FILTER (WHERE index = '{c}') AS {c}" for c in INDICES) + " FROM ix GROUP BY 1")
def index_pivot(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("subject_id").pivot("index", list(INDICES)).agg(F.max("r"))


@query(V.with_(V.SEG) + ", v AS (SELECT DISTINCT subject_id, coalesce(stage, 'none') AS stage, completeness FROM subjects)" + f" SELECT stage, {', '.join(V.r6(f'''avg(relaxed_mae) FILTER (WHERE completeness = '{c}')''') + f' AS {c}' for c in ('complete', 'partial', 'sparse'))} FROM seg JOIN v USING (subject_id) GROUP BY 1")
def mae_by_variant(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "subjects").select("subject_id", F.coalesce("stage", F.lit("none")).alias("stage"), "completeness").distinct()
    x = S.labels(spark, d).join(v, "subject_id")
    return x.groupBy("stage").pivot("completeness", ["complete", "partial", "sparse"]).agg(C.r6(F.avg("relaxed_mae")))


@query(V.with_(V.SEG) + f"SELECT subject_id, {V.r6('avg(relaxed_mae)')} AS mae FROM seg GROUP BY 1 ORDER BY avg(relaxed_mae) DESC NULLS LAST, subject_id LIMIT 1")
def worst_subject(spark: SparkSession, d: str) -> DataFrame:
    m = S.labels(spark, d).groupBy("subject_id").agg(F.avg("relaxed_mae").alias("m"))
    return m.orderBy(F.desc_nulls_last("m"), "subject_id").limit(1).select("subject_id", C.r6(F.col("m")).alias("mae"))


_COUNTS = M._PD + M._RANK + ", av AS (SELECT measure, round(avg(rank) + 1e-9, 3) AS a FROM rn GROUP BY 1)"


@query(_COUNTS + " SELECT (SELECT string_agg(measure, ',' ORDER BY a, measure) FROM (SELECT * FROM av ORDER BY a, measure LIMIT 3)) AS top, (SELECT string_agg(measure, ',' ORDER BY a DESC, measure DESC) FROM (SELECT * FROM av ORDER BY a DESC, measure DESC LIMIT 3)) AS bottom")
def top_and_bottom_column_measures(spark: SparkSession, d: str) -> DataFrame:
    return measures.top_and_bottom(M.column_measure_average_ranks(spark, d), F.col("average_rank"), "measure", 3)


@query()
def top_and_bottom_measures(spark: SparkSession, d: str) -> DataFrame:
    """With the two matrix measures."""
    return measures.top_and_bottom(M.measure_average_ranks(spark, d), F.col("average_rank"), "measure", 3)


@query(V.with_(V.OBS, "t AS (SELECT subject_id, make_timestamp(us) AS ts, ig FROM obs WHERE us IS NOT NULL AND ig IS NOT NULL)") + f"SELECT hour(ts) AS hour, isodow(ts) AS weekday, week(ts) AS week, month(ts) AS month, year(ts) AS year, count(*) AS n, {V.r6('avg(ig)')} AS ig FROM t GROUP BY ALL")
def calendar_means(spark: SparkSession, d: str) -> DataFrame:
    x = S.observations(spark, d, ("ig",)).where("us is not null").withColumn("ts", F.timestamp_micros("us"))
    part = lambda n, f: F.extract(F.lit(f), F.col("ts")).cast("long").alias(n)
    return x.groupBy(part("hour", "HOUR"), part("weekday", "DAYOFWEEK_ISO"), part("week", "WEEK"), part("month", "MONTH"), part("year", "YEAR")).agg(F.count(F.lit(1)).alias("n"), C.r6(F.avg("ig")).alias("ig"))


def _windows(seconds: int, most_gap_s: int) -> str:
    return V.with_(V.OBS, f"g AS (SELECT *, us // {seconds}000000 * {seconds} AS bucket, us - lag(us) OVER (PARTITION BY subject_id, us // {seconds}000000 ORDER BY us, obs_idx) AS gap FROM obs WHERE us IS NOT NULL AND ig IS NOT NULL)") + f"""SELECT subject_id, bucket, count(*) AS n, {V.r6('min(ig)')} AS min, {V.r6('max(ig)')} AS max, {V.r6('avg(ig)')} AS mean, {V.r6('stddev_samp(ig)')} AS std FROM g GROUP BY subject_id, bucket HAVING coalesce(max(gap), 0) <= {most_gap_s}000000"""


def _aggregated(spark: SparkSession, d: str, seconds: int, most_gap_s: int) -> DataFrame:
    x = S.observations(spark, d, ("ig",)).where("us is not null").withColumn("bucket", F.floor(F.col("us") / (seconds * 1_000_000)) * seconds)
    x = x.withColumn("gap", F.col("us") - F.lag("us").over(Window.partitionBy("subject_id", "bucket").orderBy("us", "obs_idx")))
    g = x.groupBy("subject_id", "bucket").agg(F.count(F.lit(1)).alias("n"), *[C.r6(f("ig")).alias(n) for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"), (F.stddev_samp, "std"))], F.max("gap").alias("gap"))
    return g.where(F.coalesce("gap", F.lit(0)) <= most_gap_s * 1_000_000).drop("gap")


@query(_windows(900, 300))
def quarter_hour_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 15 minutes without inner gaps over five minutes."""
    return _aggregated(spark, d, 900, 300)


@query(_windows(3600, 1800))
def hourly_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return _aggregated(spark, d, 3600, 1800)


@query(V.with_(V.OBS, "g AS (SELECT (us - lag(us) OVER (PARTITION BY subject_id ORDER BY us, obs_idx)) / 1e6::DOUBLE AS gap FROM obs WHERE us IS NOT NULL)", "p AS (SELECT quantile_cont(gap, 0.95) AS p95 FROM g)",
                "h AS (SELECT least(floor(gap / (p95 / 20)), 19)::BIGINT AS bin, count(*) AS n FROM g, p WHERE gap <= p95 AND gap >= 0 GROUP BY 1)") + "SELECT bin, n FROM h")
def gap_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Gaps up to their 95th percentile in 20 bins."""
    g = segments.time_gaps(S.observations(spark, d))
    p = exact_percentiles(g, [], "gap_s", (0.95,)).select(F.get("q", F.lit(0)).alias("p95"))  # one row
    x = g.join(F.broadcast(p)).withColumn("bin", F.when((F.col("gap_s") >= 0) & (F.col("gap_s") <= F.col("p95")), F.least(F.floor(F.col("gap_s") / (F.col("p95") / 20)), F.lit(19))))
    return x.where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(V.with_(V.OBS, V.SEG, "w AS (SELECT subject_id, count(*) AS n, count(DISTINCT us // 60000000) AS k FROM obs WHERE us IS NOT NULL GROUP BY 1)", "l AS (SELECT subject_id, segment_id, cluster_id, start_idx, floor(length / (n / k))::BIGINT AS length FROM seg JOIN w USING (subject_id))",
                "c AS (SELECT *, sum(length) OVER (PARTITION BY subject_id ORDER BY start_idx, segment_id ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM l)") + "SELECT subject_id, segment_id, cluster_id, e - length AS start_idx, e - 1 AS end_idx, length FROM c")
def rescaled_labels(spark: SparkSession, d: str) -> DataFrame:
    """Segments of complete data after resampling to minutes: lengths scaled by the mean factor, cut to whole numbers, laid end to end."""
    w = S.observations(spark, d).where("us is not null").groupBy("subject_id", F.floor(F.col("us") / 60_000_000).alias("b")).agg(F.count(F.lit(1)).alias("c")).groupBy("subject_id").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    x = S.labels(spark, d).join(w, "subject_id").withColumn("length", F.floor(F.col("length") / (F.col("n") / F.col("k"))))
    e = F.sum("length").over(Window.partitionBy("subject_id").orderBy("start_idx", "segment_id").rowsBetween(Window.unboundedPreceding, 0))
    return x.select("subject_id", "segment_id", "cluster_id", (e - F.col("length")).alias("start_idx"), (e - 1).alias("end_idx"), "length")


@query(V.with_(V.OBS_F, V.SEG, M._JOINED, V.pearson("j", "subject_id, segment_id"), "b AS (SELECT unnest(['iob-cob', 'iob-ig', 'cob-ig']) AS pair, abs(unnest([a, b, c])) AS r FROM corr)")
       + "SELECT pair, CASE WHEN isnan(r) THEN 'none' WHEN r < 0.1 THEN 'no' WHEN r < 0.3 THEN 'slight' WHEN r < 0.7 THEN 'moderate' ELSE 'strong' END AS band, count(*) AS n FROM (SELECT pair, round(r, 9) AS r FROM b) GROUP BY ALL")
def correlation_bands(spark: SparkSession, d: str) -> DataFrame:
    from strandweave.operators.correlation import _corr
    x = M._by_segment(spark, d).groupBy("subject_id", "segment_id").agg(F.array(*[F.struct(F.lit(f"{a}-{b}").alias("pair"), F.round(F.abs(_corr(a, b)), 9).alias("r")) for a, b in (("iob", "cob"), ("iob", "ig"), ("cob", "ig"))]).alias("x"))
    x = x.select(F.explode("x").alias("x")).select("x.pair", "x.r")
    band = F.when(F.isnan("r"), "none").when(F.col("r") < 0.1, "no").when(F.col("r") < 0.3, "slight").when(F.col("r") < 0.7, "moderate").otherwise("strong")
    return x.groupBy("pair", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
