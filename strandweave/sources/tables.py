"""The data model: declared schemas, cleaned views of the tables, sinks.

Every view gives each key once and drops rows that cannot be placed, as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.functions.columns import flags, vector
from strandweave.operators.gridding import finite, instant_us
from strandweave.runtime import table

VARIATES = ("iob", "cob", "ig")
OBSERVATIONS = T.StructType([T.StructField("subject_id", T.StringType()), T.StructField("obs_idx", T.LongType()), T.StructField("datetime", T.StringType()),
                             *[T.StructField(v, T.DoubleType()) for v in VARIATES], T.StructField("received_at", T.TimestampType())])
LABELS = T.StructType([T.StructField("subject_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("segment_id", "start_idx", "end_idx", "length", "cluster_id")],
                       *[T.StructField(c, T.StringType()) for c in ("correlation_to_model", "correlation_achieved", "correlation_achieved_with_tolerance")],
                       T.StructField("mae", T.FloatType()), T.StructField("relaxed_mae", T.FloatType())])
BAD_LABELS = T.StructType([LABELS.fields[0], T.StructField("clustering_desc", T.StringType()), *LABELS.fields[1:]])
PARTITIONS = ("split", "completeness", "stage")


def observations(spark: SparkSession, d: str, needed: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """`subject_id, obs_idx, us, iob, cob, ig` once per key, of keys where all `needed` variates are finite.

    Values that are not finite are null, each variate for itself; `us` is null where the time is
    unknown. Re-sent rows carry the same values; the largest stands. Rows without a key are left out.
    `whole` brings each subject's rows to one task, for work that takes subjects whole without another shuffle.
    """
    o = table(spark, d, "observations", OBSERVATIONS).select("subject_id", "obs_idx", instant_us("datetime").alias("us"), *[finite(F.col(v)).alias(v) for v in VARIATES])
    o = o.where(" and ".join(f"{c} is not null" for c in ("subject_id", "obs_idx", *needed)))
    if whole:
        o = o.repartition("subject_id")
    return o.groupBy("subject_id", "obs_idx").agg(F.max("us").alias("us"), *[F.max(v).alias(v) for v in VARIATES])


def labels(spark: SparkSession, d: str) -> DataFrame:
    """Segments once each, with `model`, `achieved` array<double> and `within` array<boolean>; mae as double, NaN as null."""
    return _parsed(table(spark, d, "segment_labels", LABELS).distinct())


def bad_labels(spark: SparkSession, d: str) -> DataFrame:
    """Degraded segments, one reported row per key; a null end is start + length - 1.

    Of rows sent again, the first stands whole, in order of bounds, cluster, errors and vectors (nulls first).
    """
    b = table(spark, d, "bad_labels", BAD_LABELS)
    k = ["subject_id", "clustering_desc", "segment_id"]
    b = b.withColumn("end_idx", F.coalesce("end_idx", F.col("start_idx") + F.col("length") - 1))
    rest = ["start_idx", "end_idx", "length", "cluster_id", "mae", "relaxed_mae", "correlation_achieved", "correlation_to_model", "correlation_achieved_with_tolerance"]
    return _parsed(b.groupBy(*k).agg(F.min(F.struct(*rest)).alias("_r")).select(*k, "_r.*"))


def _parsed(df: DataFrame) -> DataFrame:
    num = lambda c: F.when(~F.isnan(c), F.round(F.col(c).cast("double"), 6))
    return df.select(
        *[c for c in df.columns if not c.startswith("correlation") and c not in ("mae", "relaxed_mae")],
        vector("correlation_to_model").alias("model"), vector("correlation_achieved").alias("achieved"),
        flags("correlation_achieved_with_tolerance").alias("within"), num("mae").alias("mae"), num("relaxed_mae").alias("relaxed_mae"))


def patterns(spark: SparkSession, d: str) -> DataFrame:
    """`pattern_id, canonical, relaxed, regularisation, ideal` of the whole catalogue (27 rows)."""
    p = table(spark, d, "pattern_catalogue")
    return p.select("pattern_id", vector("canonical_pattern").alias("canonical"), vector("relaxed_pattern").alias("relaxed"), "regularisation", (F.col("is_ideal") == "Yes").alias("ideal"))


def patterns_to_model(spark: SparkSession, d: str) -> DataFrame:
    """The patterns that have a relaxed form (23)."""
    return patterns(spark, d).where("relaxed is not null")


def save(df: DataFrame, path: str, partitions: tuple[str, ...] = PARTITIONS, mode: str = "errorifexists") -> None:
    """Write a table, partitioned by those variant columns it has, so that reads prune by variant."""
    by = [c for c in partitions if c in df.columns]
    w = df.repartition(*by).write.mode(mode) if by else df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, **variant: str) -> DataFrame:
    """Read a table, or one variant of it, by pruning partitions."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    for c, v in variant.items():
        df = df.where(F.col(c) == v)
    return df


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result labels of a clusterer from CSV: names with blanks become names with underscores, the vector is parsed."""
    df = spark.read.csv(path, header=True, inferSchema=True, escape='"')
    df = df.select(*[F.col(f"`{c}`").alias(c.strip().lower().replace(" ", "_")) for c in df.columns if c and not c.startswith("_c")])
    return df.withColumn("achieved", vector("correlation_achieved")) if "correlation_achieved" in df.columns else df
