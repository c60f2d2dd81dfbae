"""Result tables: one layout for all kinds, by data set, variant, completeness and measure; parquet for work, CSV for reading elsewhere."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.sources.tables import BAD_LABELS, LABELS, OBSERVATIONS

KEYS = ("dataset", "stage", "completeness", "measure")
#: The order in which a kind of result reads best; tables have no order of their own.
SORTED: dict[str, Callable[[], list[Column]]] = {
    "partition_quality": lambda: [F.asc_nulls_last("jaccard")], "ranks": lambda: [F.col("criterion"), F.col("rank")], "average_ranks": lambda: [F.col("average_rank"), F.col("measure")]}
#: Declared schemas by kind of file, with the columns that a variant adds.
SCHEMAS: dict[str, T.StructType] = {"observations": OBSERVATIONS, "labels": LABELS, "bad_labels": BAD_LABELS}
ADDED = {"irregular": [T.StructField("old_id", T.LongType())], "resampled": [T.StructField("original_index", T.DoubleType())]}


@dataclass(frozen=True)
class Layout:
    """Paths of results and data under a root; reduced data sets have a part for what was dropped."""

    root: str

    def results(self, kind: str) -> str:
        return f"{self.root}/results/{kind}"

    def data(self, stage: str, completeness: str = "complete") -> str:
        return f"{self.root}/data/completeness={completeness}/stage={stage}"

    def partitions(self, stage: str, completeness: str = "complete") -> str:
        return f"{self.data(stage, completeness)}/bad_partitions"

    def reduced(self, kind: str, clusters: int = 0, segments: int = 0) -> str:
        if bool(clusters) == bool(segments):
            raise ValueError("either clusters or segments are dropped")
        return f"{self.results(kind)}/" + (f"dropped_clusters={clusters}" if clusters else f"dropped_segments={segments}")


def schema_for(kind: str, irregular: bool = False, resampled: bool = False) -> T.StructType:
    """The schema of a kind of file in a variant."""
    base = SCHEMAS[kind]
    if kind != "observations":
        return base
    return T.StructType([*base.fields, *(ADDED["irregular"] if irregular else []), *(ADDED["resampled"] if resampled else [])])


def catalogue(stages: tuple[str, ...] = ("raw", "normal", "non_normal", "resampled_1min"), completeness: tuple[str, ...] = ("complete", "partial", "sparse")) -> list[dict]:
    """Every variant of the data with its files, folders and columns."""
    lay = Layout("")
    return [
        {"stage": s, "completeness": c, "kind": k, "path": lay.partitions(s, c) if k == "bad_labels" else lay.data(s, c), "columns": schema_for(k, c != "complete", s.startswith("resampled_")).names}
        for s in stages for c in completeness for k in SCHEMAS]


def save_result(df: DataFrame, layout: Layout, kind: str, csv: bool = False, **key: str) -> str:
    """Write a result under its keys (dataset, stage, completeness, measure), replacing that part alone. Arrays go into CSV as text."""
    unknown = set(key) - set(KEYS)
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    path = layout.results(kind) + "".join(f"/{k}={key[k]}" for k in KEYS if k in key)
    if csv:
        flat = df.select(*[F.to_json(c).alias(c) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c, f in zip(df.columns, df.schema.fields)])
        flat.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def read_result(spark: SparkSession, layout: Layout, kind: str, csv: bool = False, schema: T.StructType | str | None = None, **key: str) -> DataFrame:
    """A result, or all of a kind below the keys given, in the kind's order; keys below become columns."""
    root = layout.results(kind)
    path = root + "".join(f"/{k}={key[k]}" for k in KEYS if k in key)
    r = spark.read.option("basePath", root)
    r = r.schema(schema) if schema else r
    df = r.option("header", True).option("inferSchema", schema is None).csv(path) if csv else r.parquet(path)
    order = SORTED.get(kind)
    return df.orderBy(*order()) if order else df


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The names of the runs in a registry file."""
    return spark.read.csv(path, header=True).select(F.col("Name").alias("subject_id")).where("subject_id is not null")


def of_runs(df: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of the runs in a registry."""
    return df.join(runs.distinct(), "subject_id", "left_semi")


def read_partition_files(spark: SparkSession, glob: str, schema: T.StructType | None = None) -> DataFrame:
    """Degraded partitions of one file each as one table; `subject_id` and `clustering_desc` come from `<subject>-<strategy>-<number>-labels.parquet`."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(glob)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)-labels\.parquet", 1)
    strategy = r"(wrong-clusters-\d+|shifted-end-idx-\d+|shifted-and-wrong-cluster-\d+)$"
    desc = F.regexp_extract(name, strategy, 1)
    known = {"subject_id": F.regexp_replace(name, "-" + strategy, ""), "clustering_desc": desc}
    return df.select(*[v.alias(c) for c, v in known.items()], *[c for c in df.columns if c not in known])


def read_csv_labels(spark: SparkSession, glob: str) -> DataFrame:
    """Label files in CSV with blanks in their names, as a table with `subject_id` from `<subject>-labels.csv`."""
    df = spark.read.csv(glob, header=True, inferSchema=True, escape='"')
    cols = [F.col(f"`{c}`").alias(c.strip().lower().replace(" ", "_")) for c in df.columns if c and not c.startswith("_c")]
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:-labels)?\.csv", 1).alias("subject_id"), *cols)


def read_runs_of_clusterer(spark: SparkSession, path: str) -> DataFrame:
    """Results of an outside clusterer; the subject is what stands before `:` in the name."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.withColumn("subject_id", F.substring_index("Name", ":", 1))


def read_matrix(spark: SparkSession, path: str, sep: str = ",", header: bool = False) -> DataFrame:
    """A delimited file of numbers as `row, values array<double>`, rows numbered in the order of the file (for files of one partition each)."""
    df = spark.read.csv(path, sep=sep, header=header, inferSchema=True)
    return df.select(F.monotonically_increasing_id().alias("row"), F.array(*[F.col(f"`{c}`").cast("double") for c in df.columns]).alias("values"))


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """Parameters of generated subjects, a row each: `run` and a double for every named column."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.select(F.col(f"`{df.columns[0]}`").cast("int").alias("run"), *[F.col(f"`{c}`").cast("double").alias(c) for c in df.columns[1:]])


def parameter(params: DataFrame, name: str) -> list[float]:
    """One parameter of all runs in their order (tens of rows)."""
    return [r[0] for r in params.orderBy("run").select(name).collect()]


def combined(summaries: dict[str, DataFrame]) -> DataFrame:
    """Summaries of several variants as one long table with a `variant` column."""
    out = None
    for name, df in summaries.items():
        part = df.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no summaries")
    return out
