"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import bpe, language, linkage, mixing, oracles, percentiles, runs, similar, vectors
from strandweave.operators.gridding import DAY_S, instant_us
from strandweave.runtime import table, written

DIGITS = 10
ORACLES = oracles.ORACLES


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _ig_states(spark: SparkSession, d: str) -> DataFrame:
    """States of ig per subject and UTC day; a reading that came more than once counts once."""
    o = table(spark, d, "observations").select("subject_id", "obs_idx", F.floor(instant_us("datetime") / (DAY_S * 1_000_000)).alias("day"), "ig")
    return written(percentiles.digit_state(o.where("day is not null").distinct(), ["subject_id", "day"], "ig", DIGITS))


def p1_ig_by_day(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(percentiles.select_percentiles(_ig_states(spark, d), ["subject_id", "day"], mantissa_bits=DIGITS))


def p1_ig_joined_days(spark: SparkSession, d: str) -> DataFrame:
    """The days' states joined into one span per subject."""
    return _rounded(percentiles.select_percentiles(percentiles.merged_states(_ig_states(spark, d), ["subject_id"]), ["subject_id"], mantissa_bits=DIGITS))


def p1_ig_exact(spark: SparkSession, d: str) -> DataFrame:
    """As p1_ig_by_day with whole mantissas: exact."""
    o = table(spark, d, "observations").select("subject_id", "obs_idx", F.floor(instant_us("datetime") / (DAY_S * 1_000_000)).alias("day"), "ig").where("day is not null").distinct()
    return _rounded(percentiles.select_percentiles(written(percentiles.digit_state(o, ["subject_id", "day"], "ig", 52)), ["subject_id", "day"], mantissa_bits=52, digit_bits=16))


def p1_ig_error(spark: SparkSession, d: str) -> DataFrame:
    """The stated bound against exact percentiles: groups, percentiles compared, and whether all lie within 2**-(DIGITS + 1) of the exact value."""
    names = [c for c in p1_ig_by_day(spark, d).columns if c.startswith("p")]
    exact = p1_ig_exact(spark, d).select("subject_id", "day", *[F.col(c).alias(f"e_{c}") for c in names])
    x = percentiles.matched(p1_ig_by_day(spark, d), exact, ["subject_id", "day"])
    off = F.greatest(*[F.abs(F.col(c) - F.col(f"e_{c}")) - F.abs(F.col(f"e_{c}")) * 2.0 ** -(DIGITS + 1) for c in names])
    return x.agg(F.count(F.lit(1)).alias("n_groups"), (F.count(F.lit(1)) * len(names)).alias("n_compared"), F.bool_and(off <= 2e-6).alias("within"))


def p1_labels(spark: SparkSession, d: str) -> DataFrame:
    """mae and length by cluster_id and by clustering_desc, exactly; each reported value of a segment counts once."""
    b = table(spark, d, "bad_labels").select("subject_id", "clustering_desc", "segment_id", "cluster_id", F.col("mae").cast("double").alias("mae"), F.col("length").cast("double").alias("length"))
    one = lambda g, m: F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("key"), F.lit(m).alias("measure"), F.col(m).alias("value"))
    long = b.select("subject_id", "clustering_desc", "segment_id", F.explode(F.array(*[one(g, m) for g in ("cluster_id", "clustering_desc") for m in ("mae", "length")])).alias("x"))
    long = long.select("subject_id", "clustering_desc", "segment_id", "x.*").distinct()
    g = ["grouping", "key", "measure"]
    return _rounded(percentiles.select_percentiles(written(percentiles.digit_state(long, g, "value", 52)), g, mantissa_bits=52, digit_bits=16))


def p3_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapsed_runs(table(spark, d, "bad_labels"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_runs(spark, d).where("n_events >= 2").select("subject_id", "clustering_desc", "start_idx", "end_idx")


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "result_labels")
    return similar.nearest_vectors(vectors.packed_texts(labels), size=labels.count(), drawn=_drawn(spark, labels))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of p4_neighbours: the ids divisible by 100 against all vectors by brute force."""
    v = vectors.packed_texts(table(spark, d, "result_labels"))
    truth = similar.exact_neighbours(v, v.where("vec_id % 100 = 0"))
    return similar.recall(p4_neighbours(spark, d).where("vec_id % 100 = 0"), truth)


def _drawn(spark: SparkSession, labels: DataFrame):  # noqa: ANN202
    """The sample that a forest is fitted on: 2,000 vectors, or 40 for each partition."""
    return vectors.drawn_texts(labels, max(2000, 40 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    labels = table(spark, d, "result_labels")
    return linkage.similarity_clusters(vectors.packed_texts(labels), size=labels.count(), drawn=_drawn(spark, labels))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.near_pairs(p4_neighbours(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)[0].where("size >= 5 and vec_id != first_vec_id").select("first_vec_id", "vec_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster with its size, spread, most typical segments and the cluster_id most often reported for it."""
    people, clusters = _clusters(spark, d)
    told = table(spark, d, "result_labels").where("vec_id is not null").groupBy("vec_id").agg(F.min("cluster_id").alias("cluster_id"))
    votes = people.join(told, "vec_id", "left").groupBy("first_vec_id", "cluster_id").agg(F.count(F.lit(1)).alias("n"))
    most = votes.where("cluster_id is not null").groupBy("first_vec_id").agg(F.max(F.struct("n", (-F.col("cluster_id")).alias("c"))).alias("m"))
    return clusters.join(most, "first_vec_id", "left").select(
        "first_vec_id", "size", "spread", "typical", (-F.col("m.c")).alias("reported_cluster_id"), F.round(F.col("m.n") / F.col("size"), 6).alias("reported_share"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encoded(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"), table(spark, d, "lang_aliases"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_mix(spark, d)[1])


def p7_marginals(spark: SparkSession, d: str) -> DataFrame:
    """Shares of languages and topics, wanted and reached."""
    return _rounded(_mix(spark, d)[2])


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return language.languages(docs, language.trained(docs, table(spark, d, "lang_aliases")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.label_faults(p8_languages(spark, d), table(spark, d, "lang_aliases"))


QUERIES = {
    "p1_ig_by_day": p1_ig_by_day,
    "p1_ig_joined_days": p1_ig_joined_days,
    "p1_ig_exact": p1_ig_exact,
    "p1_ig_error": p1_ig_error,
    "p1_labels": p1_labels,
    "p3_found": p3_found,
    "p3_runs": p3_runs,
    "p4_found": p4_found,
    "p4_neighbours": p4_neighbours,
    "p4_recall": p4_recall,
    "p5_found": p5_found,
    "p5_clusters": p5_clusters,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p7_marginals": p7_marginals,
    "p8_found": p8_found,
    "p8_languages": p8_languages,
}
