"""Segments over ordered observations: interval joins, runs, resampling, degraded and reduced variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.describe import same_keys

BLOCK = 256


def interval_join(obs: DataFrame, segments: DataFrame, how: str = "inner", block: int = BLOCK) -> DataFrame:
    """Observations with the segments whose `start_idx`..`end_idx` (inclusive) hold their `obs_idx`.

    Segments are cut at the blocks of `block` positions they touch, and both sides meet by equal
    (subject, block) with a range condition, so the work follows the result and a subject that holds
    a third of all rows spreads over its blocks. `how` may be inner or left_semi. Segments with null
    bounds match nothing.
    """
    s = segments.where("start_idx is not null and end_idx >= start_idx").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor(F.col("end_idx") / block))))
    s = s.withColumnRenamed("subject_id", "_s")
    o = obs.withColumn("_b0", F.floor(F.col("obs_idx") / block))
    on = (F.col("subject_id") == F.col("_s")) & (F.col("_b0") == F.col("_b")) & F.col("obs_idx").between(F.col("start_idx"), F.col("end_idx"))
    return o.join(s, on, how).drop("_b0", "_b", "_s")


def numbered(df: DataFrame, by: list[str], chunk: Column, order: list[str], name: str) -> DataFrame:
    """Adds the 0-based number of each row in its group's order. `chunk` must rise with the order; rows are numbered within a chunk, and chunks add the counts before them."""
    x = df.withColumn("_c", chunk)
    n = x.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("_base", F.sum("_n").over(Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).drop("_n")
    x = same_keys(x.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_c").orderBy(*order))), n, [*by, "_c"])
    return x.withColumn(name, (F.col("_k") + F.col("_base") - 1).cast("long")).drop("_c", "_k", "_base")


def runs_to_segments(df: DataFrame, by: list[str], order: list[str], value: str, position: str | None, chunk: Column | None = None) -> DataFrame:
    """Runs of equal values in order: `<by>, segment_id, value, start_idx, end_idx, length`.

    Bounds are values of `position`, or 0-based numbers in order without it. `chunk` must rise with the
    order: a group is then worked on chunk by chunk, and only the last value and counts of each chunk
    pass between them. Without it a group is one window.
    """
    x = df.select(*by, *[c for c in dict.fromkeys([*order, value, *([position] if position else [])]) if c not in by], (F.lit(0) if chunk is None else chunk).alias("_c"))
    w = Window.partitionBy(*by, "_c").orderBy(*order)
    over = Window.partitionBy(*by).orderBy("_c")
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    last = x.groupBy(*by, "_c").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_l"), F.count(F.lit(1)).alias("_n"))
    last = last.select(*by, "_c", F.lag("_l").over(over).alias("_b"), (F.sum("_n").over(so_far) - F.col("_n")).alias("_from"))
    x = x.withColumn("_k", F.row_number().over(w)).withColumn("_p", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    x = same_keys(x, last, [*by, "_c"])
    before = F.when(F.col("_k") == 1, F.col("_b")).otherwise(F.col("_p"))
    x = x.withColumn("_new", (before.isNull() | ~before["v"].eqNullSafe(F.col(value))).cast("int"))
    x = x.withColumn("_in", F.sum("_new").over(Window.partitionBy(*by, "_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col(position) if position else (F.col("_from") + F.col("_k") - 1).cast("long")
    # runs within chunks first, which are few; then they join over chunks
    r = x.groupBy(*by, "_c", "_in").agg(F.min(value).alias("value"), F.min(at).alias("s"), F.max(at).alias("e"), F.count(F.lit(1)).alias("n"), F.sum("_new").alias("_new"))
    r = r.withColumn("segment_id", F.sum("_new").over(Window.partitionBy(*by).orderBy("_c", "_in").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return r.groupBy(*by, "segment_id").agg(F.min("value").alias("value"), F.min("s").alias("start_idx"), F.max("e").alias("end_idx"), F.sum("n").alias("length"))


def exploded(segments: DataFrame, *keep: str) -> DataFrame:
    """One row per position of each segment."""
    return segments.select(*keep, F.explode(F.sequence(F.col("start_idx").cast("long"), F.col("end_idx").cast("long"))).alias("obs_idx"))


def best_overlap(buckets: DataFrame, segments: DataFrame, by: list[str], bucket: list[str]) -> DataFrame:
    """For each bucket the segment that shares most of its observations; ties go to the first in order of start.

    `buckets` has one row per observation: `<by>, <bucket>, obs_idx`. A bucket that no segment covers is absent.
    """
    n = interval_join(buckets, segments).groupBy(*by, *bucket, "segment_id").agg(F.count(F.lit(1)).alias("shared"), F.min("start_idx").alias("_start"))
    best = F.max(F.struct(F.col("shared"), (-F.col("_start")).alias("s"), (-F.col("segment_id")).alias("i")))
    return n.groupBy(*by, *bucket).agg(best.alias("b")).select(*by, *bucket, (-F.col("b.i")).alias("segment_id"), F.col("b.shared").alias("shared"))


def tumbling_mean(obs: DataFrame, seconds: int, columns: tuple[str, ...]) -> DataFrame:
    """Means per subject and window of event time, with the range and number of source rows; empty windows don't occur."""
    x = obs.where("us is not null").withColumn("bucket", F.floor(F.col("us") / (seconds * 1_000_000)) * seconds)
    return x.groupBy("subject_id", "bucket").agg(*[F.bround(F.round(F.avg(c), 9), 3).alias(c) for c in columns], F.min("obs_idx").alias("first_idx"), F.max("obs_idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))


def portable_hash(c: Column) -> Column:
    """A hash order that other engines can compute too."""
    return F.pmod(c * 7919, F.lit(10007))


def sparsified(obs: DataFrame, drop: float) -> DataFrame:
    """Exactly round((1 - drop) n) rows of each subject, chosen by hash, newly numbered in order; `old_idx` keeps the number.

    The hash has few values, so its counts give the threshold of each subject (a small table); only
    rows at the threshold itself are ranked. Numbers come from counts per block of positions.
    """
    o = obs.withColumn("_h", portable_hash(F.col("obs_idx")))
    h = o.groupBy("subject_id", "_h").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("subject_id")
    h = h.withColumn("_upto", F.sum("_n").over(w.orderBy("_h").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_keep", F.bround(F.round(F.sum("_n").over(w) * (1 - drop), 6), 0))
    h = h.withColumn("_room", F.col("_keep") - (F.col("_upto") - F.col("_n"))).where("_room > 0").select("subject_id", "_h", "_n", "_room")
    o = o.join(h, ["subject_id", "_h"])
    o = o.withColumn("_k", F.row_number().over(Window.partitionBy("subject_id", "_h").orderBy("obs_idx"))).where(F.col("_k") <= F.col("_room"))
    o = o.drop("_h", "_n", "_room", "_k").withColumn("_b", F.floor(F.col("obs_idx") / 4096))
    base = o.groupBy("subject_id", "_b").agg(F.count(F.lit(1)).alias("_n"))
    base = base.select("subject_id", "_b", (F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base"))
    o = o.join(base, ["subject_id", "_b"])
    new = F.col("_base") + F.row_number().over(Window.partitionBy("subject_id", "_b").orderBy("obs_idx")) - 1
    return o.withColumn("new_idx", new.cast("long")).withColumnRenamed("obs_idx", "old_idx").withColumnRenamed("new_idx", "obs_idx").drop("_b", "_base")


def relabelled(obs: DataFrame, segments: DataFrame, least: int = 3) -> DataFrame:
    """Segments over sparsified observations: bounds by new numbers; those with fewer than `least` rows are dropped."""
    x = interval_join(obs.select("subject_id", F.col("obs_idx").alias("_new"), F.col("old_idx").alias("obs_idx")), segments.select("subject_id", "segment_id", "start_idx", "end_idx", "cluster_id"))
    return x.groupBy("subject_id", "segment_id", "cluster_id").agg(F.min("_new").alias("start_idx"), F.max("_new").alias("end_idx"), F.count(F.lit(1)).alias("length")).where(F.col("length") >= least)


def ordered(segments: DataFrame, by: list[str]) -> tuple[DataFrame, Window]:
    w = Window.partitionBy(*by).orderBy("start_idx", "end_idx", "segment_id")
    x = segments.withColumn("_first", F.row_number().over(w) == 1).withColumn("_last", F.lead("segment_id").over(w).isNull())
    return x, w


def shifted(segments: DataFrame, by: list[str], k: int | Column, least: int = 3) -> DataFrame:
    """Boundaries moved by k, but for the first start and the last end; segments that begin too late are dropped, the last kept ends at the end."""
    x, _ = ordered(segments, by)
    n = F.max("end_idx").over(Window.partitionBy(*by))
    x = x.withColumn("_n", n).withColumn("start_idx", F.when(F.col("_first"), F.col("start_idx")).otherwise(F.col("start_idx") + k))
    x = x.withColumn("end_idx", F.when(F.col("_last"), F.col("end_idx")).otherwise(F.least(F.col("end_idx") + k, F.col("_n"))))
    x = x.where(F.col("_first") | (F.col("start_idx") <= F.col("_n") - least)).drop("_first", "_last")
    x, _ = ordered(x, by)
    x = x.withColumn("end_idx", F.when(F.col("_last"), F.col("_n")).otherwise(F.col("end_idx")))
    return x.withColumn("length", F.col("end_idx") - F.col("start_idx") + 1).drop("_first", "_last", "_n")


def wrong_clusters(segments: DataFrame, by: list[str], n: int | Column, clusters: Column) -> DataFrame:
    """The first n segments by hash get another cluster: the next after their own in the sorted array `clusters`."""
    w = Window.partitionBy(*by).orderBy(portable_hash((F.col("segment_id") + 1).cast("long")), "segment_id")
    at = F.array_position(clusters, F.col("cluster_id"))
    other = F.element_at(clusters, (F.pmod(at, F.size(clusters)) + 1).cast("int"))
    return segments.withColumn("_k", F.row_number().over(w)).withColumn("cluster_id", F.when(F.col("_k") <= n, other).otherwise(F.col("cluster_id"))).drop("_k")


def chosen_counts(most: Column, n: int) -> Column:
    """At most n - 1 numbers below `most`, in order of their hash, and `most` itself, ascending."""
    some = F.when(most > 1, F.slice(F.array_sort(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(most - 1, F.lit(1)).cast("long")), lambda v: F.struct(portable_hash(v).alias("h"), v.alias("v")))), 1, n - 1))
    some = F.transform(F.coalesce(some, F.array().cast("array<struct<h:bigint,v:bigint>>")), lambda x: x["v"])
    return F.array_sort(F.array_append(some, most.cast("long")))


def degraded(segments: DataFrame, n: int = 22, leave: int = 100) -> DataFrame:
    """Three strategies of up to n partitions for each subject: clusters made wrong, boundaries shifted, and both.

    How many segments get a wrong cluster, and by how many positions boundaries move, rises from
    partition to partition; the last changes all segments, or moves by the shortest length less
    `leave`, at least `leave`. Which, and to what, goes by hash. The ids of clusters are few (a catalogue).
    """
    by = ["subject_id", "clustering_desc"]
    size = segments.groupBy("subject_id").agg(chosen_counts(F.count(F.lit(1)), n).alias("k"), chosen_counts(F.greatest(F.min("length") - leave, F.lit(leave)), n).alias("s"))
    one = lambda name, k, s, p: F.struct(F.concat(F.lit(name), p.cast("string")).alias("clustering_desc"), p.cast("long").alias("_p"), k.alias("_k"), s.alias("_shift"))
    zero = F.lit(0).cast("long")
    specs = F.concat(
        F.transform("k", lambda v, i: one("wrong-clusters-", v, zero, i)), F.transform("s", lambda v, i: one("shifted-end-idx-", zero, v, i)),
        F.filter(F.transform("k", lambda v, i: one("shifted-and-wrong-cluster-", v, F.get("s", i), i)), lambda z: z["_shift"].isNotNull()))
    ids = segments.groupBy().agg(F.array_sort(F.collect_set("cluster_id")).alias("_ids"))  # one row
    x = segments.drop("length").join(size.select("subject_id", F.explode(specs).alias("x")).select("subject_id", "x.*"), "subject_id").join(F.broadcast(ids))
    w = Window.partitionBy(*by).orderBy(F.pmod((F.col("segment_id") + 1).cast("long") * 7919 + F.col("_p") * 104729, F.lit(10007)), "segment_id")
    at, many = F.array_position("_ids", F.col("cluster_id")), F.size("_ids")
    other = F.get("_ids", ((at + F.pmod((F.col("segment_id") + 1).cast("long") * 7919 + F.col("_p") * 31, F.lit(10007)) % (many - 1)) % many).cast("int"))
    x = x.withColumn("_h", F.row_number().over(w)).withColumn("cluster_id", F.when((F.col("_h") <= F.col("_k")) & (at > 0) & (many > 1), other).otherwise(F.col("cluster_id")))
    out = shifted(x, by, F.col("_shift"))
    return out.select(*by, "segment_id", "cluster_id", F.col("start_idx").cast("long").alias("start_idx"), F.col("end_idx").cast("long").alias("end_idx"), F.col("length").cast("long").alias("length"))


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """`<by>, value, times_used, n_observations, mean_length, min_length, max_length, n_of_one` of runs."""
    n = F.col("length")
    return runs.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("times_used"), F.sum(n).alias("n_observations"), F.round(F.avg(n) + 1e-9, 3).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.count_if(n == 1).alias("n_of_one"))


def reduced(segments: DataFrame, keep: Column) -> DataFrame:
    """The kept segments laid end to end: new bounds, with `old_start_idx` for moving the data along."""
    x = segments.where(keep)
    w = Window.partitionBy("subject_id").orderBy("start_idx", "segment_id").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("old_start_idx", F.col("start_idx")).withColumn("_end", F.sum("length").over(w))
    return x.withColumn("start_idx", F.col("_end") - F.col("length")).withColumn("end_idx", F.col("_end") - 1).drop("_end")


def time_gaps(obs: DataFrame, by: str = "subject_id") -> DataFrame:
    """Seconds between successive observations of known time, without the first; days are worked on apart, and each takes the last time of the day with rows before it."""
    x = obs.where("us is not null").select(by, "us", "obs_idx", F.floor(F.col("us") / 86_400_000_000).alias("_d"))
    inside = x.select(by, (F.col("us") - F.lag("us").over(Window.partitionBy(by, "_d").orderBy("us", "obs_idx"))).alias("g"))
    days = x.groupBy(by, "_d").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    between = days.select(by, (F.col("a") - F.lag("b").over(Window.partitionBy(by).orderBy("_d"))).alias("g"))
    return inside.unionByName(between).where("g is not null").select(by, (F.col("g") / 1e6).alias("gap_s"))
