"""Irregular readings onto a regular grid.

As-of merge of a sorted grid with the readings of each source: every slot without a reading looks
up its neighbours on both sides and is interpolated in proportion to time, if the gap between them
is short enough; otherwise it is marked.

How it scales: readings shuffle once on (source, slot), so a source that holds a third of all rows
still spreads over all tasks; only one row per slot goes on. The as-of lookup runs in chunks of one
day of one source (1440 slots at one minute); slots near a day's edge go to the day beyond it as
well, so that neighbours are found over midnight and no task ever holds a whole source.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_S = 86_400


def instant_us(col: Column | str) -> Column:
    """Microseconds since the epoch of an ISO text with offset; null where it names no instant."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_micros(c.try_cast("timestamp"))


def finite(col: Column) -> Column:
    """The value as double, or null where it is null, NaN or infinite."""
    c = col.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def regular_grid(
    readings: DataFrame,
    source: str = "subject_id",
    reading_id: str = "obs_idx",
    time: str = "datetime",
    variates: tuple[str, ...] = ("iob", "cob", "ig"),
    step_s: int = 60,
    max_gap_s: int = 1800,
) -> DataFrame:
    """One row per source, slot and variate: `<source>, variate, slot, value, status, n_readings`.

    Each source and UTC day has the slots from that of its first reading to that of its last,
    whatever the readings' values. `slot` is the slot's start in epoch seconds. `status` is
    `observed` (value: mean of the finite readings in the slot), `filled` (value: interpolated at
    the slot's middle between the nearest finite readings on both sides, which lie at most
    `max_gap_s` apart, over midnight too) or `missing` (value null).

    Defined cases: readings of unknown time or without source take no part; null, NaN and infinite
    values are no value; repeated and re-sent readings (same source, id and instant) count once, the
    largest finite value standing; a null id is an id like any other; an empty table gives an empty
    grid; other columns of the input are ignored, whatever their names.
    """
    if DAY_S % step_s:
        raise ValueError("step_s must divide a day")
    r = readings.select(
        F.col(source).alias("src"),
        F.col(reading_id).alias("rid"),
        instant_us(time).alias("us"),
        *[finite(F.col(v)).alias(f"v{i}") for i, v in enumerate(variates)],
    ).where("us is not null and src is not null")
    r = r.withColumn("slot", F.floor(F.col("us") / (step_s * 1_000_000)) * step_s)
    n = range(len(variates))
    once = r.repartition("src", "slot").groupBy("src", "slot", "rid", "us").agg(*[F.max(f"v{i}").alias(f"v{i}") for i in n])
    at = [F.when(F.col(f"v{i}").isNotNull(), F.struct("us", F.col(f"v{i}").alias("v"))) for i in n]
    slots = once.groupBy("src", "slot").agg(
        *[a for i in n for a in (F.count(f"v{i}").alias(f"n{i}"), F.avg(f"v{i}").alias(f"m{i}"), F.min(at[i]).alias(f"f{i}"), F.max(at[i]).alias(f"l{i}"))]
    )

    # a slot near a day's edge is context of the day beyond it, as far as a gap may reach
    reach = max_gap_s + step_s
    chunks = F.sequence(F.floor((F.col("slot") - reach) / DAY_S), F.floor((F.col("slot") + reach) / DAY_S))
    slots = slots.withColumn("day", F.explode(chunks)).withColumn("own", F.floor(F.col("slot") / DAY_S) == F.col("day"))
    chunk = Window.partitionBy("src", "day").orderBy("slot")
    up_to = chunk.rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("src", "day").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    merged = slots.select(
        "src", "day", "slot", "own", *[c for i in n for c in (f"n{i}", f"m{i}")],
        F.lead(F.when(F.col("own"), F.col("slot"))).over(chunk).alias("next_slot"),
        *[F.last(f"l{i}", ignorenulls=True).over(up_to).alias(f"p{i}") for i in n],
        *[F.last(f"f{i}", ignorenulls=True).over(past).alias(f"q{i}") for i in n],
    ).where("own")
    grid = merged.select(
        "src", F.col("slot").alias("own"),
        F.explode(F.sequence(F.col("slot"), F.coalesce(F.col("next_slot") - step_s, F.col("slot")), F.lit(step_s))).alias("slot"),
        *[c for i in n for c in (f"n{i}", f"m{i}", f"p{i}", f"q{i}")],
    )
    here = F.col("own") == F.col("slot")
    cells = grid.select(
        "src", "slot",
        F.explode(F.array(*[
            F.struct(
                F.lit(v).alias("variate"),
                F.when(here, F.col(f"n{i}")).otherwise(F.lit(0)).cast("long").alias("n"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"p{i}").alias("p"), F.col(f"q{i}").alias("q"),
            )
            for i, v in enumerate(variates)
        ])).alias("c"),
    )
    p, q, n_ = F.col("c.p"), F.col("c.q"), F.col("c.n")
    mid = (F.col("slot") + step_s / 2) * 1e6
    near = p.isNotNull() & q.isNotNull() & (q["us"] - p["us"] <= F.lit(max_gap_s * 1_000_000))
    line = p["v"] + (q["v"] - p["v"]) * ((mid - p["us"]) / F.greatest(q["us"] - p["us"], F.lit(1)))
    return cells.select(
        F.col("src").alias(source),
        F.col("c.variate").alias("variate"),
        F.col("slot").cast("long").alias("slot"),
        F.when(n_ > 0, F.col("c.mean")).when(near, line).alias("value"),
        F.when(n_ > 0, "observed").when(near, "filled").otherwise("missing").alias("status"),
        n_.alias("n_readings"),
    )


def slots_without_value(grid: DataFrame, source: str = "subject_id") -> DataFrame:
    """The cells of `regular_grid` that no finite reading supports, filled or not."""
    return grid.where(reduce(Column.__or__, [F.col("status") == s for s in ("filled", "missing")])).select(source, "variate", "slot")
