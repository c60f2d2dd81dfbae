"""Collapse runs of consecutive intervals with equal label into one row each.

Boundary interval lookup: events are sorted once, by entity and position, into partitions of even
size. In a partition's stretch of an entity the positions at which a run starts are gathered into a
sorted array; every event finds its run by binary search in it, and events aggregate by run.

What a partition cannot know is how the run that reaches into it began. Its first island of equal
labels therefore leaves as events, everything else as finished runs; one row per partition tells what
reaches out of it, and from these rows follows what reaches into each. A run that spans partitions then
adds up by ordinary aggregation.

How it scales: partitions are cut by sampled ranges of (entity, position), so an entity that holds a
third of all rows, or many events at one place, spreads over many tasks, and no task holds more than a
batch. The driver gets two rows per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.runtime import written

#: Kinds of rows that a partition sends: a finished run, an event of its first island, its last run, its first event, its last event.
RUN, EVENT, LAST, ENTERS, LEAVES = range(5)


def codes(column: pa.Array) -> np.ndarray:
    """Equal numbers for equal values of a batch; -1 for null."""
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def collapsed_runs(
    events: DataFrame, entity: tuple[str, ...] = ("subject_id", "clustering_desc"), event_id: str = "segment_id",
    start: str = "start_idx", end: str = "end_idx", length: str | None = "length", label: str = "cluster_id",
    max_gap: int = 10, partitions: int | None = None,
) -> DataFrame:
    """One row per run: `<entity>, <label>, <start>, <end>, n_events, covered`.

    Events of an entity stand in order of start, end and id. An event continues the run of the one
    just before it if both have the same non-null label and at most `max_gap` positions lie between
    the largest end of the run so far and its start. An event with null label is a run of its own.
    `covered` counts the positions that the run's events cover, each once.

    Defined cases: a null end is start + length - 1; rows without start, or with neither end nor
    length, take no part; repeated rows (same entity and id) count once (the smallest bounds stand,
    if they differ); null entity columns and null ids are values like any other; `end` before
    `start` covers nothing; an empty table gives no rows; other columns are ignored.
    """
    e = events.select(
        *[F.col(c).alias(f"e{i}") for i, c in enumerate(entity)], F.col(event_id).alias("id"),
        F.col(start).cast("long").alias("s"),
        F.coalesce(F.col(end), F.col(start) + F.col(length) - 1 if length else F.lit(None)).cast("long").alias("t"),
        F.col(label).alias("k"),
    ).where("s is not null and t is not null")
    ent = [f"e{i}" for i in range(len(entity))]
    e = e.groupBy(*ent, "id").agg(F.min(F.struct("s", "t", "k")).alias("x")).select(*ent, "x.s", "x.t", "id", "x.k")
    order = [*ent, "s", "t", "id"]
    e = (e.repartitionByRange(partitions, *order) if partitions else e.repartitionByRange(*order)).sortWithinPartitions(*order).select(*ent, "s", "t", "k")
    kinds = {f.name: f.dataType.simpleString() for f in e.schema.fields}
    names = ["kind", "part", "no", *ent, "k", "s", "t", "began", "n", "covered"]
    schema = ", ".join(f"{c} {kinds[c] if c in (*ent, 'k') else 'int' if c in ('kind', 'part') else 'long'}" for c in names)
    m = len(ent)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own: tuple | None = None  # entity and label of the event before, as Arrow arrays of one value
        reach = no = began = 0
        inside = True  # still in the partition's first island
        open_: list[int] | None = None  # (s, t, n, covered) of the last run, if it began behind the first island

        def row(kind: int, no: int, at: tuple, s: int, t: int, began: int, n: int, covered: int) -> pa.RecordBatch:
            head = [pa.array([v], w) for v, w in ((kind, pa.int32()), (part, pa.int32()), (no, pa.int64()))]
            return pa.RecordBatch.from_arrays([*head, *at, *[pa.array([v], pa.int64()) for v in (s, t, began, n, covered)]], names=names)

        for b in batches:
            size = b.num_rows
            if not size:
                continue
            s, t = b.column(m).to_numpy(), b.column(m + 1).to_numpy()
            one = lambda i: tuple(b.column(c).slice(i, 1) for c in (*range(m), m + 2))  # noqa: B023, E731
            fresh = own is None or any(a.to_pylist() != c.to_pylist() for a, c in zip(own[:-1], one(0)[:-1]))
            k = codes(b.column(m + 2))
            cut = np.empty(size, bool)
            cut[0] = fresh or k[0] < 0 or own[-1].to_pylist() != one(0)[-1].to_pylist()
            cut[1:] = np.logical_or.reduce([np.diff(codes(b.column(c))) != 0 for c in range(m)]) | (np.diff(k) != 0) | (k[1:] < 0)
            if own is None:
                yield row(ENTERS, 0, one(0), int(s[0]), int(t[0]), 0, 0, 0)

            # the largest end of the island before each event
            island = np.cumsum(cut)
            low = min(int(t.min()), reach)
            wide = max(int(t.max()), reach) - low + 1
            top = np.maximum.accumulate(np.r_[reach - low, t - low + island * wide])
            before = top[:-1] - np.r_[0, island[:-1]] * wide + low
            starts = cut | (s - before - 1 > max_gap)
            from_ = np.where(starts, s, np.maximum(s, before + 1))
            covered = np.maximum(0, t - from_ + 1)
            number = no + np.cumsum(starts)
            at = np.flatnonzero(starts)  # sorted starts; every event finds its run among them
            run = np.searchsorted(at, np.arange(size), side="right") - 1
            s0 = np.where(run >= 0, s[at[run]] if len(at) else began, began)

            first = int(np.searchsorted(island, 1 if own is None else 0, side="right")) if inside else 0
            if first:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(first, EVENT, np.int32)), pa.array(np.full(first, part, np.int32)), pa.array(number[:first]), *[b.column(c).slice(0, first) for c in (*range(m), m + 2)],
                     pa.array(from_[:first]), pa.array(t[:first]), pa.array(s0[:first]), pa.array(np.ones(first, np.int64)), pa.array(covered[:first])], names=names)
            if first < size:
                a = at[at >= first]
                lead = int(a[0]) if len(a) else size
                if lead > first:  # events that continue the open run
                    open_ = [open_[0], max(open_[1], int(t[first:lead].max())), open_[2] + lead - first, open_[3] + int(covered[first:lead].sum())]
                if len(a):
                    if open_ is not None:
                        yield row(RUN, 0, own, open_[0], open_[1], open_[0], open_[2], open_[3])
                    ends, n, c = np.maximum.reduceat(t, a), np.diff(np.r_[a, size]), np.add.reduceat(covered, a)
                    done = len(a) - 1
                    if done:
                        idx = pa.array(a[:-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(done, RUN, np.int32)), pa.array(np.full(done, part, np.int32)), pa.array(number[a[:-1]]), *[b.column(x).take(idx) for x in (*range(m), m + 2)],
                             pa.array(s[a[:-1]]), pa.array(ends[:-1]), pa.array(s[a[:-1]]), pa.array(n[:-1]), pa.array(c[:-1])], names=names)
                    open_ = [int(s[a[-1]]), int(ends[-1]), int(n[-1]), int(c[-1])]
            inside = inside and first == size
            own, reach, no, began = one(size - 1), int(top[-1] - island[-1] * wide + low), int(number[-1]), int(s0[-1])
        if own is not None:
            if open_ is not None:
                yield row(LAST, no, own, open_[0], open_[1], open_[0], open_[2], open_[3])
            yield row(LEAVES, no, own, 0, reach, began, int(inside), 0)

    sent = written(e.mapInArrow(scan, schema))
    plan = entering(sent.where(f"kind >= {ENTERS}").collect(), ent, max_gap)  # two rows of each partition
    into = events.sparkSession.createDataFrame(plan, "part int, reached long, from_part int, from_no long")
    x = sent.where(f"kind in ({EVENT}, {LAST})").join(F.broadcast(into), "part", "left")  # as small as the number of partitions
    joins = F.coalesce((F.col("kind") == EVENT) & (F.col("began") - F.col("reached") - 1 <= max_gap), F.lit(False))
    over = F.greatest(F.lit(0), F.col("t") - F.greatest(F.col("s") - 1, F.col("reached")))
    x = x.select(F.when(joins, F.col("from_part")).otherwise(F.col("part")).alias("part"), F.when(joins, F.col("from_no")).otherwise(F.col("no")).alias("no"), *ent, "k",
                 F.when(~joins, F.col("began")).alias("s"), "t", "n", F.when(joins, over).otherwise(F.col("covered")).alias("covered"))
    edge = x.groupBy("part", "no", *ent, "k").agg(F.min("s").alias("s"), F.max("t").alias("t"), F.sum("n").alias("n"), F.sum("covered").alias("covered")).select(*ent, "k", "s", "t", "n", "covered")
    all_ = sent.where(f"kind = {RUN}").select(*ent, "k", "s", "t", "n", "covered").unionByName(edge)
    return all_.select(*[F.col(x).alias(c) for x, c in zip(ent, entity)], F.col("k").alias(label), F.col("s").cast("int").alias(start), F.col("t").cast("int").alias(end), F.col("n").alias("n_events"), "covered")


def entering(rows: list, ent: list[str], max_gap: int) -> list[tuple]:
    """(partition, largest end that reaches into its first island, partition and number of the run that does) of partitions that continue an island."""
    edges = {(r["part"], r["kind"]): r for r in rows}
    told, now = [], None
    value = lambda r: (*[r[c] for c in ent], r["k"])
    for p in sorted({r["part"] for r in rows}):
        first, last = edges[p, ENTERS], edges[p, LEAVES]
        came = now if now is not None and now[0] == value(first) and first["k"] is not None else None
        if came:
            told.append((p, *came[1:]))
        reach, run = last["t"], (p, last["no"])
        if came and last["n"]:  # one island fills the partition
            if last["began"] - came[1] - 1 <= max_gap:
                run = came[2:]
            reach = max(reach, came[1])
        now = (value(last), reach, *run) if last["k"] is not None else None
    return told
