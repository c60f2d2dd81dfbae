"""Usable vectors from text, packed without loss, and groups of exact copies.

Vectors travel packed: a byte that tells the form, then the numbers as 16-bit integers where all are
whole multiples of 10^-3 or 10^-4 in that range, else as doubles. A fingerprint of 128 bits stands
for a vector wherever equality matters, so no join or grouping compares arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
PACKED = "vec_id long, fp binary, vec binary"


def packed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of finite numbers as bytes."""
    out = np.full(len(x), None, object)
    todo = np.ones(len(x), bool)
    for digits in (3, 4):
        if not todo.any():
            break
        with np.errstate(over="ignore"):
            q = np.rint(x * 10.0**digits)
        ok = todo & (np.abs(q) <= 32767).all(1) & (q / 10.0**digits == x).all(1)
        if ok.any():
            rows = q[ok].astype("<i2")
            out[ok] = [bytes((digits,)) + r.tobytes() for r in rows]
            todo &= ~ok
    if todo.any():
        out[todo] = [b"\0" + r.tobytes() for r in x[todo].astype("<f8")]
    return pa.array(out, pa.binary())


def unpacked(column: pa.Array) -> np.ndarray:
    """The matrix of packed vectors of one length."""
    n = len(column)
    if not n:
        return np.zeros((0, 1))
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    form = data[ends[:-1]]
    dims = int((ends[1] - ends[0] - 1) // (8 if form[0] == 0 else 2))
    x = np.empty((n, dims))
    for f in np.unique(form):
        at = np.flatnonzero(form == f)
        width = dims * (8 if f == 0 else 2)
        raw = np.ascontiguousarray(data[(ends[at] + 1)[:, None] + np.arange(width)])
        x[at] = raw.view("<f8") if f == 0 else raw.view("<i2") / 10.0 ** int(f)
    return x


def fingerprints(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x + 0.0)  # -0.0 becomes 0.0
    return pa.array([hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in x], pa.binary())


def numbers(texts: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows whose text holds exactly `dims` finite numbers, their numbers)."""
    t = pc.fill_null(texts, "")
    for mark in "[]()":
        t = pc.replace_substring(t, mark, " ")
    commas = pc.equal(pc.count_substring(t, ","), dims - 1).to_numpy(zero_copy_only=False)
    one, two = np.flatnonzero(commas), np.flatnonzero(~commas)
    parts = [_numbers(one, pc.split_pattern(t.take(pa.array(one)), ","), dims)]
    if len(two) or len(parts[0][0]) < len(one):  # other separators
        two = np.setdiff1d(np.arange(len(t)), parts[0][0])
        parts.append(_numbers(two, pc.split_pattern_regex(pc.utf8_trim_whitespace(t.take(pa.array(two))), r"\s*[,;\s]\s*"), dims))
    rows, x = np.concatenate([p[0] for p in parts]), np.vstack([p[1] for p in parts])
    o = np.argsort(rows, kind="stable")
    return rows[o], x[o]


def _numbers(rows: np.ndarray, parts: pa.ListArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, numbers) of split texts; rows that are not `dims` finite numbers are left out."""
    fit = np.flatnonzero(pc.equal(pc.list_value_length(parts), dims).to_numpy(zero_copy_only=False))
    rows = rows[fit]
    flat = pc.utf8_trim_whitespace(pc.list_flatten(parts.take(pa.array(fit))))
    try:
        x = pc.cast(flat, pa.float64())
    except pa.ArrowInvalid:  # a sign before, a number beyond the range of doubles, or no number at all
        ok = pc.match_substring_regex(flat, NUMBER).to_numpy(zero_copy_only=False).reshape(-1, dims).all(1)
        rows = rows[ok]
        x = pa.array([float(v) for v in flat.filter(pa.array(np.repeat(ok, dims))).to_pylist()], pa.float64())
    x = x.to_numpy(zero_copy_only=False).reshape(-1, dims)
    fine = np.isfinite(x).all(1)
    return rows[fine], x[fine]


def packed_texts(df: DataFrame, vec_id: str = "vec_id", text: str = "correlation_achieved", dims: int = 45) -> DataFrame:
    """`vec_id, fp, vec` of each row with an id and a usable text; ids may repeat.

    Brackets, blanks, signs and exponents may vary. Null and empty texts, other lengths, unreadable
    and non-finite numbers make a vector unusable; null ids are left out; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = numbers(b.column(1), dims)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), fingerprints(x), packed(x)], names=["vec_id", "fp", "vec"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(text).cast("string").alias("t")).where("vec_id is not null and t is not null").mapInArrow(run, PACKED)


def packed_frame(df: DataFrame) -> DataFrame:
    """`vec_id, fp, vec` of `vec_id, vec array<double>` without nulls; a packed frame stays as it is."""
    if "fp" in df.columns:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), fingerprints(x), packed(x)], names=["vec_id", "fp", "vec"])

    return df.select(F.col("vec_id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(run, PACKED)


def usable_vectors(df: DataFrame, vec_id: str = "vec_id", text: str = "correlation_achieved", dims: int = 45) -> DataFrame:
    """`vec_id, vec array<double>`: each id once, of the usable texts (see `packed_texts`).

    Of an id with several vectors, that of the smallest fingerprint stands.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unpacked(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["vec_id", "vec"])

    one = packed_texts(df, vec_id, text, dims).groupBy("vec_id").agg(F.min(F.struct("fp", "vec")).alias("x"))
    return one.select("vec_id", "x.vec").mapInArrow(run, "vec_id long, vec array<double>")


def shuffled(x: np.ndarray) -> np.ndarray:
    """The different rows in a fixed random order."""
    x = np.unique(x, axis=0)
    return x[np.random.default_rng(1).permutation(len(x))]


def drawn_texts(df: DataFrame, bound: int, vec_id: str = "vec_id", text: str = "correlation_achieved", dims: int = 45) -> np.ndarray:
    """At most `bound` different usable vectors, of rows drawn by hash of the id: texts are read for these alone."""
    t = df.select(text, F.xxhash64(F.col(vec_id)).alias("h")).where(f"{text} is not null").orderBy("h", text).limit(bound + bound // 8).toArrow()
    _, x = numbers(t.column(0).combine_chunks(), dims)
    return shuffled(x)[:bound] if len(x) else np.zeros((0, dims))


def drawn_vectors(vectors: DataFrame, bound: int) -> np.ndarray:
    """As `drawn_texts`, of a packed frame."""
    t = vectors.select("vec", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec").limit(bound).toArrow()
    return shuffled(unpacked(t.column(0).combine_chunks())) if t.num_rows else np.zeros((0, 1))


def collection(vectors: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(distinct vectors `rep, n, ids, vec`, members `vec_id, rep, ids` of groups of more than `keep` copies).

    `rep` is a group's smallest id, `n` its size, `ids` its `keep` smallest ids, or null where it is
    alone; so the members of small groups are in `ids`. Of an id with several vectors, that of the
    smallest fingerprint stands. A group of any size is counted and cut to its smallest ids before it
    is shuffled, and never gathered.
    """
    m = vectors.select("vec_id", "fp").groupBy("vec_id").agg(F.min("fp").alias("fp"))
    g = m.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    vecs = vectors.groupBy("fp").agg(F.min("vec").alias("vec"))
    first = m.withColumn("k", F.row_number().over(Window.partitionBy("fp").orderBy("vec_id"))).where(F.col("k") <= keep)
    ids = first.groupBy("fp").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = g.join(ids, "fp")
    distinct = groups.join(vecs, "fp").select(F.get("ids", F.lit(0)).alias("rep"), "n", F.when(F.col("n") > 1, F.col("ids")).alias("ids"), "vec")
    members = m.join(groups.where(F.col("n") > keep), "fp").select("vec_id", F.get("ids", F.lit(0)).alias("rep"), "ids")
    return distinct, members
