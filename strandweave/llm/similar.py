"""The k most similar vectors of every vector, by a hash-prefix forest.

The trees form a chain: a row carries its packed vector and the nearest found so far from tree to
tree, so a vector moves once for each tree and no lists are merged afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.hash_forest import buffered, cuts, fitted_trees, hash_strings, stretches
from strandweave.llm.vectors import collection, drawn_vectors, packed, packed_frame, unpacked

ROW = "part int, hash long, rep long, n long, ids array<long>, vec binary, near binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]


def forest_size(n: int) -> tuple[int, int]:
    """(trees, least stretch) for n vectors: recall falls slowly with n, and both rise to hold it."""
    return max(3, int(math.log10(max(n, 1))) - 2), round(1536 * max(1.0, n / 20_000) ** 0.3)


def partitions(df: DataFrame, size: int, least: int) -> int:
    """The session's number of partitions, or fewer, lest any hold less than `least` rows."""
    return max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // least))


def part_of(h: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.array(np.searchsorted(at, h, side="right").astype(np.int32))


def encoded(ids: np.ndarray, dist: np.ndarray) -> pa.Array:
    """Lists of ids and distances as bytes; those of ids stand byte by byte, as most are zero."""
    a = np.ascontiguousarray(ids).view(np.uint8).reshape(*ids.shape, 8).transpose(0, 2, 1).reshape(len(ids), -1)
    b = np.ascontiguousarray(dist).view(np.uint8).reshape(len(dist), -1)
    return pa.array(list(map(bytes, np.hstack([a, b]))), pa.binary())


def decoded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The lists again: (ids, distances), unfilled places with infinite distance."""
    n = len(column)
    if column.null_count == n:
        return np.full((n, width), -1, np.int64), np.full((n, width), np.inf)
    start = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[start : start + n * width * 16].reshape(n, width * 16)
    ids = np.ascontiguousarray(raw[:, : width * 8].reshape(n, 8, width).transpose(0, 2, 1)).view(np.int64).reshape(n, width)
    return ids, np.ascontiguousarray(raw[:, width * 8 :]).view(np.float64).reshape(n, width)


def improve(x: np.ndarray, rep: np.ndarray, more: np.ndarray, near: tuple[np.ndarray, np.ndarray], parts: list[tuple[int, int, int, int]], rows: int = 512, most: int = 200_000) -> None:
    """Put into the lists `near` (ids, distances, ascending by distance and id) whatever lies nearer in the stretches `parts`.

    `more` holds all ids of a row that stands for copies, else None. A row itself, at distance 0, is one of its nearest.
    """
    ids, dist = near
    width = ids.shape[1]
    for a, b, lo, hi in parts:
        c = x[lo:hi]
        small = (c - c.mean(0)).astype(np.float32)
        sq = (small * small).sum(1)
        right = np.hstack([small, sq[:, None]])
        slack = np.float32(4e-6) * (1 + sq.max())
        for i in range(a, b, rows):
            j = min(i + rows, b)
            own = sq[i - lo : j - lo]
            left = np.hstack([small[i - lo : j - lo] * np.float32(-2), np.ones((j - i, 1), np.float32)])
            d = left @ right.T  # squared distances less the query's own square
            step = 8 if hi - lo >= 16 * width else 1
            bound = dist[i:j, -1] ** 2 - own
            fresh = (hi - lo) // step >= width and not np.isfinite(bound).all()
            if fresh:
                bound = np.minimum(bound, np.partition(d[:, ::step], width - 1, axis=1)[:, width - 1])
            r, k = np.nonzero(d <= (bound + slack).astype(np.float32)[:, None])
            if fresh and len(r) > 2 * width * (j - i):  # only those that may be among the nearest are computed exactly
                v = d[r, k]
                o = np.lexsort((v, r))
                r, k, v = r[o], k[o], v[o]
                last = np.minimum(np.searchsorted(r, np.arange(j - i)) + width - 1, len(r) - 1)
                keep = v <= (v[last] + slack)[r]
                r, k = r[keep], k[keep]
            exact = np.empty(len(r))
            for s in range(0, len(r), most):
                exact[s : s + most] = np.sqrt(((c[k[s : s + most]] - x[i + r[s : s + most]]) ** 2).sum(1))
            at = lo + k
            new = rep[at]
            copied = np.flatnonzero(more[at] != None)  # noqa: E711
            if len(copied):
                times = np.ones(len(at), np.int64)
                times[copied] = [len(more[p]) for p in at[copied]]
                first = np.cumsum(times) - times
                new, r, exact = np.repeat(new, times), np.repeat(r, times), np.repeat(exact, times)
                for p in copied:
                    new[first[p] : first[p] + times[p]] = more[at[p]]
            had = np.isfinite(dist[i:j])
            r = np.concatenate([np.nonzero(had)[0], r])
            new, exact = np.concatenate([ids[i:j][had], new]), np.concatenate([dist[i:j][had], exact])
            o = np.lexsort((new, exact, r))
            r, new, exact = r[o], new[o], exact[o]
            # the same id comes again with the same distance, so next to itself
            keep = np.r_[True, (r[1:] != r[:-1]) | (new[1:] != new[:-1])]
            r, new, exact = r[keep], new[keep], exact[keep]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            use = place < width
            ids[i + r[use], place[use]], dist[i + r[use], place[use]] = new[use], exact[use]


def nearest_vectors(
    vectors: DataFrame, k: int = 10, trees: int | None = None, leaf: int | None = None, least: int | None = None, sample: int = 2000, seed: int = 7, buffer: int = 32768,
    size: int | None = None, drawn: np.ndarray | None = None,
) -> DataFrame:
    """`vec_id, rank, other_id, distance`: for each vector the k nearest others by Euclidean distance.

    `vectors` has `vec_id` (unique) and `vec array<double>` of one length, without nulls, or is packed
    (see `vectors`). The forest is fitted on at most `sample` vectors (40 for each partition, if that
    is more) and indexes all. Trees and stretches grow with the number of vectors, see `forest_size`.
    Equal distances rank by id; exact copies are found exactly, through one representative of each
    group. A collection of n <= k vectors gives n - 1 neighbours each; an empty one gives no rows.

    `size` and `drawn` may give the number of vectors, about, and the sample, where they are known.
    """
    v = packed_frame(vectors)
    size = v.count() if size is None else size
    many, wide = forest_size(size)
    trees, least = trees or many, least or wide
    parts = partitions(v, size, 4 * least)
    leaf, width = leaf or 2 * least + 1024, k + 1
    drawn = drawn_vectors(v, max(sample, 40 * parts)) if drawn is None else drawn
    forest = fitted_trees(drawn[:sample], trees, seed)
    edges = [cuts(drawn, t, parts) for t in forest]
    distinct, members = collection(v, width)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = hash_strings(unpacked(b.column(3)), forest[0])
                yield pa.RecordBatch.from_arrays([part_of(h, edges[0]), pa.array(h), *b.columns, pa.nulls(b.num_rows, pa.binary())], names=NAMES)

    def columns(b: pa.RecordBatch) -> tuple:
        ids, dist = decoded(b.column(6), width)
        more = np.full(b.num_rows, None, object)
        for i in np.flatnonzero(b.column(3).to_numpy() > 1):
            more[i] = b.column(4)[i].as_py()
        return b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(), more, unpacked(b.column(5)), ids, dist

    def search(at: int):  # noqa: ANN202
        last = at == trees - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, rep, n, more, x, ids, dist in buffered((b for b in batches if b.num_rows), columns, buffer):
                ids, dist = ids.copy(), dist.copy()
                improve(x, rep, more, (ids, dist), stretches(h, leaf, least))
                if last:  # a row for each copy; groups that fill their lists themselves are told apart
                    times = np.where(n > width, 0, n)
                    owner = np.array([v for r, m, t in zip(rep.tolist(), more, times.tolist()) if t for v in (m or [r])], np.int64)
                    ids, dist = np.repeat(ids, times, axis=0), np.repeat(dist, times, axis=0)
                    found = np.isfinite(dist) & (ids != owner[:, None])
                    found &= np.cumsum(found, axis=1) <= k
                    ends = pa.array(np.r_[0, np.cumsum(found.sum(1))].astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owner), pa.ListArray.from_arrays(ends, pa.array(ids[found])), pa.ListArray.from_arrays(ends, pa.array(dist[found]))], names=["vec_id", "ids", "dist"])
                else:
                    h = hash_strings(x, forest[at + 1])
                    copies = pa.array(more.tolist(), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part_of(h, edges[at + 1]), pa.array(h), pa.array(rep), pa.array(n), copies, packed(x), encoded(ids, dist)], names=NAMES)
        return run

    state = distinct.mapInArrow(first, ROW)
    for t in range(trees):
        state = state.repartitionById(parts, "part").sortWithinPartitions("hash").mapInArrow(search(t), ROW if t < trees - 1 else "vec_id long, ids array<long>, dist array<double>")

    # the k nearest of a member of more than k copies are the smallest other ids of its group
    own = F.slice(F.filter("ids", lambda x: x != F.col("vec_id")), 1, k)
    copied = members.select("vec_id", own.alias("ids")).withColumn("dist", F.transform("ids", lambda _: F.lit(0.0)))
    return state.unionByName(copied).select("vec_id", F.posexplode(F.arrays_zip("ids", "dist")).alias("r", "x")).select(
        "vec_id", (F.col("r") + 1).alias("rank"), F.col("x.ids").alias("other_id"), F.col("x.dist").alias("distance"))


def near_pairs(neighbours: DataFrame, most: float = 0.10) -> DataFrame:
    """`vec_id_a, vec_id_b`, smaller first: one is among the other's nearest, at most that far."""
    return neighbours.where(F.col("distance") <= most + 1e-9).select(
        F.least("vec_id", "other_id").alias("vec_id_a"), F.greatest("vec_id", "other_id").alias("vec_id_b")).distinct()


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 10, portion: int = 20_000) -> DataFrame:
    """As `nearest_vectors`, by brute force, for the vectors of `queries` alone (a stated part of all, packed too).

    Queries are broadcast in portions of about `portion` vectors, a bound whatever their number; each
    portion meets all vectors in blocks, every partition sends its k nearest, and lists merge by aggregation.
    """
    v, q = packed_frame(vectors), packed_frame(queries).groupBy("vec_id").agg(F.min(F.struct("fp", "vec"))["vec"].alias("vec"))
    n = -(-q.count() // portion)
    out = None
    for i in range(n):
        rows = q.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).select("vec_id", "vec").toArrow().combine_chunks()
        if rows.num_rows:
            part = _against_all(v, rows.column(0).to_numpy(), unpacked(rows.column(1).combine_chunks()), k)
            out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, rank int, other_id long, distance double")
    best = out.groupBy("vec_id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("dist").alias("d"), F.col("ids").alias("id")))))), 1, k).alias("near"))
    return best.select("vec_id", F.posexplode("near").alias("r", "x")).select("vec_id", (F.col("r") + 1).alias("rank"), F.col("x.id").alias("other_id"), F.col("x.d").alias("distance"))


def _against_all(vectors: DataFrame, ids: np.ndarray, x: np.ndarray, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        near, dist = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            other, y = b.column(0).to_numpy(), unpacked(b.column(2))
            sq = (y * y).sum(1)
            for i in range(0, len(ids), 512):
                z = slice(i, i + 512)
                d = sq[None] - 2 * x[z] @ y.T
                d[ids[z][:, None] == other[None]] = np.inf
                bound = dist[z, -1] ** 2 - (x[z] ** 2).sum(1)
                if len(other) > k:
                    bound = np.minimum(bound, np.partition(d, k - 1, axis=1)[:, k - 1])
                r, c = np.nonzero(d <= (bound + 1e-9)[:, None])
                r, c = r[np.isfinite(d[r, c])], c[np.isfinite(d[r, c])]
                exact = np.sqrt(((y[c] - x[i + r]) ** 2).sum(1))
                had = np.isfinite(dist[z])
                r, new, exact = np.r_[np.nonzero(had)[0], r], np.r_[near[z][had], other[c]], np.r_[dist[z][had], exact]
                o = np.lexsort((new, exact, r))
                r, new, exact = r[o], new[o], exact[o]
                keep = np.r_[True, (r[1:] != r[:-1]) | (new[1:] != new[:-1])] if len(r) else np.zeros(0, bool)
                r, new, exact = r[keep], new[keep], exact[keep]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                use = place < k
                near[i + r[use], place[use]], dist[i + r[use], place[use]] = new[use], exact[use]
        found = np.isfinite(dist)
        ends = pa.array(np.r_[0, np.cumsum(found.sum(1))].astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(near[found])), pa.ListArray.from_arrays(ends, pa.array(dist[found]))], names=["vec_id", "ids", "dist"])

    return vectors.mapInArrow(run, "vec_id long, ids array<long>, dist array<double>")


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """`n_queries, n_true, n_found, recall`: how many of the true neighbours a search found; one at the distance of the farthest true one stands for it."""
    far = truth.groupBy("vec_id").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
    hit = found.join(far, "vec_id").groupBy("vec_id").agg(F.count_if(F.col("distance") <= F.col("far") + 1e-9).alias("h"))
    x = far.join(hit, "vec_id", "left").select("n", F.least("n", F.coalesce("h", F.lit(0))).alias("h"))
    return x.agg(F.count(F.lit(1)).alias("n_queries"), F.sum("n").alias("n_true"), F.sum("h").alias("n_found"), F.round(F.try_divide(F.sum("h"), F.sum("n")), 4).alias("recall"))
