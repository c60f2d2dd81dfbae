"""Similarity clusters by reciprocal-nearest-neighbour average linkage.

The sparse graph has an edge between two vectors at most `most` apart that share a stretch in one of
the trees of a hash-prefix forest (see hash_forest). No merge crosses its components, as an average
is never below the least distance, so components are clustered apart: in a component, every round
merges all pairs of clusters that are each other's nearest, in parallel, by the average distance over
all pairs of members, until the nearest are farther apart than `most`. Mutual best pairs of a component
are those of the whole collection.

Within a stretch an edge is never a row: each task contracts its stretches to components and passes one
label per vector on. Labels of different trees meet as a graph of components, which is small.

A component of more than `bound` different vectors does not fit one matrix. Its clusters are first merged
in rounds, by stretches of further trees, under the root mean square distance, which sizes, means and
squared norms give exactly and which is never below the average. Where no tree finds a merge any more,
all its clusters are compared in blocks, and mutual best pairs merge until none is left. Nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.hash_forest import buffered, cuts, fitted_trees, hash_strings, stretches
from strandweave.llm.similar import part_of, partitions
from strandweave.llm.vectors import collection, drawn_vectors, packed, packed_frame, unpacked
from strandweave.runtime import dropped, written

ROW = "part int, hash long, rep long, n long, ids array<long>, vec binary, labels array<long>"
NAMES = [c.split()[0] for c in ROW.split(", ")]
RESULT = "rep long, n long, ids array<long>, distance double, first_vec_id long, size long, spread double, typical array<long>"
EPS = 1e-9


def contracted(x: np.ndarray, most: float) -> np.ndarray:
    """For each row the number of the first row of its component under `distance <= most`."""
    small = (x - x.mean(0)).astype(np.float64)
    sq = (small * small).sum(1)
    limit = most * most + EPS
    n = len(x)
    label = np.arange(n)
    while True:
        low = label.copy()
        for i in range(0, n, 512):
            near = sq[i : i + 512, None] + sq[None] - 2 * (small[i : i + 512] @ small.T) <= limit
            low[i : i + 512] = np.where(near, label[None], n).min(1)
        np.minimum(low, label, out=low)
        root = label.copy()
        np.minimum.at(root, label, low)
        while (root[root] != root).any():
            root = root[root]
        new = root[label]
        if (new == label).all():
            return label
        label = new


def linked(d: np.ndarray, n: np.ndarray, limit: float) -> np.ndarray:
    """Average linkage of a whole distance matrix, weighted by `n`: for each row the number of its cluster's first row.

    Every round merges all mutual best pairs within the limit; the order does not change the result, as merging never brings clusters nearer to others.
    """
    d, n = d.copy(), n.astype(float)
    np.fill_diagonal(d, np.inf)
    owner, first = np.arange(len(n)), np.arange(len(n))
    while len(n) > 1:
        best = d.argmin(1)
        i = np.flatnonzero((best[best] == np.arange(len(n))) & (np.arange(len(n)) < best))
        i = i[d[i, best[i]] <= limit]
        if not len(i):
            break
        j = best[i]
        wa, wb = (n[i] / (n[i] + n[j]))[:, None], (n[j] / (n[i] + n[j]))[:, None]
        d[i] = wa * d[i] + wb * d[j]
        d[:, i] = wa[:, 0] * d[:, i] + wb[:, 0] * d[:, j]
        n[i] += n[j]
        to = np.arange(len(n))
        to[j] = i
        keep = np.ones(len(n), bool)
        keep[j] = False
        place = np.cumsum(keep) - 1
        first[i] = np.minimum(first[i], first[j])
        owner = place[to[owner]]
        d, n, first = d[np.ix_(keep, keep)], n[keep], first[keep]
        np.fill_diagonal(d, np.inf)
    return first[owner]


def distances(x: np.ndarray) -> np.ndarray:
    x = x - x.mean(0)
    sq = (x * x).sum(1)
    return np.sqrt(np.maximum(0, sq[:, None] + sq[None] - 2 * x @ x.T))


def root_mean_squares(mean: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """Root mean square distance between all members of clusters, from means and mean squared norms."""
    return np.sqrt(np.maximum(0, norm[:, None] + norm[None] - 2 * mean @ mean.T))


def described(rep: np.ndarray, n: np.ndarray, ids: list, x: np.ndarray, owner: np.ndarray, typical: int) -> list[tuple]:
    """A row of RESULT for each vector; the cluster's figures stand in all of its rows, `typical` in its first only."""
    out: list[tuple] = []
    o = np.argsort(owner, kind="stable")
    for at in np.split(o, np.flatnonzero(np.diff(owner[o])) + 1):
        w = n[at].astype(float)
        size = int(n[at].sum())
        mean = (x[at] * w[:, None]).sum(0) / size
        dist = np.sqrt(((x[at] - mean) ** 2).sum(1))
        spread = float(np.sqrt(max(0.0, 2 * (w * dist * dist).sum() / size) * (size / (size - 1) if size > 1 else 1)))
        near = at[np.lexsort((rep[at], np.round(dist, 9)))[:typical]] if len(at) > typical else at
        all_ = sorted((round(float(np.sqrt(((x[p] - mean) ** 2).sum())), 9), v) for p in near for v in (ids[p] or [rep[p]])[:typical])
        first = int(rep[at].min())
        top = [int(v) for _, v in all_[:typical]]
        out += [(int(rep[p]), int(n[p]), ids[p], float(q), first, size, round(spread, 6), top if rep[p] == first else None) for p, q in zip(at, dist)]
    return out


def rows_of(b: pa.RecordBatch) -> tuple:
    """(hash, rep, n, ids, vectors, labels) of a batch of ROW."""
    ids = np.full(b.num_rows, None, object)
    n = b.column(3).to_numpy()
    for i in np.flatnonzero(n > 1):
        ids[i] = b.column(4)[i].as_py()
    labels = b.column(6)
    flat = labels.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if labels.null_count == 0 else np.zeros((b.num_rows, 0), np.int64)
    return b.column(1).to_numpy(), b.column(2).to_numpy(), n, ids, unpacked(b.column(5)), flat


def labelled(distinct: DataFrame, forest: list, edges: list[np.ndarray], parts: int, most: float, leaf: int, buffer: int) -> DataFrame:
    """`rep, n, ids, vec, labels`: per tree, the smallest rep of the component that a vector belongs to in its stretch."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                h = hash_strings(unpacked(b.column(3)), forest[0])
                none = pa.ListArray.from_arrays(pa.array(np.zeros(b.num_rows + 1, np.int32)), pa.array([], pa.int64()))
                yield pa.RecordBatch.from_arrays([part_of(h, edges[0]), pa.array(h), *b.columns, none], names=NAMES)

    def step(t: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for h, rep, n, ids, x, labels in buffered((b for b in batches if b.num_rows), rows_of, buffer):
                own = rep.copy()
                for a, b, lo, hi in stretches(h, leaf, 1):
                    for s in range(a, b, 2 * leaf):  # equal strings beyond a leaf go in portions
                        e = min(s + 2 * leaf, b)
                        k = contracted(x[s:e], most)
                        least = np.full(e - s, np.iinfo(np.int64).max)
                        np.minimum.at(least, k, rep[s:e])
                        own[s:e] = least[k]
                labels = np.hstack([labels, own[:, None]])
                wide = labels.shape[1]
                told = pa.ListArray.from_arrays(pa.array(np.arange(len(rep) + 1, dtype=np.int32) * wide), pa.array(labels.ravel()))
                rest = [pa.array(rep), pa.array(n), pa.array(ids.tolist(), pa.list_(pa.int64())), packed(x), told]
                if t + 1 < len(forest):
                    h = hash_strings(x, forest[t + 1])
                    yield pa.RecordBatch.from_arrays([part_of(h, edges[t + 1]), pa.array(h), *rest], names=NAMES)
                else:
                    yield pa.RecordBatch.from_arrays(rest, names=NAMES[2:])
        return run

    state = distinct.mapInArrow(first, ROW)
    for t in range(len(forest)):
        state = state.repartitionById(parts, "part").sortWithinPartitions("hash").mapInArrow(step(t), ROW if t + 1 < len(forest) else ROW.split(", ", 2)[2])
    return state


def joined_labels(rows: DataFrame) -> DataFrame:
    """`label, component` of the first tree's labels that others join to a smaller one: connected components of the labels, in rounds.

    Each round passes the smallest label seen to all neighbours and then along itself; what is in no pair of different labels never takes part.
    """
    pairs = rows.select(F.element_at("labels", 1).alias("a"), F.explode(F.slice("labels", 2, 1000)).alias("b")).where("a != b").distinct()
    links = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = written(links.groupBy("a").agg(F.least("a", F.min("b")).alias("c")))
    while True:
        near = links.join(now.select(F.col("a").alias("b"), "c"), "b").select("a", "c").unionByName(now).groupBy("a").agg(F.min("c").alias("c"))
        far = now.select(F.col("a").alias("c"), F.col("c").alias("d"))
        new = written(near.join(far, "c", "left").select("a", F.least("c", F.coalesce("d", "c")).alias("c")))
        moved = new.join(now.withColumnRenamed("c", "was"), "a").where("c != was").limit(1).count()
        dropped(now)
        now = new
        if not moved:
            dropped(links)
            out = now.select(F.col("a").alias("label"), F.col("c").alias("component"))
            out._strandweave_path = now._strandweave_path
            return out


def similarity_clusters(
    vectors: DataFrame, most: float = 0.80, trees: int = 3, leaf: int = 2048, bound: int = 2048, sample: int = 2000, seed: int = 11, typical: int = 3, buffer: int = 32768, rounds: int = 40, quiet: int = 2,
    size: int | None = None, drawn: np.ndarray | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(members `vec_id, first_vec_id, distance, size`, clusters `first_vec_id, size, spread, typical`).

    `first_vec_id` is the cluster's smallest vec_id, `distance` that to its mean, `spread` the root
    of the mean squared distance between members, `typical` the ids nearest to the mean (ties: the
    smallest). Vectors as for `nearest_vectors`; exact copies count as often as they occur, and always
    share a cluster. Groups whose members are all within `most` and farther than that from all others
    come out exactly. An empty collection gives no rows.
    """
    v = packed_frame(vectors)
    parts = partitions(v, v.count() if size is None else size, 4 * leaf)
    drawn = drawn_vectors(v, max(sample, 40 * parts)) if drawn is None else drawn
    forest = fitted_trees(drawn[:sample], trees, seed)
    keep = max(typical, 16)
    distinct, members = collection(v, keep)
    rows = written(labelled(distinct, forest, [cuts(drawn, t, parts) for t in forest], parts, most, leaf, buffer))
    joins = joined_labels(rows)
    few = joins.count() <= 500_000  # 16 bytes each
    label = F.element_at("labels", 1)
    rows_ = rows.withColumn("label", label).join(F.broadcast(joins) if few else joins, "label", "left").select("rep", "n", "ids", "vec", F.coalesce("component", "label").alias("component"))
    sizes = rows.select(label.alias("label")).join(F.broadcast(joins) if few else joins, "label", "left").groupBy(F.coalesce("component", "label").alias("component")).agg(F.count(F.lit(1)).alias("c"))
    large = written(sizes.where(F.col("c") > bound).select("component"))
    if large.limit(1).count():
        rest, done = rows_.join(large, "component", "left_anti"), _large(rows_.join(large, "component"), drawn, most, leaf, bound, buffer, rounds, quiet, seed, typical)
    else:
        rest, done = rows_, None

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for component, rep, n, ids, x in whole(batches):
            out: list[tuple] = []
            starts = np.r_[0, np.flatnonzero(np.diff(component)) + 1, len(component)]
            for a, b in zip(starts[:-1], starts[1:]):
                owner = linked(distances(x[a:b]), n[a:b], most + EPS) if b - a > 1 else np.zeros(1, np.int64)
                out += described(rep[a:b], n[a:b], ids[a:b].tolist(), x[a:b], owner, typical)
            yield result_batch(out)

    near = rest.select("rep", "n", "ids", "vec", "component").repartition("component").sortWithinPartitions("component").mapInArrow(cluster, RESULT)
    told = written(near if done is None else near.unionByName(done))
    dropped(rows, large, joins)
    few_copies = F.when(F.col("n") <= keep, F.coalesce("ids", F.array("rep")))
    small = told.select(F.explode(few_copies).alias("vec_id"), "first_vec_id", "distance", "size")
    many = told.where(F.col("n") > keep).select("rep", "first_vec_id", "distance", "size").join(members.select("vec_id", "rep"), "rep").drop("rep")
    return small.unionByName(many), told.where("typical is not null").select("first_vec_id", "size", "spread", "typical")


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(component, rep, n, ids, vectors) of whole components, sorted by component, as few at a time as batches allow."""
    held: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        n = b.column(1).to_numpy()
        ids = np.full(b.num_rows, None, object)
        for i in np.flatnonzero(n > 1):
            ids[i] = b.column(2)[i].as_py()
        new = (b.column(4).to_numpy(), b.column(0).to_numpy(), n, ids, unpacked(b.column(3)))
        held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
        cut = int(np.searchsorted(held[0], held[0][-1]))
        if cut:
            yield tuple(p[:cut] for p in held)
            held = tuple(p[cut:] for p in held)
    if held is not None:
        yield held


def result_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in RESULT.split(", ")])


def _large(rows: DataFrame, drawn: np.ndarray, most: float, leaf: int, bound: int, buffer: int, rounds: int, quiet: int, seed: int, typical: int) -> DataFrame:
    """RESULT rows of components beyond `bound`, by distributed rounds (see the module's text)."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = fitted_trees(drawn[:2000], rounds, seed + 1)
    kind = "component long, key long, n long, norm double, mean array<double>, into long"
    names = [c.split()[0] for c in kind.split(", ")]
    rows = written(rows)

    def lists(m: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unpacked(b.column(3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array((x * x).sum(1)), lists(x), pa.nulls(len(x), pa.int64())], names=names)

    def columns(b: pa.RecordBatch) -> tuple:
        return b.column(7).to_numpy(), *(b.column(i).to_numpy() for i in range(4)), b.column(4).flatten().to_numpy().reshape(b.num_rows, -1)

    def hashed(tree: tuple, at: np.ndarray):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    h = hash_strings(b.column(4).flatten().to_numpy().reshape(b.num_rows, -1), tree)
                    yield pa.RecordBatch.from_arrays([*b.columns, part_of(h, at), pa.array(h)], names=[*names, "part", "hash"])
        return run

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, comp, key, n, norm, mean in buffered((b for b in batches if b.num_rows), columns, buffer):
            for a, b, _, _ in stretches(h, leaf, 1):
                for s in range(a, b, 2 * leaf):
                    z = slice(s, min(s + 2 * leaf, b))
                    d = root_mean_squares(mean[z], norm[z])
                    d[comp[z][:, None] != comp[z][None]] = np.inf
                    yield combined(comp[z], key[z], n[z], norm[z], mean[z], linked(d * d, n[z], (most + EPS) ** 2))  # averages of squares are exact

    def combined(comp: np.ndarray, key: np.ndarray, n: np.ndarray, norm: np.ndarray, mean: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
        k, at = np.unique(owner, return_inverse=True)
        size = np.bincount(at, n)
        new = np.full(len(k), np.iinfo(np.int64).max)
        np.minimum.at(new, at, key)
        nm = np.bincount(at, n * norm) / size
        mm = np.stack([np.bincount(at, n * c) for c in mean.T], 1) / size[:, None]
        went = np.flatnonzero(new[at] != key)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[comp[k], comp[went]]), pa.array(np.r_[new, key[went]]), pa.concat_arrays([pa.array(size.astype(np.int64)), pa.nulls(len(went), pa.int64())]), pa.array(np.r_[nm, np.zeros(len(went))]),
             lists(np.vstack([mm, np.zeros((len(went), mm.shape[1]))])), pa.concat_arrays([pa.nulls(len(k), pa.int64()), pa.array(new[at][went])])], names=names)

    state = written(rows.select("component", "rep", "n", "vec").mapInArrow(begin, kind))
    owner = written(rows.select(F.col("rep"), F.col("rep").alias("key")))
    calm = t = 0
    while calm < quiet and t < rounds:
        step = written(state.where("n is not null").mapInArrow(hashed(forest[t], cuts(drawn, forest[t], parts)), kind + ", part int, hash long").repartitionById(parts, "part").sortWithinPartitions("hash").mapInArrow(merge, kind))
        went = step.where("into is not null").count()
        calm = 0 if went else calm + 1
        owner, state = _followed(owner, step), step
        t += 1
    while True:  # all clusters of a component against each other, in blocks
        best = written(_best_pairs(state.where("n is not null"), most))
        pairs = best.join(best.select(F.col("key").alias("other"), F.col("other").alias("back")), "other").where("back = key and key < other").select("key", "other")
        pairs = written(pairs)
        if not pairs.limit(1).count():
            break
        s = state.where("n is not null").drop("into")
        a = s.join(pairs, "key")
        b = s.select(F.col("key").alias("other"), F.col("n").alias("n2"), F.col("norm").alias("norm2"), F.col("mean").alias("mean2"))
        both = F.col("n") + F.col("n2")
        mean = F.zip_with("mean", "mean2", lambda x, y: (x * F.col("n") + y * F.col("n2")) / both)
        merged = a.join(b, "other").select("component", "key", both.alias("n"), ((F.col("norm") * F.col("n") + F.col("norm2") * F.col("n2")) / both).alias("norm"), mean.alias("mean"), F.lit(None).cast("long").alias("into"))
        gone = pairs.select(F.lit(0).cast("long").alias("component"), F.col("other").alias("key"), F.lit(None).cast("long").alias("n"), F.lit(0.0).alias("norm"), F.array().cast("array<double>").alias("mean"), F.col("key").alias("into"))
        same = s.join(pairs.select("key").unionByName(pairs.select(F.col("other").alias("key"))), "key", "left_anti").withColumn("into", F.lit(None).cast("long"))
        step = written(same.select(*names).unionByName(merged).unionByName(gone))
        owner, state = _followed(owner, step), step
    # figures of clusters of any size by aggregates
    x = rows.join(owner, "rep").join(state.where("n is not null").select("key", F.col("n").alias("size"), "norm", "mean"), "key")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mean = b.column(6).flatten().to_numpy().reshape(b.num_rows, -1)
                dist = np.sqrt(((unpacked(b.column(3)) - mean) ** 2).sum(1))
                size, inner = b.column(4).to_numpy().astype(float), (mean * mean).sum(1)
                spread = np.sqrt(np.maximum(0, 2 * (b.column(5).to_numpy() - inner)) * np.where(size > 1, size / np.maximum(size - 1, 1), 1))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(dist), b.column(7), b.column(4), pa.array(np.round(spread, 6))], names=["rep", "n", "ids", "distance", "key", "size", "spread"])

    y = x.select("rep", "n", "ids", "vec", "size", "norm", "mean", "key").mapInArrow(told, "rep long, n long, ids array<long>, distance double, key long, size long, spread double")
    near = y.select("key", "distance", F.explode(F.coalesce("ids", F.array("rep"))).alias("id")).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy(F.round("distance", 9), "id"))).where(F.col("k") <= typical)
    top = near.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda s: s["id"]).alias("typical"))
    return y.join(top, "key").select("rep", "n", "ids", "distance", F.col("key").alias("first_vec_id"), "size", "spread", F.when(F.col("rep") == F.col("key"), F.col("typical")).alias("typical"))


def _followed(owner: DataFrame, step: DataFrame) -> DataFrame:
    """The clusters of vectors after a round's merges."""
    went = step.where("into is not null").select("key", "into")
    new = written(owner.join(went, "key", "left").select("rep", F.coalesce("into", "key").alias("key")))
    dropped(owner)
    return new


def _best_pairs(state: DataFrame, most: float, chunk: int = 1024) -> DataFrame:
    """`key, other`: the nearest cluster of the component within `most`, by blocks of clusters; ties go to the smaller key."""
    s = state.select("component", "key", "n", "norm", "mean")
    of = s.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / float(chunk)).alias("parts"))
    s = s.join(of, "component").withColumn("p", F.pmod(F.xxhash64("key"), F.col("parts")))
    left = s.groupBy("component", "p").agg(F.collect_list(F.struct("key", "norm", "mean")).alias("l"))
    right = left.select("component", F.col("p").alias("q"), F.col("l").alias("m"))
    parts = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = left.join(right, "component").repartition(parts, "component", "p", "q").select("l", "m")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for one, two in zip(f["l"], f["m"]):
                key, other = (np.array([r["key"] for r in z]) for z in (one, two))
                norm, norm2 = (np.array([r["norm"] for r in z]) for z in (one, two))
                mean, mean2 = (np.array([r["mean"] for r in z]) for z in (one, two))
                o = np.argsort(other)
                other, norm2, mean2 = other[o], norm2[o], mean2[o]
                d = np.maximum(0, norm[:, None] + norm2[None] - 2 * mean @ mean2.T)
                d[key[:, None] == other[None]] = np.inf
                b = d.argmin(1)
                d = d[np.arange(len(key)), b]
                use = d <= (most + EPS) ** 2
                yield pd.DataFrame({"key": key[use], "other": other[b][use], "d": d[use]})

    return blocks.mapInPandas(run, "key long, other long, d double").groupBy("key").agg(F.min(F.struct("d", "other"))["other"].alias("other"))
