"""Clustering quality: silhouette, Davies-Bouldin, Calinski-Harabasz, PBM, observation-level agreement.

Rows are vectors with a group (a partition of a subject, say) and a cluster. Distances between all
rows of a group are needed by the silhouette alone. A piece of work has some of a group's rows and,
packed, the vectors of all of them (some 40 bytes a row); only one sum per piece and measure leaves
it. The work grows with the square of a group, so it ends long before a group's vectors fill a task.
Centroids are rank correlations of pooled observations. A subject's observations are few megabytes:
they go to one task, once for all partitions, instead of once per partition to disk.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.functions.columns import distance, ratio
from strandweave.functions.numeric import foerstner_batch, log_frobenius_batch, matrix_logs
from strandweave.operators.segments import interval_join


def powered(x: np.ndarray, p: int) -> np.ndarray:
    """x ** p by squaring."""
    out = None
    while p:
        if p & 1:
            out = x if out is None else out * x
        p >>= 1
        x = x * x if p else x
    return out


#: Groups of at most so many rows are measured together with others of their size.
STACKED = 128
#: Pairs of rows that are measured at a time: their powers stay in a processor's cache.
BLOCK = 32_000
#: Measures that depend on the order of their two vectors: the row that comes first is the first.
ONE_WAY = ("foerstner",)
MATRIX_BATCHES = {"foerstner": foerstner_batch, "log_frobenius": log_frobenius_batch}


def block_distances(a: np.ndarray, b: np.ndarray, measure: str) -> np.ndarray:
    """Distances between all rows of two matrices, by any measure of `columns.DISTANCES` and the two matrix measures."""
    if measure == "cosine":
        norms = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)
        return np.divide(a @ b.T, norms, out=np.full((len(a), len(b)), np.nan), where=norms > 0)
    if measure == "log_frobenius":
        return np.linalg.norm(matrix_logs(a)[:, None] - matrix_logs(b)[None], axis=(2, 3))
    if measure == "foerstner":
        step = max(1, 50_000 // max(1, len(b)))
        parts = [foerstner_batch(np.repeat(a[i : i + step], len(b), axis=0), np.tile(b, (len(a[i : i + step]), 1))) for i in range(0, len(a), step)]
        return np.concatenate(parts).reshape(len(a), len(b)) if parts else np.empty((0, len(b)))
    name, _, kind = measure.partition("_")
    if kind == "ref":
        far = lambda x: lp_block(x, np.full((1, x.shape[1]), 1 / math.sqrt(x.shape[1])), name)[:, 0]
        return lp_block(a, b, name) * (far(a)[:, None] + far(b)[None])
    if kind == "dot":
        more = lambda x: np.hstack([x, (x.sum(1, keepdims=True) / math.sqrt(x.shape[1]) + 1) / 2])
        return lp_block(more(a), more(b), name)
    if kind:
        raise ValueError(f"unknown distance {measure}")
    return lp_block(a, b, name)


def lp_block(a: np.ndarray, b: np.ndarray, name: str) -> np.ndarray:
    """Lp distances between all rows of two matrices, for whole p and for infinity."""
    p = 0 if name == "linf" else int(name[1:])
    out = np.empty((len(a), len(b)))
    step = max(1, 200_000 // max(1, b.size))
    for i in range(0, len(a), step):
        if b.shape[1] <= 24:  # component by component: sums over a short last axis are slow
            out[i : i + step] = lp_of([np.abs(x[:, None] - y[None]) for x, y in zip(a[i : i + step].T, b.T)], p)
            continue
        d = np.abs(a[i : i + step, None] - b[None])
        if not p:
            out[i : i + step] = d.max(2)
        elif p <= 10:
            out[i : i + step] = powered(d, p).sum(2) ** (1 / p)
        else:  # the largest difference is factored out, lest the powers vanish
            most = d.max(2)
            out[i : i + step] = most * powered(d / np.where(most > 0, most, 1)[:, :, None], p).sum(2) ** (1 / p)
    return out


def lp_of(parts: list[np.ndarray], p: int) -> np.ndarray:
    """Lp norms from the absolute differences of each component; p = 0 is infinity."""
    if p == 1:
        return reduce(np.add, parts)
    if 1 < p <= 10:
        return reduce(np.add, (powered(x, p) for x in parts)) ** (1 / p)
    most = reduce(np.maximum, parts)
    if not p:
        return most
    by = np.where(most > 0, most, 1)
    return most * reduce(np.add, (powered(x / by, p) for x in parts)) ** (1 / p)


def about(x: np.ndarray, measures: tuple[str, ...]) -> dict[str, np.ndarray]:
    """What measures need of single vectors (last axis): distances from the reference vector, norms, projections."""
    root = math.sqrt(x.shape[-1])
    out = {m: lp_of([np.abs(x[..., i] - 1 / root) for i in range(x.shape[-1])], _order(m)) for m in measures if m.endswith("_ref")}
    return out | {"cosine": np.linalg.norm(x, axis=-1), "dot": (x.sum(-1) / root + 1) / 2}


def _order(measure: str) -> int:
    name = measure.partition("_")[0]
    return 0 if name == "linf" else int(name[1:])


def broadcast_distances(a: np.ndarray, b: np.ndarray, measures: tuple[str, ...], about_a: dict[str, np.ndarray] | None = None, about_b: dict[str, np.ndarray] | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """(measure, distances) of the vectors along the last axis of two arrays that are broadcast, as `block_distances`; powers and norms are taken once for all measures that need them."""
    dim = a.shape[-1]
    about_a, about_b = about_a or about(a, measures), about_b or about(b, measures)

    @cache
    def power(p: int, scaled: bool = False) -> list[np.ndarray]:
        if p > 1:
            return [x * x for x in power(p // 2, scaled)] if p % 2 == 0 else [x * y for x, y in zip(power(p - 1, scaled), power(1, scaled))]
        if scaled:
            by = np.where(largest() > 0, largest(), 1)
            return [x / by for x in power(1)]
        return [np.abs(a[..., i] - b[..., i]) for i in range(dim)]

    @cache
    def largest() -> np.ndarray:
        return reduce(np.maximum, power(1))

    @cache
    def total(p: int) -> np.ndarray:
        return reduce(np.add, power(p))

    @cache
    def lp(p: int) -> np.ndarray:
        if p <= 10:
            return rooted(total(p), p) if p else largest()
        return largest() * rooted(reduce(np.add, power(p, True)), p)

    try:
        for m in measures:
            if m in MATRIX_BATCHES:
                x, y = np.broadcast_arrays(a, b)
                yield m, MATRIX_BATCHES[m](x.reshape(-1, dim), y.reshape(-1, dim)).reshape(x.shape[:-1])
                continue
            if m == "cosine":
                norms = about_a[m] * about_b[m]
                yield m, np.divide(reduce(np.add, (a[..., i] * b[..., i] for i in range(dim))), norms, out=np.full(norms.shape, np.nan), where=norms > 0)
                continue
            p, kind = _order(m), m.partition("_")[2]
            if kind == "ref":
                yield m, lp(p) * (about_a[m] + about_b[m])
            elif kind == "dot":
                more = np.abs(about_a[kind] - about_b[kind])
                yield m, (rooted(total(p) + powered(more, p), p) if p <= 10 else lp_of([*power(1), more], p)) if p else np.maximum(largest(), more)
            elif kind:
                raise ValueError(f"unknown distance {m}")
            else:
                yield m, lp(p).copy()
    finally:  # they refer to one another: their arrays would wait for the collector
        for f in (power, largest, total, lp):
            f.cache_clear()


def rooted(x: np.ndarray, p: int) -> np.ndarray:
    """The p-th root."""
    return x if p == 1 else np.sqrt(x) if p == 2 else np.cbrt(x) if p == 3 else x ** (1 / p)


def keep_memory() -> None:
    """Let the C library keep the memory of a block's arrays for the next block: it raises its thresholds (a few 10 MB) when a large array is freed."""
    np.empty(4_000_000)


def stacked_silhouettes(own: np.ndarray, x: np.ndarray, measures: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(measure, silhouettes, counted) of groups of equal size: clusters from 0 (groups x rows) and finite vectors of rows that all have names of their own.

    Silhouettes are as those of `silhouette_values`. Rows whose vector has no distance by a measure (a null vector by cosine) don't count.
    """
    n = own.shape[1]
    hot = (own[:, :, None] == np.arange(own.max() + 1)).astype(float)
    for m, d in broadcast_distances(x[:, :, None], x[:, None], measures):
        counted, h = np.ones(own.shape, bool), hot
        if m == "cosine":
            counted = ~np.isnan(np.diagonal(d, axis1=1, axis2=2))
            d, h = np.nan_to_num(d), hot * counted[:, :, None]
        d[:, np.arange(n), np.arange(n)] = 0
        yield m, np.where(counted, _silhouettes(d @ h, h.sum(1)[:, None] - h, own), np.nan), counted


def silhouette_values(rows: np.ndarray, own: np.ndarray, x: np.ndarray, lo: int, hi: int, measures: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray]]:
    """(measure, silhouettes) of rows lo to hi of a group in order of `rows`; NaN where there is one cluster or a distance is undefined.

    Rows of one name (and cluster) count as one, and distances among them are left out. Sums run over
    columns in order of cluster, in blocks that stay in a processor's cache.
    """
    n = len(rows)
    turn = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(own[turn]) > 0])
    own = np.unique(own, return_inverse=True)[1]
    k, size, place = len(starts), np.diff(np.r_[starts, n]), np.argsort(turn)
    twice = bool((rows[1:] == rows[:-1]).any())
    plain = tuple(m for m in measures if m not in MATRIX_BATCHES)
    logs = matrix_logs(x).reshape(n, -1) if "log_frobenius" in measures else None
    sides = [(x, plain)] + ([(np.hstack([logs.real, logs.imag]), ("log_frobenius",))] if logs is not None else []) + [(x, (m,)) for m in measures if m in ONE_WAY]
    total, count = {m: np.empty((hi - lo, k)) for m in measures}, np.empty((hi - lo, k))

    def blocks(v: np.ndarray, w: np.ndarray, names: tuple[str, ...], single: dict[str, np.ndarray], s: int, e: int) -> Iterator[tuple[str, np.ndarray]]:
        if names == ("log_frobenius",):
            yield "log_frobenius", block_distances(v[s:e], w, "l2")
        elif names and names[0] in ONE_WAY:  # the earlier row comes first
            d = block_distances(v[s:e], v[s:e], names[0])
            mid = np.where(np.arange(s, e)[:, None] < np.arange(s, e)[None], d, d.T)
            yield names[0], np.hstack([block_distances(v[:s], v[s:e], names[0]).T, mid, block_distances(v[s:e], v[e:], names[0])])[:, turn]
        elif len(names) == 1:
            yield names[0], block_distances(v[s:e], w, names[0])
        else:
            yield from broadcast_distances(v[s:e, None], w[None], names, {z: y[s:e, None] for z, y in single.items()}, {z: y[turn][None] for z, y in single.items()})

    for v, names in sides:
        w, single = v[turn], about(v, names)
        step = max(1, (BLOCK if len(names) > 1 else 500_000) // n)
        for s in range(lo, hi, step):
            e = min(hi, s + step)
            same = rows[s:e, None] == rows[turn][None] if twice else (np.arange(e - s), place[s:e])
            count[s - lo : e - lo] = np.add.reduceat(~same, starts, axis=1, dtype=float) if twice else size - (own[s:e, None] == np.arange(k))
            for m, d in blocks(v, w, names, single, s, e):
                d[same] = 0
                total[m][s - lo : e - lo] = np.add.reduceat(d, starts, axis=1)
    for z in total.values():  # a row with an undefined distance has no silhouette
        z[~np.isfinite(z).all(1)] = np.nan
    c = own[lo:hi]
    if twice:
        name = np.r_[0, np.cumsum(rows[lo + 1 : hi] != rows[lo : hi - 1])]
        key, at = np.unique(name * k + c, return_inverse=True)
        once = lambda z: np.array([np.bincount(at, z[:, j], minlength=len(key)) for j in range(k)]).T
        total, count, c = {m: once(z) for m, z in total.items()}, once(count), key % k
    for m in measures:
        yield m, _silhouettes(total[m][None], count[None], c[None])[0]


def _silhouettes(total: np.ndarray, count: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Silhouettes (groups x rows) from summed distances and numbers of rows (groups x rows x clusters)."""
    at = own[:, :, None]
    mean = np.divide(total, count, out=np.full(count.shape, np.nan), where=count > 0)
    a, alone = np.take_along_axis(mean, at, 2)[:, :, 0], np.take_along_axis(count, at, 2)[:, :, 0] == 0
    np.put_along_axis(mean, at, np.nan, 2)
    b = np.fmin.reduce(mean, axis=2)
    most = np.fmax(a, b)
    out = np.divide(b - a, most, out=np.zeros(own.shape), where=most != 0)
    return np.where(np.isnan(b), np.nan, np.where(alone, 0.0, out))


def silhouettes_by_measure(df: DataFrame, by: list[str], row: str, cluster: str, vec: str, measures: tuple[str, ...], chunk: int = 512) -> DataFrame:
    """`<by>, measure, swc`: the mean silhouette; null where every row is its own cluster or there is but one cluster."""
    x = df.dropna(subset=by).select(*by, F.struct(F.col(row).alias("r"), F.col(cluster).alias("c"), F.transform(vec, lambda v: v.cast("double")).alias("v")).alias("_s"))
    g = x.groupBy(*by).agg(F.sort_array(F.collect_list("_s")).alias("_l"))
    g = g.select(*by, F.transform("_l", lambda s: s["r"]).alias("_r"), F.transform("_l", lambda s: s["c"]).alias("_c"), F.flatten(F.transform("_l", lambda s: s["v"])).alias("_v"))
    n = F.size("_r")
    parts = F.greatest(F.least(F.ceil(n / float(chunk)), F.lit(12)), F.ceil(n / (4.0 * chunk))).cast("int")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    g = g.withColumn("_parts", parts).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).repartition(tasks, *by, "_p")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = tuple(m for m in measures if m not in MATRIX_BATCHES)
        keep_memory()
        for batch in batches:
            told: list[tuple] = []
            stacks: dict[tuple, list[tuple]] = defaultdict(list)
            for i in range(batch.num_rows):
                rows, c, v = (batch.column(name)[i].values.to_numpy(zero_copy_only=False) for name in ("_r", "_c", "_v"))
                vecs = v.reshape(len(rows), -1)
                names, own = np.unique(c, return_inverse=True)
                small = len(rows) <= STACKED and not (rows[1:] == rows[:-1]).any() and np.isfinite(vecs).all()
                if small:
                    stacks[vecs.shape].append((i, own, vecs))
                p, of = batch.column("_p")[i].as_py(), batch.column("_parts")[i].as_py()
                lo, hi = (next((j for j in range(at, len(rows)) if j == 0 or rows[j] != rows[j - 1]), len(rows)) for at in (p * len(rows) // of, (p + 1) * len(rows) // of))
                rest = tuple(m for m in measures if m not in plain) if small else measures
                for some in (tuple(m for m in rest if m != "cosine"), tuple(m for m in rest if m == "cosine")):
                    here, from_, to = (rows, own, vecs), lo, hi
                    if some == ("cosine",) and not (there := vecs.any(1)).all():  # a null vector has no cosine
                        here, from_, to = tuple(z[there] for z in here), int(there[:lo].sum()), int(there[:hi].sum())
                    k = len(np.unique(here[1]))
                    for m, s in silhouette_values(*here, from_, to, some) if from_ < to and some else ((m, np.empty(0)) for m in some):
                        told.append((i, m, float(np.nansum(s)), int((~np.isnan(s)).sum()), len(s), k))
            for (n, _), groups in stacks.items():
                step = max(1, BLOCK // (n * n))
                for j in range(0, len(groups), step):
                    at, own, x = (np.array(z) for z in zip(*groups[j : j + step]))
                    for m, s, counted in stacked_silhouettes(own, x, plain):
                        clusters = own.max(1) + 1 if counted.all() else np.array([len(np.unique(o[u])) for o, u in zip(own, counted)])
                        told += zip(at.tolist(), [m] * len(at), np.nansum(s, 1).tolist(), (~np.isnan(s)).sum(1).tolist(), counted.sum(1).tolist(), clusters.tolist())
            at, *cols = zip(*told) if told else [()] * 6
            kept = [batch.column(b).take(pa.array(at, pa.int64())) for b in by]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), *[pa.int64()] * 3)))], [*by, "measure", "s", "m", "n", "k"])

    d = g.select(*by, "_p", "_parts", "_r", "_c", "_v").mapInArrow(run, ", ".join(f"{b} {kinds[b]}" for b in by) + ", measure string, s double, m long, n long, k long")
    d = d.groupBy(*by, "measure").agg(*[F.sum(c).alias(c) for c in ("s", "m", "n")], F.max("k").alias("k"))
    return d.where("n > 0").select(*by, "measure", F.when(F.col("n") > F.col("k"), F.round(F.try_divide("s", "m") + 1e-9, 6)).alias("swc"))


def silhouette_index(df: DataFrame, by: list[str], row: str, cluster: str, vec: str, measure: str = "l5", chunk: int = 512) -> DataFrame:
    """As `silhouettes_by_measure`, of one measure: `<by>, swc`."""
    return silhouettes_by_measure(df, by, row, cluster, vec, (measure,), chunk).drop("measure")


def _measured(df: DataFrame, measures: tuple[str, ...], **pairs: tuple[str, str]) -> DataFrame:
    """A row per measure with the distances of the named pairs of vector columns."""
    return df.withColumn("_m", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), *[distance(m)(F.col(a), F.col(b)).alias(n) for n, (a, b) in pairs.items()]) for m in measures]))).select("*", "_m.*").drop("_m")


def centroid_indices(rows: DataFrame, centroids: DataFrame, overall: DataFrame, by: list[str], cluster: str, measures: str | tuple[str, ...] = ("l5",), least: float = 1e-15, over: list[str] | None = None) -> DataFrame:
    """`<by>, measure, dbi, vrc, pbm, e` from rows (`<by>, cluster, vec`), cluster centroids (`<by>, cluster, centroid`) and the whole's centroid (`<over>, overall`).

    Centroids at distance 0 count as `least` apart. PBM divides by the number of rows. An index that
    its formula leaves undefined (one cluster; as many clusters as rows) is null. Pairs of centroids
    meet within their group alone, and there are as many centroids as clusters, not rows. `e` is the
    summed distance of rows to their centroids: where it is 0 but for rounding, VRC and PBM are noise.
    """
    over = by if over is None else over
    measures = (measures,) if isinstance(measures, str) else measures
    x = rows.join(centroids, [*by, cluster]).join(overall, over)
    x = _measured(x, measures, d_own=("vec", "centroid"), d_all=("vec", "overall"), d_between=("centroid", "overall"))
    g = [*by, "measure"]
    per = x.groupBy(*g, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d_own").alias("sigma"), F.sum("d_own").alias("e"), F.sum(F.col("d_own") * F.col("d_own")).alias("e2"), F.sum("d_all").alias("e1"), F.first("d_between").alias("_b"))
    sums = per.groupBy(*g).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("_b") * F.col("_b")).alias("between"), F.sum("e2").alias("e2"), F.sum("e").alias("e"), F.sum("e1").alias("e1"))
    used = rows.select(*by, cluster).distinct().join(centroids, [*by, cluster])
    two = used.join(used.select(*by, F.col(cluster).alias("_c2"), F.col("centroid").alias("_m2")), by).where(F.col(cluster) != F.col("_c2"))
    two = _measured(two, measures, d=("centroid", "_m2")).select(*g, cluster, "_c2", "d")
    two = two.join(per.select(*g, cluster, "sigma"), [*g, cluster]).join(per.select(*g, F.col(cluster).alias("_c2"), F.col("sigma").alias("_s2")), [*g, "_c2"])
    worst = two.groupBy(*g, cluster).agg(F.max((F.col("sigma") + F.col("_s2")) / F.greatest(F.col("d"), F.lit(least))).alias("r"), F.max("d").alias("d"))
    worst = worst.groupBy(*g).agg(F.avg("r").alias("dbi"), F.max("d").alias("apart"))
    y = sums.join(worst, g, "left")
    vrc = ratio(F.col("between") * (F.col("rows") - F.col("k")), F.col("e2") * (F.col("k") - 1))
    pbm = F.pow(ratio(F.col("apart") * F.col("e1"), F.col("rows") * F.col("e")), 2.0)
    return y.select(*g, "dbi", vrc.alias("vrc"), pbm.alias("pbm"), "e")


def grouped_ranks(code: np.ndarray, counts: np.ndarray, place: np.ndarray, places: int) -> np.ndarray:
    """Average ranks within each code of values given by their place among all different values, less the mean rank."""
    base = np.r_[0, np.cumsum(counts)[:-1]]
    key = code.astype(np.int64) * places + place
    if len(counts) * places <= 4 * len(key) + 1000:  # counted without sorting
        n, at = np.bincount(key, minlength=len(counts) * places), key
    else:
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    rank = np.cumsum(n) - (n - 1) / 2.0
    return rank[at] - base[code] - (counts[code] + 1) / 2.0


def grouped_correlations(code: np.ndarray, groups: int, places: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Rank correlations (upper triangle) of the rows of each code; NaN where a column is constant."""
    counts = np.bincount(code, minlength=groups)
    r = [grouped_ranks(code, counts, *p) for p in places]
    var = [np.bincount(code, x * x, minlength=groups) for x in r]
    out = np.full((groups, len(r) * (len(r) - 1) // 2), np.nan)
    for j, (a, b) in enumerate(combinations(range(len(r)), 2)):
        v = var[a] * var[b]
        np.divide(np.bincount(code, r[a] * r[b], minlength=groups), np.sqrt(v), out=out[:, j], where=v > 0)
    return out


def cut3(x: np.ndarray) -> np.ndarray:
    """As `columns.trunc3`."""
    x = np.round(x, 9)
    return np.sign(x) * np.floor(np.round(np.abs(x) * 1000, 6)) / 1000


def subject_indices(obs: dict[str, np.ndarray], seg: dict[str, np.ndarray], variates: tuple[str, ...], measures: tuple[str, ...], least: float = 1e-15) -> list[tuple]:
    """(partition, measure, dbi, vrc, pbm, e) of all partitions of one subject, as `centroid_indices`; None where undefined.

    `obs` has `obs_idx` and the variates; `seg` has `partition`, `cluster`, `start_idx`, `end_idx` (NaN bounds cover nothing),
    `vec` and `usable`, the rows that the indices are of.
    """
    order = np.argsort(obs["obs_idx"], kind="stable")
    idx = obs["obs_idx"][order]
    places = []
    for v in variates:
        u, at = np.unique(obs[v][order], return_inverse=True)
        places.append((at.astype(np.int32), len(u)))
    if not len(idx):
        return []
    overall = cut3(grouped_correlations(np.zeros(len(idx), np.int32), 1, places))
    kinds, which = np.unique(seg["partition"], return_inverse=True)
    turn = np.argsort(which, kind="stable")
    found: list[tuple] = []
    for part, at in zip(kinds, np.split(turn, np.cumsum(np.bincount(which, minlength=len(kinds)))[:-1])):
        labels, own = np.unique(seg["cluster"][at], return_inverse=True)
        start, end = seg["start_idx"][at], seg["end_idx"][at]
        covers = end >= start
        lo, hi = (np.searchsorted(idx, np.where(covers, b, 0), side) for b, side in ((start, "left"), (end, "right")))
        n = np.where(covers, hi - lo, 0)
        rows = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        code = np.repeat(own.astype(np.int32), n)
        there = np.bincount(code, minlength=len(labels)) > 0
        cen = cut3(grouped_correlations(code, len(labels), [(p[rows], k) for p, k in places])) if len(code) else np.full((len(labels), overall.shape[1]), np.nan)
        use = seg["usable"][at] & there[own]
        if not use.any():
            continue
        used, c = np.unique(own[use], return_inverse=True)
        found.append((part, seg["vec"][at][use], c, cen[used]))
    return partition_indices(found, overall, measures, least) if found else []


def partition_indices(found: list[tuple], overall: np.ndarray, measures: tuple[str, ...], least: float) -> list[tuple]:
    """(partition, measure, dbi, vrc, pbm, e) from (partition, vectors, their clusters from 0, centroids) and the whole's centroid: partitions side by side in one array, filled up with centroids that don't count."""
    k = np.array([len(x[3]) for x in found])
    most = int(k.max())
    real = np.arange(most) < k[:, None]
    cen = np.zeros((len(found), most, overall.shape[1]))
    cen[real] = np.concatenate([x[3] for x in found])
    vec, c = np.concatenate([x[1] for x in found]), np.concatenate([x[2] + i * most for i, x in enumerate(found)])
    rows = np.array([len(x[1]) for x in found])
    part = np.repeat(np.arange(len(found)), rows)
    pairs = real[:, :, None] & real[:, None] & ~np.eye(most, dtype=bool)
    many = np.bincount(c, minlength=real.size).reshape(real.shape).astype(float)
    summed = lambda x: np.bincount(c, x, minlength=real.size).reshape(real.shape)
    pooled_cen = cen.reshape(-1, cen.shape[2])[c]
    out: list[tuple] = []
    each = (broadcast_distances(a, b, measures) for a, b in ((vec, pooled_cen), (vec, overall), (cen, overall), (cen[:, :, None], cen[:, None])))
    for (m, d_own), (_, d_all), (_, b), (_, far) in zip(*each):
        by, e, e2, e1 = summed(d_own), summed(d_own).sum(1), summed(d_own * d_own).sum(1), np.bincount(part, d_all, minlength=len(found))
        sigma = by / np.maximum(many, 1)
        worst = np.where(pairs, (sigma[:, :, None] + sigma[:, None]) / np.maximum(far, least), -np.inf).max(2)
        apart = np.where(pairs, far, -np.inf).max((1, 2))
        dbi = np.where(real, worst, 0).sum(1) / k
        rest, total = e2 * (k - 1), rows * e
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            vrc, pbm = np.where(real, many * b * b, 0).sum(1) * (rows - k) / rest, (apart * e1 / total) ** 2
        several = k > 1
        none = lambda x, ok: [v if u else None for v, u in zip(x.tolist(), ok.tolist())]
        out += zip([x[0] for x in found], [m] * len(found), none(dbi, several), none(vrc, rest != 0), none(pbm, several & (total != 0)), e.tolist())
    return out


def pooled_indices(obs: DataFrame, segments: DataFrame, partition: str, variates: tuple[str, ...], measures: tuple[str, ...]) -> DataFrame:
    """`subject_id, <partition>, measure, dbi, vrc, pbm, e` of every partition, from a subject's observations (all variates there) and the segments of its partitions.

    `segments` has `subject_id, <partition>, cluster_id, start_idx, end_idx, vec, usable`. Each subject is one piece of work.
    """
    s = segments.dropna(subset=["subject_id", partition, "cluster_id"])
    s = s.select("subject_id", F.col(partition).alias("partition"), F.col("cluster_id").alias("cluster"), *[F.col(c).cast("double").alias(c) for c in ("start_idx", "end_idx")],
                 *[F.when(F.col("usable"), F.get("vec", F.lit(i)).cast("double")).alias(f"v{i}") for i in range(len(variates) * (len(variates) - 1) // 2)], F.coalesce("usable", F.lit(False)).alias("usable"))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keep_memory()
        a, b = ({c: t.column(c).to_numpy() for c in t.column_names if c != "subject_id"} for t in (left, right))
        b["vec"] = np.stack([b[c] for c in b if c.startswith("v")], axis=1).astype(float)
        b["usable"] = b["usable"].astype(bool)
        got = subject_indices(a, b, variates, measures) if left.num_rows and right.num_rows else []
        cols = list(zip(*got)) or [()] * 6
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(got), pa.string()), *(pa.array(c, t) for c, t in zip(cols, [pa.string()] * 2 + [pa.float64()] * 4))], names=["subject_id", partition, "measure", "dbi", "vrc", "pbm", "e"])

    o = obs.select("subject_id", "obs_idx", *variates).groupBy("subject_id").cogroup(s.groupBy("subject_id"))
    return o.applyInArrow(run, f"subject_id string, {partition} string, measure string, dbi double, vrc double, pbm double, e double")


def mean_vectors(rows: DataFrame, by: list[str], vec: str, name: str) -> DataFrame:
    """Component-wise means of vectors per group."""
    x = rows.select(*by, F.posexplode(vec).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_x"))
    return x.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(name))


def agreement(truth: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """`subject_id, <by>, n, agree`: positions that both segmentations cover, and those with equal cluster.

    Intervals meet through the blocks they touch; a pair of intervals counts in the block of the
    larger start only, so overlaps are summed once and no position becomes a row.
    """
    block = 1024
    cut = lambda s, p: s.where("end_idx >= start_idx").select(*[F.col(c).alias(f"{p}{c}") for c in ("subject_id", "start_idx", "end_idx", "cluster_id")], *([] if p == "t_" else by), F.explode(F.sequence(F.floor(F.col("start_idx") / block), F.floor(F.col("end_idx") / block))).alias(f"{p}b"))
    t, o = cut(truth, "t_"), cut(other, "o_")
    lo, hi = F.greatest("t_start_idx", "o_start_idx"), F.least("t_end_idx", "o_end_idx")
    x = t.join(o, (F.col("t_subject_id") == F.col("o_subject_id")) & (F.col("t_b") == F.col("o_b"))).where((lo <= hi) & (F.floor(lo / block) == F.col("t_b")))
    x = x.withColumn("_n", hi - lo + 1)
    return x.groupBy(F.col("t_subject_id").alias("subject_id"), *by).agg(F.sum("_n").alias("n"), F.coalesce(F.sum(F.when(F.col("t_cluster_id") == F.col("o_cluster_id"), F.col("_n"))), F.lit(0)).alias("agree"))


def pooled(obs: DataFrame, segments: DataFrame, by: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Observations with the clusters that cover them, for correlations pooled by cluster."""
    return interval_join(obs.select("subject_id", "obs_idx", *columns), segments.select("subject_id", "start_idx", "end_idx", *[c for c in by if c != "subject_id"])).select(*by, *columns)


def ranked_groups(df: DataFrame, by: list[str], value: str, name: str, ascending: bool = True) -> DataFrame:
    """Dense ranks within a group."""
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(value).asc() if ascending else F.col(value).desc())))
