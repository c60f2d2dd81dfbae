"""Toeplitz inverse-covariance clustering of multivariate series.

A model is fitted on all rows of all series (alternating a sparse block-Toeplitz inverse covariance
per cluster with the best assignment under a switching penalty): moments of the stacked windows are
summed per cluster by the tasks, and only these sums reach the driver. It is applied to series of any
number and length. `fit_matrix` does the same for one series in memory.

Assigning is a shortest path. It is cut into chunks of positions: each chunk gives the cost of its
best path for every pair of first and last cluster; per subject these small matrices are chained;
then each chunk is solved between its fixed ends. The result is that of the uncut path, and no task
holds a whole subject's observations.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandweave.runtime import dropped, scratch, written


@dataclass
class Model:
    means: np.ndarray  # clusters x (window * variates)
    inverses: np.ndarray
    window: int
    penalty: float
    bic: float

    def costs(self, stacked: np.ndarray) -> np.ndarray:
        """Negative log-likelihood of each row in each cluster."""
        out = np.empty((len(stacked), len(self.means)))
        for k, (m, inv) in enumerate(zip(self.means, self.inverses)):
            d = stacked - m
            out[:, k] = ((d @ inv) * d).sum(1) - np.linalg.slogdet(inv)[1]
        return out


def stacked_windows(x: np.ndarray, window: int) -> np.ndarray:
    """Row i holds rows i..i+window-1 side by side; past the end there are zeros."""
    padded = np.vstack([x, np.zeros((window - 1, x.shape[1]))])
    return np.hstack([padded[k : k + len(x)] for k in range(window)])


@lru_cache
def _block_diagonals(size: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of every entry, whether it lies in the upper blocks, number of upper entries of each group); mirrored entries share a group."""
    r, c = np.indices((size, size))
    i, j, a, b = r // n, c // n, r % n, c % n
    lag, upper = np.abs(j - i), i <= j
    a, b = np.where(upper, a, b), np.where(upper, b, a)
    a, b = np.where(lag == 0, np.minimum(a, b), a), np.where(lag == 0, np.maximum(a, b), b)
    groups = np.unique((lag * n + a) * n + b, return_inverse=True)[1].reshape(size, size)
    return groups, upper, np.bincount(groups[upper])


def toeplitz_mean(m: np.ndarray, n: int) -> np.ndarray:
    """The nearest symmetric matrix whose blocks of size n are equal along each block diagonal."""
    groups, upper, counts = _block_diagonals(len(m), n)
    return (np.bincount(groups[upper], m[upper]) / counts)[groups]


def sparse_inverse(cov: np.ndarray, n: int, penalty: float = 0.1, rho: float = 1.0, steps: int = 300, tol: float = 1e-5) -> np.ndarray:
    """Graphical lasso with block-Toeplitz structure, by alternating directions."""
    return sparse_inverses(cov[None], n, penalty, rho, steps, tol)[0]


def sparse_inverses(covs: np.ndarray, n: int, penalty: float = 0.1, rho: float = 1.0, steps: int = 300, tol: float = 1e-5) -> np.ndarray:
    """As `sparse_inverse`, of a stack of matrices; each stops when it has converged."""
    size = covs.shape[1]
    groups, upper, counts = _block_diagonals(size, n)
    flat, diag = groups[upper], np.arange(size)
    z = np.broadcast_to(np.eye(size), covs.shape).copy()
    u = np.zeros_like(covs)
    todo = np.arange(len(covs))
    for _ in range(steps):
        zt, ut = z[todo], u[todo]
        w, q = np.linalg.eigh(rho * (zt - ut) - covs[todo])
        x = (q * ((w + np.sqrt(w * w + 4 * rho)) / (2 * rho))[:, None, :]) @ q.transpose(0, 2, 1)
        a = x + ut
        a = np.stack([np.bincount(flat, m[upper]) for m in a])
        a = (a / counts)[:, groups]
        soft = np.sign(a) * np.maximum(np.abs(a) - penalty / rho, 0)
        soft[:, diag, diag] = a[:, diag, diag]
        z[todo], u[todo] = soft, ut + x - soft
        done = (np.abs(soft - zt).max((1, 2)) < tol) & (np.abs(x - soft).max((1, 2)) < tol)
        todo = todo[~done]
        if not len(todo):
            break
    w, q = np.linalg.eigh(z)
    return (q * np.maximum(w, 1e-6)[:, None, :]) @ q.transpose(0, 2, 1)


def best_path(cost: np.ndarray, penalty: float, first: int | None = None, last: int | None = None) -> np.ndarray:
    """Clusters of least cost, where every change costs the penalty; ends may be fixed. Ties stay, then take the lower number."""
    n, k = cost.shape
    back = np.empty((n, k), np.int32)
    total = np.full(k, np.inf) if first is not None else cost[0].copy()
    if first is not None:
        total[first] = cost[0, first]
    for t in range(1, n):
        j = int(total.argmin())
        stay = total <= total[j] + penalty
        back[t] = np.where(stay, np.arange(k), j)
        total = np.where(stay, total, total[j] + penalty) + cost[t]
    path = np.empty(n, np.int32)
    path[-1] = int(total.argmin()) if last is None else last
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def path_costs(cost: np.ndarray, penalty: float) -> np.ndarray:
    """Least cost from each first cluster (row) to each last one (column)."""
    k = cost.shape[1]
    total = np.where(np.eye(k, dtype=bool), cost[0], np.inf)
    for row in cost[1:]:
        total = np.minimum(total, total.min(1, keepdims=True) + penalty) + row
    return total


def chained_ends(matrices: list[np.ndarray], penalty: float) -> list[tuple[int, int]]:
    """(first, last) cluster of each chunk on the best path over all."""
    k = len(matrices[0])
    change = penalty * (1 - np.eye(k))
    reach, enter = np.zeros(k), []
    for i, m in enumerate(matrices):
        start = (reach[:, None] + change).min(0) if i else reach
        came = (reach[:, None] + change).argmin(0)
        through = start[:, None] + m
        enter.append((came, through.argmin(0)))
        reach = through.min(0)
    last = int(reach.argmin())
    ends = []
    for came, firsts in reversed(enter):
        first = int(firsts[last])
        ends.append((first, last))
        last = int(came[first])
    return ends[::-1]


def fit_matrix(x: np.ndarray, clusters: int, window: int, sparsity: float = 0.1, penalty: float = 50.0, iterations: int = 10, seed: int = 3) -> tuple[Model, np.ndarray]:
    """(model, assignment) of one series; clusters that run empty take rows of the costliest one."""
    rng = np.random.default_rng(seed)
    n = x.shape[1]
    s = stacked_windows(x, window)
    centres = s[rng.choice(len(s), clusters, replace=len(s) < clusters)]
    for _ in range(10):
        a = ((s[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([s[a == k].mean(0) if (a == k).any() else centres[k] for k in range(clusters)])
    model = None
    for _ in range(iterations):
        counts = np.bincount(a, minlength=clusters)
        for k in np.flatnonzero(counts < 2):
            from_ = np.flatnonzero(a == counts.argmax())
            a[from_[len(from_) // 2 :][: max(2, len(from_) // 4)]] = k
            counts = np.bincount(a, minlength=clusters)
        means = np.array([s[a == k].mean(0) if (a == k).any() else s.mean(0) for k in range(clusters)])
        covs = [np.cov(s[a == k].T, bias=True) if (a == k).sum() > 1 else np.eye(s.shape[1]) for k in range(clusters)]
        model = Model(means, np.array([sparse_inverse(c + 1e-6 * np.eye(len(c)), n, sparsity) for c in covs]), window, penalty, 0.0)
        new = best_path(model.costs(s), penalty)
        if (new == a).all():
            break
        a = new
    model.bic = bayes_information(model, s, a)
    return model, a


def bayes_information(model: Model, stacked: np.ndarray, a: np.ndarray, zero: float = 2e-5) -> float:
    """Parameters (non-zero entries, counted at every change of cluster) times log n, less twice the log-likelihood."""
    changes = a[np.r_[True, a[1:] != a[:-1]]]
    size = (np.abs(model.inverses) > zero).sum((1, 2))
    fit = 0.0
    for k in np.unique(a):
        c = np.cov(stacked[a == k].T, bias=True) if (a == k).sum() > 1 else np.eye(stacked.shape[1])
        fit += np.linalg.slogdet(model.inverses[k])[1] - np.trace(c @ model.inverses[k])
    return float(size[changes].sum() * np.log(len(stacked)) - 2 * fit)


def packed(obs: DataFrame, variates: tuple[str, ...], chunk: int, window: int) -> DataFrame:
    """`subject_id, chunk, n, x, idx`: the rows of each chunk in order, as bytes: its own `n`, then the `window - 1` rows that follow them in the subject.

    Written once. What follows comes from the first rows of the next chunks, a small table; a chunk
    holds at most `chunk` positions, so no task holds a subject.
    """
    names, more = list(variates), window - 1

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("obs_idx")
        x = g[names].to_numpy(float)
        return pd.DataFrame({"subject_id": [key[0]], "chunk": [key[1]], "n": [len(g)], "x": [x.tobytes()], "idx": [g["obs_idx"].to_numpy(np.int64).tobytes()], "head": [x[:more].ravel()]})

    at = F.floor(F.col("obs_idx") / chunk).alias("chunk")
    own = obs.select("subject_id", "obs_idx", *names, at).groupBy("subject_id", "chunk").applyInPandas(run, "subject_id string, chunk long, n int, x binary, idx binary, head array<double>")
    if more <= 0:
        return written(own.drop("head"))
    with scratch(own) as own:
        w = Window.partitionBy("subject_id").orderBy("chunk").rowsBetween(1, more)
        after = own.select("subject_id", "chunk", F.slice(F.flatten(F.collect_list("head").over(w)), 1, more * len(names)).alias("after"))

        def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                f["x"] = [x + np.asarray(a, float).tobytes() for x, a in zip(f["x"], f["after"])]
                yield f[["subject_id", "chunk", "n", "x", "idx"]]

        return written(own.drop("head").join(after, ["subject_id", "chunk"]).mapInPandas(joined, "subject_id string, chunk long, n int, x binary, idx binary"))


def _stacked(rec: tuple, window: int, variates: int) -> np.ndarray:
    return stacked_windows(np.frombuffer(rec.x).reshape(-1, variates), window)[: rec.n]


def _features(s: np.ndarray) -> np.ndarray:
    """One, the values and the upper triangle of their products: what means and covariances are made of."""
    i, j = np.triu_indices(s.shape[1])
    return np.hstack([np.ones((len(s), 1)), s, s[:, i] * s[:, j]])


def _moments(sums: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, biased covariances) of clusters from summed features; nothing gives zeros."""
    n = sums[:, 0]
    by = np.maximum(n, 1e-300)[:, None]
    means, second = sums[:, 1 : size + 1] / by, sums[:, size + 1 :] / by
    covs = np.zeros((len(n), size, size))
    i, j = np.triu_indices(size)
    covs[:, i, j] = second - means[:, i] * means[:, j]
    covs[:, j, i] = covs[:, i, j]
    return n, means, covs


def _summed(df: DataFrame, f: Callable[[tuple], np.ndarray]) -> np.ndarray:
    """The sum of f over the rows of a packed table: an array of fixed length, added up by the tasks."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for frame in frames:
            for rec in frame.itertuples(index=False):
                v = f(rec)
                out = v if out is None else out + v
        if out is not None:
            yield pd.DataFrame({"j": np.arange(len(out)), "v": out})

    rows = df.mapInPandas(run, "j long, v double").groupBy("j").agg(F.sum("v").alias("v")).collect()
    out = np.empty(len(rows))
    for r in rows:
        out[r.j] = r.v
    return out


def seeds(data: DataFrame, clusters: int, window: int, variates: int, seed: int, about: int = 20_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift, sample, assignment): k-means of about `about` windows drawn over all series; starting points of the mixture only."""
    share = min(1.0, about / max(1, data.agg(F.sum("n")).first()[0]))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec in frame.itertuples(index=False):
                s = _stacked(rec, window, variates)
                rng = np.random.default_rng(zlib.crc32(f"{seed} {rec.subject_id} {rec.chunk}".encode()))
                s = s[rng.random(len(s)) < share]
                if len(s):  # Arrow takes no empty column of lists
                    yield pd.DataFrame({"id": rec.subject_id, "chunk": rec.chunk, "s": list(s)})

    got = data.mapInPandas(run, "id string, chunk long, s array<double>").collect()
    s = np.array([r.s for r in sorted(got, key=lambda r: (r.id, r.chunk))])
    rng = np.random.default_rng(seed)
    shift, centres = s.mean(0), [s[rng.integers(len(s))]]
    near = ((s - centres[0]) ** 2).sum(1)
    while len(centres) < clusters:
        centres.append(s[rng.choice(len(s), p=near / near.sum())] if near.sum() > 0 else s[rng.integers(len(s))])
        near = np.minimum(near, ((s - centres[-1]) ** 2).sum(1))
    c = np.array(centres)
    for _ in range(30):
        a = ((s**2).sum(1)[:, None] - 2 * s @ c.T + (c**2).sum(1)).argmin(1)
        c = np.array([s[a == k].mean(0) if (a == k).any() else c[k] for k in range(clusters)])
    return shift, s, a


def mixture_start(data: DataFrame, clusters: int, window: int, variates: int, seed: int, most: int = 100, tol: float = 1e-3, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(shift, sums): a Gaussian mixture with full covariances, and the feature sums of all rows by most probable component.

    Expectation-maximisation runs on the seeds' bounded sample first, and goes on over all rows from
    there, until the mean log-likelihood of all rows gains less than `tol`, `most` passes at most.
    """
    size = window * variates
    shift, sample, a = seeds(data, clusters, window, variates, seed)
    sample = sample - shift

    def logs(s: np.ndarray, weights: np.ndarray, means: np.ndarray, roots: np.ndarray) -> np.ndarray:
        out = np.empty((len(s), clusters))
        for k in range(clusters):
            out[:, k] = -0.5 * (((s - means[k]) @ roots[k]) ** 2).sum(1) + np.log(np.diag(roots[k])).sum() + weights[k]
        return out - 0.5 * size * np.log(2 * np.pi)

    def parameters(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, means, covs = _moments(sums, size)
        return np.log(np.maximum(n, 1e-12) / n.sum()), means, np.array([np.linalg.inv(np.linalg.cholesky(c + floor * np.eye(size))).T for c in covs])

    def softly(s: np.ndarray, features: np.ndarray, p: tuple) -> np.ndarray:
        g = logs(s, *p)
        top = g.max(1, keepdims=True)
        e = np.exp(g - top)
        t = e.sum(1, keepdims=True)
        return np.append(((e / t).T @ features).ravel(), (top + np.log(t)).sum())

    def climbed(sums: np.ndarray, step: Callable[[tuple], np.ndarray]) -> np.ndarray:
        before = -np.inf
        for _ in range(most):
            got = step(parameters(sums))
            sums = got[:-1].reshape(clusters, -1)
            bound = got[-1] / sums[:, 0].sum()
            if abs(bound - before) < tol:
                break
            before = bound
        return sums

    f = _features(sample)
    sums = climbed((a[:, None] == np.arange(clusters)).astype(float).T @ f, lambda p: softly(sample, f, p))

    def over_all(p: tuple) -> np.ndarray:
        def soft(rec: tuple) -> np.ndarray:
            s = _stacked(rec, window, variates) - shift
            return softly(s, _features(s), p)
        return _summed(data, soft)

    p = parameters(climbed(sums, over_all))

    def hard(rec: tuple) -> np.ndarray:
        s = _stacked(rec, window, variates) - shift
        return ((logs(s, *p).argmax(1)[:, None] == np.arange(clusters)).astype(float).T @ _features(s)).ravel()

    return shift, _summed(data, hard).reshape(clusters, -1)


def _fixed_ends(data: DataFrame, model: Model, variates: int) -> DataFrame:
    """`subject_id, chunk, first, last, before`: the clusters at the ends of each chunk on its subject's best path, and the one before it (-1: none)."""
    k = len(model.means)

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec in frame.itertuples(index=False):
                yield pd.DataFrame({"subject_id": [rec.subject_id], "chunk": [rec.chunk], "m": [path_costs(model.costs(_stacked(rec, model.window, variates)), model.penalty).ravel()]})

    def chain(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk")
        e = chained_ends([np.asarray(m).reshape(k, k) for m in g["m"]], model.penalty)
        return pd.DataFrame({"subject_id": key[0], "chunk": g["chunk"], "first": [a for a, _ in e], "last": [b for _, b in e], "before": [-1, *[b for _, b in e[:-1]]]})

    m = data.mapInPandas(ends, "subject_id string, chunk long, m array<double>")
    return m.groupBy("subject_id").applyInPandas(chain, "subject_id string, chunk long, first int, last int, before int")


def fit(obs: DataFrame, clusters: int, window: int, sparsity: float = 0.11, penalty: float = 400.0, iterations: int = 10, seed: int = 102, moved: int = 30, chunk: int = 8192) -> Model:
    """Fit on all rows of all subjects, from a Gaussian mixture, until no assignment changes, `iterations` at most.

    A cluster that runs empty takes the `moved` rows from the first row on that a cluster with the
    largest covariance has in one of its chunks. The ends of chunks (one small row for `chunk`
    observations) are broadcast.
    """
    names = tuple(c for c in obs.columns if c not in ("subject_id", "obs_idx"))
    n = len(names)
    size = window * n
    data = packed(obs, names, chunk, window)
    shift, sums = mixture_start(data, clusters, window, n, seed)
    digest = None
    for i in range(iterations):
        count, means, covs = _moments(sums, size)
        inverses = sparse_inverses(np.array([c + 1e-6 * np.eye(size) if m > 1 else np.eye(size) for m, c in zip(count, covs)]), n, sparsity, steps=1000, tol=1e-6)
        model = Model(means + shift, inverses, window, penalty, float("nan"))

        def path(rec: tuple) -> tuple[np.ndarray, np.ndarray]:
            s = _stacked(rec, window, n)
            return s, best_path(model.costs(s), penalty, rec.first, rec.last)  # noqa: B023

        def assigned(rec: tuple) -> np.ndarray:
            s, a = path(rec)  # noqa: B023
            hot = (a[:, None] == np.arange(clusters)).astype(float)
            starts = np.bincount(a[np.r_[rec.before, a[:-1]] != a], minlength=clusters)
            d = hashlib.sha256(f"{rec.subject_id} {rec.chunk} ".encode() + a.tobytes()).digest()
            return np.r_[(hot.T @ _features(s - shift)).ravel(), starts, [int.from_bytes(d[b : b + 4], "big") for b in (0, 4, 8)]]

        fixed = written(_fixed_ends(data, model, n))
        joined = data.join(F.broadcast(fixed), ["subject_id", "chunk"])
        got = _summed(joined, assigned)
        sums, starts, now = got[: -clusters - 3].reshape(clusters, -1).copy(), got[-clusters - 3 : -3], tuple(got[-3:])
        if now == digest or i == iterations - 1:
            dropped(fixed)
            break
        digest = now
        empty = np.flatnonzero(sums[:, 0] < 0.5)
        donors = [int(k) for k in np.argsort([-np.linalg.norm(np.linalg.inv(v)) for v in inverses]) if sums[k, 0] >= 2]
        for at, k in enumerate(empty):
            g = donors[at % len(donors)]
            rec = joined.where((F.col("first") == g) | (F.col("last") == g)).orderBy("subject_id", "chunk").offset(at // len(donors)).limit(1).collect()
            rows = None
            if rec:
                s, a = path(rec[0])
                from_ = int(np.flatnonzero(a == g)[0])
                rows = _features(s[from_ : from_ + moved][a[from_ : from_ + moved] == g] - shift)
            if rows is not None and len(rows) < sums[g, 0]:
                sums[k] += rows.sum(0)
                sums[g] -= rows.sum(0)
        dropped(fixed)
    count, _, covs = _moments(sums, size)
    like = sum(np.linalg.slogdet(inverses[k])[1] - np.trace((covs[k] if count[k] > 1 else np.eye(size)) @ inverses[k]) for k in np.flatnonzero(count > 0.5))
    model.bic = float(((np.abs(inverses) > 2e-5).sum((1, 2)) * starts).sum() * np.log(count.sum()) - 2 * like)
    dropped(data)
    return model


def predict(obs: DataFrame, model: Model, variates: tuple[str, ...], chunk: int = 8192) -> DataFrame:
    """`subject_id, obs_idx, cluster`: the best path of each subject under the model.

    A window past a subject's last row holds zeros.
    """
    data = packed(obs, variates, chunk, model.window)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rec in frame.itertuples(index=False):
                a = best_path(model.costs(_stacked(rec, model.window, len(variates))), model.penalty, rec.first, rec.last)
                yield pd.DataFrame({"subject_id": rec.subject_id, "obs_idx": np.frombuffer(rec.idx, np.int64), "cluster": a})

    fixed = _fixed_ends(data, model, len(variates))
    return data.join(fixed, ["subject_id", "chunk"]).mapInPandas(solve, "subject_id string, obs_idx long, cluster int")


def edges(spark: SparkSession, model: Model, zero: float = 2e-5) -> DataFrame:
    """`cluster, i, j, lag, v`: the non-zero off-diagonal entries of each cluster's inverse covariance, of fixed size."""
    n = model.means.shape[1] // model.window
    rows = [(k, i, j, abs(i // n - j // n), round(float(m[i, j]), 6)) for k, m in enumerate(model.inverses) for i in range(len(m)) for j in range(len(m)) if i != j and abs(m[i, j]) > zero]
    return spark.createDataFrame(rows, "cluster int, i int, j int, lag int, v double")


def asymmetric_edges(e: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Entries whose mirror differs or is missing: empty for an undirected graph."""
    t = e.select("cluster", F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("w"))
    return e.join(t, ["cluster", "i", "j"], "left").where(F.col("w").isNull() | (F.abs(F.col("v") - F.col("w")) > tol))


def centralities(e: DataFrame) -> DataFrame:
    """`cluster, node, degree, closeness, betweenness` of each cluster's unweighted graph (tens of nodes)."""
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*g["i"], *g["j"]})
        near: dict[int, set[int]] = {v: set() for v in nodes}
        for i, j in zip(g["i"], g["j"]):
            near[i].add(j)
            near[j].add(i)
        between, close = dict.fromkeys(nodes, 0.0), {}
        for s in nodes:
            dist, ways, order, todo = {s: 0}, {s: 1.0}, [], deque([s])
            while todo:
                v = todo.popleft()
                order.append(v)
                for w in near[v]:
                    if w not in dist:
                        dist[w], ways[w] = dist[v] + 1, 0.0
                        todo.append(w)
                    if dist[w] == dist[v] + 1:
                        ways[w] += ways[v]
            far = sum(dist.values())
            close[s] = (len(dist) - 1) / far if far else 0.0
            share = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in near[w]:
                    if dist[v] == dist[w] - 1:
                        share[v] += ways[v] / ways[w] * (1 + share[w])
                if w != s:
                    between[w] += share[w]
        return pd.DataFrame({"cluster": key[0], "node": nodes, "degree": [len(near[v]) for v in nodes], "closeness": [round(close[v], 6) for v in nodes], "betweenness": [round(between[v] / 2, 6) for v in nodes]})

    return e.groupBy("cluster").applyInPandas(run, "cluster int, node int, degree int, closeness double, betweenness double")


def temporal_centralities(e: DataFrame) -> DataFrame:
    """`step, node, degree, closeness, betweenness` with each cluster as a step of time, and the means over all steps (step null); a node without edges in a step counts 0."""
    c = centralities(e)
    steps, nodes = c.select(F.col("cluster").alias("step")).distinct(), c.select("node").distinct()  # clusters and nodes: tens each
    x = steps.join(F.broadcast(nodes)).join(c.withColumnRenamed("cluster", "step"), ["step", "node"], "left").na.fill(0, ["degree", "closeness", "betweenness"])
    names = ("degree", "closeness", "betweenness")
    over = x.groupBy("node").agg(*[F.round(F.avg(n), 6).alias(n) for n in names]).select(F.lit(None).cast("int").alias("step"), "node", *names)
    return x.select("step", "node", *[F.col(n).cast("double").alias(n) for n in names]).unionByName(over)


def transitions(assigned: DataFrame) -> DataFrame:
    """`cluster, first_idx, last_idx, n` of each subject's positions by cluster: the index sets as counts and bounds, never as lists."""
    return assigned.groupBy("subject_id", "cluster").agg(F.min("obs_idx").alias("first_idx"), F.max("obs_idx").alias("last_idx"), F.count(F.lit(1)).alias("n"))
