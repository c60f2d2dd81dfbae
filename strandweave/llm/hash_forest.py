"""Hash-prefix forest: sorted arrays of long hash strings, one per tree.

Each tree gives a vector a string of 63 bits. The leading bits tell on which side of random
hyperplanes it lies, which are drawn from the spread of the data and set at gaps between samples;
the trailing bits quantise random projections ever more finely, so that close vectors too end up
with different strings. Sorted by string, all vectors with a common prefix are one stretch.

A query descends to its longest prefix and ascends to the shortest stretch that holds at least
`least` vectors. The trees are passed one after the other with what the query knows so far, so all
ascend to the same size, and a later tree adds only what is nearer than the k-th so far. Vectors of
one stretch are answered together as a matrix product.

How it scales: rows go to partitions by the range of their string, cut at quantiles of the strings of
the sample, so partitions stay even whatever the data's clusters; a task holds about two buffers of
rows. A run of equal strings longer than that is searched in portions; other trees bring its parts
together. Work per vector is bounded by trees x leaf, not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

COARSE, BITS = 28, 63


def fitted_trees(sample: np.ndarray, trees: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(directions, offsets, fine directions, fine widths) of each tree, from a bounded sample."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    centred = sample - sample.mean(0) if len(sample) else np.eye(dims)
    out = []
    for _ in range(trees):
        r = rng.normal(size=(COARSE, len(centred))) @ centred + 1e-9 * rng.normal(size=(COARSE, dims))
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        proj = np.sort((sample if len(sample) else centred) @ r.T, axis=0)
        lo, hi = int(0.3 * len(proj)), max(int(0.7 * len(proj)), int(0.3 * len(proj)) + 1)
        cut = np.empty(COARSE)
        for j in range(COARSE):
            p = proj[lo : hi + 1, j]
            k = int(np.argmax(np.diff(p))) if len(p) > 1 else 0
            cut[j] = p[k : k + 2].mean()
        fine = rng.normal(size=(BITS - COARSE, dims))
        widths = 2.0 * 0.75 ** np.arange(BITS - COARSE)
        out.append((r, cut, fine / np.linalg.norm(fine, axis=1, keepdims=True), widths))
    return out


def hash_strings(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The hash string of each row as a non-negative integer that sorts like the string."""
    r, cut, fine, widths = tree
    bits = np.hstack([x @ r.T > cut, np.floor(x @ fine.T / widths).astype(np.int64) & 1 > 0])
    return bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def cuts(sample: np.ndarray, tree: tuple, parts: int) -> np.ndarray:
    """Strings that cut the sample into `parts` even ranges."""
    h = np.sort(hash_strings(sample, tree)) if len(sample) else np.zeros(0, np.int64)
    return h[(np.arange(1, parts) * len(h)) // parts] if len(h) else h


def stretches(h: np.ndarray, leaf: int, least: int) -> list[tuple[int, int, int, int]]:
    """(first, end) of queries and (first, end) of their candidates in a sorted array of strings."""
    out, todo = [], [(0, len(h), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= leaf or depth == BITS:
            if b > a:
                out.append((a, b, a, b))
            continue
        bit = 1 << (BITS - 1 - depth)
        mid = a + int(np.searchsorted(h[a:b] & bit, bit))
        for c, d in ((a, mid), (mid, b)):
            if d - c >= least:
                todo.append((c, d, depth + 1))
            elif d > c:
                out.append((c, d, a, b))
    return out


def buffered(batches: Iterator, columns: Callable, buffer: int) -> Iterator[tuple]:
    """Arrays in order of the strings (the first), of about `buffer` rows; cut where strings differ most early, equal ones at the buffer's end."""
    held: list[tuple] = []
    rows = 0

    def joined() -> tuple:
        return held[0] if len(held) == 1 else tuple(np.concatenate(p) for p in zip(*held))

    for batch in batches:
        held.append(columns(batch))
        rows += len(held[-1][0])
        while rows >= 2 * buffer:
            all_ = joined()
            h = all_[0]
            gaps = h[buffer // 2 + 1 :] ^ h[buffer // 2 : -1]
            end = buffer // 2 + 1 + int(np.argmax(gaps)) if gaps.any() else buffer
            yield tuple(p[:end] for p in all_)
            held, rows = [tuple(p[end:] for p in all_)], rows - end
    if rows:
        yield joined()
