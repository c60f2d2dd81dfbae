"""Topics of documents: clusters of the words that their prose uses.

Words are hashed into a vector of logarithmic counts; the mean of the document's language is taken off,
so that clusters do not merely repeat the languages, and what is left is compared by its direction.
Means and centres are those of all documents: spherical k-means whose rounds pass over the packed
vectors of all of them, and of which only sums of fixed size come to the driver. For the rounds, the
vectors of many documents are written as one row: Spark then hands on bytes, not a row per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.bpe import VOCABULARY, encoder, portions, read_ranks
from strandweave.llm.tallies import Speaker, Tallies, packed, summed
from strandweave.runtime import scratch

DIMS = 1024
PER_TASK = 40_000  # documents of a task in a pass, at least
PER_BLOCK = 500  # documents at once
ONE = 2.0**30  # sums are of whole parts
_SPEAKERS: dict[int, tuple[object, Speaker]] = {}


def described(docs: DataFrame, tallies: Tallies, vocabulary: str = VOCABULARY) -> DataFrame:
    """`doc_id, source, lang_code, n_tokens, dims, counts` of documents `doc_id, source, text`, which pass once; `dims` (16 bits each)
    are the classes of words that the prose in the main language uses and `counts` (32 bits each) how often. Without prose the language is `und`."""
    sc = docs.sparkSession.sparkContext
    ranks, shared = sc.broadcast(read_ranks(vocabulary)), sc.broadcast((tallies.langs, tallies.weights()))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        if id(model) not in _SPEAKERS:
            _SPEAKERS.clear()
            _SPEAKERS[id(model)] = (model, Speaker(*model, DIMS))
        speaker, enc = _SPEAKERS[id(model)][1], encoder(ranks, vocabulary)
        for b in batches:
            for i, j in portions(b.column(2)):
                texts = b.column(2).slice(i, j - i)
                names, at, dims, counts = speaker.described(texts.to_pylist())
                pack = lambda x, size: pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(x)])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(names, pa.string()), pa.array(enc.counts(texts)), pack(dims, 2), pack(counts, 4)],
                    names=["doc_id", "source", "lang_code", "n_tokens", "dims", "counts"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {key}, source string, lang_code string, n_tokens long, dims binary, counts binary")


@dataclass
class Vectors:
    """Rows of logarithmic counts of a portion of documents, and their languages; all have a value."""

    logs: np.ndarray
    lang: np.ndarray


_LOGS = np.log1p(np.arange(4096)).astype(np.float32)


Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def parts(langs: list[str], lang: pa.Array, dims: pa.Array, counts: pa.Array) -> Iterator[Part]:
    """Portions of documents: numbers of their languages, where the classes of each begin, and the end, the classes, their counts."""
    lang = np.asarray(pc.index_in(lang, pa.array(langs, lang.type)).to_numpy(zero_copy_only=False), np.int64)
    for i in range(0, len(lang), PER_BLOCK):
        yield lang[i : i + PER_BLOCK], *flat(dims.slice(i, PER_BLOCK), np.uint16), flat(counts.slice(i, PER_BLOCK), np.uint32)[1]


#: Of each array of a portion: its column in a block, how its numbers are packed; counts take 8 bits where they all fit.
BLOCK = {"lang": np.int16, "at": np.int32, "dims": np.uint16, "counts": np.uint32}


def blocks(spoken: DataFrame, langs: list[str]) -> DataFrame:
    """A row for each portion of rows `lang_code, dims, counts`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in parts(langs, *b.columns):
                kinds = BLOCK | ({"counts": np.uint8} if p[3].max(initial=0) < 256 else {})
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(p, kinds.values())], names=list(BLOCK))

    return spoken.mapInArrow(run, ", ".join(f"{x} binary" for x in BLOCK))


def unpacked(blocks: pa.RecordBatch) -> Iterator[Part]:
    for row in zip(*blocks.columns):
        lang, at, dim, count = (x.as_buffer() for x in row)
        yield (np.frombuffer(lang, np.int16).astype(np.int64), np.frombuffer(at, np.int32), np.frombuffer(dim, np.uint16),
               np.frombuffer(count, np.uint8 if 2 * count.size == dim.size else np.uint32))


def vectors(portions: Iterator[Part]) -> Iterator[Vectors]:
    """Vectors of portions of documents, each in the place of the one before."""
    place = np.zeros(PER_BLOCK * DIMS, np.float32)
    for lang, at, dim, count in portions:
        n = len(lang)
        held = np.repeat(np.arange(n) * DIMS, np.diff(at)) + dim
        place[held] = _LOGS[count] if count.max(initial=0) < len(_LOGS) else np.log1p(count)
        yield Vectors(place[: n * DIMS].reshape(n, DIMS), lang)
        place[held] = 0


def rows(langs: list[str], lang: pa.Array, dims: pa.Array, counts: pa.Array) -> Iterator[Vectors]:
    return vectors(parts(langs, lang, dims, counts))


def flat(packed: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(where the numbers of each row begin, and the end; the numbers) of rows of packed numbers."""
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1]
    size = np.dtype(kind).itemsize
    return (at - at[0]) // size, np.frombuffer(data[int(at[0]) : int(at[-1])], kind) if at[-1] > at[0] else np.zeros(0, kind)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-12)


@dataclass
class Topics:
    langs: list[str]
    means: np.ndarray
    centres: np.ndarray

    @classmethod
    def fitted(cls, docs: DataFrame, k: int = 12, rounds: int = 25, seed: int = 9, least_gain: float = 1e-4) -> Topics:
        """From all documents (as `described`) that have a language.

        The first centres are the documents with the smallest hashes of their ids; rounds end when the mean cosine
        gains less than `least_gain` of itself. A centre that no document is nearest to stays.
        """
        spoken = docs.where("length(dims) > 0").select("lang_code", "dims", "counts")
        tasks = max(1, -(-docs.count() // PER_TASK))
        few, spoken = tasks <= 8, spoken.coalesce(tasks)  # the start of a task costs more than a pass over a few documents
        langs = sorted(r["lang_code"] for r in spoken.select("lang_code").distinct().collect())
        out = cls(langs, np.zeros((len(langs), DIMS)), np.zeros((0, DIMS)))
        if not langs:
            return out

        def counted(v: Vectors) -> dict[int, np.ndarray]:
            return {0: np.rint((of_each(v.lang, len(langs)) @ v.logs) * ONE).astype(np.int64).ravel()}

        with scratch(blocks(spoken, langs)) as held:
            held = held.coalesce(tasks)
            out.means = unit(passed(held, langs, counted, few)[0].reshape(-1, DIMS).astype(float))
            first = docs.where("length(dims) > 0").orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").select("lang_code", "dims", "counts").limit(k).collect()
            v = next(rows(langs, *(pa.array([x if isinstance(x, str) else bytes(x) for x in c]) for c in zip(*first))))
            out.centres = unit(unit(v.logs) - out.means[v.lang])
            was = 0.0
            for _ in range(rounds):
                sums = passed(held, langs, out.sums, few)
                total = sums[1].reshape(-1, DIMS) / ONE
                out = cls(langs, out.means, np.where(total.any(1)[:, None], unit(total), out.centres))
                now = sums[0][0] / sums[0][1]
                if now - was <= least_gain * now:
                    break
                was = now
        return out

    def nearest(self, v: Vectors) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nearest centre of the direction of each row of unit length less its language's mean, cosine, what makes the row and the mean that direction)."""
        k = len(self.centres)
        size = 1 / np.sqrt(np.einsum("ij,ij->i", v.logs, v.logs).astype(float))
        near = (v.logs @ np.concatenate([self.centres, self.means]).astype(np.float32).T) * size[:, None]
        mean = near[np.arange(len(near)), k + v.lang]
        length = np.sqrt(np.maximum(2 - 2 * mean, 0))  # both are of length 1
        inverse = np.divide(1.0, length, out=np.zeros_like(length), where=length > 1e-3)
        cosine = (near[:, :k] - (self.means @ self.centres.T)[v.lang]) * inverse[:, None]
        best = cosine.argmax(1)
        return best, cosine[np.arange(len(best)), best], size * inverse, inverse

    def sums(self, v: Vectors) -> dict[int, np.ndarray]:
        """0: sum of cosines and number of rows; 1: sums of the directions nearest to each centre."""
        best, cosine, scale, inverse = self.nearest(v)
        k, n = len(self.centres), len(self.langs)
        total = of_each(best, k, scale) @ v.logs - np.bincount(best * n + v.lang, inverse, minlength=k * n).reshape(k, n) @ self.means
        return {0: np.array([round(cosine.sum() * ONE), round(len(best) * ONE)]), 1: np.rint(total * ONE).astype(np.int64).ravel()}

    def labelled(self, docs: DataFrame) -> DataFrame:
        """`doc_id, source, lang_code, topic, n_tokens` of documents as `described`; without prose the topic is `none`."""
        shared = docs.sparkSession.sparkContext.broadcast(self)  # of fixed size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            topics = shared.value
            for b in batches:
                best = [topics.nearest(v)[0] for v in rows(topics.langs, *(c.filter(pc.greater(pc.binary_length(b.column(4)), 0)) for c in (b.column(2), b.column(4), b.column(5))))]
                names = np.full(b.num_rows, "none", object)
                names[np.asarray(pc.binary_length(b.column(4))) > 0] = [f"topic-{x:02d}" for y in best for x in y.tolist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(names, pa.string()), b.column(3)], names=["doc_id", "source", "lang_code", "topic", "n_tokens"])

        key = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "source", "lang_code", "n_tokens", "dims", "counts").mapInArrow(
            run, f"doc_id {key}, source string, lang_code string, topic string, n_tokens long")


def of_each(group: np.ndarray, n: int, weight: np.ndarray | float = 1.0) -> np.ndarray:
    """The matrix that sums rows by group."""
    out = np.zeros((n, len(group)), np.float32)
    out[group, np.arange(len(group))] = weight
    return out


def passed(spoken: DataFrame, langs: list[str], sums: Callable[[Vectors], dict[int, np.ndarray]], few: bool) -> dict[int, np.ndarray]:
    """Sums over all rows `lang_code, dims, counts`, or blocks of them, which go through in portions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for v in vectors(unpacked(b)) if b.schema.names == list(BLOCK) else rows(langs, *b.columns):
                for k, x in sums(v).items():
                    total[k] = total[k] + x if k in total else x
        yield packed(total)

    return summed(spoken.mapInArrow(run, "k int, v binary"), few)
