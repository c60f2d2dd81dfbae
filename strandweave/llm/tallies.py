"""Languages of documents from counts over all labelled documents.

A word counts as itself and its letter triples, hashed. One pass over the texts counts them for each label
in the sentences, and once more in everything that stands outside sentences; counts of fixed size are
added up exactly, so the result depends on the documents alone, not on how they are spread over tasks.
A sentence belongs to the language under whose counts its words are likeliest, or to none if they are likelier
in what stands outside sentences or among arbitrary letters. Wrong labels blunt the counts but seldom
turn the comparison, as long as most labels of a language are right.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.bpe import Index, Rows, numbered, portions
from strandweave.llm.labels import language_of
from strandweave.llm.language import NONE, SPACE, words_of
from strandweave.llm.prose import sentences

# Odd multipliers of the hashes.
MIX, POWER, FIRST, SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x100000001B3, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features of the words, one after the other; number of each): the word and its letter triples, its ends marked."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(starts, size)
    powers = np.multiply.accumulate(np.full(size.max(), POWER))
    out = np.empty_like(codes)  # a word of n letters has n triples, n + 2 places: whole word first, then triples, the last place unused
    out[starts] = np.add.reduceat(codes * powers[place], starts) + SECOND
    at = np.flatnonzero(place < np.repeat(size - 2, size))
    out[at + 1] = codes[at] * FIRST + codes[at + 1] * SECOND + codes[at + 2] * POWER
    used = place < np.repeat(size - 1, size)
    mixed = out[used] * MIX
    return ((mixed ^ mixed >> np.uint64(29)) * FIRST >> np.uint64(48)).astype(np.int64), size - 1


def split(texts: pa.Array) -> pa.Array:
    """The pieces between white space of each text, as `str.split` cuts them; of a blank text one that is empty."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))


class Prose:
    """Texts as numbered words; pieces between white space once cut are remembered, within a bound."""

    def __init__(self, most_pieces: int = 400_000) -> None:
        self.most_pieces = most_pieces
        self.forget()

    def forget(self) -> None:
        self.pieces, self.words, self.words_of = Index(), Index(), Rows()

    def learnt(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        """Of new words, and of new pieces the numbers of their words."""

    def looked_up(self, pieces: pa.Array) -> np.ndarray:
        at = numbered(self.pieces, pieces)
        if new := self.pieces.taken():
            cut = [words_of(p) for p in new]
            flat = np.fromiter(map(self.words.__getitem__, [w for ws in cut for w in ws]), np.int32)
            size = np.fromiter(map(len, cut), np.int64, len(cut))
            self.words_of.add(flat, size)
            self.learnt(self.words.taken(), flat, size)
        return at

    def spoken(self, texts: list[str | None], least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text and words of each sentence of at least so many words; sentence and number of each of their pieces)."""
        said: list[str] = []
        many = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            if t:
                s = sentences(t)
                said += s
                many[k] = len(s)
        cut = split(pa.array(said, pa.string()))
        doc, ends = np.repeat(np.arange(len(texts)), many), np.asarray(cut.offsets, np.int64)
        at = self.looked_up(cut.flatten())
        done = np.concatenate([[0], np.cumsum(self.words_of.size[at])])
        n = np.diff(done[ends])
        use = n >= least_words
        keep = np.repeat(use, np.diff(ends))
        of = np.repeat(np.cumsum(use) - 1, np.diff(ends))[keep]
        return doc[use], n[use], of, at[keep]


@dataclass
class Tallies:
    """Languages with their counts of features, and those of what stands outside sentences last."""

    langs: list[str]
    counts: np.ndarray

    def weights(self, least: float = 0.5) -> np.ndarray:
        """Logarithms of the chances of each feature in each language, and in none last."""
        x = self.counts.astype(float)
        p = (x + least) / (x.sum(0) + least * SPACE)
        p[:, -1] = p[:, -1] / 2 + 0.5 / SPACE
        return np.log(p).astype(np.float32)


class Speaker(Prose):
    """The languages of sentences, by tallies, and classes of their words."""

    def __init__(self, langs: list[str], weights: np.ndarray, dims: int, most_pieces: int = 400_000) -> None:
        self.langs, self.weights, self.dims = langs, weights, dims
        super().__init__(most_pieces)

    def forget(self) -> None:
        super().forget()
        self.word_score = self.score = np.zeros((0, self.weights.shape[1]), np.float32)
        self.dim = np.zeros(0, np.int64)

    def learnt(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        if words:
            cols, n = features(words)
            starts = np.cumsum(n) - n
            self.word_score = np.concatenate([self.word_score, np.add.reduceat(self.weights[cols], starts, axis=0)])
            self.dim = np.concatenate([self.dim, cols[starts] % self.dims])
        own = np.zeros((len(size), self.weights.shape[1]), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            own[some] = np.add.reduceat(self.word_score[flat], (np.cumsum(size) - size)[some], axis=0)
        self.score = np.concatenate([self.score, own])

    def described(self, texts: list[str | None], least_words: int = 3) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language with most words of prose of each text, `und` where none claims any; offsets of the texts in what follows;
        classes of the words of that language's sentences, ascending; how often each occurs)."""
        if len(self.pieces) > self.most_pieces:
            self.forget()
        doc, n, of, at = self.spoken(texts, least_words) if self.langs else (np.zeros(0, np.int64),) * 4
        if not len(doc):
            return ["und"] * len(texts), np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.uint32)
        k = len(self.langs)
        lang = np.add.reduceat(self.score[at], np.searchsorted(of, np.arange(len(doc))), axis=0).argmax(1)
        words = np.bincount(doc * (k + 1) + lang, n, minlength=len(texts) * (k + 1)).reshape(-1, k + 1)[:, :k]
        best = np.where(words.max(1) > 0, words.argmax(1), -1)
        keep = (lang == best[doc])[of]
        at, of = at[keep], of[keep]
        flat, _ = self.words_of.joined(at)
        cells = np.bincount(np.repeat(doc[of], self.words_of.size[at]) * self.dims + self.dim[flat], minlength=len(texts) * self.dims)
        held = np.flatnonzero(cells)
        offsets = np.searchsorted(held, np.arange(len(texts) + 1) * self.dims)
        return [self.langs[i] if i >= 0 else "und" for i in best.tolist()], offsets, (held % self.dims).astype(np.uint16), cells[held].astype(np.uint32)


def summed(df: DataFrame, few: bool = False) -> dict[int, np.ndarray]:
    """The sums of whole numbers `v` (64 bits each, packed) of each `k`, added up in tasks: one row of each comes to the driver; of a few tasks, what each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(v.as_buffer(), np.int64)
                total[k] = total[k] + v if k in total else v
        yield packed(total)

    out: dict[int, np.ndarray] = {}
    for k, v in (df if few else df.repartition("k").mapInArrow(run, "k int, v binary")).collect():
        v = np.frombuffer(v, np.int64)
        out[k] = out[k] + v if k in out else v
    return out


def packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.ascontiguousarray(v, np.int64).tobytes() for v in total.values()], pa.binary())], names=["k", "v"])


class Tally(Prose):
    """Counts of words by label; what a word gives to the features is worked out once."""

    def __init__(self, labels: int, most_pieces: int = 400_000) -> None:
        self.total = np.zeros((labels, SPACE), np.int64)
        super().__init__(most_pieces)

    def forget(self) -> None:
        super().forget()
        self.n = np.zeros((len(self.total), 0), np.int64)

    def add(self, at: np.ndarray, label: np.ndarray) -> None:
        """Pieces `at`, each of a label."""
        k = len(self.total)
        times = np.bincount(label * len(self.pieces) + at, minlength=k * len(self.pieces))
        held = np.flatnonzero(times)
        self.add_times(held % len(self.pieces), held // len(self.pieces), times[held])

    def add_times(self, at: np.ndarray, label: np.ndarray, times: np.ndarray) -> None:
        flat, _ = self.words_of.joined(at)
        known, k = len(self.words), len(self.total)
        self.n = np.concatenate([self.n, np.zeros((k, known - self.n.shape[1]), np.int64)], 1)
        size = self.words_of.size[at]
        self.n += np.bincount(np.repeat(label, size) * known + flat, np.repeat(times, size), minlength=k * known).astype(np.int64).reshape(k, known)  # exact: a portion has far less than 2^53

    def flushed(self) -> None:
        cols, size = features(list(self.words)[: self.n.shape[1]])
        for total, n in zip(self.total, self.n):
            if n.any():
                total += np.bincount(cols, np.repeat(n, size), minlength=SPACE).astype(np.int64)
        self.forget()


def tallied(docs: DataFrame, aliases: DataFrame, least_words: int = 5) -> Tallies:
    """From all documents (`lang, text`) whose label names a language of the aliases; sentences of at least `least_words` words count."""
    langs = sorted({r["lang_code"] for r in aliases.select("lang_code").distinct().collect() if r["lang_code"]})
    code = F.array_position(F.array(*map(F.lit, langs)), language_of("lang", aliases)).cast("int") if langs else F.lit(None).cast("int")
    known = docs.where("text is not null and text != ''").select(code.alias("code"), F.col("text").cast("string").alias("text")).where("code > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(len(langs) + 1)
        for b in batches:
            for i, j in portions(b.column(1)):
                if len(tally.pieces) > tally.most_pieces:
                    tally.flushed()
                label = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64) - 1
                texts = b.column(1).slice(i, j - i)
                doc, _, of, at = tally.spoken(texts.to_pylist(), least_words)
                tally.add(at, label[doc[of]])
                once = pc.value_counts(split(texts).flatten())
                at = tally.looked_up(once.field("values"))
                tally.add_times(at, np.full(len(at), len(langs)), once.field("counts").to_numpy())  # whole texts: what stands in sentences is taken off in the end
        tally.flushed()
        yield packed({k: v for k, v in enumerate(tally.total) if v.any()})

    sums = summed(known.mapInArrow(run, "k int, v binary"))
    counts = np.stack([sums.get(k, np.zeros(SPACE, np.int64)) for k in range(len(langs) + 1)], 1)
    counts[:, -1] = np.maximum(counts[:, -1] - counts[:, :-1].sum(1), 0)
    has = np.flatnonzero(counts[:, :-1].any(0))
    return Tallies([langs[k] for k in has], counts[:, [*has, len(langs)]])
