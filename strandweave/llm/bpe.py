"""Byte-level BPE encoding of whole corpora with a public vocabulary.

Pair occurrence index: the words that a batch meets for the first time lie in one linked list of
tokens; each adjacent pair maps to all its positions, and the pairs that the vocabulary can merge
are taken in ascending order of rank. Merging a pair touches its positions only, and enters the
pairs that arise around them. Words and pieces once encoded are remembered, within a bound.

Texts are cut before white space that follows other characters. No word reaches over such a place,
so lines, and the pieces between single blanks, encode alone and once. Where white space runs on, the
pieces that a word may reach over are joined, and these stretches encode alone and once likewise.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# How the public tokenizer cuts text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same over characters of which all letters and digits can be listed as a few ranges.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u04ff"
PLAIN = rf"[\t\n\r\x20-\x7e\xa1\xa7\xab\xb0\xb7\xbb\xbf{LETTERS}\xd7\xf7\u2010-\u2027]*"
PLAIN_WORDS = rf"""'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"""
FIRST = "\x00"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Index(dict):
    """Numbers strings in order of first sight and notes the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, k: str) -> int:
        self.new.append(k)
        self[k] = n = len(self)
        return n

    def taken(self) -> list[str]:
        new, self.new = self.new, []
        return new


def numbered(index: Index, strings: pa.Array) -> np.ndarray:
    """The numbers of strings, of which each different one is looked up once."""
    d = strings.dictionary_encode()
    return np.fromiter(map(index.__getitem__, d.dictionary.to_pylist()), np.int64, len(d.dictionary))[d.indices.to_numpy()]


def held(texts: pa.Array | list[str | None]) -> pa.Array:
    return pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")


class Rows:
    """Lists of ids of varying length in one array."""

    def __init__(self) -> None:
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])

    def shortened(self, n: int) -> None:
        self.flat = self.flat[: self.start[n] if n < len(self.start) else len(self.flat)]
        self.start, self.size = self.start[:n], self.size[:n]

    def joined(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows `at`, one after the other; where each begins, and the end)."""
        size = self.size[at]
        done = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=done[1:])
        return self.flat[np.repeat(self.start[at] - done[:-1], size) + np.arange(done[-1])], done


class Encoder:
    """Encodes texts by a vocabulary of token bytes and ranks, where the rank is the id.

    A text is looked up by the pieces between its blanks and line ends; each keeps the one before
    it. Pieces that words reach over, since white space runs on, are looked up as one. A text that holds
    the mark of first pieces is cut whole.
    """

    def __init__(self, ranks: dict[bytes, int], most_pieces: int = 500_000) -> None:
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.merge: dict[int, int] = {}
        self.most_pieces = most_pieces
        self.find, self.find_plain, self.plain = regex.compile(WORDS).findall, re.compile(PLAIN_WORDS).findall, re.compile(PLAIN).fullmatch
        self.forget()

    def forget(self) -> None:
        self.words, self.word_ids = Index(), Rows()
        self.pieces, self.piece_ids = Index(), Rows()
        self.begins, self.ends = np.zeros(0, bool), np.zeros(0, bool)

    def rank_of(self, key: int) -> int:
        """The rank of the merge of a pair of ids, -1 if there is none."""
        r = self.merge.get(key)
        if r is None:
            r = self.merge[key] = self.ranks.get(self.bytes_of[key >> 20] + self.bytes_of[key & 0xFFFFF], -1)
        return r

    def learn_words(self, words: list[str]) -> None:
        """Encode new words, all at once, by an index of the positions of each pair."""
        raw = [w.encode("utf-8", "replace") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        tok = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        n = len(tok)
        ends = np.cumsum(size)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[ends - 1], prv[ends - size] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[tuple[int, int]] = []

        def enter(keys: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(keys, kind="stable")
            keys, places = keys[order], places[order]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            at = [0, *cuts.tolist(), len(keys)]
            for k, i, j in zip(keys[at[:-1]].tolist(), at, at[1:]):
                held = index.get(k)
                if held is not None:
                    held.append(places[i:j])
                elif (r := self.rank_of(k)) >= 0:
                    index[k] = [places[i:j]]
                    heapq.heappush(heap, (r, k))

        i = np.flatnonzero(nxt >= 0)
        if len(i):
            enter(tok[i] << 20 | tok[i + 1], i)
        while heap:
            rank, key = heapq.heappop(heap)
            held = index.pop(key)
            a, b = key >> 20, key & 0xFFFFF
            i = held[0] if len(held) == 1 else np.concatenate(held)
            i = i[tok[i] == a]
            i = i[nxt[i] >= 0]
            i = i[tok[nxt[i]] == b]  # the others lost a side to an earlier merge
            if a == b and len(i):  # overlapping places merge from the left
                i, last, keep = np.unique(i), -1, []
                for p, q in zip(i.tolist(), nxt[i].tolist()):
                    if p != last:
                        keep.append(p)
                        last = q
                i = np.array(keep)
            if not len(i):
                continue
            j = nxt[i]
            after = nxt[j]
            tok[i], tok[j], nxt[i] = rank, -1, after
            has = after >= 0
            prv[after[has]] = i[has]
            before = prv[i]
            left = before[before >= 0]
            right = i[has]
            if len(left) or len(right):
                enter(np.concatenate([rank << 20 | tok[nxt[right]], tok[left] << 20 | rank]), np.concatenate([right, left]))
        live = tok >= 0
        self.word_ids.add(tok[live].astype(np.int32), np.add.reduceat(live, ends - size).astype(np.int64) if n else size)

    def cut_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words, where each text's begin, and the end)."""
        cut = [self.find_plain(t) if self.plain(t) else self.find(t) for t in texts]
        flat = [w for ws in cut for w in ws]
        at = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        if new := self.words.taken():
            self.learn_words(new)
        first = np.zeros(len(cut) + 1, np.int64)
        np.cumsum([len(ws) for ws in cut], out=first[1:])
        return at, first

    def encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's begin, and the end), each text by its words."""
        at, first = self.cut_words(texts)
        ids, done = self.word_ids.joined(at)
        return ids, done[first]

    def learn_pieces(self, pieces: list[str]) -> None:
        """Encode new pieces, and stretches of pieces with a blank between them; note whether white space after other white space would
        reach into them (they are blank or begin with two of it), and whether they end with it."""
        own, begins, ends = [], [], []
        for p in pieces:
            w = (p[1:] if p[0:1] == FIRST else p if p[0:1] == "\n" else " " + p).replace(" \n", "\n")
            own.append(w)
            bare = w.lstrip()
            begins.append(len(w) - len(bare) > 1 or (not bare and w != ""))
            ends.append(w[-1:].isspace())
        self.begins, self.ends = np.concatenate([self.begins, np.array(begins, bool)]), np.concatenate([self.ends, np.array(ends, bool)])
        ids, done = self.encode_words(own)
        self.piece_ids.add(ids, np.diff(done))

    def looked_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(numbers of the pieces, where each text's begin, and the end, texts that must be cut whole)."""
        if len(self.pieces) > self.most_pieces:
            self.forget()
        cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(FIRST, texts, ""), "\n", " \n"), " ")
        pieces, first = cut.flatten(), np.asarray(cut.offsets, np.int64)
        first = first - first[0]
        at = numbered(self.pieces, pieces)
        if new := self.pieces.taken():
            self.learn_pieces(new)
        # a run of white space gives all but its last character to one word: a piece joins the one before where the run goes on beyond its first
        joined = np.zeros(len(at), bool)
        joined[1:] = self.ends[at[:-1]] & self.begins[at[1:]]
        joined[first[:-1]] = False
        if joined.any():
            starts = np.flatnonzero(~joined)
            size = np.diff(starts, append=len(at))
            long = np.flatnonzero(size > 1)
            at, first, parts = at[starts], np.searchsorted(starts, first), pieces.take(pa.array(np.flatnonzero(np.repeat(size > 1, size)))).to_pylist()
            done = [0, *np.cumsum(size[long]).tolist()]
            at[long] = [self.pieces[" ".join(parts[i:j])] for i, j in zip(done, done[1:])]
            if new := self.pieces.taken():
                self.learn_pieces(new)
        return at, first, np.flatnonzero(pc.match_substring(texts, FIRST)).tolist()

    def counts(self, texts: pa.Array | list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        texts = held(texts)
        at, first, bad = self.looked_up(texts)
        done = np.zeros(len(at) + 1, np.int64)
        np.cumsum(self.piece_ids.size[at], out=done[1:])
        out = np.diff(done[first])
        if bad:
            at, first = self.cut_words([texts[i].as_py() for i in bad])
            done = np.zeros(len(at) + 1, np.int64)
            np.cumsum(self.word_ids.size[at], out=done[1:])
            out[bad] = np.diff(done[first])
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, offsets of each text); a null or empty text has none."""
        texts = held(texts)
        at, first, bad = self.looked_up(texts)
        known = len(self.piece_ids.size)
        if bad:
            ids, done = self.encode_words([texts[i].as_py() for i in bad])
            self.piece_ids.add(np.concatenate([ids, ids[:0]]), np.concatenate([np.diff(done), [0]]))
            for k, i in enumerate(bad):
                at[first[i] : first[i + 1]] = known + len(bad)
                at[first[i]] = known + k
        ids, done = self.piece_ids.joined(at)
        self.piece_ids.shortened(known)
        return ids, done[first]


_ENCODERS: dict[str, Encoder] = {}


def encoder(ranks, key: str) -> Encoder:  # noqa: ANN001
    """The worker's encoder; it outlives a task, with what it has learnt."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks.value)
    return _ENCODERS[key]


def portions(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text, so that very long texts don't add up."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    start = done = 0
    for i, n in enumerate(np.cumsum(lengths)):
        if n - done > most and i > start:
            yield start, i
            start, done = i, n - lengths[i]
    if start < len(lengths):
        yield start, len(lengths)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """`<key>, ids array<int>` of each row, without special tokens; null and empty texts give [].

    Rows are kept as they are, repeated keys too; other columns are ignored. Strings that name
    special tokens are ordinary text. The vocabulary, of fixed size, is read by the driver.
    """
    sc = docs.sparkSession.sparkContext
    ranks, kind = sc.broadcast(read_ranks(vocabulary)), docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks, vocabulary)
        for b in batches:
            for i, j in portions(b.column(1)):
                ids, offsets = enc.encode(b.column(1).slice(i, j - i))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], names=["key", "ids"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
