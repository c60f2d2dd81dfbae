"""Languages of documents and of their stretches.

Hierarchical discrimination: a sentence is first given to a language family, by one-versus-one
linear support vector machines between families, then to a language of that family, by one-versus-
one machines between its members. The machines see the words, their ends and their letter triples;
a word's share in all of them is computed once per worker, so a sentence costs a sum over its words.

Junk is a family of its own: the machines learn it from words that stand outside prose in the sampled
documents, from shuffled letters and from repetitions.

Training takes a bounded sample of labelled documents (`per_language` of each, by hash of the id) and of
their sentences (`per_label` of each language, by hash, from anywhere in the texts). Labels may be wrong:
a second fit leaves out the sentences that the first contradicts. Confidence is the chance of a right
label at a margin, fitted on sentences that the machines have not seen. Everything else covers every
document and its whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.bpe import Index, portions
from strandweave.llm.labels import language_of
from strandweave.llm.prose import WORD, sentences

# The languages by family.
FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "it", "pt"), "slavic": ("pl", "ru")}
NONE = "none"
SPACE = 1 << 16


def features(word: str) -> list[int]:
    w = f"<{word}>"
    parts = [w, "^" + word[:2], "$" + word[-2:], "$" + word[-3:], *(w[i : i + 3] for i in range(len(w) - 2))]
    return [zlib.crc32(p.encode("utf-8", "replace")) & (SPACE - 1) for p in parts]


class Words:
    """Feature lists of words, numbered in order of first sight."""

    def __init__(self) -> None:
        self.index = Index()
        self.flat, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new = [features(w) for w in self.index.taken()]
        if new:
            self.flat = np.concatenate([self.flat, np.array([x for f in new for x in f], np.int64)])
            self.size = np.concatenate([self.size, np.array([len(f) for f in new], np.int64)])
        return at


def fitted(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, steps: int = 60, c: float = 1e-4) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss (full gradients, adaptive steps)."""
    n = len(y)
    w, g2 = np.zeros(SPACE + 1), np.full(SPACE + 1, 1e-8)
    balance = np.where(y > 0, n / max(1, (y > 0).sum()), n / max(1, (y < 0).sum())) / 2
    for _ in range(steps):
        margin = np.bincount(rows, vals * w[cols], minlength=n) + w[-1]
        slack = np.maximum(0, 1 - y * margin) * y * balance / n
        g = c * w
        g -= np.bincount(cols, vals * slack[rows], minlength=SPACE + 1)
        g[-1] = -slack.sum()
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2)
    return w


class Model:
    per_family = 3600  #: sentences of a family that a machine between families sees at most

    def __init__(self, families: dict[str, tuple[str, ...]]) -> None:
        self.families = families
        self.langs = [x for m in families.values() for x in m]
        groups = list(families)
        self.pairs = [(("f", a), ("f", b)) for a, b in combinations(groups, 2)]
        for m in families.values():
            self.pairs += [(("l", a), ("l", b)) for a, b in combinations(m, 2)]
        self.family_of = {x: f for f, m in families.items() for x in m}
        self.weights = np.zeros((len(self.pairs), SPACE + 1))
        self.scale = (3.0, 0.0)

    def fit(self, texts: list[list[str]], labels: list[str], steps: int = 60) -> None:
        """texts: the words of each sentence."""
        words = Words()
        at = words.of([w for t in texts for w in t])
        rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        starts = np.cumsum(words.size) - words.size
        size = words.size[at]
        done = np.cumsum(size) - size
        cols = words.flat[np.repeat(starts[at] - done, size) + np.arange(size.sum())]
        frow = np.repeat(rows, size)
        vals = 1 / np.sqrt(np.maximum(1, np.bincount(frow, minlength=len(texts))))[frow]
        lab = np.array(labels)
        fam = np.array([self.family_of[x] for x in labels])
        for k, ((kind, a), (_, b)) in enumerate(self.pairs):
            of = fam if kind == "f" else lab
            use = (of == a) | (of == b)
            if kind == "f":  # families have several languages: their machines see every second or third sentence
                for x in (a, b):
                    own = np.flatnonzero(of == x)
                    if len(own) > self.per_family:
                        use[own] = np.arange(len(own)) % -(-len(own) // self.per_family) == 0
            if not (of[use] == a).any() or not (of[use] == b).any():
                self.weights[k, -1] = 1.0 if (of == a).any() else -1.0
                continue
            place = np.cumsum(use) - 1
            pick = use[frow]
            self.weights[k] = fitted(place[frow[pick]], cols[pick], vals[pick], np.where(of[use] == a, 1.0, -1.0), steps)

    def calibrate(self, margins: np.ndarray, right: np.ndarray) -> None:
        """Fit scale and shift of the logistic curve from margin to the chance of being right: penalised likelihood, by gradient steps with halving."""
        x = np.stack([margins, np.ones(len(margins))], 1)
        prior = np.array([3.0, 0.0])

        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((np.logaddexp(0, z) - right * z).mean() + 1e-3 * ((w - prior) ** 2).sum())

        w, rate = prior.copy(), 1.0
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - right) / len(x) + 2e-3 * (w - prior)
            while rate > 1e-9 and loss(w - rate * g) > loss(w):
                rate /= 2
            w, rate = w - rate * g, rate * 1.5
        self.scale = (max(0.1, float(w[0])), float(w[1]))


class Judge:
    """Applies a model; remembers each word's share in every machine, within a bound."""

    def __init__(self, model: Model, most_words: int = 300_000) -> None:
        self.m, self.most = model, most_words
        self.w = model.weights[:, :-1].T.astype(np.float32)
        self.forget()

    def forget(self) -> None:
        self.index = Index()
        self.score = np.zeros((0, len(self.m.pairs)), np.float32)
        self.size = np.zeros(0)

    def judged(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(language number, confidence) of each non-empty sentence."""
        lang, margin = self.margins(texts)
        a, b = self.m.scale
        return lang, 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))

    def margins(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.most:
            self.forget()
        flat = [w for t in texts for w in t]
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        new = self.index.taken()
        if new:
            f = [features(w) for w in new]
            size = np.array([len(x) for x in f])
            cols = np.array([c for x in f for c in x])
            self.score = np.concatenate([self.score, np.add.reduceat(self.w[cols], np.cumsum(size) - size, axis=0)])
            self.size = np.concatenate([self.size, size])
        n = np.array([len(t) for t in texts])
        starts = np.cumsum(n) - n
        s = np.add.reduceat(self.score[at], starts, axis=0) / np.sqrt(np.add.reduceat(self.size[at], starts))[:, None] + self.m.weights[:, -1]
        fam, sure = self.voted(s, "f", list(self.m.families))
        lang = np.zeros(len(texts), np.int64)
        for k, members in enumerate(self.m.families.values()):
            own = np.flatnonzero(fam == k)
            if len(own):
                best, conf = self.voted(s[own], "l", list(members))
                lang[own] = [self.m.langs.index(members[b]) for b in best]
                sure[own] = np.minimum(sure[own], conf)
        return lang, sure

    def voted(self, s: np.ndarray, kind: str, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(winner, its least margin) of the machines between the names; most votes, then the larger sum."""
        votes, total, least = (np.zeros((len(s), len(names))) for _ in range(3))
        least += 10.0
        for k, ((t, a), (_, b)) in enumerate(self.m.pairs):
            if t == kind and a in names and b in names:
                i, j = names.index(a), names.index(b)
                votes[:, i] += s[:, k] > 0
                votes[:, j] += s[:, k] <= 0
                total[:, i] += s[:, k]
                total[:, j] -= s[:, k]
                least[:, i] = np.minimum(least[:, i], s[:, k])
                least[:, j] = np.minimum(least[:, j], -s[:, k])
        best = (votes + 1e-3 * np.tanh(total)).argmax(1)
        return best, least[np.arange(len(s)), best]


def words_of(sentence: str) -> list[str]:
    return WORD.findall(sentence.lower())


def junk(outside: list[str], inside: list[str], n: int, seed: int = 3) -> list[list[str]]:
    """n made-up sentences that are no language: words from outside prose, shuffled letters, repetitions, random signs and letters."""
    rng = np.random.default_rng(seed)
    outside, inside = outside or inside, inside or outside
    signs = "".join(map(chr, range(33, 127)))
    letters = sorted({c for w in inside for c in w})
    pick = lambda pool, k: [pool[j] for j in rng.integers(0, len(pool), k)]
    out = []
    for i in range(n if outside else 0):
        size = int(rng.integers(3, 25))
        match i % 6:
            case 0 | 1:
                t = pick(outside, size)
            case 2:
                t = ["".join(np.array(list(w))[rng.permutation(len(w))]) for w in pick(inside, size)]
            case 3:
                t = pick(pick(outside, int(rng.integers(1, 4))), size)
            case 4:
                t = words_of("".join(pick(signs, int(rng.integers(20, 300)))))
            case _:
                few = pick(letters, int(rng.integers(4, 30)))
                t = ["".join(pick(few, int(rng.integers(1, 10)))) for _ in range(size)]
        out.append(t or pick(outside, size))
    return out


def trained(docs: DataFrame, aliases: DataFrame, per_language: int = 150, per_label: int = 2400, least_words: int = 5) -> Model:
    """A model from at most 2 x `per_language` labelled documents, and `per_label` sentences of them, of each language."""
    code = language_of("lang", aliases).alias("code")
    counts = {r["code"]: r["count"] for r in docs.where("doc_id is not null").select(code).groupBy("code").count().collect() if r["code"]}
    families = {f: tuple(x for x in m if x in counts) for f, m in FAMILIES.items() if any(x in counts for x in m)}
    if not families:
        return Model({})
    langs = [x for m in families.values() for x in m]
    share = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1.0, 1.5 * per_language / n)))])
    h = F.xxhash64(F.lit(17), F.col("doc_id"))
    u = F.pmod(h, F.lit(1 << 30)) / float(1 << 30)
    lab = docs.where("text is not null and text != ''").select("doc_id", code, "text", h.alias("h"), u.alias("u")).where(F.col("code").isin(langs))
    rows = lab.where(F.col("u") < share[F.col("code")]).orderBy("h", "doc_id").limit(2 * per_language * len(langs)).collect()
    taken: Counter = Counter()
    found: dict[str, list[tuple[int, list[str]]]] = {x: [] for x in langs}
    outside: list[str] = []
    for r in rows:
        taken[r["code"]] += 1
        if taken[r["code"]] > 2 * per_language:
            continue
        own = [w for w in map(words_of, sentences(r["text"])) if len(w) >= least_words]
        found[r["code"]] += [(zlib.crc32(f"{r['doc_id']} {i}".encode()), w) for i, w in enumerate(own)]
        rest = Counter(words_of(r["text"]))
        rest.subtract(w for t in own for w in t)
        outside += sorted(rest.elements())
    texts, labels, order = [], [], []
    for x in langs:
        for key, w in sorted(found[x])[:per_label]:
            texts.append(w)
            labels.append(x)
            order.append(key)
    if not texts:
        return Model({})
    bad = junk(outside, [w for t in texts[:: max(1, len(texts) // 20_000)] for w in t], len(texts) // len(langs))
    texts, labels, order = texts + bad, labels + [NONE] * len(bad), order + list(range(len(bad)))
    families = {**families, NONE: (NONE,)}
    held = np.array(order) % 5 == 0
    part = lambda use: ([t for t, y in zip(texts, use) if y], [x for x, y in zip(labels, use) if y])
    first = Model(families)
    first.fit(*part(~held & (np.array(order) % 2 == 0)))
    lang, _ = Judge(first).judged(texts)
    agree = np.array([first.langs[k] == x for k, x in zip(lang, labels)])
    model = Model(families)
    model.fit(*part(agree & ~held))
    if held.any():
        t, x = part(held)
        lang, margin = Judge(model).margins(t)
        model.calibrate(margin, np.array([model.langs[k] == y for k, y in zip(lang, x)], float))
    return model


_JUDGES: dict[int, Judge] = {}


def languages(docs: DataFrame, model: Model, least_words: int = 3) -> DataFrame:
    """`doc_id, lang, main_lang, confidence, n_words, langs, lang_words, seg_langs, seg_words, seg_confidence` of each row.

    `n_words` counts the words of prose in sentences of at least `least_words` words that a language
    claims; what the machines give to no language is junk. `main_lang` has more than half of these words, else it is null.
    `confidence` is the share-weighted confidence of the main language's sentences. The seg_ arrays
    hold the stretches of sentences in one language, in order. `lang` is passed on.

    Defined cases: null, empty and proseless texts have 0 words, null main language and confidence,
    and empty arrays; repeated rows come out repeatedly; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of fixed size
    names = ["doc_id", "lang", "main_lang", "confidence", "n_words", "langs", "lang_words", "seg_langs", "seg_words", "seg_confidence"]

    def of(n_docs: int, doc: list[int], n: list[int], lang: np.ndarray, conf: np.ndarray) -> list[list]:
        segs: list[list[list]] = [[] for _ in range(n_docs)]
        tags = shared.value.langs
        for i, words, k, c in zip(doc, n, lang.tolist(), conf.tolist()):
            if tags[k] != NONE:
                s = segs[i]
                if s and s[-1][0] == k:
                    s[-1][1] += words
                    s[-1][2] += words * c
                else:
                    s.append([k, words, words * c])
        cols: list[list] = [[] for _ in range(8)]
        for s in segs:
            total: dict[int, int] = {}
            for k, words, _ in s:
                total[k] = total.get(k, 0) + words
            all_ = sum(total.values())
            main = next((k for k, w in total.items() if 2 * w > all_), None)
            sure = None if main is None else round(sum(c for k, _, c in s if k == main) / all_, 6)
            order = sorted(total, key=lambda k: (-total[k], k))
            for c, v in zip(cols, (None if main is None else tags[main], sure, all_, [tags[k] for k in order], [total[k] for k in order], [tags[k] for k, _, _ in s], [w for _, w, _ in s], [round(c / w, 6) for _, w, c in s])):
                c.append(v)
        return cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        judge = _JUDGES.get(id(m))
        if judge is None:
            _JUDGES.clear()
            judge = _JUDGES[id(m)] = Judge(m)
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.float64())]
        for b in batches:
            for i, j in portions(b.column(2)):
                doc, texts = [], []
                for k, t in enumerate(b.column(2).slice(i, j - i).to_pylist()):
                    for s in sentences(t) if t else ():
                        w = words_of(s)
                        if len(w) >= least_words:
                            doc.append(k)
                            texts.append(w)
                lang, conf = judge.judged(texts) if texts and m.langs else (np.zeros(0, np.int64), np.zeros(0))
                cols = of(j - i, doc if len(lang) else [], [len(w) for w in texts], lang, conf)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=names)

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {key}, lang string, main_lang string, confidence double, n_words long, langs array<string>, lang_words array<long>, seg_langs array<string>, seg_words array<long>, seg_confidence array<double>")


def label_faults(judged: DataFrame, aliases: DataFrame, least_prose: int = 20, least_other: int = 10) -> DataFrame:
    """`doc_id, kind, lang`: labels `missing` or `wrong`, and the other languages of `mixed` documents."""
    j = judged.where((F.col("n_words") >= least_prose) & F.col("main_lang").isNotNull()).withColumn("code", language_of("lang", aliases))
    label = F.when(F.col("code").isNull(), F.struct(F.lit("missing").alias("kind"), F.col("main_lang").alias("lang"))).when(
        F.col("code") != F.col("main_lang"), F.struct(F.lit("wrong").alias("kind"), F.col("main_lang").alias("lang")))
    other = F.transform(
        F.filter(F.arrays_zip("langs", "lang_words"), lambda x: (x["lang_words"] >= least_other) & (x["langs"] != F.col("main_lang"))),
        lambda x: F.struct(F.lit("mixed").alias("kind"), x["langs"].alias("lang")))
    return j.select("doc_id", F.explode(F.filter(F.concat(F.array(label), other), lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.kind", "x.lang")
