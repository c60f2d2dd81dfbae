"""The models of the mix come from all documents: a sample of 300 or 800 of these would not give the same sums."""

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import bpe, topics
from strandweave.llm.language import SPACE, words_of
from strandweave.llm.prose import sentences
from strandweave.llm.tallies import Tally, features, split, tallied
from strandweave.llm.topics import DIMS, Topics, described, flat

EN, DE = "the old bridge number {} stands on the left bank of the quiet river. ", "die alte Brücke Nummer {} steht am linken Ufer des stillen Flusses. "


@pytest.fixture(scope="module")
def texts(spark):
    letters = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(1500)]
    rows = [(i, "a", "en" if i % 3 else "de", (EN if i % 3 else DE).format(w) * (1 + i % 2) + f"\n| cell {w}") for i, w in enumerate(letters)] + [(9001, "a", None, EN), (9002, "a", "en", None)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, lang string, text string"), spark.createDataFrame([("en", "en"), ("de", "de"), ("fr", "fr")], "alias string, lang_code string")


def test_languages_are_counted_over_all_labelled_documents(texts):
    rows, docs, aliases = texts
    t = tallied(docs, aliases)
    want = np.zeros((3, SPACE), np.int64)
    for _, _, lang, text in rows:
        if lang and text:
            for k, words in ((("de", "en").index(lang), [w for s in sentences(text) for w in words_of(s)]), (2, ["cell", words_of(text)[-1]])):
                want[k] += np.bincount(features(words)[0], minlength=SPACE)
    assert t.langs == ["de", "en"] and np.array_equal(t.counts.T[:2], want[:2])
    assert t.counts[:, 2].sum() == want[2].sum()
    assert np.array_equal(t.counts, tallied(docs.repartition(7), aliases).counts)


def test_topics_are_fitted_to_all_documents(texts):
    rows, docs, aliases = texts
    d = described(docs, tallied(docs, aliases)).cache()
    got = {r.doc_id: r for r in d.collect()}
    assert got[9001].lang_code == "en" and got[9002].lang_code == "und" and got[9002].n_tokens == 0 and got[0].lang_code == "de"
    fit = Topics.fitted(d, k=4)
    for k, lang in enumerate(fit.langs):
        own = [r for r in got.values() if r.lang_code == lang]
        total = np.zeros(DIMS)
        for r in own:
            total[flat(pa.array([bytes(r.dims)]), np.uint16)[1]] += np.log1p(flat(pa.array([bytes(r.counts)]), np.uint32)[1])
        assert len(own) >= 500 and fit.means[k] == pytest.approx(total / np.linalg.norm(total), abs=1e-5)
    named = fit.labelled(d).collect()
    assert {r.topic for r in named if r.lang_code == "und"} == {"none"} and 1 < len({r.topic for r in named if r.lang_code != "und"}) <= 4
    assert not len(Topics.fitted(d.limit(0)).centres) and Topics.fitted(d.limit(0)).labelled(d.limit(0)).count() == 0


def test_token_numbers_without_ids():
    enc = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    odd = ["", None, "a\n\n\nb", "a  b", "some words here", "\x00 a\x00b", "x\r\ry   z", " "]
    assert enc.counts(odd).tolist() == np.diff(enc.encode(odd)[1]).tolist()


def test_passes_over_few_documents_take_few_tasks(texts, monkeypatch):
    _, docs, aliases = texts
    sc = docs.sparkSession.sparkContext
    d = described(docs, tallied(docs, aliases)).repartition(12, "doc_id").cache()
    d.count()
    tasks = []
    for per_task in (topics.PER_TASK, 100):
        monkeypatch.setattr(topics, "PER_TASK", per_task)
        sc.setJobGroup(f"topics {per_task}", "")
        fit = Topics.fitted(d, k=4, rounds=3)
        stages = [sc.statusTracker().getStageInfo(k) for j in sc.statusTracker().getJobIdsForGroup(f"topics {per_task}") for k in sc.statusTracker().getJobInfo(j).stageIds]
        tasks.append(sum(x.numTasks for x in stages if x))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < tasks[0] < tasks[1]
    spoken = d.where("length(dims) > 0").select("lang_code", "dims", "counts")
    a, b = topics.passed(spoken.coalesce(2), fit.langs, fit.sums, True), topics.passed(spoken, fit.langs, fit.sums, False)
    assert a[0][1] == b[0][1] == 1501 * topics.ONE and a[0][0] == pytest.approx(b[0][0], rel=1e-5)
    # documents as near to one centre as to another may change sides with rounding; all together they don't
    assert a[1].reshape(4, -1).sum(0) / topics.ONE == pytest.approx(b[1].reshape(4, -1).sum(0) / topics.ONE, abs=1e-2)


def test_white_space_that_runs_on_needs_no_text_cut_whole():
    enc = bpe.Encoder(bpe.read_ranks(bpe.VOCABULARY))
    texts = ["\n== a ==\r\n\r\nword   next\n\n\n  x \t\n\ty", "a\n\n\n", "   ", " \n b\x1c  c\x85 \x1f", "\t\t a \u3000 b", ""]
    want = [enc.encode_words([t])[0].tolist() for t in texts]
    ids, at = enc.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == want and enc.counts(texts).tolist() == [len(x) for x in want]
    enc.cut_words = None  # all is known by now, so nothing is cut again
    assert enc.counts([texts[0] + texts[0], texts[2]]).tolist() == [2 * len(want[0]), len(want[2])]


def test_pieces_are_looked_up_once_for_all_that_are_alike():
    class Counted(bpe.Index):
        n = 0

        def __getitem__(self, k):
            self.n += 1
            return super().__getitem__(k)

    tally = Tally(2)
    tally.pieces = Counted()
    doc, n, of, at = tally.spoken(["The word and the word. And the end of it all.", None, "The word and the word."] * 50, 3)
    assert n.tolist()[:3] == [5, 6, 5] and doc.tolist()[:4] == [0, 0, 2, 3] and len(at) == 50 * 16 and tally.pieces.n == len(tally.pieces) == 10
    tally.add(at, np.ones(len(at), np.int64))
    assert tally.n[:, tally.words["word"]].tolist() == [0, 200] and tally.n.sum() == 50 * 16
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    odd = ["".join(f"{a}x{b}" for a, b in zip(spaces, spaces[1:])), "a\u200bb \ufeffc", *(f"{c}a{c}{c}b{c}" for c in spaces)]
    assert split(pa.array(odd)).to_pylist() == [t.split() for t in odd]


def test_passes_read_blocks_of_documents(texts):
    _, docs, aliases = texts
    spoken = described(docs, tallied(docs, aliases)).where("length(dims) > 0").select("lang_code", "dims", "counts").coalesce(1).cache()
    langs = ["de", "en"]
    rows = [v for b in spoken.toArrow().combine_chunks().to_batches() for v in topics.rows(langs, *b.columns) for v in [(v.logs.copy(), v.lang)]]
    blocks = topics.blocks(spoken, langs).toArrow().combine_chunks().to_batches()
    got = [v for b in blocks for v in topics.vectors(topics.unpacked(b)) for v in [(v.logs.copy(), v.lang)]]
    assert [len(x) for _, x in got] == [500, 500, 500, 1] and all(np.array_equal(a, b) and np.array_equal(k, m) for (a, k), (b, m) in zip(rows, got, strict=True))
    large = (np.array([1]), np.array([0, 2]), np.array([3, 9], np.uint16), np.array([1, 5000], np.uint32))
    for count in (large[3], large[3] % 256):
        row = pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip((*large[:3], count), {**topics.BLOCK, **({} if count.max() > 255 else {"counts": np.uint8})}.values())], names=list(topics.BLOCK))
        assert next(topics.vectors(topics.unpacked(row))).logs[0, [3, 9]] == pytest.approx(np.log1p(count))
