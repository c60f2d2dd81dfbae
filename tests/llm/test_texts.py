import numpy as np
import pytest

from strandweave.llm import bpe, mixing
from strandweave.llm.language import label_faults, languages, trained
from strandweave.llm.prose import sentences

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(bpe.VOCABULARY)


ODD = ["", None, " ", "\n", "\n\n", "a", " a", "a ", "a  b", "a\n\n\nb", "a \n b\r\n\r\nc", "I'll we've 'S x'll's", "<|endoftext|>", "a" * 5000, "ab" * 3000, "9" * 400, "½ ⅷ ٣٤ １２ ²³", "éäñ = éäñ",
       "\x00 a\x00b", "\x1c a\x1f b\x85 c　d", "👩🏽‍🔬 🇪🇺", "שלום x مرحبا", "\ttab\t\tx \t y", "end \n", "x\r\ry", " \n \n ", "日本 漢字"]


def test_encoding_equals_public_libraries(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ODD + [r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]
    enc = bpe.Encoder(ranks)
    for part in (texts, texts[::-1], texts[5:9]):
        ids, ends = enc.encode(part)
        got = [ids[ends[i] : ends[i + 1]].tolist() for i in range(len(part))]
        assert got == [own.encode_ordinary(t) if t else [] for t in part]


def test_encoding_survives_forgetting(ranks):
    a, b = bpe.Encoder(ranks), bpe.Encoder(ranks, most_pieces=3)
    for t in ODD * 2:
        assert a.encode([t])[0].tolist() == b.encode([t])[0].tolist()


def test_encoded_frame(spark):
    df = spark.createDataFrame([(1, "hi there", "x"), (1, "hi there", "y"), (2, None, "z"), (3, "", None), (None, "hi", None)], "doc_id long, text string, ids string")
    got = sorted([(r.doc_id or 0, r.ids) for r in bpe.encoded(df).collect()])
    assert got[1] == got[2] and got[3:] == [(2, []), (3, [])] and got[0][0] == 0 and len(got[0][1]) == 1
    assert bpe.encoded(df.limit(0)).count() == 0


def test_filled_respects_caps():
    x = mixing.filled(np.array([1.0, 1.0, 2.0]), np.array([0.5, 10.0, 10.0]), 6.5)
    assert x == pytest.approx([0.5, 2.0, 4.0])


def test_mix_reaches_shares(spark):
    docs = spark.createDataFrame([(i, " A " if i % 3 else "b", "en", f"some words here {i} " * (1 + i % 5)) for i in range(3000)] + [(9001, None, "en", "x"), (9002, "other", "en", "x"), (9003, "a", None, None)], "doc_id long, source string, lang string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1), ("B", 1.0, 2), ("none", 2.0, 3), ("b", 1.0, 2)], "source string, weight double, max_repeats int")
    aliases = spark.createDataFrame([("en", "en")], "alias string, lang_code string")
    used, report, marginals = mixing.mixed(docs, targets, aliases)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"a", "b", "none"} and r["none"].actual_share == 0 and r["none"].n_docs == 0
    assert r["a"].actual_share == pytest.approx(0.5, abs=1e-3) and r["b"].most_copies <= 2 and r["a"].most_copies == 1
    assert r["b"].tokens == pytest.approx(r["a"].tokens, rel=2e-3) and used.where("doc_id >= 9001").count() == 0
    m = {(x.marginal, x.value): x for x in marginals.collect()}
    assert all(sum(x.actual_share for (k, _), x in m.items() if k == kind) == pytest.approx(1) for kind in ("language", "topic"))
    half = mixing.mixed(docs, targets, aliases, total_tokens=4000)[1].agg({"tokens": "sum"}).first()[0]
    assert half == pytest.approx(4000, abs=80)
    assert mixing.mixed(docs.limit(0), targets, aliases)[0].count() == 0


def test_prose():
    text = """{{Infobox\n| a = {{#if:x|y}}\n}}\n'''Name''' – First [[A|link]] here.<ref>no {{x}}</ref> Second.\n== Heading ==\n{| class="x"\n| cell\n|}\n* Item one.\n#REDIRECT [[X]]\n[[Category:No]]\n<table><tr><td>1</td></tr></table>"""
    assert sentences(text) == ["First link here.", "Second.", "Item one."]
    assert sentences("") == [] and sentences("{{open\n| x\n| y") == []


def test_languages(spark):
    docs, aliases = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{D}/lang_aliases.parquet")
    model = trained(docs, aliases)
    en = "The name of the place comes from an older word that means quiet water. The old bridge was built in 1700 and stands on the left bank of the river. "
    fr = "Le nom du lieu vient d'un mot plus ancien qui signifie eau tranquille et les habitants se retrouvaient souvent ici. "
    rows = [(1, "en", en * 2), (2, "de", en * 2), (3, None, en * 2), (4, "xx", fr * 3), (5, "en", en * 3 + fr), (6, "en", None), (7, "en", ""), (8, None, "MARZOR FENHOL!!! " * 40), (9, "en", "Zel.")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, lang string, text string, n_words int")
    j = languages(df, model)
    got = sorted(map(tuple, label_faults(j, aliases).collect()))
    assert got == [(2, "wrong", "en"), (3, "missing", "en"), (4, "missing", "fr"), (5, "mixed", "fr")]
    r = {x.doc_id: x for x in j.collect()}
    assert r[5].seg_langs == ["en", "fr"] and 0.5 < r[1].confidence <= 1 and r[6].n_words == r[8].n_words == 0 and r[6].main_lang is None
    assert languages(df.limit(0), model).count() == 0


def test_languages_of_held_out_documents(spark):
    """Labels of the other documents as held-out truth: a few per cent of them are wrong on purpose."""
    docs, aliases = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{D}/lang_aliases.parquet")
    model = trained(docs, aliases)
    other = languages(spark.read.parquet(f"{D}/documents.parquet"), model).where("n_words >= 60")
    from pyspark.sql import functions as F
    label = other.withColumn("code", mixing.language_of("lang", aliases)).where("code is not null")
    assert label.where(F.col("code") == F.col("main_lang")).count() / label.count() > 0.85
    untrained = trained(docs.limit(0), aliases)
    assert languages(docs.limit(5), untrained).where("n_words > 0").count() == 0


def test_junk_is_no_language(spark):
    docs, aliases = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{D}/lang_aliases.parquet")
    model = trained(docs, aliases)
    rows = [(1, None, "9q kGrjB zT mBt Dwsa rw HV s aDlSYi q G zy yDgxm xQ. " * 4), (2, None, "Zelwen Marzorol Irdra Tambelmor Quinul Delgarhol Nestor Wenrosol. " * 4), (3, None, "kjzh xqqgdk lfs jk dfsqg dahaq ghklkzkqg kjlg sgkfffl. " * 4),
            (4, None, "Lars Zelwen and Irdra Marzorol met Tambelmor of Quinul in Delgarhol, where the harbour was built. " * 3)]
    j = {r.doc_id: r for r in languages(spark.createDataFrame(rows, "doc_id long, lang string, text string"), model).collect()}
    assert all(j[i].n_words == 0 for i in (1, 2, 3)) and j[4].main_lang == "en"


def test_confidence_is_calibrated(spark):
    """Of other documents, about as many bear the language told as the mean confidence says; labels are wrong on purpose in a few per cent."""
    docs, aliases = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet(f"{D}/lang_aliases.parquet")
    model = trained(docs, aliases)
    j = languages(spark.read.parquet(f"{D}/documents.parquet"), model).where("n_words >= 60 and main_lang is not null").withColumn("code", mixing.language_of("lang", aliases)).where("code is not null").collect()
    assert model.scale[0] > 0 and all(0 <= r.confidence <= 1 for r in j)
    right, told = np.mean([r.code == r.main_lang for r in j]), np.mean([r.confidence for r in j])
    assert len(j) > 20 and right > 0.85 and abs(right - told) < 0.12


def test_unclosed_tags_take_linear_time():
    import time
    t = time.time()
    sentences("<ref>a " * 40_000 + "<!-- x " * 10_000)
    assert time.time() - t < 5
    assert sentences("A <ref>b</ref> c <ref name=x/> d. <!-- e --> F <math>g") == ["A   c   d.", "F  g"]
