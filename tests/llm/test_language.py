import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftsmith.llm import entries
from draftsmith.llm import language as L
from tests.conftest import SF_SMALL
from tests.llm.helpers import DOCS, PROSE, docs_frame

SF = SF_SMALL.replace("sf0.001", "sf0.01")
ODD = [None, "", " ", "123 --- ...", "a", "A", "ab", "l'été, ab!", "İstanbul ß ﬁ", "中文 한국어 \U0001d4d0x", PROSE, "a b" * 9]


def plain_bag(text, bits):
    """Counts of the hashed n-grams, one by one."""
    out = {}
    codes = [ord(c) if c.isalpha() else 0 for c in "\0" + (text or "").casefold() + "\0"]
    codes = [c for i, c in enumerate(codes) if c or i == 0 or codes[i - 1]]
    for n in (2, 3, 4):
        for i in range(len(codes) - n + 1):
            g = codes[i : i + n]
            if all(g[1:-1]) and any(g):
                h = g[0] + 1
                for c in g[1:]:
                    h = (h * 0x100000001B3 + c + 1) % 2**64
                b = ((h ^ n) * 0x9E3779B97F4A7C15) % 2**64 >> (64 - bits)
                out[b] = out.get(b, 0) + 1
    return out


def as_dict(bag):
    return dict(zip(bag[0].tolist(), bag[1].tolist()))


@pytest.mark.parametrize("width", [1, 2, 5, L._SLICE])
def test_grams_in_slices_are_the_plain_ones(monkeypatch, width):
    monkeypatch.setattr(L, "_SLICE", width)
    for t in ODD:
        assert as_dict(L.bag(t, 12)) == plain_bag(t, 12), t


def test_grams_of_many_texts_stay_apart():
    got = [{} for _ in ODD]
    for bucket, doc in L.hashed_grams(ODD, 12):
        assert (np.diff(doc) >= 0).all()
        for b, d in zip(bucket.tolist(), doc.tolist()):
            got[d][b] = got[d].get(b, 0) + 1
    assert got == [plain_bag(t, 12) for t in ODD]


@pytest.fixture(scope="module")
def found(spark):
    return entries.QUERIES["op11_language_id"](spark, SF).toPandas().set_index("doc_id")


def test_query_rows_and_held_out_accuracy(spark, found):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").toPandas().set_index("doc_id")
    assert sorted(found.index) == sorted(docs.index)
    want = [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.index]
    assert found.held_out.tolist() == want
    both = found.join(docs)
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    sure = held[held.accepted]
    assert len(sure) > 0.9 * len(held) and (sure.lang_pred == sure.lang).mean() >= 0.99
    assert both.score.between(0, 1).all()


def test_prediction_is_that_of_the_model_text_by_text(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = L.train(docs.where(L.fold() != 1))
    got = {r.doc_id: r for r in L.identify(docs, model).collect()}
    for r in docs.collect():
        k, n = L.bag(r.text, model.bits)
        if not len(k):
            assert got[r.doc_id].lang_pred == "und"
            continue
        mean = sum(model.table[b].astype(float) * c for b, c in zip(k, n)) / n.sum()
        z = (model.weights @ mean + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id].lang_pred == model.langs[int(p.argmax())]
        assert got[r.doc_id].score == pytest.approx(p.max(), abs=1e-6)


EN = ["the house is on the hill and the river runs below it", "we went with them to see what there was", "this thing and that other thing were there"]
DE = ["das haus steht auf dem hügel und der fluss fließt darunter", "wir gingen mit ihnen um zu sehen was es gab", "dieses ding und jenes andere ding waren dort"]


def labelled(spark, copies=8):
    rows = [(i, t, lang, "s", 1) for k in range(copies) for lang, ts in (("en", EN), ("de", DE)) for i, t in enumerate(ts, 100 * k)]
    return spark.createDataFrame([(n, f"{r[1]} {'ab cd ef'[: n % 8]}", *r[2:]) for n, r in enumerate(rows)], DOCS)


def test_odd_texts_nulls_and_clashing_columns(spark):
    model = L.train(labelled(spark))
    assert model.langs == ["de", "en"]
    odd = docs_frame(spark, list(enumerate(ODD)) + [(None, EN[0]), (3, EN[1]), (3, EN[1])], extra=True).withColumn("score", F.lit("old"))
    got = L.identify(odd, model).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters)
        assert r.m == "xm" and r.template == "xtemplate"
    assert {r.lang_pred for r in got if r.text in EN} == {"en"}
    assert L.identify(docs_frame(spark, []), model).collect() == []


def test_rejection_and_no_labels(spark):
    model = L.train(labelled(spark))
    model.threshold = 1.1
    got = L.identify(docs_frame(spark, [(1, EN[0])]), model, reject=True).collect()
    assert got[0].lang_pred == "und" and not got[0].accepted
    none = L.train(docs_frame(spark, [(1, EN[0])]).withColumn("lang", F.lit(None).cast("string")))
    assert none.langs == [] and L.identify(docs_frame(spark, [(1, EN[0])]), none).first().lang_pred == "und"
    assert L.train(docs_frame(spark, [(1, "123"), (2, None)])).langs == []
    one = L.train(docs_frame(spark, [(1, EN[0]), (2, EN[1])]))
    r = L.identify(docs_frame(spark, [(5, DE[0])]), one).first()
    assert (r.lang_pred, r.score) == ("en", 1.0)


def test_calibration():
    rng = np.random.default_rng(0)
    model = L.LanguageModel(["a", "b"], 5 * rng.normal(size=(4, 2)).astype(np.float32), np.eye(2), np.zeros(2), 2)
    bags = [(np.array([i % 4]), np.array([1.0])) for i in range(400)]
    right = np.array([int((model.table[i % 4]).argmax()) for i in range(400)])
    y = np.where(rng.random(400) < 0.3, 1 - right, right)
    made = L.calibrate(model, bags, y, target=0.9)
    assert made.temperature > 1  # more modest than it was
    z = np.stack([model.table[i % 4] for i in range(400)]) / made.temperature
    p = np.exp(z).max(axis=1) / np.exp(z).sum(axis=1)
    assert abs(p.mean() - (right == y).mean()) < 0.05
