import hashlib
import random

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from draftsmith.llm import bpe, entries
from draftsmith.llm.bpe import TrieEncoder, decode, encode_documents, tokenizer_file, vocabulary
from draftsmith.llm.token_counts import encoded_lengths, length_histogram, length_quantiles, suffix_sums, truncated_totals
from tests.conftest import SF_SMALL
from tests.llm.helpers import PROSE, docs_frame, long_text

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as f:
        return TrieEncoder(f.read())


def test_fuzz(theirs, ours):
    rng = random.Random(11)
    letters = "abcdefgh ijklmnop ABC  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0　 ​﻿᠎ 012345'''.,!?-é ü日本語\U0001f600\U0001f44d\U0001f3fd́½²Ⅷßñ<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>c", "=" * 700, "ab" * 2000, " " * 900 + "x", "don't I'LL 've 'S's", None, ""]
    got = ours.encode_batch(texts)
    for t, g in zip(texts, got):
        want = theirs.encode(t or "", add_special_tokens=False).ids
        assert g.tolist() == want
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)
    assert ours.encode_batch(texts, count_only=True) == [len(g) for g in got]


def test_long_text_is_cut_only_between_words(theirs, ours, monkeypatch):
    monkeypatch.setattr(bpe, "_CHUNK", 50)
    text = (PROSE + "\n\n  " + "x" * 300 + " 12 ") * 30
    assert ours.encode_batch([text])[0].tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_word_table_is_bounded(theirs, ours, monkeypatch):
    monkeypatch.setattr(bpe, "_MEMO", 10)
    texts = [long_text(200), PROSE, "y" * 100]
    for _ in range(2):
        assert [g.tolist() for g in ours.encode_batch(texts)] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]


def test_op8_against_the_library(spark, theirs):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = entries.QUERIES["op8_bpe_round_trip"](spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        back = theirs.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def test_edges(spark, theirs):
    rows = [(1, None), (2, ""), (3, PROSE), (3, PROSE), (None, "a"), (4, long_text(60_000)), (5, "z" * 200_000)]
    docs = docs_frame(spark, rows, extra=True)
    out = encode_documents(docs, PATH)
    assert set(docs.columns) <= set(out.columns)
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert list(r.token_ids) == theirs.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert encode_documents(docs.limit(0), PATH).count() == 0
    back = out.where("doc_id = 3").select(decode(F.col("token_ids"), vocabulary(spark, PATH)).alias("t")).collect()
    assert {r.t for r in back} == {PROSE}


def test_op4_against_plain_sums(spark, theirs):
    lens = [(r.doc_id, len(theirs.encode(r.text, add_special_tokens=False).ids)) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    got = {r.length: r for r in entries.QUERIES["op4_token_counts"](spark, SF_SMALL).collect()}
    assert set(got) == {n for _, n in lens}
    for n, r in got.items():
        assert r.n_docs == sum(m == n for _, m in lens)
        assert r.first_id == min(d for d, m in lens if m == n)
        assert r.docs_ge == sum(m >= n for _, m in lens) and r.tokens_ge == sum(m for _, m in lens if m >= n)
        assert r.docs_le == sum(m <= n for _, m in lens)
        assert r.truncated_tokens == sum(min(m, n) for _, m in lens)


def test_limits_and_quantiles(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (4, long_text(3000)), (5, long_text(900)), (5, long_text(900))]
    lengths = encoded_lengths(docs_frame(spark, rows, extra=True), PATH).cache()
    ls = sorted(r.length for r in lengths.collect())
    sums = suffix_sums(length_histogram(lengths))
    limits = [0, 1, 2, 500, 10**6, *ls]
    got = {r.context_limit: (r.tokens, r.docs_cut) for r in truncated_totals(sums, limits).collect()}
    assert got == {c: (sum(min(x, c) for x in ls), sum(x > c for x in ls)) for c in limits}
    qs = {r.quantile: r.length for r in length_quantiles(sums, [0.1, 0.5, 0.9, 1.0]).collect()}
    assert qs == {q: next(x for i, x in enumerate(ls) if (i + 1) / len(ls) >= q) for q in (0.1, 0.5, 0.9, 1.0)}
    none = suffix_sums(length_histogram(lengths.limit(0)))
    assert none.count() == 0
    assert [tuple(r) for r in truncated_totals(none, [5]).collect()] == [(5, 0, 0)]
    assert length_quantiles(none, [0.5]).first().length is None
