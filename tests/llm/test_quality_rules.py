import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from draftsmith.llm import entries
from draftsmith.llm import quality as Q
from tests.conftest import SF_SMALL
from tests.llm.helpers import PROSE, docs_frame, long_text


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if wins[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text) if words else 0, len(lines) - len(set(lines)), len(hit)


def test_op9_base_against_plain_python(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF_SMALL}/documents.parquet'").fetchall())
    rows = entries.QUERIES["op9_quality_rules"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert not (r.base_failed and r.kept)


def test_verdicts_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in entries.QUERIES["op9_quality_rules"](spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    judged = [(got[d].kept, q) for d, q in labels if not got[d].base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.97
    assert np.mean([k for k, q in judged if q]) > 0.98  # good documents stay


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, PROSE), (4, PROSE), (None, PROSE), (5, long_text(50_000)), (6, "x" * 300_000)]
    docs = docs_frame(spark, rows, extra=True)
    got = Q.quality_scores(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].base_failed and by[2].base_failed and by[3].m.n_words == 0
    assert by[5].m.n_words == 50_000 and by[6].m.word_chars == 300_000
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert Q.quality_filter(docs.limit(0)).count() == 0 and Q.quality_scores(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [["a"] * 30, list("abcdefgh") * 2, list("abcdefghi") + list("abcdefgh"), []])
def test_repeated_words(words):
    assert Q.repeated_words(words) == plain_base(" ".join(words))[4]


def test_em_finds_the_minority_class():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.9
    votes = np.where(good[:, None], rng.choice([2, 1, 0], (20_000, 5), p=[0.9, 0.08, 0.02]), rng.choice([2, 1, 0], (20_000, 5), p=[0.2, 0.1, 0.7]))
    codes = (votes * 3 ** np.arange(5)).sum(axis=1)
    counts = list(Counter(codes.tolist()).items())
    prior, p = Q.fit(counts, 5)
    post = dict(Q.posteriors([c for c, _ in counts], prior, p))
    assert abs(prior - 0.9) < 0.02
    assert np.mean([(post[c] >= 0.5) == g for c, g in zip(codes.tolist(), good)]) > 0.99


def test_schema(spark):
    s = entries.QUERIES["op9_quality_rules"](spark, SF_SMALL)
    assert s.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert s.where(F.col("kept").isNull() | F.col("base_failed").isNull()).count() == 0
