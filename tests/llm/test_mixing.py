import hashlib
import math

import pytest
from pyspark.sql import functions as F

from draftsmith.llm import entries
from draftsmith.llm.mixing import mix_sources, source_rates
from tests.conftest import SF_SMALL
from tests.llm.helpers import PROSE, docs_frame, long_text


def plain_copies(doc_id, rate, seed=17):
    u = (int(hashlib.md5(f"{seed}:{doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p = 0, math.exp(-rate)
    c = p
    while u >= c and k < 1000:
        k += 1
        p = p * rate / k
        c += p
    return k


def test_counts_against_plain_inversion(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rates = {r.source: r.rate for r in source_rates(docs, source_col="source").collect()}
    n = {r.source: r["count"] for r in docs.groupBy("source").count().collect()}
    total = sum(n.values())
    for s, r in rates.items():
        assert math.isclose(r, total * math.sqrt(n[s]) / sum(map(math.sqrt, n.values())) / n[s], rel_tol=1e-12)
    want = {r.doc_id: plain_copies(r.doc_id, rates[r.source]) for r in docs.select("doc_id", "source").collect()}
    got = {r.doc_id: r["count"] for r in mix_sources(docs).groupBy("doc_id").count().collect()}
    assert got == {d: k for d, k in want.items() if k}


def test_weights_are_met(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else "small") for i in range(6000)]
    out = mix_sources(docs_frame(spark, rows), weights={"big": 1.0, "small": 3.0}, total=8000)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 250 and abs(n["small"] - 6000) < 350
    keys = [r.shuffle_key for r in out.collect()]
    assert len(set(keys)) == len(keys)


def test_order_is_random_and_stable(spark):
    docs = docs_frame(spark, [(i, f"t{i}") for i in range(500)])
    a = [(r.doc_id, r.copy) for r in mix_sources(docs).collect()]
    assert a == [(r.doc_id, r.copy) for r in mix_sources(docs.repartition(7)).collect()] or sorted(a) == sorted((r.doc_id, r.copy) for r in mix_sources(docs.repartition(7)).collect())
    ids = [d for d, _ in a]
    assert ids != sorted(ids)


def test_shuffle_join_gives_the_same_rows(spark, monkeypatch):
    import draftsmith.llm.mixing as M

    docs = docs_frame(spark, [(i, "t", f"s{i % 7}") for i in range(300)])
    want = sorted((r.doc_id, r.copy) for r in mix_sources(docs).collect())
    monkeypatch.setattr(M, "BROADCAST_BYTES", 0)
    assert sorted((r.doc_id, r.copy) for r in mix_sources(docs).collect()) == want


def test_edges(spark):
    rows = [(1, None, None), (2, "", None), (3, PROSE, "a"), (3, PROSE, "a"), (None, PROSE, "a"), (4, long_text(50_000), "b")]
    docs = docs_frame(spark, rows, extra=True)
    out = mix_sources(docs, total=60)
    got = out.collect()
    assert set(docs.columns) <= set(out.columns)
    assert {r.source for r in got} == {None, "a", "b"}
    n3 = sum(r.doc_id == 3 for r in got)
    assert n3 % 2 == 0  # repeated rows alike
    assert mix_sources(docs.limit(0)).count() == 0
    assert mix_sources(docs, weights={"a": 1.0}, total=10).where("source IS NULL OR source <> 'a'").count() == 0
    with pytest.raises(Exception, match="repetition rate"):
        mix_sources(docs, total=10**9).collect()


def plain_pieced(doc_id, rate, seed=17):
    if rate <= 700:
        return plain_copies(doc_id, rate, seed)
    pieces = math.ceil(rate / 700)
    return sum(plain_copies(doc_id, rate / pieces, f"{seed}/{j}") for j in range(1, pieces + 1))


def test_a_small_source_beside_many_rows(spark):
    # default weights: the rate of a one-row source grows with the corpus
    rows = spark.range(400_000).selectExpr("id AS doc_id", "'t' AS text", "'hot' AS source")
    rows = rows.union(spark.range(400_000, 400_001).selectExpr("id", "'rare'", "'r1'")).union(spark.range(400_001, 400_002).selectExpr("id", "'none'", "CAST(null AS string)"))
    rate = 400_002 / (math.sqrt(400_000) + 2)
    got = {r.doc_id: r for r in mix_sources(rows).where("doc_id >= 400000").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi")).collect()}
    assert 500 < rate < 700
    assert {d: r.n for d, r in got.items()} == {d: plain_copies(d, rate) for d in (400_000, 400_001)}
    assert all(r.lo == 1 and r.hi == r.n for r in got.values())


def test_rates_of_many_pieces(spark):
    docs = docs_frame(spark, [(i, f"t{i}", "rare" if i < 40 else "big") for i in range(100_000)])
    out = mix_sources(docs, weights={"rare": 1.0, "big": 1.0}).where("source = 'rare'")
    got = {r.doc_id: r for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy").alias("d"), F.max("copy").alias("hi")).collect()}
    assert {d: r.n for d, r in got.items()} == {d: plain_pieced(d, 1250.0) for d in range(40)}
    assert all(r.n == r.d == r.hi for r in got.values())
    n = [r.n for r in got.values()]
    mean = sum(n) / 40
    assert abs(mean - 1250) < 4 * math.sqrt(1250 / 40) and 600 < sum((x - mean) ** 2 for x in n) / 39 < 2300  # as Poisson has it


def test_registered(spark):
    assert {"op10_poisson_mixing"} <= set(entries.QUERIES) & set(entries.ORACLES)
