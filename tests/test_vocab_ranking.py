"""Vocabulary selection, frequencies, ranks, splits and rank chunks (FIXTURES 17, 18)."""

import random

import pytest
from pyspark.sql import functions as F

from draftsmith.operators.ranking import chunk_of, global_rank, id_rank, seeded_rank, split_cut
from draftsmith.operators.resume import assign_chunks, backfill_plan
from draftsmith.operators.vocab import combine_frequencies, select_draft_tokens, token_frequency, validate_vocab_maps, vocab_maps


def _py_select(freq: dict, k: int) -> list:
    top = sorted(freq, key=lambda t: (-freq[t], t))[:k]
    have = set(top)
    for t in range(k):
        if len(top) >= k:
            break
        if t not in have:
            top.append(t)
    return sorted(top)


@pytest.mark.parametrize("k", [3, 10, 40])
def test_select_draft_tokens_matches_python(spark, k):
    rng = random.Random(k)
    freq = {rng.randint(0, 60): rng.randint(1, 5) for _ in range(25)}
    df = spark.createDataFrame(list(freq.items()), "token_id long, freq long")
    got = sorted(r.token_id for r in select_draft_tokens(spark, df, k).collect())
    assert got == _py_select(freq, k)
    d2t, t2d = vocab_maps(select_draft_tokens(spark, df, k), 100, spark)
    validate_vocab_maps(d2t, t2d, k, 100)
    offs = {r.draft_id: r.offset for r in d2t.collect()}
    assert [i + offs[i] for i in range(k)] == got


def test_frequency_counts_only_trainable(spark):
    rows = spark.createDataFrame([(1, [5, 6, 5, 7], [True, True, True, False]), (2, [5, 7], [False, True])], "sample_id long, input_ids array<long>, loss_mask array<boolean>")
    f = {r.token_id: r.freq for r in token_frequency(rows).collect()}
    assert f == {5: 2, 6: 1, 7: 1}
    c = {r.token_id: r.freq for r in combine_frequencies(token_frequency(rows), token_frequency(rows)).collect()}
    assert c == {5: 4, 6: 2, 7: 2}


def test_global_rank_equals_sort(spark):
    df = spark.range(0, 3000).withColumn("v", F.pmod(F.col("id") * 7919, F.lit(1000)))
    r = seeded_rank(df, 11, "id", "rk")
    got = [x.id for x in r.orderBy("rk").collect()]
    exp = [x.id for x in df.withColumn("k", F.md5(F.concat_ws(":", F.lit("11"), F.col("id").cast("string")))).orderBy("k", "id").collect()]
    assert got == exp
    assert [x.rk for x in r.orderBy("rk").collect()] == list(range(3000))
    g = global_rank(df, [F.col("v"), F.col("id")], F.floor(F.col("v") / 100), "r2")
    assert [x.id for x in g.orderBy("r2").collect()] == [x.id for x in df.orderBy("v", "id").collect()]


def test_split_cut():
    assert split_cut(10, 0.8) == (0, 8)
    assert split_cut(10, -0.2) == (8, 10)
    assert split_cut(10, 1.0) == (0, 10)
    for bad in (0.0, 1.5, -1.0):
        with pytest.raises(ValueError):
            split_cut(10, bad)


def test_rank_chunks_fixture(spark):
    ids = spark.range(10).withColumnRenamed("id", "sample_id")
    got = {r.sample_id: r.owner for r in assign_chunks(ids, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 1, 7: 2, 8: 2, 9: 2}
    existing = spark.createDataFrame([(2,), (5,), (7,)], "sample_id long")
    todo = sorted(r.sample_id for r in backfill_plan(ids, existing, 1).collect())
    assert todo == [0, 1, 3, 4, 6, 8, 9]
    big = spark.range(100).withColumnRenamed("id", "sample_id")
    c = {r.sample_id: r.owner for r in assign_chunks(big, 2, max_samples=10).collect()}
    assert c == {i: (0 if i < 5 else 1) for i in range(10)}


def test_chunks_cover_without_overlap(spark):
    for n, w in [(7, 3), (2, 5), (100, 7)]:
        df = spark.range(n).select(chunk_of(F.col("id"), n, w).alias("o"))
        owners = [r.o for r in df.collect()]
        assert all(o is not None for o in owners)
        sizes = [owners.count(k) for k in range(w)]
        assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n


def test_id_rank_dense(spark):
    df = spark.createDataFrame([(5,), (100000,), (7,), (70000,)], "sample_id long")
    r = {x.sample_id: x.rank for x in id_rank(df, "sample_id").collect()}
    assert r == {5: 0, 7: 1, 70000: 2, 100000: 3}
    sparse = spark.createDataFrame([(-(1 << 61),), (3,), ((1 << 61) + 9,), ((1 << 61) + 10,)], "sample_id long")
    assert sorted((x.rank, x.sample_id) for x in id_rank(sparse, "sample_id").collect()) == [(0, -(1 << 61)), (1, 3), (2, (1 << 61) + 9), (3, (1 << 61) + 10)]
    assert id_rank(df.limit(0), "sample_id").count() == 0


def test_rank_with_a_hot_duplicated_key(spark):
    from draftsmith.operators.ranking import global_rank_with_ties

    # one key holds 40% of the rows
    rows = [(7, i) for i in range(400)] + [(k, i) for k in range(100) if k != 7 for i in range(6)]
    df = spark.createDataFrame(rows, "k long, payload long")
    r = global_rank_with_ties(df, ["k"], F.floor(F.col("k") / 10), "rk", rows_per_group=50).collect()
    ranks = sorted(x.rk for x in r)
    assert ranks == list(range(len(rows)))  # a permutation of 0..n-1
    by_key = {}
    for x in r:
        by_key.setdefault(x.k, []).append(x.rk)
    keys = sorted(by_key)
    for a, b in zip(keys, keys[1:]):
        assert max(by_key[a]) < min(by_key[b])  # key order respected


def test_seeded_rank_duplicates_mode(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(i,) for i in range(2, 12)], "sample_id long")
    r = seeded_rank(df, 3, "sample_id", "rk", unique_ids=False).collect()
    assert sorted(x.rk for x in r) == list(range(40))
    u = seeded_rank(df.distinct(), 3, "sample_id", "rk").orderBy("rk").collect()
    d = {}
    for x in r:
        d.setdefault(x.sample_id, []).append(x.rk)
    assert [x.sample_id for x in u] == sorted(d, key=lambda k: min(d[k]))  # same id order as the unique ranking
