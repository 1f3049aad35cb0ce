"""Bucketed stores, Bloom filters and distributed selection."""

import random
import re

import pytest
from pyspark.sql import functions as F

from draftsmith.operators.bucketed import append, bloom_words, maybe_in, missing_by_bloom, open_store
from draftsmith.operators.ranking import seeded_rank, shuffle_cap, smallest_keys
from draftsmith.operators.resume import attach_artefacts, missing_ids, validate_artefacts
from draftsmith.sources.artefacts import ARTEFACT_SCHEMA, PREPARED_SCHEMA


@pytest.fixture
def sorted_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _exchanges(df):
    return len(re.findall(r"\bExchange\b", df._jdf.queryExecution().executedPlan().toString()))


def test_stores_bucketed_alike_are_joined_in_place(spark, tmp_path, sorted_joins):
    rows = open_store(spark, "prepared_b", f"{tmp_path}/prepared", PREPARED_SCHEMA, "sample_id", 4)
    made = open_store(spark, "artefacts_b", f"{tmp_path}/made", ARTEFACT_SCHEMA, "sample_id", 4)
    assert rows.count() == made.count() == 0
    ids = spark.range(100).withColumnRenamed("id", "sample_id")
    full = ids.select("sample_id", F.array("sample_id").alias("input_ids"), F.array(F.lit(True)).alias("loss_mask"), F.lit(1).alias("seq_len"))
    states = ids.select("sample_id", F.array("sample_id").alias("token_ids"), F.array(F.array(F.lit(0.5).cast("float"))).alias("hidden_states"))
    append(full, "prepared_b", "sample_id", 4)
    for part in ("sample_id % 3 = 0", "sample_id % 3 = 1 AND sample_id < 50"):  # later appends keep the buckets
        append(states.filter(part), "artefacts_b", "sample_id", 4)
    rows, made = spark.table("prepared_b"), spark.table("artefacts_b")
    have = {i for i in range(100) if i % 3 == 0 or (i % 3 == 1 and i < 50)}
    for df, want in (
        (missing_ids(rows, made), set(range(100)) - have),
        (attach_artefacts(rows, made, "skip"), have),
        (validate_artefacts(rows, made).filter("ok"), have),
    ):
        assert _exchanges(df) == 0, df._jdf.queryExecution().executedPlan().toString()
        assert {r.sample_id for r in df.collect()} == want
    # another session finds the store by its folder
    again = open_store(spark.newSession(), "found_b", f"{tmp_path}/made", ARTEFACT_SCHEMA, "sample_id", 4)
    assert {r.sample_id for r in again.select("sample_id").collect()} == have
    for t in ("prepared_b", "artefacts_b", "found_b"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


@pytest.mark.parametrize("words", [None, 1, 64])
def test_bloom_filter_settles_false_positives(spark, words):
    todo = spark.range(3000).select(F.col("id").cast("string").alias("sample_id"), F.lit("payload").alias("p"))
    todo = todo.unionAll(spark.createDataFrame([(None, "p")], "sample_id string, p string"))
    have = todo.filter("sample_id % 7 = 0").select("sample_id")
    got = missing_by_bloom(todo, have, words=words)
    assert sorted(map(str, got.collect())) == sorted(map(str, missing_ids(todo, have).collect()))
    maybe = todo.filter(maybe_in(bloom_words(have, words=words)))
    assert maybe.join(have, "sample_id", "left_semi").count() == have.count()  # no id is lost
    if words is None:
        assert maybe.count() < 1.1 * have.count()  # few others come through
    assert missing_by_bloom(todo, have.limit(0), words=words).count() == 3001


def test_caps_select_without_ranking(spark):
    df = spark.range(5000).select(F.col("id").alias("sample_id"), F.lit("x").alias("text"))
    for n in (0, 1, 17, 2500, 4999, 5000, 9000):
        want = {r.sample_id for r in seeded_rank(df, 3, "sample_id", "r").filter(F.col("r") < n).collect()}
        got = shuffle_cap(df, 3, "sample_id", n)
        assert {r.sample_id for r in got.collect()} == want and got.count() == min(n, 5000)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan
    assert shuffle_cap(df, 3, "sample_id", None).count() == 5000
    # rounds of refinement, down to single keys
    keys = df.select(F.md5(F.col("sample_id").cast("string")).alias("k"))
    ordered = sorted(r.k for r in keys.collect())
    for n in (1, 123, 5000):
        assert smallest_keys(keys, "k", n, digits=1, most=2) == (ordered[n - 1], True, 1)


def test_caps_with_repeated_ids(spark):
    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.4 else i, f"t{i}") for i in range(2000)] + [(9, "same")] * 300
    df = spark.createDataFrame(rows, "sample_id long, text string").repartition(5)
    for n in (1, 100, 1500, 2299, 2300):
        got = [tuple(r) for r in shuffle_cap(df, 1, "sample_id", n, unique_ids=False).collect()]
        assert len(got) == n and not set(got) - set(rows)
        assert all(got.count(r) <= rows.count(r) for r in set(got))
        order = {r.sample_id: r.rank for r in seeded_rank(df.select("sample_id").distinct(), 1, "sample_id").collect()}
        last = max(order[i] for i, _ in got)
        full = sum(order[i] < last for i, _ in rows)
        assert full <= n and sum(order[i] < last for i, _ in got) == full
