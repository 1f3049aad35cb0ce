"""Training-log operators (FIXTURE 33) and streaming jobs vs batch results."""

import random

import pytest
from pyspark.sql import functions as F

from draftsmith.operators.evaluation import scrape_deltas
from draftsmith.operators.training_logs import best_epoch, failure_streaks, normalize_counted, running_best, step_profile
from draftsmith.streaming.jobs import counter_delta_stream, dedup_stream, failure_breaker_stream, file_stream, read_aborts, read_counter_deltas, regen_stream, run_available


def test_normalize_counted(spark):
    df = spark.createDataFrame([(0, "loss_sum", 6.0), (0, "loss_total", 3.0), (0, "acc_sum", 1.0), (0, "acc_total", 0.0),
                                (0, "lr", 4.0), (0, "orphan_total", 5.0), (0, "lone_sum", 2.0)], "k int, name string, value double")
    r = {x.name: x.value for x in normalize_counted(df, ("k",), world_size=2).collect()}
    assert r == {"loss": 2.0, "acc": 0.0, "lr": 2.0, "lone_sum": 1.0}


def _py_streaks(oks, threshold):
    out, c = [], 0
    for ok in oks:
        c = 0 if ok else c + 1
        out.append(c)
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_failure_streaks_bucketed_exact(spark, width):
    rng = random.Random(width)
    rows = [(e, t, rng.random() > 0.6) for e in range(3) for t in range(60)]
    df = spark.createDataFrame(rows, "endpoint long, t long, ok boolean")
    got = {(r.endpoint, r.t): r.streak for r in failure_streaks(df, 3, bucket_width=width).collect()}
    for e in range(3):
        oks = [ok for (ee, _, ok) in rows if ee == e]
        assert [got[(e, t)] for t in range(60)] == _py_streaks(oks, 3)


def test_step_profile_fixture(spark):
    m = spark.createDataFrame([(0, 0.0, 0.1, 0.3, 0.5, 0.6, 4096), (1, None, 0.1, 0.3, 0.5, 0.6, 10)],
                              "step int, start double, fetch double, fwd double, bwd double, opt double, num_tokens long")
    r = {x.step: x for x in step_profile(m).collect()}
    assert r[0].fetch_ms == pytest.approx(100) and r[0].fwd_ms == pytest.approx(200) and r[0].step_ms == pytest.approx(600)
    assert r[0].tokens_per_s == pytest.approx(4096 / 0.6) and r[0].fetch_frac == pytest.approx(1 / 6)
    assert r[1].step_ms == 0.0 and r[1].tokens_per_s == 0.0 and r[1].fetch_frac == 0.0


def test_best_epoch_first_wins_ties(spark):
    df = spark.createDataFrame([(0, "loss_epoch", 2.0), (1, "loss_epoch", 1.0), (2, "loss_epoch", 1.0), (3, "loss_epoch", 0.5)], "epoch int, name string, value double")
    assert best_epoch(df, saved=F.col("epoch") < 3).first().best_epoch == 1
    rb = {r.epoch: r.improved for r in running_best(df.filter("name = 'loss_epoch'")).collect()}
    assert rb == {0: True, 1: True, 2: False, 3: True}


def test_streaming_counter_deltas_and_breaker(spark, tmp_path):
    scr = spark.createDataFrame([(s, "e", "num_drafts", -1, float(v)) for s, v in enumerate([1, 4, 9, 2, 5])],
                                "scrape int, engine string, name string, position int, value double")
    for lo, hi in [(0, 2), (2, 5)]:
        scr.filter((F.col("scrape") >= lo) & (F.col("scrape") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = file_stream(spark, str(tmp_path / "in"), scr.schema, max_files=1)
    run_available(counter_delta_stream(src, str(tmp_path / "out"), str(tmp_path / "ck")))
    d = {r.scrape: r.delta for r in read_counter_deltas(spark, str(tmp_path / "out")).collect()}
    assert d == {1: 3.0, 2: 5.0, 3: 2.0, 4: 3.0}  # scrape 3 is a reset: delta restarts from 0

    att = spark.createDataFrame([(1, t, ok) for t, ok in enumerate([True, False, False, True, False, False, False])], "endpoint long, t long, ok boolean")
    att.coalesce(1).write.parquet(str(tmp_path / "att"))
    src = file_stream(spark, str(tmp_path / "att"), att.schema)
    run_available(failure_breaker_stream(src, 2, str(tmp_path / "ab"), str(tmp_path / "ck2")))
    assert [(r.t, r.streak) for r in read_aborts(spark, str(tmp_path / "ab"), 2).collect()] == [(2, 2)]


ROWS = 200_000


def _layouts(df, order, folder, spark):
    """Folders with the same rows: 16 files in order, and files of mixed rows."""
    df.repartitionByRange(16, order).sortWithinPartitions(order).write.parquet(f"{folder}/ordered")
    df.repartition(9).write.parquet(f"{folder}/mixed")
    for name, files in (("ordered", None), ("ordered", 5), ("mixed", 4)):
        yield f"{name}-{files}", file_stream(spark, f"{folder}/{name}", df.schema, max_files=files)


def test_counter_deltas_do_not_depend_on_the_order_of_files(spark, tmp_path):
    """One counter with 200,000 scrapes (and a small one), with resets."""
    value = F.when(F.col("id") % 1013 == 0, 0.0).otherwise((F.col("id") % 1013) * 3.0 + F.pmod(F.xxhash64("id"), F.lit(3)))
    scr = spark.range(ROWS).select(F.col("id").cast("int").alias("scrape"), F.lit("e").alias("engine"), F.when(F.col("id") % 40_000 == 7, "rare").otherwise("hot").alias("name"), F.lit(-1).alias("position"), value.alias("value"))
    want = sorted(map(tuple, scrape_deltas(scr).collect()))
    assert len(want) == ROWS - 2
    for name, src in _layouts(scr, "scrape", str(tmp_path), spark):
        run_available(counter_delta_stream(src, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-ck", width=5000))
        assert sorted(map(tuple, read_counter_deltas(spark, f"{tmp_path}/{name}-out").collect())) == want, name


def test_breaker_does_not_depend_on_the_order_of_files(spark, tmp_path):
    """Endpoint 1 fails every other time but for two streaks; 2 never has a
    streak; 3 has one over the end of a segment; 4 only fails."""
    at = F.col("id")
    att = spark.range(ROWS).select(F.lit(1).cast("bigint").alias("endpoint"), at.alias("t"), ((at % 2 == 0) & ~at.isin(30_004, 150_004)).alias("ok"))
    att = att.unionAll(spark.range(20_000).selectExpr("2L", "id", "id % 3 <> 1"))
    att = att.unionAll(spark.range(20_000).selectExpr("3L", "id", "id NOT BETWEEN 4998 AND 5002"))
    att = att.unionAll(spark.range(12_000).selectExpr("4L", "id", "false"))
    for threshold, want in ((2, [(1, 30_004), (3, 4_999), (4, 1)]), (3, [(1, 30_005), (3, 5_000), (4, 2)]), (5, [(3, 5_002), (4, 4)]), (11_000, [(4, 10_999)])):
        batch = failure_streaks(att, threshold).filter("abort").groupBy("endpoint").agg(F.min("t").alias("t"))
        assert sorted(map(tuple, batch.collect())) == want
        for name, src in _layouts(att, "t", f"{tmp_path}/{threshold}", spark):
            out = f"{tmp_path}/{threshold}/{name}"
            run_available(failure_breaker_stream(src, threshold, f"{out}-out", f"{out}-ck", width=5000))
            assert sorted((r.endpoint, r.t) for r in read_aborts(spark, f"{out}-out", threshold).collect()) == want, name


def test_a_batch_tried_again_leaves_each_row_once(spark, tmp_path):
    """The sink of a micro-batch may run twice (a restart after the write)."""
    scr = spark.createDataFrame([(s, "e", "n", -1, float(s * s)) for s in range(10)], "scrape int, engine string, name string, position int, value double")
    scr.filter("scrape % 2 = 0").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for k in (1, 2):  # another checkpoint of the same output starts again with batch 0
        run_available(counter_delta_stream(file_stream(spark, str(tmp_path / "in"), scr.schema), out, str(tmp_path / f"ck{k}"), width=4))
        assert read_counter_deltas(spark, out).count() == 4
    scr.filter("scrape % 2 = 1").write.mode("append").parquet(str(tmp_path / "in"))
    run_available(counter_delta_stream(file_stream(spark, str(tmp_path / "in"), scr.schema), out, str(tmp_path / "ck2"), width=4))
    got = {r.scrape: r.delta for r in read_counter_deltas(spark, out).collect()}
    assert got == {s: float(2 * s - 1) for s in range(1, 10)}


def test_regen_stream_resume_is_idempotent(spark, tmp_path):
    convs = spark.createDataFrame(
        [(i, [{"role": "user", "content": f"question number {i} with enough text"}, {"role": "assistant", "content": "old"}]) for i in range(6)],
        "sample_id long, conversations array<struct<role:string,content:string>>",
    )
    convs.coalesce(1).write.json(str(tmp_path / "in"))
    src = lambda: file_stream(spark, str(tmp_path / "in"), convs.schema, fmt="json")
    answer = lambda p: p.select("sample_id", "turn", F.concat(F.lit("re: "), "text").alias("reply"))
    run_available(regen_stream(src(), answer, str(tmp_path / "out"), str(tmp_path / "ck1")))
    # a second run with a fresh checkpoint must not regenerate anything (anti-join on the output)
    run_available(regen_stream(src(), answer, str(tmp_path / "out"), str(tmp_path / "ck2")))
    out = spark.read.json(str(tmp_path / "out"))
    assert out.count() == 6 and out.select("sample_id").distinct().count() == 6


def test_dedup_does_not_depend_on_files(spark, tmp_path):
    """One key again each hour of a day, as one file and as eight, one file a batch."""
    recs = spark.range(8).select(F.lit(1).alias("user"), F.lit(0).alias("day"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 10000).alias("ts"), "id")
    for n in (1, 8):
        for k in range(n):
            recs.filter(F.col("id") % n == k).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
        src = file_stream(spark, str(tmp_path / f"in{n}"), recs.schema, max_files=1)
        run_available(dedup_stream(src, ["user", "day"], str(tmp_path / f"out{n}"), str(tmp_path / f"ck{n}")))
        assert spark.read.parquet(str(tmp_path / f"out{n}")).count() == 1


def test_failure_streaks_keep_rows_without_key_or_time(spark):
    from draftsmith.operators.training_logs import failure_streaks

    att = spark.createDataFrame([(1, 0, False), (1, 1, False), (None, 2, False), (1, None, False)], "endpoint long, t long, ok boolean")
    got = sorted((str(r.endpoint), str(r.t), r.streak, r.abort) for r in failure_streaks(att, 2).collect())
    assert got == [("1", "0", 1, False), ("1", "1", 2, True), ("1", "None", 0, False), ("None", "2", 0, False)]
