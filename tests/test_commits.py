"""Manifests and log-structured runs."""

import pytest
from pyspark.sql import functions as F

from draftsmith.operators.regen import write_results_once
from draftsmith.sources import commits
from draftsmith.sources.benchmarks import write_result_rows
from draftsmith.sources.commits import Folder, Runs, committed, read_committed, write_once
from draftsmith.streaming.jobs import file_stream, read_latest_counts, run_available, token_frequency_stream


def test_a_job_that_dies_and_is_run_again_adds_its_rows_once(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    rows = spark.range(10).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") < 8, "ok").otherwise("error").alias("status"))
    read = lambda: sorted((r.id, r.status) for r in read_committed(spark, out, "id string, status string", "json").collect())
    want = sorted(map(tuple, rows.collect()))
    assert read() == []
    # killed after the rows are written and before the manifest
    with monkeypatch.context() as m:
        m.setattr(Folder, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            write_results_once(rows, out, "j1")
    assert read() == []
    assert write_results_once(rows, out, "j1") and read() == want
    # killed after the manifest: run again, nothing is added
    assert not write_results_once(rows, out, "j1") and read() == want
    # two attempts at a time: the manifest of the other is there when this one ends
    with monkeypatch.context() as m:
        m.setattr(Folder, "names", lambda self, folder: [])
        assert not write_results_once(rows, out, "j1")
    assert read() == want and len(committed(spark, out)) == 1
    assert write_results_once(rows.limit(2), out, "j2") and len(read()) == 12
    with pytest.raises(ValueError):
        write_once(rows, out, "a/b")


def test_result_rows_of_a_job_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", "constant", 1.0)], "subset string, strategy string, rps_median double")
    for _ in range(2):
        write_result_rows(rows, str(tmp_path / "csv"), job="sweep-1")
    (path,) = committed(spark, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(path).count() == 1


def _counts(spark, values):
    return spark.createDataFrame(list(values.items()), "token_id long, freq long")


@pytest.mark.parametrize("fanout", [2, 3])
def test_runs_keep_the_newest_and_stay_few(spark, tmp_path, fanout):
    runs, want = Runs(spark, str(tmp_path), ["token_id"], fanout), {}
    for batch in range(12):
        changed = {t: batch * 100 + t for t in (batch % 5, 7, 20 + batch)}
        want |= changed
        runs.add(_counts(spark, changed), batch)
        assert {r.token_id: r.freq for r in runs.newest().collect()} == want
        live = runs.live()
        levels = [r[0] for r in live]
        assert all(levels.count(k) < fanout for k in levels)
        assert [b for r in live for b in range(r[1], r[2] + 1)] == list(range(batch + 1))  # each batch once
        assert sorted(runs._all()) == sorted(live)  # merged runs are gone
    runs.add(_counts(spark, changed), 11)  # a batch that is tried again
    assert {r.token_id: r.freq for r in runs.newest().collect()} == want


@pytest.mark.parametrize("dies", ["_write", "drop", "create"])
def test_a_merge_that_dies_loses_nothing(spark, tmp_path, monkeypatch, dies):
    runs, want = Runs(spark, str(tmp_path), ["token_id"], 2), {}
    runs.add(_counts(spark, {1: 1, 2: 2}), 0)
    want = {1: 1, 2: 5, 3: 3}

    def die(*a):
        raise KeyboardInterrupt

    real, calls = Runs._write, []

    def second(self, rows, run):  # the batch itself is written, the merge dies half way
        calls.append(run)
        if len(calls) > 1:
            rows.limit(1).write.mode("overwrite").parquet(f"{self.folder.root}/{self._place(run)}")
            die()
        real(self, rows, run)

    with monkeypatch.context() as m:
        if dies == "_write":
            m.setattr(Runs, "_write", second)
        elif dies == "drop":  # merged, but what was merged is still there
            m.setattr(Folder, "drop", die)
        else:  # before the first manifest: the batch is not there yet
            m.setattr(Folder, "create", die)
        with pytest.raises(KeyboardInterrupt):
            runs.add(_counts(spark, {2: 5, 3: 3}), 1)
    seen = {r.token_id: r.freq for r in runs.newest().collect()}
    assert seen == ({1: 1, 2: 2} if dies == "create" else want)
    runs.add(_counts(spark, {2: 5, 3: 3}), 1)  # the stream starts the batch again
    assert {r.token_id: r.freq for r in runs.newest().collect()} == want
    runs.add(_counts(spark, {4: 4}), 2)
    assert {r.token_id: r.freq for r in runs.newest().collect()} == want | {4: 4}


def test_token_counts_of_a_stream_of_many_batches(spark, tmp_path):
    rows = spark.range(60).select(F.array(F.col("id") % 7, F.col("id") % 3, F.col("id")).alias("input_ids"), F.array(F.lit(True), F.col("id") % 2 == 0, F.lit(True)).alias("loss_mask"))
    rows.repartition(9).write.parquet(str(tmp_path / "in"))
    src = file_stream(spark, str(tmp_path / "in"), rows.schema, max_files=1)
    run_available(token_frequency_stream(src, str(tmp_path / "out"), str(tmp_path / "ck"), fanout=3))
    t = rows.select(F.explode(F.arrays_zip("input_ids", "loss_mask")).alias("t")).filter("t.loss_mask")
    want = {r.token_id: r.n for r in t.groupBy(F.col("t.input_ids").alias("token_id")).agg(F.count("*").alias("n")).collect()}
    assert {r.token_id: r.freq for r in read_latest_counts(spark, str(tmp_path / "out")).collect()} == want
    assert commits.Runs(spark, str(tmp_path / "out"), ["token_id"]).live()[0][0] > 0
