"""End-to-end plans: regen with resume and limit, backfill by rank, evaluation files."""

import json

from pyspark.sql import functions as F

from draftsmith.plans.backfill import backfill
from draftsmith.plans.evaluate import evaluate_subset, speedup
from draftsmith.plans.regenerate import regenerate_dataset
from draftsmith.sources.conversations import RAW_SCHEMA


def _raw(spark, n):
    rows = [{"idx": i, "language": "EN" if i % 3 else "DE", "prompt": f"fallback prompt number {i} long enough",
             "conversations": [{"from": "human", "value": f"question {i} with plenty of text"}, {"from": "gpt", "value": "x"}]}
            for i in range(n)]
    return spark.createDataFrame(rows, RAW_SCHEMA)


def _answer(calls=None, empty=()):
    """Replies made of the question; user texts in ``empty`` get none."""

    def answer(prompts):
        if calls is not None:
            calls.append(prompts.count())
        q = prompts.filter("role = 'user'")
        return q.select("sample_id", "turn", F.when(F.col("text").isin(*empty, ""), "").otherwise(F.concat(F.lit("re: "), "text")).alias("reply"),
                        F.lit("stop").alias("finish_reason"), F.lit(2).alias("prompt_tokens"), F.lit(3).alias("completion_tokens"), F.lit(5).alias("total_tokens"), F.lit(0.12345).alias("latency_s"))

    return answer


def test_regen_limit_resume(spark, tmp_path):
    out = str(tmp_path / "regen")
    runs = [regenerate_dataset(spark, _raw(spark, 12), _answer(), out, language="EN", limit=3) for _ in range(3)]
    ids = [sorted(r.id for r in run.collect()) for run in runs]
    assert ids == [["sample_1", "sample_2", "sample_4"], ["sample_5", "sample_7", "sample_8"], ["sample_10", "sample_11"]]


def test_regen_resume_with_uuids(spark, tmp_path):
    out, calls = str(tmp_path / "regen"), []
    raw = _raw(spark, 9).withColumn("uuid", F.when(F.col("idx") % 2 == 0, F.concat(F.lit("u-"), F.col("idx").cast("string"))).when(F.col("idx") == 1, ""))
    raw = raw.withColumn("idx", F.when(F.col("idx") != 4, F.col("idx")))
    first = regenerate_dataset(spark, raw, _answer(calls, empty=("question 3 with plenty of text",)), out)
    assert {r.id: r.status for r in first.collect()} == {f"u-{i}" if i % 2 == 0 else f"sample_{i}": "error" if i == 3 else "ok" for i in range(9)}
    second = regenerate_dataset(spark, raw, _answer(calls), out)
    assert [(r.id, r.status) for r in second.collect()] == [("sample_3", "ok")]  # only what failed is asked for again
    assert regenerate_dataset(spark, raw, _answer(calls), out).count() == 0
    assert calls == [9, 1, 0]


def test_regenerate_joins(spark):
    from draftsmith.operators.regen import regenerate, run_summary

    prompts = spark.createDataFrame(
        [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 3, "user", "b"), (2, 0, "user", "c"), (2, 2, "user", "d"), (2, 4, "user", "e"), (3, 0, "user", "f")],
        "sample_id long, turn long, role string, text string",
    )
    replies = spark.createDataFrame(
        [(1, 1, "A", "think", None, 1.0004), (1, 3, "B", None, None, 2.0), (2, 0, "C", None, None, 1.0), (2, 2, "", None, None, 1.0), (2, 4, "E", None, None, 1.0), (3, 0, "F", None, "boom", 1.0)],
        "sample_id long, turn long, reply string, reasoning string, error string, latency_s double",
    )
    got = {r.sample_id: r for r in regenerate(prompts, replies).collect()}
    said = lambda i: [(t["from"], t["value"]) for t in got[i].conversations]
    assert said(1) == [("system", "s"), ("human", "a"), ("gpt", "A"), ("human", "b"), ("gpt", "B")]
    assert got[1].conversations[2].reasoning_content == "think" and got[1].latency_s == 3.0 and got[1].error is None
    assert said(2) == [("human", "c"), ("gpt", "C"), ("human", "d")] and got[2].error == "empty reply at turn 2"
    assert said(3) == [("human", "f")] and got[3].error == "boom at turn 0" and got[3].total_tokens is None
    assert {r.status: r.n for r in run_summary(regenerate(prompts, replies)).collect()} == {"ok": 1, "error": 2}


def test_backfill_by_rank(spark, tmp_path):
    prepared = spark.createDataFrame([(i, [i, i + 1], [True, True], 2) for i in range(10)], "sample_id long, input_ids array<long>, loss_mask array<boolean>, seq_len int")
    existing = spark.createDataFrame([(2,), (5,), (7,)], "sample_id long")
    made = spark.sparkContext.accumulator(0)

    def generate(rows):
        def run(parts):
            for p in parts:
                made.add(len(p))
                yield p.rename(columns={"input_ids": "token_ids"}).assign(hidden_states=[[[float("nan") if i == 3 else 0.5], [0.5]] for i in p["sample_id"]])

        return rows.mapInPandas(run, "sample_id long, token_ids array<long>, hidden_states array<array<float>>")

    store = str(tmp_path / "store")
    out = backfill(spark, prepared, existing, generate, store=store, world_size=2, rank=0)
    assert {r.sample_id: r.ok for r in out.collect()} == {0: True, 1: True, 3: False, 4: True} and out.count() == 4
    assert made.value == 4  # asked once for each missing row
    assert sorted(r.sample_id for r in spark.read.parquet(f"{store}/data").collect()) == [0, 1, 4]
    assert [(r.sample_id, r.reason) for r in spark.read.parquet(f"{store}/errors").collect()] == [(3, "nan in hidden states")]


def test_evaluate_files(spark, tmp_path):
    m = lambda v: {"successful": {"mean": v, "median": v, "sum": v}}
    bench = lambda rate, lat: {"config": {"strategy": {"type_": "constant", "rate": rate}},
                               "metrics": {"requests_per_second": m(rate), "request_latency": m(lat), "inter_token_latency_ms": m(1.0),
                                           "time_to_first_token_ms": m(1.0), "output_tokens_per_second": m(1.0), "output_tokens": m(1.0)}}
    p = tmp_path / "sweeps_qa.json"
    p.write_text(json.dumps({"benchmarks": [bench(1.0, 1.0), bench(2.0, 2.0), bench(4.0, 5.0)], "args": {"data_args": [{"data_files": "qa.jsonl"}]}}))
    q = tmp_path / "sweeps_qa_spec.json"
    q.write_text(json.dumps({"benchmarks": [bench(1.0, 0.5), bench(2.0, 1.0), bench(4.0, 2.0)], "args": {"data_args": [{"data_files": "qa.jsonl"}]}}))
    before, after = tmp_path / "m0.txt", tmp_path / "m1.txt"
    before.write_text("e:spec_decode_num_drafts_total 10\ne:spec_decode_num_accepted_tokens_total 5\n")
    after.write_text("e:spec_decode_num_drafts_total 30\ne:spec_decode_num_accepted_tokens_total 25\n"
                     'e:spec_decode_num_accepted_tokens_per_pos_total{position="0"} 12\n')
    rows = evaluate_subset(spark, "qa", str(p), str(before), str(after), str(tmp_path / "out.csv")).collect()
    assert len(rows) == 3 and all(abs(r.acceptance_length - 2.0) < 1e-12 for r in rows)
    assert rows[0].acceptance_at_pos_0 == 12 / 20
    sp = speedup(spark, [f"B={p}"], [f"T={q}"]).collect()
    assert len(sp) == 200 and min(r.speedup for r in sp) > 1.5


def test_backfill_with_pandas_generator(spark, tmp_path):
    import pandas as pd

    from draftsmith.operators.resume import artefact_generator

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "sample_id": pdf["sample_id"],
            "token_ids": pdf["input_ids"],
            "hidden_states": [[[float(t)] for t in ids] for ids in pdf["input_ids"]],
        })

    prepared = spark.createDataFrame([(i, [i, i + 1], [True, True], 2) for i in range(6)], "sample_id long, input_ids array<long>, loss_mask array<boolean>, seq_len int")
    existing = spark.createDataFrame([(1,)], "sample_id long")
    out = backfill(spark, prepared, existing, artefact_generator(states), store=str(tmp_path / "store")).collect()
    assert sorted(r.sample_id for r in out) == [0, 2, 3, 4, 5] and all(r.ok for r in out)


def test_a_generator_gets_bounded_frames(spark):
    """One Arrow batch of 3,000 rows; each call sees a run of rows of bounded tokens, all rows once."""
    import pandas as pd

    from draftsmith.operators.resume import PART_TOKENS, artefact_generator

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        n = sum(len(ids) for ids in pdf["input_ids"])
        if n > 2 * PART_TOKENS or n > PART_TOKENS and len(pdf) > 1 or list(pdf.index) != list(range(len(pdf))):
            raise ValueError(f"{n} tokens in {len(pdf)} rows")
        return pd.DataFrame({"sample_id": pdf["sample_id"], "token_ids": pdf["input_ids"], "hidden_states": [[[float(t)] for t in ids] for ids in pdf["input_ids"]]})

    size = F.when(F.col("id") == 1000, 2 * PART_TOKENS).when(F.col("id") % 7 == 0, 0).otherwise(100)
    ids = F.when(size > 0, F.sequence(F.col("id"), F.col("id") + size - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = spark.range(3000, numPartitions=1).select(F.col("id").alias("sample_id"), ids.alias("input_ids"))
    made = artefact_generator(states)(rows).select("sample_id", F.col("token_ids").alias("input_ids"), F.transform("hidden_states", lambda v: v[0].cast("bigint")).alias("states"))
    assert made.count() == 3000 and made.filter(F.col("input_ids") != F.col("states")).count() == 0
    assert made.select("sample_id", "input_ids").exceptAll(rows).count() == 0


def test_build_training_batches(spark):
    from draftsmith.plans.examples import build_training_batches

    rows = spark.createDataFrame(
        [(i, list(range(100 * i, 100 * i + 5 + (i * 7) % 30)), [bool(k % 3) for k in range(5 + (i * 7) % 30)]) for i in range(40)],
        "sample_id long, input_ids array<long>, loss_mask array<boolean>",
    )
    b = build_training_batches(rows, 64, 2, seed=1, step="shift", anchors=(4, 3, 999)).collect()
    assert b and all(len(r.input_ids) == 64 and len(r.document_ids) == 64 and sum(r.lengths) <= 64 for r in b)
    # every sample appears at most once across all bins, and the shift removed one token per sample
    used = sum(sum(r.lengths) for r in b)
    assert used <= sum(4 + (i * 7) % 30 for i in range(40))
    assert all(len(r.anchors) == 4 and len(r.blocks) == 12 for r in b)
    resumed = build_training_batches(rows, 64, 2, seed=1, resume_batches=2)
    assert resumed.agg(F.min("batch_no")).first()[0] == 2
