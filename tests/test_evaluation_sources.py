"""Evaluation operators and file sources (FIXTURES 11-13, 35)."""

import json
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftsmith.operators.evaluation import (
    acceptance_from_counters, accumulate, counter_delta, generation_lengths, interpolate_speedup, next_pow2, parse_exposition,
)
from draftsmith.sources.benchmarks import read_curves, read_generation_lengths, read_labelled, read_sweeps
from draftsmith.sources.conversations import load_raw, parse_hub_spec, seen_ids

NS = "eng"


def test_exposition_parse_and_acceptance(spark):
    text = [
        "# HELP something", f"{NS}:spec_decode_num_drafts_total 10", f"{NS}:spec_decode_num_draft_tokens_total 30",
        f"{NS}:spec_decode_num_accepted_tokens_total 12",
        f'{NS}:spec_decode_num_accepted_tokens_per_pos_total{{position="0"}} 7',
        f'{NS}:spec_decode_num_accepted_tokens_per_pos_total{{position="1"}} 4',
        f'{NS}:spec_decode_num_accepted_tokens_per_pos_total{{position="2"}} 1',
        f'{NS}:spec_decode_num_accepted_tokens_per_pos_total{{engine="1",position="0"}} 3',
        f"{NS}:requests_total 99", "garbage line",
    ]
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    parsed = parse_exposition(lines)
    acc = accumulate(parsed)
    res = {(r.metric, r.position): r.value for r in acceptance_from_counters(acc).collect()}
    assert res[("acceptance_length", -1)] == pytest.approx(1 + 12 / 10)
    assert res[("acceptance_at_pos", 0)] == pytest.approx(1.0)  # 7 + 3 summed across engines (Q3)
    assert res[("acceptance_at_pos", 2)] == pytest.approx(0.1)
    empty = acceptance_from_counters(acc.filter(F.col("name") != "num_drafts"), no_drafts_length=1.0)
    assert {r.metric: r.value for r in empty.collect() if r.position < 0}["acceptance_length"] == 1.0


def test_counter_delta_pads_missing(spark):
    a = spark.createDataFrame([("x", 0, 5.0), ("x", 1, 2.0)], "name string, position int, value double")
    b = spark.createDataFrame([("x", 0, 1.0), ("x", 2, 1.0)], "name string, position int, value double")
    d = {r.position: r.value for r in counter_delta(a, b).collect()}
    assert d == {0: 4.0, 1: 2.0, 2: -1.0}


@pytest.mark.parametrize("per_pos,length", [([34.36, 9.00, 1.27], 1.4463), ([89.36, 72.34, 61.70], 3.234)])
def test_published_acceptance_arithmetic(spark, per_pos, length):
    rows = [("num_drafts", -1, 10000.0), ("num_accepted_tokens", -1, sum(per_pos) * 100)]
    rows += [("num_accepted_tokens_per_pos", i, v * 100) for i, v in enumerate(per_pos)]
    acc = spark.createDataFrame(rows, "name string, position int, value double")
    r = {(x.metric, x.position): x.value for x in acceptance_from_counters(acc).collect()}
    assert r[("acceptance_length", -1)] == pytest.approx(length, abs=1e-3)


def test_generation_lengths(spark):
    vals = [5, 9, 100, 33, 64]
    df = spark.createDataFrame([("s", v) for v in vals], "subset string, output_tokens long")
    r = generation_lengths(df).first()
    assert r["median"] == statistics.median(vals) and r.max_tokens == next_pow2(statistics.median(vals)) == 64


def test_speedup_matches_numpy(spark):
    bx, by = [1.0, 2.0, 4.0, 8.0], [1.0, 1.5, 3.0, 7.0]
    tx, ty = [1.5, 3.0, 6.0, 9.0], [0.8, 1.0, 2.0, 4.0]
    b = spark.createDataFrame([("s", x, y) for x, y in zip(bx, by)] + [("only_b", 1.0, 1.0)], "subset string, x double, y double")
    t = spark.createDataFrame([("s", x, y) for x, y in zip(tx, ty)], "subset string, x double, y double")
    r = interpolate_speedup(b, t, increasing=True).orderBy("i").collect()
    grid = np.linspace(1.5, 8.0, 200)
    exp = np.interp(grid, bx, by) / np.interp(grid, tx, ty)
    assert len(r) == 200 and {x.subset for x in r} == {"s"}
    assert np.allclose([x.speedup for x in r], exp)


def _bench(rate, strategy, lat):
    m = lambda v: {"successful": {"mean": v, "median": v, "sum": v * 10}}
    return {
        "config": {"strategy": {"type_": strategy, "rate": rate}},
        "metrics": {"requests_per_second": m(rate), "request_latency": m(lat), "inter_token_latency_ms": m(1.0),
                    "time_to_first_token_ms": m(2.0), "output_tokens_per_second": m(3.0), "output_tokens": m(4.0)},
        "requests": {"successful": [{"output_tokens": t} for t in (10, 30, 20)]},
    }


def test_sweep_and_gen_len_files(spark, tmp_path):
    doc = {"benchmarks": [_bench(1.0, "constant", 0.5), _bench(2.0, "constant", 0.7), _bench(9.0, "throughput", 2.0)],
           "args": {"data_args": [{"data_files": "/x/qa.jsonl"}]}}
    p = tmp_path / "sweeps_qa.json"
    p.write_text(json.dumps(doc))
    rows = read_sweeps(spark, str(p)).collect()
    assert {r.subset for r in rows} == {"qa"} and len(rows) == 2 and {r.strategy for r in rows} == {"constant"}
    g = read_generation_lengths(spark, str(p)).collect()
    assert sorted(r.output_tokens for r in g) == [10, 20, 30]
    c = read_labelled(spark, [f"A={p}"], "latency").orderBy("x").collect()
    assert [(r.x, r.y, r.label) for r in c] == [(1.0, 0.5, "A"), (2.0, 0.7, "A")]
    empty = tmp_path / "sweep_none.json"
    empty.write_text(json.dumps({"benchmarks": []}))
    with pytest.raises(ValueError):
        read_sweeps(spark, str(empty))


def test_curve_csv(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("subset,strategy,rps_median,latency_median_s\nrun_qa,constant,1.0,0.5\nrun_qa,throughput,9,9\nrun_qa,constant,bad,1\n")
    r = read_curves(spark, str(p), "latency").collect()
    assert [(x.subset, x.x, x.y) for x in r] == [("qa", 1.0, 0.5)]
    with pytest.raises(ValueError):
        read_curves(spark, str(tmp_path / "r.txt"), "latency")


def test_raw_sources(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    (tmp_path / "a.jsonl").write_text(json.dumps({"conversations": [{"from": "human", "value": "hi"}]}) + "\n" +
                                      json.dumps({"conversations": [{"from": "human", "value": "yo"}]}) + "\n")
    (tmp_path / "b.json").write_text(json.dumps([{"conversations": [{"role": "user", "content": "x"}]}]))
    (tmp_path / "nested" / "c.json").write_text(json.dumps({"conversations": [{"role": "user", "content": "y"}]}))
    assert load_raw(spark, str(tmp_path)).count() == 4
    (tmp_path / "empty").mkdir()
    with pytest.raises(Exception):
        load_raw(spark, str(tmp_path / "empty")).count()


def test_hub_spec():
    assert parse_hub_spec("hf:org/name") == ("org/name", None, "train")
    assert parse_hub_spec("hf:org/name:split") == ("org/name", None, "split")
    assert parse_hub_spec("hf:org/name:subset:split") == ("org/name", "subset", "split")
    for bad in ("hf:org/name:a:b:c", "hf:", "hf:org/name:", "hf:org/name:subset:", "hf:org/name::split"):
        with pytest.raises(ValueError):
            parse_hub_spec(bad)


def test_seen_ids_skip_broken_lines(spark, tmp_path):
    p = tmp_path / "out.jsonl"
    p.write_text('{"id": "a"}\nnot json\n{"metadata": {"idx": 7}}\n')
    assert sorted(r.key for r in seen_ids(spark, str(p)).collect()) == ["7", "a"]


def test_list_content_and_rows_without_ids(spark, tmp_path):
    from draftsmith.sources.conversations import is_multimodal, read_conversations, to_turns

    rows = [
        {"conversations": [{"role": "user", "content": [{"type": "text", "text": "what is "}, {"type": "image", "path": "a.jpg"}]}, {"role": "assistant", "content": "a cat"}]},
        {"conversations": [{"role": "user", "content": "[note] plain"}, {"role": "assistant", "content": "[1, 2]"}]},
        {"conversations": [{"role": "user", "content": "[note] plain"}, {"role": "assistant", "content": "[1, 2]"}]},
    ]
    p = tmp_path / "chats.jsonl"
    p.write_text("\n".join(json.dumps(r) for r in rows))
    raw = read_conversations(spark, str(p))
    got = sorted((r.m, r.t) for r in raw.select(is_multimodal("conversations").alias("m"), raw.conversations[0]["content"].alias("t")).collect())
    assert got == [(False, "[note] plain"), (False, "[note] plain"), (True, "what is <image>")]
    turns = to_turns(raw, "idx")
    assert turns.select("idx").distinct().count() == 3 and turns.filter("idx IS NULL").count() == 0
    assert turns.filter("parts IS NOT NULL").select(F.size("parts")).first()[0] == 2


def test_exposition_grammar(spark):
    lines = [
        "# TYPE eng:spec_decode_num_drafts counter",
        'eng:spec_decode_num_drafts_total{engine="0"} 12 1700000000000',
        'eng:spec_decode_num_draft_tokens_total{engine="0", note="a \\"quoted\\" }, b"} +Inf',
        "eng:spec_decode_num_accepted_tokens_total NaN",
        'eng:spec_decode_num_accepted_tokens_per_pos_total{engine="0",position="17"} 3e2',
        "eng:spec_decode_broken{ 4",
        "eng:other_total 5",
    ]
    got = {(r.name, r.position): r.value for r in parse_exposition(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got[("num_drafts", -1)] == 12.0 and got[("num_draft_tokens", -1)] == float("inf") and got[("num_accepted_tokens_per_pos", 17)] == 300.0
    assert got[("num_accepted_tokens", -1)] != got[("num_accepted_tokens", -1)] and len(got) == 4


def test_all_positions_get_a_column(spark):
    from draftsmith.plans.evaluate import acceptance_wide

    acc = spark.createDataFrame([("acceptance_at_pos", i, i / 20) for i in range(20)] + [("num_drafts", -1, 5.0)], "metric string, position int, value double")
    row = acceptance_wide(acc, "s").first()
    assert row.acceptance_at_pos_19 == 0.95 and row.num_drafts == 5.0 and row.subset == "s"


def test_curve_fit_is_the_least_squares_cubic(spark):
    from draftsmith.operators.evaluation import fit_curve

    rng = np.random.default_rng(4)
    x = np.sort(rng.uniform(0, 10, 9))
    y = 0.3 * x**3 - x + rng.normal(size=9)
    pts = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)] + [("b", 1.0, 2.0), ("c", 0.0, 1.0), ("c", 2.0, 5.0)], "subset string, x double, y double")
    got = {}
    for r in fit_curve(pts, ("subset",)).collect():
        got.setdefault(r.subset, []).append((r.x, r.y))
    dense = np.linspace(x.min(), x.max(), 300)
    assert np.allclose([q for _, q in sorted(got["a"])], np.polyval(np.polyfit(x, y, 3), dense), rtol=1e-6, atol=1e-6)
    assert got["b"] == [(1.0, 2.0)]
    assert np.allclose([q for _, q in sorted(got["c"])], np.linspace(1.0, 5.0, 300))


def test_median_from_counts(spark):
    vals = [("a", v) for v in (5, 1, 9, 9)] + [("b", 7)] + [("c", v) for v in (3, 1, 2)]
    got = {r.subset: (r["count"], r.median, r.min, r.max, r.max_tokens) for r in generation_lengths(spark.createDataFrame(vals, "subset string, output_tokens long")).collect()}
    assert got == {"a": (4, 7.0, 1, 9, 8), "b": (1, 7.0, 7, 7, 8), "c": (3, 2.0, 1, 3, 2)}
