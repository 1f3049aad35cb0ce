"""Normalisation, dropout, prompt extraction (FIXTURES 1-3, 8, 15, 16, 34)."""

import random

from pyspark.sql import functions as F

from draftsmith.operators.normalize import drop_empty_conversations, extract_prompt_turns, normalize_turns, record_id
from draftsmith.sources.conversations import RAW_SCHEMA, normalize_input_output, to_turns


def _turns(spark, rows):
    schema = "conv_id long, turn long, `from` string, role string, value string, content string, tool_call_id string, reasoning_content string"
    return spark.createDataFrame(rows, schema)


def test_role_map_and_content(spark):
    df = _turns(spark, [
        (1, 0, "human", None, "What is the capital of France?", None, None, None),
        (1, 1, "gpt", None, "Paris is the capital of France.", None, None, None),
    ])
    out = normalize_turns(df).orderBy("turn").collect()
    assert [r.role for r in out] == ["user", "assistant"]
    assert [r.text for r in out] == ["What is the capital of France?", "Paris is the capital of France."]


def test_unknown_role_dropped(spark):
    df = _turns(spark, [
        (1, 0, None, "user", None, "hi", None, None),
        (1, 1, None, "narrator", None, "...", None, None),
        (1, 2, None, "assistant", None, "hello", None, None),
    ])
    out = normalize_turns(df).orderBy("turn").collect()
    assert [r.role for r in out] == ["user", "assistant"]


def test_empty_content_falls_through_and_fields_kept(spark):
    df = _turns(spark, [
        (1, 0, None, "user", None, "call a tool", None, None),
        (1, 1, None, "assistant", "", None, None, "thinking..."),
        (1, 2, None, "tool", None, "42", "call_1", None),
    ])
    out = {r.turn: r for r in normalize_turns(df).collect()}
    assert out[1].text == ""
    assert out[1].thinking == "thinking..." and out[1].reasoning_content == "thinking..."
    assert out[2].tool_call_id == "call_1" and out[0].tool_call_id is None


def _py_dropout(roles, n_keep):
    kept = []
    for i, r in enumerate(roles):
        if r not in ("user", "assistant", "system", "tool", "human", "gpt"):
            continue
        kept.append(i)
        if i + 1 >= n_keep and r in ("assistant", "gpt"):
            break
    return kept


def test_turn_dropout_matches_plain_python(spark):
    rng = random.Random(3)
    rows = []
    for cid in range(60):
        n = rng.randint(1, 8)
        for t in range(n):
            rows.append((cid, t, None, rng.choice(["user", "assistant", "assistant", "system", "odd"]), None, f"t{t}", None, None))
    df = _turns(spark, rows)
    seed = 7
    got = normalize_turns(df, turn_dropout=True, seed=seed)
    keys = {r.sample_id: r.k for r in df.select(F.col("conv_id").alias("sample_id"), F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("conv_id").cast("string"))), 1, 8), 16, 10).cast("long").alias("k")).distinct().collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r[3])
    gk = {}
    for r in got.collect():
        gk.setdefault(r.sample_id, []).append(r.turn)
    for cid, roles in by_conv.items():
        n_keep = keys[cid] % len(roles) + 1
        exp = _py_dropout(roles, n_keep)
        assert sorted(gk.get(cid, [])) == exp, (cid, roles, n_keep)


def test_drop_empty(spark):
    """Only a conversation without a kept turn goes; empty texts stay, and a
    given but empty ``from`` does not fall back to ``role``."""
    df = _turns(spark, [(1, 0, None, "user", None, "", None, None), (2, 0, None, "user", None, "x", None, None), (3, 0, None, "narrator", None, "x", None, None), (4, 0, "", "user", None, "x", None, None)])
    out = drop_empty_conversations(normalize_turns(df)).select("sample_id").distinct().collect()
    assert sorted(r.sample_id for r in out) == [1, 2]


def test_input_output_normaliser(spark):
    df = spark.createDataFrame([{"idx": 0, "input": [{"role": "user", "content": "hi"}], "output": "hello"}], RAW_SCHEMA)
    t = normalize_turns(to_turns(normalize_input_output(df)), id_col="idx").orderBy("turn").collect()
    assert [(r.role, r.text) for r in t] == [("user", "hi"), ("assistant", "hello")]


PROMPT_CASES = [
    # (turns [(role, text)], prompt, expected [(role, text)])
    ([("user", "q1"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a2")], None, [("user", "q1"), ("user", "q2")]),
    ([("system", "sys"), ("user", "q"), ("assistant", "a")], None, [("system", "sys"), ("user", "q")]),
    ([("human", "q"), ("gpt", "a")], None, [("user", "q")]),
    ([], "fallback", [("user", "fallback")]),
    ([("system", "only")], "p", [("user", "p")]),
    ([("user", ""), ("assistant", "a")], "p", [("user", "p")]),
    ([("system", "only")], None, []),
]


def test_prompt_extraction_cases(spark):
    rows, prompts = [], []
    for cid, (turns, prompt, _) in enumerate(PROMPT_CASES):
        for t, (role, text) in enumerate(turns):
            rows.append((cid, t, role, text))
        prompts.append((cid, prompt))
    turns_df = spark.createDataFrame(rows, "sample_id long, turn long, role string, text string")
    prom = spark.createDataFrame(prompts, "sample_id long, prompt string")
    got = {}
    for r in extract_prompt_turns(turns_df, prom).orderBy("sample_id", "turn").collect():
        got.setdefault(r.sample_id, []).append((r.role, r.text))
    for cid, (_, _, exp) in enumerate(PROMPT_CASES):
        assert got.get(cid, []) == exp, cid


def test_record_id(spark):
    df = spark.createDataFrame([("u1", 3), ("", 4), (None, 5)], "uuid string, idx long")
    assert [r[0] for r in df.select(record_id(F.col("uuid"), F.col("idx"))).collect()] == ["u1", "sample_4", "sample_5"]
