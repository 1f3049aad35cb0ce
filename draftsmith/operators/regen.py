"""Regenerated chats from a table of replies.

Replies come as a table, one row per answered user turn, from whatever serves
the model (:data:`Answer`: prompt turns in, reply rows out).  Assembling is an
equi join on ``(sample_id, turn)`` and one aggregate per conversation: a turn
takes the output places ``2 * turn`` (itself) and ``2 * turn + 1`` (its reply),
a conversation fails at its first user turn without a usable reply.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftsmith.sources.commits import write_once

# prompt turns (sample_id, turn, role, text) -> replies (REPLY_FIELDS)
Answer = Callable[[DataFrame], DataFrame]

REPLY_FIELDS = {
    "reply": "string", "reasoning": "string", "finish_reason": "string",
    "prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint",
    "latency_s": "double", "error": "string",
}


def regenerate(prompt_turns: DataFrame, replies: DataFrame) -> DataFrame:
    """P28 + P29 + P30 (+ F16): one row per conversation.

    ``prompt_turns(sample_id, turn, role, text)`` as left by
    :func:`draftsmith.operators.normalize.extract_prompt_turns`;
    ``replies(sample_id, turn, ...)`` with any of ``REPLY_FIELDS``.  A user
    turn fails when its reply is missing or empty or carries an error; then
    the conversation has status ``error`` and keeps its turns up to that one.
    Usage and latency (three decimals) are summed over the kept replies.
    """
    r = replies.select(
        F.col("sample_id").alias("_rid"), F.col("turn").alias("_rturn"),
        *[(F.col(c) if c in replies.columns else F.lit(None)).cast(t).alias(c) for c, t in REPLY_FIELDS.items()],
    )
    user = F.col("role") != "system"
    j = prompt_turns.join(r, (F.col("sample_id") == F.col("_rid")) & (F.col("turn") == F.col("_rturn")) & user, "left")
    good = F.col("error").isNull() & (F.coalesce(F.col("reply"), F.lit("")) != "")
    j = j.withColumn("_bad", user & ~good)
    said = F.struct(F.when(user, "human").otherwise("system").alias("from"), F.col("text").alias("value"), F.lit(None).cast("string").alias("reasoning_content"))
    answer = F.struct(F.lit("gpt").alias("from"), F.col("reply").alias("value"), F.col("reasoning").alias("reasoning_content"))
    place = lambda k, t, reason: F.struct((F.col("turn") * 2 + k).alias("at"), t.alias("t"), reason.alias("reason"))
    none = F.lit(None).cast("string")
    turn = F.struct(
        F.col("turn").alias("turn"),
        F.array_compact(F.array(place(0, said, none), F.when(user & good, place(1, answer, F.col("finish_reason"))))).alias("out"),
        *[F.when(user & good, F.col(c)).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens", "latency_s")],
    )
    per = j.groupBy("sample_id").agg(
        F.bool_or("_bad").alias("_failed"),
        F.min(F.when(F.col("_bad"), F.col("turn"))).alias("_cut"),
        F.min_by(F.coalesce(F.col("error"), F.lit("empty reply")), F.when(F.col("_bad"), F.col("turn"))).alias("_why"),
        F.collect_list(turn).alias("_turns"),
    )
    per = per.withColumn("_turns", F.filter("_turns", lambda t: F.col("_cut").isNull() | (t["turn"] <= F.col("_cut"))))
    per = per.withColumn("_out", F.sort_array(F.flatten(F.transform("_turns", lambda t: t["out"]))))
    total = lambda c, zero: F.aggregate("_turns", zero, lambda a, t: a + F.coalesce(t[c], zero))
    ok = ~F.col("_failed")
    answers = F.filter("_out", lambda x: x["t"]["from"] == "gpt")
    return per.select(
        "sample_id",
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.transform("_out", lambda x: x["t"]).alias("conversations"),
        F.when(ok, F.transform(answers, lambda x: x["reason"])).alias("finish_reasons"),
        *[F.when(ok, total(c, F.lit(0).cast("bigint"))).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")],
        F.when(ok, F.round(total("latency_s", F.lit(0.0)), 3)).alias("latency_s"),
        F.when(~ok, F.concat(F.col("_why"), F.lit(" at turn "), F.col("_cut").cast("string"))).alias("error"),
    )


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """K4: one pass, good and failed rows land in ``status=ok`` / ``status=error``."""
    results.write.mode(mode).partitionBy("status").json(path)


def write_results_once(results: DataFrame, path: str, job: str) -> bool:
    """K4 for a batch job that may be run again: the rows of ``job`` are added once,
    whatever happened to earlier tries (read them with ``read_committed``)."""
    return write_once(results, path, job, "json", ("status",))


def run_summary(results: DataFrame) -> DataFrame:
    """``(status, n)``."""
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# Regeneration sources — dataset, prompt field, default split, subset.
REGEN_SOURCES = {
    "magpie": {"id": "Magpie-Align/Magpie-Llama-3.1-Pro-300K-Filtered", "prompt_field": "instruction", "default_split": "train"},
    "ultrachat": {"id": "HuggingFaceH4/ultrachat_200k", "prompt_field": "prompt", "default_split": "train_sft"},
    "gsm8k": {"id": "openai/gsm8k", "prompt_field": "question", "default_split": "train", "subset": "main"},
}


def read_regen_source(spark, name: str, data_root: str, split: str | None = None, subset: str | None = None, stream: bool = False):
    """A regeneration source from the registry (prompt field, default split,
    subset) as a batch or a streaming scan of its JSON folder."""
    from draftsmith.sources.conversations import RAW_SCHEMA

    cfg = REGEN_SOURCES[name]
    parts = [data_root.rstrip("/"), cfg["id"], subset if subset is not None else cfg.get("subset"), split or cfg["default_split"]]
    path = "/".join(p for p in parts if p)
    reader = spark.readStream if stream else spark.read
    df = reader.schema(RAW_SCHEMA).option("recursiveFileLookup", "true").json(path)
    return df, cfg["prompt_field"]


def regen_todo(prompt_turns: DataFrame, seen: DataFrame | None = None, limit: int | None = None, order: str = "sample_id") -> DataFrame:
    """J1 + O4: drop conversations already in the output, then keep the first
    ``limit`` remaining conversations in ``order`` — the limit counts *after*
    the filters and the resume, as in the reference (top-k of the ids alone).
    """
    todo = prompt_turns
    if seen is not None:
        todo = todo.join(seen.select("sample_id"), "sample_id", "left_anti")
    if limit is None:
        return todo
    ids = todo.groupBy("sample_id").agg(F.min(order).alias("_o")).orderBy("_o", "sample_id").limit(limit).select("sample_id")
    return todo.join(ids, "sample_id", "left_semi")
