"""Regen job: chats → prompts → regenerated chats + error table (SURVEY §3 "Regen").

Filters (language, P25), the resume anti-join (J1 against the ids already
written, S20) and the row limit (O4, counted after both) run before replies
are asked for.  Each run writes its own folder once and returns a read of it,
so replies are never asked for twice.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftsmith.operators.normalize import extract_prompt_turns, record_id
from draftsmith.operators.regen import Answer, regen_todo, regenerate, write_results
from draftsmith.sources.conversations import language_filter, seen_ids, to_turns


def path_missing(e: AnalysisException) -> bool:
    """Nothing has been written yet."""
    return e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def regenerate_dataset(
    spark: SparkSession,
    raw: DataFrame,
    answer: Answer,
    out: str,
    prompt_field: str = "prompt",
    language: str | None = None,
    limit: int | None = None,
    resume: bool = True,
) -> DataFrame:
    """``raw`` is the array form (``idx``, ``uuid``, ``conversations`` / ``messages``,
    the prompt field, ``language``).  A record is known by its ``uuid``, else
    ``sample_<idx>`` (P26), in the output and for the resume alike.  Writes
    ``out/run=<id>/status=ok|error`` and returns the rows of this run."""
    src = language_filter(raw, language).withColumn("sample_id", record_id(F.col("uuid"), F.col("idx")))
    if "messages" in src.columns and src.schema["messages"].dataType == src.schema["conversations"].dataType:
        # ``messages`` wins when present and non-empty (P24), as in the reference
        src = src.withColumn("conversations", F.coalesce(F.when(F.size("messages") > 0, F.col("messages")), F.col("conversations")))
    turns = to_turns(src.select("sample_id", "conversations"), "sample_id")
    prompts = src.select("sample_id", F.col(prompt_field).alias("prompt"))
    todo = extract_prompt_turns(turns, prompts)
    seen = None
    if resume:
        try:
            seen = seen_ids(spark, f"{out.rstrip('/')}/run=*/status=ok").withColumnRenamed("key", "sample_id")
        except AnalysisException as e:
            if not path_missing(e):
                raise
    if limit is not None:
        todo = todo.join(src.select("sample_id", F.coalesce(F.col("idx"), F.lit(0)).alias("_idx")).dropDuplicates(["sample_id"]), "sample_id")
        todo = regen_todo(todo, seen, limit, order="_idx").drop("_idx")
    else:
        todo = regen_todo(todo, seen)
    run = uuid.uuid4().hex
    rows = f"{out.rstrip('/')}/_rows/run={run}"
    regenerate(todo, answer(todo)).withColumnRenamed("sample_id", "id").write.parquet(rows)
    res = spark.read.parquet(rows)
    write_results(res, f"{out.rstrip('/')}/run={run}", "errorifexists")
    return res
