"""Backfill job: prepared rows × existing artefacts → missing rows → validated
artefacts (SURVEY §3 "Backfill").

``prepared ⋈ existing (left anti) → generate → validate (J5) → append``.
Generated rows are written once, with the ids they were made for, and checked
from what was written; rows that fail go to an error folder, so that a reader
of the store never takes them for present.  Rank chunking (O7) is only used
when external workers split the work.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from draftsmith.operators.resume import backfill_plan, missing_ids, validate_artefacts


def backfill(
    spark: SparkSession,
    prepared: DataFrame,
    existing: DataFrame,
    generate: Callable[[DataFrame], DataFrame],
    store: str,
    world_size: int | None = None,
    rank: int | None = None,
    max_samples: int | None = None,
) -> DataFrame:
    """Generate artefacts for rows whose ``sample_id`` is not in ``existing``.

    With ``world_size``/``rank`` only that rank's contiguous chunk of the
    first ``max_samples`` indices is processed (O7, Q7).  ``generate`` is asked
    once; its rows land in ``<store>/_made/<run>``, valid ones are appended to
    ``<store>/data`` and the others to ``<store>/errors`` with a reason.
    Returns the rows of this run with ``ok`` and ``reason``, read back.
    """
    ids = prepared.select("sample_id")
    if world_size is not None:
        plan = backfill_plan(ids, existing, world_size, max_samples)
        if rank is not None:
            plan = plan.filter(plan["owner"] == rank)
        todo = prepared.join(plan.select("sample_id"), "sample_id", "left_semi")
    else:
        todo = missing_ids(prepared, existing)
    root, run = store.rstrip("/"), uuid.uuid4().hex
    raw = f"{root}/_made/{run}"
    generate(todo.select("sample_id", "input_ids")).write.parquet(raw)
    made = spark.read.parquet(raw)
    checked = made.join(validate_artefacts(prepared, made), "sample_id")
    checked.write.partitionBy("ok").parquet(f"{root}/_checked/{run}")
    done = spark.read.schema(checked.schema).parquet(f"{root}/_checked/{run}")
    columns = made.columns
    done.filter("ok").select(*columns).write.mode("append").parquet(f"{root}/data")
    done.filter("NOT ok").select(*columns, "reason").write.mode("append").parquet(f"{root}/errors")
    return done
