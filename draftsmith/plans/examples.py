"""Examples job: prepared rows → packed, collated training batches (SURVEY §1 "Examples").

``(id, len)`` → packing plan (O8/O9, the payload is not read) → per-sample
preprocessing by name (X4, e.g. the next-token shift P39) → rows joined to
their bin → one collated row per (batch, replica) in the plan's order (P43) →
optional anchors and blocks for block models (O13, P44–P46).  One exchange for
the join, one for the collate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftsmith.operators.examples import anchors_in_row, blocks_in_row, collate_rows, preprocess
from draftsmith.operators.packing import pack_batches, skip_batches


def build_training_batches(
    rows: DataFrame,
    max_len: int,
    replicas: int,
    seed: int = 0,
    epoch: int = 0,
    step: str = "none",
    resume_batches: int = 0,
    anchors: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Batch rows ``(batch_no, replica, input_ids, loss_mask, position_ids,
    document_ids, lengths[, anchors, blocks])``.

    ``resume_batches`` skips the first batches (O12) before any
    payload is joined; ``anchors=(num_anchors, block_size, mask_id)`` adds the
    block-model inputs.
    """
    lengths = rows.select("sample_id", F.size("input_ids").cast("bigint").alias("length"))
    plan = skip_batches(pack_batches(lengths, max_len, replicas, seed=seed, epoch=epoch), resume_batches)
    prepared = preprocess(rows.select("sample_id", "input_ids", "loss_mask"), step)
    j = prepared.join(plan.select("sample_id", "batch_no", "replica", "item"), "sample_id")
    j = j.withColumn("_bin", F.struct("batch_no", "replica"))
    b = collate_rows(j.select("_bin", "item", "input_ids", "loss_mask"), "_bin", "item", max_len)
    b = b.select("batch_id.*", *[c for c in b.columns if c != "batch_id"])
    if anchors is not None:
        n, block, mask_id = anchors
        key = F.concat_ws(":", F.col("batch_no").cast("string"), F.col("replica").cast("string"))
        b = b.withColumn("anchors", anchors_in_row(key, F.col("loss_mask"), n, block, max_len, seed + epoch))
        b = b.withColumn("blocks", blocks_in_row(F.col("anchors"), F.col("input_ids"), F.col("loss_mask"), block, mask_id))
    return b
