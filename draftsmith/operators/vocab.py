"""Token frequencies and draft vocabularies.

Frequencies are a plain ``groupBy(token_id).count()``: Spark's partial
(map-side) aggregation combines counts inside each task before the shuffle,
so a hot token (one id holding a third of all tokens) costs one row per task
in the exchange, not one row per occurrence.

The draft vocabulary is bounded by ``draft_vocab_size`` rows and the target
map by ``target_vocab_size`` rows — both are model constants, not data
sizes, which is what makes their single-partition steps and broadcasts safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftsmith.session import broadcast_bounded


def token_frequency(rows: DataFrame) -> DataFrame:
    """A1: ``(token_id, freq)`` over trainable tokens of prepared rows."""
    toks = rows.select(F.explode(F.arrays_zip("input_ids", "loss_mask")).alias("t"))
    return (
        toks.filter(F.col("t.loss_mask"))
        .groupBy(F.col("t.input_ids").alias("token_id"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )


def combine_frequencies(*tables: DataFrame) -> DataFrame:
    """A2: union several frequency tables and sum per token."""
    if not tables:
        raise ValueError("no frequency tables given")
    u = tables[0].select("token_id", "freq")
    for t in tables[1:]:
        u = u.unionByName(t.select("token_id", "freq"))
    return u.groupBy("token_id").agg(F.sum("freq").cast("bigint").alias("freq"))


def select_draft_tokens(spark: SparkSession, freq: DataFrame, draft_vocab_size: int) -> DataFrame:
    """Top ``k`` ids by (freq desc, id asc), filled with the smallest unused ids.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject: each task keeps
    its own top ``k`` and only ``k`` rows per task reach the final merge.
    The fill reads ``range(k)`` — at most ``k`` candidates are ever needed,
    because at most ``k`` ids can be taken already.
    """
    k = int(draft_vocab_size)
    # Fill candidates: ids below k that have no frequency at all.  If there are
    # at least k counted ids the fill is never reached; otherwise every counted
    # id is selected and the fill supplies the smallest unused ids — the same
    # selection as "top k, then fill", in one ordered pass.
    counted_small = freq.select("token_id").filter(F.col("token_id") < k)  # at most k rows
    fill = (
        spark.range(k)
        .select(F.col("id").alias("token_id"))
        .join(broadcast_bounded(counted_small, k, "ids below k"), "token_id", "left_anti")
        .select("token_id", F.lit(1).alias("_prio"), F.lit(None).cast("bigint").alias("_f"))
    )
    ranked = freq.select("token_id", F.lit(0).alias("_prio"), F.col("freq").cast("bigint").alias("_f"))
    return (
        ranked.unionByName(fill)
        .orderBy("_prio", F.col("_f").desc_nulls_last(), "token_id")
        .limit(k)
        .select("token_id")
    )


def vocab_maps(selected: DataFrame, target_vocab_size: int, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """W11 + O5: ``d2t(draft_id, target_id, offset)`` and ``t2d(target_id, in_draft)``.

    ``draft_id`` is the rank of the selected id; ``offset = target - draft``.
    ``selected`` has at most ``draft_vocab_size`` rows, so the un-partitioned
    window is a bounded single-task step.
    """
    d2t = selected.select(
        (F.row_number().over(Window.orderBy("token_id")) - 1).cast("bigint").alias("draft_id"),
        F.col("token_id").cast("bigint").alias("target_id"),
    ).withColumn("offset", F.col("target_id") - F.col("draft_id"))
    t2d = (
        spark.range(target_vocab_size)
        .select(F.col("id").alias("target_id"))
        .join(selected.select(F.col("token_id").alias("target_id"), F.lit(True).alias("in_draft")), "target_id", "left")
        .select("target_id", F.coalesce("in_draft", F.lit(False)).alias("in_draft"))
    )
    return d2t, t2d


def validate_vocab_maps(d2t: DataFrame, t2d: DataFrame, draft_vocab_size: int, target_vocab_size: int) -> None:
    """Sizes and the number of selected ids must agree; raises otherwise."""
    n_d2t = d2t.count()
    t = t2d.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("in_draft").cast("int")).alias("sel")).first()
    if n_d2t != draft_vocab_size:
        raise ValueError(f"d2t has {n_d2t} entries, expected {draft_vocab_size}")
    if t["n"] != target_vocab_size:
        raise ValueError(f"t2d has {t['n']} entries, expected {target_vocab_size}")
    if (t["sel"] or 0) != draft_vocab_size:
        raise ValueError(f"t2d selects {t['sel']} ids, expected {draft_vocab_size}")


def draft_to_target(draft_ids: DataFrame, d2t: DataFrame, draft_col: str = "draft_id") -> DataFrame:
    """``target = draft + offset`` by an equi join on the map (the planner
    broadcasts it when it is small)."""
    m = d2t.select(F.col("draft_id").alias(draft_col), "offset")
    return draft_ids.join(m, draft_col, "left").withColumn("target_id", F.col(draft_col) + F.col("offset")).drop("offset")


def prune_to_draft(df: DataFrame, t2d: DataFrame, token_col: str = "token_id") -> DataFrame:
    """Keep rows whose token is in the draft vocabulary (semi join)."""
    sel = t2d.filter("in_draft").select(F.col("target_id").alias(token_col))
    return df.join(sel, token_col, "left_semi")
