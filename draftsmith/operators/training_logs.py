"""Training-log analytics.

Metric records are long tables ``(keys..., name, value)``.  Sum/total pairs
stay as two numbers until the final division (A11), so any number of
partial aggregates (tasks, ranks, batches) combine exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_record(df: DataFrame, id_cols: tuple[str, ...], sep: str = "/") -> DataFrame:
    """Nested struct / map columns → long ``(id..., key, value double)``.

    Struct fields become ``a/b/c`` keys (walked on the driver from the
    schema — metadata only); map columns contribute ``col/<map key>``.
    Non-numeric leaves are dropped.
    """
    leaves: list[Column] = []

    def walk(path: list[str], dtype, col: Column):
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk(path + [f.name], f.dataType, col[f.name])
        elif isinstance(dtype, T.MapType) and isinstance(dtype.valueType, T.NumericType):
            leaves.append(
                F.transform(
                    F.map_entries(col),
                    lambda e: F.struct(F.concat(F.lit(sep.join(path) + sep), e["key"].cast("string")).alias("key"), e["value"].cast("double").alias("value")),
                )
            )
        elif isinstance(dtype, T.NumericType):
            leaves.append(F.array(F.struct(F.lit(sep.join(path)).alias("key"), col.cast("double").alias("value"))))

    for f in df.schema.fields:
        if f.name not in id_cols:
            walk([f.name], f.dataType, F.col(f.name))
    if not leaves:
        raise ValueError("no numeric fields to flatten")
    return df.select(*id_cols, F.explode(F.flatten(F.array(*leaves))).alias("_kv")).select(*id_cols, "_kv.key", "_kv.value")


def normalize_counted(metrics: DataFrame, keys: tuple[str, ...], world_size: int = 1) -> DataFrame:
    """``x_sum / x_total`` → ``x`` (0 when total is 0); a ``_total`` without
    its ``_sum`` is dropped; every other metric is divided by ``world_size``."""
    name = F.col("name")
    kind = F.when(name.endswith("_sum"), "sum").when(name.endswith("_total"), "total").otherwise("other")
    prefix = F.when(kind == "sum", F.regexp_replace(name, "_sum$", "")).when(kind == "total", F.regexp_replace(name, "_total$", "")).otherwise(name)
    m = metrics.select(*keys, "name", "value", kind.alias("_kind"), prefix.alias("_prefix"))
    per = m.groupBy(*keys, "_prefix").agg(
        F.sum(F.when(F.col("_kind") == "sum", F.col("value"))).alias("_s"),
        F.sum(F.when(F.col("_kind") == "total", F.col("value"))).alias("_t"),
        F.count(F.when(F.col("_kind") == "sum", 1)).alias("_ns"),
        F.count(F.when(F.col("_kind") == "total", 1)).alias("_nt"),
        F.sum(F.when(F.col("_kind") == "other", F.col("value"))).alias("_o"),
        F.count(F.when(F.col("_kind") == "other", 1)).alias("_no"),
    )
    paired = per.filter((F.col("_ns") > 0) & (F.col("_nt") > 0)).select(
        *keys, F.col("_prefix").alias("name"), F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(0.0).alias("value")
    )
    lone_sum = per.filter((F.col("_ns") > 0) & (F.col("_nt") == 0)).select(
        *keys, F.concat(F.col("_prefix"), F.lit("_sum")).alias("name"), (F.col("_s") / world_size).alias("value")
    )
    other = per.filter(F.col("_no") > 0).select(*keys, F.col("_prefix").alias("name"), (F.col("_o") / world_size).alias("value"))
    return paired.unionByName(lone_sum).unionByName(other)


def epoch_metrics(batches: DataFrame, world_size: int = 1, epoch: str = "epoch", batch: str = "batch") -> DataFrame:
    """Per epoch, each metric summed over batches ÷ number of batches, then
    A11, names suffixed ``_epoch``."""
    counts = batches.groupBy(epoch).agg(F.countDistinct(batch).alias("_nb"))
    avg = batches.groupBy(epoch, "name").agg(F.sum("value").alias("_v")).join(counts, epoch)
    avg = avg.select(epoch, "name", (F.col("_v") / F.col("_nb")).alias("value"))
    out = normalize_counted(avg, (epoch,), world_size)
    return out.withColumn("name", F.concat("name", F.lit("_epoch")))


def best_epoch(epochs: DataFrame, metric: str = "loss_epoch", saved: Column | None = None) -> DataFrame:
    """The strictly smallest ``metric`` among saved epochs; the first epoch wins ties."""
    e = epochs.filter(F.col("name") == metric)
    if saved is not None:
        e = e.filter(saved)
    return e.agg(
        F.min_by("epoch", F.struct("value", "epoch")).alias("best_epoch"),
        F.min("value").alias("best_value"),
    )


def running_best(losses: DataFrame, run_keys: tuple[str, ...] = ()) -> DataFrame:
    """Best loss before each epoch and whether the epoch improved on it.

    The window is per run over its epochs (one row per epoch — tiny).
    """
    w = (Window.partitionBy(*run_keys) if run_keys else Window.partitionBy(F.lit(0))).orderBy("epoch")
    prev = F.min("value").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return losses.select(
        *run_keys, "epoch", "value", prev.alias("prev_best"),
        (F.col("value") < F.coalesce(prev, F.lit(float("inf")))).alias("improved"),
    )


def failure_streaks(
    attempts: DataFrame, threshold: int, key: str = "endpoint", order: str = "t", ok: str = "ok", bucket_width: int = 1 << 20
) -> DataFrame:
    """Consecutive failures, reset by a success; abort at ``threshold``.

    Exact, and safe when one key holds a large share of all attempts: the
    order axis is cut into buckets of ``bucket_width``, so no window ever
    spans a whole key.

    1. per (key, bucket): rows, whether a success occurred, and the
       failures after the bucket's last success;
    2. carry-in of each bucket = failures in a row at the end of all earlier
       buckets (gaps and islands over the small bucket table);
    3. inside each bucket, streak = failures since the last success (window
       per (key, bucket)) plus the carry for rows before the first success.

    Returns every attempt with ``streak`` and ``abort``; attempts without a key
    or a time belong to no streak (zero, no abort).
    """
    known = F.col(key).isNotNull() & F.col(order).isNotNull()
    apart = attempts.filter(~known).select("*", F.lit(0).cast("bigint").alias("streak"), F.lit(False).alias("abort"))
    b = attempts.withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket_width)).cast("bigint"))
    # the join below would add these not-null filters to one branch only; stating
    # them here keeps both uses of the partitioned pass identical (one exchange)
    b = b.filter(F.col(key).isNotNull() & F.col("_bucket").isNotNull())
    fail = (~F.col(ok)).cast("int")
    part = Window.partitionBy(key, "_bucket")
    run = part.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    # one pass over the attempts, partitioned by (key, bucket): local islands
    # and streaks, plus what the bucket summary needs (no second scan)
    local = b.withColumn("_island", F.sum(F.col(ok).cast("int")).over(run))
    local = (
        local.withColumn("_st", F.sum(fail).over(Window.partitionBy(key, "_bucket", "_island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_last_isl", F.max("_island").over(part))
    )
    # per bucket: rows, whether a success occurred, failures after its last success
    summary = local.groupBy(key, "_bucket").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max(F.col(ok).cast("int")).alias("_has_ok"),
        F.sum(F.when((F.col("_island") == F.col("_last_isl")) & ~F.col(ok), 1).otherwise(0)).alias("_trail"),
    )
    # carry-in = failures in a row at the end of all earlier buckets (small table)
    wb = Window.partitionBy(key).orderBy("_bucket")
    s = summary.withColumn("_isl", F.coalesce(F.sum("_has_ok").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_prev_trail", F.last(F.when(F.col("_has_ok") == 1, F.col("_trail")), True).over(wb.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_since", F.coalesce(F.sum("_n").over(Window.partitionBy(key, "_isl").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carry = s.select(
        key, "_bucket",
        F.when(F.col("_isl") == 0, F.col("_since")).otherwise(F.coalesce("_prev_trail", F.lit(0)) + F.col("_since")).alias("_carry"),
    )
    out = local.join(carry, [key, "_bucket"]).withColumn(
        "streak", (F.col("_st") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)).cast("bigint")
    )
    out = out.withColumn("abort", F.col("streak") >= threshold).drop("_bucket", "_island", "_st", "_last_isl", "_carry")
    return out.unionByName(apart)


def step_profile(marks: DataFrame, tokens: str = "num_tokens") -> DataFrame:
    """Stage times in ms, tokens/s and fetch fraction from per-step marks
    ``start, fetch, fwd, bwd, opt`` (seconds); a missing start or zero step
    time gives 0."""
    has_start = F.col("start").isNotNull()
    step_ms = F.when(has_start, (F.col("opt") - F.col("start")) * 1000).otherwise(0.0)
    fetch_ms = F.when(has_start, (F.col("fetch") - F.col("start")) * 1000).otherwise(0.0)
    return marks.select(
        "*",
        fetch_ms.alias("fetch_ms"),
        ((F.col("fwd") - F.col("fetch")) * 1000).alias("fwd_ms"),
        ((F.col("bwd") - F.col("fwd")) * 1000).alias("bwd_ms"),
        ((F.col("opt") - F.col("bwd")) * 1000).alias("opt_ms"),
        step_ms.alias("step_ms"),
        F.when(step_ms > 0, F.col(tokens) / (step_ms / 1000)).otherwise(0.0).alias("tokens_per_s"),
        F.when(step_ms > 0, fetch_ms / step_ms).otherwise(0.0).alias("fetch_frac"),
    )
