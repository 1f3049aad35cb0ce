"""Structured Streaming jobs.

Every job reads a file stream (a folder the producers append to), keeps
its progress in a checkpoint location, and writes through an idempotent
sink: file sinks (exactly-once through the sink log) or ``foreachBatch``
writes keyed by the batch id (a retried batch overwrites its own output).
Aggregation and deduplication use the built-in state store.  Jobs that depend
on the order of a key's rows (T4, T7) keep segments of the order axis as state,
in tables: rows may arrive in any order, and no key is bound to one task.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draftsmith.session import checkpoint_dir
from draftsmith.sources.commits import Runs


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/draftsmith-{name}-{uuid.uuid4().hex[:12]}"


def file_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", pattern: str | None = None, max_files: int | None = None) -> DataFrame:
    """A file-source stream over ``folder`` (new files are new data).

    ``max_files`` bounds each micro-batch (back-pressure, T1).
    """
    r = spark.readStream.schema(schema).format(fmt)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(folder)


def run_available(writer) -> None:
    """Process everything available now, then stop (batch-equivalent runs, tests)."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def read_if_written(spark: SparkSession, path: str, *columns: str) -> DataFrame | None:
    """The Parquet table at ``path``, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path).select(*columns)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def token_frequency_stream(rows: DataFrame, out: str, ckpt: str, fanout: int = 4):
    """Running trainable-token counts in ``update`` mode.

    Each micro-batch adds a run with the counts that changed; runs are merged as
    they become many (:class:`draftsmith.sources.commits.Runs`), so reading the
    newest counts costs the vocabulary times ``fanout`` runs a level, not the
    history.  A batch that is tried again replaces its own run.
    """
    counts = (
        rows.select(F.explode(F.arrays_zip("input_ids", "loss_mask")).alias("t"))
        .filter("t.loss_mask")
        .groupBy(F.col("t.input_ids").alias("token_id"))
        .agg(F.count(F.lit(1)).alias("freq"))
    )

    def sink(bdf: DataFrame, batch_id: int) -> None:
        Runs(bdf.sparkSession, out, ["token_id"], fanout).add(bdf, batch_id)

    return counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", ckpt)


def read_latest_counts(spark: SparkSession, out: str) -> DataFrame:
    return Runs(spark, out, ["token_id"]).newest()


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each (keys, segment) as the last micro-batch that touched it left them."""
    versions = rows.groupBy(*keys, "segment").agg(F.max("batch").alias("batch"))
    same = [rows[c].eqNullSafe(versions[c]) for c in (*keys, "segment", "batch")]
    return rows.join(versions, on=functools.reduce(lambda a, b: a & b, same), how="left_semi")


def merged_segments(bdf: DataFrame, batch_id: int, store: str, keys: list[str], order: str, width: int) -> DataFrame:
    """Rows of a micro-batch with those that earlier batches stored of the same
    segments (``width`` units of ``order`` of one key), and the column ``segment``.

    A segment is the unit of state: it is read again only when new rows fall into
    it, and is then written as a whole, so neither the order of files nor that of
    micro-batches matters, and one key is as many tasks as it has segments.
    """
    new = bdf.withColumn("segment", F.floor(F.col(order) / width).cast("bigint"))
    have = read_if_written(bdf.sparkSession, store, "batch", "segment", *bdf.columns)
    if have is None:
        return new
    lo, hi = new.agg(F.min("segment"), F.max("segment")).first()
    touched = new.select(*keys, "segment").distinct()
    have = have.filter((F.col("batch") < batch_id) & F.col("segment").between(lo, hi))  # a batch that is tried again ignores its own
    same = functools.reduce(lambda a, b: a & b, [have[c].eqNullSafe(touched[c]) for c in (*keys, "segment")])
    return new.unionByName(_newest(have.join(touched, on=same, how="left_semi"), keys).select(*new.columns))


COUNTER = ["engine", "name", "position"]


def counter_delta_stream(scrapes: DataFrame, out: str, ckpt: str, width: int = 4096):
    """Each scrape's delta to the one before it (a decrease is a reset: the
    delta restarts from 0), in whatever order scrapes arrive.

    Deltas inside a segment of ``width`` scrapes are written with its rows; the
    first row of a segment has none yet and its last one is marked, which is all
    that :func:`read_counter_deltas` needs to join neighbouring segments.
    """

    def sink(bdf: DataFrame, batch_id: int) -> None:
        known = bdf.select("scrape", *COUNTER, "value").filter(F.col("scrape").isNotNull())
        rows = merged_segments(known, batch_id, out, COUNTER, "scrape", width)
        inside = Window.partitionBy(*COUNTER, "segment").orderBy("scrape", "value")
        before = F.lag("value").over(inside)
        rows = rows.select("segment", "scrape", *COUNTER, "value", _delta(F.col("value"), before).alias("delta"), F.lead("scrape").over(inside).isNull().alias("last"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return scrapes.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)


def _delta(value: Column, before: Column) -> Column:
    return F.when(value >= before, value - before).when(before.isNotNull(), value)


def read_counter_deltas(spark: SparkSession, out: str) -> DataFrame:
    """Deltas ``(scrape, engine, name, position, delta)`` of all that has arrived; a
    counter's first scrape has none."""
    rows = _newest(spark.read.parquet(out), COUNTER)
    place = F.struct("scrape", "value")
    ends = rows.filter(F.col("delta").isNull() | F.col("last")).groupBy(*COUNTER, "segment").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    before = F.lag("last").over(Window.partitionBy(*COUNTER).orderBy("segment"))["value"]
    joints = ends.withColumn("before", before).select(F.col("first.scrape").alias("scrape"), *COUNTER, _delta(F.col("first.value"), F.col("before")).alias("delta"))
    inside = rows.select("scrape", *COUNTER, "delta")
    return inside.unionAll(joints).filter(F.col("delta").isNotNull())


def failure_breaker_stream(attempts: DataFrame, threshold: int, out: str, ckpt: str, width: int = 4096):
    """T4: consecutive-failure circuit breaker per endpoint, in whatever order
    attempts arrive.

    Each segment of ``width`` units of time is summed up so that neighbours can be
    joined: failures before its first success (with the times of the first
    ``threshold`` of them), failures after its last one, and the first time a
    streak of its own reaches ``threshold``.  :func:`read_aborts` joins the sums.
    """

    def sink(bdf: DataFrame, batch_id: int) -> None:
        known = bdf.select("endpoint", "t", "ok").filter("endpoint IS NOT NULL AND t IS NOT NULL")
        rows = merged_segments(known, batch_id, f"{out}/rows", ["endpoint"], "t", width)
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
        segment_sums(bdf.sparkSession.read.parquet(f"{out}/rows/batch={batch_id}"), threshold).write.mode("overwrite").parquet(f"{out}/sums/batch={batch_id}")

    return attempts.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)


def segment_sums(rows: DataFrame, threshold: int) -> DataFrame:
    """``rows(endpoint, segment, t, ok)`` to one row a segment: ``has_ok``, ``trail``,
    ``lead`` (times of its first failures) and ``hit``; at equal times failures come first."""
    part = Window.partitionBy("endpoint", "segment")
    upto = part.orderBy("t", "ok").rowsBetween(Window.unboundedPreceding, 0)
    x = rows.withColumn("island", F.sum(F.col("ok").cast("int")).over(upto))
    streak = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("endpoint", "segment", "island").orderBy("t", "ok").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("streak", streak)
    failed_first = (F.col("island") == 0) & (F.col("streak") <= threshold)
    return x.groupBy("endpoint", "segment").agg(
        F.max("ok").alias("has_ok"),
        F.max_by("streak", F.struct("t", "ok", "streak")).alias("trail"),
        F.array_sort(F.collect_list(F.when(failed_first, F.col("t")))).alias("lead"),
        F.min(F.when((F.col("island") > 0) & (F.col("streak") >= threshold), F.col("t"))).alias("hit"),
    )


def read_aborts(spark: SparkSession, out: str, threshold: int) -> DataFrame:
    """``(endpoint, t, streak)``: the first time each endpoint has ``threshold``
    failures in a row, from one row a segment (the job stops when there is one)."""
    s = _newest(spark.read.parquet(f"{out}/sums"), ["endpoint"])
    earlier = Window.partitionBy("endpoint").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("island", F.coalesce(F.sum(F.col("has_ok").cast("int")).over(earlier), F.lit(0)))
    s = s.withColumn("from", F.last(F.when(F.col("has_ok"), F.col("trail")), True).over(earlier))
    since = F.sum("trail").over(Window.partitionBy("endpoint", "island").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    s = s.withColumn("carry", F.coalesce("from", F.lit(0)) + F.coalesce(since, F.lit(0)))
    # carried over: the failure of ``lead`` that makes the streak long enough
    crossed = F.when(F.col("carry") < threshold, F.get("lead", (F.lit(threshold - 1) - F.col("carry")).cast("int")))
    return s.groupBy("endpoint").agg(F.min(F.least(crossed, "hit")).alias("t")).filter("t IS NOT NULL").select("endpoint", "t", F.lit(threshold).cast("bigint").alias("streak"))


def windowed_metrics_stream(records: DataFrame, out: str, ckpt: str, window: str = "1 day", delay: str = "10 minutes"):
    """Sums per event-time window and name, late data bounded by a watermark;
    a window is written once the watermark passes its end (append)."""
    agg = (
        records.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), "name")
        .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "name", "value", "n")
    )
    return agg.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt)


def dedup_stream(records: DataFrame, keys: list[str], out: str, ckpt: str, delay: str = "1 day 10 minutes"):
    """Drop re-submitted records (same keys) while the first is within the
    watermark.  ``delay`` must cover the span in which a key can come again (for
    keys that hold a day: a day and the lateness); then the result does not
    depend on how records are split into files."""
    d = records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return d.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ckpt)


def regen_stream(
    conversations: DataFrame,
    answer,
    out: str,
    ckpt: str,
    id_col: str = "sample_id",
    language: str | None = None,
):
    """T1 + T5: incremental regeneration.

    Each micro-batch: language filter (P25) → prompt extraction (P24) →
    anti-join with the ids already done (J1) → replies (X6, a table) → one
    write partitioned by status (K4).

    Resume is idempotent even with a fresh checkpoint: successful ids are
    appended to an ids-only Parquet ledger (``<out>/_done``) in the same
    batch, and the anti-join reads just that column — never the JSON output.
    """
    from draftsmith.operators.normalize import conversations_to_long, extract_prompt_turns
    from draftsmith.operators.regen import regenerate, write_results

    ledger = f"{out.rstrip('/')}/_done"
    # one run per checkpoint: a recovered query (same checkpoint) overwrites
    # its own retried batch; a new checkpoint writes next to earlier runs
    run = hashlib.md5(ckpt.encode("utf-8")).hexdigest()[:12]

    def sink(bdf: DataFrame, batch_id: int) -> None:
        spark = bdf.sparkSession
        b = bdf if language is None else bdf.filter(F.col("language") == language)
        turns = conversations_to_long(b, id_col).withColumnRenamed(id_col, "sample_id")
        prompts = extract_prompt_turns(turns)
        seen = read_if_written(spark, ledger, "sample_id")
        if seen is not None:
            prompts = prompts.join(seen, "sample_id", "left_anti")
        # replies are asked for once: rows are staged (a retried batch overwrites
        # its own), then split by status, and the ledger is read from them
        stage = f"{ckpt.rstrip('/')}-rows/batch={batch_id}"
        regenerate(prompts, answer(prompts)).write.mode("overwrite").parquet(stage)
        res = spark.read.parquet(stage)
        write_results(res, f"{out.rstrip('/')}/run={run}/batch={batch_id}", "overwrite")
        res.filter("status = 'ok'").select("sample_id").write.mode("overwrite").parquet(f"{ledger}/run={run}/batch={batch_id}")

    return conversations.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)


def backfill_stream(
    rows: DataFrame,
    store: str,
    generate: Callable[[DataFrame], DataFrame],
    ckpt: str,
    retention: str = "cache",
    consume: Callable[[DataFrame, int], None] | None = None,
):
    """T2 + K5: on-demand artefacts — rows missing from the store are generated.

    ``retention="cache"`` adds them to the store (later runs reuse them);
    ``"delete"`` keeps the store unchanged.  Generated rows are written once,
    to this batch's own folder, and read back for the store and for
    ``consume(df, batch_id)``, so a retried batch overwrites its own output.
    """
    if retention not in ("cache", "delete"):
        raise ValueError("retention must be 'cache' or 'delete'")
    run = hashlib.md5(ckpt.encode("utf-8")).hexdigest()[:12]

    def sink(bdf: DataFrame, batch_id: int) -> None:
        spark = bdf.sparkSession
        part = f"run={run}/batch={batch_id}"
        have = read_if_written(spark, store, "sample_id", "run", "batch") if retention == "cache" else read_if_written(spark, store, "sample_id")
        if have is not None and retention == "cache":  # what this batch wrote before a retry does not count
            have = have.filter((F.coalesce(F.col("run").cast("string"), F.lit("")) != run) | (F.col("batch") != batch_id)).select("sample_id")
        todo = bdf if have is None else bdf.join(have, "sample_id", "left_anti")
        folder = f"{store.rstrip('/')}/{part}" if retention == "cache" else f"{ckpt.rstrip('/')}-made/{part}"
        generate(todo).write.mode("overwrite").parquet(folder)
        if consume is not None:
            consume(spark.read.parquet(folder), batch_id)

    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt)
