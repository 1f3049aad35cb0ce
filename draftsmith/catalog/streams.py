"""Streaming queries (T1, T2, T4–T9) checked against their batch equivalents.

Each query stages data derived from the test tables into a fresh folder of
the shared checkpoint folder (as a producer would append files), runs the
stream with ``availableNow`` over several micro-batches
(``maxFilesPerTrigger=1``) and returns the sink's content.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import prepared, sql_prepared_chain
from draftsmith.catalog.evaluation import _SQL_EVENTS, _scrapes
from draftsmith.catalog.regen import _SQL_REGEN, answered
from draftsmith.functions.time import event_time
from draftsmith.streaming.jobs import (
    backfill_stream,
    counter_delta_stream,
    dedup_stream,
    failure_breaker_stream,
    file_stream,
    read_aborts,
    read_counter_deltas,
    read_latest_counts,
    regen_stream,
    run_available,
    scratch,
    token_frequency_stream,
    windowed_metrics_stream,
)
from draftsmith.tables import table

G = "streams"
THRESHOLD = 2
FILES = 12  # of a stage without order


def _stage(df, folder: str, key: str, files: int = 3, fmt: str = "parquet") -> None:
    """Write ``df`` to ``folder`` as files in ``key`` order (range partitions,
    written one after another so that the stream reads them in that order)."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    if lo is None:
        df.write.mode("append").format(fmt).save(folder)
        return
    width = (hi - lo) // files + 1
    cut = F.floor((F.col(key) - lo) / width).cast("int")
    held = df.withColumn("_cut", cut).repartitionByRange(files, "_cut").sortWithinPartitions(key)
    held.write.partitionBy("_cut").mode("overwrite").parquet(f"{folder}-held")
    for k in range(files):
        part = df.sparkSession.read.parquet(f"{folder}-held").filter(F.col("_cut") == k).drop("_cut")
        part.write.mode("append").format(fmt).save(folder)


@register("stream_token_frequency", f"""WITH {sql_prepared_chain()}
SELECT t.id AS token_id, CAST(count(*) AS BIGINT) AS freq
FROM (SELECT UNNEST(input_ids) AS id, UNNEST(loss_mask) AS m FROM prepared) t WHERE t.m GROUP BY t.id""", G)
def stream_token_frequency(spark, sf):
    rows = prepared(spark, sf).select("sample_id", "input_ids", "loss_mask")
    base = scratch(spark, "tokfreq")
    _stage(rows, f"{base}/in", "sample_id")
    src = file_stream(spark, f"{base}/in", rows.schema, max_files=1)
    run_available(token_frequency_stream(src, f"{base}/out", f"{base}/ck"))
    return read_latest_counts(spark, f"{base}/out")


@register("stream_counter_deltas", f"""WITH {_SQL_EVENTS}
SELECT scrape, engine, name, position, value - lag(value) OVER (PARTITION BY engine, name, position ORDER BY scrape) AS delta
FROM scr QUALIFY lag(value) OVER (PARTITION BY engine, name, position ORDER BY scrape) IS NOT NULL""", G)
def stream_counter_deltas(spark, sf):
    s = _scrapes(spark, sf).select(F.col("scrape").cast("int"), "engine", "name", F.col("position").cast("int"), "value")
    base = scratch(spark, "deltas")
    s.repartition(FILES).write.parquet(f"{base}/in")
    src = file_stream(spark, f"{base}/in", s.schema, max_files=FILES // 3)
    run_available(counter_delta_stream(src, f"{base}/out", f"{base}/ck", width=7))
    return read_counter_deltas(spark, f"{base}/out")


@register("stream_failure_breaker", f"""WITH a AS (SELECT user_id % 4 AS endpoint, event_id AS t, event_type <> 'error' AS ok FROM events),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY endpoint ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM a),
s AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY endpoint, isl ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM i)
SELECT CAST(endpoint AS BIGINT) AS endpoint, CAST(min(t) AS BIGINT) AS t, CAST({THRESHOLD} AS BIGINT) AS streak
FROM s WHERE streak >= {THRESHOLD} GROUP BY endpoint""", G)
def stream_failure_breaker(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "event_type")
    att = e.select(F.pmod(F.col("user_id"), F.lit(4)).cast("bigint").alias("endpoint"), F.col("event_id").alias("t"), (F.col("event_type") != "error").alias("ok"))
    base = scratch(spark, "breaker")
    att.repartition(FILES).write.parquet(f"{base}/in")
    src = file_stream(spark, f"{base}/in", att.schema, max_files=FILES // 3)
    run_available(failure_breaker_stream(src, THRESHOLD, f"{base}/out", f"{base}/ck"))
    return read_aborts(spark, f"{base}/out", THRESHOLD)


@register("stream_dedup", f"""WITH {_SQL_EVENTS}
SELECT DISTINCT CAST(e.user_id AS BIGINT) AS user_id, e.event_type, ev.day, CAST(1 AS BIGINT) AS n_kept
FROM events e JOIN ev USING (event_id)""", G)
def stream_dedup(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type")
    recs = e.select(
        "event_id", "user_id", "event_type", event_time(F.col("ts")).alias("ts"),
        F.floor((F.unix_timestamp("ts") - 1704067200) / 86400).cast("int").alias("day"),
    )
    base = scratch(spark, "dedup")
    _stage(recs, f"{base}/in", "event_id", files=8)
    src = file_stream(spark, f"{base}/in", recs.schema, max_files=2)
    run_available(dedup_stream(src, ["user_id", "event_type", "day"], f"{base}/out", f"{base}/ck"))
    out = spark.read.parquet(f"{base}/out")
    return out.groupBy("user_id", "event_type", "day").agg(F.count(F.lit(1)).alias("n_kept"))


@register("stream_window_metrics", """WITH r AS (SELECT date_trunc('day', ts) AS window_start, event_type AS name, value FROM events)
SELECT CAST(epoch(window_start) AS BIGINT) AS window_start, name, round(sum(value), 4) AS value, CAST(count(*) AS BIGINT) AS n
FROM r GROUP BY window_start, name""", G)
def stream_window_metrics(spark, sf):
    e = table(spark, sf, "events", "ts", "event_type", "value")
    recs = e.select(event_time(F.col("ts")).alias("ts"), F.col("event_type").alias("name"), "value")
    # an end marker a day after the last record closes the last window; its own
    # window stays open and is not part of the result
    last = recs.agg((F.max("ts") + F.expr("INTERVAL 2 DAY")).alias("ts")).select("ts", F.lit("end").alias("name"), F.lit(0.0).alias("value"))
    base = scratch(spark, "windows")
    recs.write.parquet(f"{base}/in")
    src = file_stream(spark, f"{base}/in", recs.schema)
    run_available(windowed_metrics_stream(src, f"{base}/out", f"{base}/ck"))
    last.write.mode("append").parquet(f"{base}/in")
    src = file_stream(spark, f"{base}/in", recs.schema)
    run_available(windowed_metrics_stream(src, f"{base}/out", f"{base}/ck"))
    out = spark.read.parquet(f"{base}/out")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "name", F.round("value", 4).alias("value"), "n")


@register("stream_regen", f"""WITH {_SQL_REGEN}
SELECT sample_id, CASE WHEN max(fail_turn) IS NULL THEN 'ok' ELSE 'error' END AS status,
       CAST(sum(CASE WHEN role = 'system' OR fails THEN 1 ELSE 2 END) AS BIGINT) AS n_out_turns
FROM st GROUP BY sample_id""", G)
def stream_regen(spark, sf):
    """T1 + T5: the stream runs twice with different checkpoints; the second
    run finds all good conversations in the ledger and regenerates the failed
    ones only (which fail again), so good rows are there once."""
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    convs = raw.groupBy(F.col("conv_id").alias("sample_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("conversations")
    )
    base = scratch(spark, "regen")
    _stage(convs, f"{base}/in", "sample_id", fmt="json")
    for run in (1, 2):
        src = file_stream(spark, f"{base}/in", convs.schema, fmt="json", max_files=1)
        run_available(regen_stream(src, answered(spark, sf), f"{base}/out", f"{base}/ck{run}"))
    out = spark.read.json(f"{base}/out").select("sample_id", "status", F.size("conversations").cast("bigint").alias("n_out_turns"))
    return out.filter("status = 'ok'").unionAll(out.filter("status = 'error'").distinct())


@register("stream_backfill", f"""WITH {sql_prepared_chain()}
SELECT sample_id, CAST(len(input_ids) AS BIGINT) AS n_tokens, CAST(v.vec_id IS NOT NULL AS INTEGER) AS has_state,
       CASE WHEN sample_id IN (SELECT doc_id FROM labels) THEN 'seed' ELSE 'generated' END AS origin
FROM prepared LEFT JOIN embeddings v ON v.vec_id = sample_id""", G)
def stream_backfill(spark, sf):
    """T2 + K5: states are the rows of ``embeddings`` under the sample's id; the
    ids of ``labels`` are in the store already, and a second run of the stream
    (fresh checkpoint) finds nothing to do."""
    rows = prepared(spark, sf).select("sample_id", "input_ids")
    vec = table(spark, sf, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("sample_id"), F.array("embedding").alias("hidden_states"))

    def states(d, origin):
        return d.join(vec, "sample_id", "left").select("sample_id", F.col("input_ids").alias("token_ids"), "hidden_states", F.lit(origin).alias("origin"))

    base = scratch(spark, "backfill")
    seed_ids = table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("sample_id")).distinct()
    states(rows.join(seed_ids, "sample_id", "left_semi"), "seed").write.parquet(f"{base}/store/run=seed/batch=0")
    _stage(rows, f"{base}/in", "sample_id")
    for run in (1, 2):
        src = file_stream(spark, f"{base}/in", rows.schema, max_files=1)
        run_available(backfill_stream(src, f"{base}/store", lambda d: states(d, "generated"), f"{base}/ck{run}"))
    store = spark.read.parquet(f"{base}/store")
    return store.select("sample_id", F.size("token_ids").cast("bigint").alias("n_tokens"), F.col("hidden_states").isNotNull().cast("int").alias("has_state"), "origin")
