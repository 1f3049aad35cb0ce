"""Training-log queries.

Stand-ins derived from ``events``: epoch = ``day div 10``, batch =
``event_id div 50``; per batch the metric record holds ``loss_sum`` (sum of
values), ``loss_total`` (events), ``acc_sum`` (purchases), ``acc_total``
(views), ``lr`` (mean value / 1024, unpaired), ``skip_sum`` (clicks, a sum
without total) and ``orphan_total`` (errors, a total without sum).  Step
marks are the five event times of ``event_id div 5``; attempts are events
per endpoint ``user_id % 4`` with ``error`` as a failure.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.functions.time import epoch_seconds
from draftsmith.operators.training_logs import (
    best_epoch,
    epoch_metrics,
    failure_streaks,
    flatten_record,
    normalize_counted,
    running_best,
    step_profile,
)
from draftsmith.tables import table

G = "training_logs"
EPOCH0 = 1704067200
WORLD = 2
THRESHOLD = 2
BUCKET = 256


def _ev(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        "event_id", "user_id", "event_type", "value", "ts",
        F.floor((F.unix_timestamp("ts") - EPOCH0) / 86400 / 10).cast("int").alias("epoch"),
        F.floor(F.col("event_id") / 50).cast("bigint").alias("batch"),
    )


def _records(spark, sf):
    e = _ev(spark, sf)
    cnt = lambda t: F.count(F.when(F.col("event_type") == t, 1)).cast("double")
    wide = e.groupBy("epoch", "batch").agg(
        F.sum("value").alias("loss_sum"), F.count(F.lit(1)).cast("double").alias("loss_total"),
        cnt("purchase").alias("acc_sum"), cnt("view").alias("acc_total"),
        (F.avg("value") / 1024.0).alias("lr"), cnt("click").alias("skip_sum"), cnt("error").alias("orphan_total"),
    )
    names = ["loss_sum", "loss_total", "acc_sum", "acc_total", "lr", "skip_sum", "orphan_total"]
    return wide, names


def _long(spark, sf):
    wide, names = _records(spark, sf)
    return wide.select("epoch", "batch", F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))).alias("name", "value"))


_SQL_REC = f"""ev AS (
  SELECT *, CAST(floor((epoch(ts) - {EPOCH0}) / 86400 / 10) AS INTEGER) AS epoch, CAST(event_id // 50 AS BIGINT) AS batch FROM events
),
rec AS (
  SELECT epoch, batch, sum(value) AS loss_sum, CAST(count(*) AS DOUBLE) AS loss_total,
         CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS acc_sum,
         CAST(count(*) FILTER (WHERE event_type = 'view') AS DOUBLE) AS acc_total,
         avg(value) / 1024.0 AS lr, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS skip_sum,
         CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS orphan_total
  FROM ev GROUP BY epoch, batch
)"""


def _sql_norm(src: str, keys: str, world: int) -> str:
    """A11 over a wide record ``src`` (one column per raw metric)."""
    return f"""SELECT {keys}, 'loss' AS name, CASE WHEN loss_total > 0 THEN loss_sum / loss_total ELSE 0.0 END AS value FROM {src}
UNION ALL SELECT {keys}, 'acc', CASE WHEN acc_total > 0 THEN acc_sum / acc_total ELSE 0.0 END FROM {src}
UNION ALL SELECT {keys}, 'lr', lr / {world} FROM {src}
UNION ALL SELECT {keys}, 'skip_sum', skip_sum / {world} FROM {src}"""


@register("metric_ratios", f"""WITH {_SQL_REC},
n AS ({_sql_norm('rec', 'epoch, batch', WORLD)})
SELECT epoch, batch, name, round(value, 6) AS value FROM n""", G)
def metric_ratios(spark, sf):
    r = normalize_counted(_long(spark, sf), ("epoch", "batch"), WORLD)
    return r.select("epoch", "batch", "name", F.round("value", 6).alias("value"))


_SQL_EPOCH = f"""{_SQL_REC},
ep AS (
  SELECT epoch, sum(loss_sum) / count(*) AS loss_sum, sum(loss_total) / count(*) AS loss_total,
         sum(acc_sum) / count(*) AS acc_sum, sum(acc_total) / count(*) AS acc_total, sum(lr) / count(*) AS lr,
         sum(skip_sum) / count(*) AS skip_sum
  FROM rec GROUP BY epoch
),
en AS (SELECT epoch, name || '_epoch' AS name, value FROM ({_sql_norm('ep', 'epoch', WORLD)}))"""


@register("epoch_metrics", f"""WITH {_SQL_EPOCH}
SELECT epoch, name, round(value, 6) AS value FROM en""", G)
def epoch_metrics_q(spark, sf):
    r = epoch_metrics(_long(spark, sf), WORLD)
    return r.select("epoch", "name", F.round("value", 6).alias("value"))


@register("best_epoch", f"""WITH {_SQL_EPOCH}
SELECT CAST(arg_min(epoch, (value, epoch)) AS INTEGER) AS best_epoch, round(min(value), 6) AS best_value
FROM en WHERE name = 'loss_epoch'""", G)
def best_epoch_q(spark, sf):
    r = best_epoch(epoch_metrics(_long(spark, sf), WORLD))
    return r.select(F.col("best_epoch").cast("int"), F.round("best_value", 6).alias("best_value"))


@register("running_best", f"""WITH {_SQL_EPOCH}
SELECT epoch, round(value, 6) AS value,
       round(min(value) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS prev_best,
       CAST(value < coalesce(min(value) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS INTEGER) AS improved
FROM en WHERE name = 'loss_epoch'""", G)
def running_best_q(spark, sf):
    losses = epoch_metrics(_long(spark, sf), WORLD).filter(F.col("name") == "loss_epoch")
    r = running_best(losses)
    return r.select("epoch", F.round("value", 6).alias("value"), F.round("prev_best", 6).alias("prev_best"), F.col("improved").cast("int"))


@register("failure_streaks", f"""WITH a AS (SELECT user_id % 4 AS endpoint, event_id AS t, event_type <> 'error' AS ok FROM events),
i AS (SELECT *, sum(CAST(ok AS INTEGER)) OVER (PARTITION BY endpoint ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM a),
s AS (SELECT *, sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY endpoint, isl ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS streak FROM i)
SELECT CAST(endpoint AS BIGINT) AS endpoint, CAST(count(*) AS BIGINT) AS n_attempts, CAST(max(streak) AS BIGINT) AS max_streak,
       CAST(min(t) FILTER (WHERE streak >= {THRESHOLD}) AS BIGINT) AS first_abort
FROM s GROUP BY endpoint""", G)
def failure_streaks_q(spark, sf):
    e = table(spark, sf, "events", "event_id", "user_id", "event_type")
    att = e.select(F.pmod(F.col("user_id"), F.lit(4)).cast("bigint").alias("endpoint"), F.col("event_id").alias("t"), (F.col("event_type") != "error").alias("ok"))
    s = failure_streaks(att, THRESHOLD, bucket_width=BUCKET)
    return s.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n_attempts"), F.max("streak").cast("bigint").alias("max_streak"),
        F.min(F.when(F.col("abort"), F.col("t"))).cast("bigint").alias("first_abort"),
    )


@register("step_profile", """WITH m AS (
  SELECT event_id // 5 AS step, list(epoch_us(ts) / 1e6 ORDER BY epoch_us(ts)) AS marks, count(*) AS n,
         CAST(sum(round(value * 10)) AS BIGINT) AS num_tokens
  FROM events GROUP BY event_id // 5
),
p AS (SELECT step, num_tokens, CASE WHEN n = 5 THEN marks[1] END AS st, CASE WHEN n = 5 THEN marks[2] ELSE marks[1] END AS fe,
  CASE WHEN n = 5 THEN marks[3] ELSE marks[2] END AS fw, CASE WHEN n = 5 THEN marks[4] ELSE marks[3] END AS bw, CASE WHEN n = 5 THEN marks[5] ELSE marks[4] END AS op FROM m)
SELECT CAST(step AS BIGINT) AS step, round(coalesce((fe - st) * 1000, 0.0), 3) AS fetch_ms, round((fw - fe) * 1000, 3) AS fwd_ms,
       round((bw - fw) * 1000, 3) AS bwd_ms, round((op - bw) * 1000, 3) AS opt_ms, round(coalesce((op - st) * 1000, 0.0), 3) AS step_ms,
       round(CASE WHEN (op - st) * 1000 > 0 THEN num_tokens / ((op - st) * 1000 / 1000) ELSE 0.0 END, 3) AS tokens_per_s,
       round(CASE WHEN (op - st) * 1000 > 0 THEN (fe - st) * 1000 / ((op - st) * 1000) ELSE 0.0 END, 6) AS fetch_frac
FROM p""", G)
def step_profile_q(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "value")
    secs = epoch_seconds(F.col("ts"))
    m = e.groupBy(F.floor(F.col("event_id") / 5).cast("bigint").alias("step")).agg(
        F.sort_array(F.collect_list(secs)).alias("_m"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.round(F.col("value") * 10)).cast("bigint").alias("num_tokens"),
    )
    # a step with fewer events has no start mark (and, below four, lacks later ones)
    full = F.col("_n") == 5
    marks = m.select("step", "num_tokens", *[F.when(full, F.get("_m", F.lit(i))).otherwise(F.get("_m", F.lit(i - 1))).alias(n) for i, n in enumerate(["start", "fetch", "fwd", "bwd", "opt"])])
    p = step_profile(marks)
    r3 = lambda c, d=3: F.round(c, d).alias(c)
    return p.select("step", r3("fetch_ms"), r3("fwd_ms"), r3("bwd_ms"), r3("opt_ms"), r3("step_ms"), r3("tokens_per_s"), r3("fetch_frac", 6))


@register("log_flatten", f"""WITH {_SQL_REC},
kv AS (
  SELECT epoch, batch, UNNEST(['train/loss_sum', 'train/loss_total', 'train/acc_sum', 'train/acc_total', 'train/lr',
                               'train/skip_sum', 'train/orphan_total', 'profile/n_events']) AS key,
         UNNEST([loss_sum, loss_total, acc_sum, acc_total, lr, skip_sum, orphan_total, loss_total]) AS value
  FROM rec
)
SELECT epoch, batch, key, round(value, 6) AS value FROM kv""", G)
def log_flatten(spark, sf):
    wide, names = _records(spark, sf)
    nested = wide.select(
        "epoch", "batch",
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names)).alias("train"),
        F.struct(F.col("loss_total").alias("n_events")).alias("profile"),
    )
    flat = flatten_record(nested, ("epoch", "batch"))
    return flat.select("epoch", "batch", "key", F.round("value", 6).alias("value"))
