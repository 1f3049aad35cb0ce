"""Serving-evaluation queries.

Stand-ins derived from ``events`` (documented, repeated in every oracle):

* subset / engine = ``'sub' || user_id % 4``; run = ``base`` for the first
  15 days of events, ``spec`` for the rest (two runs);
* counters: ``view`` → drafts, ``click`` → draft tokens, ``purchase`` →
  accepted tokens, ``signup`` → accepted tokens per position
  (``event_id % 3``), ``error`` → a non-spec counter; a scrape per day holds
  the cumulative counts, rendered as exposition-format text lines and
  parsed back by the text-scan operator;
* sweep rows: one benchmark per (subset, event type); ``error`` is the
  ``throughput`` strategy (skipped), others ``constant`` at rates 1/2/4/8;
* generation lengths: ``round(value * 10)`` tokens per request.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import prepared, sql_prepared_chain
from draftsmith.operators.evaluation import (
    ACCEPTED_PER_POS,
    acceptance_report,
    accumulate,
    acceptance_from_counters,
    attach_acceptance,
    common_subsets,
    delta_since,
    generation_lengths,
    interpolate_speedup,
    parse_exposition,
    pretty_subset,
    scrape_deltas,
    smooth,
    storage_estimate,
)
from draftsmith.plans.evaluate import speedup
from draftsmith.sources.benchmarks import write_result_rows
from draftsmith.streaming.jobs import scratch
from draftsmith.tables import table

G = "evaluation"
EPOCH0 = 1704067200  # 2024-01-01T00:00:00Z, start of the events table
BASE_DAY = 14
RUN_SPLIT_DAY = 15  # first half of the month = baseline run, second half = speculative run
NS = "srv"
COUNTER_OF = {"view": "num_drafts", "click": "num_draft_tokens", "purchase": "num_accepted_tokens", "signup": "num_accepted_tokens_per_pos"}
RATE_OF = {"view": 1, "click": 2, "purchase": 4, "signup": 8}


def _events(spark, sf):
    e = table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        "event_id", "event_type", "value",
        F.concat(F.lit("sub"), F.pmod(F.col("user_id"), F.lit(4)).cast("string")).alias("subset"),
        F.floor((F.unix_timestamp("ts") - EPOCH0) / 86400).cast("int").alias("day"),
        F.when(F.floor((F.unix_timestamp("ts") - EPOCH0) / 86400) < RUN_SPLIT_DAY, "base").otherwise("spec").alias("run"),
    )


def _map(d: dict, col):
    return F.element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))]), col)


def _scrape_lines(spark, sf):
    """Exposition text of every daily scrape (one line per engine and counter)."""
    e = _events(spark, sf)
    name = F.coalesce(_map(COUNTER_OF, F.col("event_type")), F.lit("request_errors"))
    pos = F.when(F.col("event_type") == "signup", F.pmod(F.col("event_id"), F.lit(3)).cast("int")).otherwise(F.lit(-1))
    daily = e.groupBy("subset", name.alias("cname"), pos.alias("pos"), "day").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("subset", "cname", "pos").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    cum = daily.withColumn("cum", F.sum("n").over(w))
    labels = F.when(F.col("pos") >= 0, F.format_string('{engine="%s",position="%d"}', F.col("subset"), F.col("pos"))).otherwise(
        F.format_string('{engine="%s"}', F.col("subset"))
    )
    prefix = F.when(F.col("cname") == "request_errors", F.lit(f"{NS}:")).otherwise(F.lit(f"{NS}:spec_decode_"))
    line = F.concat(prefix, F.col("cname"), F.lit("_total"), labels, F.lit(" "), F.col("cum").cast("string"))
    return cum.select(F.col("day").alias("scrape"), line.alias("value"))


def _scrapes(spark, sf):
    return parse_exposition(_scrape_lines(spark, sf), "value", ("scrape",))


def _at_or_before(scrapes, day=None):
    """Counter values at the last scrape ``<= day`` (all scrapes when None)."""
    s = scrapes if day is None else scrapes.filter(F.col("scrape") <= day)
    return s.groupBy("engine", "name", "position").agg(F.max_by("value", "scrape").alias("value"))


_SQL_EVENTS = f"""ev AS (
  SELECT event_id, event_type, value, 'sub' || CAST(user_id % 4 AS VARCHAR) AS subset,
         CAST(floor((epoch(ts) - {EPOCH0}) / 86400) AS INTEGER) AS day,
         CASE WHEN floor((epoch(ts) - {EPOCH0}) / 86400) < {RUN_SPLIT_DAY} THEN 'base' ELSE 'spec' END AS run
  FROM events
),
cnt AS (
  SELECT subset AS engine,
         CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTER_OF.items())} END AS name,
         CASE WHEN event_type = 'signup' THEN CAST(event_id % 3 AS INTEGER) ELSE -1 END AS position, day
  FROM ev WHERE event_type <> 'error'
),
daily AS (SELECT engine, name, position, day, count(*) AS n FROM cnt GROUP BY ALL),
scr AS (
  SELECT day AS scrape, engine, name, position,
         CAST(sum(n) OVER (PARTITION BY engine, name, position ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS value
  FROM daily
)"""


@register("prometheus_counters", f"""WITH {_SQL_EVENTS},
last AS (SELECT engine, name, position, arg_max(value, scrape) AS value FROM scr GROUP BY ALL)
SELECT name, position, sum(value) AS value FROM last GROUP BY name, position""", G)
def prometheus_counters(spark, sf):
    return accumulate(_at_or_before(_scrapes(spark, sf))).select("name", "position", "value")


@register("counter_deltas", f"""WITH {_SQL_EVENTS}
SELECT scrape, engine, name, position, value - lag(value) OVER (PARTITION BY engine, name, position ORDER BY scrape) AS delta
FROM scr QUALIFY lag(value) OVER (PARTITION BY engine, name, position ORDER BY scrape) IS NOT NULL""", G)
def counter_deltas(spark, sf):
    return scrape_deltas(_scrapes(spark, sf))


def _sql_acceptance(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""acc AS (SELECT {k}name, position, sum(value) AS value FROM {src} GROUP BY ALL),
dr AS (SELECT *, sum(CASE WHEN name = 'num_drafts' AND position < 0 THEN value ELSE 0.0 END) OVER ({part}) AS drafts FROM acc),
res AS (
  SELECT {k}name AS metric, -1 AS position, value FROM dr
    WHERE position < 0 AND name IN ('num_drafts', 'num_draft_tokens', 'num_accepted_tokens')
  UNION ALL
  SELECT {k}'acceptance_length', -1, CASE WHEN drafts > 0 THEN 1.0 + value / drafts ELSE 0.0 END FROM dr
    WHERE name = 'num_accepted_tokens' AND position < 0
  UNION ALL
  SELECT {k}'acceptance_at_pos', position, CASE WHEN drafts > 0 THEN value / drafts ELSE 0.0 END FROM dr
    WHERE name = '{ACCEPTED_PER_POS}'
)"""


@register("acceptance_metrics", f"""WITH {_SQL_EVENTS},
fin AS (SELECT engine, name, position, arg_max(value, scrape) AS value FROM scr GROUP BY ALL),
bas AS (SELECT engine, name, position, arg_max(value, scrape) AS value FROM scr WHERE scrape <= {BASE_DAY} GROUP BY ALL),
fa AS (SELECT name, position, sum(value) AS value FROM fin GROUP BY ALL),
ba AS (SELECT name, position, sum(value) AS value FROM bas GROUP BY ALL),
delta AS (SELECT coalesce(f.name, b.name) AS name, coalesce(f.position, b.position) AS position,
                 coalesce(f.value, 0.0) - coalesce(b.value, 0.0) AS value
          FROM fa f FULL OUTER JOIN ba b ON f.name = b.name AND f.position = b.position),
{_sql_acceptance('delta')}
SELECT metric, CAST(position AS INTEGER) AS position, round(value, 6) AS value FROM res""", G)
def acceptance_metrics(spark, sf):
    r = acceptance_from_counters(delta_since(_scrapes(spark, sf), BASE_DAY))
    return r.select("metric", F.col("position").cast("int"), F.round("value", 6).alias("value"))


@register("acceptance_report", f"""WITH {_SQL_EVENTS},
fin AS (SELECT engine, name, position, arg_max(value, scrape) AS value FROM scr GROUP BY ALL),
{_sql_acceptance('fin')}
SELECT metric, CAST(position AS INTEGER) AS position, round(value, 6) AS value FROM res WHERE position < 100""", G)
def acceptance_report_q(spark, sf):
    """Totals, acceptance length and one line per position (first 100)."""
    r = acceptance_report(accumulate(_at_or_before(_scrapes(spark, sf))), 100)
    return r.select("metric", F.col("position").cast("int"), F.round("value", 6).alias("value"))


@register("regression_metrics", f"""WITH {_SQL_EVENTS},
fin AS (SELECT engine, name, position, arg_max(value, scrape) AS value FROM scr GROUP BY ALL),
{_sql_acceptance('fin', 'engine').replace("ELSE 0.0 END FROM dr" + chr(10) + "    WHERE name = 'num_accepted_tokens'", "ELSE 1.0 END FROM dr" + chr(10) + "    WHERE name = 'num_accepted_tokens'")}
SELECT engine, metric, CAST(position AS INTEGER) AS position, round(value, 6) AS value FROM res""", G)
def regression_metrics(spark, sf):
    """Per engine, with the empty-run rule ``acceptance_length = 1``."""
    r = acceptance_from_counters(accumulate(_at_or_before(_scrapes(spark, sf)), ("engine",)), ("engine",), no_drafts_length=1.0)
    return r.select("engine", "metric", F.col("position").cast("int"), F.round("value", 6).alias("value"))


@register("gen_length_budget", f"""WITH {_SQL_EVENTS}
SELECT subset, subset AS pretty, CAST(count(*) AS BIGINT) AS count, median(CAST(round(value * 10) AS BIGINT)) AS median,
       CAST(min(round(value * 10)) AS BIGINT) AS min, CAST(max(round(value * 10)) AS BIGINT) AS max,
       CAST(pow(2, ceil(log2(greatest(median(CAST(round(value * 10) AS BIGINT)), 1)))) AS BIGINT) AS max_tokens
FROM ev GROUP BY subset""", G)
def gen_length_budget(spark, sf):
    req = _events(spark, sf).select("subset", F.round(F.col("value") * 10).cast("bigint").alias("output_tokens"))
    g = generation_lengths(req)
    return g.select("subset", pretty_subset(F.col("subset")).alias("pretty"), "count", "median", "min", "max", "max_tokens")


def _sweep(ev, keys=("subset", "event_type")):
    strategy = F.when(F.col("event_type") == "error", "throughput").otherwise("constant")
    rows = ev.groupBy(*keys).agg(
        (F.count(F.lit(1)) / 60.0).alias("rps_median"),
        (F.median("value") / 10.0).alias("latency_median_s"),
        F.median("value").alias("itl_median_ms"),
        (F.median("value") * 2.0).alias("ttft_median_ms"),
        (F.median("value") * 3.0).alias("output_tps_median"),
        F.sum(F.round(F.col("value") * 10)).cast("bigint").alias("total_output_tokens"),
    )
    return rows.withColumn("strategy", strategy).filter(F.col("strategy") != "throughput").withColumn(
        "target_rate", _map(RATE_OF, F.col("event_type")).cast("double")
    )


_SQL_SWEEP = """sweep AS (
  SELECT subset, event_type, 'constant' AS strategy,
         CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 END AS DOUBLE) AS target_rate,
         count(*) / 60.0 AS rps_median, median(value) / 10.0 AS latency_median_s, median(value) AS itl_median_ms,
         median(value) * 2.0 AS ttft_median_ms, median(value) * 3.0 AS output_tps_median,
         CAST(sum(round(value * 10)) AS BIGINT) AS total_output_tokens
  FROM SRC WHERE event_type <> 'error' GROUP BY subset, event_type
)"""


@register("sweep_rows", f"""WITH {_SQL_EVENTS},
{_SQL_SWEEP.replace('SRC', 'ev')},
fin AS (SELECT engine, name, position, arg_max(value, scrape) AS value FROM scr GROUP BY ALL),
{_sql_acceptance('fin', 'engine')},
wide AS (
  SELECT engine AS subset,
    max(CASE WHEN metric = 'acceptance_length' THEN value END) AS acceptance_length,
    max(CASE WHEN metric = 'acceptance_at_pos' AND position = 0 THEN value END) AS acceptance_at_pos_0,
    max(CASE WHEN metric = 'acceptance_at_pos' AND position = 1 THEN value END) AS acceptance_at_pos_1,
    max(CASE WHEN metric = 'acceptance_at_pos' AND position = 2 THEN value END) AS acceptance_at_pos_2
  FROM res GROUP BY engine
)
SELECT s.subset, s.strategy, s.target_rate, round(s.rps_median, 6) AS rps_median, round(s.latency_median_s, 6) AS latency_median_s,
       round(s.itl_median_ms, 6) AS itl_median_ms, round(s.ttft_median_ms, 6) AS ttft_median_ms,
       round(s.output_tps_median, 6) AS output_tps_median, s.total_output_tokens,
       round(w.acceptance_length, 6) AS acceptance_length, round(w.acceptance_at_pos_0, 6) AS acceptance_at_pos_0,
       round(w.acceptance_at_pos_1, 6) AS acceptance_at_pos_1, round(w.acceptance_at_pos_2, 6) AS acceptance_at_pos_2
FROM sweep s LEFT JOIN wide w ON w.subset = s.subset""", G)
def sweep_rows(spark, sf):
    rows = _sweep(_events(spark, sf))
    acc = acceptance_from_counters(accumulate(_at_or_before(_scrapes(spark, sf)), ("engine",)), ("engine",))
    wide = acc.groupBy(F.col("engine").alias("subset")).agg(
        F.max(F.when(F.col("metric") == "acceptance_length", F.col("value"))).alias("acceptance_length"),
        *[F.max(F.when((F.col("metric") == "acceptance_at_pos") & (F.col("position") == i), F.col("value"))).alias(f"acceptance_at_pos_{i}") for i in range(3)],
    )
    j = attach_acceptance(rows, wide)
    r6 = lambda c: F.round(c, 6).alias(c)
    return j.select(
        "subset", "strategy", "target_rate", r6("rps_median"), r6("latency_median_s"), r6("itl_median_ms"), r6("ttft_median_ms"),
        r6("output_tps_median"), "total_output_tokens", r6("acceptance_length"), r6("acceptance_at_pos_0"), r6("acceptance_at_pos_1"),
        r6("acceptance_at_pos_2"),
    )


def _curves(spark, sf):
    """Both runs' curves from ONE grouped pass over ``events``; the two runs are
    filters on that aggregate (identical sub-plans share one exchange)."""
    both = _sweep(_events(spark, sf), ("run", "subset", "event_type")).select(
        "run", "subset", F.col("rps_median").alias("x"), F.col("latency_median_s").alias("y")
    )
    return both.filter(F.col("run") == "base").drop("run"), both.filter(F.col("run") == "spec").drop("run")


_SQL_CURVES = f"""{_SQL_SWEEP.replace('sweep AS', 'sb AS').replace('SRC', "(SELECT * FROM ev WHERE run = 'base')")},
{_SQL_SWEEP.replace('sweep AS', 'ss AS').replace('SRC', "(SELECT * FROM ev WHERE run = 'spec')")},
cb AS (SELECT subset, rps_median AS x, latency_median_s AS y FROM sb),
cs AS (SELECT subset, rps_median AS x, latency_median_s AS y FROM ss)"""


def _sql_interp(curve: str, run: str) -> str:
    return f"""u_{run} AS (
  SELECT subset, NULL::INTEGER AS i, x, y, 0 AS k FROM {curve} WHERE subset IN (SELECT subset FROM ov)
  UNION ALL SELECT subset, i, x, NULL::DOUBLE, 1 FROM grid
),
s_{run} AS (
  SELECT subset, i, x, k,
    last_value(CASE WHEN k = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY subset ORDER BY x, k, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x0,
    last_value(y IGNORE NULLS) OVER (PARTITION BY subset ORDER BY x, k, y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y0,
    first_value(CASE WHEN k = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY subset ORDER BY x, k, y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1,
    first_value(y IGNORE NULLS) OVER (PARTITION BY subset ORDER BY x, k, y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y1
  FROM u_{run}
),
i_{run} AS (
  SELECT subset, i, x, CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x1 = x0 THEN y0
                            ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END AS y_{run}
  FROM s_{run} WHERE k = 1
)"""


@register("speedup_interpolated", f"""WITH {_SQL_EVENTS},
{_SQL_CURVES},
rb AS (SELECT subset, min(x) AS lo, max(x) AS hi FROM cb GROUP BY subset),
rs AS (SELECT subset, min(x) AS lo, max(x) AS hi FROM cs GROUP BY subset),
ov AS (SELECT rb.subset, greatest(rb.lo, rs.lo) AS lo, least(rb.hi, rs.hi) AS hi FROM rb JOIN rs USING (subset)
       WHERE greatest(rb.lo, rs.lo) < least(rb.hi, rs.hi)),
grid AS (SELECT subset, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 199 AS x FROM (SELECT *, UNNEST(range(200)) AS i FROM ov)),
{_sql_interp('cb', 'base')},
{_sql_interp('cs', 'target')}
SELECT b.subset, b.i, round(b.x, 6) AS x, round(b.y_base, 6) AS y_base, round(t.y_target, 6) AS y_target,
       round(b.y_base / greatest(t.y_target, 1e-12), 6) AS speedup
FROM i_base b JOIN i_target t USING (subset, i)""", G)
def speedup_interpolated(spark, sf):
    base, spec = _curves(spark, sf)
    r = interpolate_speedup(base, spec, increasing=True)
    return r.select("subset", F.col("i").cast("int"), *[F.round(c, 6).alias(c) for c in ("x", "y_base", "y_target", "speedup")])


def _sql_cubic(raw: str, out: str, dense: int = 300) -> str:
    """CTEs that turn points ``raw(subset, x, y)`` into their least-squares cubic on
    ``dense`` even places, by orthogonal polynomials of the points."""
    return f"""{out}_0 AS (SELECT r.subset, x, y, lo, hi, k, CASE WHEN k > 1 THEN (x - lo) / (hi - lo) ELSE 0 END AS u
  FROM {raw} r JOIN (SELECT subset, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS k FROM {raw} GROUP BY subset) USING (subset)),
{out}_1 AS (SELECT *, u - a0 AS p1 FROM {out}_0 JOIN (SELECT subset, avg(u) AS a0, avg(y) AS c0, CAST(count(*) AS DOUBLE) AS n0 FROM {out}_0 GROUP BY subset) USING (subset)),
{out}_2 AS (SELECT *, (u - a1) * p1 - n1 / n0 AS p2 FROM {out}_1 JOIN (
  SELECT subset, sum(u * p1 * p1) / sum(p1 * p1) AS a1, sum(y * p1) / sum(p1 * p1) AS c1, sum(p1 * p1) AS n1 FROM {out}_1 WHERE k > 1 GROUP BY subset) USING (subset)),
{out}_3 AS (SELECT *, (u - a2) * p2 - n2 / n1 * p1 AS p3 FROM {out}_2 JOIN (
  SELECT subset, CASE WHEN k > 2 THEN sum(u * p2 * p2) / sum(p2 * p2) ELSE 0 END AS a2, CASE WHEN k > 2 THEN sum(y * p2) / sum(p2 * p2) ELSE 0 END AS c2,
         CASE WHEN k > 2 THEN sum(p2 * p2) ELSE 0 END AS n2 FROM {out}_2 GROUP BY subset, k) USING (subset)),
{out}_4 AS (SELECT subset, k, lo, hi, a0, a1, a2, c0, c1, c2, n1 / n0 AS b1, n2 / n1 AS b2, CASE WHEN max(k) > 3 THEN sum(y * p3) / sum(p3 * p3) ELSE 0 END AS c3
  FROM {out}_3 GROUP BY ALL),
{out}_5 AS (SELECT *, i / {dense - 1}.0 AS u FROM (SELECT *, unnest(range({dense})) AS i FROM {out}_4)),
{out} AS (SELECT subset, lo + (hi - lo) * u AS x, c0 + c1 * p1 + c2 * p2 + c3 * ((u - a2) * p2 - b2 * p1) AS y
  FROM (SELECT *, (u - a1) * p1 - b1 AS p2 FROM (SELECT *, u - a0 AS p1 FROM {out}_5))
  UNION ALL SELECT subset, x, y FROM {out}_0 WHERE k = 1)"""


@register("speedup_smoothed", f"""WITH {_SQL_EVENTS},
{_SQL_CURVES.replace('cb AS', 'kb AS').replace('cs AS', 'ks AS')},
{_sql_cubic('kb', 'cb')},
{_sql_cubic('ks', 'cs')},
rb AS (SELECT subset, min(x) AS lo, max(x) AS hi FROM kb GROUP BY subset),
rs AS (SELECT subset, min(x) AS lo, max(x) AS hi FROM ks GROUP BY subset),
ov AS (SELECT rb.subset, greatest(rb.lo, rs.lo) AS lo, least(rb.hi, rs.hi) AS hi FROM rb JOIN rs USING (subset)
       WHERE greatest(rb.lo, rs.lo) < least(rb.hi, rs.hi)),
grid AS (SELECT subset, CAST(i AS INTEGER) AS i, lo + (hi - lo) * i / 199 AS x FROM (SELECT *, UNNEST(range(200)) AS i FROM ov)),
{_sql_interp('cb', 'base')},
{_sql_interp('cs', 'target')}
SELECT b.subset, b.i, round(b.x, 4) AS x, round(b.y_base, 4) AS y_base, round(t.y_target, 4) AS y_target,
       CASE WHEN t.y_target > 0.001 THEN round(b.y_base / t.y_target, 4) END AS speedup
FROM i_base b JOIN i_target t USING (subset, i)""", G)
def speedup_smoothed(spark, sf):
    """Result files of two runs, each curve smoothed, then interpolated (no
    ratio is shown where a smoothed target falls to zero)."""
    path = scratch(spark, "speedup")
    rows = _sweep(_events(spark, sf), ("run", "subset", "event_type"))
    for run in ("base", "spec"):
        write_result_rows(rows.filter(F.col("run") == run), f"{path}/{run}.csv")
    r = speedup(spark, [f"B={path}/base.csv"], [f"T={path}/spec.csv"], "latency")
    shown = F.when(F.col("y_target") > 0.001, F.round("speedup", 4)).alias("speedup")
    return r.select("subset", F.col("i").cast("int"), *[F.round(c, 4).alias(c) for c in ("x", "y_base", "y_target")], shown)


@register("curve_smoothing", f"""WITH {_SQL_EVENTS},
{_SQL_CURVES},
pts AS (SELECT 'base' AS label, * FROM cb UNION ALL SELECT 'spec', * FROM cs)
SELECT label, subset, round(x, 6) AS x, round(avg(y) OVER (PARTITION BY label, subset ORDER BY x, y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS y
FROM pts""", G)
def curve_smoothing(spark, sf):
    base, spec = _curves(spark, sf)
    pts = base.withColumn("label", F.lit("base")).unionByName(spec.withColumn("label", F.lit("spec")))  # U2: pooled under labels
    s = smooth(pts, ("label", "subset"), 1)
    return s.select("label", "subset", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("subset_intersection", f"""WITH {_SQL_EVENTS},
{_SQL_CURVES},
allowed AS (SELECT DISTINCT subset FROM ev WHERE event_type = 'purchase')
SELECT subset FROM (SELECT subset FROM cb INTERSECT SELECT subset FROM cs) WHERE subset IN (SELECT subset FROM allowed)""", G)
def subset_intersection(spark, sf):
    base, spec = _curves(spark, sf)
    allowed = _events(spark, sf).filter(F.col("event_type") == "purchase").select("subset").distinct()
    return common_subsets(base, spec, allowed)


@register("storage_estimate", f"""WITH {sql_prepared_chain()}
SELECT CAST(count(*) AS BIGINT) AS n_samples, CAST(sum(seq_len) AS BIGINT) AS tokens,
       CAST(sum(seq_len) * {4 * 4096 * 2} AS BIGINT) AS bytes FROM prepared""", G)
def storage_estimate_q(spark, sf):
    return storage_estimate(prepared(spark, sf), 4, 4096, 2)
