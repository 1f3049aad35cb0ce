"""Serving-benchmark analytics.

Counters are long tables ``(scrape, engine, name, position, value)`` with
``position = -1`` for scalar counters; curves are ``(label, subset, x, y)``.
All steps are aggregates, windows partitioned by small keys (subset,
counter), or equi joins; the speed-up interpolation uses windows over the
union of both curves and the grid instead of a theta join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Display names of benchmark subsets; other names pass through.
PRETTY_SUBSET_NAMES = {
    "HumanEval": "HumanEval",
    "math_reasoning": "Math Reasoning",
    "qa": "QA",
    "question": "Question",
    "rag": "RAG",
    "summarization": "Summarization",
    "tool_call": "Tool Call",
    "translation": "Translation",
    "writing": "Writing",
}

# Counter suffixes after the ``<namespace>:spec_decode_`` prefix.
DRAFTS = "num_drafts"
DRAFT_TOKENS = "num_draft_tokens"
ACCEPTED = "num_accepted_tokens"
ACCEPTED_PER_POS = "num_accepted_tokens_per_pos"


def pretty_subset(col: Column) -> Column:
    """Display name lookup with fallback to the raw name."""
    m = F.create_map(*[x for k, v in PRETTY_SUBSET_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, col), col)


def generation_lengths(requests: DataFrame, subset: str = "subset", tokens: str = "output_tokens") -> DataFrame:
    """A3 + A4: per subset ``count, median, min, max, max_tokens``.

    ``max_tokens = 2 ** ceil(log2(max(median, 1)))``.  The median is exact
    (interpolated 50th percentile, like ``statistics.median``) from the counts
    of the distinct values: rows are counted map-side, and a window holds the
    distinct lengths of a subset, not its requests.
    """
    n = requests.filter(F.col(tokens).isNotNull()).groupBy(subset, tokens).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(subset).orderBy(tokens).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("_upto", upto).withColumn("_all", F.sum("_n").over(Window.partitionBy(subset)))
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col(tokens))).cast("double")  # noqa: E731  value at 0-based place k
    agg = n.groupBy(subset).agg(
        F.sum("_n").alias("count"),
        ((at(F.floor((F.col("_all") - 1) / 2)) + at(F.floor(F.col("_all") / 2))) / 2).alias("median"),
        F.min(tokens).alias("min"),
        F.max(tokens).alias("max"),
    )
    return agg.withColumn("max_tokens", F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("median"), F.lit(1.0))))).cast("bigint"))


def parse_exposition(lines: DataFrame, col: str = "value", source_cols: tuple[str, ...] = ()) -> DataFrame:
    """Exposition-format text lines → ``(engine, name, position, value)``.

    Accepts ``name value`` and ``name{labels} value`` lines, with a timestamp or
    not, and NaN or infinite values; keeps names with a ``:spec_decode`` part; strips the ``_total`` *suffix* only (Q4);
    ``position`` comes from a ``position="N"`` label of per-position
    counters, -1 for scalar counters.  Comments and other lines are dropped.
    """
    # the text format: name, optional {label="value", ...} with \\-escapes in the
    # quotes, blanks, a number (or NaN, +Inf, -Inf), an optional timestamp
    quoted = '"(?:[^"\\\\]|\\\\.)*"'
    label = f"[A-Za-z_][A-Za-z0-9_]*[ \\t]*=[ \\t]*{quoted}"
    grammar = f"^([A-Za-z_:][A-Za-z0-9_:]*)[ \\t]*(?:\\{{((?:[ \\t]*{label}[ \\t]*,?)*)[ \\t]*\\}})?[ \\t]*(\\S+)(?:[ \\t]+-?[0-9]+)?$"
    line = F.trim(F.col(col))
    part = lambda k: F.nullif(F.regexp_extract(line, grammar, k), F.lit(""))
    number = F.regexp_replace(F.regexp_replace(part(3), "^\\+", ""), "^(-?)Inf$", "$1Infinity")
    parsed = lines.select(
        *source_cols,
        part(1).alias("_raw"),
        part(2).alias("_labels"),
        number.try_cast("double").alias("value"),
    ).filter(F.col("_raw").contains(":spec_decode") & F.col("value").isNotNull())
    name = F.regexp_replace(F.regexp_extract("_raw", r":spec_decode_?(.*)$", 1), r"_total$", "")
    pos_txt = F.regexp_extract(F.coalesce("_labels", F.lit("")), r'position="(\d+)"', 1)
    engine_lab = F.regexp_extract(F.coalesce("_labels", F.lit("")), r'engine="([^"]*)"', 1)
    per_pos = name.contains("per_pos")
    return parsed.select(
        *source_cols,
        F.when(engine_lab != "", engine_lab).otherwise(F.lit("")).alias("engine"),
        name.alias("name"),
        F.when(per_pos, F.when(pos_txt != "", pos_txt.cast("int"))).otherwise(F.lit(-1)).alias("position"),
        "value",
    ).filter(~per_pos | F.col("position").isNotNull())


def accumulate(counters: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A5: scalar counters summed by name, per-position counts summed by position
    (across engines and vectors — Q3: summed, not overwritten)."""
    return counters.groupBy(*keys, "name", "position").agg(F.sum("value").alias("value"))


def counter_delta(final: DataFrame, baseline: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``final - baseline`` by (name, position); missing side counts as 0
    (full outer join = zero padding of unequal vectors)."""
    k = [*keys, "name", "position"]
    return final.withColumnRenamed("value", "_f").join(baseline.withColumnRenamed("value", "_b"), k, "full").select(
        *k, (F.coalesce("_f", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))).alias("value")
    )


def delta_since(scrapes: DataFrame, base: int) -> DataFrame:
    """J8 for one table of scrapes: per (name, position) the last value minus the
    last one at or before scrape ``base``, summed over engines — both sides in one
    grouped pass, no join."""
    per = scrapes.groupBy("engine", "name", "position").agg(
        F.max_by("value", "scrape").alias("_f"),
        F.max_by(F.when(F.col("scrape") <= base, F.col("value")), F.when(F.col("scrape") <= base, F.col("scrape"))).alias("_b"),
    )
    return per.groupBy("name", "position").agg(F.sum(F.col("_f") - F.coalesce("_b", F.lit(0.0))).alias("value"))


def acceptance_from_counters(acc: DataFrame, keys: tuple[str, ...] = (), no_drafts_length: float = 0.0) -> DataFrame:
    """A6 (+A26 via ``no_drafts_length=1``): long result ``(metric, position, value)``.

    ``acceptance_length = 1 + accepted / drafts``; ``acceptance_at_pos_i =
    count_i / drafts``; both 0 (or the given default) when there are no drafts.
    """
    # ``acc`` is already accumulated: one row per (keys, name, position), a
    # bounded table (counter names × draft positions), so an un-keyed window
    # over it is a small single-task step.
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    drafts_expr = F.sum(F.when((F.col("name") == DRAFTS) & (F.col("position") < 0), F.col("value")).otherwise(0.0))
    d = acc.withColumn("_drafts", drafts_expr.over(w))
    has = F.col("_drafts") > 0
    scalars = d.filter(F.col("position") < 0).filter(F.col("name").isin(DRAFTS, DRAFT_TOKENS, ACCEPTED))
    length = d.filter((F.col("name") == ACCEPTED) & (F.col("position") < 0)).select(
        *keys, F.lit("acceptance_length").alias("metric"), F.lit(-1).alias("position"),
        F.when(has, 1.0 + F.col("value") / F.col("_drafts")).otherwise(F.lit(no_drafts_length)).alias("value"),
    )
    per_pos = d.filter(F.col("name") == ACCEPTED_PER_POS).select(
        *keys, F.lit("acceptance_at_pos").alias("metric"), "position",
        F.when(has, F.col("value") / F.col("_drafts")).otherwise(F.lit(0.0)).alias("value"),
    )
    base = scalars.select(*keys, F.col("name").alias("metric"), F.lit(-1).alias("position"), "value")
    return base.unionByName(length).unionByName(per_pos)


def scrape_deltas(scrapes: DataFrame) -> DataFrame:
    """Per counter, value minus the previous scrape's value.

    A decrease means the counter was reset: the delta then starts from 0
    (the new value itself).  The first scrape has no delta.
    """
    w = Window.partitionBy("engine", "name", "position").orderBy("scrape")
    prev = F.lag("value").over(w)
    return scrapes.withColumn("_prev", prev).filter(F.col("_prev").isNotNull()).select(
        "scrape", "engine", "name", "position",
        F.when(F.col("value") >= F.col("_prev"), F.col("value") - F.col("_prev")).otherwise(F.col("value")).alias("delta"),
    )


def smooth(points: DataFrame, keys: tuple[str, ...], window: int = 1) -> DataFrame:
    """O16 (re-aimed): centred moving average of ``y`` over ``x`` order, ``window``
    points each side, per curve; O15: curves are ordered by ``x``."""
    w = Window.partitionBy(*keys).orderBy("x", "y").rowsBetween(-window, window)  # (x, y): a total order even with tied x
    return points.select(*keys, "x", F.avg("y").over(w).alias("y"))


def fit_curve(points: DataFrame, keys: tuple[str, ...], n_dense: int = 300) -> DataFrame:
    """O16 before J11: each curve's least-squares cubic, on ``n_dense`` even
    places from its smallest to its largest ``x``.

    A smoothing spline that may leave the whole variance of ``y`` as residual is
    that polynomial.  Curves with two or three points get the polynomial through
    them, a single point stays.  A curve is the few points of one sweep.
    """

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g["x"].to_numpy(float), g["y"].to_numpy(float)
        distinct = len(np.unique(x))
        if distinct < 2:
            dense, value = x, y
        else:
            dense = np.linspace(x.min(), x.max(), n_dense)
            value = np.polynomial.Polynomial.fit(x, y, min(3, distinct - 1))(dense)
        return pd.DataFrame({**{k: g[k].iloc[0] for k in keys}, "x": dense, "y": value})

    schema = ", ".join([f"{k} {points.schema[k].dataType.simpleString()}" for k in keys] + ["x double", "y double"])
    return points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(*keys).applyInPandas(fit, schema)


def interpolate_speedup(base: DataFrame, target: DataFrame, increasing: bool, n_grid: int = 200, eps: float = 1e-12) -> DataFrame:
    """J11 (+U4): per subset present in both runs, speed-up on an ``n_grid`` x
    grid over the overlap of their x ranges; subsets without overlap are skipped.

    One pass over the union of both curves, no theta join and no second
    read of either input:

    1. windows per (subset, run) give each run's x range, a window per subset
       the overlap and the number of runs present;
    2. one designated point row per subset also emits the grid points (one
       ``explode`` of ``[point] ++ grid``);
    3. windows per (subset, run) ordered by x fill each grid point's previous
       and next known point (``last/first(ignorenulls)``) → linear interpolation;
    4. a group-by (subset, grid index) pairs the two runs.

    ``increasing`` metrics (latency) give ``base / target``, others ``target / base``.
    """
    pts = base.select("subset", "x", F.col("y").cast("double").alias("y"), F.lit("base").alias("run")).unionByName(
        target.select("subset", "x", F.col("y").cast("double").alias("y"), F.lit("target").alias("run"))
    )
    sr = Window.partitionBy("subset", "run")
    s_ = Window.partitionBy("subset")
    ranged = (
        pts.withColumn("_lo_r", F.min("x").over(sr)).withColumn("_hi_r", F.max("x").over(sr))
        .withColumn("_lo", F.max("_lo_r").over(s_)).withColumn("_hi", F.min("_hi_r").over(s_))
        .withColumn("_runs", F.size(F.collect_set("run").over(s_)))
        .withColumn("_first", F.row_number().over(s_.orderBy("run", "x", "y")) == 1)
        .filter((F.col("_runs") == 2) & (F.col("_lo") < F.col("_hi")))
    )
    grid_x = lambda i: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * i / F.lit(n_grid - 1)
    item_t = "struct<run:string,i:int,x:double,y:double,k:int>"
    point = F.array(F.struct(F.col("run"), F.lit(None).cast("int").alias("i"), F.col("x").cast("double").alias("x"), F.col("y"), F.lit(0).alias("k")))
    grid = F.when(
        F.col("_first"),
        F.flatten(
            F.transform(
                F.array(F.lit("base"), F.lit("target")),
                lambda r: F.transform(
                    F.sequence(F.lit(0), F.lit(n_grid - 1)),
                    lambda i: F.struct(r.alias("run"), i.alias("i"), grid_x(i).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), F.lit(1).alias("k")),
                ),
            )
        ),
    ).otherwise(F.array().cast(f"array<{item_t}>"))
    u = ranged.select("subset", F.explode(F.concat(point, grid)).alias("_e")).select("subset", "_e.*")
    before = Window.partitionBy("subset", "run").orderBy("x", "k", "y").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("subset", "run").orderBy("x", "k", "y").rowsBetween(0, Window.unboundedFollowing)
    px = F.when(F.col("k") == 0, F.col("x"))
    filled = u.select(
        "subset", "run", "i", "x", "k",
        F.last(px, True).over(before).alias("x0"), F.last("y", True).over(before).alias("y0"),
        F.first(px, True).over(after).alias("x1"), F.first("y", True).over(after).alias("y1"),
    ).filter(F.col("k") == 1)
    y = (
        F.when(F.col("x0").isNull(), F.col("y1"))
        .when(F.col("x1").isNull() | (F.col("x1") == F.col("x0")), F.col("y0"))
        .otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    )
    j = filled.withColumn("_y", y).groupBy("subset", "i").agg(
        F.first("x").alias("x"),
        F.max(F.when(F.col("run") == "base", F.col("_y"))).alias("y_base"),
        F.max(F.when(F.col("run") == "target", F.col("_y"))).alias("y_target"),
    )
    ratio = (
        F.col("y_base") / F.greatest(F.col("y_target"), F.lit(eps))
        if increasing
        else F.col("y_target") / F.greatest(F.col("y_base"), F.lit(eps))
    )
    return j.select("subset", "i", "x", "y_base", "y_target", ratio.alias("speedup"))


def attach_acceptance(rows: DataFrame, acceptance_wide: DataFrame) -> DataFrame:
    """Acceptance columns on every sweep row of the subset (left join)."""
    return rows.join(acceptance_wide, "subset", "left")


def common_subsets(a: DataFrame, b: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """U4 (+U3 filter): subsets present in both runs, optionally within a filter list."""
    s = a.select("subset").intersect(b.select("subset"))
    return s if allowed is None else s.join(allowed.select("subset"), "subset", "left_semi")


def storage_estimate(rows: DataFrame, layers: int, hidden: int, bytes_per_value: int = 2) -> DataFrame:
    """Bytes of hidden states = ``sum(seq_len) * layers * hidden * bytes``."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum("seq_len").cast("bigint").alias("tokens"),
        (F.sum("seq_len").cast("bigint") * F.lit(layers * hidden * bytes_per_value)).cast("bigint").alias("bytes"),
    )


def next_pow2(x: float) -> int:
    """Plain-Python twin of the A4 budget (tests)."""
    return 2 ** math.ceil(math.log2(max(x, 1)))


def acceptance_report(acc: DataFrame, max_positions: int = 100) -> DataFrame:
    """Totals, acceptance length and one line per position (the first
    ``max_positions``), as a long, ordered result ``(metric, position, value)``."""
    r = acceptance_from_counters(acc)
    return r.filter(F.col("position") < max_positions).orderBy("metric", "position")
