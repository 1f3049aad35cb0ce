"""Metrics job: benchmark results + counter scrapes → acceptance and speed-up
(SURVEY §3 "Metrics").  Scan text/JSON → explode → groupBy sums → full outer
join to the baseline → guarded ratios → pivot only at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftsmith.operators.evaluation import (
    acceptance_from_counters,
    accumulate,
    attach_acceptance,
    counter_delta,
    fit_curve,
    generation_lengths,
    interpolate_speedup,
)
from draftsmith.sources.benchmarks import CURVE_METRICS, read_exposition, read_generation_lengths, read_labelled, read_sweeps, write_budget, write_result_rows


def acceptance_between(spark: SparkSession, before: str | None, after: str) -> DataFrame:
    """A6 over ``after - before`` scrapes (J8): long ``(metric, position, value)``."""
    final = accumulate(read_exposition(spark, after))
    if before:
        final = counter_delta(final, accumulate(read_exposition(spark, before)))
    return acceptance_from_counters(final)


def acceptance_wide(acc: DataFrame, subset: str, positions: int | None = None) -> DataFrame:
    """Pivot the long acceptance result to one row (bounded: a few metrics and
    the draft positions).  ``positions`` columns, by default as many as occur."""
    if positions is None:
        last = acc.filter("metric = 'acceptance_at_pos'").agg(F.max("position")).first()[0]  # a scalar
        positions = 0 if last is None else last + 1
    cols = [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("num_drafts", "num_draft_tokens", "num_accepted_tokens", "acceptance_length")]
    cols += [
        F.max(F.when((F.col("metric") == "acceptance_at_pos") & (F.col("position") == i), F.col("value"))).alias(f"acceptance_at_pos_{i}")
        for i in range(positions)
    ]
    return acc.agg(*cols).withColumn("subset", F.lit(subset))


def evaluate_subset(spark: SparkSession, subset: str, sweep_json: str, scrape_before: str | None, scrape_after: str, out_csv: str | None = None) -> DataFrame:
    """One subset run: sweep rows (S12) with the acceptance columns attached (J10), appended to a CSV (K6)."""
    rows = read_sweeps(spark, sweep_json)
    acc = acceptance_wide(acceptance_between(spark, scrape_before, scrape_after), subset)
    out = attach_acceptance(rows, acc)
    if out_csv is not None:
        write_result_rows(out, out_csv, [c for c in acc.columns if c != "subset"])
    return out


def generation_budgets(spark: SparkSession, gen_len_files: list[str], out_json: str | None = None) -> DataFrame:
    """A3 + A4 (+K7): per subset generation-length statistics and token budget."""
    g = generation_lengths(read_generation_lengths(spark, gen_len_files))
    if out_json is not None:
        write_budget(g, out_json)
    return g


def speedup(spark: SparkSession, baseline: list[str], target: list[str], metric: str = "latency") -> DataFrame:
    """Speed-up curves of ``LABEL=PATH`` target runs over baseline runs, both
    smoothed first (O16)."""
    increasing = CURVE_METRICS[metric][3]
    b = read_labelled(spark, baseline, metric).select("subset", "x", "y")
    t = read_labelled(spark, target, metric).select("subset", "x", "y")
    return interpolate_speedup(fit_curve(b, ("subset",)), fit_curve(t, ("subset",)), increasing)
