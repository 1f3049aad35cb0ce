"""Benchmark-result sources and sinks.

Result JSON files are read with an explicit nested schema, ``explode``d on
``benchmarks`` and projected with struct field access; the subset name
comes from the file name (``_metadata.file_path``).  Metrics text
(exposition format) is scanned with ``spark.read.text`` and parsed by
:func:`draftsmith.operators.evaluation.parse_exposition`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.operators.evaluation import parse_exposition
from draftsmith.sources.commits import write_once

STAT = T.StructType([T.StructField(k, T.DoubleType()) for k in ("mean", "median", "sum")])
METRIC = T.StructType([T.StructField("successful", STAT)])
# Benchmark metric keys and the result-row columns they feed.
METRICS_TO_EXTRACT = [
    ("requests_per_second", "rps_median"),
    ("request_latency", "latency_median_s"),
    ("inter_token_latency_ms", "itl_median_ms"),
    ("time_to_first_token_ms", "ttft_median_ms"),
    ("output_tokens_per_second", "output_tps_median"),
]
BASE_CSV_COLUMNS = [
    "subset", "strategy", "target_rate", "rps_median", "latency_median_s", "itl_median_ms",
    "ttft_median_ms", "output_tps_median", "total_output_tokens",
]
SKIP_STRATEGIES = ("throughput",)
# Curve metrics — result column, JSON key, statistic, larger-is-worse.
CURVE_METRICS = {
    "latency": ("latency_median_s", "request_latency", "median", True),
    "itl": ("itl_median_ms", "inter_token_latency_ms", "median", True),
    "ttft": ("ttft_median_ms", "time_to_first_token_ms", "median", True),
    "output_tps": ("output_tps_median", "output_tokens_per_second", "median", False),
}

BENCH_SCHEMA = T.StructType(
    [
        T.StructField(
            "benchmarks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("config", T.StructType([T.StructField("strategy", T.StructType([T.StructField("type_", T.StringType()), T.StructField("rate", T.DoubleType())]))])),
                        T.StructField("metrics", T.StructType([T.StructField(k, METRIC) for k, _ in METRICS_TO_EXTRACT] + [T.StructField("output_tokens", METRIC)])),
                        T.StructField("requests", T.StructType([T.StructField("successful", T.ArrayType(T.StructType([T.StructField("output_tokens", T.LongType())])))])),
                    ]
                )
            ),
        ),
        T.StructField("args", T.StructType([T.StructField("data_args", T.ArrayType(T.StructType([T.StructField("data_files", T.StringType())])))])),
    ]
)


def subset_from_path(path: Column) -> Column:
    """``(gen_len|sweep|sweeps)_<subset>.json`` → subset, else the file stem."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    m = F.regexp_extract(name, r"(?:gen_len|sweeps?)_(.+)\.json$", 1)
    return F.when(m != "", m).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def _read_bench(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    return spark.read.schema(BENCH_SCHEMA).option("multiLine", True).json(paths).select("*", F.col("_metadata.file_path").alias("_path"))


def read_sweeps(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Sweep files → result rows (``throughput`` strategy skipped).

    Files without benchmarks raise ``ValueError`` (one aggregate over the
    file list, not a driver loop over rows).
    """
    raw = _read_bench(spark, paths)
    empty = raw.filter(F.coalesce(F.size("benchmarks"), F.lit(0)) <= 0).select("_path").limit(1).collect()
    if empty:
        raise ValueError(f"{empty[0][0]}: the result file has an empty benchmark list")
    b = raw.select(subset_from_path(F.col("_path")).alias("subset"), F.explode("benchmarks").alias("b"))
    strategy = F.coalesce(F.col("b.config.strategy.type_"), F.lit("unknown"))
    cols = [F.col("subset"), strategy.alias("strategy"), F.col("b.config.strategy.rate").alias("target_rate")]
    cols += [F.col(f"b.metrics.{k}.successful.median").alias(c) for k, c in METRICS_TO_EXTRACT]
    cols += [F.col("b.metrics.output_tokens.successful.sum").alias("total_output_tokens")]
    return b.select(*cols).filter(~F.col("strategy").isin(*SKIP_STRATEGIES))


def read_generation_lengths(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``benchmarks[0].requests.successful[].output_tokens`` per subset."""
    raw = _read_bench(spark, paths)
    first = F.get("benchmarks", F.lit(0))
    if raw.filter(F.coalesce(F.size("benchmarks"), F.lit(0)) > 0).isEmpty():
        raise ValueError("no file holds a benchmark")
    return raw.select(subset_from_path(F.col("_path")).alias("subset"), F.explode(first["requests"]["successful"]).alias("r")).select(
        "subset", F.col("r.output_tokens").alias("output_tokens")
    )


def read_curve_csv(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """Result CSV → ``(subset, x=rps, y)``; constant strategy only, ``run_``
    prefix removed, unparsable rows skipped."""
    col = CURVE_METRICS[metric][0]
    df = spark.read.option("header", True).csv(path)
    return df.filter(F.col("strategy") == "constant").select(
        F.regexp_replace(F.coalesce(F.col("subset"), F.lit("unknown")), "^run_", "").alias("subset"),
        F.col("rps_median").try_cast("double").alias("x"),
        F.col(col).try_cast("double").alias("y"),
    ).dropna(subset=["x", "y"])


def read_curve_json(spark: SparkSession, paths: list[str] | str, metric: str) -> DataFrame:
    """Raw result JSON → ``(subset, x=median rps, y)``; constant strategy only.

    The subset is the stem of the first data file in the run's arguments.
    (Q5: the median, as in CSV curves, so that both can be pooled.)
    """
    _, key, stat, _ = CURVE_METRICS[metric]
    raw = _read_bench(spark, paths)
    subset = F.regexp_replace(F.regexp_extract(F.element_at("args.data_args", 1)["data_files"], r"([^/]+)$", 1), r"\.[^.]*$", "")
    b = raw.select(subset.alias("subset"), F.explode("benchmarks").alias("b")).filter(F.col("b.config.strategy.type_") == "constant")
    return b.select("subset", F.col("b.metrics.requests_per_second.successful.median").alias("x"), F.col(f"b.metrics.{key}.successful.{stat}").alias("y")).dropna(subset=["x", "y"])


def read_curves(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """Dispatch on the file suffix."""
    if path.endswith(".csv"):
        return read_curve_csv(spark, path, metric)
    if path.endswith(".json"):
        return read_curve_json(spark, path, metric)
    raise ValueError(f"{path}: curves are read from .csv or .json result files only")


def read_labelled(spark: SparkSession, sources: list[str], metric: str) -> DataFrame:
    """S17 + U2: ``LABEL=PATH`` arguments; runs with the same label are pooled."""
    frames = []
    for arg in sources:
        if "=" not in arg:
            raise ValueError(f"{arg!r}: a source is given as LABEL=PATH")
        label, path = (x.strip() for x in arg.split("=", 1))
        frames.append(read_curves(spark, path, metric).withColumn("label", F.lit(label)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_exposition(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Metrics text files → ``(engine, name, position, value)`` (a text scan)."""
    lines = spark.read.text(paths)
    return parse_exposition(lines, "value")


def write_result_rows(rows: DataFrame, path: str, extra_cols: list[str] = (), job: str | None = None) -> None:
    """K6: append rows with the fixed result columns (+ acceptance columns): a
    column that is absent is written empty, so later appends do not shift; others
    are ignored.  Rows of a named ``job`` are added once, however often it is run."""
    cols = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in dict.fromkeys([*BASE_CSV_COLUMNS, *extra_cols])]
    if job is not None:
        write_once(rows.select(*cols), path, job, "csv", header=True)
    else:
        rows.select(*cols).write.mode("append").option("header", True).csv(path)


def write_budget(budgets: DataFrame, path: str) -> None:
    """K7: ``{subset: max_tokens}`` as one JSON object (a small per-subset table)."""
    budgets.select(F.map_from_entries(F.collect_list(F.struct("subset", "max_tokens"))).alias("max_tokens")).coalesce(1).write.mode("overwrite").json(path)
