"""Artefact and log sources.

File listings use the ``binaryFile`` source with only ``path``/``length``
selected, so file contents are never read (column pruning of ``content``).
Artefact payloads are Parquet array columns (the tensor container codecs of
the reference are not rebuilt; see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.operators.resume import artefact_index

PREPARED_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.LongType())),
        T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
        T.StructField("seq_len", T.IntegerType()),
    ]
)
ARTEFACT_SCHEMA = T.StructType(
    [
        T.StructField("sample_id", T.LongType()),
        T.StructField("token_ids", T.ArrayType(T.LongType())),
        T.StructField("hidden_states", T.ArrayType(T.ArrayType(T.FloatType()))),
    ]
)


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Prepared rows (Parquet)."""
    return spark.read.schema(PREPARED_SCHEMA).parquet(path)


def read_artefacts(spark: SparkSession, path: str) -> DataFrame:
    """S9 (re-aimed): artefact payloads as Parquet array columns
    ``(sample_id, token_ids, hidden_states)`` instead of one tensor file per row."""
    return spark.read.schema(ARTEFACT_SCHEMA).parquet(path)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """``(sample_id, seq_len)`` only — the arrays are pruned from the scan."""
    return read_prepared(spark, path).select("sample_id", "seq_len")


def list_files(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """File listing ``(path, length)``; an absent folder is an empty listing."""
    r = spark.read.format("binaryFile")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    try:
        return r.load(root).select("path", "length")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], "path string, length bigint")
        raise


def existing_artefacts(spark: SparkSession, root: str) -> DataFrame:
    """Indices of ``hs_<int>.safetensors`` files (non-integer names skipped)."""
    return artefact_index(list_files(spark, root, "hs_*.safetensors", recursive=False))


def legacy_sample_files(spark: SparkSession, root: str) -> DataFrame:
    """Recursive listing of files whose name ends with ``pt``."""
    return list_files(spark, root).filter(F.col("path").endswith("pt"))


def sample_lengths(spark: SparkSession, files: DataFrame, lengths_json: str | None, first_len: int | None = None) -> DataFrame:
    """Sample lengths from ``sample_lengths.json`` (``{"<N>": len}``; one file, or
    a folder of such) keyed by the part after the last ``_`` of each file stem; if *any* file has no entry,
    every length falls back to ``ceil(size / size_0 * len_0)`` (file 0 = first
    by path, ``len_0`` = its known length).

    One left join plus one ``bool_or`` aggregate (a scalar) decides the branch.
    The lengths are read as a table: records end at the commas, so a large file
    is read by many tasks and no map is ever one value.
    """
    stem = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    f = files.select("path", "length", F.element_at(F.split(stem, "_"), -1).alias("_key"))
    if lengths_json is not None:
        entry = r'^[\s\uFEFF{]*"([^"]*)"\s*:\s*(-?\d+)[\s}]*$'
        m = spark.read.option("lineSep", ",").text(lengths_json).filter(F.col("value").rlike(entry))
        f = f.join(m.select(F.regexp_extract("value", entry, 1).alias("_key"), F.regexp_extract("value", entry, 2).cast("bigint").alias("_len")), "_key", "left")
    else:
        f = f.withColumn("_len", F.lit(None).cast("bigint"))
    stats = f.agg(F.bool_or(F.col("_len").isNull()).alias("missing"), F.min_by("length", "path").alias("size0")).first()
    if not stats["missing"]:
        return f.select("path", F.col("_len").alias("length"))
    if first_len is None:
        raise ValueError("lengths must be estimated from file sizes but the first sample's length is unknown")
    est = F.ceil(F.col("length") / F.lit(float(stats["size0"])) * F.lit(first_len)).cast("bigint")
    return f.select("path", est.alias("length"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """S22 input: JSON-lines training log records (nested); flatten with
    :func:`draftsmith.operators.training_logs.flatten_record`."""
    schema = T.StructType(
        [
            T.StructField("step", T.LongType()),
            T.StructField("epoch", T.IntegerType()),
            T.StructField("train", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("val", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("profile", T.MapType(T.StringType(), T.DoubleType())),
            T.StructField("lr", T.DoubleType()),
        ]
    )
    return spark.read.schema(schema).json(path)


def read_val_metrics(spark: SparkSession, root: str) -> DataFrame:
    """``<root>/<epoch>/val_metrics.json`` → long ``(epoch, name, value)``."""
    raw = spark.read.text(f"{root.rstrip('/')}/*/val_metrics.json", wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]+)/val_metrics\.json$", 1).cast("int").alias("epoch"),
        F.from_json("value", "map<string,double>").alias("m"),
    )
    return raw.select("epoch", F.explode("m").alias("name", "value"))
