"""Conversation sources.

Raw chat data is read with an explicit schema (never inferred) into the
array form ``conversations: array<struct<...>>``; the per-source
normalisers are DataFrame → DataFrame functions of higher-order column
expressions, and :func:`to_turns` turns the result into the long form every
operator works on.

Named presets are re-aimed: there is no network access, so a preset names
a dataset location *under a data root* (``{root}/{dataset_id}[/{subset}]/{split}``,
Parquet or JSON), plus its filter and normaliser.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.operators.normalize import conversations_to_long
from draftsmith.sources.json_arrays import read_json_documents

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("base64", T.StringType()),
        T.StructField("image", T.StringType()),
    ]
)
TOOL_CALL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])),
    ]
)
TURN = T.StructType(
    [
        T.StructField("from", T.StringType()),
        T.StructField("role", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("parts", T.ArrayType(PART)),
        T.StructField("tool_calls", T.ArrayType(TOOL_CALL)),
        T.StructField("tool_call_id", T.StringType()),
        T.StructField("thinking", T.StringType()),
        T.StructField("reasoning_content", T.StringType()),
    ]
)
RAW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("uuid", T.StringType()),
        T.StructField("idx", T.LongType()),
        T.StructField("conversations", T.ArrayType(TURN)),
        T.StructField("messages", T.ArrayType(TURN)),
        T.StructField("tools", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("input", T.ArrayType(TURN)),
        T.StructField("output", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("language", T.StringType()),
    ]
)


_JSON_IDS = 1 << 62  # rows of JSON documents are numbered below the negative of this


def _read_json_documents(spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``.json`` documents (one object or an array each), an array read by as many
    tasks as it has byte ranges.  A row without ``idx`` gets the negative number of
    its file (in the order of their paths) and of its place there."""
    df = read_json_documents(spark, path, schema, glob=glob, recursive=recursive)
    if "idx" not in df.columns:
        return df.drop("_file", "_element")
    plain = lambda c: F.regexp_replace(c, "^([A-Za-z0-9.+-]+):/+", "$1:/")
    files = spark.createDataFrame([(f, -_JSON_IDS - (k << 34)) for k, f in enumerate(sorted(df.inputFiles()))], "_path string, _base bigint")
    df = df.join(files.select(plain(F.col("_path")).alias("_path"), "_base"), plain(F.col("_file")) == F.col("_path"), "left")
    return df.withColumn("idx", F.coalesce(F.col("idx"), F.col("_base") - F.col("_element"))).drop("_file", "_element", "_path", "_base")


def _read_json_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All files below a folder: ``.jsonl`` files are line-delimited, ``.json`` files documents."""
    frames = []
    lines = lambda: spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").json(path)
    for read in (lines, lambda: _read_json_documents(spark, path, schema, "*.json", True)):
        try:
            df = read()
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            if df.inputFiles():
                frames.append(df)
    if not frames:
        raise ValueError(f"{path}: the folder holds no JSON or JSON-lines files")
    return functools.reduce(DataFrame.unionByName, frames)


def list_content(df: DataFrame) -> DataFrame:
    """Turns whose content is a list of parts (read as its JSON text) get the
    list as ``parts`` and its texts, with ``<image>`` for other parts, as content."""

    def split(t: Column) -> Column:
        given = F.from_json(F.when(F.ltrim(t["content"]).startswith("["), t["content"]), T.ArrayType(PART))
        parsed = F.when((F.size(given) > 0) & F.forall(given, lambda p: p["type"].isNotNull()), given)
        text = F.array_join(F.transform(parsed, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.lit("<image>"))), "")
        return t.withField("parts", F.coalesce(t["parts"], parsed)).withField("content", F.coalesce(text, t["content"]))

    for c in ("conversations", "messages", "input"):
        if c in df.columns and df.schema[c].dataType == T.ArrayType(TURN):
            df = df.withColumn(c, F.transform(c, split))
    return df


def with_row_ids(df: DataFrame) -> DataFrame:
    """Raw rows as they leave a reader: list content split (P9), and an ``idx`` in
    every row: its own, else a negative number that no other row of the source
    has (the same on every read of the same files and splits), so that files
    without ids keep one conversation per row.  (Rows of JSON documents have one already.)"""
    df = list_content(df)
    if "idx" not in df.columns:
        return df
    return df.withColumn("idx", F.coalesce(F.col("idx"), -1 - F.monotonically_increasing_id()))


def load_raw(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """One ``.json``/``.jsonl`` file, or a directory searched recursively.

    A directory without any ``.json``/``.jsonl`` file raises ``ValueError``
    (checked from the file listing, ``inputFiles()`` — metadata only).
    """
    if path.endswith(".jsonl"):
        return with_row_ids(spark.read.schema(schema).json(path))
    if path.endswith(".json"):
        return with_row_ids(_read_json_documents(spark, path, schema))
    return with_row_ids(_read_json_files(spark, path, schema))


def _turn(role: str | Column, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(
        F.lit(None).cast("string").alias("from"), r.alias("role"), F.lit(None).cast("string").alias("value"),
        content.cast("string").alias("content"), F.lit(None).cast(T.ArrayType(PART)).alias("parts"),
        F.lit(None).cast(T.ArrayType(TOOL_CALL)).alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"),
        F.lit(None).cast("string").alias("thinking"), F.lit(None).cast("string").alias("reasoning_content"),
    )


def turn_struct(role, content: Column) -> Column:
    """A turn in the source schema's struct type (other fields null)."""
    return _turn(role, content)


def normalize_messages(df: DataFrame) -> DataFrame:
    """``messages`` → ``conversations`` (when present)."""
    return df.withColumn("conversations", F.coalesce(F.col("messages"), F.col("conversations")))


def normalize_question_answer(df: DataFrame) -> DataFrame:
    """P5: ``question``/``answer`` → a user and an assistant turn."""
    return df.withColumn("conversations", F.array(_turn("user", F.col("question")), _turn("assistant", F.col("answer"))))


def normalize_input_output(df: DataFrame) -> DataFrame:
    """``input`` turns followed by ``output`` as the assistant turn."""
    return df.withColumn("conversations", F.concat(F.col("input"), F.array(_turn("assistant", F.col("output")))))


def coco_filter(df: DataFrame) -> DataFrame:
    """Keep rows whose ``image`` starts with ``coco/``."""
    return df.filter(F.col("image").startswith("coco/"))


def normalize_image_chat(spark: SparkSession, df: DataFrame, image_root: str, check_exists: bool = True) -> DataFrame:
    """User text split on newlines, a ``<image>`` line becomes an image part at
    ``image_root/<image without coco/>``; assistant text is one text part.

    With ``check_exists``, rows whose image file is missing fail the job: the
    paths are checked by a left-anti join against a ``binaryFile`` listing of
    ``image_root`` (only ``path`` is read — no file contents).
    """
    path = F.concat(F.lit(image_root.rstrip("/") + "/"), F.regexp_replace(F.col("image"), "^coco/", ""))
    out = df.withColumn("_img", path)
    if check_exists:
        listing = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(image_root)
            .select(F.regexp_replace("path", "^file:", "").alias("_img"))
        )
        missing = out.select("_img").distinct().join(listing, "_img", "left_anti")
        # a filter predicate (not a dropped column, which Catalyst would prune)
        out = out.join(missing.withColumn("_missing", F.lit(True)), "_img", "left").filter(
            F.when(F.col("_missing"), F.raise_error(F.concat(F.lit("No image found at "), F.col("_img"))).isNull()).otherwise(F.lit(True))
        ).drop("_missing")

    def parts_of(t):
        is_user = F.coalesce(t["from"], t["role"]).isin("human", "user")
        text = F.coalesce(t["value"], t["content"])
        user_parts = F.transform(
            F.split(text, "\n"),
            lambda p: F.when(p == "<image>", F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), F.col("_img").alias("path"),
                                                       F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("base64"), F.lit(None).cast("string").alias("image")))
            .otherwise(F.struct(F.lit("text").alias("type"), p.alias("text"), F.lit(None).cast("string").alias("path"),
                                F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("base64"), F.lit(None).cast("string").alias("image"))),
        )
        asst_parts = F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("path"),
                                      F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("base64"), F.lit(None).cast("string").alias("image")))
        return t.withField("parts", F.when(is_user, user_parts).otherwise(asst_parts))

    return out.withColumn("conversations", F.transform("conversations", parts_of)).drop("_img")


def text_parts(parts: Column, content: Column) -> Column:
    """A bare string content becomes one text part (multimodal only)."""
    single = F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), F.lit(None).cast("string").alias("path"),
                              F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("base64"), F.lit(None).cast("string").alias("image")))
    return F.coalesce(parts, single)


def request_parts(parts: Column) -> Column:
    """P10 + F17: parts for a chat request: text stays; ``path`` → ``file://`` URL part;
    ``url`` stays a URL part; inline base64 / raw image objects and unknown
    types are errors (``raise_error`` at run time)."""
    def adapt(p):
        return (
            F.when(p["type"] == "text", F.struct(F.lit("text").alias("type"), p["text"].alias("text"), F.lit(None).cast("string").alias("url")))
            .when(p["path"].isNotNull(), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("file://"), p["path"]).alias("url")))
            .when(p["url"].isNotNull(), F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), p["url"].alias("url")))
            .when(p["base64"].isNotNull() | p["image"].isNotNull(), F.raise_error(F.lit("inline image data is not supported in requests")).cast("struct<type:string,text:string,url:string>"))
            .otherwise(F.raise_error(F.concat(F.lit("unsupported part type: "), F.coalesce(p["type"], F.lit("null")))).cast("struct<type:string,text:string,url:string>"))
        )

    return F.transform(parts, adapt)


def is_multimodal(conv: Column) -> Column:
    """Any turn's content is a list of parts."""
    return F.exists(conv, lambda t: t["parts"].isNotNull())


def parse_tools(tools: Column) -> Column:
    """Tools JSON per conversation: empty → null, bad JSON → null.

    Returns a ``VariantType`` (``try_parse_json``); a list stays a list.
    """
    return F.when(F.trim(F.coalesce(tools, F.lit(""))).isin("", "null", "[]"), F.lit(None)).otherwise(F.try_parse_json(tools))


def to_turns(df: DataFrame, id_col: str = "idx") -> DataFrame:
    """Array form → long form ``(id, turn, from, role, value, content, ...)``."""
    return conversations_to_long(df, id_col, "conversations")


@dataclass(frozen=True)
class SourceSpec:
    """S3 + X1: a named preset — dataset location, filter (a DataFrame →
    DataFrame predicate step) and normaliser (a DataFrame transform)."""

    name: str
    dataset_id: str
    split: str
    subset: str | None = None
    predicate: Callable[[DataFrame], DataFrame] | None = None
    normalize: Callable[[DataFrame], DataFrame] | None = None


# The preset names and the public dataset each one points to.
PRESETS: dict[str, SourceSpec] = {
    "sharegpt": SourceSpec("sharegpt", "Aeala/ShareGPT_Vicuna_unfiltered", "train"),
    "ultrachat": SourceSpec("ultrachat", "HuggingFaceH4/ultrachat_200k", "train_sft", normalize=normalize_messages),
    "gsm8k": SourceSpec("gsm8k", "openai/gsm8k", "train", subset="main", normalize=normalize_question_answer),
    "magpie": SourceSpec("magpie", "Magpie-Align/Magpie-Llama-3.1-Pro-300K-Filtered", "train"),
    "nemotron": SourceSpec("nemotron", "nvidia/Llama-Nemotron-Post-Training-Dataset", "chat", subset="SFT", normalize=normalize_input_output),
    "sharegpt4v_coco": SourceSpec("sharegpt4v_coco", "Lin-Chen/ShareGPT4V", "train", subset="ShareGPT4V", predicate=coco_filter),
    "open-perfectblend": SourceSpec("open-perfectblend", "mlabonne/open-perfectblend", "train"),
}


# hf:<id>, then nothing, :<split>, or :<subset>:<split>
_HUB_SPEC = re.compile(r"(?:hf:)?(?P<id>[^:]+)(?:(?::(?P<subset>[^:]+))?:(?P<split>[^:]+))?")


def parse_hub_spec(spec: str) -> tuple[str, str | None, str]:
    """Dataset id, subset (or None) and split (``train`` if not named)."""
    m = _HUB_SPEC.fullmatch(spec)
    if m is None:
        raise ValueError(f"{spec!r} does not read as hf:<id>[[:<subset>]:<split>] with no part empty")
    return m["id"], m["subset"], m["split"] or "train"


def _dataset_dir(root: str, ds: str, subset: str | None, split: str) -> str:
    return "/".join(p for p in (root.rstrip("/"), ds, subset, split) if p)


def _read_dataset_dir(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    df = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    return with_row_ids(df if df.inputFiles() else _read_json_files(spark, path, schema))


def read_conversations(
    spark: SparkSession,
    source: str,
    data_root: str | None = None,
    schema: T.StructType = RAW_SCHEMA,
    image_root: str | None = None,
) -> DataFrame:
    """S5 (S3, X1: presets by name): file → directory → preset → ``hf:`` spec → error.

    Returns the array form with ``conversations`` (normalised by the
    preset's normaliser) and the source's other columns.
    """
    if not source.startswith("hf:") and (source.endswith((".json", ".jsonl")) or "/" in source or os.path.isdir(source)):
        return load_raw(spark, source, schema)  # a file or folder, also one that only Spark reaches
    root = data_root or os.environ.get("DRAFTSMITH_DATA_ROOT", "")
    if source in PRESETS:
        spec = PRESETS[source]
        df = _read_dataset_dir(spark, _dataset_dir(root, spec.dataset_id, spec.subset, spec.split), schema)
        if spec.predicate is not None:
            df = spec.predicate(df)
        if spec.name == "sharegpt4v_coco":
            return normalize_image_chat(spark, df, image_root or os.environ.get("COCO_DIR", "coco/"))
        return spec.normalize(df) if spec.normalize is not None else df
    if source.startswith("hf:"):
        ds, subset, split = parse_hub_spec(source)
        df = _read_dataset_dir(spark, _dataset_dir(root, ds, subset, split), schema)
        if df.filter(F.col("conversations").isNotNull()).limit(1).count() == 0:
            raise ValueError(f"dataset '{ds}' (split '{split}') is not in conversations format: no 'conversations' values")
        return df
    raise ValueError(f"{source!r} is neither a .json/.jsonl file, a folder, a preset ({sorted(PRESETS)}) nor an hf:<id>[:<subset>][:<split>] spec")


def seen_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids already written to an output (JSON lines); broken lines are skipped.

    The key is ``id``, else ``metadata.idx`` (Q1: the reference reads keys
    the writer never writes; we read what is written).
    """
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("metadata", T.StructType([T.StructField("idx", T.LongType())]))])
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df.select(F.coalesce(F.col("id"), F.col("metadata.idx").cast("string")).alias("key")).filter(F.col("key").isNotNull()).distinct()


def language_filter(df: DataFrame, language: str | None, col: str = "language") -> DataFrame:
    """P25: equality filter on the language column (before any generation)."""
    return df if language is None else df.filter(F.col(col) == language)
