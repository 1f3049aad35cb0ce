"""Corpus pipeline: documents to token ids.

``STAGES`` are (name, function) pairs; each function takes
``(spark, docs, sf_dir)`` and its result is written as Parquet and read again
as the next one's ``docs``.  ``run`` applies them to the documents table.

1. quality rules: documents that fail the base rules or whose posterior
   probability of being good is under one half go;
2. line dedup: repeated runs of 50 or more words are deleted from all but their
   first place (``n_chars`` is counted anew; a document may become empty);
3. SimHash near-dedup: of each component the smallest id stays;
4. mixing: sources are repeated to weights in proportion to the square root of
   their size, and shuffled;
5. BPE: each text becomes token ids, decoded again as a check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftsmith.llm.bpe import encode_documents, ids_digest, tokenizer_file
from draftsmith.llm.lines import dedup_lines
from draftsmith.llm.mixing import mix_sources
from draftsmith.llm.quality import quality_filter
from draftsmith.llm.simhash import keep_one
from draftsmith.session import checkpoint_dir

ORACLE_SQL = None  # XXH64 fingerprints and BPE are not expressible in SQL; tests hold a brute-force version


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs).select(*docs.columns)


def _bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    x = encode_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return x.select(
        "doc_id",
        "source",
        "token_ids",
        F.size("token_ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("token_ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality rules", _quality),
    ("line dedup", _lines),
    ("SimHash near-dedup", _simhash),
    ("mixing sources", _mix),
    ("BPE encoding and decoding", _bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; stages meet in Parquet below the shared
    checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
