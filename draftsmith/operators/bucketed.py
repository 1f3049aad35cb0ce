"""Bucketed stores and Bloom filters for resume and backfill.

Prepared rows and artefacts that are bucketed alike by the sample id are joined
bucket by bucket: payloads are sorted where they lie and never exchanged.  Where
the rows are not bucketed, a Bloom filter over the existing ids lets rows that
are certainly missing skip the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from draftsmith.operators.resume import missing_ids

BLOOM_WORDS = 1 << 19  # 64-bit words of a filter at most: 4 MB, whatever it is built from
_HASHES = 5


def open_store(spark: SparkSession, table: str, path: str, schema: StructType, key: str, buckets: int) -> DataFrame:
    """J2 + J4 + J5: the store at ``path`` as the table ``table`` of ``buckets`` buckets by ``key``
    (an empty one if there is none).  Stores that are joined must have the same
    number of buckets; a bucket of some 200 MB suits a task."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def append(rows: DataFrame, table: str, key: str, buckets: int) -> None:
    """Add rows to a bucketed store; one exchange, so that each bucket gets one file."""
    spark = rows.sparkSession
    rows.select(*spark.table(table).columns).repartition(buckets, key).write.insertInto(table)
    spark.catalog.refreshTable(table)


def _place(key: str, words: int) -> tuple[Column, Column]:
    """Word of a key and the bits that it sets there."""
    h = F.xxhash64(key)
    bits = F.lit(0).cast("bigint")
    for i in range(_HASHES):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), at))
    return F.pmod(F.xxhash64(F.lit("word"), key), F.lit(words)), bits


def bloom_words(existing: DataFrame, key: str = "sample_id", words: int | None = None) -> DataFrame:
    """One row with the filter's ``words`` (array of longs): about 16 bits an id, up
    to ``BLOOM_WORDS``; a filter that is too small only lets more rows through."""
    if words is None:
        n = existing.select(key).count()
        words = max(1, min(BLOOM_WORDS, 1 << max(0, (n - 1).bit_length() - 2)))
    word, bits = _place(key, words)
    used = existing.filter(F.col(key).isNotNull()).select(word.alias("w"), bits.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    every = existing.sparkSession.range(words).withColumnRenamed("id", "w").join(used, "w", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("bigint")).alias("b")))), lambda x: x["b"]).alias("words"))


def maybe_in(words: DataFrame, key: str = "sample_id") -> Column:
    """False only for keys that were not among those of ``words`` (for certain)."""
    array = words.select("words").scalar()
    word, bits = _place(key, F.size(array))
    return F.get(array, word.cast("int")).bitwiseAND(bits) == bits


def missing_by_bloom(todo: DataFrame, existing: DataFrame, key: str = "sample_id", words: int | None = None) -> DataFrame:
    """:func:`missing_ids` for a payload that is not bucketed and mostly
    missing: only rows that the filter lets through meet the existing ids in a
    join (which settles its false positives), the others are not exchanged."""
    maybe = F.coalesce(maybe_in(bloom_words(existing, key, words), key), F.lit(False))
    return todo.filter(~maybe).unionAll(missing_ids(todo.filter(maybe), existing, key).select(*todo.columns))
