"""Large JSON documents read by many tasks.

A document that is one array of objects has no line ends to split at.  It is
read as text whose records end at ``}`` instead: such records can be split by
byte ranges in any file system that Spark reads, a multi-byte character or an
escape never holds the byte, and no task sees more than its range.  Where the
pieces stand is then found by prefix sums in two levels, as for any scan: the
quotes of a piece flip "inside a string", brackets outside of strings change the
depth; sums by byte range give each range its start, a window inside the range
the rest.  An element ends at a ``}`` outside of strings that leads back to the
depth of the array.  Pieces are put together within their range; only elements
that cross the end of a range (one a range) are put together across ranges.

Documents are UTF-8; a document that is one object is its own element.  Elements
that are no objects are not read.  A file with broken JSON yields nulls where
its elements cannot be parsed; a document cut off in the middle loses its last
element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE = "_file"
_RANGE = ["_file", "_start"]


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def _before(per_range: DataFrame, col: str) -> DataFrame:
    """``col`` of each byte range summed over the ranges before it (one row a range)."""
    earlier = Window.partitionBy(_FILE).orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    return per_range.withColumn(col, F.coalesce(F.sum(col).over(earlier), F.lit(0)))


def _pieces(text: DataFrame) -> DataFrame:
    """``(_file, _start, _at, piece, bare)``: records in order of ``_at`` within a
    byte range; ``bare`` is the record without escapes."""
    return text.select(
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("piece"),
        F.regexp_replace("value", r"\\.", "").alias("bare"),
    )


def element_texts(spark: SparkSession, paths: list[str] | str, *, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``(_file, _element, value)``: the text of each array element (or the whole
    object) of the JSON documents, numbered within its file."""
    r = spark.read.option("lineSep", "}")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    x = _pieces(r.text(paths))
    inside = Window.partitionBy(*_RANGE).orderBy("_at")
    upto, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)

    # quotes before each range, then before each piece
    x = x.withColumn("_quotes", _count(F.col("bare"), '"'))
    quotes = _before(x.groupBy(*_RANGE).agg(F.sum("_quotes").alias("_quoted")), "_quoted")
    x = x.join(quotes, _RANGE)
    start = F.col("_quoted") + F.coalesce(F.sum("_quotes").over(earlier), F.lit(0))
    x = x.withColumn("_open", start % 2 == 1).withColumn("_shut", (start + F.col("_quotes")) % 2 == 0)
    # what is outside of strings, and how it changes the depth (the record's own } included)
    outside = F.regexp_replace(F.when(F.col("_open"), F.concat(F.lit('"'), "bare")).otherwise(F.col("bare")), r'"[^"]*("|$)', "")
    x = x.withColumn("_out", outside)
    depth = _count(F.col("_out"), "{") + _count(F.col("_out"), "[") - _count(F.col("_out"), "]") - F.col("_shut").cast("int")
    x = x.withColumn("_step", depth).select(*_RANGE, "_at", "piece", "_shut", "_step")
    # an array's elements are one level down; a document starts with its first range
    first = x.filter("_start = 0").groupBy(_FILE).agg(F.min_by("piece", "_at").alias("_head"))
    first = first.select(_FILE, F.col("_head").rlike(r"^[\s\uFEFF]*\[").cast("int").alias("_level"))
    depths = _before(x.groupBy(*_RANGE).agg(F.sum("_step").alias("_deep")), "_deep").join(first, _FILE, "left")
    x = x.join(depths, _RANGE).withColumn("_depth", F.col("_deep") + F.sum("_step").over(upto))
    x = x.withColumn("_ends", (F.col("_shut") & (F.col("_depth") == F.coalesce("_level", F.lit(0)))).cast("int"))
    x = x.withColumn("_n", F.coalesce(F.sum("_ends").over(earlier), F.lit(0)))
    # pieces of one element within a range, in order; _done: its end is among them
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", "piece"))), lambda p: p["piece"])
    parts = x.groupBy(*_RANGE, "_n").agg(F.array_join(ordered, "}").alias("text"), F.max("_ends").alias("_done"))
    ended = _before(x.groupBy(*_RANGE).agg(F.sum("_ends").alias("_ended")), "_ended")
    parts = parts.join(ended, _RANGE).select(_FILE, "_start", (F.col("_ended") + F.col("_n")).alias("_element"), "text", "_done", (F.col("_n") == 0).alias("_first"))
    # whole unless it comes first or ends later: those meet their other parts
    whole = parts.filter(~F.col("_first") & (F.col("_done") == 1)).select(_FILE, "_element", "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_start", "text"))), lambda p: p["text"])
    split = parts.filter(F.col("_first") | (F.col("_done") == 0)).groupBy(_FILE, "_element").agg(F.array_join(ordered, "}").alias("text"), F.max("_done").alias("_done"))
    out = whole.unionAll(split.filter("_done = 1").select(_FILE, "_element", "text"))
    return out.select(_FILE, "_element", F.concat(F.regexp_replace("text", r"^[\s\uFEFF\[,]+", ""), F.lit("}")).alias("value"))


def read_json_documents(spark: SparkSession, paths: list[str] | str, schema: T.StructType, *, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """Rows of ``schema``, one per array element, with ``_file`` and ``_element``."""
    x = element_texts(spark, paths, glob=glob, recursive=recursive)
    return x.select(F.from_json("value", schema).alias("r"), _FILE, "_element").select("r.*", _FILE, "_element")
