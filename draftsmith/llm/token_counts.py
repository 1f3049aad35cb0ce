"""Token totals for every context limit from an exact length histogram.

Documents are aggregated by their encoded length.  For a length ``L`` suffix
sums over the histogram give the documents and tokens at or above ``L``; from
these the total after truncation to any limit ``c`` is
``tokens below c + c * documents at or above c``, and quantiles are lookups.

On Spark: one narrow Arrow pass counts tokens, the histogram is one aggregate
with map-side combine (a length that a third of all documents have is one row
per task).  Suffix sums run in two levels, over ranges of ``_RANGE`` lengths
and inside each range, so no window holds more than one range or one row per
range.

Defined results: null and empty texts have length zero and are counted; repeated
rows count each; an empty table gives an empty summary, totals of zero and null
quantiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftsmith.llm import bpe
from draftsmith.session import checkpoint_dir

_RANGE = 256


def encoded_lengths(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, length)`` of every row."""
    vocab = bpe.vocabulary(docs.sparkSession, vocab_path)
    return bpe.encoded_lengths(docs.select(id_col, text_col), vocab, text_col=text_col).select(id_col, "length")


def length_histogram(lengths: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``(length, n_docs, first_id)``."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"), F.min(id_col).alias("first_id"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """The histogram with ``docs_ge``, ``tokens_ge`` (this length or more),
    ``docs_le`` and ``truncated_tokens`` (total with the limit at this length)."""
    x = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("r", F.floor(F.col("length") / _RANGE))
    ranges = x.groupBy("r").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    every = Window.orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = ranges.select(
        "r",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(every).alias("d_all"),
        F.sum("t").over(every).alias("t_all"),
    )
    here = Window.partitionBy("r").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("d_in", F.sum("n_docs").over(here)).withColumn("t_in", F.sum("tokens").over(here)).join(tops, "r")
    x = x.withColumn("docs_ge", F.col("d_in") + F.col("d_above")).withColumn("tokens_ge", F.col("t_in") + F.col("t_above"))
    return x.select(
        "length",
        "n_docs",
        "first_id",
        "docs_ge",
        "tokens_ge",
        (F.col("d_all") - F.col("docs_ge") + F.col("n_docs")).alias("docs_le"),
        (F.col("t_all") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_tokens"),
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, tokens, docs_cut)`` for stated context limits.  A limit
    falls between two lengths; what is above it is the smallest length above."""
    answers = [
        F.struct(
            F.lit(int(c)).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("length") <= c, F.col("length") * F.col("n_docs"))), F.lit(0)).alias("below"),
            F.coalesce(F.max(F.when(F.col("length") > c, F.col("docs_ge"))), F.lit(0)).alias("docs_cut"),
        )
        for c in limits
    ]
    one = sums.agg(F.array(*answers).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return one.select("context_limit", (F.col("below") + F.col("context_limit") * F.col("docs_cut")).alias("tokens"), "docs_cut")


def length_quantiles(sums: DataFrame, quantiles: list[float]) -> DataFrame:
    """``(quantile, length)``: the smallest length that at least this share of
    the documents does not exceed (one row per quantile; null when empty)."""
    share = F.col("docs_le") / (F.col("docs_le") + F.col("docs_ge") - F.col("n_docs"))
    picks = [F.struct(F.lit(float(p)).alias("quantile"), F.min(F.when(share >= p, F.col("length"))).alias("length")) for p in quantiles]
    return sums.agg(F.array(*picks).alias("a")).select(F.explode("a").alias("a")).select("a.*")


def token_counts(docs: DataFrame, vocab_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Suffix sums of the length histogram, a row per distinct length.  The
    histogram is written to the checkpoint folder, as it is read twice."""
    checkpoint_dir(docs.sparkSession)
    return suffix_sums(length_histogram(encoded_lengths(docs, vocab_path, id_col=id_col, text_col=text_col), id_col=id_col).checkpoint())
