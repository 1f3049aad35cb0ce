"""Mixing sources to target weights by Poisson replication.

A source with ``n`` rows and target share ``w`` of ``total`` rows has the mean
repetition rate ``total * w / n``.  Each row inverts the Poisson distribution
with that mean at a uniform number hashed from ``(seed, id)``: the number of
copies is the count of cumulative probabilities not above it.  A rate over
``PIECE_RATE`` is the sum of that many equal pieces as keep below it, each drawn
by a uniform number of its own (a sum of independent Poisson numbers is one),
so a source of few rows has no largest rate.  Copies are exploded and dealt out
by a hash of ``(seed, id, copy)``, and sorted by it inside each partition, which
is a random order of the whole result.

On Spark: one aggregate for the row counts (map-side combine; a hot source is
one row per task), a table of one distribution per source, and the one global
shuffle that the method asks for.  The distributions are broadcast only up to
``BROADCAST_BYTES`` (measured), beyond that they are joined by a shuffle, with the
same rows.  Rows with more than one piece are dealt out by
piece before their copies are made, so no task makes all copies of a row.  The
number of copies is a pure function of seed, id and rate, so lost tasks come
back the same.

Defined results: rows with a null source form a source of their own; sources
without a target weight get weight zero (their rows go) when weights are given;
rows that share an id are repeated alike, a null id counts as an empty one; an
empty table stays empty; any source may have any rate, but a given ``total`` of
more than ``MAX_GROWTH`` times the rows there are raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftsmith.session import checkpoint_dir

BROADCAST_BYTES = 16 << 20  # measured size of the rates up to which they are broadcast; else both sides are exchanged
PIECE_RATE = 700.0  # exp(-700) is still a normal double
MAX_GROWTH = 500
SEED = 17


def _hash52(*parts: Column) -> Column:
    """Top 52 bits of an md5 over the colon-joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def _uniform(*parts: Column) -> Column:
    return (_hash52(*parts) + 0.5) / F.lit(float(1 << 52))


def _terms(rate: Column) -> Column:
    return F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")


def poisson_cdf(rate: Column) -> Column:
    """Cumulative probabilities of 0, 1, ... copies, to beyond double precision."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * rate / k
        c = a["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.array_append(a["all"], c).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), _terms(rate)), start, step, lambda a: a["all"])


def source_rates(docs: DataFrame, *, source_col: str, weights: dict | None = None, power: float = 0.5, total: int | None = None) -> DataFrame:
    """``(source, rate, pieces, cdf)``: target weights as given, or in proportion
    to the source's row count to the ``power``; ``total`` rows are aimed at
    (default: as many as there are); ``cdf`` is that of one piece."""
    n = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        pairs = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        w = F.coalesce(*pairs, F.lit(0.0))
    n = n.withColumn("w", w).checkpoint()
    sums = n.agg(F.sum("w").alias("sw"), F.sum("n").alias("sn")).first()  # two numbers
    rows = sums["sn"] or 0
    if total is not None and rows and total > MAX_GROWTH * rows:
        raise ValueError(f"repetition rate too high: {total} rows of {rows}")
    sw, sn = float(sums["sw"] or 0), float(total if total is not None else rows)
    rate = F.lit(sn) * F.col("w") / F.lit(sw) / F.col("n") if sw else F.lit(0.0)
    r = n.withColumn("rate", rate)
    r = r.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE_RATE), F.lit(1)).cast("int"))
    return r.select("source", "rate", "pieces", poisson_cdf(F.col("rate") / F.col("pieces")).alias("cdf"))


def _pieced(x: DataFrame, did: Column, text_col: str, seed: int) -> DataFrame:
    """A row per copy of the rows whose rate has several pieces."""
    us = F.transform(F.sequence(F.lit(1), F.col("__ms_pieces")), lambda j: _uniform(F.concat(F.lit(f"{seed}/"), j.cast("string")), did))
    x = x.withColumn("__ms_counts", F.transform(us, lambda u: F.size(F.filter("__ms_cdf", lambda c: c <= u))))
    x = x.drop("__ms_cdf").withColumn("__ms_ends", F.transform("__ms_counts", lambda _, i: F.aggregate(F.slice("__ms_counts", F.lit(1), i + 1), F.lit(0), lambda a, n: a + n)))
    x = x.withColumn("__ms_piece", F.explode(F.arrays_zip("__ms_counts", "__ms_ends"))).drop("__ms_counts", "__ms_ends")
    x = x.select("*", F.col("__ms_piece.__ms_counts").alias("__ms_n"), F.col("__ms_piece.__ms_ends").alias("__ms_end")).where("__ms_n > 0")
    x = x.repartition(did, "__ms_end", text_col)
    return x.withColumn("__ms_copy", F.explode(F.sequence(F.col("__ms_end") - F.col("__ms_n") + 1, F.col("__ms_end"))))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: dict | None = None, power: float = 0.5, total: int | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` repeated to the target weights, in a random order, with columns
    ``copy`` (from 1) and ``shuffle_key``."""
    checkpoint_dir(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rates = source_rates(docs, source_col=source_col, weights=weights, power=power, total=total).select(F.col("source").alias("__ms_source"), F.col("pieces").alias("__ms_pieces"), F.col("cdf").alias("__ms_cdf")).checkpoint()
    size = F.sum(F.size("__ms_cdf") * 8 + F.coalesce(F.octet_length(F.col("__ms_source").cast("string")), F.lit(0)) + 64)
    facts = rates.agg(size.alias("bytes"), F.max("__ms_pieces").alias("pieces")).first()
    if (facts["bytes"] or 0) <= BROADCAST_BYTES:
        rates = F.broadcast(rates)
    did = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    u = _uniform(F.lit(str(seed)), did)
    kept = [F.col(f"`{c}`") for c in names]
    x = docs.join(rates, F.col(source_col).eqNullSafe(F.col("__ms_source")), "left")

    few = x.where("__ms_pieces = 1").withColumn("__ms_u", u).withColumn("__ms_n", F.size(F.filter("__ms_cdf", lambda c: c <= F.col("__ms_u"))))
    few = few.where("__ms_n > 0").withColumn("__ms_copy", F.explode(F.sequence(F.lit(1), F.col("__ms_n"))))
    copies = few.select(*kept, "__ms_copy")
    if (facts["pieces"] or 1) > 1:
        copies = copies.unionByName(_pieced(x.where("__ms_pieces > 1"), did, text_col, seed).select(*kept, "__ms_copy"))
    x = copies.withColumn("__ms_key", _hash52(F.lit(str(seed)), did, F.col("__ms_copy").cast("string")))
    # the text spreads rows that share an id
    x = x.select(*kept, F.col("__ms_copy").alias("copy"), F.col("__ms_key").alias("shuffle_key"))
    return x.repartition("shuffle_key", text_col).sortWithinPartitions("shuffle_key", id_col)
