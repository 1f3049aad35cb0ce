"""Token-budget batch packing.

``pack_batches`` packs over the histogram of lengths.  A histogram has at most
``max_len`` rows whatever the number of samples, so the driver can run
best-fit-decreasing on the counts: bins with equal room are one range of bin
numbers, and a length fills ranges, fullest first, instead of single bins.
What comes out is a list of runs: item ``i`` of the order (length descending,
seeded key) goes to bin ``first_bin + (i - first_item) // per_bin``.  Samples get
their place in that order from windows over (length, bucket of the key), with as
many buckets as the longest bar of the histogram needs, and their bin by looking
up the run.  The payload is never read, no bin exceeds ``max_len``, every sample is
placed, and the bins are those of sample-by-sample best-fit-decreasing.  Bins are
dealt to batches by a seeded stride over all bins, so each stretch of batches
holds long and short samples alike.

``pack_running_sums`` cuts running token sums instead: no pass for the histogram
and nothing on the driver, but bins that are less full.  It deals samples into
``shards`` hash shards, in seeded order inside each; a sample that lies inside one
stretch of ``max_len`` tokens is placed in that bin, those that cross a cut go round
again, ``LEVELS`` times, and then get a bin each.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftsmith.functions.hashing import HASH_RANGE, seeded_key
from draftsmith.session import broadcast_bounded, checkpoint_dir

SHARDS = 64
LEVELS = 3
BUCKET_ROWS = 1 << 18


def clip_or_drop(lengths: DataFrame, max_len: int, truncate_long: bool = True, len_col: str = "length") -> DataFrame:
    """Clip long samples to ``max_len`` or drop them."""
    if truncate_long:
        return lengths.withColumn(len_col, F.least(F.col(len_col), F.lit(max_len)).cast("bigint"))
    return lengths.filter(F.col(len_col) <= max_len)


def assign_bins(lengths: DataFrame, max_len: int, seed: int = 0, shards: int = SHARDS, levels: int = LEVELS) -> DataFrame:
    """``lengths(sample_id, length)`` with ``shard, level, cut, item`` from the
    running token sums: samples of equal ``(shard, level, cut)`` share a bin, in ``item`` order."""
    key = seeded_key(seed, "sample_id")
    x = lengths.withColumn("_key", key).withColumn("shard", F.pmod("_key", F.lit(shards)).cast("int"))
    order = Window.partitionBy("shard").orderBy("_key", "sample_id")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("level", F.lit(None).cast("int")).withColumn("cut", F.lit(None).cast("bigint"))
    for k in range(levels):
        end = F.sum(F.when(F.col("level").isNull(), F.col("length")).otherwise(0)).over(upto)
        x = x.withColumn("_end", end).withColumn("_at", F.floor((F.col("_end") - F.col("length")) / max_len))
        inside = F.col("level").isNull() & (F.floor(F.greatest(F.col("_end") - 1, F.col("_end") - F.col("length")) / max_len) == F.col("_at"))
        x = x.withColumn("cut", F.when(inside, F.col("_at")).otherwise(F.col("cut"))).withColumn("level", F.when(inside, k).otherwise(F.col("level")))
    alone = F.sum(F.when(F.col("level").isNull(), 1).otherwise(0)).over(upto) - 1
    x = x.withColumn("cut", F.when(F.col("level").isNull(), alone).otherwise(F.col("cut")))
    x = x.withColumn("level", F.coalesce("level", F.lit(levels))).withColumn("item", F.row_number().over(order) - 1)
    return x.select("sample_id", "length", "shard", "level", "cut", F.col("item").cast("bigint").alias("item"))


def bin_runs(counts: dict[int, int], max_len: int) -> tuple[list[tuple[int, int, int]], int]:
    """Best-fit-decreasing over ``{length: count}``: runs ``(first_item, first_bin,
    per_bin)`` in item order, and the number of bins.

    An item goes to the bin with least room that holds it, of equal ones to the
    first; a bin that took one takes more of the same length while it has room.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins), ascending
    rooms: list[int] = []
    runs: list[tuple[int, int, int]] = []
    items = bins = 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            insort(ranges[room], (first, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop(0)
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            else:
                room, first = max_len, bins
                n = -(-left // (max_len // length))
                bins += n
            per = room // length
            full = min(n, left // per)
            last = min(left - full * per, per) if full < n else 0  # of the one bin that is not filled up
            for start, size, each in ((first, full, per), (first + full, 1 if last else 0, last)):
                if size:
                    runs.append((items, start, each))
                    keep(room - each * length, start, size)
                    items += size * each
                    left -= size * each
                    first, n = start + size, n - size
            keep(room, first, n)
    return runs, bins


def stride(bins: int, seed: int) -> tuple[int, int]:
    """``(step, shift)`` of a seeded permutation ``(bin * step + shift) mod bins``:
    a step near the golden section spreads neighbours over the whole range."""
    step = max(1, min(int(bins * (0.6180339887 + 0.01 * (seed % 7))), (1 << 62) // max(1, bins)))
    while math.gcd(step, bins) > 1:
        step += 1
    return step, seed * 7919 % max(1, bins)


def ordered_items(sized: DataFrame, counts: dict[int, int], seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``sized(sample_id, size, ...)`` with ``item``, the 0-based place in the order
    (size descending, seeded key, id); no window holds much more than ``bucket_rows``."""
    before, seen = [], 0
    for size in sorted(counts, reverse=True):
        before.append((size, seen))
        seen += counts[size]
    buckets = -(-max(counts.values(), default=1) // bucket_rows)
    x = sized.withColumn("_key", seeded_key(seed, "sample_id"))
    x = x.withColumn("_sub", F.floor(F.col("_key") * buckets / HASH_RANGE).cast("int"))
    offsets = sized.sparkSession.createDataFrame(before, "size bigint, _before bigint")
    x = x.join(broadcast_bounded(offsets, len(before), "samples longer than each length"), "size")
    if buckets > 1:
        sums = x.groupBy("size", "_sub").agg(F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("size").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("size", "_sub", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_in"))
        x = x.join(sums, ["size", "_sub"]).withColumn("_before", F.col("_before") + F.col("_in"))
    here = Window.partitionBy("size", "_sub").orderBy("_key", "sample_id")
    return x.withColumn("item", (F.col("_before") + F.row_number().over(here) - 1).cast("bigint"))


def pack_batches(
    lengths: DataFrame,
    max_len: int,
    replicas: int,
    seed: int = 0,
    epoch: int = 0,
    truncate_long: bool = True,
    drop_last: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """O8 + O9 + O11: batch plan ``(batch_no, replica, sample_id, length, item)``.

    The order is the seeded permutation of ``seed + epoch``.  ``drop_last``
    leaves out the last batch when fewer than ``replicas`` bins are left for it.
    An empty sample takes the room of one token, so a bin holds at most
    ``max_len`` samples.  ``lengths`` is read once (when called): ids and lengths are
    checkpointed, for the histogram and for the plan.
    """
    spark = lengths.sparkSession
    checkpoint_dir(spark)
    base = clip_or_drop(lengths.select("sample_id", F.col("length").cast("bigint")), max_len, truncate_long)
    base = base.withColumn("size", F.greatest(F.coalesce("length", F.lit(0)), F.lit(1)).cast("bigint")).checkpoint()
    counts = {r["size"]: r["count"] for r in base.groupBy("size").count().collect()}  # at most max_len rows
    runs, bins = bin_runs(counts, max_len)
    plan = spark.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 3).T)  # a few runs a length

    @F.pandas_udf("bigint")
    def bin_of(item: pd.Series) -> pd.Series:
        first, start, per = plan.value
        i = item.to_numpy()
        at = np.searchsorted(first, i, "right") - 1
        return pd.Series(start[at] + (i - first[at]) // per[at])

    step, shift = stride(bins, seed + epoch)
    x = ordered_items(base, counts, seed + epoch, bucket_rows).withColumn("_bin", F.pmod(bin_of("item") * step + shift, F.lit(max(1, bins))))
    if drop_last:
        x = x.filter(F.col("_bin") < bins // replicas * replicas)
    return x.select(
        F.floor(F.col("_bin") / replicas).cast("bigint").alias("batch_no"),
        F.pmod(F.col("_bin"), F.lit(replicas)).cast("int").alias("replica"),
        "sample_id", "length", "item",
    )


def pack_running_sums(
    lengths: DataFrame,
    max_len: int,
    replicas: int,
    seed: int = 0,
    epoch: int = 0,
    truncate_long: bool = True,
    drop_last: bool = True,
    shards: int = SHARDS,
    levels: int = LEVELS,
) -> DataFrame:
    """Batch plan ``(batch_no, replica, sample_id, length, item)`` from running token
    sums in the seeded order of ``seed + epoch``."""
    base = clip_or_drop(lengths.select("sample_id", F.col("length").cast("bigint")), max_len, truncate_long)
    x = assign_bins(base, max_len, seed + epoch, shards, levels)
    x = x.withColumn("_in", F.dense_rank().over(Window.partitionBy("shard").orderBy("level", "cut")) - 1)
    bins = x.groupBy("shard").agg((F.max("_in") + 1).alias("_n"))  # one row per shard
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = bins.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(all_).alias("_all"))
    x = x.join(broadcast_bounded(first, shards, "bins before a shard"), "shard").withColumn("_bin", F.col("_off") + F.col("_in"))
    if drop_last:
        x = x.filter(F.col("_bin") < F.floor(F.col("_all") / replicas) * replicas)
    return x.select(
        F.floor(F.col("_bin") / replicas).cast("bigint").alias("batch_no"),
        F.pmod(F.col("_bin"), F.lit(replicas)).cast("int").alias("replica"),
        "sample_id", "length", "item",
    )


def skip_batches(plan: DataFrame, n: int) -> DataFrame:
    """Resume inside an epoch — the first ``n`` batches are skipped."""
    return plan.filter(F.col("batch_no") >= n)


def pack_summary(plan: DataFrame, lengths: DataFrame, max_len: int, replicas: int) -> DataFrame:
    """One row — packed samples and tokens, batches, capacity, fill ratio,
    dropped and long (clipped or dropped) sample counts.

    One aggregation over the union of the plan and the source lengths.
    """
    u = plan.select(F.lit(True).alias("_plan"), "length", F.col("batch_no").alias("_b")).unionByName(
        lengths.select(F.lit(False).alias("_plan"), F.col("length").cast("bigint"), F.lit(None).cast("bigint").alias("_b"))
    )
    agg = u.agg(
        F.count(F.when(F.col("_plan"), 1)).alias("n_packed"),
        F.coalesce(F.sum(F.when(F.col("_plan"), F.col("length"))), F.lit(0)).cast("bigint").alias("used_tokens"),
        (F.coalesce(F.max("_b"), F.lit(-1)) - F.coalesce(F.min("_b"), F.lit(0)) + 1).alias("n_batches"),
        F.count(F.when(~F.col("_plan"), 1)).alias("n_samples"),
        F.count(F.when(~F.col("_plan") & (F.col("length") > max_len), 1)).alias("n_long"),
    )
    return agg.select(
        "n_samples",
        "n_packed",
        (F.col("n_samples") - F.col("n_packed")).alias("n_dropped"),
        "n_long",
        "n_batches",
        "used_tokens",
        (F.col("n_batches") * replicas * max_len).cast("bigint").alias("capacity"),
        F.when(F.col("n_batches") > 0, F.col("used_tokens") / (F.col("n_batches") * replicas * max_len)).otherwise(0.0).alias("fill_ratio"),
    )
