"""Stable order, distributed global rank, caps, splits and rank chunks.

O1–O4, O7, O11, P33, P34.

``global_rank`` never uses an un-partitioned window over the data: rows are
bucketed by an order-preserving key prefix, bucket sizes (at most
``16**digits`` rows) get prefix sums in one small task, the offsets are
broadcast back, and ``row_number`` runs inside each bucket.  With md5
buckets the buckets are uniform whatever the id distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftsmith.functions.hashing import seeded_hex


def global_rank(df: DataFrame, order_cols: list[Column], bucket: Column, rank_col: str = "rank", max_buckets: int = 1 << 16) -> DataFrame:
    """0-based rank of every row in ``order_cols`` order.

    ``bucket`` must be an integer that never decreases along the order
    (e.g. a prefix of the sort key) and take at most ``max_buckets`` values:
    that is the size of the only single-task step (the join is left to AQE).
    Rows are expected to have distinct order keys (ids are unique); when keys
    may repeat, use :func:`global_rank_with_ties`, which stays balanced even
    if one key holds a large share of the rows.
    """
    b = df.withColumn("_bucket", bucket)
    sizes = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    w = Window.partitionBy("_bucket").orderBy(*order_cols)
    return (
        b.join(offsets, "_bucket")
        .withColumn(rank_col, (F.col("_off") + F.row_number().over(w) - 1).cast("bigint"))
        .drop("_bucket", "_off")
    )


def seeded_rank(df: DataFrame, seed: int | Column, id_col: str, rank_col: str = "rank", digits: int = 3, unique_ids: bool = True) -> DataFrame:
    """Rank in the seeded shuffle order ``(md5(seed:id), id)``.

    With ``unique_ids=False`` repeated ids are allowed — even one id holding a
    large share of the rows (:func:`global_rank_with_ties`).
    """
    key = seeded_hex(seed, id_col)
    keyed = df.withColumn("_key", key)
    bucket = F.conv(F.substring("_key", 1, digits), 16, 10).cast("int")
    if not unique_ids:
        return global_rank_with_ties(keyed, ["_key", id_col], bucket, rank_col, max_buckets=16**digits).drop("_key")
    return global_rank(keyed, [F.col("_key"), F.col(id_col)], bucket, rank_col, max_buckets=16**digits).drop("_key")


ID_BUCKETS = 1 << 14


def id_rank(df: DataFrame, id_col: str, rank_col: str = "rank") -> DataFrame:
    """Rank in ascending ``id_col`` order (stable dataset index order).

    The id range (two scalars) is cut into ``ID_BUCKETS`` equal parts, so the
    table of bucket sizes is bounded however sparse the ids are.
    """
    lo, hi = df.agg(F.min(id_col), F.max(id_col)).first()
    width = 1 if lo is None else (hi - lo) // ID_BUCKETS + 1
    bucket = F.floor((F.col(id_col) - F.lit(lo or 0)) / F.lit(width)).cast("bigint")
    return global_rank(df, [F.col(id_col)], bucket, rank_col, max_buckets=ID_BUCKETS)


def smallest_keys(df: DataFrame, key: str, n: int, digits: int = 3, most: int = 1 << 12) -> tuple[str, bool, int]:
    """Distributed selection of the ``n`` smallest values of ``key`` (hex strings of
    one length): ``(cut, all_of_cut, rest)``.

    A histogram of key prefixes (at most ``16**digits`` rows reach the driver)
    finds the bucket in which the ``n``-th key lies; that bucket alone is counted
    again by its next digits, until it has at most ``most`` keys, which are looked
    at.  Keys below ``cut`` are in; of those equal to it all, or else ``rest`` rows.
    """
    prefix, need = "", n
    while True:
        here = df.filter(F.col(key).startswith(prefix)) if prefix else df
        counts = here.groupBy(F.substring(key, len(prefix) + 1, digits).alias("k")).count().orderBy("k").collect()
        for r in counts:
            if r["count"] >= need:
                break
            need -= r["count"]
        else:  # fewer rows than asked for: only on the first pass
            return "g", False, 0
        prefix += r["k"]
        if r["k"] == "" or len(r["k"]) < digits:  # the whole key: equal rows
            return prefix, r["count"] == need, need
        if r["count"] <= most:
            keys = sorted(x[0] for x in df.filter(F.col(key).startswith(prefix)).select(key).collect())
            cut = keys[need - 1]
            below = sum(k < cut for k in keys)
            return cut, keys.count(cut) == need - below, need - below


def shuffle_cap(df: DataFrame, seed: int, id_col: str, n: int | None, unique_ids: bool = True) -> DataFrame:
    """O1 + O2/O3: keep the first ``n`` rows of the seeded order (all if None).

    The ``n``-th key is found by :func:`smallest_keys` (when called; it reads ids
    only), and the rows are filtered by it: no rank, no window, no exchange.  Rows
    of equal ids (``unique_ids=False``) are ordered by a hash of the whole row.
    """
    if n is None:
        return df
    if n <= 0:
        return df.filter(F.lit(False))
    key = seeded_hex(seed, id_col)
    if not unique_ids:
        key = F.concat(key, F.lpad(F.lower(F.hex(F.xxhash64(*[F.col(c) for c in df.columns]))), 16, "0"))
    keyed = df.withColumn("_key", F.coalesce(key, F.lit("f" * (32 if unique_ids else 48))))
    cut, whole, rest = smallest_keys(keyed.select("_key"), "_key", n)
    if whole or not rest:
        return keyed.filter(F.col("_key") <= cut).drop("_key")
    # rows that nothing tells apart: any of them will do
    return keyed.filter(F.col("_key") < cut).unionAll(keyed.filter(F.col("_key") == cut).limit(rest)).drop("_key")


def union_shuffle_cap(frames: list[DataFrame], seed: int, id_col: str, per_source_cap: int | None, final_cap: int | None) -> DataFrame:
    """O2 + U1 + O3: per-source cap at ``3*n`` before the union, final cap after.

    Ids must be unique across sources (prefix them with the source name).
    """
    capped = [shuffle_cap(f, seed, id_col, None if per_source_cap is None else 3 * per_source_cap) for f in frames]
    u = capped[0]
    for f in capped[1:]:
        u = u.unionByName(f)
    return shuffle_cap(u, seed, id_col, final_cap)


def split_cut(n_rows: int, ratio: float) -> tuple[int, int]:
    """P33 bounds ``[lo, hi)`` on the 0-based rank; one cut value for both sides.

    ``ratio`` in (0, 1) keeps the prefix ``int(n*ratio)``; in (-1, 0) the
    suffix from ``int(n*(1+ratio))``; 1.0 keeps all; else error.
    """
    if ratio == 1.0:
        return 0, n_rows
    if 0 < ratio < 1:
        return 0, int(n_rows * ratio)
    if -1 < ratio < 0:
        return int(n_rows * (1.0 + ratio)), n_rows
    raise ValueError(f"ratio {ratio} outside the accepted values: 0 < |ratio| < 1, or exactly 1")


def seeded_split(df: DataFrame, seed: int, id_col: str, n_rows: int, ratio: float = 0.9, rank_col: str | None = None) -> DataFrame:
    """Shuffled split — the first ``int(n*ratio)`` rows of the seeded order
    are ``train``, the rest ``val`` (the same cut value for both sides); the rank
    is kept as ``rank_col`` when named."""
    ranked = seeded_rank(df, seed, id_col, rank_col or "_srank")
    cut = int(n_rows * ratio)
    return ranked.withColumn("split", F.when(F.col(rank_col or "_srank") < cut, "train").otherwise("val")).drop("_srank")


def contiguous_split(ranked: DataFrame, n_rows: int, ratio: float, rank_col: str = "rank") -> DataFrame:
    lo, hi = split_cut(n_rows, ratio)
    return ranked.filter((F.col(rank_col) >= lo) & (F.col(rank_col) < hi))


def chunk_of(idx: Column, target: int, world_size: int) -> Column:
    """Rank owning index ``idx`` among ``target`` indices split over ``world_size``.

    Chunks differ by at most one; the remainder goes to the first ranks.
    Indices ``>= target`` get null.
    """
    c, r = divmod(target, world_size)
    big = r * (c + 1)
    owner = F.when(idx < big, F.floor(idx / (c + 1))).otherwise(F.lit(r) + F.floor((idx - big) / F.lit(max(c, 1))))
    return F.when((idx >= 0) & (idx < target), owner.cast("int"))


def weighted_key_starts(keys: DataFrame, key_cols: list[str], weight: str, bucket: Column, max_buckets: int = 1 << 16) -> DataFrame:
    """For unique keys with a weight (row count), the rank of the first row of
    each key in key order: bucket totals → prefix sums in one small task →
    running sum of weights inside each bucket."""
    b = keys.withColumn("_bucket", bucket)
    sizes = b.groupBy("_bucket").agg(F.sum(weight).alias("_n"))
    offsets = sizes.select(
        "_bucket",
        F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    w = Window.partitionBy("_bucket").orderBy(*[F.col(c) for c in key_cols]).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(offsets, "_bucket")
        .withColumn("_key_start", (F.col("_off") + F.coalesce(F.sum(weight).over(w), F.lit(0))).cast("bigint"))
        .drop("_bucket", "_off")
    )


def global_rank_with_ties(
    df: DataFrame, key_cols: list[str], bucket: Column, rank_col: str = "rank", rows_per_group: int = 1_000_000, max_buckets: int = 1 << 16
) -> DataFrame:
    """Exact 0-based rank in ``key_cols`` order when keys may repeat — even one
    key holding a large share of all rows.

    1. rows per key (partial aggregation: a hot key is one row per task);
    2. the start rank of each key, from the ranks of the *distinct* keys
       weighted by their counts (unique keys → uniform buckets);
    3. inside a key, rows are spread over ``ceil(count / rows_per_group)``
       salt groups by a row hash; group sizes → offsets; ``row_number``
       runs per (key, salt), so no window holds more than about
       ``rows_per_group`` rows.

    Rows with equal keys are ordered by the row hash (fully identical rows are
    interchangeable).  ``bucket`` must be monotone in the key order.
    """
    row_hash = F.xxhash64(*[F.col(c) for c in df.columns])
    counts = df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_cnt"))
    starts = weighted_key_starts(counts.withColumn("_b", bucket), key_cols, "_cnt", F.col("_b"), max_buckets).drop("_b")
    starts = starts.withColumn("_groups", F.greatest(F.lit(1), F.ceil(F.col("_cnt") / F.lit(rows_per_group))).cast("bigint"))
    rows = df.withColumn("_h", row_hash).join(starts.select(*key_cols, "_key_start", "_groups"), key_cols)
    rows = rows.withColumn("_salt", F.pmod(F.col("_h"), F.col("_groups")))
    salt_sizes = rows.groupBy(*key_cols, "_salt").agg(F.count(F.lit(1)).alias("_sn"))
    ws = Window.partitionBy(*key_cols).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    salt_off = salt_sizes.withColumn("_soff", F.coalesce(F.sum("_sn").over(ws), F.lit(0))).drop("_sn")
    wr = Window.partitionBy(*key_cols, "_salt").orderBy("_h", *[F.col(c) for c in df.columns])
    return (
        rows.join(salt_off, [*key_cols, "_salt"])
        .withColumn(rank_col, (F.col("_key_start") + F.col("_soff") + F.row_number().over(wr) - 1).cast("bigint"))
        .drop("_h", "_key_start", "_groups", "_salt", "_soff")
    )
