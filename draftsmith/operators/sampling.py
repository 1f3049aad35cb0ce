"""Depth-wise (COD) position sampling.

Depth 0 keeps every position; depth ``d`` keeps
``int(max(0, S - d) * max(r**d, r_min))`` of the previous depth's
candidates (``S`` = trainable positions of the sequence), chosen in hash
order of ``(seed, sample, depth, pos)``.  The next candidates are the kept
positions + 1 (mod length, position 0 removed) that are trainable — a
left-semi join on the trainable positions.

One DataFrame step per depth (``num_depths`` ≤ 8) in a driver loop over
*depths*, never over data.  Each step is a window per sequence (bounded by
the sequence length) and one semi join.  The per-sample base and each
depth's sample are written with ``checkpoint()`` to the cluster's
checkpoint folder: depth ``d`` then reads depth ``d-1`` instead of
re-running the whole chain (work linear, not quadratic, in the depth) and a
lost executor never forces a recomputation from the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftsmith.functions.hashing import seeded_key
from draftsmith.session import checkpoint_dir


def cod_sample(
    rows: DataFrame,
    num_depths: int = 8,
    ratio: float = 0.7,
    ratio_min: float = 0.2,
    seed: int = 0,
    filter_position_zero: bool = True,
    drop_negative_anchors: bool = True,
    max_anchors: int | None = None,
    checkpoint_every: int = 1,
) -> DataFrame:
    """O14 (+ U6 semi join, X9): ``rows(sample_id, input_ids, loss_mask)`` →
    ``(sample_id, depth, anchor)``."""
    spark = rows.sparkSession
    seqs = rows.select("sample_id", F.size("input_ids").alias("seq_len"), "loss_mask")
    if checkpoint_every:
        # the compact per-sample base (one row per sequence) is written once;
        # positions are derived from it narrowly at every depth
        checkpoint_dir(spark)
        seqs = seqs.checkpoint(eager=True)
    valid = seqs.select("sample_id", "seq_len", F.posexplode("loss_mask").alias("pos", "m")).filter("m").select(
        "sample_id", "seq_len", F.col("pos").cast("bigint").alias("pos")
    )
    seed_idx = valid
    if max_anchors is not None:
        w = Window.partitionBy("sample_id").orderBy(seeded_key(seed, "sample_id", F.lit("anchor"), "pos"), "pos")
        seed_idx = valid.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_anchors).drop("_r")
    n_seed = seed_idx.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_seed"))

    # sequence(0, -1) would count down to [0, -1]: empty sequences have no positions
    depth0 = seqs.filter(F.col("seq_len") > 0).select(
        "sample_id", F.lit(0).alias("depth"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("seq_len") - 1).cast("bigint"))).alias("anchor")
    )
    outs = [depth0]
    prev = seed_idx.select("sample_id", "seq_len", "pos")
    for d in range(1, num_depths):
        r = max(ratio**d, ratio_min)
        size = F.floor(F.greatest(F.col("n_seed") - d, F.lit(0)) * F.lit(float(r))).cast("bigint")
        p = prev.join(n_seed, "sample_id").withColumn("_size", size).filter(F.col("_size") > 0)
        wseq = Window.partitionBy("sample_id")
        p = p.withColumn("_cnt", F.count(F.lit(1)).over(wseq)).withColumn(
            "_rn", F.row_number().over(wseq.orderBy(seeded_key(seed, "sample_id", F.lit(d), "pos"), "pos"))
        )
        sampled = p.filter((F.col("_cnt") < F.col("_size")) | (F.col("_rn") <= F.col("_size"))).select("sample_id", "seq_len", "pos")
        if checkpoint_every and d % checkpoint_every == 0:
            sampled = sampled.checkpoint(eager=True)
        anchors = sampled.select("sample_id", F.lit(d).alias("depth"), (F.col("pos") - d).alias("anchor"))
        if drop_negative_anchors:
            anchors = anchors.filter(F.col("anchor") >= 0)
        outs.append(anchors)
        nxt = sampled.select("sample_id", "seq_len", F.pmod(F.col("pos") + 1, F.col("seq_len")).alias("pos"))
        if filter_position_zero:
            nxt = nxt.filter(F.col("pos") != 0)
        prev = nxt.join(valid.select("sample_id", "pos"), ["sample_id", "pos"], "left_semi")
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def cod_in_row(sample_id: Column, mask: Column, num_depths: int = 8, ratio: float = 0.7, ratio_min: float = 0.2, seed: int = 0,
               filter_position_zero: bool = True, drop_negative_anchors: bool = True, max_anchors: int | None = None) -> Column:
    """O14 (U6 as a filter on trainable slots) for one sequence as array expressions: ``array<struct<depth, anchor>>``.

    Depth 0 is every position; depth ``d`` keeps ``int(max(0, S-d) * max(r**d,
    r_min))`` of the previous candidates in hash order of ``(seed, sample,
    d, pos)`` (all of them when there are fewer); the next candidates are the
    kept positions + 1 (mod length, 0 removed) that are trainable.  The depth
    chain is unrolled on the driver (``num_depths`` ≤ 8) and every step is
    bound once with ``let`` — no join, shuffle or checkpoint per depth.
    """
    from draftsmith.functions.distributions import let
    from draftsmith.functions.hashing import seeded_key

    out_t = "array<struct<depth:int,anchor:bigint>>"
    empty_l = F.array().cast("array<bigint>")

    def positions(m):
        n = F.size(m)
        return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))).otherwise(empty_l)

    def body(m):
        n_len = F.size(m)

        def chain(d, prev, n_seed):
            if d >= num_depths:
                return F.array().cast(out_t)
            r = max(ratio**d, ratio_min)
            size = F.floor(F.greatest(n_seed - d, F.lit(0)) * F.lit(float(r))).cast("bigint")

            def pick(p):
                ordered = F.array_sort(F.transform(p, lambda q: F.struct(seeded_key(seed, sample_id, F.lit(d), q).alias("k"), q.alias("q"))))
                chosen = F.array_sort(F.transform(F.slice(ordered, 1, size.cast("int")), lambda x: x["q"]))
                return F.when(size <= 0, empty_l).when(F.size(p) >= size, chosen).otherwise(p)

            def after(s):
                anchors = F.transform(s, lambda q: q - d)
                if drop_negative_anchors:
                    anchors = F.filter(anchors, lambda a: a >= 0)
                here = F.transform(anchors, lambda a: F.struct(F.lit(d).alias("depth"), a.alias("anchor")))
                nxt = F.transform(s, lambda q: F.pmod(q + 1, n_len.cast("bigint")))
                if filter_position_zero:
                    nxt = F.filter(nxt, lambda q: q != 0)
                nxt = F.filter(nxt, lambda q: F.element_at(m, (q + 1).cast("int")))
                return F.concat(here, let(nxt, lambda p2: chain(d + 1, p2, n_seed)))

            return let(pick(prev), after)

        valid = F.filter(positions(m), lambda i: F.element_at(m, (i + 1).cast("int")))
        if max_anchors is not None:  # a hash-ordered choice of the seeds, back in order
            keyed = F.array_sort(F.transform(valid, lambda q: F.struct(seeded_key(seed, sample_id, F.lit("anchor"), q).alias("k"), q.alias("q"))))
            valid = F.array_sort(F.transform(F.slice(keyed, 1, max_anchors), lambda x: x["q"]))
        depth0 = F.transform(positions(m), lambda i: F.struct(F.lit(0).alias("depth"), i.alias("anchor")))
        return F.concat(depth0, let(valid, lambda v: chain(1, v, F.size(v))))

    return let(mask, body)


def cod_sample_rows(rows: DataFrame, num_depths: int = 8, ratio: float = 0.7, ratio_min: float = 0.2, seed: int = 0, max_anchors: int | None = None) -> DataFrame:
    """O14 on prepared rows, in row: ``(sample_id, depth, anchor)`` — narrow, no shuffle."""
    return rows.select(
        "sample_id", F.explode(cod_in_row(F.col("sample_id"), F.col("loss_mask"), num_depths, ratio, ratio_min, seed, max_anchors=max_anchors)).alias("_c")
    ).select("sample_id", "_c.depth", "_c.anchor")
