"""Draft-quality aggregates.

Inputs are *scored position* tables: one row per predicted position with
``draft`` / ``target`` logit arrays (or predicted / target ids), a
``mask`` and the grouping columns (``batch_id``, ``block_id``, ``slot``,
``step``).  Ratios are kept as (numerator, denominator) sums until the end
(A11), so partial aggregation across tasks stays exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from draftsmith.functions.distributions import LOSSES, argmax, bce_with_logits, overlap, parse_loss_spec, sigmoid
from draftsmith.session import broadcast_bounded


def masked_decayed_mean(
    df: DataFrame, value: Column, mask: str = "mask", batch: str = "batch_id", weight: Column | None = None, eps: float = 1e-5
) -> DataFrame:
    """Per batch ``sum(v*m*w) / (sum(m) + eps)``, then the mean over batches.

    The decay weight is in the numerator only (as in the reference).
    """
    m = F.col(mask).cast("double")
    w = weight if weight is not None else F.lit(1.0)
    per = df.groupBy(batch).agg((F.sum(value * m * w) / (F.sum(m) + eps)).alias("_b"))
    return per.agg(F.avg("_b").alias("value"))


def compound_loss(
    df: DataFrame,
    spec: dict[str, float] | str,
    draft: str = "draft",
    target: str = "target",
    mask: str = "mask",
    batch: str = "batch_id",
    weight: Column | None = None,
    eps: float = 1e-5,
) -> DataFrame:
    """A10: ``loss = sum_k w_k * term_k`` with each term an A9 mean; one row.
    ``spec`` as for :func:`parse_loss_spec` (F11).

    Per-term columns ``{name}_loss`` are reported only when there are
    several terms.  All terms come from one pass (one column per term).
    """
    spec = parse_loss_spec(spec)
    m = F.col(mask).cast("double")
    w = weight if weight is not None else F.lit(1.0)
    terms = {name: LOSSES[name](F.col(draft), F.col(target)) for name in spec}
    per = df.groupBy(batch).agg(
        *[(F.sum(t * m * w) / (F.sum(m) + eps)).alias(f"{n}_loss") for n, t in terms.items()]
    )
    means = per.agg(*[F.avg(f"{n}_loss").alias(f"{n}_loss") for n in terms])
    total = sum((F.lit(float(spec[n])) * F.col(f"{n}_loss") for n in terms), F.lit(0.0))
    cols = [total.alias("loss")]
    if len(terms) > 1:
        cols += [F.col(f"{n}_loss") for n in terms]
    return means.select(*cols)


def chain_accuracy(steps: DataFrame, key: tuple[str, ...] = ("pos",)) -> DataFrame:
    """A7 + W4 per step: ``full_correct, full_total, cond_correct, cond_total``.

    ``steps(key..., step, pred, target, mask, base_mask)``: ``mask`` is the
    target mask of the step, ``base_mask`` the position's own mask (the
    chain's initial value).  The chain at step ``k`` is ``base_mask`` AND
    every earlier step correct; the conditional total counts the chain
    without the step mask (reference behaviour, Q8).
    """
    w = Window.partitionBy(*key).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    eq = (F.col("pred") == F.col("target")).cast("int")
    chained = steps.withColumn("_eq", eq).withColumn(
        "_prev", F.col("base_mask") & F.coalesce(F.min("_eq").over(w), F.lit(1)).cast("boolean")
    )
    good = F.col("_prev") & (F.col("_eq") == 1) & F.col("mask")
    return chained.groupBy("step").agg(
        F.sum(good.cast("bigint")).alias("full_correct"),
        F.sum(F.col("mask").cast("bigint")).alias("full_total"),
        F.sum(good.cast("bigint")).alias("cond_correct"),
        F.sum(F.col("_prev").cast("bigint")).alias("cond_total"),
    )


def position_accuracy(
    spark: SparkSession, df: DataFrame, num_pos: int, pos: str = "slot", pred: str = "pred", target: str = "target", mask: str = "mask"
) -> DataFrame:
    """Per position ``correct, total`` over masked rows; empty positions give 0.

    The position table is ``range(num_pos)`` (a model constant) broadcast
    into a left join.
    """
    agg = df.filter(F.col(mask)).groupBy(F.col(pos).cast("bigint").alias("pos")).agg(
        F.sum((F.col(pred) == F.col(target)).cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total")
    )
    return (
        broadcast_bounded(spark.range(num_pos).select(F.col("id").alias("pos")), num_pos, "position table")
        .join(agg, "pos", "left")
        .select("pos", F.coalesce("correct", F.lit(0)).cast("bigint").alias("correct"), F.coalesce("total", F.lit(0)).cast("bigint").alias("total"))
    )


def block_accuracy(per_pos: DataFrame) -> DataFrame:
    """Overall accuracy over positions ``>= 1`` (position 0 is the anchor)."""
    return per_pos.filter(F.col("pos") > 0).agg(
        F.sum("correct").cast("bigint").alias("full_correct"), F.sum("total").cast("bigint").alias("full_total")
    )


def block_metrics(
    df: DataFrame,
    block_size: int,
    gamma: float = 4.0,
    draft: str = "draft",
    target: str = "target",
    mask: str = "mask",
    conf: str | None = "conf_logit",
    batch: str = "batch_id",
    block: str = "block_id",
    slot: str = "slot",
) -> DataFrame:
    """A16 + A17 + A18 (+ W3) in one aggregation chain block → batch → all; one row.

    * ``accept_rate`` — mean overlap over masked rows (A16);
    * ``accept_len`` — ``1 + sum cumprod(alpha*m)`` over draft slots 1..B-1,
      averaged over blocks with a valid draft slot (A17);
    * with a confidence column (A18): ``confidence_loss`` (masked decayed BCE
      mean per batch, eps 1e-8, then mean over batches), ``abs_error``,
      ``pred_mean`` and ``cumprod_bias`` (confidence vs acceptance products).

    A block (at most ``block_size`` rows) is collected in slot order and the
    running products are an ``aggregate`` over that array — exact at zero,
    unlike ``exp(sum(log))``.
    """
    from draftsmith.functions.distributions import block_decay

    m = F.col(mask).cast("double")
    a = df.withColumn("_a", overlap(F.col(draft), F.col(target)))
    c = sigmoid(F.col(conf)) if conf else F.lit(0.0)
    bce = bce_with_logits(F.col(conf), F.col("_a")) * m * block_decay(F.col(slot), gamma) if conf else F.lit(0.0)
    per_block = a.groupBy(batch, block).agg(
        F.sort_array(
            F.collect_list(F.struct(F.col(slot).alias("s"), F.col("_a").alias("a"), c.alias("c"), m.alias("m")))
        ).alias("_xs"),
        F.sum(F.col("_a") * m).alias("s_am"),
        F.sum(m).alias("s_m"),
        F.sum(F.abs(c - F.col("_a")) * m).alias("s_abs"),
        F.sum(c * m).alias("s_c"),
        F.sum(bce).alias("s_bce"),
    )
    zero = F.lit(0.0)
    acc0 = F.struct(F.lit(1.0).alias("pa"), F.lit(1.0).alias("pc"), zero.alias("sum_pa"), zero.alias("bias"), zero.alias("n"))

    def step(st, x):
        d = x["s"] > 0
        pa = F.when(d, st["pa"] * x["a"] * x["m"]).otherwise(st["pa"])
        pc = F.when(d, st["pc"] * x["c"] * x["m"]).otherwise(st["pc"])
        return F.struct(
            pa.alias("pa"),
            pc.alias("pc"),
            (st["sum_pa"] + F.when(d, pa).otherwise(0.0)).alias("sum_pa"),
            (st["bias"] + F.when(d, (pc - pa) * x["m"]).otherwise(0.0)).alias("bias"),
            (st["n"] + F.when(d, x["m"]).otherwise(0.0)).alias("n"),
        )

    folded = per_block.withColumn("_f", F.aggregate("_xs", acc0, step)).drop("_xs")
    valid = (F.col("_f.n") > 0).cast("double")
    per_batch = folded.groupBy(batch).agg(
        F.sum("s_am").alias("s_am"), F.sum("s_m").alias("s_m"), F.sum("s_abs").alias("s_abs"), F.sum("s_c").alias("s_c"),
        (F.sum("s_bce") / (F.sum("s_m") + 1e-8)).alias("b_bce"),
        F.sum((F.col("_f.sum_pa") + 1.0) * valid).alias("s_len"), F.sum(valid).alias("n_valid_blocks"),
        F.sum("_f.bias").alias("s_bias"), F.sum("_f.n").alias("n_draft"),
    )
    def per(total: str, count: str) -> Column:  # each batch counts at least one, as the reference clamps per batch
        return F.sum(total) / F.greatest(F.sum(F.greatest(F.col(count), F.lit(1.0))), F.lit(1.0))

    out = per_batch.agg(
        per("s_am", "s_m").alias("accept_rate"),
        per("s_len", "n_valid_blocks").alias("accept_len"),
        F.avg("b_bce").alias("confidence_loss"),
        per("s_abs", "s_m").alias("abs_error"),
        per("s_c", "s_m").alias("pred_mean"),
        per("s_bias", "n_draft").alias("cumprod_bias"),
    )
    if not conf:
        out = out.select("accept_rate", "accept_len")
    return out


def greedy_accept(df: DataFrame, top_k: int = 1, tolerance: float = 0.0, draft: str = "draft", target: str = "target") -> Column:
    """The drafted token (argmax of the draft) is accepted when its rank in
    the target is ``<= top_k`` and ``logp_top - logp_token <= tolerance``."""
    from draftsmith.functions.distributions import let

    def rule(tval):
        rank = F.size(F.filter(F.col(target), lambda v: v > tval)) + 1
        gap = F.array_max(F.col(target)) - tval  # log-softmax differences equal logit differences
        return (rank <= top_k) & (gap <= tolerance)

    return let(F.element_at(F.col(target), argmax(F.col(draft)) + 1), rule)


def threshold_check(per_pos_rate: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Join thresholds on position; pass when ``rate >= threshold``."""
    return thresholds.join(per_pos_rate, "pos", "left").select(
        "pos", "threshold", F.coalesce("rate", F.lit(0.0)).alias("rate"),
        (F.coalesce("rate", F.lit(0.0)) >= F.col("threshold")).alias("passed"),
    )


def gather_ahead(rows: DataFrame, at: DataFrame, offsets: int, pos: str = "pos", key_col: str = "offset") -> DataFrame:
    """For every row and every offset ``k < offsets`` join the row at
    ``pos + k`` of ``at`` (equi join on the shifted position; the offsets are
    exploded from the row itself)."""
    base = rows.withColumn(key_col, F.explode(F.sequence(F.lit(0), F.lit(offsets - 1))))
    other = at.withColumnRenamed(pos, "_at")
    return base.join(other, base[pos] + base[key_col] == other["_at"]).drop("_at")


def depth_accuracy(pred: DataFrame, target: DataFrame, depths: int) -> DataFrame:
    """Per depth ``d``, the prediction at ``pos`` against the target gathered
    at ``pos + d`` (J9), over masked targets — all depths, no decay.

    ``pred(pos, pred)``, ``target(pos, target, mask)`` → ``(depth, correct, total)``.
    """
    j = gather_ahead(pred, target, depths, key_col="depth").filter(F.col("mask"))
    return j.groupBy(F.col("depth").cast("int").alias("depth")).agg(
        F.sum((F.col("pred") == F.col("target")).cast("bigint")).alias("correct"), F.count(F.lit(1)).alias("total")
    )


def step_metrics(steps: DataFrame, decay: float, loss_col: str = "loss_term") -> DataFrame:
    """A15 (+P51, A7, A9): per step — the loss term masked-averaged per batch with
    weight ``decay**step`` then averaged over batches, and the chained accuracy.

    ``steps(pos, batch_id, step, pred, target, mask, base_mask, loss_term)``.
    """
    m = F.col("mask").cast("double")
    loss = (
        steps.groupBy("step", "batch_id")
        .agg((F.sum(F.col(loss_col) * m * F.pow(F.lit(decay), F.col("step"))) / (F.sum(m) + 1e-5)).alias("_l"))
        .groupBy("step").agg(F.avg("_l").alias("loss"))
    )
    acc = chain_accuracy(steps.select("pos", "step", "pred", "target", "mask", "base_mask"))
    return acc.join(loss, "step")


def mtp_step_loss(steps: DataFrame, weights: list[float], ce_col: str = "ce") -> DataFrame:
    """A20 (+F10): per step ``k``: ``w_k * sum(ce over valid) / max(valid, 1)``;
    the total loss is the sum over steps.  ``steps(step, mask, ce)``."""
    wmap = F.create_map(*[x for i, w in enumerate(weights) for x in (F.lit(i), F.lit(float(w)))])
    per = steps.groupBy("step").agg(
        F.count(F.when(F.col("mask"), 1)).alias("n_valid"),
        F.coalesce(F.sum(F.when(F.col("mask"), F.col(ce_col))), F.lit(0.0)).alias("_s"),
    )
    w = F.element_at(wmap, F.col("step"))
    return per.select("step", w.alias("weight"), "n_valid", (w * F.col("_s") / F.greatest(F.col("n_valid"), F.lit(1))).alias("step_loss"))
