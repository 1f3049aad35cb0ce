"""Loss and draft-quality queries.

Stand-in scored positions, derived from ``embeddings``: the draft logits of
position ``p`` are ``10 × embedding(p)``, the target logits ``10 × (0.75 ×
embedding(p) + 0.25 × embedding(p+1))`` (equi self-join on the shifted id; near
the draft, so that ids match often but not always), slot ``p mod 8``, block
``p div 8``, batch ``p div 64``, mask ``label <> 0 and slot > 0``, confidence
logit ``label - 4.5``.  Predicted / target ids are the argmax of all logits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.functions.distributions import argmax, block_decay, ce, kl, lk_hybrid, nla, overlap, power_decay, rkl, step_weights, tv  # noqa: F401
from draftsmith.operators.quality import (
    block_accuracy,
    depth_accuracy,
    gather_ahead,
    mtp_step_loss,
    step_metrics,
    block_metrics,
    chain_accuracy,
    compound_loss,
    greedy_accept,
    masked_decayed_mean,
    position_accuracy,
    threshold_check,
)
from draftsmith.session import broadcast_bounded
from draftsmith.tables import table

G = "quality"
SCALE = 10.0
NEAR = 0.75  # exact in binary, as is 1 - NEAR
BLOCK = 8
BATCH = 64
GAMMA = 4.0
STEPS = 3
BETA = 0.6
THRESHOLDS = [(1, 0.40), (2, 0.10), (3, 0.01)]  # fixed values: regression thresholds per position


def _scored(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    x = F.col("embedding").cast("array<double>")
    d = e.select("vec_id", "label", x.alias("_own"))
    t = e.select((F.col("vec_id") - 1).alias("vec_id"), x.alias("_next"))
    s = d.join(t, "vec_id")
    s = s.withColumn("draft", F.transform("_own", lambda v: v * SCALE))
    s = s.withColumn("target", F.zip_with("_own", "_next", lambda a, b: (a * NEAR + b * (1.0 - NEAR)) * SCALE))
    slot = F.pmod(F.col("vec_id"), F.lit(BLOCK))
    return s.select(
        "vec_id",
        F.floor(F.col("vec_id") / BATCH).cast("bigint").alias("batch_id"),
        F.floor(F.col("vec_id") / BLOCK).cast("bigint").alias("block_id"),
        slot.cast("int").alias("slot"),
        ((F.col("label") != 0) & (slot > 0)).alias("mask"),
        (F.col("label").cast("double") - 4.5).alias("conf_logit"),
        "draft",
        "target",
    )


def _ids(spark, sf):
    s = _scored(spark, sf)
    return s.select(
        "vec_id", "batch_id", "block_id", "slot", "mask",
        argmax(F.col("draft")).alias("pred"), argmax(F.col("target")).alias("tgt"),
    )


_SQL_SCORED = f"""sc AS (
  SELECT d.vec_id, d.vec_id // {BATCH} AS batch_id, d.vec_id // {BLOCK} AS block_id, CAST(d.vec_id % {BLOCK} AS INTEGER) AS slot,
         (d.label <> 0 AND d.vec_id % {BLOCK} > 0) AS mask, CAST(d.label AS DOUBLE) - 4.5 AS conf_logit,
         list_transform(d.embedding, lambda x: CAST(x AS DOUBLE) * {SCALE}) AS draft,
         list_transform(list_zip(d.embedding, t.embedding),
                        lambda z: (CAST(z[1] AS DOUBLE) * {NEAR} + CAST(z[2] AS DOUBLE) * {1.0 - NEAR}) * {SCALE}) AS target
  FROM embeddings d JOIN embeddings t ON t.vec_id = d.vec_id + 1
),
lz AS (SELECT *, list_max(draft) AS dmx, list_max(target) AS tmx FROM sc),
lz2 AS (SELECT *, dmx + ln(list_sum(list_transform(draft, lambda v: exp(v - dmx)))) AS dlse,
                  tmx + ln(list_sum(list_transform(target, lambda v: exp(v - tmx)))) AS tlse FROM lz),
lsm AS (SELECT *, list_transform(draft, lambda v: v - dlse) AS lq, list_transform(target, lambda v: v - tlse) AS lpp FROM lz2),
fx AS (
  SELECT *,
    list_sum(list_transform(list_zip(lq, lpp), lambda z: least(exp(z[1]), exp(z[2])))) AS alpha,
    list_sum(list_transform(list_zip(lpp, lq), lambda z: CASE WHEN exp(z[1]) > 0 THEN exp(z[1]) * (z[1] - z[2]) ELSE 0.0 END)) AS kl,
    list_sum(list_transform(list_zip(lq, lpp), lambda z: CASE WHEN exp(z[1]) > 0 THEN exp(z[1]) * (z[1] - z[2]) ELSE 0.0 END)) AS rkl,
    -lq[list_position(target, list_max(target))] AS ce,
    list_position(draft, list_max(draft)) - 1 AS pred,
    list_position(target, list_max(target)) - 1 AS tgt
  FROM lsm
)"""


def _per_position(name, spark_fn, sql_expr):
    @register(f"loss_{name}" if name != "overlap" else "softmax_overlap", f"""WITH {_SQL_SCORED}
SELECT vec_id, round({sql_expr}, 6) AS value FROM fx""", G)
    def q(spark, sf):
        s = _scored(spark, sf)
        return s.select("vec_id", F.round(spark_fn(F.col("draft"), F.col("target")), 6).alias("value"))

    return q


_per_position("overlap", overlap, "alpha")
_per_position("kl", kl, "kl")
_per_position("rkl", rkl, "rkl")
_per_position("ce", ce, "ce")
_per_position("tv", tv, "1.0 - alpha")
_per_position("nla", nla, "-ln(greatest(alpha, 1e-5))")
_per_position("lk_hybrid", lk_hybrid, "exp(-3.0 * alpha) * kl + (1.0 - exp(-3.0 * alpha)) * (1.0 - alpha)")

_SQL_DECAY = f"CASE WHEN slot = 0 THEN 0.0 ELSE exp(-CAST(greatest(slot - 1, 0) AS DOUBLE) / {GAMMA}) END"


@register("compound_loss", f"""WITH {_SQL_SCORED},
per AS (
  SELECT batch_id,
    sum(kl * CAST(mask AS DOUBLE) * {_SQL_DECAY}) / (sum(CAST(mask AS DOUBLE)) + 1e-5) AS kl_loss,
    sum((1.0 - alpha) * CAST(mask AS DOUBLE) * {_SQL_DECAY}) / (sum(CAST(mask AS DOUBLE)) + 1e-5) AS tv_loss
  FROM fx GROUP BY batch_id
)
SELECT round(1.0 * avg(kl_loss) + 0.5 * avg(tv_loss), 6) AS loss, round(avg(kl_loss), 6) AS kl_loss, round(avg(tv_loss), 6) AS tv_loss FROM per""", G)
def compound_loss_q(spark, sf):
    s = _scored(spark, sf)
    r = compound_loss(s, '{"kl": 1.0, "tv": 0.5}', weight=block_decay(F.col("slot"), GAMMA))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


@register("masked_decayed_loss", f"""WITH {_SQL_SCORED},
per AS (SELECT batch_id, sum(ce * CAST(mask AS DOUBLE) * pow(0.8, slot)) / (sum(CAST(mask AS DOUBLE)) + 1e-5) AS b FROM fx GROUP BY batch_id)
SELECT round(avg(b), 6) AS value FROM per""", G)
def masked_decayed_loss(spark, sf):
    s = _scored(spark, sf)
    r = masked_decayed_mean(s, ce(F.col("draft"), F.col("target")), weight=power_decay(F.col("slot"), 0.8))
    return r.select(F.round("value", 6).alias("value"))


@register("position_accuracy", f"""WITH {_SQL_SCORED},
agg AS (SELECT slot AS pos, sum(CAST(pred = tgt AS BIGINT)) AS correct, count(*) AS total FROM fx WHERE mask GROUP BY slot)
SELECT CAST(r.range AS BIGINT) AS pos, CAST(coalesce(a.correct, 0) AS BIGINT) AS correct, CAST(coalesce(a.total, 0) AS BIGINT) AS total
FROM range({BLOCK}) r LEFT JOIN agg a ON a.pos = r.range""", G)
def position_accuracy_q(spark, sf):
    return position_accuracy(spark, _ids(spark, sf), BLOCK, "slot", "pred", "tgt")


@register("block_accuracy", f"""WITH {_SQL_SCORED}
SELECT CAST(sum(CAST(pred = tgt AS BIGINT)) AS BIGINT) AS full_correct, CAST(count(*) AS BIGINT) AS full_total
FROM fx WHERE mask AND slot > 0""", G)
def block_accuracy_q(spark, sf):
    return block_accuracy(position_accuracy(spark, _ids(spark, sf), BLOCK, "slot", "pred", "tgt"))


def _steps(spark, sf):
    ids = _ids(spark, sf)
    base = ids.select(F.col("vec_id").alias("pos"), F.col("mask").alias("base_mask"), F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"))
    at = ids.select(F.col("vec_id").alias("_at"), "pred", F.col("tgt").alias("target"), "mask")
    return base.join(at, base["pos"] + base["step"] == at["_at"]).drop("_at")


_SQL_STEPS = f"""steps AS (
  SELECT a.vec_id AS pos, a.mask AS base_mask, k.step, b.pred, b.tgt AS target, b.mask
  FROM fx a CROSS JOIN (SELECT UNNEST(range({STEPS})) AS step) k JOIN fx b ON b.vec_id = a.vec_id + k.step
)"""


@register("conditional_accuracy", f"""WITH {_SQL_SCORED},
{_SQL_STEPS},
ch AS (
  SELECT *, base_mask AND coalesce(min(CAST(pred = target AS INTEGER)) OVER (PARTITION BY pos ORDER BY step
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS prev FROM steps
)
SELECT CAST(step AS INTEGER) AS step,
  CAST(sum(CAST(prev AND pred = target AND mask AS BIGINT)) AS BIGINT) AS full_correct,
  CAST(sum(CAST(mask AS BIGINT)) AS BIGINT) AS full_total,
  CAST(sum(CAST(prev AND pred = target AND mask AS BIGINT)) AS BIGINT) AS cond_correct,
  CAST(sum(CAST(prev AS BIGINT)) AS BIGINT) AS cond_total
FROM ch GROUP BY step""", G)
def conditional_accuracy(spark, sf):
    r = chain_accuracy(_steps(spark, sf))
    return r.select(F.col("step").cast("int"), "full_correct", "full_total", "cond_correct", "cond_total")


@register("depth_accuracy", f"""WITH {_SQL_SCORED}
SELECT CAST(k.depth AS INTEGER) AS depth, CAST(sum(CAST(a.pred = b.tgt AS BIGINT)) AS BIGINT) AS correct, CAST(count(*) AS BIGINT) AS total
FROM fx a CROSS JOIN (SELECT UNNEST(range({STEPS})) AS depth) k JOIN fx b ON b.vec_id = a.vec_id + k.depth
WHERE b.mask GROUP BY k.depth""", G)
def depth_accuracy_q(spark, sf):
    """A14 with J9: the depth-``d`` prediction at ``p`` is scored against the
    target gathered at ``p + d`` (equi join), all depths, no decay."""
    ids = _ids(spark, sf)
    return depth_accuracy(ids.select(F.col("vec_id").alias("pos"), "pred"), ids.select(F.col("vec_id").alias("pos"), F.col("tgt").alias("target"), "mask"), STEPS)


_SQL_BLOCKS = f"""bx AS (
  SELECT *, 1.0 / (1.0 + exp(-conf_logit)) AS c, CAST(mask AS DOUBLE) AS m FROM fx
),
blk AS (
  SELECT batch_id, block_id,
    list(alpha * m ORDER BY slot) FILTER (WHERE slot > 0) AS xa,
    list(c * m ORDER BY slot) FILTER (WHERE slot > 0) AS xc,
    list(m ORDER BY slot) FILTER (WHERE slot > 0) AS xm,
    sum(alpha * m) AS s_am, sum(m) AS s_m, sum(abs(c - alpha) * m) AS s_abs, sum(c * m) AS s_c,
    sum((greatest(conf_logit, 0.0) - conf_logit * alpha + ln(1 + exp(-abs(conf_logit)))) * m * {_SQL_DECAY}) AS s_bce
  FROM bx GROUP BY batch_id, block_id
),
pre AS (
  SELECT *, list_transform(range(1, len(xa) + 1), lambda k: list_reduce(xa[1:k], lambda x, y: x * y)) AS pa,
            list_transform(range(1, len(xc) + 1), lambda k: list_reduce(xc[1:k], lambda x, y: x * y)) AS pc
  FROM blk
),
fin AS (
  SELECT *, list_sum(pa) AS sum_pa, list_sum(list_transform(list_zip(pc, pa, xm), lambda z: (z[1] - z[2]) * z[3])) AS bias,
         list_sum(xm) AS n FROM pre
),
bat AS (
  SELECT batch_id, sum(s_am) AS s_am, sum(s_m) AS s_m, sum(s_abs) AS s_abs, sum(s_c) AS s_c, sum(s_bce) / (sum(s_m) + 1e-8) AS b_bce,
         sum(CASE WHEN n > 0 THEN sum_pa + 1.0 ELSE 0.0 END) AS s_len, sum(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS n_valid,
         sum(bias) AS s_bias, sum(n) AS n_draft
  FROM fin GROUP BY batch_id
)"""


@register("accept_length", f"""WITH {_SQL_SCORED},
{_SQL_BLOCKS}
SELECT round(sum(s_am) / greatest(sum(greatest(s_m, 1.0)), 1.0), 6) AS accept_rate,
       round(sum(s_len) / greatest(sum(greatest(n_valid, 1.0)), 1.0), 6) AS accept_len FROM bat""", G)
def accept_length(spark, sf):
    r = block_metrics(_scored(spark, sf), BLOCK, GAMMA, conf=None)
    return r.select(F.round("accept_rate", 6).alias("accept_rate"), F.round("accept_len", 6).alias("accept_len"))


@register("confidence_calibration", f"""WITH {_SQL_SCORED},
{_SQL_BLOCKS}
SELECT round(avg(b_bce), 6) AS confidence_loss, round(sum(s_abs) / greatest(sum(greatest(s_m, 1.0)), 1.0), 6) AS abs_error,
       round(sum(s_c) / greatest(sum(greatest(s_m, 1.0)), 1.0), 6) AS pred_mean,
       round(sum(s_bias) / greatest(sum(greatest(n_draft, 1.0)), 1.0), 6) AS cumprod_bias
FROM bat""", G)
def confidence_calibration(spark, sf):
    r = block_metrics(_scored(spark, sf), BLOCK, GAMMA)
    return r.select(*[F.round(c, 6).alias(c) for c in ("confidence_loss", "abs_error", "pred_mean", "cumprod_bias")])


_W = step_weights(STEPS, BETA)
_SQL_W = "CASE k.step " + " ".join(f"WHEN {i} THEN CAST('{w!r}' AS DOUBLE)" for i, w in enumerate(_W)) + " END"


@register("mtp_step_loss", f"""WITH {_SQL_SCORED},
j AS (
  SELECT k.step, -a.lq[list_position(b.target, list_max(b.target))] AS l, b.mask
  FROM lsm a CROSS JOIN (SELECT UNNEST(range({STEPS})) AS step) k JOIN lsm b ON b.vec_id = a.vec_id + k.step
)
SELECT CAST(step AS INTEGER) AS step, round(max(w), 6) AS weight, CAST(count(*) FILTER (WHERE mask) AS BIGINT) AS n_valid,
       round(max(w) * coalesce(sum(l) FILTER (WHERE mask), 0.0) / greatest(count(*) FILTER (WHERE mask), 1), 6) AS step_loss
FROM (SELECT j.*, {_SQL_W.replace('k.step', 'j.step')} AS w FROM j) GROUP BY step""", G)
def mtp_step_loss_q(spark, sf):
    """A20 + F10: ``w_k * sum ce / max(valid, 1)`` per step, ``w = beta^k / sum beta^j``."""
    s = _scored(spark, sf)
    rows = s.select(F.col("vec_id").alias("pos"), "draft")
    at = s.select(F.col("vec_id").alias("pos"), "target", "mask")
    j = gather_ahead(rows, at, STEPS, key_col="step").withColumn("ce", ce(F.col("draft"), F.col("target")))
    r = mtp_step_loss(j, _W)
    return r.select(F.col("step").cast("int"), F.round("weight", 6).alias("weight"), "n_valid", F.round("step_loss", 6).alias("step_loss"))


@register("acceptance_thresholds", f"""WITH {_SQL_SCORED},
agg AS (SELECT slot AS pos, sum(CAST(pred = tgt AS BIGINT)) AS correct, count(*) AS total FROM fx WHERE mask GROUP BY slot),
th AS (SELECT * FROM (VALUES {", ".join(f"({p}, {t})" for p, t in THRESHOLDS)}) t(pos, threshold))
SELECT CAST(th.pos AS BIGINT) AS pos, CAST(th.threshold AS DOUBLE) AS threshold,
       round(coalesce(CAST(a.correct AS DOUBLE) / a.total, 0.0), 6) AS rate,
       CAST(coalesce(CAST(a.correct AS DOUBLE) / a.total, 0.0) >= th.threshold AS INTEGER) AS passed
FROM th LEFT JOIN agg a ON a.pos = th.pos""", G)
def acceptance_thresholds(spark, sf):
    per = position_accuracy(spark, _ids(spark, sf), BLOCK, "slot", "pred", "tgt")
    rate = per.select("pos", F.when(F.col("total") > 0, F.col("correct") / F.col("total")).otherwise(0.0).alias("rate"))
    th = spark.createDataFrame(THRESHOLDS, "pos bigint, threshold double")
    r = threshold_check(rate, broadcast_bounded(th, len(THRESHOLDS), "thresholds"))
    return r.select("pos", "threshold", F.round("rate", 6).alias("rate"), F.col("passed").cast("int").alias("passed"))


@register("greedy_acceptance", f"""WITH {_SQL_SCORED},
g AS (
  SELECT block_id, list_position(draft, list_max(draft)) AS tok, target FROM fx
),
h AS (SELECT block_id, target[tok] AS tv, list_max(target) AS tm, target FROM g)
SELECT block_id,
  CAST(sum(CAST(len(list_filter(target, lambda v: v > tv)) + 1 <= 1 AND tm - tv <= 0.0 AS BIGINT)) AS BIGINT) AS accepted_k1,
  CAST(sum(CAST(len(list_filter(target, lambda v: v > tv)) + 1 <= 3 AND tm - tv <= 0.5 AS BIGINT)) AS BIGINT) AS accepted_k3
FROM h GROUP BY block_id""", G)
def greedy_acceptance(spark, sf):
    s = _scored(spark, sf)
    return s.groupBy("block_id").agg(
        F.sum(greedy_accept(s, 1, 0.0).cast("bigint")).alias("accepted_k1"),
        F.sum(greedy_accept(s, 3, 0.5).cast("bigint")).alias("accepted_k3"),
    )


@register("step_metrics", f"""WITH {_SQL_SCORED},
st AS (
  SELECT a.vec_id AS pos, a.batch_id, a.mask AS base_mask, k.step, b.mask, a.pred, b.tgt AS target,
         list_sum(list_transform(list_zip(b.lpp, a.lq), lambda z: CASE WHEN exp(z[1]) > 0 THEN exp(z[1]) * (z[1] - z[2]) ELSE 0.0 END)) AS kl
  FROM fx a CROSS JOIN (SELECT UNNEST(range({STEPS})) AS step) k JOIN fx b ON b.vec_id = a.vec_id + k.step
),
ch AS (
  SELECT *, base_mask AND coalesce(min(CAST(pred = target AS INTEGER)) OVER (PARTITION BY pos ORDER BY step
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) = 1 AS prev FROM st
),
lb AS (SELECT step, batch_id, sum(kl * CAST(mask AS DOUBLE) * pow(0.8, step)) / (sum(CAST(mask AS DOUBLE)) + 1e-5) AS l FROM st GROUP BY step, batch_id),
ls AS (SELECT step, avg(l) AS loss FROM lb GROUP BY step),
acc AS (
  SELECT step, sum(CAST(prev AND pred = target AND mask AS BIGINT)) AS full_correct, sum(CAST(mask AS BIGINT)) AS full_total,
         sum(CAST(prev AS BIGINT)) AS cond_total FROM ch GROUP BY step
)
SELECT CAST(a.step AS INTEGER) AS step, round(l.loss, 6) AS loss, CAST(a.full_correct AS BIGINT) AS full_correct,
       CAST(a.full_total AS BIGINT) AS full_total, CAST(a.cond_total AS BIGINT) AS cond_total
FROM acc a JOIN ls l USING (step)""", G)
def step_metrics_q(spark, sf):
    """A15 (+P51, J9): per step ``k``, the draft at ``p`` is scored against the
    target at ``p+k`` with the mask at ``p+k``: a KL loss with step decay
    ``0.8**k`` (A9 per batch, mean over batches) and the chained accuracy (A7)."""
    s = _scored(spark, sf)
    rows = s.select(F.col("vec_id").alias("pos"), "batch_id", F.col("mask").alias("base_mask"), "draft", argmax(F.col("draft")).alias("pred"))
    at = s.select(F.col("vec_id").alias("pos"), "target", "mask", argmax(F.col("target")).alias("tgt"))
    st = gather_ahead(rows, at, STEPS, key_col="step").withColumn("loss_term", kl(F.col("draft"), F.col("target")))
    r = step_metrics(st.drop("target").withColumnRenamed("tgt", "target"), 0.8)
    return r.select(F.col("step").cast("int"), F.round("loss", 6).alias("loss"), "full_correct", "full_total", "cond_total")
