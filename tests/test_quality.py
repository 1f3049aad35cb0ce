"""Losses and draft-quality metrics (FIXTURES 24-29) + algebraic identities."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftsmith.functions.distributions import (
    block_decay, ce, kl, lk_hybrid, nla, overlap, parse_loss_spec, power_decay, rkl, step_weights, tv,
)
from draftsmith.operators.quality import block_metrics, chain_accuracy, compound_loss, position_accuracy


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "id long, draft array<double>, target array<double>")


def _np_softmax(x):
    e = np.exp(np.asarray(x) - np.max(x))
    return e / e.sum()


def test_losses_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=16).tolist(), (3 * rng.normal(size=16)).tolist()) for i in range(20)]
    df = _pairs(spark, rows)
    got = df.select("id", kl("draft", "target").alias("kl"), rkl("draft", "target").alias("rkl"), ce("draft", "target").alias("ce"),
                    tv("draft", "target").alias("tv"), nla("draft", "target").alias("nla"), lk_hybrid("draft", "target").alias("lk")).collect()
    for r, (_, d, t) in zip(sorted(got, key=lambda r: r.id), rows):
        q, p = _np_softmax(d), _np_softmax(t)
        assert r.kl == pytest.approx(float(np.sum(p * (np.log(p) - np.log(q)))), rel=1e-9)
        assert r.rkl == pytest.approx(float(np.sum(q * (np.log(q) - np.log(p)))), rel=1e-9)
        assert r.ce == pytest.approx(float(-np.log(q[int(np.argmax(t))])), rel=1e-9)
        a = float(np.minimum(p, q).sum())
        assert r.tv == pytest.approx(1 - a) and r.tv == pytest.approx(0.5 * float(np.abs(p - q).sum()))
        assert r.nla == pytest.approx(-math.log(max(a, 1e-5)))
        lam = math.exp(-3 * a)
        assert r.lk == pytest.approx(lam * r.kl + (1 - lam) * r.tv)


def test_nla_equals_ce_on_point_mass(spark):
    t = [0.0] * 8
    t[3] = 200.0
    df = _pairs(spark, [(0, [0.1 * i for i in range(8)], t)])
    r = df.select(nla("draft", "target").alias("n"), ce("draft", "target").alias("c")).first()
    assert r.n == pytest.approx(r.c, rel=1e-6)


def test_lk_hybrid_eta_zero_is_kl(spark):
    df = _pairs(spark, [(0, [0.3, -1.0, 2.0], [1.0, 0.0, -1.0])])
    r = df.select(lk_hybrid("draft", "target", eta=0.0).alias("h"), kl("draft", "target").alias("k")).first()
    assert r.h == pytest.approx(r.k)


def test_large_logits_are_stable(spark):
    df = _pairs(spark, [(0, [1000.0, 999.0], [1000.0, 1001.0])])
    r = df.select(overlap("draft", "target").alias("a")).first()
    assert 0 < r.a < 1


def test_decays(spark):
    r = spark.range(1).select(
        block_decay(F.lit(0), 4.0).alias("b0"), block_decay(F.lit(1), 4.0).alias("b1"), power_decay(F.lit(2), 0.5).alias("p2")
    ).first()
    assert (r.b0, r.b1, r.p2) == (0.0, 1.0, 0.25)
    w = step_weights(3, 0.6)
    assert sum(w) == pytest.approx(1.0) and w[0] > w[1] > w[2]


def test_chain_accuracy_fixture(spark):
    pred = {0: [1, 2, 3, 0], 1: [1, 2, 0, 4]}
    tgt = {0: [1, 2, 3, 4], 1: [1, 2, 5, 4]}
    rows = [(p, s, pred[s][p], tgt[s][p], True, True) for s in (0, 1) for p in range(4)]
    df = spark.createDataFrame(rows, "pos long, step int, pred long, target long, mask boolean, base_mask boolean")
    r = {x.step: x for x in chain_accuracy(df).collect()}
    assert (r[0].full_correct, r[0].full_total) == (3, 4)
    assert (r[1].full_correct, r[1].full_total, r[1].cond_correct, r[1].cond_total) == (2, 4, 2, 3)


def test_position_accuracy_fixture(spark):
    df = spark.createDataFrame([(0, 2, 2, True), (1, 1, 1, True), (0, 0, 0, True), (1, 1, 0, True)], "slot int, pred long, target long, mask boolean")
    r = {x.pos: x for x in position_accuracy(spark, df, 2, "slot").collect()}
    assert r[0].correct / r[0].total == 1.0 and r[1].correct / r[1].total == 0.5
    df2 = spark.createDataFrame([(0, 2, 2, True), (1, 1, 0, False), (0, 0, 0, True), (1, 1, 1, True)], "slot int, pred long, target long, mask boolean")
    r2 = {x.pos: x for x in position_accuracy(spark, df2, 3, "slot").collect()}
    assert r2[0].correct / r2[0].total == 1.0 and r2[1].correct / r2[1].total == 1.0 and r2[2].total == 0


def _blocks(spark, draft_eq_target, mask, conf=20.0):
    rows = []
    for i, m in enumerate(mask):
        d = [5.0, 0.0, 0.0] if draft_eq_target else [0.0, 5.0, 0.0]
        rows.append((i // 2, i // 2, i % 2, m, conf, d, [5.0, 0.0, 0.0]))
    return spark.createDataFrame(rows, "batch_id long, block_id long, slot int, mask boolean, conf_logit double, draft array<double>, target array<double>")


def test_accept_length_fixture(spark):
    r = block_metrics(_blocks(spark, True, [False, True, False, True]), 2).first()
    assert r.accept_rate == pytest.approx(1.0, abs=1e-9) and r.accept_len == pytest.approx(2.0, abs=1e-9)


def test_calibration_fixture(spark):
    r = block_metrics(_blocks(spark, False, [False, True, False, True]), 2).first()
    assert r.cumprod_bias > 0.5


def test_compound_loss_single_and_multi(spark):
    rows = [(0, 0, True, [0.1, 0.2], [0.3, 0.1]), (0, 1, False, [0.1, 0.2], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "batch_id long, slot int, mask boolean, draft array<double>, target array<double>")
    one = compound_loss(df, {"kl": 1.0})
    assert one.columns == ["loss"]
    two = compound_loss(df, {"kl": 1.0, "tv": 0.5}).first()
    assert two.loss == pytest.approx(two.kl_loss + 0.5 * two.tv_loss)
    zero = compound_loss(df.withColumn("mask", F.lit(False)), {"kl": 1.0}).first()
    assert zero.loss == 0.0


def test_loss_spec():
    assert parse_loss_spec("kl") == {"kl": 1.0}
    assert parse_loss_spec('{"kl": 1, "tv": 0.5}') == {"kl": 1.0, "tv": 0.5}
    for bad in ("", "nope", '{"kl": "x"}', "{}"):
        with pytest.raises(ValueError):
            parse_loss_spec(bad)


def test_position_counts_sum_to_totals(spark):
    from draftsmith.operators.quality import block_accuracy

    rows = [(i % 4, i % 3, (i * 5) % 3, (i % 5) != 0) for i in range(200)]
    df = spark.createDataFrame(rows, "slot int, pred long, target long, mask boolean")
    per = position_accuracy(spark, df, 4, "slot")
    tot = block_accuracy(per).first()
    sub = per.filter("pos > 0").agg(F.sum("correct").alias("c"), F.sum("total").alias("t")).first()
    assert (tot.full_correct, tot.full_total) == (sub.c, sub.t)
    assert per.agg(F.sum("total")).first()[0] == sum(1 for r in rows if r[3])
