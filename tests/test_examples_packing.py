"""Example builders and packing (FIXTURES 19, 21, 22, 30, 32) + packing invariants."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from draftsmith.operators.examples import align_targets, anchor_blocks, anchor_context, batch_lengths, causal_pair_counts, chain_context, collate_rows, mtp_step_targets, pack_slots, shift_rows  # noqa: F401
from draftsmith.operators.packing import assign_bins, bin_runs, pack_batches, pack_running_sums, pack_summary, stride


def test_shift_fixture(spark):
    df = spark.createDataFrame([(0, [0, 1, 2, 3, 4], [False, False, True, True, True], [[0.0], [1.0], [2.0], [3.0], [4.0]])],
                               "sample_id long, input_ids array<long>, loss_mask array<boolean>, hidden_states array<array<double>>")
    r = shift_rows(df, state_cols=("hidden_states",)).first()
    assert r.input_ids == [1, 2, 3, 4] and r.loss_mask == [False, True, True, True]
    assert r.position_ids == [1, 2, 3, 4] and r.lengths == 4 and r.hidden_states == [[0.0], [1.0], [2.0], [3.0]]
    empty = spark.createDataFrame([(1, [], [])], "sample_id long, input_ids array<long>, loss_mask array<boolean>")
    assert shift_rows(empty).first().lengths == 0


def _rows(spark, lengths):
    return spark.createDataFrame([(i, 0, i, list(range(100 * i, 100 * i + n)), [True] * n) for i, n in enumerate(lengths)],
                                 "sample_id long, batch long, ord long, input_ids array<long>, loss_mask array<boolean>")


def test_collate_fixture_2_6(spark):
    s = pack_slots(_rows(spark, [2, 6]), "batch", "ord", 10).orderBy("slot").collect()
    assert [r.document_id for r in s] == [0, 0, 1, 1, 1, 1, 1, 1, -1, -1]
    assert [r.position_id for r in s][:8] == [0, 1, 0, 1, 2, 3, 4, 5]


def test_collate_fixture_5_7(spark):
    s = pack_slots(_rows(spark, [5, 7]), "batch", "ord", 11).orderBy("slot").collect()
    assert [r.document_id for r in s] == [0] * 5 + [1] * 6
    ls = [r.length for r in batch_lengths(_rows(spark, [5, 7]), "batch", "ord", 11).orderBy("document_id").collect()]
    assert ls == [5, 6]


def test_document_context_fixture(spark):
    b = collate_rows(_rows(spark, [1, 2, 3]), "batch", "ord", 8)
    assert causal_pair_counts(b).first().n_pairs == 1 + 3 + 6  # the padding sees nothing
    b = b.withColumn("anchors", F.expr("array(named_struct('anchor_no', 0, 'anchor', 5L, 'anchor_valid', true), named_struct('anchor_no', 1, 'anchor', 0L, 'anchor_valid', false))"))
    assert [tuple(r) for r in anchor_context(b, 1).collect()] == [(0, 0, 5, 1)]
    assert [(r.depth, r.n_visible) for r in chain_context(b, 2).orderBy("depth").collect()] == [(0, 3), (1, 4)]
    assert b.select(align_targets(F.col("input_ids"), 8).alias("x")).first().x == [None] + b.first().input_ids[:-1]


def test_anchor_blocks_fixture(spark):
    slots = pack_slots(_rows(spark, [20]), "batch", "ord", 20)
    anchors = spark.createDataFrame([(0, 0, 0, True), (0, 1, 5, True), (0, 2, 10, True)], "batch_id long, anchor_no int, anchor long, anchor_valid boolean")
    b = anchor_blocks(anchors, slots, 3, 999).orderBy("anchor_no", "j").collect()
    assert [r.anchor + r.j for r in b] == [0, 1, 2, 5, 6, 7, 10, 11, 12]
    assert [r.block_input for r in b][:3] == [0, 999, 999]
    assert [r.block_mask for r in b][:3] == [False, True, True]


def test_mtp_targets(spark):
    df = spark.createDataFrame([(0, [10, 11, 12, 13, 14, 15], [True, True, False, True, True, True])], "sample_id long, input_ids array<long>, loss_mask array<boolean>")
    t = {r.step: r for r in mtp_step_targets(df, 3).collect()}
    assert set(t) == {0, 1, 2} and t[0].valid_len == 2
    assert t[0].step_targets == [-100, 13] and t[0].step_inputs == [11, 12]
    assert t[2].step_targets == [14, 15]


def _py_bins(rows, max_len, levels):
    """Plain loop over one shard's (id, length) in order: id -> (level, cut)."""
    out, left = {}, rows
    for k in range(levels):
        at, again = 0, []
        for i, n in left:
            if at // max_len == max(at + n - 1, at) // max_len:
                out[i] = (k, at // max_len)
            else:
                again.append((i, n))
            at += n
        left = again
    return out | {i: (levels, j) for j, (i, _) in enumerate(left)}


def test_bins_match_a_plain_loop(spark):
    rng = random.Random(0)
    lens = {i: rng.choice([0, 1, 5, 30, 64, rng.randint(1, 64)]) for i in range(500)}
    df = spark.createDataFrame(list(lens.items()), "sample_id long, length long")
    got = assign_bins(df, 64, seed=3, shards=4, levels=2).collect()
    for shard in range(4):
        rows = sorted((r.item, r.sample_id, r.length) for r in got if r.shard == shard)
        want = _py_bins([(i, n) for _, i, n in rows], 64, 2)
        assert {r.sample_id: (r.level, r.cut) for r in got if r.shard == shard} == want


@pytest.mark.parametrize("pack", [pack_batches, pack_running_sums])
def test_pack_invariants(spark, pack):
    kw = {"shards": 3} if pack is pack_running_sums else {}
    rng = random.Random(1)
    lens = spark.createDataFrame([(i, rng.randint(5, 600)) for i in range(4000)], "sample_id long, length long")
    plan = pack(lens, 1024, 4, seed=3, **kw)
    rows = plan.collect()
    ids = [r.sample_id for r in rows]
    assert len(ids) == len(set(ids))
    fill = {}
    for r in rows:
        fill[(r.batch_no, r.replica)] = fill.get((r.batch_no, r.replica), 0) + r.length
    assert max(fill.values()) <= 1024
    batches = {b for b, _ in fill}
    assert batches == set(range(len(batches))) and len(fill) == 4 * len(batches)
    s = pack_summary(plan, lens, 1024, 4).first()
    assert s.n_packed == len(ids) and s.n_dropped == 4000 - len(ids) and 0.5 < s.fill_ratio <= 1
    whole = pack(lens, 1024, 4, seed=3, drop_last=False, **kw)
    assert whole.count() == 4000  # every sample is placed


def _plain_best_fit(lengths, max_len):
    """Bin of each length (in descending order), one by one."""
    room, out = [], []
    for n in lengths:
        fits = [(r, b) for b, r in enumerate(room) if r >= n]
        if not fits:
            room.append(max_len)
            fits = [(max_len, len(room) - 1)]
        _, b = min(fits)
        room[b] -= n
        out.append(b)
    return out, len(room)


def test_runs_are_best_fit_decreasing():
    for seed in range(400):
        rng = random.Random(seed)
        max_len = rng.randint(1, 40)
        lens = sorted((rng.randint(1, max_len) for _ in range(rng.randint(0, 80))), reverse=True)
        runs, bins = bin_runs({n: lens.count(n) for n in lens}, max_len)
        ends = [r[0] for r in runs[1:]] + [len(lens)]
        got = [first + (i - item) // per for (item, first, per), end in zip(runs, ends) for i in range(item, end)]
        assert (got, bins) == _plain_best_fit(lens, max_len)


def test_stride_is_a_permutation():
    for bins in (1, 2, 3, 10, 97, 360):
        for seed in range(9):
            step, shift = stride(bins, seed)
            assert sorted((b * step + shift) % bins for b in range(bins)) == list(range(bins))


def test_packing_is_dense_and_independent_of_the_layout(spark):
    """Lengths 100 to 2,599 and bins of 4,096: full to 97 % at least; one length
    may hold a third of the samples; small buckets and other partitions change nothing."""
    rng = random.Random(7)
    rows = [(i, 1500 if i % 3 == 0 else rng.randint(100, 2599)) for i in range(20_000)]
    lens = spark.createDataFrame(rows, "sample_id long, length long")
    plan = pack_batches(lens, 4096, 8, seed=5)
    even = pack_summary(pack_batches(spark.createDataFrame([(i, rng.randint(100, 2599)) for i in range(20_000)], "sample_id long, length long"), 4096, 8), lens, 4096, 8).first()
    assert even.fill_ratio >= 0.97
    got = {r.sample_id: (r.batch_no, r.replica, r.item) for r in plan.collect()}
    _, n = bin_runs(Counter(length for _, length in rows), 4096)
    assert len({g[:2] for g in got.values()}) == n // 8 * 8
    fill = {}
    for i, length in rows:
        if i in got:
            fill[got[i][:2]] = fill.get(got[i][:2], 0) + length
    assert max(fill.values()) <= 4096
    other = pack_batches(lens.repartition(7), 4096, 8, seed=5, bucket_rows=300)
    assert {r.sample_id: (r.batch_no, r.replica, r.item) for r in other.collect()} == got
    # batches are mixed: long and short samples all over the epoch
    half = [length for i, length in rows if i in got and got[i][0] < n // 16]
    rest = [length for i, length in rows if i in got and got[i][0] >= n // 16]
    assert abs(sum(half) / len(half) - sum(rest) / len(rest)) < 60


def test_packing_empty_and_long_samples(spark):
    lens = spark.createDataFrame([(i, 0) for i in range(50)] + [(100, 99), (101, None), (102, 10)], "sample_id long, length long")
    plan = pack_batches(lens, 10, 1).collect()
    assert len(plan) == 53 and max(r.length or 0 for r in plan) == 10
    per = {}
    for r in plan:
        per[r.batch_no] = per.get(r.batch_no, 0) + max(r.length or 0, 1)
    assert max(per.values()) <= 10 and len(per) == 8
    assert pack_batches(lens.filter("sample_id = 100"), 10, 1, truncate_long=False).collect() == []
    assert pack_batches(lens.limit(0), 10, 2).collect() == []


def test_collate_rows_fixtures(spark):
    from draftsmith.operators.examples import collate_rows

    r = collate_rows(_rows(spark, [2, 6]), "batch", "ord", 10).first()
    assert r.document_ids == [0, 0, 1, 1, 1, 1, 1, 1, -1, -1]
    assert r.position_ids == [0, 1, 0, 1, 2, 3, 4, 5, 0, 0] and r.lengths == [2, 6]
    assert r.input_ids[:3] == [0, 1, 100] and r.input_ids[-2:] == [0, 0] and r.loss_mask[-1] is False
    r2 = collate_rows(_rows(spark, [5, 7]), "batch", "ord", 11).first()
    assert r2.document_ids == [0] * 5 + [1] * 6 and r2.lengths == [5, 6]


def test_row_and_slot_layouts_agree(spark):
    from draftsmith.operators.examples import anchors_in_row, blocks_in_row, collate_rows

    rows = spark.createDataFrame(
        [(i, i // 3, i, list(range(1000 * i, 1000 * i + 7 + i)), [bool((i + k) % 3) for k in range(7 + i)]) for i in range(9)],
        "sample_id long, batch long, ord long, input_ids array<long>, loss_mask array<boolean>",
    )
    L, n, B = 32, 4, 3
    slots = pack_slots(rows, "batch", "ord", L)
    from draftsmith.operators.examples import sample_anchors

    a_slot = {(r.batch_id, r.anchor_no): (r.anchor, r.anchor_valid) for r in sample_anchors(slots, n, B, L, 5).collect()}
    br = collate_rows(rows, "batch", "ord", L).withColumn("anchors", anchors_in_row(F.col("batch_id"), F.col("loss_mask"), n, B, L, 5))
    a_row = {(r.batch_id, a.anchor_no): (a.anchor, a.anchor_valid) for r in br.collect() for a in r.anchors}
    assert a_slot == a_row
    b_slot = {(r.batch_id, r.anchor_no, r.j): (r.block_input, r.block_mask, r.target) for r in anchor_blocks(sample_anchors(slots, n, B, L, 5), slots, B, 999).collect()}
    blocks = br.select("batch_id", F.explode(blocks_in_row(F.col("anchors"), F.col("input_ids"), F.col("loss_mask"), B, 999)).alias("b"))
    b_row = {(r.batch_id, r.b.anchor_no, r.b.j): (r.b.block_input, r.b.block_mask, r.b.target) for r in blocks.collect()}
    assert b_slot == b_row


def test_resume_skips_batches_without_payload(spark):
    """Resuming inside an epoch is a filter on the stored plan (ids and
    lengths only) — the first n batches are skipped, whatever the shard count."""
    from draftsmith.operators.packing import skip_batches

    lens = spark.createDataFrame([(i, 10 + (i * 7) % 50) for i in range(600)], "sample_id long, length long")
    for plan in (pack_batches(lens, 100, 2, seed=1), pack_running_sums(lens, 100, 2, seed=1, shards=4)):
        rest = skip_batches(plan, 3)
        assert set(plan.columns) == {"batch_no", "replica", "sample_id", "length", "item"}
        assert rest.agg(F.min("batch_no")).first()[0] == 3
        assert plan.select("batch_no").distinct().count() - rest.select("batch_no").distinct().count() == 3


def test_cod_in_row_equals_join_based(spark):
    from draftsmith.operators.sampling import cod_sample, cod_sample_rows

    rows = spark.createDataFrame(
        [(i, list(range(20 + 3 * i)), [bool((i * k) % 4) for k in range(20 + 3 * i)]) for i in range(12)]
        + [(99, [], [])],
        "sample_id long, input_ids array<long>, loss_mask array<boolean>",
    )
    for depths, top in ((2, None), (5, None), (4, 6)):
        a = cod_sample(rows, depths, 0.7, 0.2, seed=3, max_anchors=top).select("sample_id", "depth", "anchor")
        b = cod_sample_rows(rows, depths, 0.7, 0.2, seed=3, max_anchors=top).select("sample_id", "depth", "anchor")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_empty_documents_and_tiny_batches(spark):
    from draftsmith.operators.examples import anchors_in_row, collate_rows

    rows = spark.createDataFrame(
        [(0, 0, 0, [1, 2], [True, True]), (1, 0, 1, [], []), (2, 0, 2, [3], [True])],
        "sample_id long, batch long, ord long, input_ids array<long>, loss_mask array<boolean>",
    )
    r = collate_rows(rows, "batch", "ord", 5).first()
    assert r.document_ids == [0, 0, 2, -1, -1] and r.position_ids == [0, 1, 0, 0, 0] and r.lengths == [2, 0, 1]
    assert len(r.input_ids) == len(r.loss_mask) == len(r.position_ids) == 5
    a = collate_rows(rows, "batch", "ord", 3).withColumn("a", anchors_in_row(F.col("batch_id"), F.col("loss_mask"), 2, 4, 3, 0)).first().a
    assert [x.anchor_valid for x in a] == [False, False]  # max_len <= block: no candidate, never a count-down range
