"""Training-example builders.

Two layouts are used:

* **row layout** — one row per sample with array columns.  Per-sample
  shifts, slices and step targets are higher-order array functions: no
  shuffle, no explode, whole-stage codegen.
* **slot layout** — one row per token slot of a packed batch
  ``(batch_id, slot, document_id, token, mask, position_id)``.  Built from a
  window over *documents* (not tokens) per batch, so the only shuffle is on
  the batch id and the per-batch work is bounded by ``max_len``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from draftsmith.functions.hashing import seeded_key

# ----------------------------------------------------------------- row layout


def with_positions(rows: DataFrame) -> DataFrame:
    """``lengths`` and ``position_ids = 0..n-1``."""
    n = F.size("input_ids")
    return rows.withColumn("lengths", n).withColumn(
        "position_ids", F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    )


def shift_rows(rows: DataFrame, state_cols: tuple[str, ...] = (), verifier_cols: tuple[str, ...] = ()) -> DataFrame:
    """P39 + W6: token, mask, verifier state and position from ``t+1`` (the
    next-token shift); hidden state from ``t``.

    ``lengths = max(n - 1, 0)``.  Arrays are sliced in row (no window).
    """
    rows = with_positions(rows) if "position_ids" not in rows.columns else rows
    rows = rows.withColumn("_n", F.size("input_ids"))  # fixed before any column is replaced
    keep = F.greatest(F.col("_n") - 1, F.lit(0))
    out = rows.withColumn("lengths", keep)
    for c in ("input_ids", "loss_mask", "position_ids", *verifier_cols):
        out = out.withColumn(c, F.slice(F.col(c), 2, keep))
    for c in state_cols:
        out = out.withColumn(c, F.slice(F.col(c), 1, keep))
    return out.drop("_n")


def shift_rows_mtp(rows: DataFrame) -> DataFrame:
    """The MTP variant only renames (``verifier_last_hidden_states`` → ``hidden_states``)."""
    if "verifier_last_hidden_states" in rows.columns:
        return rows.withColumnRenamed("verifier_last_hidden_states", "hidden_states")
    return rows


def slice_pad(arr: Column, length: int, pad: Column | int = 0) -> Column:
    """First ``length`` elements, padded with ``pad``."""
    p = pad if isinstance(pad, Column) else F.lit(pad)
    return F.slice(F.concat(arr, F.array_repeat(p, F.lit(length))), 1, length)


def mtp_step_targets(rows: DataFrame, num_steps: int = 3, ignore_index: int = -100) -> DataFrame:
    """Per step ``k``: input ``ids[p+k+1]``, target ``ids[p+k+2]`` (masked → ignore).

    ``steps = min(K, max(0, n-2))``, ``valid_len = n - steps - 1``.  One row
    per (sample, step) from ``explode(sequence)`` — the step table comes from
    the row itself, never from a cross join.
    """
    n = F.size("input_ids")
    steps = F.least(F.lit(num_steps), F.greatest(n - 2, F.lit(0)))
    base = rows.withColumn("_steps", steps).withColumn("valid_len", n - F.col("_steps") - 1)
    base = base.filter(F.col("_steps") > 0).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_steps") - 1)))
    tgt = F.slice("input_ids", F.col("step") + 3, F.col("valid_len"))
    msk = F.slice("loss_mask", F.col("step") + 3, F.col("valid_len"))
    inp = F.slice("input_ids", F.col("step") + 2, F.col("valid_len"))
    return base.select(
        "sample_id",
        "step",
        "valid_len",
        inp.alias("step_inputs"),
        F.zip_with(tgt, msk, lambda t, m: F.when(m, t).otherwise(F.lit(ignore_index).cast("bigint"))).alias("step_targets"),
    )


def offpolicy_targets(rows: DataFrame, num_steps: int = 3) -> DataFrame:
    """P50: ground truth shifted left by ``1+step``, zero padded, per step."""
    n = F.size("input_ids")
    base = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(num_steps - 1))))
    shifted = F.concat(
        F.slice("input_ids", F.col("step") + 2, F.greatest(n - F.col("step") - 1, F.lit(0))),
        F.array_repeat(F.lit(0).cast("bigint"), F.least(F.col("step") + 1, n)),
    )
    return base.select("sample_id", "step", shifted.alias("targets"))


def step_alignment(rows: DataFrame, pred_col: str, num_steps: int = 3) -> DataFrame:
    """``pred[p]`` vs ``target[p+step]`` with the mask at ``p+step``.

    Returns ``(sample_id, step, correct, total)`` over masked aligned pairs.
    """
    n = F.size("input_ids")
    base = rows.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(num_steps - 1))))
    m = F.greatest(n - F.col("step"), F.lit(0))
    pred = F.slice(pred_col, 1, m)
    tgt = F.slice("input_ids", F.col("step") + 1, m)
    msk = F.slice("loss_mask", F.col("step") + 1, m)
    pairs = F.arrays_zip(pred.alias("p"), tgt.alias("t"), msk.alias("m"))
    ok = F.filter(pairs, lambda x: x["m"])
    return base.select(
        "sample_id",
        "step",
        F.size(F.filter(ok, lambda x: x["p"] == x["t"])).cast("bigint").alias("correct"),
        F.size(ok).cast("bigint").alias("total"),
    )


def uniform_noise(vec: Column, seed: int, row_id: Column, std: float = 0.05) -> Column:
    """``x + 2*(u - 0.5)*std`` with ``u`` a hash of ``(seed, id, i)`` (reproducible)."""
    return F.transform(
        vec,
        lambda x, i: x + (F.lit(2.0) * (seeded_key(seed, row_id, i) / F.lit(4294967296.0) - 0.5) * std),
    )


def gaussian_noise(vec: Column, seed: int, row_id: Column, std: float = 0.05) -> Column:
    """P41 Gaussian: Box–Muller on two hash uniforms (reproducible)."""
    def u(tag, i):
        return (seeded_key(seed, row_id, i, F.lit(tag)) + 1) / F.lit(4294967297.0)

    return F.transform(
        vec, lambda x, i: x + F.sqrt(-2.0 * F.log(u("a", i))) * F.cos(2 * 3.141592653589793 * u("b", i)) * std
    )


def split_layers(states: Column, num_layers: int, hidden: int) -> tuple[Column, Column]:
    """``[layers*hidden]`` → (first ``layers-1`` concatenated, last layer)."""
    body = F.slice(states, 1, (num_layers - 1) * hidden)
    last = F.slice(states, (num_layers - 1) * hidden + 1, hidden)
    return body, last


# ---------------------------------------------------------------- slot layout


def pack_slots(rows: DataFrame, batch_col: str, order_col: str, max_len: int) -> DataFrame:
    """P43 + W1 + W9: collate the samples of each batch into ``max_len`` slots.

    Documents are concatenated in ``order_col`` order; the document that
    crosses ``max_len`` is truncated and later ones are dropped; padding
    slots get ``document_id = -1``, token 0, mask false, position 0.

    One window stage over the *documents* of a batch (one exchange on the
    batch id), then a single explode: every document emits its kept token
    slots and the batch's last document also emits the padding slots.
    """
    w = Window.partitionBy(batch_col).orderBy(order_col)
    docs = (
        rows.withColumn("_n", F.size("input_ids"))
        .withColumn("document_id", (F.row_number().over(w) - 1).cast("bigint"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
        .filter(F.col("_start") < max_len)
        .withColumn("kept_len", F.least(F.col("_n"), F.lit(max_len) - F.col("_start")).cast("bigint"))
        .withColumn("_used", F.sum("kept_len").over(Window.partitionBy(batch_col)))
    )
    slot_t = "struct<slot:bigint,document_id:bigint,token:bigint,mask:boolean,position_id:bigint,real:boolean>"
    real = F.transform(
        F.arrays_zip(F.slice("input_ids", 1, F.col("kept_len")).alias("t"), F.slice("loss_mask", 1, F.col("kept_len")).alias("m")),
        lambda x, i: F.struct(
            (F.col("_start") + i).cast("bigint").alias("slot"), F.col("document_id").alias("document_id"), x["t"].cast("bigint").alias("token"),
            x["m"].alias("mask"), i.cast("bigint").alias("position_id"), F.lit(True).alias("real"),
        ),
    )
    is_last = (F.col("_start") + F.col("kept_len")) == F.col("_used")
    pads = F.when(
        is_last & (F.col("_used") < max_len),
        F.transform(
            F.sequence(F.col("_used"), F.lit(max_len - 1).cast("bigint")),
            lambda s: F.struct(
                s.alias("slot"), F.lit(-1).cast("bigint").alias("document_id"), F.lit(0).cast("bigint").alias("token"),
                F.lit(False).alias("mask"), F.lit(0).cast("bigint").alias("position_id"), F.lit(False).alias("real"),
            ),
        ),
    ).otherwise(F.array().cast(f"array<{slot_t}>"))
    out = docs.select(F.col(batch_col).alias("batch_id"), "sample_id", F.explode(F.concat(real, pads)).alias("_s"))
    return out.select(
        "batch_id", "_s.slot", F.when(F.col("_s.real"), F.col("sample_id")).alias("sample_id"),
        "_s.document_id", "_s.token", "_s.mask", "_s.position_id",
    )


def batch_lengths(rows: DataFrame, batch_col: str, order_col: str, max_len: int) -> DataFrame:
    """P43 lengths: kept document lengths per batch (last one truncated)."""
    w = Window.partitionBy(batch_col).orderBy(order_col)
    return (
        rows.withColumn("_n", F.size("input_ids"))
        .withColumn("document_id", (F.row_number().over(w) - 1).cast("bigint"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter(F.col("_start") < max_len)
        .select(F.col(batch_col).alias("batch_id"), "document_id", F.least(F.col("_n"), F.lit(max_len) - F.col("_start")).cast("bigint").alias("length"))
    )


def sample_anchors(slots: DataFrame, num_anchors: int, block_size: int, max_len: int, seed: int) -> DataFrame:
    """Up to ``n`` trainable slots per batch, last ``block`` slots excluded.

    The choice is the first ``n`` slots in hash order of ``(seed, batch, slot)``
    (``row_number`` per batch, bounded by ``max_len`` rows).  Missing anchors
    are ``(0, false)`` like the reference's padded output.
    """
    if block_size <= 0:
        raise ValueError(f"block_size must be positive (got {block_size})")
    if num_anchors <= 0:
        raise ValueError(f"num_anchors must be positive (got {num_anchors})")
    cand = slots.filter(F.col("mask") & (F.col("slot") < max_len - block_size))
    w = Window.partitionBy("batch_id").orderBy(seeded_key(seed, "batch_id", "slot"), "slot")
    chosen = cand.withColumn("anchor_no", F.row_number().over(w) - 1).filter(F.col("anchor_no") < num_anchors)
    chosen = chosen.select("batch_id", F.col("anchor_no").cast("int"), F.col("slot").alias("anchor"), F.lit(True).alias("anchor_valid"))
    slots_per_batch = slots.select("batch_id").distinct().select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(num_anchors - 1))).alias("anchor_no"))
    return slots_per_batch.join(chosen, ["batch_id", "anchor_no"], "left").select(
        "batch_id",
        "anchor_no",
        F.coalesce("anchor", F.lit(0)).cast("bigint").alias("anchor"),
        F.coalesce("anchor_valid", F.lit(False)).alias("anchor_valid"),
    )


def anchor_blocks(anchors: DataFrame, slots: DataFrame, block_size: int, mask_id: int) -> DataFrame:
    """P44 + P45 + P46 + J9: expand anchors to blocks and gather per position.

    ``block_input`` = the real token at offset 0, ``mask_id`` after;
    ``block_mask`` = mask at ``anchor+j`` × anchor valid, offset 0 forced off;
    ``target`` = the token at ``anchor+j`` (J9 equi join on ``(batch_id, slot)``).
    """
    blocks = anchors.select(
        "batch_id", "anchor_no", "anchor", "anchor_valid",
        F.posexplode(F.sequence(F.col("anchor"), F.col("anchor") + block_size - 1)).alias("j", "slot"),
    )
    g = slots.select("batch_id", "slot", "token", "mask")
    joined = blocks.join(g, ["batch_id", "slot"], "left")
    return joined.select(
        "batch_id",
        "anchor_no",
        "anchor",
        F.col("j").cast("int").alias("j"),
        F.when(F.col("j") == 0, F.col("token")).otherwise(F.lit(mask_id).cast("bigint")).alias("block_input"),
        (F.coalesce("mask", F.lit(False)) & F.col("anchor_valid") & (F.col("j") > 0)).alias("block_mask"),
        F.col("token").alias("target"),
    )


def prev_token_in_block(blocks: DataFrame) -> DataFrame:
    """Previous target token inside the block; offset 0 sees the anchor itself."""
    w = Window.partitionBy("batch_id", "anchor_no").orderBy("j")
    return blocks.withColumn("prev_token", F.coalesce(F.lag("target").over(w), F.col("target")))


def anchor_context(batches: DataFrame, window: int) -> DataFrame:
    """J13 (re-aimed): context size of each valid anchor of batch rows
    ``(batch_id, position_ids, anchors)`` = same-document slots before it,
    limited to ``window``: arithmetic on the anchor's position in its document —
    no theta join, no pairs."""
    a = batches.select("batch_id", "position_ids", F.explode("anchors").alias("a")).filter("a.anchor_valid")
    ctx = F.least(F.element_at("position_ids", (F.col("a.anchor") + 1).cast("int")), F.lit(window))
    return a.select("batch_id", F.col("a.anchor_no").cast("int").alias("anchor_no"), "a.anchor", ctx.cast("bigint").alias("n_context"))


def chain_context(batches: DataFrame, depths: int) -> DataFrame:
    """J14 (re-aimed): visible context of the depth-``d`` token of an anchor chain =
    depth-0 tokens of the same document up to the anchor + ``d`` chain tokens."""
    a = batches.select("batch_id", "position_ids", F.explode("anchors").alias("a")).filter("a.anchor_valid")
    a = a.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depths - 1))))
    n = F.element_at("position_ids", (F.col("a.anchor") + 1).cast("int")) + 1 + F.col("depth")
    return a.select("batch_id", F.col("a.anchor_no").cast("int").alias("anchor_no"), F.col("depth").cast("int"), n.cast("bigint").alias("n_visible"))


def causal_pair_counts(batches: DataFrame) -> DataFrame:
    """J15 (count form): visible same-document positions of each real slot of batch
    rows = ``position_id + 1``; summed per batch.  Padding excluded."""
    pairs = F.aggregate(
        F.arrays_zip("position_ids", "document_ids"), F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.when(x["document_ids"] >= 0, x["position_ids"] + 1).otherwise(0),
    )
    return batches.select("batch_id", pairs.alias("n_pairs"))


def align_targets(outputs: Column, max_len: int) -> Column:
    """Verifier outputs of a batch row rolled right by one — slot ``i`` gets the
    value of slot ``i-1``; slot 0 has none (null, never a kept target)."""
    return F.concat(F.array(F.lit(None).cast("bigint")), F.slice(outputs, 1, max_len - 1))


def multi_depth_inputs(samples: DataFrame, rows: DataFrame, mask_id: int) -> DataFrame:
    """Parallel-group inputs — the real token at depth 0, ``mask_id`` deeper.

    ``samples(sample_id, depth, anchor)`` (e.g. from COD sampling) is joined
    to the rows by id; the depth-0 token is read from the row array.
    """
    j = samples.join(rows.select("sample_id", "input_ids"), "sample_id")
    tok = F.element_at("input_ids", (F.col("anchor") + F.col("depth") + 1).cast("int"))
    return j.select("sample_id", "depth", "anchor", F.when(F.col("depth") == 0, tok).otherwise(F.lit(mask_id).cast("bigint")).alias("input_token"))


def cast_states(df: DataFrame, cols: tuple[str, ...], dtype: str = "float") -> DataFrame:
    """Cast hidden-state array columns (``array<...<dtype>>``) — bf16 is stored as float32."""
    out = df
    for c in cols:
        t = df.schema[c].dataType
        depth = 0
        while hasattr(t, "elementType"):
            depth += 1
            t = t.elementType
        out = out.withColumn(c, F.col(c).cast("array<" * depth + dtype + ">" * depth))
    return out


def request_projection(df: DataFrame, conv_col: str = "conversations") -> DataFrame:
    """Ids always; the messages only for multimodal rows."""
    from draftsmith.sources.conversations import is_multimodal

    return df.select("sample_id", "input_ids", F.when(is_multimodal(F.col(conv_col)), F.col(conv_col)).alias("messages"))


# Per-sample preprocessing selectable by name (collate pre-step).
PREPROCESS = {"shift": shift_rows, "shift_mtp": shift_rows_mtp, "none": lambda df: df}


def preprocess(rows: DataFrame, name: str) -> DataFrame:
    """Apply a named per-sample preprocessing step before collating."""
    if name not in PREPROCESS:
        raise ValueError(f"unknown preprocess {name!r}; choose from {sorted(PREPROCESS)}")
    return PREPROCESS[name](rows)


# ------------------------------------------------------------ batch-row layout
#
# A packed batch is bounded by ``max_len``, so it can be one row holding the
# collated arrays — the shape a trainer consumes.  Anchors, blocks, gathers
# (J9) and context counts are then array expressions inside that row: one
# shuffle (documents grouped by batch), no slot-level joins.


def collate_rows(rows: DataFrame, batch_col: str, order_col: str, max_len: int) -> DataFrame:
    """P43 + W1 + W9 + P42 as one row per batch:
    ``(batch_id, input_ids, loss_mask, position_ids, document_ids, lengths)``,
    each array padded to ``max_len`` (token 0, mask false, position 0,
    document -1); the document crossing ``max_len`` is truncated, later ones dropped."""
    w = Window.partitionBy(batch_col).orderBy(order_col)
    docs = (
        rows.withColumn("_n", F.size("input_ids"))
        .withColumn("_doc", (F.row_number().over(w) - 1).cast("bigint"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint"))
        .filter(F.col("_start") < max_len)
        .withColumn("_kept", F.least(F.col("_n"), F.lit(max_len) - F.col("_start")).cast("int"))
    )
    per = docs.groupBy(F.col(batch_col).alias("batch_id")).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "_doc", "_kept",
                    F.slice("input_ids", 1, F.col("_kept")).alias("ids"),
                    F.slice("loss_mask", 1, F.col("_kept")).alias("m"),
                )
            )
        ).alias("_d")
    )
    used = F.aggregate("_d", F.lit(0), lambda a, d: a + d["_kept"])
    pad = F.lit(max_len) - used

    def padded(arr, fill, dtype):
        return F.concat(arr, F.array_repeat(F.lit(fill).cast(dtype), pad))

    return per.select(
        "batch_id",
        padded(F.flatten(F.transform("_d", lambda d: d["ids"])), 0, "bigint").alias("input_ids"),
        padded(F.flatten(F.transform("_d", lambda d: d["m"])), False, "boolean").alias("loss_mask"),
        padded(F.flatten(F.transform("_d", lambda d: F.when(d["_kept"] > 0, F.sequence(F.lit(0).cast("bigint"), (d["_kept"] - 1).cast("bigint"))).otherwise(F.array().cast("array<bigint>")))), 0, "bigint").alias("position_ids"),
        padded(F.flatten(F.transform("_d", lambda d: F.array_repeat(d["_doc"], d["_kept"]))), -1, "bigint").alias("document_ids"),
        F.transform("_d", lambda d: d["_kept"].cast("bigint")).alias("lengths"),
    )


def anchors_in_row(batch_id: Column, mask: Column, num_anchors: int, block_size: int, max_len: int, seed: int) -> Column:
    """O13 in row: up to ``n`` trainable slots below ``max_len - block`` in hash
    order of ``(seed, batch, slot)``; missing anchors are ``(0, false)``.
    Returns ``array<struct<anchor_no, anchor, anchor_valid>>`` of length ``n``."""
    if block_size <= 0:
        raise ValueError(f"block_size must be positive (got {block_size})")
    if num_anchors <= 0:
        raise ValueError(f"num_anchors must be positive (got {num_anchors})")
    from draftsmith.functions.distributions import let

    last_start = max_len - block_size - 1  # a negative bound means no candidate (never a count-down range)
    # Arrays used inside lambdas are bound once per row first: a column
    # reference inside a lambda would otherwise be replaced by the expression
    # that produced it and re-evaluated for every element.
    def pick(m):
        span = F.sequence(F.lit(0).cast("bigint"), F.lit(last_start).cast("bigint")) if last_start >= 0 else F.array().cast("array<bigint>")
        cand = F.filter(span, lambda i: F.element_at(m, (i + 1).cast("int")))
        keyed = F.array_sort(F.transform(cand, lambda i: F.struct(seeded_key(seed, batch_id, i).alias("k"), i.alias("slot"))))
        return let(
            F.slice(keyed, 1, num_anchors),
            lambda chosen: F.transform(
                F.sequence(F.lit(0), F.lit(num_anchors - 1)),
                lambda j: F.struct(
                    j.alias("anchor_no"),
                    F.when(j < F.size(chosen), F.element_at(chosen, j + 1)["slot"]).otherwise(F.lit(0).cast("bigint")).alias("anchor"),
                    (j < F.size(chosen)).alias("anchor_valid"),
                ),
            ),
        )

    return let(mask, pick)


def blocks_in_row(anchors: Column, input_ids: Column, mask: Column, block_size: int, mask_id: int) -> Column:
    """P44 + P45 + P46 + J9 + W5 in row: per anchor and offset ``j``, the
    gathered token at ``anchor + j`` (``element_at``, no join), the masked-block
    input, the aligned block mask and the previous token inside the block."""
    from draftsmith.functions.distributions import let

    def build(ids, m):
        def block(a):
            tok = lambda j: F.element_at(ids, (a["anchor"] + j + 1).cast("int"))
            return F.transform(
                F.sequence(F.lit(0), F.lit(block_size - 1)),
                lambda j: F.struct(
                    a["anchor_no"].alias("anchor_no"), a["anchor"].alias("anchor"), j.alias("j"),
                    F.when(j == 0, tok(j)).otherwise(F.lit(mask_id).cast("bigint")).alias("block_input"),
                    (F.coalesce(F.element_at(m, (a["anchor"] + j + 1).cast("int")), F.lit(False)) & a["anchor_valid"] & (j > 0)).alias("block_mask"),
                    tok(j).alias("target"),
                    F.when(j == 0, tok(j)).otherwise(tok(j - 1)).alias("prev_token"),
                ),
            )

        return F.flatten(F.transform(anchors, block))

    # bind the batch arrays once per row (see anchors_in_row)
    return let(input_ids, lambda ids: let(mask, lambda m: build(ids, m)))
