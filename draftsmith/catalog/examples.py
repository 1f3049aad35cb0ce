"""Training-example queries.

Fixture: batches are consecutive groups of ``BATCH`` prepared rows in the
seeded shuffle order (what a sampler does), collated into ``MAX_SLOTS``
slots.  Logits / hidden-state stand-ins come from ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import SEED, VOCAB, bool_digest, ids_digest, prepared, prepared_ids, sql_bool_digest, sql_ids_digest, sql_prepared_chain
from draftsmith.functions.hashing import sql_md5_int
from draftsmith.operators.examples import (
    align_targets,
    anchor_context,
    batch_lengths,
    causal_pair_counts,
    chain_context,
    collate_rows,
    mtp_step_targets,
    offpolicy_targets,
    shift_rows,
    slice_pad,
    split_layers,
    step_alignment,
    uniform_noise,
)
from draftsmith.operators.ranking import seeded_rank
from draftsmith.tables import table

G = "examples"
BATCH = 4
MAX_SLOTS = 4096
N_ANCHORS = 8
BLOCK = 4
MASK_ID = VOCAB
CTX_WINDOW = 64
DEPTHS = 3


def _batched(spark, sf):
    """Prepared rows with their seeded rank; the rank is computed on the id
    table and joined (rows are already partitioned by id)."""
    ranks = seeded_rank(prepared_ids(spark, sf), SEED, "sample_id", "rk")
    r = prepared(spark, sf).join(ranks, "sample_id")
    return r.withColumn("batch_id", F.floor(F.col("rk") / BATCH).cast("bigint"))


def _batch_rows(spark, sf):
    from draftsmith.operators.examples import anchors_in_row, collate_rows

    b = collate_rows(_batched(spark, sf), "batch_id", "rk", MAX_SLOTS)
    return b.withColumn("anchors", anchors_in_row(F.col("batch_id"), F.col("loss_mask"), N_ANCHORS, BLOCK, MAX_SLOTS, SEED))


def _blocks(spark, sf):
    from draftsmith.operators.examples import blocks_in_row

    b = _batch_rows(spark, sf)
    return b.select("batch_id", F.explode(blocks_in_row(F.col("anchors"), F.col("input_ids"), F.col("loss_mask"), BLOCK, MASK_ID)).alias("b")).select("batch_id", "b.*")


_SQL_BATCHED = f"""ranked AS (
  SELECT p.*, CAST(row_number() OVER (ORDER BY md5('{SEED}' || ':' || CAST(sample_id AS VARCHAR)), sample_id) - 1 AS BIGINT) AS rk
  FROM prepared p
),
docs AS (
  SELECT *, rk // {BATCH} AS batch_id,
         CAST(row_number() OVER (PARTITION BY rk // {BATCH} ORDER BY rk) - 1 AS BIGINT) AS document_id,
         CAST(coalesce(sum(len(input_ids)) OVER (PARTITION BY rk // {BATCH} ORDER BY rk
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_s
  FROM ranked
),
kept AS (SELECT *, CAST(least(len(input_ids), {MAX_SLOTS} - start_s) AS BIGINT) AS kept_len FROM docs WHERE start_s < {MAX_SLOTS}),
realx AS (SELECT batch_id, sample_id, document_id, start_s, input_ids, loss_mask, UNNEST(range(kept_len)) AS i FROM kept),
slots AS (
  SELECT batch_id, CAST(start_s + i AS BIGINT) AS slot, sample_id, document_id, input_ids[i + 1] AS token,
         loss_mask[i + 1] AS mask, CAST(i AS BIGINT) AS position_id FROM realx
  UNION ALL
  SELECT batch_id, CAST(UNNEST(range(used, {MAX_SLOTS})) AS BIGINT) AS slot, NULL, -1, 0, false, 0
  FROM (SELECT batch_id, CAST(sum(kept_len) AS BIGINT) AS used FROM kept GROUP BY batch_id) WHERE used < {MAX_SLOTS}
)"""

_SQL_ANCHORS = f"""cand AS (
  SELECT batch_id, slot, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY
         {sql_md5_int(f"'{SEED}' || ':' || CAST(batch_id AS VARCHAR) || ':' || CAST(slot AS VARCHAR)")}, slot) - 1 AS INTEGER) AS anchor_no
  FROM slots WHERE mask AND slot < {MAX_SLOTS - BLOCK}
),
nums AS (SELECT batch_id, CAST(UNNEST(range({N_ANCHORS})) AS INTEGER) AS anchor_no FROM (SELECT DISTINCT batch_id FROM slots)),
anchors AS (
  SELECT n.batch_id, n.anchor_no, CAST(coalesce(c.slot, 0) AS BIGINT) AS anchor, c.slot IS NOT NULL AS anchor_valid
  FROM nums n LEFT JOIN cand c ON c.batch_id = n.batch_id AND c.anchor_no = n.anchor_no
)"""


def _sql_rows_digest(expr_ids: str, expr_mask: str) -> str:
    return f"{sql_ids_digest(expr_ids)} AS ids_digest, {sql_bool_digest(expr_mask)} AS mask_digest"


@register("shift_examples", f"""WITH {sql_prepared_chain()}
SELECT sample_id, CAST(greatest(len(input_ids) - 1, 0) AS INTEGER) AS lengths,
       {_sql_rows_digest('input_ids[2:]', 'loss_mask[2:]')},
       {sql_ids_digest('range(1, len(input_ids))')} AS pos_digest
FROM prepared""", G)
def shift_examples(spark, sf):
    s = shift_rows(prepared(spark, sf))
    return s.select(
        "sample_id", F.col("lengths").cast("int"), ids_digest(F.col("input_ids")).alias("ids_digest"),
        bool_digest(F.col("loss_mask")).alias("mask_digest"), ids_digest(F.col("position_ids")).alias("pos_digest"),
    )


@register("mtp_targets", f"""WITH {sql_prepared_chain()},
st AS (SELECT sample_id, input_ids, loss_mask, least(3, greatest(len(input_ids) - 2, 0)) AS steps,
              len(input_ids) - least(3, greatest(len(input_ids) - 2, 0)) - 1 AS valid_len FROM prepared),
ex AS (SELECT *, UNNEST(range(steps)) AS step FROM st WHERE steps > 0)
SELECT sample_id, CAST(step AS INTEGER) AS step, CAST(valid_len AS INTEGER) AS valid_len,
       {sql_ids_digest('input_ids[step + 2 : step + 1 + valid_len]')} AS inputs_digest,
       {sql_ids_digest("list_transform(list_zip(input_ids[step + 3 : step + 2 + valid_len], loss_mask[step + 3 : step + 2 + valid_len]), lambda z: CASE WHEN z[2] THEN z[1] ELSE -100 END)")} AS targets_digest
FROM ex""", G)
def mtp_targets(spark, sf):
    t = mtp_step_targets(prepared(spark, sf), 3)
    return t.select(
        "sample_id", F.col("step").cast("int"), F.col("valid_len").cast("int"),
        ids_digest(F.col("step_inputs")).alias("inputs_digest"), ids_digest(F.col("step_targets")).alias("targets_digest"),
    )


@register("offpolicy_shift", f"""WITH {sql_prepared_chain()},
ex AS (SELECT sample_id, input_ids, UNNEST(range(3)) AS step FROM prepared)
SELECT sample_id, CAST(step AS INTEGER) AS step,
       {sql_ids_digest('list_concat(input_ids[step + 2 : len(input_ids)], repeat([0::BIGINT], CAST(least(step + 1, len(input_ids)) AS BIGINT)))')} AS targets_digest
FROM ex""", G)
def offpolicy_shift(spark, sf):
    t = offpolicy_targets(prepared(spark, sf), 3)
    return t.select("sample_id", F.col("step").cast("int"), ids_digest(F.col("targets")).alias("targets_digest"))


@register("step_alignment", f"""WITH {sql_prepared_chain()},
pr AS (SELECT sample_id, input_ids, loss_mask, list_concat(input_ids[2:], [0::BIGINT]) AS pred FROM prepared),
ex AS (SELECT *, UNNEST(range(3)) AS step FROM pr),
z AS (SELECT sample_id, step, list_zip(pred[1 : greatest(len(input_ids) - step, 0)],
             input_ids[step + 1 : len(input_ids)], loss_mask[step + 1 : len(input_ids)]) AS zz FROM ex)
SELECT sample_id, CAST(step AS INTEGER) AS step,
       CAST(len(list_filter(zz, lambda x: x[3] AND x[1] = x[2])) AS BIGINT) AS correct,
       CAST(len(list_filter(zz, lambda x: x[3])) AS BIGINT) AS total
FROM z""", G)
def step_alignment_q(spark, sf):
    rows = prepared(spark, sf).withColumn("pred", F.concat(F.slice("input_ids", 2, F.size("input_ids")), F.array(F.lit(0).cast("bigint"))))
    return step_alignment(rows, "pred", 3).select("sample_id", F.col("step").cast("int"), "correct", "total")


@register("collate_document_ids", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED}
SELECT batch_id, CAST(count(DISTINCT document_id) FILTER (WHERE document_id >= 0) AS BIGINT) AS n_docs,
       CAST(count(*) FILTER (WHERE document_id < 0) AS BIGINT) AS n_pad,
       md5(string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY slot)) AS docids_digest,
       md5(string_agg(CAST(position_id AS VARCHAR), ',' ORDER BY slot)) AS pos_digest,
       md5(string_agg(CAST(token AS VARCHAR), ',' ORDER BY slot)) AS token_digest
FROM slots GROUP BY batch_id""", G)
def collate_document_ids(spark, sf):
    b = collate_rows(_batched(spark, sf), "batch_id", "rk", MAX_SLOTS)
    j = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return b.select(
        "batch_id",
        F.size("lengths").cast("bigint").alias("n_docs"),
        F.size(F.filter("document_ids", lambda d: d < 0)).cast("bigint").alias("n_pad"),
        j(F.col("document_ids")).alias("docids_digest"), j(F.col("position_ids")).alias("pos_digest"), j(F.col("input_ids")).alias("token_digest"),
    )


@register("collate_lengths", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED}
SELECT batch_id, document_id, CAST(kept_len AS BIGINT) AS length FROM kept""", G)
def collate_lengths(spark, sf):
    return batch_lengths(_batched(spark, sf), "batch_id", "rk", MAX_SLOTS)


@register("pad_to_length", f"""WITH {sql_prepared_chain()}
SELECT sample_id,
  {sql_ids_digest('list_concat(input_ids, repeat([0::BIGINT], 512))[1:512]')} AS ids_digest,
  {sql_bool_digest('list_concat(loss_mask, repeat([false], 512))[1:512]')} AS mask_digest
FROM prepared""", G)
def pad_to_length(spark, sf):
    r = prepared(spark, sf)
    return r.select(
        "sample_id",
        ids_digest(slice_pad(F.col("input_ids"), 512, F.lit(0).cast("bigint"))).alias("ids_digest"),
        bool_digest(slice_pad(F.col("loss_mask"), 512, F.lit(False))).alias("mask_digest"),
    )


@register("anchor_sampling", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED},
{_SQL_ANCHORS}
SELECT batch_id, anchor_no, anchor, CAST(anchor_valid AS INTEGER) AS anchor_valid FROM anchors""", G)
def anchor_sampling(spark, sf):
    a = _batch_rows(spark, sf).select("batch_id", F.explode("anchors").alias("a"))
    return a.select("batch_id", F.col("a.anchor_no").cast("int").alias("anchor_no"), "a.anchor", F.col("a.anchor_valid").cast("int").alias("anchor_valid"))


_SQL_BLOCKS = f"""blocks AS (
  SELECT a.batch_id, a.anchor_no, a.anchor, a.anchor_valid, CAST(j AS INTEGER) AS j FROM anchors a, (SELECT UNNEST(range({BLOCK})) AS j)
),
gathered AS (
  SELECT b.*, s.token, s.mask FROM blocks b LEFT JOIN slots s ON s.batch_id = b.batch_id AND s.slot = b.anchor + b.j
)"""


@register("anchor_blocks", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED},
{_SQL_ANCHORS},
{_SQL_BLOCKS}
SELECT batch_id, anchor_no, j, CAST(CASE WHEN j = 0 THEN token ELSE {MASK_ID} END AS BIGINT) AS block_input,
       CAST(coalesce(mask, false) AND anchor_valid AND j > 0 AS INTEGER) AS block_mask, token AS target
FROM gathered""", G)
def anchor_blocks_q(spark, sf):
    b = _blocks(spark, sf)
    return b.select("batch_id", F.col("anchor_no").cast("int"), F.col("j").cast("int"), "block_input", F.col("block_mask").cast("int"), "target")


@register("prev_token_in_block", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED},
{_SQL_ANCHORS},
{_SQL_BLOCKS}
SELECT batch_id, anchor_no, j, coalesce(lag(token) OVER (PARTITION BY batch_id, anchor_no ORDER BY j), token) AS prev_token
FROM gathered""", G)
def prev_token_in_block_q(spark, sf):
    b = _blocks(spark, sf)
    return b.select("batch_id", F.col("anchor_no").cast("int"), F.col("j").cast("int"), "prev_token")


@register("anchor_prefix_context", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED},
{_SQL_ANCHORS},
adoc AS (SELECT a.batch_id, a.anchor_no, a.anchor, s.document_id FROM anchors a JOIN slots s
         ON s.batch_id = a.batch_id AND s.slot = a.anchor WHERE a.anchor_valid)
SELECT a.batch_id, a.anchor_no, a.anchor, CAST(count(s.slot) AS BIGINT) AS n_context
FROM adoc a LEFT JOIN slots s ON s.batch_id = a.batch_id AND s.document_id = a.document_id
     AND s.slot < a.anchor AND s.slot >= a.anchor - {CTX_WINDOW}
GROUP BY a.batch_id, a.anchor_no, a.anchor""", G)
def anchor_prefix_context(spark, sf):
    return anchor_context(_batch_rows(spark, sf), CTX_WINDOW)


@register("chain_context_count", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED},
{_SQL_ANCHORS},
adoc AS (SELECT a.batch_id, a.anchor_no, a.anchor, s.document_id FROM anchors a JOIN slots s
         ON s.batch_id = a.batch_id AND s.slot = a.anchor WHERE a.anchor_valid),
d AS (SELECT *, CAST(UNNEST(range({DEPTHS})) AS INTEGER) AS depth FROM adoc)
SELECT d.batch_id, d.anchor_no, d.depth, CAST(count(s.slot) + d.depth AS BIGINT) AS n_visible
FROM d LEFT JOIN slots s ON s.batch_id = d.batch_id AND s.document_id = d.document_id AND s.slot <= d.anchor
GROUP BY d.batch_id, d.anchor_no, d.depth""", G)
def chain_context_count(spark, sf):
    return chain_context(_batch_rows(spark, sf), DEPTHS)


@register("causal_pairs", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED}
SELECT a.batch_id, CAST(count(*) AS BIGINT) AS n_pairs
FROM slots a JOIN slots b ON a.batch_id = b.batch_id AND a.document_id = b.document_id AND b.slot <= a.slot
WHERE a.document_id >= 0 GROUP BY a.batch_id""", G)
def causal_pairs(spark, sf):
    return causal_pair_counts(collate_rows(_batched(spark, sf), "batch_id", "rk", MAX_SLOTS))


@register("noise_columns", f"""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) + 2.0 *
         ({sql_md5_int(f"'{SEED}' || ':' || CAST(vec_id AS VARCHAR) || ':' || CAST(i - 1 AS VARCHAR)")} / 4294967296.0 - 0.5) * 0.05)), 6) AS noised_sum
FROM embeddings""", G)
def noise_columns(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    noised = uniform_noise(F.col("embedding").cast("array<double>"), SEED, F.col("vec_id"), 0.05)
    return e.select("vec_id", F.round(F.aggregate(noised, F.lit(0.0), lambda a, x: a + x), 6).alias("noised_sum"))


@register("v1_layout", """SELECT vec_id, len(embedding[1:48]) AS body_len,
  round(list_sum(list_transform(embedding[1:48], lambda x: CAST(x AS DOUBLE))), 6) AS body_sum,
  round(list_sum(list_transform(embedding[49:64], lambda x: CAST(x AS DOUBLE))), 6) AS last_sum
FROM embeddings""", G)
def v1_layout(spark, sf):
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    body, last = split_layers(F.col("embedding").cast("array<double>"), 4, 16)
    s = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return e.select("vec_id", F.size(body).cast("bigint").alias("body_len"), s(body).alias("body_sum"), s(last).alias("last_sum"))


@register("target_alignment", f"""WITH {sql_prepared_chain()},
{_SQL_BATCHED},
al AS (SELECT s.batch_id, s.slot, p.token AS aligned FROM slots s LEFT JOIN slots p ON p.batch_id = s.batch_id AND p.slot = s.slot - 1)
SELECT batch_id, md5(string_agg(CAST(coalesce(aligned, -1) AS VARCHAR), ',' ORDER BY slot)) AS aligned_digest,
       CAST(count(aligned) AS BIGINT) AS n_aligned
FROM al GROUP BY batch_id""", G)
def target_alignment(spark, sf):
    b = collate_rows(_batched(spark, sf), "batch_id", "rk", MAX_SLOTS)
    aligned = align_targets(F.col("input_ids"), MAX_SLOTS)
    return b.select(
        "batch_id",
        F.md5(F.array_join(F.transform(aligned, lambda x: F.coalesce(x, F.lit(-1)).cast("string")), ",")).alias("aligned_digest"),
        F.size(F.filter(aligned, lambda x: x.isNotNull())).cast("bigint").alias("n_aligned"),
    )


def _sql_multi_depth() -> str:
    from draftsmith.catalog.sampling import _sql_cod

    return _sql_cod(f"""SELECT a.sample_id, CAST(a.depth AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS n,
       CAST(sum(CASE WHEN a.depth = 0 THEN p.input_ids[a.anchor + a.depth + 1] ELSE {MASK_ID} END) AS BIGINT) AS token_sum
FROM allx a JOIN prepared p ON p.sample_id = a.sample_id GROUP BY a.sample_id, a.depth""")


@register("multi_depth_inputs", _sql_multi_depth(), G)
def multi_depth_inputs_q(spark, sf):
    """P48 over COD-sampled anchors: real tokens at depth 0, the mask id deeper."""
    from draftsmith.operators.examples import multi_depth_inputs
    from draftsmith.operators.sampling import cod_sample_rows

    rows = prepared(spark, sf)
    s = cod_sample_rows(rows, 4, 0.7, 0.2, seed=SEED)
    m = multi_depth_inputs(s, rows, MASK_ID)
    return m.groupBy("sample_id", F.col("depth").cast("int").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("input_token").cast("bigint").alias("token_sum")
    )
