"""Vocabulary queries: frequencies, draft top-k, maps, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import VOCAB, doc_rows, prepared, sql_doc_rows, sql_prepared_chain
from draftsmith.operators.vocab import (
    combine_frequencies,
    draft_to_target,
    prune_to_draft,
    select_draft_tokens,
    token_frequency,
    vocab_maps,
)

G = "vocab"
K_SMALL = 1024  # fewer than the distinct trainable ids: top-k path
K_FILL = 16384  # more than the distinct trainable ids at small scale: fill path

_SQL_FREQ = """freq AS (
  SELECT t.id AS token_id, CAST(count(*) AS BIGINT) AS freq
  FROM (SELECT UNNEST(input_ids) AS id, UNNEST(loss_mask) AS m FROM prepared) t
  WHERE t.m GROUP BY t.id
)"""

_SQL_DOC_FREQ = """docfreq AS (
  SELECT t.id AS token_id, CAST(count(*) AS BIGINT) AS freq
  FROM (SELECT UNNEST(input_ids) AS id, UNNEST(loss_mask) AS m FROM docrows) t
  WHERE t.m GROUP BY t.id
)"""


def _sql_select(k: int, src: str = "freq") -> str:
    return f"""top AS (SELECT token_id, freq FROM {src} ORDER BY freq DESC, token_id LIMIT {k}),
fill AS (SELECT range AS token_id FROM range({k}) WHERE range NOT IN (SELECT token_id FROM top)),
sel AS (
  SELECT token_id FROM (
    SELECT token_id, 0 AS prio, freq AS f FROM top
    UNION ALL SELECT token_id, 1 AS prio, NULL AS f FROM fill)
  ORDER BY prio, f DESC NULLS LAST, token_id LIMIT {k}
),
d2t AS (
  SELECT CAST(row_number() OVER (ORDER BY token_id) - 1 AS BIGINT) AS draft_id, CAST(token_id AS BIGINT) AS target_id FROM sel
)"""


@register("token_frequency", f"WITH {sql_prepared_chain()},\n{_SQL_FREQ}\nSELECT token_id, freq FROM freq", G)
def token_frequency_q(spark, sf):
    return token_frequency(prepared(spark, sf))


@register("combine_frequency", f"""WITH {sql_prepared_chain()},
{sql_doc_rows()},
{_SQL_FREQ},
{_SQL_DOC_FREQ}
SELECT token_id, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT * FROM freq UNION ALL SELECT * FROM docfreq) GROUP BY token_id""", G)
def combine_frequency_q(spark, sf):
    return combine_frequencies(token_frequency(prepared(spark, sf)), token_frequency(doc_rows(spark, sf)))


@register("draft_vocab_topk", f"""WITH {sql_prepared_chain()},
{_SQL_FREQ},
{_sql_select(K_SMALL)}
SELECT d.draft_id, d.target_id, d.target_id - d.draft_id AS offset, CAST(coalesce(f.freq, 0) AS BIGINT) AS freq
FROM d2t d LEFT JOIN freq f ON f.token_id = d.target_id""", G)
def draft_vocab_topk(spark, sf):
    freq = token_frequency(prepared(spark, sf))
    d2t, _ = vocab_maps(select_draft_tokens(spark, freq, K_SMALL), VOCAB, spark)
    return d2t.join(freq.withColumnRenamed("token_id", "target_id"), "target_id", "left").select(
        "draft_id", "target_id", "offset", F.coalesce("freq", F.lit(0)).cast("bigint").alias("freq")
    )


@register("vocab_offsets", f"""WITH {sql_prepared_chain()},
{_SQL_FREQ},
{_sql_select(K_FILL)}
SELECT draft_id, target_id, target_id - draft_id AS offset FROM d2t""", G)
def vocab_offsets(spark, sf):
    freq = token_frequency(prepared(spark, sf))
    d2t, _ = vocab_maps(select_draft_tokens(spark, freq, K_FILL), VOCAB, spark)
    return d2t


@register("target_to_draft", f"""WITH {sql_prepared_chain()},
{_SQL_FREQ},
{_sql_select(K_SMALL)}
SELECT CAST(r.range // 4096 AS BIGINT) AS block, CAST(count(d.target_id) AS BIGINT) AS n_in_draft, CAST(count(*) AS BIGINT) AS n_ids
FROM range({VOCAB}) r LEFT JOIN d2t d ON d.target_id = r.range GROUP BY 1""", G)
def target_to_draft(spark, sf):
    freq = token_frequency(prepared(spark, sf))
    _, t2d = vocab_maps(select_draft_tokens(spark, freq, K_SMALL), VOCAB, spark)
    return t2d.groupBy(F.floor(F.col("target_id") / 4096).cast("bigint").alias("block")).agg(
        F.sum(F.col("in_draft").cast("bigint")).alias("n_in_draft"), F.count(F.lit(1)).alias("n_ids")
    )


@register("vocab_coverage", f"""WITH {sql_prepared_chain()},
{_SQL_FREQ},
{_sql_select(K_SMALL)},
toks AS (SELECT sample_id, UNNEST(input_ids) AS id, UNNEST(loss_mask) AS m FROM prepared)
SELECT t.sample_id, CAST(count(*) AS BIGINT) AS n_valid, CAST(count(d.target_id) AS BIGINT) AS n_in_draft
FROM toks t LEFT JOIN d2t d ON d.target_id = t.id WHERE t.m GROUP BY t.sample_id""", G)
def vocab_coverage(spark, sf):
    rows = prepared(spark, sf)
    freq = token_frequency(rows)
    _, t2d = vocab_maps(select_draft_tokens(spark, freq, K_SMALL), VOCAB, spark)
    toks = rows.select("sample_id", F.explode(F.arrays_zip("input_ids", "loss_mask")).alias("t")).filter("t.loss_mask")
    toks = toks.select("sample_id", F.col("t.input_ids").alias("token_id"))
    inside = prune_to_draft(toks, t2d).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_in_draft"))
    return (
        toks.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_valid"))
        .join(inside, "sample_id", "left")
        .select("sample_id", "n_valid", F.coalesce("n_in_draft", F.lit(0)).cast("bigint").alias("n_in_draft"))
    )


@register("oov_prune_semi", f"""WITH {sql_prepared_chain()},
{_SQL_FREQ},
{_sql_select(K_SMALL)}
SELECT token_id, freq FROM freq WHERE token_id IN (SELECT target_id FROM d2t)""", G)
def oov_prune_semi(spark, sf):
    freq = token_frequency(prepared(spark, sf))
    _, t2d = vocab_maps(select_draft_tokens(spark, freq, K_SMALL), VOCAB, spark)
    return prune_to_draft(freq, t2d)


@register("draft_target_lookup", f"""WITH {sql_prepared_chain()},
{_SQL_FREQ},
{_sql_select(K_SMALL)},
picks AS (SELECT sample_id, ((sample_id * 7 + seq_len) % {K_SMALL}) AS draft_id FROM prepared)
SELECT p.sample_id, CAST(p.draft_id AS BIGINT) AS draft_id, CAST(p.draft_id + (d.target_id - d.draft_id) AS BIGINT) AS target_id
FROM picks p JOIN d2t d ON d.draft_id = p.draft_id""", G)
def draft_target_lookup(spark, sf):
    """J6 over draft predictions derived from each row (``(7*id + seq_len) mod k``)."""
    rows = prepared(spark, sf)
    d2t, _ = vocab_maps(select_draft_tokens(spark, token_frequency(rows), K_SMALL), VOCAB, spark)
    picks = rows.select("sample_id", F.pmod(F.col("sample_id") * 7 + F.col("seq_len"), F.lit(K_SMALL)).cast("bigint").alias("draft_id"))
    return draft_to_target(picks, d2t).select("sample_id", "draft_id", F.col("target_id").cast("bigint").alias("target_id"))
