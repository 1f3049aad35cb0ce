"""Rendered layouts and rows of a model vocabulary."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import ids_digest
from draftsmith.functions.text import HFTokenizer
from draftsmith.operators.templates import HEADERS, LAYOUTS, prepare_by_model
from draftsmith.tables import table

G = "templates"
MAX_LEN = 512
NL = "chr(10) || chr(10)"

_SQL_LAYOUTS = f"""t AS (
  SELECT conv_id AS sample_id, turn, role, coalesce(text, '') AS text, lag(role) OVER w AS previous, lag(turn) OVER w IS NULL AS first, lead(turn) OVER w IS NULL AS last
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (
  SELECT 'headers' AS layout, t.*, CASE WHEN first THEN '<|begin_of_text|>' ELSE '' END || '<|start_header_id|>' || role || '<|end_header_id|>' || {NL} AS before, '<|eot_id|>' AS after FROM t
  UNION ALL
  SELECT 'instruct', t.*, CASE WHEN first THEN '<s>' ELSE '' END || CASE WHEN role = 'system' THEN '[INST] <<SYS>>' || chr(10) WHEN role = 'assistant' THEN ' ' WHEN previous = 'system' THEN '' ELSE '[INST] ' END,
         CASE WHEN role = 'system' THEN chr(10) || '<</SYS>>' || {NL} WHEN role = 'user' THEN ' [/INST]' WHEN last THEN ' </s>' ELSE ' </s><s>' END FROM t
  UNION ALL
  SELECT 'spoken', t.*, CASE role WHEN 'user' THEN 'USER: ' WHEN 'assistant' THEN 'ASSISTANT: ' ELSE '' END, CASE WHEN role = 'assistant' THEN '</s>' ELSE ' ' END FROM t),
s AS (SELECT *, coalesce(sum(length(before || text || after)) OVER (PARTITION BY layout, sample_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(before) AS start FROM p)"""


def _chats(spark, sf):
    return table(spark, sf, "conversations", "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "sample_id")


@register("render_layouts", f"""WITH {_SQL_LAYOUTS}
SELECT layout, sample_id, md5(string_agg(before || text || after, '' ORDER BY turn)) AS digest, CAST(count(*) FILTER (WHERE role = 'assistant') AS BIGINT) AS n_spans,
       CAST(coalesce(sum(start) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS span_starts, CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS n_trainable
FROM s GROUP BY layout, sample_id""", G)
def render_layouts(spark, sf):
    """Three layouts, whose markers depend on the turn's place."""
    out = None
    total = lambda f: F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + f(s))
    for t in LAYOUTS.values():
        one = t.render(_chats(spark, sf)).select(
            F.lit(t.name).alias("layout"), "sample_id", F.md5("text").alias("digest"), F.size("spans").cast("bigint").alias("n_spans"),
            total(lambda s: s["span_start"]).alias("span_starts"), total(lambda s: s["span_end"] - s["span_start"]).alias("n_trainable"),
        )
        out = one if out is None else out.unionByName(one)
    return out


@register("model_rows", None, G)
def model_rows(spark, sf):
    """Rows by a public byte-level vocabulary (BPE is not expressible
    in SQL; tests hold a plain version by the vocabulary's own library)."""
    path = os.path.join(os.environ.get("DRAFTSMITH_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
    rows = prepare_by_model(_chats(spark, sf), HEADERS, HFTokenizer.from_file(path), MAX_LEN)
    return rows.select(
        "sample_id", "seq_len", ids_digest(F.col("input_ids")).alias("digest"),
        F.size(F.filter("loss_mask", lambda m: m)).cast("bigint").alias("n_valid"), F.col("error").isNotNull().alias("failed"),
    )
