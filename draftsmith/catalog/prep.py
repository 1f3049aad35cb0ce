"""Prep queries: normalise → render → tokenize → mask → rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import (
    SEED,
    SQL_PREFIX_TEXT,
    SQL_ROLE,
    SQL_SUFFIX_TEXT,
    bool_digest,
    ids_digest,
    prepared,
    sql_bool_digest,
    sql_ids_digest,
    sql_norm,
    sql_prepared_chain,
    sql_valid,
    turns,
)
from draftsmith.functions.hashing import sql_seeded_key
from draftsmith.functions.text import CHATML, PIECE_PATTERN
from draftsmith.operators.normalize import drop_empty_conversations, normalize_turns, with_extras
from draftsmith.operators.tokenize import (
    mask_rows,
    render_text,
    token_array,
    rendered_spans,
    token_offsets,
    trainable_runs,
    valid_tokens,
)
from draftsmith.tables import table

G = "prep"


@register("normalize_conversations", f"""WITH {sql_norm()}
SELECT sample_id, turn, role, CAST(length(text) AS BIGINT) AS n_chars FROM norm""", G)
def normalize_conversations(spark, sf):
    return turns(spark, sf).select("sample_id", "turn", "role", F.length("text").cast("bigint").alias("n_chars"))


@register("turn_dropout", f"""WITH raw AS (SELECT conv_id AS sample_id, turn, {SQL_ROLE} AS role FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY turn) - 1 AS raw_idx,
             count(*) OVER (PARTITION BY sample_id) AS n_raw FROM raw),
k AS (SELECT *, ({sql_seeded_key(SEED, 'sample_id')} % n_raw) + 1 AS keep_n FROM r),
c AS (SELECT *, min(CASE WHEN role = 'assistant' AND raw_idx >= keep_n - 1 THEN raw_idx END)
                OVER (PARTITION BY sample_id) AS cut FROM k)
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_kept, CAST(max(turn) AS BIGINT) AS last_turn
FROM c WHERE role IS NOT NULL AND (cut IS NULL OR raw_idx <= cut) GROUP BY sample_id""", G)
def turn_dropout(spark, sf):
    t = normalize_turns(table(spark, sf, "conversations", "conv_id", "turn", "role", "text"), turn_dropout=True, seed=SEED)
    return t.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_kept"), F.max("turn").cast("bigint").alias("last_turn")
    )


@register("drop_empty_conversations", f"""WITH {sql_norm()}
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_turns FROM norm GROUP BY sample_id""", G)
def drop_empty(spark, sf):
    return drop_empty_conversations(turns(spark, sf)).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_turns"))


_SQL_RENDER = f"""{sql_norm()},
rendered AS (
  SELECT sample_id, string_agg({SQL_PREFIX_TEXT} || text || {SQL_SUFFIX_TEXT}, '' ORDER BY turn) AS text
  FROM norm GROUP BY sample_id
)"""


@register("render_template", f"""WITH {_SQL_RENDER}
SELECT sample_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM rendered""", G)
def render_template(spark, sf):
    r = render_text(turns(spark, sf), CHATML)
    return r.select("sample_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _sql_offsets(src: str, id_col: str, text_col: str, name: str) -> str:
    return f"""{name}_p AS (
  SELECT {id_col} AS id, UNNEST(pieces) AS piece, UNNEST(generate_series(1, len(pieces))) AS i
  FROM (SELECT {id_col}, regexp_extract_all(coalesce({text_col}, ''), '{PIECE_PATTERN}') AS pieces FROM {src})
),
{name} AS (
  SELECT id, piece AS token, CAST(start_c AS BIGINT) AS start_c, CAST(start_c + length(piece) AS BIGINT) AS end_c,
         CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS BIGINT) AS pos
  FROM (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY id ORDER BY i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_c FROM {name}_p)
  WHERE NOT regexp_full_match(piece, '[ \\t\\r\\n]+')
)"""


@register("tokenize_offsets", f"""WITH {_sql_offsets('documents', 'doc_id', 'text', 'tok')}
SELECT id AS doc_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(start_c) AS BIGINT) AS sum_start,
       CAST(max(end_c) AS BIGINT) AS max_end, CAST(sum(pos * length(token)) AS BIGINT) AS pos_weight
FROM tok GROUP BY id""", G)
def tokenize_offsets(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    t = token_offsets(docs, "doc_id", "text")
    return t.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.sum("start").cast("bigint").alias("sum_start"),
        F.max("end").cast("bigint").alias("max_end"),
        F.sum(F.col("pos") * F.length("token")).cast("bigint").alias("pos_weight"),
    )


@register("loss_mask", f"""WITH {_SQL_RENDER},
{_sql_offsets('rendered', 'sample_id', 'text', 'tok')},
spans AS (
  SELECT sample_id, span_start, span_start + length(text) AS span_end FROM (
    SELECT sample_id, role, text,
           coalesce(sum(length({SQL_PREFIX_TEXT}) + length(text) + length({SQL_SUFFIX_TEXT}))
                    OVER (PARTITION BY sample_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + length({SQL_PREFIX_TEXT}) AS span_start
    FROM norm) WHERE role = 'assistant'
),
marked AS (
  SELECT t.id, t.pos, max(CASE WHEN s.sample_id IS NOT NULL THEN 1 ELSE 0 END) AS tr
  FROM tok t LEFT JOIN spans s ON s.sample_id = t.id AND t.end_c > s.span_start AND t.start_c < s.span_end
  GROUP BY t.id, t.pos
)
SELECT id AS sample_id, CAST(count(*) AS BIGINT) AS n_tokens, CAST(sum(tr) AS BIGINT) AS n_trainable
FROM marked GROUP BY id""", G)
def loss_mask(spark, sf):
    """J12 on the rendered text: token offsets in row, spans by construction
    (running rendered lengths), joined per row and tested in row."""
    t = turns(spark, sf)
    rows = render_text(t, CHATML).select("sample_id", token_array(F.col("text")).alias("tokens"))
    m = mask_rows(rows, rendered_spans(t, CHATML), "sample_id")
    return m.select(
        "sample_id", F.size("tokens").cast("bigint").alias("n_tokens"), valid_tokens(F.col("mask")).cast("bigint").alias("n_trainable")
    )


def _rows_summary(rows):
    return rows.select(
        "sample_id",
        F.col("seq_len").cast("bigint").alias("seq_len"),
        valid_tokens(F.col("loss_mask")).cast("bigint").alias("n_valid"),
        ids_digest(F.col("input_ids")).alias("ids_digest"),
        bool_digest(F.col("loss_mask")).alias("mask_digest"),
    )


def _sql_rows_summary(src: str, where: str = "") -> str:
    return f"""SELECT sample_id, seq_len, CAST({sql_valid('loss_mask')} AS BIGINT) AS n_valid,
       {sql_ids_digest('input_ids')} AS ids_digest, {sql_bool_digest('loss_mask')} AS mask_digest
FROM {src} {where}"""


@register("prepare_rows", f"WITH {sql_prepared_chain()}\n{_sql_rows_summary('prepared')}", G)
def prepare_rows_q(spark, sf):
    return _rows_summary(prepared(spark, sf))


@register("prepare_rows_regex", f"WITH {sql_prepared_chain()}\n{_sql_rows_summary('prepared')}", G)
def prepare_rows_regex(spark, sf):
    """P15/P17 regex path (pattern of the template) — must equal the construction path."""
    from draftsmith.operators.tokenize import prepare_rows_by_pattern

    return _rows_summary(prepare_rows_by_pattern(turns(spark, sf), CHATML.assistant_pattern()))


@register("min_valid_tokens", f"WITH {sql_prepared_chain()}\n{_sql_rows_summary('prepared', 'WHERE ' + sql_valid('loss_mask') + ' >= 200')}", G)
def min_valid_tokens_q(spark, sf):
    return _rows_summary(prepared(spark, sf, min_valid=200))


@register("truncate_tokens", f"""WITH {sql_prepared_chain(max_length=256)}
SELECT sample_id, seq_len, CAST({sql_valid('loss_mask')} AS BIGINT) AS n_valid,
       {sql_ids_digest('input_ids')} AS ids_digest, {sql_bool_digest('loss_mask')} AS mask_digest,
       CAST(n_tokens_full > 256 AS INTEGER) AS truncated,
       CAST(has_asst = 1 AND {sql_valid('loss_mask')} = 0 AS INTEGER) AS span_cut
FROM prepared""", G)
def truncate_tokens(spark, sf):
    rows = prepared(spark, sf, max_length=256)
    return _rows_summary(rows).join(
        rows.select(
            "sample_id",
            F.col("truncated").cast("int").alias("truncated"),
            (F.col("has_assistant") & (valid_tokens(F.col("loss_mask")) == 0)).cast("int").alias("span_cut"),
        ),
        "sample_id",
    )


@register("trainable_runs", f"""WITH {sql_prepared_chain()},
m AS (SELECT sample_id, UNNEST(loss_mask) AS m, UNNEST(generate_series(0, len(loss_mask) - 1)) AS pos FROM prepared),
f AS (SELECT *, CASE WHEN lag(m) OVER w IS NULL OR lag(m) OVER w <> m THEN 1 ELSE 0 END AS nw
      FROM m WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
g AS (SELECT *, sum(nw) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS run_no FROM f)
SELECT sample_id, CAST(run_no AS BIGINT) AS run_no, CAST(max(CAST(m AS INTEGER)) AS INTEGER) AS trainable,
       CAST(min(pos) AS BIGINT) AS run_start, CAST(count(*) AS BIGINT) AS run_len
FROM g GROUP BY sample_id, run_no""", G)
def trainable_runs_q(spark, sf):
    r = trainable_runs(prepared(spark, sf))
    return r.select("sample_id", F.col("run_no").cast("bigint").alias("run_no"), F.col("trainable").cast("int").alias("trainable"), "run_start", "run_len")




_SQL_EXTRAS = f"""{sql_norm()},
ext AS (
  SELECT sample_id, turn, role,
    CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '<think>' || chr(10) || 'turn ' || turn || chr(10) || '</think>' || chr(10) || chr(10) ELSE '' END || text ||
    CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN chr(10) || '<tool_call>' || chr(10) || '{{"name": "look", "arguments": {{"turn": ' || turn || '}}}}' || chr(10) || '</tool_call>' ELSE '' END AS text
  FROM norm
  UNION ALL
  SELECT DISTINCT sample_id, -1, 'system', '# Tools' || chr(10) || chr(10) || '<tools>' || chr(10) || '[{{"name": "f' || sample_id || '"}}]' || chr(10) || '</tools>'
  FROM norm WHERE sample_id % 2 = 0
)"""


@register("render_tools", f"""WITH {_SQL_EXTRAS},
rendered AS (SELECT sample_id, string_agg({SQL_PREFIX_TEXT} || text || {SQL_SUFFIX_TEXT}, '' ORDER BY turn) AS text FROM ext GROUP BY sample_id)
SELECT sample_id, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS digest FROM rendered""", G)
def render_tools(spark, sf):
    """Thoughts, tool calls and a tools preamble in the rendered text."""
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    call = F.struct(F.lit("c").alias("id"), F.lit("function").alias("type"),
                    F.struct(F.lit("look").alias("name"), F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")).alias("arguments")).alias("function"))
    raw = raw.withColumn("thinking", F.when(F.col("turn") % 4 == 1, F.concat(F.lit("turn "), F.col("turn").cast("string"))))
    raw = raw.withColumn("tool_calls", F.when(F.col("turn") % 3 == 1, F.array(call)))
    ids = raw.select(F.col("conv_id").alias("sample_id")).distinct()
    tools = ids.select("sample_id", F.when(F.col("sample_id") % 2 == 0, F.concat(F.lit('[{"name": "f'), F.col("sample_id").cast("string"), F.lit('"}]'))).otherwise("[broken").alias("tools"))
    r = render_text(with_extras(normalize_turns(raw), tools), CHATML)
    return r.select("sample_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))
