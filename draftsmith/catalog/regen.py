"""Shuffle, caps, splits, resume/backfill and regeneration queries.

Stand-ins: the "existing artefacts" of a backfill are the prepared rows whose
id appears in ``labels`` (a real table that covers some of the ids); the replies
to a user turn are the assistant turn that follows it in ``conversations``, with
regex token counts as usage (a user turn without one fails).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import MAX_LEN, SEED, VOCAB, prepared, prepared_ids, sql_prepared_chain, turns
from draftsmith.functions.text import CHATML, TOKEN_PATTERN, sanitize_name
from draftsmith.operators.normalize import extract_prompt_turns
from draftsmith.operators.ranking import id_rank, seeded_rank, seeded_split, split_cut, union_shuffle_cap
from draftsmith.operators.regen import regenerate, run_summary
from draftsmith.operators.tokenize import prepare_rows
from draftsmith.operators.resume import (
    assign_chunks,
    attach_artefacts,
    backfill_plan,
    existing_per_chunk,
    missing_ids,
    validate_artefacts,
)
from draftsmith.tables import table

G = "regen"
CAP = 60
WORLD = 3
SPLIT = 0.8


def _sql_key(expr: str) -> str:
    return f"md5('{SEED}' || ':' || CAST({expr} AS VARCHAR))"


@register("shuffle_cap", f"""WITH ids AS (SELECT DISTINCT conv_id AS sample_id FROM conversations),
r AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY {_sql_key('sample_id')}, sample_id) - 1 AS BIGINT) AS shuffle_rank FROM ids)
SELECT sample_id, shuffle_rank, CAST(shuffle_rank < {CAP} AS INTEGER) AS kept FROM r""", G)
def shuffle_cap_q(spark, sf):
    ids = table(spark, sf, "conversations", "conv_id").select(F.col("conv_id").alias("sample_id")).distinct()
    r = seeded_rank(ids, SEED, "sample_id", "shuffle_rank")
    return r.select("sample_id", "shuffle_rank", (F.col("shuffle_rank") < CAP).cast("int").alias("kept"))


@register("union_shuffle_cap", f"""WITH a AS (SELECT DISTINCT 'conv_' || CAST(conv_id AS VARCHAR) AS source_id FROM conversations),
b AS (SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS source_id FROM documents),
ac AS (SELECT source_id FROM a QUALIFY row_number() OVER (ORDER BY {_sql_key('source_id')}, source_id) <= {3 * CAP}),
bc AS (SELECT source_id FROM b QUALIFY row_number() OVER (ORDER BY {_sql_key('source_id')}, source_id) <= {3 * CAP}),
u AS (SELECT * FROM ac UNION ALL SELECT * FROM bc)
SELECT source_id, CAST(row_number() OVER (ORDER BY {_sql_key('source_id')}, source_id) - 1 AS BIGINT) AS shuffle_rank
FROM u QUALIFY shuffle_rank < {CAP}""", G)
def union_shuffle_cap_q(spark, sf):
    a = table(spark, sf, "conversations", "conv_id").select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("source_id")).distinct()
    b = table(spark, sf, "documents", "doc_id").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("source_id"))
    u = union_shuffle_cap([a, b], SEED, "source_id", CAP, CAP)
    return seeded_rank(u, SEED, "source_id", "shuffle_rank")


@register("train_val_split", f"""WITH {sql_prepared_chain()},
r AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS BIGINT) AS idx FROM prepared),
n AS (SELECT count(*) AS n FROM prepared)
SELECT sample_id, idx, CASE WHEN idx < CAST(floor(n * {SPLIT}) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM r, n""", G)
def train_val_split(spark, sf):
    rows = prepared_ids(spark, sf)
    n = rows.count()
    ranked = id_rank(rows, "sample_id", "idx")
    lo, hi = split_cut(n, SPLIT)
    return ranked.select("sample_id", "idx", F.when((F.col("idx") >= lo) & (F.col("idx") < hi), "train").otherwise("val").alias("split"))


@register("shuffled_split", f"""WITH {sql_prepared_chain()},
r AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY {_sql_key('sample_id')}, sample_id) - 1 AS BIGINT) AS shuffle_rank FROM prepared),
n AS (SELECT count(*) AS n FROM prepared)
SELECT sample_id, shuffle_rank, CASE WHEN shuffle_rank < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM r, n""", G)
def shuffled_split(spark, sf):
    rows = prepared_ids(spark, sf)
    return seeded_split(rows, SEED, "sample_id", rows.count(), 0.9, "shuffle_rank")


def _existing(spark, sf):
    rows = prepared_ids(spark, sf)
    return rows.join(table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("sample_id")).distinct(), "sample_id", "left_semi")


_SQL_EXISTING = "existing AS (SELECT sample_id FROM prepared WHERE sample_id IN (SELECT doc_id FROM labels))"


def _sql_chunks(world: int) -> str:
    return f"""idx AS (SELECT sample_id, CAST(row_number() OVER (ORDER BY sample_id) - 1 AS BIGINT) AS idx FROM prepared),
tgt AS (SELECT count(*) AS n, count(*) // {world} AS c, count(*) % {world} AS r FROM prepared),
chunks AS (
  SELECT sample_id, idx, CAST(CASE WHEN idx < r * (c + 1) THEN idx // (c + 1)
                              ELSE r + (idx - r * (c + 1)) // greatest(c, 1) END AS INTEGER) AS owner
  FROM idx, tgt
)"""


@register("rank_chunks", f"""WITH {sql_prepared_chain()},
{_SQL_EXISTING},
{_sql_chunks(WORLD)}
SELECT sample_id, idx, owner FROM chunks WHERE sample_id NOT IN (SELECT sample_id FROM existing)""", G)
def rank_chunks(spark, sf):
    ids = prepared_ids(spark, sf)
    return backfill_plan(ids, _existing(spark, sf), WORLD).select("sample_id", "idx", "owner")


@register("resume_anti_join", f"""WITH {sql_prepared_chain()},
{_SQL_EXISTING}
SELECT sample_id, seq_len FROM prepared WHERE sample_id NOT IN (SELECT sample_id FROM existing)""", G)
def resume_anti_join(spark, sf):
    # the ids are taken out before any turn is tokenised
    todo = missing_ids(turns(spark, sf), table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("sample_id")))
    return prepare_rows(todo, CHATML, MAX_LEN, VOCAB).select("sample_id", F.col("seq_len").cast("bigint"))


@register("existing_semi_count", f"""WITH {sql_prepared_chain()},
{_SQL_EXISTING},
{_sql_chunks(WORLD)}
SELECT owner, CAST(count(e.sample_id) AS BIGINT) AS n_existing, CAST(count(*) AS BIGINT) AS n_total
FROM chunks c LEFT JOIN existing e USING (sample_id) GROUP BY owner""", G)
def existing_semi_count(spark, sf):
    chunks = assign_chunks(prepared_ids(spark, sf), WORLD)
    return existing_per_chunk(chunks, _existing(spark, sf))


@register("artefact_left_join_policy", f"""WITH {sql_prepared_chain()},
{_SQL_EXISTING}
SELECT p.sample_id, CASE WHEN e.sample_id IS NULL THEN 'generate' ELSE 'present' END AS status
FROM prepared p LEFT JOIN existing e USING (sample_id)""", G)
def artefact_left_join_policy(spark, sf):
    rows = prepared_ids(spark, sf)
    return attach_artefacts(rows, _existing(spark, sf).select("sample_id"), "generate").select("sample_id", "status")


def _artefacts(spark, sf):
    """Stand-in artefact payloads derived from the rows and ``labels``:
    low-quality rows lost their last token id, toxic rows carry a NaN state."""
    rows = prepared(spark, sf)
    lab = table(spark, sf, "labels", "doc_id", "quality", "toxic").withColumnRenamed("doc_id", "sample_id")
    j = rows.join(lab, "sample_id")
    ids = F.when(F.col("quality") == 1, F.col("input_ids")).otherwise(F.slice("input_ids", 1, F.greatest(F.size("input_ids") - 1, F.lit(0))))
    hs = F.transform(
        "input_ids",
        lambda x, i: F.array(F.when((F.col("toxic") == 1) & (i == 0), F.lit(float("nan"))).otherwise(x.cast("float") / 1000.0).cast("float")),
    )
    return j.select("sample_id", ids.alias("token_ids"), hs.alias("hidden_states"))


@register("artefact_validation", f"""WITH {sql_prepared_chain()},
a AS (SELECT p.sample_id, l.quality, l.toxic FROM prepared p JOIN labels l ON l.doc_id = p.sample_id)
SELECT sample_id, CAST(reason IS NULL AS INTEGER) AS ok, reason FROM (
  SELECT sample_id, CASE WHEN quality <> 1 THEN 'token ids differ'
                         WHEN toxic = 1 THEN 'nan in hidden states' END AS reason FROM a)""", G)
def artefact_validation(spark, sf):
    v = validate_artefacts(prepared(spark, sf), _artefacts(spark, sf))
    return v.select("sample_id", F.col("ok").cast("int").alias("ok"), "reason")


# ------------------------------------------------------------------ regeneration

_SQL_PROMPTS = """pt AS (
  SELECT conv_id AS sample_id, turn, CASE WHEN role = 'system' THEN 'system' ELSE 'user' END AS role, text
  FROM conversations WHERE role IN ('system', 'user', 'human') AND text IS NOT NULL AND text <> ''
),
prompts AS (SELECT * FROM pt WHERE sample_id IN (SELECT sample_id FROM pt WHERE role = 'user'))"""

_SQL_REGEN = f"""{_SQL_PROMPTS},
rep AS (SELECT conv_id AS sample_id, turn - 1 AS turn, text AS reply FROM conversations WHERE role IN ('assistant', 'gpt')),
steps AS (
  SELECT p.*, r.reply, p.role = 'user' AND coalesce(r.reply, '') = '' AS fails,
         len(regexp_extract_all(p.text, '{TOKEN_PATTERN}')) AS n_in, len(regexp_extract_all(r.reply, '{TOKEN_PATTERN}')) AS n_out
  FROM prompts p LEFT JOIN rep r ON p.role = 'user' AND r.sample_id = p.sample_id AND r.turn = p.turn
),
firstfail AS (SELECT sample_id, min(turn) AS fail_turn FROM steps WHERE fails GROUP BY sample_id),
st AS (SELECT s.*, f.fail_turn FROM steps s LEFT JOIN firstfail f USING (sample_id) WHERE f.fail_turn IS NULL OR s.turn <= f.fail_turn)"""


@register("extract_prompts", f"""WITH {_SQL_PROMPTS}
SELECT sample_id, CAST(count(*) AS BIGINT) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS n_chars,
       CAST(sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) AS BIGINT) AS n_system
FROM prompts GROUP BY sample_id""", G)
def extract_prompts(spark, sf):
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "sample_id")
    p = extract_prompt_turns(raw)
    return p.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
        F.sum((F.col("role") == "system").cast("bigint")).alias("n_system"),
    )


def replies(spark, sf):
    """The reply table: the assistant turn after each user turn."""
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").filter(F.col("role").isin("assistant", "gpt"))
    n = F.size(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).cast("bigint")
    return raw.select(F.col("conv_id").alias("sample_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"), F.lit("stop").alias("finish_reason"), n.alias("completion_tokens"))


def answered(spark, sf):
    """X6 over the test tables: prompt turns to replies, with the usage of both."""
    r = replies(spark, sf)

    def answer(prompts):
        n = F.size(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), F.lit(0))).cast("bigint")
        asked = prompts.filter(F.col("role") == "user").select("sample_id", "turn", n.alias("prompt_tokens"))
        return r.join(asked, ["sample_id", "turn"]).withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))

    return answer


def _regen(spark, sf):
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").withColumnRenamed("conv_id", "sample_id")
    prompts = extract_prompt_turns(raw)
    return regenerate(prompts, answered(spark, sf)(prompts))


@register("regen_assemble", f"""WITH {_SQL_REGEN},
okc AS (SELECT * FROM st WHERE fail_turn IS NULL),
outt AS (
  SELECT sample_id, 2 * turn AS place, CASE WHEN role = 'system' THEN 'system' ELSE 'human' END AS "from", text AS value FROM okc
  UNION ALL
  SELECT sample_id, 2 * turn + 1, 'gpt', reply FROM okc WHERE role = 'user'
)
SELECT sample_id, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY place) - 1 AS BIGINT) AS pos, "from",
       CAST(length(value) AS BIGINT) AS n_chars, md5(value) AS digest
FROM outt""", G)
def regen_assemble(spark, sf):
    ok = _regen(spark, sf).filter(F.col("status") == "ok")
    t = ok.select("sample_id", F.posexplode("conversations").alias("pos", "t"))
    return t.select(
        "sample_id", F.col("pos").cast("bigint").alias("pos"), F.col("t.from").alias("from"),
        F.length("t.value").cast("bigint").alias("n_chars"), F.md5("t.value").alias("digest"),
    )


@register("regen_error_split", f"""WITH {_SQL_REGEN}
SELECT sample_id, CASE WHEN max(fail_turn) IS NULL THEN 'ok' ELSE 'error' END AS status,
       CAST(sum(CASE WHEN role = 'system' OR fails THEN 1 ELSE 2 END) AS BIGINT) AS n_out_turns,
       CASE WHEN max(fail_turn) IS NOT NULL THEN 'empty reply at turn ' || CAST(max(fail_turn) AS VARCHAR) END AS error
FROM st GROUP BY sample_id""", G)
def regen_error_split(spark, sf):
    r = _regen(spark, sf)
    return r.select("sample_id", "status", F.size("conversations").cast("bigint").alias("n_out_turns"), "error")


@register("usage_totals", f"""WITH {_SQL_REGEN}
SELECT sample_id, CAST(coalesce(sum(n_in) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(n_out), 0) AS BIGINT) AS completion_tokens,
       CAST(coalesce(sum(n_in + n_out) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS total_tokens
FROM st WHERE fail_turn IS NULL GROUP BY sample_id""", G)
def usage_totals(spark, sf):
    r = _regen(spark, sf).filter(F.col("status") == "ok")
    return r.select("sample_id", "prompt_tokens", "completion_tokens", "total_tokens")


@register("run_summary", f"""WITH {_SQL_REGEN},
per AS (SELECT sample_id, CASE WHEN max(fail_turn) IS NULL THEN 'ok' ELSE 'error' END AS status FROM st GROUP BY sample_id)
SELECT status, CAST(count(*) AS BIGINT) AS n FROM per GROUP BY status""", G)
def run_summary_q(spark, sf):
    return run_summary(_regen(spark, sf))


@register("sanitize_names", """SELECT page_id,
  regexp_replace(regexp_replace(url, '[/\\\\:*?"<>| ]', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS safe_name
FROM pages""", G)
def sanitize_names(spark, sf):
    return table(spark, sf, "pages", "page_id", "url").select("page_id", sanitize_name(F.col("url")).alias("safe_name"))


RESUME_LIMIT = 20


@register("regen_resume", f"""WITH {_SQL_REGEN},
per AS (SELECT sample_id, max(fail_turn) IS NULL AS ok, row_number() OVER (ORDER BY sample_id) AS rk FROM st GROUP BY sample_id),
runs AS (
  SELECT sample_id, ok, 1 AS run FROM per WHERE rk <= {RESUME_LIMIT}
  UNION ALL SELECT sample_id, ok, 2 FROM per WHERE rk > {RESUME_LIMIT} OR NOT ok)
SELECT CASE WHEN sample_id % 2 = 1 THEN 'u-' ELSE 'sample_' END || sample_id AS id, run, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status
FROM runs""", G)
def regen_resume(spark, sf):
    """Two runs of the Regen job into one output, the first
    limited; the second asks again for what is missing or failed only."""
    from draftsmith.plans.regenerate import regenerate_dataset
    from draftsmith.sources.conversations import turn_struct
    from draftsmith.streaming.jobs import scratch

    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    key = F.concat(F.when(F.col("conv_id") % 2 == 1, "u-").otherwise("sample_"), F.col("conv_id").cast("string"))
    conv = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: turn_struct(t["role"], t["text"]))
    chats = raw.groupBy(F.col("conv_id").alias("idx")).agg(conv.alias("conversations"))
    chats = chats.withColumn("uuid", F.when(F.col("idx") % 2 == 1, F.concat(F.lit("u-"), F.col("idx").cast("string")))).withColumn("prompt", F.lit(None).cast("string"))
    said = raw.filter(F.col("role") == "assistant").select(key.alias("sample_id"), (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    out = scratch(spark, "regen-resume")
    runs = [regenerate_dataset(spark, chats, lambda prompts: said, out, limit=n) for n in (RESUME_LIMIT, None)]
    return runs[0].select("id", F.lit(1).alias("run"), "status").unionAll(runs[1].select("id", F.lit(2).alias("run"), "status"))

