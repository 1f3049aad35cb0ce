"""Queries over bucketed stores, attempt ledgers and generators."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import SEED, ids_digest, prepared, sql_ids_digest, sql_prepared_chain, sql_valid
from draftsmith.catalog.regen import _SQL_EXISTING, _artefacts
from draftsmith.catalog.sampling import COD_DEPTHS, COD_MIN, COD_RATIO, _sql_cod
from draftsmith.operators.bucketed import append, missing_by_bloom, open_store
from draftsmith.operators.examples import shift_rows, shift_rows_mtp
from draftsmith.operators.resume import artefact_generator, attach_artefacts, missing_ids, validate_artefacts
from draftsmith.operators.retries import ask_until_done
from draftsmith.operators.sampling import cod_sample
from draftsmith.sources.artefacts import ARTEFACT_SCHEMA, PREPARED_SCHEMA
from draftsmith.streaming.jobs import scratch
from draftsmith.tables import table

G = "stores"
BUCKETS = 8


@register("bucketed_backfill", f"""WITH {sql_prepared_chain()},
a AS (SELECT p.sample_id, l.quality, l.toxic FROM prepared p JOIN labels l ON l.doc_id = p.sample_id)
SELECT p.sample_id, CASE WHEN a.sample_id IS NULL THEN 'generate' ELSE 'present' END AS status, CAST(a.sample_id IS NULL AS INTEGER) AS missing,
       CASE WHEN quality <> 1 THEN 'token ids differ' WHEN toxic = 1 THEN 'nan in hidden states' END AS reason
FROM prepared p LEFT JOIN a USING (sample_id)""", G)
def bucketed_backfill(spark, sf):
    """J2 J4 J5 on stores bucketed alike: no payload is exchanged for the joins."""
    base, run = scratch(spark, "buckets"), uuid.uuid4().hex[:12]
    names = {"rows": f"rows_{run}", "made": f"made_{run}"}
    for name, schema, df in (("rows", PREPARED_SCHEMA, prepared(spark, sf)), ("made", ARTEFACT_SCHEMA, _artefacts(spark, sf))):
        open_store(spark, names[name], f"{base}/{name}", schema, "sample_id", BUCKETS)
        append(df, names[name], "sample_id", BUCKETS)
    rows, made = (spark.table(t) for t in names.values())
    missing = missing_ids(rows, made).select("sample_id", F.lit(1).alias("missing"))
    out = attach_artefacts(rows, made, "generate").select("sample_id", "status").join(missing, "sample_id", "left")
    out = out.join(validate_artefacts(rows, made).select("sample_id", "reason"), "sample_id", "left")
    return out.select("sample_id", "status", F.coalesce("missing", F.lit(0)).alias("missing"), "reason")


@register("bloom_anti_join", f"""WITH {sql_prepared_chain()},
{_SQL_EXISTING}
SELECT sample_id, {sql_ids_digest('input_ids')} AS digest FROM prepared WHERE sample_id NOT IN (SELECT sample_id FROM existing)""", G)
def bloom_anti_join(spark, sf):
    """Rows that the filter lets through meet the existing ids, the others do not."""
    rows = prepared(spark, sf).select("sample_id", "input_ids")
    have = table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("sample_id"))
    return missing_by_bloom(rows, have).select("sample_id", ids_digest(F.col("input_ids")).alias("digest"))


@register("retry_attempts", """WITH r AS (
  SELECT conv_id AS sample_id, turn, (conv_id + turn) % 6 AS kind FROM conversations WHERE role = 'user'),
n AS (SELECT *, CASE kind WHEN 5 THEN 1 WHEN 4 THEN 4 ELSE kind + 1 END AS n FROM r),
a AS (SELECT *, unnest(generate_series(1, n)) AS attempt FROM n)
SELECT sample_id, turn, CAST(attempt AS INTEGER) AS attempt, CAST(pow(2, attempt) - 2 AS DOUBLE) AS at,
       CASE WHEN attempt < n OR kind = 4 AND attempt < 4 THEN 'transient' WHEN kind = 5 THEN 'permanent' WHEN kind = 4 THEN 'exhausted' ELSE 'ok' END AS outcome,
       CASE WHEN attempt < n THEN CAST(pow(2, attempt + 1) - 2 AS DOUBLE) END AS due
FROM a""", G)
def retry_attempts(spark, sf):
    """User turns are requests; by (conversation + turn) mod 6 one is answered
    after 0 to 3 failures, never, or with an invalid reply.  Time is simulated."""
    asked = table(spark, sf, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'")
    asked = asked.select(F.col("conv_id").alias("sample_id"), "turn", "text")
    now = [0.0]

    def answer(due):
        kind = F.pmod(F.col("sample_id") + F.col("turn"), F.lit(6))
        error = F.when(kind == 5, "invalid").when((kind == 4) | (F.col("attempt") <= kind), "timeout")
        return due.select("sample_id", "turn", F.when(error.isNull(), F.col("text")).alias("reply"), error.alias("error"))

    def sleep(s):
        now[0] += s

    done = ask_until_done(asked, answer, f"{scratch(spark, 'retries')}/ledger", "error = 'invalid'", clock=lambda: now[0], sleep=sleep)
    return done.select("sample_id", "turn", "attempt", "at", "outcome", "due")


@register("generated_artefacts", f"""WITH {sql_prepared_chain()},
{_SQL_EXISTING}
SELECT sample_id, {sql_ids_digest('input_ids')} AS digest, CAST(len(input_ids) AS BIGINT) AS n_states, CAST(list_sum(input_ids) AS DOUBLE) AS state_sum
FROM prepared WHERE sample_id NOT IN (SELECT sample_id FROM existing)""", G)
def generated_artefacts(spark, sf):
    """A callable over pandas frames as the generator of missing artefacts; its
    stand-in state of a token is the token's id."""

    def states(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sample_id": rows["sample_id"], "token_ids": rows["input_ids"], "hidden_states": [[[float(i)] for i in ids] for ids in rows["input_ids"]]})

    have = table(spark, sf, "labels", "doc_id").select(F.col("doc_id").alias("sample_id"))
    made = artefact_generator(states)(missing_ids(prepared(spark, sf), have))
    total = F.aggregate("hidden_states", F.lit(0.0), lambda a, v: a + v[0].cast("double"))
    return made.select("sample_id", ids_digest(F.col("token_ids")).alias("digest"), F.size("hidden_states").cast("bigint").alias("n_states"), total.alias("state_sum"))


@register("cod_sampling_by_joins", _sql_cod(), G)
def cod_sampling_by_joins(spark, sf):
    """The long form, a join a depth; the same rows as ``cod_sampling``."""
    s = cod_sample(prepared(spark, sf), COD_DEPTHS, COD_RATIO, COD_MIN, seed=SEED)
    return s.groupBy("sample_id", F.col("depth").cast("int").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"), *[f("anchor").cast("bigint").alias(f"{f.__name__}_anchor") for f in (F.sum, F.min, F.max)]
    )


@register("mtp_renamed", f"""WITH {sql_prepared_chain()}
SELECT sample_id, {sql_ids_digest('input_ids[2:]')} AS digest, CAST({sql_valid('loss_mask[2:]')} AS BIGINT) AS n_valid,
       CAST(greatest(len(input_ids) - 1, 0) AS BIGINT) AS n_states
FROM prepared""", G)
def mtp_renamed(spark, sf):
    """The shift for several steps, whose states go by another name."""
    rows = prepared(spark, sf).withColumn("verifier_last_hidden_states", F.transform("input_ids", lambda i: F.array(i.cast("double"))))
    out = shift_rows_mtp(shift_rows(rows, state_cols=("verifier_last_hidden_states",)))
    return out.select(
        "sample_id", ids_digest(F.col("input_ids")).alias("digest"),
        F.size(F.filter("loss_mask", lambda m: m)).cast("bigint").alias("n_valid"), F.size("hidden_states").cast("bigint").alias("n_states"),
    )
