"""Shared derivations for the catalog, in Spark and as DuckDB CTEs.

Every Spark derivation here has a SQL twin with the same semantics; the
catalog queries compose them.  Parameters are module constants so the two
sides cannot drift.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftsmith.functions.text import CHATML, DEFAULT_VOCAB_SIZE, py_token_ids, sql_token_ids
from draftsmith.operators.normalize import ROLE_MAP, normalize_turns
from draftsmith.operators.tokenize import prepare_rows, tokenize_turns
from draftsmith.tables import table

VOCAB = DEFAULT_VOCAB_SIZE
MAX_LEN = 8192
SEED = 42

# ---------------------------------------------------------------- Spark side


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return normalize_turns(table(spark, sf, "conversations", "conv_id", "turn", "role", "text"))


def turn_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize_turns(turns(spark, sf), CHATML, VOCAB)


def prepared(spark: SparkSession, sf: str, max_length: int = MAX_LEN, min_valid: int | None = None) -> DataFrame:
    return prepare_rows(turns(spark, sf), CHATML, max_length, VOCAB, min_valid)


def prepared_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of the prepared rows — conversations with a kept turn — from the
    turn table alone (ranking or splitting ids must not re-run the tokenizer)."""
    return turns(spark, sf).select("sample_id").distinct()


def doc_rows(spark: SparkSession, sf: str, max_length: int = MAX_LEN) -> DataFrame:
    """Documents as single-turn assistant conversations (every token trainable)."""
    docs = table(spark, sf, "documents", "doc_id", "text").select(
        F.col("doc_id").alias("sample_id"), F.lit(0).cast("bigint").alias("turn"), F.lit("assistant").alias("role"), "text"
    )
    return prepare_rows(docs, CHATML, max_length, VOCAB)


# ------------------------------------------------------------------ SQL side


def _sql_list(ids: list[int]) -> str:
    return "[" + ", ".join(str(i) for i in ids) + "]::BIGINT[]"


def _sql_case(table_: dict[str, list[int]]) -> str:
    whens = " ".join(f"WHEN '{r}' THEN {_sql_list(ids)}" for r, ids in table_.items())
    return f"CASE role {whens} ELSE []::BIGINT[] END"


SQL_PRE = _sql_case({r: py_token_ids(p, VOCAB) for r, (p, _) in CHATML.roles.items()})
SQL_SUF = _sql_case({r: py_token_ids(s, VOCAB) for r, (_, s) in CHATML.roles.items()})
SQL_ROLE = "CASE " + " ".join(f"WHEN role = '{k}' THEN '{v}'" for k, v in ROLE_MAP.items()) + " END"
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL_PREFIX_TEXT = "CASE role " + " ".join(f"WHEN '{r}' THEN {_sql_str(p)}" for r, (p, _) in CHATML.roles.items()) + " ELSE '' END"
SQL_SUFFIX_TEXT = "CASE role " + " ".join(f"WHEN '{r}' THEN {_sql_str(s)}" for r, (_, s) in CHATML.roles.items()) + " ELSE '' END"


def sql_norm(name: str = "norm") -> str:
    return f"""{name} AS (
  SELECT conv_id AS sample_id, turn, role, coalesce(nullif(text, ''), '') AS text
  FROM (SELECT conv_id, turn, {SQL_ROLE} AS role, text FROM conversations)
  WHERE role IS NOT NULL
)"""


def sql_turn_tokens(src: str = "norm", name: str = "ttok") -> str:
    body = sql_token_ids("text", VOCAB)
    return f"""{name} AS (
  SELECT sample_id, turn, role,
         list_concat(list_concat(pre, body), suf) AS ids,
         list_concat(list_concat(repeat([false], len(pre)), repeat([role = 'assistant'], len(body))),
                     repeat([false], len(suf))) AS mask
  FROM (SELECT sample_id, turn, role, {SQL_PRE} AS pre, {body} AS body, {SQL_SUF} AS suf FROM {src})
)"""


def sql_prepared(src: str = "ttok", name: str = "prepared", max_length: int = MAX_LEN) -> str:
    return f"""{name}_b AS (
  SELECT *,
         coalesce(sum(len(ids)) OVER (PARTITION BY sample_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_tok,
         sum(len(ids)) OVER (PARTITION BY sample_id) AS total_tok,
         max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id) AS has_asst
  FROM {src}
),
{name} AS (
  SELECT sample_id,
         flatten(list(ids ORDER BY turn))[1:{max_length}] AS input_ids,
         flatten(list(mask ORDER BY turn))[1:{max_length}] AS loss_mask,
         CAST(least(max(total_tok), {max_length}) AS BIGINT) AS seq_len,
         CAST(max(total_tok) AS BIGINT) AS n_tokens_full,
         max(has_asst) AS has_asst
  FROM {name}_b WHERE start_tok < {max_length}
  GROUP BY sample_id
)"""


def sql_prepared_chain(max_length: int = MAX_LEN, name: str = "prepared") -> str:
    """``WITH`` body (without the keyword) producing ``prepared``."""
    return ",\n".join([sql_norm(), sql_turn_tokens(), sql_prepared(max_length=max_length, name=name)])


def sql_doc_rows(name: str = "docrows", max_length: int = MAX_LEN) -> str:
    return ",\n".join(
        [
            "docnorm AS (SELECT doc_id AS sample_id, CAST(0 AS BIGINT) AS turn, 'assistant' AS role, text FROM documents)",
            sql_turn_tokens("docnorm", "doctok"),
            sql_prepared("doctok", name, max_length),
        ]
    )


def sql_valid(mask: str) -> str:
    return f"len(list_filter({mask}, lambda m: m))"


def ids_digest(col) -> "F.Column":
    """Scalar digest of an id array: md5 of the comma-joined ids."""
    return F.md5(F.array_join(F.transform(col, lambda x: x.cast("string")), ","))


def sql_ids_digest(expr: str) -> str:
    return f"md5(array_to_string({expr}, ','))"


def bool_digest(col) -> "F.Column":
    return F.md5(F.array_join(F.transform(col, lambda x: F.when(x, "1").otherwise("0")), ""))


def sql_bool_digest(expr: str) -> str:
    return f"md5(array_to_string(list_transform({expr}, lambda x: CASE WHEN x THEN '1' ELSE '0' END), ''))"
