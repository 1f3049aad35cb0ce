"""Conversation normalisation.

Conversations are handled in **long form** ``(sample_id, turn, role, text)``:
one row per turn.  Row-wise rules (role map, content coalescing) are plain
projections; the per-conversation rules (turn dropout, emptiness) are window
or aggregate expressions partitioned by the conversation id, so the only
shuffle is on that id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftsmith.functions.hashing import seeded_key

# Accepted raw role names and their normalised role.
ROLE_MAP = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "system": "system",
    "tool": "tool",
}


def map_role(raw_role: Column) -> Column:
    """P1 role map; unknown roles give null (the turn is dropped)."""
    expr = None
    for raw, norm in ROLE_MAP.items():
        expr = F.when(raw_role == raw, F.lit(norm)) if expr is None else expr.when(raw_role == raw, F.lit(norm))
    return expr


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _nonempty(c: Column) -> Column:
    return F.when(c.isNull() | (c.cast("string") == ""), F.lit(None)).otherwise(c)


def normalize_turns(
    turns: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    text_col: str = "text",
    turn_dropout: bool = False,
    seed: int = 0,
) -> DataFrame:
    """P1 + P2 + P3 on long-form turns.

    Input columns: ``id_col, turn_col`` and any of ``from, role`` /
    ``value, content, text`` / ``tool_calls, tool_call_id, thinking,
    reasoning_content``.  Output: ``sample_id, turn, role, text`` plus the
    optional fields that exist in the input.

    Role: ``from`` wins over ``role`` where it is given, an empty one too.  Content: first non-empty of
    ``value``, ``content``, ``text``, else ``''``.  Unknown roles are dropped
    but still count as raw turns for dropout.

    Turn dropout keeps turns up to the first assistant turn whose raw index
    is ``>= N-1`` with ``N`` in ``[1, n_raw]`` drawn from ``md5(seed:id)``;
    when there is none, all turns are kept.
    """
    raw_role = F.coalesce(_opt(turns, "from"), _opt(turns, "role"), F.lit(""))
    content = F.coalesce(
        _nonempty(_opt(turns, "value")),
        _nonempty(_opt(turns, "content")),
        _nonempty(_opt(turns, text_col)) if text_col not in ("value", "content") else F.lit(None),
        F.lit(""),
    )
    cols = [
        F.col(id_col).alias("sample_id"),
        F.col(turn_col).alias("turn"),
        map_role(raw_role).alias("role"),
        content.cast("string").alias("text"),
    ]
    if "tool_calls" in turns.columns:
        cols.append(F.when(F.size("tool_calls") > 0, F.col("tool_calls")).alias("tool_calls"))
    if "tool_call_id" in turns.columns:
        cols.append(_nonempty(F.col("tool_call_id")).alias("tool_call_id"))
    if "thinking" in turns.columns or "reasoning_content" in turns.columns:
        thinking = F.coalesce(_nonempty(_opt(turns, "thinking")), _nonempty(_opt(turns, "reasoning_content")))
        cols += [thinking.alias("thinking"), thinking.alias("reasoning_content")]
    out = turns.select(*cols)

    if not turn_dropout:
        return out.filter(F.col("role").isNotNull())

    # One aggregate over (id, turn, role) and one join on the id (no window over a
    # whole conversation, texts are not aggregated): AQE's skew-join splitting keeps
    # a conversation with a huge number of turns off a single task.  The raw index
    # of a turn is its ``turn`` number (0-based, as in the long form).
    per = out.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("_n_raw"), F.collect_list(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_asst")
    )
    keep_n = F.pmod(seeded_key(seed, "sample_id"), F.col("_n_raw")) + 1
    per = per.withColumn("_keep_n", keep_n).select(
        F.col("sample_id").alias("_sid"), F.array_min(F.filter("_asst", lambda t: t >= F.col("_keep_n") - 1)).alias("_cut")
    )
    j = out.join(per, F.col("sample_id").eqNullSafe(F.col("_sid")))
    return j.filter(F.col("role").isNotNull() & (F.col("_cut").isNull() | (F.col("turn") <= F.col("_cut")))).drop("_sid", "_cut")


# The marks around thoughts, tool calls and the tools preamble.
THINK = ("<think>\n", "\n</think>\n\n")
CALL = ("\n<tool_call>\n", "\n</tool_call>")
TOOLS = ("# Tools\n\n<tools>\n", "\n</tools>")


def with_extras(turns: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """P13 for normalised turns with more than text: an assistant turn's thought
    goes before its text and its tool calls after it; ``tools(sample_id, tools)``
    (one JSON text per conversation that parses, P11) become a system turn
    before the first one.  Rendering then needs ``text`` alone.
    """
    from draftsmith.sources.conversations import parse_tools

    mine = F.col("role") == "assistant"
    thought = _opt(turns, "thinking")
    text = F.concat(F.when(mine & thought.isNotNull(), F.concat(F.lit(THINK[0]), thought, F.lit(THINK[1]))).otherwise(F.lit("")), F.col("text"))
    if "tool_calls" in turns.columns:
        def call(c: Column) -> Column:
            args = F.coalesce(_nonempty(c["function"]["arguments"]), F.lit("{}"))
            return F.concat(F.lit(CALL[0] + '{"name": "'), c["function"]["name"], F.lit('", "arguments": '), args, F.lit("}" + CALL[1]))

        calls = F.array_join(F.transform("tool_calls", call), "")
        text = F.concat(text, F.when(mine, F.coalesce(calls, F.lit(""))).otherwise(F.lit("")))
    out = turns.withColumn("text", text)
    if tools is None:
        return out
    ok = tools.filter(parse_tools(F.col("tools")).isNotNull())
    first = ok.select("sample_id", F.lit(-1).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("system").alias("role"),
                      F.concat(F.lit(TOOLS[0]), F.trim("tools"), F.lit(TOOLS[1])).alias("text"))
    return out.unionByName(first, allowMissingColumns=True)


def drop_empty_conversations(turns: DataFrame) -> DataFrame:
    """P12 on long form: conversations without a kept turn have no rows, so what
    is left to drop are turns whose role did not map; turns with empty text stay."""
    return turns.filter(F.col("role").isNotNull())


def conversations_to_long(df: DataFrame, id_col: str, conv_col: str = "conversations") -> DataFrame:
    """Array form ``(id, conversations: array<struct>)`` → long form.

    Null or empty arrays produce no rows (P12).
    """
    return df.select(F.col(id_col), F.posexplode(conv_col).alias("turn", "_t")).select(
        id_col, "turn", "_t.*"
    )


def normalize_array(conv: Column) -> Column:
    """P1 + P2 on an ``array<struct<from|role, value|content>>`` column, in row.

    Uses higher-order functions (no explode, no shuffle).  Struct fields that
    do not exist must be added by the caller (``from``/``role`` etc. as null).
    """
    mapped = F.transform(
        conv,
        lambda t: F.struct(
            map_role(F.coalesce(t["from"], t["role"], F.lit(""))).alias("role"),
            F.coalesce(_nonempty(t["value"]), _nonempty(t["content"]), F.lit("")).alias("content"),
        ),
    )
    return F.filter(mapped, lambda t: t["role"].isNotNull())


def extract_prompt_turns(turns: DataFrame, prompts: DataFrame | None = None, prompt_col: str = "prompt") -> DataFrame:
    """Keep system and user turns with content; assistant turns go.

    Role is read as ``role`` then ``from`` and content as ``content|text``
    then ``value`` (the opposite order of :func:`normalize_turns`).  A
    conversation without any user turn falls back to one user turn holding
    ``prompt_col`` from ``prompts(sample_id, prompt)``; none → no rows.
    """
    raw_role = F.coalesce(_nonempty(_opt(turns, "role")), _opt(turns, "from"))
    content = F.coalesce(_nonempty(_opt(turns, "content")), _nonempty(_opt(turns, "text")), _nonempty(_opt(turns, "value")))
    role = F.when(raw_role == "system", "system").when(raw_role.isin("user", "human"), "user")
    kept = turns.select(
        F.col("sample_id"), F.col("turn"), role.alias("role"), content.alias("text")
    ).filter(F.col("role").isNotNull() & F.col("text").isNotNull())
    with_user = kept.filter(F.col("role") == "user").select("sample_id").distinct()
    good = kept.join(with_user, "sample_id", "left_semi")
    if prompts is None:
        return good
    fallback = (
        prompts.join(with_user, "sample_id", "left_anti")
        .filter(F.col(prompt_col).isNotNull() & (F.col(prompt_col) != ""))
        .select("sample_id", F.lit(0).cast(turns.schema["turn"].dataType).alias("turn"), F.lit("user").alias("role"), F.col(prompt_col).alias("text"))
    )
    return good.unionByName(fallback)


def record_key(uuid: Column, idx: Column) -> Column:
    """``uuid`` if non-empty else the row index; id is ``uuid`` or ``sample_<idx>``."""
    return F.coalesce(_nonempty(uuid), idx.cast("string"))


def record_id(uuid: Column, idx: Column) -> Column:
    return F.coalesce(_nonempty(uuid), F.concat(F.lit("sample_"), idx.cast("string")))
