"""Render, tokenize, mask and assemble training rows.

Plan shape for ``prepare_rows``::

    scan(turns) → project(prefix ids ++ text ids ++ suffix ids, mask)   [narrow]
      → Exchange hashpartitioning(sample_id)
      → Window(running token count) → filter(start < max_length)
      → collect_list of turn structs → project(flatten + slice)

Turns numbered 256 or more, which most tables lack, are cut before they join the
exchange: token sums per (sample_id, bucket of turns), running sums over the small
bucket table and inside each bucket.  A conversation collects at most twice
``max_length`` tokens plus two turns, whatever its size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.functions.batches import runs
from draftsmith.functions.text import CHATML, DEFAULT_VOCAB_SIZE, PIECE_PATTERN, TOKEN_PATTERN, ChatTemplate, token_ids


def _marker_ids(tokenizer, texts: dict[str, str]) -> dict[str, list[int]]:
    """Template markers encoded once on the driver (a handful of constant strings)."""
    names = list(texts)
    enc = tokenizer.encode_batch([texts[n] for n in names]) if names else []
    return {n: [int(i) for i in ids] for n, ids in zip(names, enc)}


def tokenize_turns(
    turns: DataFrame,
    template: ChatTemplate = CHATML,
    vocab_size: int = DEFAULT_VOCAB_SIZE,
    tokenizer=None,
) -> DataFrame:
    """Per turn: ``ids = prefix ++ text ++ suffix`` and the matching mask.

    Only assistant content is trainable (P17/P18: the assistant span is
    group 1 of the template pattern, markers excluded).

    ``tokenizer`` (X2): any picklable object with ``encode_batch(list[str])
    -> list[list[int]]`` (e.g. a ``tokenizers.Tokenizer`` wrapper).  Turn
    texts then go through one Arrow batch UDF; the markers are encoded on
    the driver.  A turn that fails to encode sets ``_err`` and its
    conversation is dropped at assembly (P21).  Default: the JVM regex
    tokenizer with the hashing vocabulary.
    """
    role = F.col("role")
    is_asst = role == "assistant"
    if tokenizer is None:
        pre = template.prefix_ids(role, vocab_size)
        suf = template.suffix_ids(role, vocab_size)
        body, err = token_ids(F.col("text"), vocab_size), F.lit(None).cast("string")
    else:
        from draftsmith.functions.text import _lookup_ids

        pre = _lookup_ids(role, _marker_ids(tokenizer, {r: p for r, (p, _) in template.roles.items() if p}))
        suf = _lookup_ids(role, _marker_ids(tokenizer, {r: s for r, (_, s) in template.roles.items() if s}))
        enc = arrow_tokenizer(tokenizer.encode_batch)(F.col("text"))
        body, err = F.coalesce(enc["ids"], F.array().cast("array<bigint>")), enc["error"]
    # the error column only exists with a model tokenizer (the JVM path cannot fail per row)
    extra = [err.alias("_err")] if tokenizer is not None else []
    # the JVM tokenizer counts without making ids, so a plan that needs lengths alone stays cheap
    counted = F.size(pre) + F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))) + F.size(suf)
    if tokenizer is None:
        extra.append(counted.alias("n_ids"))
    return (
        turns.select("sample_id", "turn", "role", pre.alias("_pre"), body.alias("_body"), suf.alias("_suf"), *extra)
        .select(
            "sample_id",
            "turn",
            "role",
            F.concat("_pre", "_body", "_suf").alias("ids"),
            F.concat(
                F.array_repeat(F.lit(False), F.size("_pre")),
                F.array_repeat(is_asst, F.size("_body")),
                F.array_repeat(F.lit(False), F.size("_suf")),
            ).alias("mask"),
            "_err" if tokenizer is not None else "n_ids",
        )
    )


BUCKET_TURNS = 256


def _later_turns(x: DataFrame, max_length: int, bucket_turns: int) -> DataFrame:
    """Of the turns after a conversation's first ``bucket_turns`` those that start
    before ``max_length`` tokens (counted from the first of them), with the sums of
    all of them.  Bucket sums give each bucket's start by a running sum over the
    small bucket table, a running sum inside the bucket gives each turn's."""
    b = x.withColumn("_bucket", F.floor(F.col("turn") / F.lit(bucket_turns)).cast("bigint")).repartition("sample_id", "_bucket")
    sums = b.groupBy("sample_id", "_bucket").agg(F.sum("_n").alias("_bn"), F.max("_a").alias("_ba"), F.max("_e").alias("_be"))
    whole = Window.partitionBy("sample_id")
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("sample_id").alias("_sid"), F.col("_bucket").alias("_sb"),
        F.coalesce(F.sum("_bn").over(earlier), F.lit(0)).alias("_bstart"),
        F.sum("_bn").over(whole).alias("_all_n"), F.max("_ba").over(whole).alias("_all_a"), F.max("_be").over(whole).alias("_all_e"),
    )
    kept = b.join(starts, F.col("sample_id").eqNullSafe(F.col("_sid")) & (F.col("_bucket") == F.col("_sb"))).filter(F.col("_bstart") < max_length)
    inside = Window.partitionBy("sample_id", "_bucket").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.filter(F.col("_bstart") < max_length).withColumn("_start", F.col("_bstart") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return kept.filter(F.col("_start") < max_length).drop("_bucket", "_sid", "_sb", "_bstart", "_start")


def assemble_rows(turn_tokens: DataFrame, max_length: int = 8192, bucket_turns: int = BUCKET_TURNS) -> DataFrame:
    """Concatenate turn tokens in turn order and truncate to ``max_length``.

    The first ``bucket_turns`` turn numbers of a conversation are few whatever its
    size, so they go to its task as they are: one scan, one exchange.  Later turns,
    where there are any, are cut first (:func:`_later_turns`; their scans are pruned
    by the turn number), so a conversation of any size collects no more than twice
    ``max_length`` tokens and two turns.

    Output: ``sample_id, input_ids, loss_mask, seq_len, n_tokens_full,
    truncated, has_assistant`` (P19, P22: only the row columns are kept).
    """
    x = turn_tokens.withColumn("_n", F.col("n_ids") if "n_ids" in turn_tokens.columns else F.size("ids"))
    # a turn that failed to encode fails the conversation, wherever it is
    x = x.withColumn("_e", F.col("_err").isNotNull() if "_err" in turn_tokens.columns else F.lit(False))
    x = x.select("sample_id", "turn", "ids", "mask", "_n", (F.col("role") == "assistant").cast("int").alias("_a"), "_e")
    later = _later_turns(x.filter(F.col("turn") >= bucket_turns), max_length, bucket_turns)
    first = x.filter(F.col("turn") < bucket_turns)
    first = first.select("*", *[F.lit(None).cast(later.schema[c].dataType).alias(c) for c in ("_all_n", "_all_a", "_all_e")])
    b = first.withColumn("_later", F.lit(False)).unionByName(later.withColumn("_later", F.lit(True))).repartition("sample_id")
    part = Window.partitionBy("sample_id", "_later")
    start = F.coalesce(F.sum("_n").over(part.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = {"_all_n": F.sum("_n"), "_all_a": F.max("_a"), "_all_e": F.max("_e")}
    b = b.select("sample_id", "turn", "ids", "mask", "_later", start.alias("_start"), *[F.coalesce(c, v.over(part)).alias(c) for c, v in sums.items()])
    side = lambda c, later: F.coalesce(F.max(F.when(F.col("_later") == later, F.col(c))), F.lit(0))
    rows = b.filter(F.col("_start") < max_length).groupBy("sample_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "ids", "mask"))).alias("_parts"),
        (side("_all_n", False) + side("_all_n", True)).alias("_total"),
        F.max("_all_a").alias("_asst"),
        F.max("_all_e").alias("_failed"),
    ).filter(~F.col("_failed"))
    ids = F.slice(F.flatten(F.transform("_parts", lambda p: p["ids"])), 1, max_length)
    mask = F.slice(F.flatten(F.transform("_parts", lambda p: p["mask"])), 1, max_length)
    return rows.select(
        "sample_id",
        ids.alias("input_ids"),
        mask.alias("loss_mask"),
        F.least(F.col("_total"), F.lit(max_length)).cast("int").alias("seq_len"),
        F.col("_total").cast("bigint").alias("n_tokens_full"),
        (F.col("_total") > max_length).alias("truncated"),
        (F.col("_asst") == 1).alias("has_assistant"),
    )


def valid_tokens(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda m: m))


def min_valid_tokens(rows: DataFrame, n: int | None) -> DataFrame:
    """P20: drop rows with fewer than ``n`` trainable tokens (equality kept)."""
    if n is None:
        return rows
    if n < 0:
        raise ValueError("minimum_valid_tokens must be non-negative")
    return rows.filter(valid_tokens(F.col("loss_mask")) >= n)


def prepare_rows(
    turns: DataFrame,
    template: ChatTemplate = CHATML,
    max_length: int = 8192,
    vocab_size: int = DEFAULT_VOCAB_SIZE,
    minimum_valid_tokens: int | None = None,
    tokenizer=None,
) -> DataFrame:
    """Normalised long-form turns → prepared rows (the Prep job's core): one
    scan, tokens per turn (narrow), :func:`assemble_rows`."""
    return min_valid_tokens(assemble_rows(tokenize_turns(turns, template, vocab_size, tokenizer), max_length), minimum_valid_tokens)


@F.arrow_udf(T.ArrayType(T.LongType()))
def piece_starts(pieces):
    """Start offset of every piece of a row: an exclusive prefix sum of the piece
    lengths (code points), computed per Arrow batch with vectorised compute
    (``utf8_length`` + ``cumulative_sum``), re-based at each row — no explode,
    no shuffle, no per-element Python."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(pieces, pa.ChunkedArray):
        pieces = pieces.combine_chunks()
    n = len(pieces)
    off = pc.subtract(pieces.offsets, pieces.offsets[0])
    flat = pc.list_flatten(pieces)
    if len(flat) == 0:
        return pa.ListArray.from_arrays(off, pa.array([], pa.int64()))
    ln = pc.utf8_length(flat).cast(pa.int64())
    excl = pc.subtract(pc.cumulative_sum(ln), ln)
    first = off.slice(0, n)
    sizes = pc.subtract(off.slice(1, n), first)
    base = pc.take(excl, pc.if_else(pc.greater(sizes, 0), first, 0))
    starts = pc.subtract(excl, pc.take(base, pc.list_parent_indices(pieces)))
    return pa.ListArray.from_arrays(off, starts)


# Pieces whose offsets a Python worker holds at a time.
PART_PIECES = 1 << 18


def _token_table_part(pieces: pa.Array) -> pa.Array:
    """Pieces → ``[(token, start, end)]`` of the non-space pieces, with
    vectorised compute: prefix sums of piece lengths re-based per
    row, space runs dropped (a piece is a space run iff its first character
    is a space — pieces tile the text), list offsets rebuilt from counts."""
    import numpy as np
    import pyarrow.compute as pc

    n = len(pieces)
    off = pc.subtract(pieces.offsets, pieces.offsets[0])
    flat = pc.list_flatten(pieces)
    struct_t = pa.struct([("token", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    if len(flat) == 0:
        return pa.ListArray.from_arrays(off, pa.array([], struct_t))
    ln = pc.utf8_length(flat).cast(pa.int64())
    excl = pc.subtract(pc.cumulative_sum(ln), ln)
    first = off.slice(0, n)
    sizes = pc.subtract(off.slice(1, n), first)
    parents = pc.list_parent_indices(pieces)
    starts = pc.subtract(excl, pc.take(pc.take(excl, pc.if_else(pc.greater(sizes, 0), first, 0)), parents))
    # exactly the tokenizer's space class (other Unicode spaces are tokens)
    keep = pc.invert(pc.is_in(pc.utf8_slice_codeunits(flat, 0, 1), value_set=pa.array([" ", "\t", "\r", "\n"])))
    toks, st, ln_k = pc.filter(flat, keep), pc.filter(starts, keep), pc.filter(ln, keep)
    counts = np.bincount(pc.filter(parents, keep).to_numpy(zero_copy_only=False), minlength=n)
    new_off = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    values = pa.StructArray.from_arrays([toks, st, pc.add(st, ln_k)], fields=list(struct_t))
    return pa.ListArray.from_arrays(new_off, values)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
def _token_table(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """:func:`_token_table_part` of an Arrow batch by runs of rows of ``PART_PIECES``
    pieces, each sent on at once: a worker holds a batch of pieces, not its table."""
    import pyarrow.compute as pc

    for pieces in batches:
        if isinstance(pieces, pa.ChunkedArray):
            pieces = pieces.combine_chunks()
        for first, n in runs(pc.fill_null(pc.list_value_length(pieces), 0), PART_PIECES):
            yield _token_table_part(pieces.slice(first, n))


def token_array(text: Column) -> Column:
    """P14 in row: ``array<struct<token, start, end>>`` of the non-space tokens
    (pieces extracted in the JVM, offsets and filtering in one Arrow UDF)."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE_PATTERN), 0)
    return _token_table(pieces)


def token_offsets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """P14 with offsets as a long table ``(id, pos, token, start, end)``.

    Narrow: tokens and offsets are computed in row (:func:`token_array`) and
    exploded last; no exchange.
    """
    return docs.select(id_col, text_col).select(F.col(id_col), F.posexplode(token_array(F.col(text_col))).alias("pos", "_t")).select(
        id_col, F.col("pos").cast("bigint").alias("pos"), "_t.token", "_t.start", "_t.end"
    )


def overlap_mask(tokens: Column, spans: Column) -> Column:
    """P18 / J12 in row: a token is trainable if it overlaps any span
    (``end > span_start and start < span_end``); a row has few spans."""
    sp = F.coalesce(spans, F.array().cast("array<struct<span_start:bigint,span_end:bigint>>"))
    return F.transform(tokens, lambda t: F.exists(sp, lambda s: (t["end"] > s["span_start"]) & (t["start"] < s["span_end"])))


def mask_rows(token_rows: DataFrame, spans: DataFrame, id_col: str, tokens_col: str = "tokens") -> DataFrame:
    """Attach each row's spans (grouped per row — a handful) by an equi join
    on the row id, then test the overlap in row (no token-level join)."""
    per_row = spans.groupBy(id_col).agg(F.collect_list(F.struct("span_start", "span_end")).alias("_spans"))
    return token_rows.join(per_row, id_col, "left").withColumn("mask", overlap_mask(F.col(tokens_col), F.col("_spans"))).drop("_spans")


def mask_by_spans(tokens: DataFrame, spans: DataFrame, id_col: str) -> DataFrame:
    """Long-form variant of J12 (token rows × a row's spans), for inspection."""
    per_row = spans.groupBy(id_col).agg(F.collect_list(F.struct("span_start", "span_end")).alias("_spans"))
    joined = tokens.join(per_row, id_col, "left")
    one = F.struct(F.col("start"), F.col("end"))
    tr = F.exists(
        F.coalesce(F.col("_spans"), F.array().cast("array<struct<span_start:bigint,span_end:bigint>>")),
        lambda sp: (one["end"] > sp["span_start"]) & (one["start"] < sp["span_end"]),
    )
    return joined.withColumn("trainable", tr).drop("_spans")


def rendered_spans(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """P13 + P17 by construction: char spans of assistant content.

    The rendered text is ``concat(prefix, text, suffix)`` over turns, so the
    start of each turn is a running sum of rendered lengths (window on the
    conversation).  Output ``(sample_id, turn, span_start, span_end)`` for
    assistant turns.
    """
    role = F.col("role")
    rendered_len = F.length(template.prefix(role)) + F.length("text") + F.length(template.suffix(role))
    w = Window.partitionBy("sample_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(rendered_len).over(w), F.lit(0)) + F.length(template.prefix(role))
    return (
        turns.withColumn("span_start", start.cast("bigint"))
        .withColumn("span_end", (F.col("span_start") + F.length("text")).cast("bigint"))
        .filter(role == "assistant")
        .select("sample_id", "turn", "span_start", "span_end")
    )


def render_text(turns: DataFrame, template: ChatTemplate = CHATML) -> DataFrame:
    """``(sample_id, text)`` — the whole rendered conversation."""
    role = F.col("role")
    piece = F.concat(template.prefix(role), F.coalesce(F.col("text"), F.lit("")), template.suffix(role))
    return turns.groupBy("sample_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("turn", piece.alias("p")))), lambda x: x["p"]), ""
        ).alias("text")
    )


def regex_span_array(text: Column, pattern: str) -> Column:
    """P17 in row: ``array<struct<span_start, span_end>>`` of group 1 of every
    match of a Python regex (DOTALL) — a small per-row helper in an Arrow
    batch UDF (custom patterns may use look-ahead, which Java/RE2 differ on)."""
    rx = re.compile(pattern, re.DOTALL)
    span_t = T.ArrayType(T.StructType([T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType())]))

    @F.pandas_udf(span_t)
    def _spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"span_start": m.start(1), "span_end": m.end(1)} for m in rx.finditer(t or "")] for t in texts])

    return _spans(text)


def regex_spans(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """P17 for free text and a custom pattern (X3): group 1 of every match.

    Python ``re`` with DOTALL, as the pattern language of a custom assistant
    regex is Python's (look-ahead included).  A small per-row helper inside
    an Arrow batch UDF; the explode and the overlap test stay in Spark.
    """
    rx = re.compile(pattern, re.DOTALL)
    span_t = T.ArrayType(T.StructType([T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType())]))

    @F.pandas_udf(span_t)
    def _spans(texts: pd.Series) -> pd.Series:
        return pd.Series(
            [[{"span_start": m.start(1), "span_end": m.end(1)} for m in rx.finditer(t or "")] for t in texts]
        )

    return docs.select(F.col(id_col), F.explode(_spans(F.col(text_col))).alias("_s")).select(id_col, "_s.*")


def bound_turns(turns: DataFrame, template: ChatTemplate = CHATML, max_length: int = 8192, vocab_size: int = DEFAULT_VOCAB_SIZE, bucket_turns: int = 256) -> DataFrame:
    """Only the turns that start before ``max_length`` tokens, plus ``_total``
    (all tokens of the conversation) — skew-safe.

    Template markers start and end on non-alphanumerics, so per-turn token
    counts are exact without rendering.  Counts are summed per bucket of
    ``bucket_turns`` turns (partial aggregation), bucket starts come from a
    small window, and only the buckets starting before ``max_length`` are
    examined turn by turn — a conversation of any size keeps at most
    ``max_length`` tokens plus one bucket of turns.
    """
    n = tokenize_turns(turns.select("sample_id", "turn", "role", "text"), template, vocab_size).select(
        "sample_id", "turn", F.size("ids").alias("_n"), F.floor(F.col("turn") / F.lit(bucket_turns)).cast("bigint").alias("_bucket")
    )
    sums = n.groupBy("sample_id", "_bucket").agg(F.sum("_n").alias("_bn"))
    wb = Window.partitionBy("sample_id").orderBy("_bucket")
    starts = (
        sums.withColumn("_bstart", F.coalesce(F.sum("_bn").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(Window.partitionBy("sample_id")))
        .filter(F.col("_bstart") < max_length)
        .select("sample_id", "_bucket", "_bstart", "_total")
    )
    w = Window.partitionBy("sample_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    keep = (
        n.join(starts, ["sample_id", "_bucket"])
        .withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0)))
        .filter(F.col("_start") < max_length)
        .select("sample_id", "turn", "_total")
    )
    return turns.join(keep, ["sample_id", "turn"])


def prepare_rows_by_pattern(
    turns: DataFrame,
    pattern: str,
    template: ChatTemplate = CHATML,
    max_length: int = 8192,
    vocab_size: int = DEFAULT_VOCAB_SIZE,
) -> DataFrame:
    """P15 (X3) custom-pattern path: render → tokens with offsets → regex spans →
    overlap mask → ids, all in row after the render (one shuffle: the
    conversation id); truncated to ``max_length`` (Q2: always)."""
    from draftsmith.functions.text import token_id

    # only turns that start before max_length are rendered (bounded per row)
    kept = bound_turns(turns, template, max_length, vocab_size)
    text = render_text(kept, template).join(kept.groupBy("sample_id").agg(F.first("_total").alias("_total")), "sample_id")
    r = text.select(
        "sample_id", "_total", token_array(F.col("text")).alias("_tok"), regex_span_array(F.col("text"), pattern).alias("_sp")
    ).select("sample_id", "_total", "_tok", overlap_mask(F.col("_tok"), F.col("_sp")).alias("_m"))
    return r.select(
        "sample_id",
        F.slice(F.transform("_tok", lambda t: token_id(t["token"], vocab_size)), 1, max_length).alias("input_ids"),
        F.slice("_m", 1, max_length).alias("loss_mask"),
        F.least(F.col("_total"), F.lit(max_length)).cast("int").alias("seq_len"),
        F.col("_total").cast("bigint").alias("n_tokens_full"),
        (F.col("_total") > max_length).alias("truncated"),
    )


def trainable_runs(rows: DataFrame) -> DataFrame:
    """Maximal runs of equal mask value per row (gaps and islands).

    Output ``(sample_id, run_no, trainable, run_start, run_len)``.
    """
    toks = rows.select("sample_id", F.posexplode("loss_mask").alias("pos", "m"))
    w = Window.partitionBy("sample_id").orderBy("pos")
    flagged = toks.withColumn(
        "_new", F.when(F.lag("m").over(w).isNull() | (F.lag("m").over(w) != F.col("m")), 1).otherwise(0)
    ).withColumn("run_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return flagged.groupBy("sample_id", "run_no").agg(
        F.first("m").alias("trainable"),
        F.min("pos").cast("bigint").alias("run_start"),
        F.count(F.lit(1)).alias("run_len"),
    )


def arrow_tokenizer(encode, vocab_size: int | None = None):
    """X2 + P21: wrap a model tokenizer as an Arrow batch UDF
    ``text -> struct<ids: array<bigint>, error: string>``.

    ``encode`` maps a list of strings to a list of id lists (e.g. the batch
    encoder of the ``tokenizers`` package).  It is called once per Arrow
    batch; if the batch call fails, rows are retried one by one and a row
    that still fails gets ``ids = null`` and its error (the row is dropped
    by the caller and counted, never failing the job).  Load the tokenizer
    inside ``encode`` lazily so each Python worker loads it once.
    """
    out_t = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("error", T.StringType())])

    @F.pandas_udf(out_t)
    def _tok(texts: pd.Series) -> pd.DataFrame:
        items = texts.fillna("").tolist()
        try:
            ids = encode(items)
            errs = [None] * len(items)
        except Exception:  # noqa: BLE001 - isolate the failing rows
            ids, errs = [], []
            for t in items:
                try:
                    ids.append(encode([t])[0])
                    errs.append(None)
                except Exception as e:  # noqa: BLE001
                    ids.append(None)
                    errs.append(repr(e))
        if vocab_size is not None:
            ids = [None if x is None else [int(i) % vocab_size for i in x] for x in ids]
        return pd.DataFrame({"ids": ids, "error": errs})

    return _tok
