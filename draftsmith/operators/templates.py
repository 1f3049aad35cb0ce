"""Chat templates whose markers depend on a turn's place.

A template is an automaton over turns: what stands before and after a turn's
text depends on its role, on the role of the turn before it, and on whether it is
first or last.  Its rules become ``CASE`` expressions; places come from one
window over a conversation's turns.  Rendering, spans of trainable text and the
pattern of a regular expression all follow from the same rules, and markers may
begin or end with letters, because nothing is tokenised piece by piece: a model
tokenizer encodes the rendered text, its tokens get character offsets, and a token
is trainable if it overlaps a span.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.functions.batches import runs
from draftsmith.functions.text import HFTokenizer

Turns = list[tuple[str, str]]  # (role, text)


@dataclass(frozen=True)
class Rule:
    """``before`` and ``after`` stand around the text of a turn of ``role`` that
    meets all conditions given (None: any)."""

    role: str
    before: str
    after: str
    previous: str | None = None
    first: bool | None = None
    last: bool | None = None

    def holds(self, role: str, previous: str | None, first: bool, last: bool) -> bool:
        return role == self.role and self.previous in (None, previous) and self.first in (None, first) and self.last in (None, last)


@dataclass(frozen=True)
class TurnTemplate:
    """The first rule that holds renders a turn; turns that no rule renders are left
    out.  ``begin`` stands before everything."""

    name: str
    rules: tuple[Rule, ...]
    begin: str = ""
    trainable: str = "assistant"

    def _case(self, value: Callable[[Rule], str | None]) -> Column:
        out = F.lit(None).cast("string")
        for r in reversed(self.rules):
            when = F.col("role") == r.role
            if r.previous is not None:
                when &= F.coalesce(F.col("_previous") == r.previous, F.lit(False))
            if r.first is not None:
                when &= F.col("_first") == r.first
            if r.last is not None:
                when &= F.col("_last") == r.last
            out = F.when(when, F.lit(value(r))).otherwise(out)
        return out

    def pieces(self, turns: DataFrame) -> DataFrame:
        """``turns(sample_id, turn, role, text)`` with ``before`` and ``after``."""
        order = Window.partitionBy("sample_id").orderBy("turn")
        x = turns.select(
            "sample_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
            F.lag("role").over(order).alias("_previous"), F.lag("turn").over(order).isNull().alias("_first"), F.lead("turn").over(order).isNull().alias("_last"),
        )
        before = F.concat(F.when(F.col("_first"), F.lit(self.begin)).otherwise(F.lit("")), self._case(lambda r: r.before))
        return x.select("sample_id", "turn", "role", "text", before.alias("before"), self._case(lambda r: r.after).alias("after")).filter(F.col("before").isNotNull())

    def render(self, turns: DataFrame) -> DataFrame:
        """P13 + P17: ``(sample_id, text, spans)``: the rendered text of each conversation and its
        trainable spans ``array<struct<span_start, span_end>>`` (in characters)."""
        p = self.pieces(turns)
        parts = F.array_sort(F.collect_list(F.struct("turn", "role", "before", "text", "after")))
        x = p.groupBy("sample_id").agg(parts.alias("_p"))
        text = F.array_join(F.transform("_p", lambda t: F.concat(t["before"], t["text"], t["after"])), "")
        size = lambda t: F.length(t["before"]) + F.length(t["text"]) + F.length(t["after"])
        ends = F.aggregate(
            "_p", F.array().cast("array<bigint>"),
            lambda a, t: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)).cast("bigint") + size(t)),
        )
        x = x.withColumn("_ends", ends)
        start = lambda t, i: F.get("_ends", i) - F.length(t["after"]) - F.length(t["text"])
        spans = F.transform("_p", lambda t, i: F.when(t["role"] == self.trainable, F.struct(start(t, i).alias("span_start"), (start(t, i) + F.length(t["text"])).alias("span_end"))))
        return x.select("sample_id", text.alias("text"), F.array_compact(spans).alias("spans"))

    def render_text(self, turns: Turns) -> str:
        """The same for one conversation in plain Python (probes, tests)."""
        out = []
        for i, (role, text) in enumerate(turns):
            previous, last = (turns[i - 1][0] if i else None), i == len(turns) - 1
            rule = next((r for r in self.rules if r.holds(role, previous, i == 0, last)), None)
            if rule is not None:
                out.append((self.begin if i == 0 else "") + rule.before + (text or "") + rule.after)
        return "".join(out)


# The public layouts.
HEADERS = TurnTemplate(
    "headers",
    tuple(Rule(r, f"<|start_header_id|>{r}<|end_header_id|>\n\n", "<|eot_id|>") for r in ("system", "user", "assistant", "tool")),
    begin="<|begin_of_text|>",
)
INSTRUCT = TurnTemplate(
    "instruct",
    (
        Rule("system", "[INST] <<SYS>>\n", "\n<</SYS>>\n\n"),
        Rule("user", "", " [/INST]", previous="system"),
        Rule("user", "[INST] ", " [/INST]"),
        Rule("assistant", " ", " </s><s>", last=False),
        Rule("assistant", " ", " </s>"),
    ),
    begin="<s>",
)
SPOKEN = TurnTemplate(
    "spoken",
    (
        Rule("system", "", " "),
        Rule("user", "USER: ", " "),
        Rule("assistant", "ASSISTANT: ", "</s>"),
    ),
)
LAYOUTS = {t.name: t for t in (HEADERS, INSTRUCT, SPOKEN)}

_THOUGHT = re.compile(r"<think>.*?</think>\s*", re.DOTALL)
_TAG = re.compile(r"<\|?/?\w+\|?>?|\[/?\w+\]")


def assistant_pattern(render: Callable[[Turns], str]) -> str:
    """The regular expression whose group 1 is an assistant turn's text, from
    renderings of probes alone.

    A probe of two rounds shows what stands before and after the second answer;
    one that ends with the question shows how much of that closes the question.
    What both answers have after them in common closes an answer.  A thought block
    that the template adds is part of no marker, and an answer never runs into the
    tag that opens the next one.
    """
    said = [("user", "Q-one-1"), ("assistant", "A-one-1"), ("user", "Q-two-2"), ("assistant", "A-two-2")]
    whole, asked = render(said), render(said[:3])
    if any(whole.count(text) != 1 for _, text in said):
        raise ValueError("the template does not show each turn's text once")
    after = lambda text, mark: text.split(mark, 1)[1]
    lead = after(whole, "Q-two-2").split("A-two-2", 1)[0]
    closing = os.path.commonprefix([after(asked, "Q-two-2"), lead])
    marker = _THOUGHT.sub("", lead[len(closing) :])
    if not marker.strip():  # the end of the question is all that announces an answer
        marker = _THOUGHT.sub("", lead)
    tails = after(whole, "A-one-1").split("Q-two-2", 1)[0], after(whole, "A-two-2")
    tail = os.path.commonprefix(tails) or tails[0] or "\n"
    tag = _TAG.search(marker)
    stop = re.escape(tag[0]) if tag else re.escape(marker.strip()) or re.escape(tail)
    return f"{re.escape(marker)}((?:(?!{stop}).)*?){re.escape(tail)}"


def spans_agree(template: TurnTemplate, pattern: str, turns: Turns) -> bool:
    """Whether a pattern finds the very texts that the rules say are trainable;
    the probe by which a template's path is chosen."""
    want = [text for role, text in turns if role == template.trainable]
    return [m[1] for m in re.finditer(pattern, template.render_text(turns), re.DOTALL)] == want


_TOKEN = T.StructType([T.StructField("token_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
_ENCODED = T.StructType([T.StructField("tokens", T.ArrayType(_TOKEN)), T.StructField("error", T.StringType())])


def character_offsets(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last character that each token touches, for tokens
    of ``sizes`` bytes that tile the text.  A token may hold a part of a character."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
    ends = np.cumsum(sizes)
    if len(sizes) and ends[-1] != len(raw):
        raise ValueError("the tokens do not tile the text")
    starts = ends - sizes
    return char[starts], char[np.maximum(ends, 1) - 1] + 1


# Bytes of text whose tokens a Python worker holds at a time.
PART_BYTES = 1 << 20


def _encoded_part(texts: list[str | None], tokenizer: HFTokenizer) -> pa.Array:
    """The tokens of some texts, as columns from the start: no object per token."""
    ids, starts, ends, counts, errors = [], [], [], [], []
    for t in texts:
        try:
            one, sizes = tokenizer.encode_bytes(t or "")
            start, end = character_offsets(t or "", sizes)
            one = np.asarray(one, dtype=np.int64)
            error = None
        except Exception as e:  # noqa: BLE001 - of this row alone
            one = start = end = np.zeros(0, dtype=np.int64)
            error = f"{type(e).__name__}: {e}"
        for column, value in ((ids, one), (starts, start), (ends, end)):
            column.append(value)
        counts.append(len(one))
        errors.append(error)
    error = pa.array(errors, pa.string())
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    token = pa.StructArray.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in (ids, starts, ends)], names=["token_id", "start", "end"])
    tokens = pa.ListArray.from_arrays(offsets, token, mask=pc.is_valid(error))
    return pa.StructArray.from_arrays([tokens, error], names=["tokens", "error"])


def encoded(text: Column, tokenizer: HFTokenizer) -> Column:
    """P14 + X2: ``struct<tokens array<struct<token_id, start, end>>, error>`` of a
    byte-level vocabulary; a text that cannot be encoded has an error and null tokens
    (P21: its row is dropped and counted, the job goes on).  An Arrow batch is encoded
    and sent on by runs of rows of ``PART_BYTES`` of text, so a worker's memory does
    not depend on the number of rows in a batch."""

    @F.arrow_udf(_ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for first, n in runs(pc.fill_null(pc.binary_length(texts), 0), PART_BYTES):
                yield _encoded_part(texts.slice(first, n).to_pylist(), tokenizer)

    return run(text)


def prepare_by_model(turns: DataFrame, template: TurnTemplate, tokenizer: HFTokenizer, max_length: int = 8192) -> DataFrame:
    """P14 + P18 + P21: turns to ``(sample_id, input_ids, loss_mask, seq_len, error)`` with a model
    vocabulary: rendered, encoded, masked by the spans of the rules, cut to
    ``max_length``.  Rows with an error have no ids; drop and count them."""
    from draftsmith.operators.tokenize import overlap_mask

    x = template.render(turns).withColumn("_e", encoded(F.col("text"), tokenizer))
    x = x.select("sample_id", "spans", F.slice("_e.tokens", 1, max_length).alias("_t"), "_e.error")
    return x.select(
        "sample_id",
        F.transform("_t", lambda t: t["token_id"]).alias("input_ids"),
        F.when(F.col("_t").isNotNull(), overlap_mask(F.col("_t"), F.col("spans"))).alias("loss_mask"),
        F.coalesce(F.size("_t"), F.lit(0)).alias("seq_len"),
        "error",
    )
