"""Templates by turn rules, derived patterns and a model vocabulary."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftsmith.functions.text import CHATML, HFTokenizer
from draftsmith.operators.templates import HEADERS, INSTRUCT, LAYOUTS, SPOKEN, Rule, TurnTemplate, assistant_pattern, character_offsets, encoded, prepare_by_model, spans_agree

VOCAB = os.path.join(os.environ.get("DRAFTSMITH_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
CHAT = [("system", "Be kind."), ("user", "hi"), ("assistant", "hello"), ("user", "bye"), ("assistant", "see you\n\nsoon")]


def test_layouts_render_as_their_reference_text():
    head = lambda r, t: f"<|start_header_id|>{r}<|end_header_id|>\n\n{t}<|eot_id|>"
    assert HEADERS.render_text(CHAT) == "<|begin_of_text|>" + "".join(head(r, t) for r, t in CHAT)
    assert INSTRUCT.render_text(CHAT) == "<s>[INST] <<SYS>>\nBe kind.\n<</SYS>>\n\nhi [/INST] hello </s><s>[INST] bye [/INST] see you\n\nsoon </s>"
    assert INSTRUCT.render_text(CHAT[1:3]) == "<s>[INST] hi [/INST] hello </s>"
    assert SPOKEN.render_text(CHAT) == "Be kind. USER: hi ASSISTANT: hello</s>USER: bye ASSISTANT: see you\n\nsoon</s>"


@pytest.mark.parametrize("name", LAYOUTS)
def test_columns_render_and_mask_as_plain_python(spark, name):
    t, rng = LAYOUTS[name], random.Random(3)
    chats = {0: CHAT, 1: CHAT[1:], 2: CHAT[:2], 3: [("user", None)], 4: [("other", "left out"), ("assistant", "é\U0001f600")]}
    chats |= {i: [(rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["", "a b", "x\ny", "ü"])) for _ in range(rng.randint(1, 6))] for i in range(5, 40)}
    rows = [(i, 10 * k, r, x) for i, c in chats.items() for k, (r, x) in enumerate(c)]
    rng.shuffle(rows)
    got = {r.sample_id: r for r in t.render(spark.createDataFrame(rows, "sample_id long, turn long, role string, text string")).collect()}
    for i, c in chats.items():
        text = t.render_text(c)
        if i in got:
            assert got[i].text == text
            known = {r.role for r in t.rules}
            assert [text[s.span_start : s.span_end] for s in got[i].spans] == [x or "" for r, x in c if r == "assistant" and r in known]
        else:
            assert text == ""


@pytest.mark.parametrize("name", LAYOUTS)
def test_patterns_are_derived_from_probes(name):
    t = LAYOUTS[name]
    pattern = assistant_pattern(t.render_text)
    assert spans_agree(t, pattern, CHAT[1:]) and spans_agree(t, pattern, CHAT[1:3])
    assert not spans_agree(t, r"never(.*?)found", CHAT[1:])


def test_derived_pattern_of_the_default_layout_and_of_thoughts():
    plain = lambda turns: "".join(CHATML.roles[r][0] + x + CHATML.roles[r][1] for r, x in turns)
    p = assistant_pattern(plain)
    assert p == re.escape("<|im_start|>assistant\n") + "((?:(?!" + re.escape("<|im_start|>") + ").)*?)" + re.escape("<|im_end|>\n")
    # a template that puts an empty thought before the last answer only
    thinks = TurnTemplate("t", (Rule("user", "<|u|>", "<|e|>"), Rule("assistant", "<|a|>", "<|e|>", last=False), Rule("assistant", "<|a|><think>\n\n</think>\n\n", "<|e|>")))
    p = assistant_pattern(thinks.render_text)
    assert "think" not in p
    found = [m[1] for m in re.finditer(p, thinks.render_text(CHAT[1:]), re.DOTALL)]
    assert found == ["hello", "<think>\n\n</think>\n\nsee you\n\nsoon"]
    # an answer that was cut off does not run into the next one
    assert [m[1] for m in re.finditer(p, "<|a|>cut off <|a|>whole<|e|>", re.DOTALL)] == ["whole"]
    with pytest.raises(ValueError):
        assistant_pattern(lambda turns: "nothing")


TEXTS = ["", "plain words, and 12345", "é\U0001f600中文 กำ", "\U0001f469‍\U0001f680 ﬁ", "a\n\n  b\t", "<|endoftext|> and text", "\x00\x7f"]


def test_offsets_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    lib, tok = Tokenizer.from_file(VOCAB), HFTokenizer.from_file(VOCAB)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)], "id long, text string")
    got = {r.id: r.e for r in df.select("id", encoded(F.col("text"), tok).alias("e")).collect()}
    for i, t in enumerate(TEXTS):
        e = lib.encode(t, add_special_tokens=False)
        assert [x.token_id for x in got[i].tokens] == e.ids
        assert [(x.start, x.end) for x in got[i].tokens] == e.offsets, t
    assert got[99].tokens == [] and got[99].error is None
    with pytest.raises(ValueError):
        character_offsets("abc", np.array([1, 1]))


def test_rows_by_a_model_vocabulary(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(VOCAB)
    chats = {1: CHAT[:3], 2: CHAT, 3: [("user", "é?"), ("assistant", "\U0001f600 ja")]}
    rows = [(i, k, r, x) for i, c in chats.items() for k, (r, x) in enumerate(c)]
    turns = spark.createDataFrame(rows, "sample_id long, turn long, role string, text string")
    for t in LAYOUTS.values():
        got = {r.sample_id: r for r in prepare_by_model(turns, t, HFTokenizer.from_file(VOCAB)).collect()}
        for i, c in chats.items():
            text = t.render_text(c)
            e = lib.encode(text, add_special_tokens=False)
            spans = [m.span(1) for m in re.finditer(assistant_pattern(t.render_text), text, re.DOTALL)]
            assert got[i].input_ids == e.ids and got[i].seq_len == len(e.ids) and got[i].error is None
            assert got[i].loss_mask == [any(b > s and a < z for s, z in spans) for a, b in e.offsets], (t.name, i)
        cut = {r.sample_id: r for r in prepare_by_model(turns, t, HFTokenizer.from_file(VOCAB), max_length=5).collect()}
        assert cut[2].input_ids == got[2].input_ids[:5] and len(cut[2].loss_mask) == 5

    class Breaks(HFTokenizer):
        """Fails on one word."""

        def encode_bytes(self, text):
            if "bye" in text:
                raise RuntimeError("cannot")
            return HFTokenizer.encode_bytes(self, text)

    failed = {r.sample_id: (r.error, r.input_ids, r.seq_len) for r in prepare_by_model(turns, HEADERS, Breaks.from_file(VOCAB)).collect()}
    assert failed[2] == ("RuntimeError: cannot", None, 0) and failed[1][0] is None  # one row, not the job


def test_the_query_against_the_vocabularys_own_library(spark):
    import hashlib

    from tokenizers import Tokenizer

    from draftsmith.catalog.templates import MAX_LEN, model_rows
    from tests.conftest import SF_SMALL

    lib = Tokenizer.from_file(VOCAB)
    chats = {}
    for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        chats.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.sample_id: r for r in model_rows(spark, SF_SMALL).collect()}
    assert set(got) == set(chats)
    pattern = assistant_pattern(HEADERS.render_text)
    for i, c in chats.items():
        text = HEADERS.render_text(c)
        e = lib.encode(text, add_special_tokens=False)
        spans = [m.span(1) for m in re.finditer(pattern, text, re.DOTALL)]
        assert got[i].seq_len == min(len(e.ids), MAX_LEN) and not got[i].failed
        assert got[i].n_valid == sum(any(b > s and a < z for s, z in spans) for a, b in e.offsets[:MAX_LEN])
        assert got[i].digest == hashlib.md5(",".join(map(str, e.ids[:MAX_LEN])).encode()).hexdigest()


def test_a_large_batch_is_encoded_in_bounded_memory(spark):
    """4,000 texts of 500 words are one Arrow batch; a worker holds a part of their tokens."""

    class Watched(HFTokenizer):
        """Fails once its process has grown by 250 MB since the first text."""

        def encode_bytes(self, text):
            out = HFTokenizer.encode_bytes(self, text)
            with open("/proc/self/statm") as f:
                now = int(f.read().split()[1]) * 4096
            self.first = getattr(self, "first", now)
            if now - self.first > 250e6:
                raise MemoryError(f"{(now - self.first) / 1e6:.0f} MB")
            return out

    df = spark.range(4000, numPartitions=1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 500)).alias("text"))
    got = df.select("*", encoded(F.col("text"), Watched.from_file(VOCAB)).alias("e")).select("id", F.size("e.tokens").alias("n"), F.element_at("e.tokens", -1)["end"].alias("end"), F.length("text").alias("n_chars"), "e.error").collect()
    assert len(got) == 4000 and {r.error for r in got} == {None}
    assert all(r.n > 500 and r.end == r.n_chars for r in got)


def test_runs_of_rows():
    from draftsmith.functions.batches import runs

    assert list(runs([], 5)) == []
    assert list(runs([0, 0, 0], 5)) == [(0, 3)]
    assert list(runs([2, 3, 1, 9, 0, 4, 2], 5)) == [(0, 2), (2, 1), (3, 1), (4, 2), (6, 1)]
