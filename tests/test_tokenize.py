"""Render / tokenize / mask (FIXTURES 6, 7, 9) and the construction invariant."""

import re

from pyspark.sql import functions as F

from draftsmith.catalog.derived import turns
from draftsmith.functions.text import CHATML, ChatTemplate, py_token_ids
from draftsmith.operators.tokenize import (
    mask_by_spans,
    mask_rows,
    token_array,
    min_valid_tokens,
    prepare_rows,
    regex_spans,
    render_text,
    rendered_spans,
    token_offsets,
    valid_tokens,
)
from tests.conftest import SF_SMALL


def test_mask_by_construction_equals_interval_join(spark):
    t = turns(spark, SF_SMALL)
    rows = prepare_rows(t).select("sample_id", valid_tokens(F.col("loss_mask")).alias("n"), F.size("input_ids").alias("len"))
    toks = token_offsets(render_text(t), "sample_id", "text")
    marked = mask_by_spans(toks, rendered_spans(t), "sample_id").groupBy("sample_id").agg(
        F.sum(F.col("trainable").cast("int")).alias("n2"), F.count("*").alias("len2"))
    rowwise = mask_rows(render_text(t).select("sample_id", token_array(F.col("text")).alias("tokens")), rendered_spans(t), "sample_id")
    marked = marked.join(rowwise.select("sample_id", valid_tokens(F.col("mask")).alias("n3")), "sample_id")
    assert marked.filter(F.col("n2") != F.col("n3")).count() == 0
    bad = rows.join(marked, "sample_id").filter((F.col("n") != F.col("n2")) | (F.col("len") != F.col("len2")))
    assert bad.count() == 0


def test_template_constant_ids_match_spark_tokenizer(spark):
    pre = CHATML.roles["assistant"][0]
    from draftsmith.functions.text import token_ids
    got = spark.range(1).select(token_ids(F.lit(pre)).alias("x")).first().x
    assert got == py_token_ids(pre)


def test_template_rejects_alnum_markers():
    import pytest
    with pytest.raises(ValueError):
        ChatTemplate(roles={"user": ("User:", "")})


def test_regex_spans_fixture(spark):
    text = "User: Hello\nAssistant: Hi there!\nUser: How are you?\nAssistant: Good!"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    spans = regex_spans(df, "id", "text", r"Assistant: (.*?)(?=\n|$)").orderBy("span_start").collect()
    exp = [(m.start(1), m.end(1)) for m in re.finditer(r"Assistant: (.*?)(?=\n|$)", text, re.DOTALL)]
    assert [(s.span_start, s.span_end) for s in spans] == exp
    toks = token_offsets(df, "id", "text")
    marked = mask_by_spans(toks, regex_spans(df, "id", "text", r"Assistant: (.*?)(?=\n|$)"), "id")
    tr = {r.token for r in marked.filter("trainable").collect()}
    assert tr == {"Hi", "there", "!", "Good"}


def test_no_assistant_gives_empty_mask(spark):
    df = spark.createDataFrame([(1, 0, "user", "only a question")], "sample_id long, turn long, role string, text string")
    r = prepare_rows(df).first()
    assert not any(r.loss_mask) and r.seq_len == len(r.input_ids) > 0


def test_min_valid_tokens_boundary(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a b c")], "sample_id long, turn long, role string, text string")
    rows = prepare_rows(df)
    n = rows.select(valid_tokens(F.col("loss_mask"))).first()[0]
    assert n == 3
    assert min_valid_tokens(rows, n).count() == 1
    assert min_valid_tokens(rows, n + 1).count() == 0


def test_truncation(spark):
    df = spark.createDataFrame([(1, 0, "user", "q " * 50), (1, 1, "assistant", "a " * 50)], "sample_id long, turn long, role string, text string")
    r = prepare_rows(df, max_length=60).first()
    assert r.seq_len == 60 and len(r.input_ids) == 60 and len(r.loss_mask) == 60


def test_piece_starts_match_python(spark):
    import re as _re
    texts = ["", "ab  cd!", "héllo wörld\n\tx", None, "a" * 50 + " b", "nb\u00a0sp \u3000 v\x0bt \u2003x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").repartition(3)
    got = {r.id: [(x.token, x.start, x.end) for x in r.tok] for r in df.select("id", token_array(F.col("t")).alias("tok")).collect()}
    for i, t in enumerate(texts):
        exp, pos = [], 0
        for p in _re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\r\n]|[ \t\r\n]+", t or ""):
            if not _re.fullmatch(r"[ \t\r\n]+", p):
                exp.append((p, pos, pos + len(p)))
            pos += len(p)
        assert got[i] == exp, (i, got[i], exp)


def test_a_large_batch_is_tabled_by_bounded_parts(spark):
    """A batch of many pieces leaves as parts of bounded pieces that make the whole table."""
    import pyarrow as pa

    from draftsmith.operators.tokenize import PART_PIECES, _token_table

    rows = [["é1", " ", "b", "!", "\n "] * (i % 5) for i in range(60_000)] + [["x", "  "] * PART_PIECES, [], ["yé", "\t", "z"]]
    parts = [p.to_pylist() for p in _token_table.func(iter([pa.array(rows, pa.list_(pa.string()))]))]
    assert len(parts) >= 4 and all(sum(map(len, p)) <= PART_PIECES or len(p) == 1 for p in parts)
    got = [r for p in parts for r in p]
    assert len(got) == len(rows)
    for pieces, tokens in zip(rows, got):
        exp, pos = [], 0
        for x in pieces:
            if x.strip():
                exp.append((x, pos, pos + len(x)))
            pos += len(x)
        assert [(t["token"], t["start"], t["end"]) for t in tokens] == exp
    df = spark.range(20_000, numPartitions=1).select("id", F.concat(F.col("id").cast("string"), F.repeat(F.lit(" a-b"), 20)).alias("text"))
    per_row = token_offsets(df, "id", "text").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos"), F.max("end").alias("end"))
    assert per_row.join(df, "id").filter((F.col("n") == 61) & (F.col("pos") == 60) & (F.col("end") == F.length("text"))).count() == 20_000


def test_assembly_does_not_depend_on_buckets(spark):
    from draftsmith.operators.tokenize import assemble_rows, tokenize_turns

    t = tokenize_turns(turns(spark, SF_SMALL))
    cols = ["sample_id", "input_ids", "loss_mask", "seq_len", "n_tokens_full", "truncated", "has_assistant"]
    for max_len in (8192, 300, 64):
        one = assemble_rows(t, max_len).select(*cols)  # no conversation has more turns than a bucket
        for bucket in (1, 2, 3):
            many = assemble_rows(t, max_len, bucket_turns=bucket).select(*cols)
            assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_one_conversation_with_a_third_of_all_bytes(spark):
    """A hot conversation of many long turns: its row is cut by tokens, and only
    the turns that start before the limit reach the collect."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "word " * 400) for i in range(1500)]
    rows += [(2 + i // 2, i % 2, "user" if i % 2 == 0 else "assistant", "word " * 400) for i in range(3000)]
    df = spark.createDataFrame(rows, "sample_id long, turn long, role string, text string").repartition(8)
    out = {r.sample_id: (r.seq_len, r.n_tokens_full, r.truncated) for r in prepare_rows(df, max_length=1000).select("sample_id", "seq_len", "n_tokens_full", "truncated").collect()}
    assert len(out) == 1501 and out[1][0] == 1000 and out[1][2]
    per_turn = out[2][1] // 2
    assert out[1][1] == 1500 * per_turn


TEMPLATE_FAMILIES = {
    "chatml": CHATML,
    "header": ChatTemplate(name="header", roles={
        "system": ("<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>"),
        "user": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>"),
        "assistant": ("<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>"),
    }),
    "bracket": ChatTemplate(name="bracket", roles={
        "system": ("[SYS] ", " [/SYS]\n"),
        "user": ("[INST] ", " [/INST]"),
        "assistant": ("[ANS] ", " [/ANS]"),
    }),
    "role_tag": ChatTemplate(name="role_tag", roles={
        "system": ("<system>\n", "\n</system>\n"),
        "user": ("<user>\n", "\n</user>\n"),
        "assistant": ("<assistant>\n", "\n</assistant>\n"),
    }),
}


def test_mask_methods_agree_across_template_families(spark):
    """For every template family, the mask known by construction
    equals the mask found by the template's assistant pattern (regex path)."""
    from draftsmith.operators.tokenize import prepare_rows_by_pattern

    t = turns(spark, SF_SMALL)
    cols = ["sample_id", "input_ids", "loss_mask", "seq_len"]
    for name, tmpl in TEMPLATE_FAMILIES.items():
        a = prepare_rows(t, template=tmpl).select(*cols)
        b = prepare_rows_by_pattern(t, tmpl.assistant_pattern(), tmpl).select(*cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_regex_path_needs_distinctive_markers(spark):
    """A template whose assistant marker is not distinctive (a lone space) makes
    the regex path ambiguous — it matches inside user text — while the
    construction path, which never searches the text, stays exact."""
    from draftsmith.operators.tokenize import prepare_rows_by_pattern

    tmpl = ChatTemplate(name="weak", roles={"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")})
    df = spark.createDataFrame([(1, 0, "user", "two words"), (1, 1, "assistant", "ok")], "sample_id long, turn long, role string, text string")
    exact = prepare_rows(df, template=tmpl).first()
    guessed = prepare_rows_by_pattern(df, tmpl.assistant_pattern(), tmpl).first()
    assert sum(exact.loss_mask) == 1  # only "ok"
    assert sum(guessed.loss_mask) > 1  # the regex also swallowed user text


def _word_tokenizer_json():
    from tokenizers import Tokenizer, models, pre_tokenizers

    words = ["<unk>", "<|im_start|>", "<|im_end|>", "user", "assistant", "system", "hello", "world", "ok", "here"]
    t = Tokenizer(models.WordLevel({w: i for i, w in enumerate(words)}, unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    t.add_special_tokens(["<|im_start|>", "<|im_end|>"])
    return t.to_str()


def test_model_tokenizer_in_prep(spark):
    """X2 + P21: a real ``tokenizers`` model in the prep path; a conversation
    whose turn fails to encode is skipped, the others are kept."""
    from draftsmith.functions.text import HFTokenizer

    class Failing(HFTokenizer):  # defined here: pickled by value for the workers
        def encode_batch(self, texts):
            if any("BOOM" in t for t in texts):
                raise ValueError("cannot encode")
            return super().encode_batch(texts)

    df = spark.createDataFrame(
        [(1, 0, "user", "hello world"), (1, 1, "assistant", "ok ok"), (2, 0, "user", "hello"), (2, 1, "assistant", "BOOM here")],
        "sample_id long, turn long, role string, text string",
    )
    tok = Failing(_word_tokenizer_json())
    rows = {r.sample_id: r for r in prepare_rows(df, tokenizer=tok).collect()}
    assert set(rows) == {1}
    r = rows[1]
    assert [i for i, m in zip(r.input_ids, r.loss_mask) if m] == tok.encode_batch(["ok ok"])[0]
    assert r.input_ids[0] == 1  # <|im_start|> marker encoded as the special token
    plain = HFTokenizer(_word_tokenizer_json())
    assert prepare_rows(df, tokenizer=plain).count() == 2


def test_regex_path_is_bounded_and_exact(spark):
    """The regex path renders only turns that start before max_length, and still
    equals the construction path (including the full-length/truncated columns)."""
    from draftsmith.operators.tokenize import bound_turns, prepare_rows_by_pattern

    t = turns(spark, SF_SMALL)
    cols = ["sample_id", "input_ids", "loss_mask", "seq_len", "n_tokens_full", "truncated"]
    for L in (64, 700, 8192):
        a = prepare_rows(t, max_length=L).select(*cols)
        b = prepare_rows_by_pattern(t, CHATML.assistant_pattern(), CHATML, max_length=L).select(*cols)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, L
    kept = bound_turns(t, CHATML, 64, bucket_turns=2)
    assert kept.count() < t.count()
