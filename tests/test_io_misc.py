"""Sinks, file sources and row-level helpers (FIXTURES 4, 5, 10, 23)."""

import json

import pytest
from pyspark.sql import functions as F

from draftsmith.operators.tokenize import arrow_tokenizer
from draftsmith.plans.prepare import resolve_vocab, write_frequencies, write_prepared
from draftsmith.sources.artefacts import existing_artefacts, legacy_sample_files, read_val_metrics, sample_lengths
from draftsmith.sources.conversations import RAW_SCHEMA, is_multimodal, normalize_image_chat, parse_tools, request_parts
from draftsmith.operators.examples import request_projection


def test_sinks_ignore_and_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2], [True, False], 2)], "sample_id long, input_ids array<long>, loss_mask array<boolean>, seq_len int")
    p = str(tmp_path / "rows")
    write_prepared(rows, p)
    write_prepared(rows.withColumn("seq_len", F.lit(9)), p)  # exists → kept
    assert spark.read.parquet(p).first().seq_len == 2
    write_prepared(rows.withColumn("seq_len", F.lit(9)), p, overwrite=True)
    assert spark.read.parquet(p).first().seq_len == 9
    f = str(tmp_path / "freq")
    freq = spark.createDataFrame([(1, 5)], "token_id long, freq long")
    write_frequencies(freq, f)
    write_frequencies(freq.withColumn("freq", F.lit(7)), f)
    assert spark.read.parquet(f).first().freq == 5


def test_resolve_vocab_order(spark, tmp_path):
    freq = spark.createDataFrame([(i, 10 - i) for i in range(10)], "token_id long, freq long")
    cache = str(tmp_path / "vocab")
    d2t, t2d = resolve_vocab(spark, cache_dir=cache, freq=freq, draft_vocab_size=4, target_vocab_size=20)
    assert sorted(r.target_id for r in d2t.collect()) == [0, 1, 2, 3]
    d2t2, _ = resolve_vocab(spark, cache_dir=cache)  # cached pair
    assert d2t2.count() == 4
    assert resolve_vocab(spark) is None  # full vocabulary


def test_image_chat_and_request_parts(spark, tmp_path):
    img = tmp_path / "coco" / "train2017"
    img.mkdir(parents=True)
    (img / "a.jpg").write_bytes(b"x")
    rows = [{"idx": 0, "image": "coco/train2017/a.jpg",
             "conversations": [{"from": "human", "value": "<image>\nWhat is shown?"}, {"from": "gpt", "value": "A cat."}]}]
    df = spark.createDataFrame(rows, RAW_SCHEMA)
    out = normalize_image_chat(spark, df, str(tmp_path / "coco")).first()
    parts = out.conversations[0].parts
    assert [p.type for p in parts] == ["image", "text"] and parts[0].path.endswith("train2017/a.jpg")
    assert [p.type for p in out.conversations[1].parts] == ["text"]
    req = spark.createDataFrame(rows, RAW_SCHEMA)
    adapted = normalize_image_chat(spark, req, str(tmp_path / "coco")).select(
        request_parts(F.col("conversations")[0]["parts"]).alias("r"), is_multimodal(F.col("conversations")).alias("mm")
    ).first()
    assert adapted.r[0].url.startswith("file://") and adapted.r[1].text == "What is shown?" and adapted.mm
    missing = spark.createDataFrame([{**rows[0], "image": "coco/train2017/none.jpg"}], RAW_SCHEMA)
    with pytest.raises(Exception):
        normalize_image_chat(spark, missing, str(tmp_path / "coco")).collect()


def test_request_parts_errors(spark):
    df = spark.createDataFrame([([{"type": "image", "base64": "AAAA"}],)], "p array<struct<type:string,text:string,path:string,url:string,base64:string,image:string>>")
    with pytest.raises(Exception):
        df.select(request_parts(F.col("p"))).collect()


def test_request_projection(spark):
    df = spark.createDataFrame([{"idx": 0, "conversations": [{"role": "user", "content": "hi"}]}], RAW_SCHEMA).select(
        F.lit(1).cast("long").alias("sample_id"), F.array(F.lit(1).cast("long")).alias("input_ids"), "conversations")
    assert request_projection(df).columns == ["sample_id", "input_ids", "messages"]
    assert request_projection(df).first().messages is None


def test_parse_tools(spark):
    df = spark.createDataFrame([("this is not valid json",), ('[{"name": "f"}]',), ("",), (None,)], "tools string")
    r = df.select(parse_tools(F.col("tools")).alias("t")).collect()
    assert r[0].t is None and r[1].t is not None and r[2].t is None and r[3].t is None


def test_artefact_listings(spark, tmp_path):
    for n in ("hs_0.safetensors", "hs_12.safetensors", "hs_x.safetensors", "other.bin"):
        (tmp_path / n).write_bytes(b"1")
    assert sorted(r.sample_id for r in existing_artefacts(spark, str(tmp_path)).collect()) == [0, 12]
    assert existing_artefacts(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "data_1.pt").write_bytes(b"12345")
    assert [r.path.endswith("data_1.pt") for r in legacy_sample_files(spark, str(tmp_path)).collect()] == [True]


def test_sample_lengths_fixture(spark, tmp_path):
    files = spark.createDataFrame([(f"/d/data_{i}.pt", 100 * (i + 1)) for i in range(3)], "path string, length long")
    lj = tmp_path / "sample_lengths.json"
    lj.write_text(json.dumps({"0": 9, "1": 14, "2": 19}))
    assert [r.length for r in sample_lengths(spark, files, str(lj)).orderBy("path").collect()] == [9, 14, 19]
    lj.write_text(json.dumps({"0": 9, "1": 14}))  # partial → all estimated from sizes
    assert [r.length for r in sample_lengths(spark, files, str(lj), first_len=9).orderBy("path").collect()] == [9, 18, 27]
    assert [r.length for r in sample_lengths(spark, files, None, first_len=9).orderBy("path").collect()] == [9, 18, 27]


def test_val_metrics(spark, tmp_path):
    for e, loss in ((0, 2.0), (1, 1.5)):
        (tmp_path / str(e)).mkdir()
        (tmp_path / str(e) / "val_metrics.json").write_text(json.dumps({"loss_epoch": loss, "acc_epoch": 0.5}))
    r = {(x.epoch, x.name): x.value for x in read_val_metrics(spark, str(tmp_path)).collect()}
    assert r[(1, "loss_epoch")] == 1.5 and r[(0, "acc_epoch")] == 0.5


def test_arrow_tokenizer_isolates_failures(spark):
    def encode(texts):
        if any("boom" in t for t in texts):
            raise ValueError("bad text")
        return [[len(w) for w in t.split()] for t in texts]

    df = spark.createDataFrame([("a bb ccc",), ("boom",), ("dddd",)], "text string")
    r = df.select(arrow_tokenizer(encode)(F.col("text")).alias("t")).collect()
    assert r[0].t.ids == [1, 2, 3] and r[1].t.ids is None and "bad text" in r[1].t.error and r[2].t.ids == [4]


def test_frequencies_keyed_by_dataset_version(spark, tmp_path):
    from draftsmith.operators.vocab import token_frequency
    from draftsmith.plans.prepare import dataset_version

    def rows(ids, name):
        p = str(tmp_path / name)
        spark.createDataFrame([(1, ids, [True] * len(ids), len(ids))], "sample_id long, input_ids array<long>, loss_mask array<boolean>, seq_len int").write.parquet(p)
        return spark.read.parquet(p)

    a, b = rows([1, 1, 2], "a"), rows([3], "b")
    va, vb = dataset_version(a), dataset_version(b)
    assert va != vb and va == dataset_version(spark.read.parquet(str(tmp_path / "a")))
    out = str(tmp_path / "freq")
    write_frequencies(token_frequency(a), out, va)
    write_frequencies(token_frequency(b), out, vb)  # new data: its own table, not the stale one
    write_frequencies(token_frequency(b).withColumn("freq", F.lit(99)), out, vb)  # same data: kept
    got = {(r.version, r.token_id): r.freq for r in spark.read.parquet(out).collect()}
    assert got == {(va, 1): 2, (va, 2): 1, (vb, 3): 1}
