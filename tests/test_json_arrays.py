"""Reading one JSON document by many tasks."""

import json
import random

import pytest
from pyspark.sql import types as T

from draftsmith.sources.conversations import load_raw, read_conversations, to_turns
from draftsmith.sources.json_arrays import element_texts, read_json_documents

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("conversations", T.ArrayType(T.StructType([T.StructField("from", T.StringType()), T.StructField("value", T.StringType())])))])
SIGNS = ["{", "}", "[", "]", '"', "\\", "\\\\", ",", ":", "é", "\U0001f600", "\n", "\t", " ", "a", "}}", '{"', '\\"', " ", "]}"]


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "0")
    yield lambda size: spark.conf.set(names[0], size)
    for n, v in zip(names, before):
        spark.conf.set(n, v)


def _rows(n):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 30)))
    return [{"id": str(i), "conversations": [{"from": text(), "value": text()} for _ in range(rng.randint(0, 4))]} for i in range(n)]


@pytest.mark.parametrize("size", [300, 4096, 1 << 27])
def test_as_the_reader_of_one_task(spark, tmp_path, small_ranges, size):
    rows = _rows(400)
    folder = tmp_path / "with space"
    folder.mkdir()
    write = lambda name, text: (folder / name).write_text(text, encoding="utf-8")
    write("a.json", json.dumps(rows, ensure_ascii=False))
    write("b.json", json.dumps(rows[:40], indent=2))
    write("c.json", json.dumps(rows[7], ensure_ascii=False))
    write("d.json", "[]")
    write("e.json", '\n [ {"id":"e"} ,\n{}\n]\n')
    write("f.json", '{"id":"f"}\n')
    write("g.json", "")
    write("h.json", '[{"id":"x" * 3}, {"id":"h"}')
    small_ranges(size)
    got = read_json_documents(spark, str(folder), SCHEMA).collect()
    key = lambda r: (r.id or "", str(r.conversations))
    broken = [r for r in got if r["_file"].endswith("h.json")]
    assert [r.id for r in sorted(broken, key=lambda r: r["_element"])] == [None, "h"]
    (folder / "h.json").unlink()
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(str(folder)).collect()
    assert sorted(map(key, (r for r in got if r not in broken))) == sorted(map(key, want))
    if size == 300:
        a = element_texts(spark, str(folder / "a.json"))
        texts = [r.value for r in sorted(a.collect(), key=lambda r: r["_element"])]
        assert [json.loads(t) for t in texts] == rows
        assert spark.read.option("lineSep", "}").text(str(folder / "a.json")).rdd.getNumPartitions() > 50


def test_each_chat_of_large_arrays_stays_one_conversation(spark, tmp_path, small_ranges):
    rows = [{k: v for k, v in r.items() if k != "id"} for r in _rows(200) if r["conversations"]]
    (tmp_path / "x.json").write_text(json.dumps(rows), encoding="utf-8")
    (tmp_path / "y.json").write_text(json.dumps(rows[:30]), encoding="utf-8")
    (tmp_path / "z.jsonl").write_text("\n".join(map(json.dumps, rows[:20])), encoding="utf-8")
    small_ranges(500)
    raw = load_raw(spark, str(tmp_path))
    ids = [r.idx for r in raw.collect()]
    assert len(set(ids)) == len(ids) == len(rows) + 50 and max(ids) < 0
    assert sorted(ids) == sorted(r.idx for r in load_raw(spark, str(tmp_path)).collect())
    turns = to_turns(read_conversations(spark, str(tmp_path)), "idx").groupBy("idx").count().collect()
    assert sorted(r["count"] for r in turns) == sorted(len(r["conversations"]) for r in rows + rows[:30] + rows[:20])


def test_own_ids_are_kept(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"idx": 5, "conversations": []}, {"idx": 6, "conversations": []}]')
    assert sorted(r.idx for r in load_raw(spark, str(tmp_path / "x.json")).collect()) == [5, 6]


def test_sample_lengths_from_one_large_map(spark, tmp_path, small_ranges):
    from draftsmith.sources.artefacts import sample_lengths

    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "sample_lengths.json").write_text(json.dumps({str(i): i * 3 for i in range(1000)}, indent=1))
    files = spark.createDataFrame([(f"d/data_{i}.pt", 10) for i in range(1000)], "path string, length long")
    small_ranges(200)
    got = {r.path: r.length for r in sample_lengths(spark, files, str(tmp_path / "l")).collect()}
    assert got == {f"d/data_{i}.pt": i * 3 for i in range(1000)}
