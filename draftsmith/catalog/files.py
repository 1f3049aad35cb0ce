"""Readers and writers over files derived from the test tables.

Each query writes what a producer would leave (JSON lines, JSON documents, CSV,
text, Parquet) into a fresh folder below the shared checkpoint folder, reads it
with the library's reader or writes it with its writer, and returns what came
out of it; the oracle computes the same from the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import VOCAB, ids_digest, prepared, sql_ids_digest, sql_prepared_chain, sql_valid
from draftsmith.catalog.evaluation import _SQL_EVENTS, _SQL_SWEEP, _events, _scrape_lines, _sweep
from draftsmith.catalog.vocab import _SQL_FREQ, K_SMALL, _sql_select
from draftsmith.operators.evaluation import generation_lengths
from draftsmith.operators.examples import cast_states, request_projection
from draftsmith.operators.regen import read_regen_source
from draftsmith.operators.resume import artefact_index
from draftsmith.operators.training_logs import flatten_record
from draftsmith.operators.vocab import token_frequency, validate_vocab_maps
from draftsmith.plans.evaluate import acceptance_between, acceptance_wide
from draftsmith.plans.prepare import resolve_vocab, write_frequencies, write_prepared
from draftsmith.sources import artefacts, benchmarks, conversations
from draftsmith.streaming.jobs import scratch
from draftsmith.tables import table

G = "files"


PART_ROWS = 1000  # rows that one staged document holds, about


def _staged(spark: SparkSession, rows: DataFrame, targets) -> None:
    """Write ``rows(value)`` as text, a file for each part of the frame or for each
    value of a column ``part``, under the paths that ``targets`` gives in turn."""
    tmp = f"{scratch(spark, 'staged')}/rows"
    (rows.write.partitionBy("part") if "part" in rows.columns else rows.write).text(tmp)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(tmp).getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(s.getPath().toString() for s in fs.globStatus(fs_path(f"{tmp}/{'part=*/' if 'part' in rows.columns else ''}part-*")) if s.isFile())
    for k, file in enumerate(files):
        path = fs_path(targets(k))
        fs.mkdirs(path.getParent())
        if not fs.rename(fs_path(file), path):
            raise OSError(f"{path.toString()} cannot be written")


def _named(spark: SparkSession, rows: DataFrame, folder: str, name: str) -> None:
    """Files ``folder/<k>/name`` with the rows (readers go by the name)."""
    _staged(spark, rows, lambda k: f"{folder}/{k}/{name}")


def _document(spark: SparkSession, row: DataFrame, path: str) -> None:
    """The one row of ``row`` as the file ``path``."""
    _staged(spark, row.coalesce(1), lambda k: path)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` with ``part``, so that a part has about ``PART_ROWS`` rows at any size."""
    parts = -(-df.count() // PART_ROWS)
    return df.withColumn("part", F.pmod(F.xxhash64(key), F.lit(max(1, parts))))


def _chats(spark, sf):
    """One row per conversation: id and turns in order."""
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return raw.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))


def _turns(col="t", role="role", text="content"):
    return F.transform(col, lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))


_SQL_CHAT = """chat AS (
  SELECT conv_id, count(*) AS n_turns, sum(length(text)) AS n_chars, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest
  FROM conversations GROUP BY conv_id)"""


def _digest(df, conv="conversations"):
    said = F.transform(conv, lambda t: F.concat(F.coalesce(t["role"], t["from"]), F.lit(":"), F.coalesce(t["content"], t["value"])))
    chars = F.aggregate(conv, F.lit(0).cast("bigint"), lambda a, t: a + F.length(F.coalesce(t["content"], t["value"])))
    return df.select(F.size(conv).cast("bigint").alias("n_turns"), chars.alias("n_chars"), F.md5(F.array_join(said, "\n")).alias("digest"))


@register("raw_chats_without_ids", f"""WITH {_SQL_CHAT}
SELECT CAST(n_turns AS BIGINT) AS n_turns, CAST(n_chars AS BIGINT) AS n_chars, digest FROM chat""", G)
def raw_chats_without_ids(spark, sf):
    """A folder of JSON-lines and JSON documents without ids;
    every chat is one conversation again after the long form."""
    base = scratch(spark, "raw")
    chats = _chats(spark, sf).select("conv_id", _turns(role="from", text="value").alias("conversations"))
    even = chats.filter("conv_id % 2 = 0").select(F.to_json(F.struct("conversations")).alias("value"))
    odd = _dealt(chats.filter("conv_id % 2 = 1"), "conv_id").groupBy("part").agg(F.to_json(F.collect_list(F.struct("conversations"))).alias("value"))
    _named(spark, even, f"{base}/in/a", "part.jsonl")
    _named(spark, odd, f"{base}/in/b", "chats.json")
    raw = conversations.read_conversations(spark, f"{base}/in")
    turns = conversations.to_turns(raw, "idx")
    back = turns.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("turn", "from", "role", "value", "content"))).alias("conversations"))
    return _digest(back)


@register("preset_sources", f"""WITH {_SQL_CHAT},
qa AS (SELECT u.conv_id, u.text AS q, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
       WHERE u.role = 'user' AND a.role = 'assistant')
SELECT 'ultrachat' AS source, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_chars AS BIGINT) AS n_chars, digest FROM chat
UNION ALL SELECT 'hub', n_turns, n_chars, digest FROM chat
UNION ALL SELECT 'gsm8k', 2, length(q) + length(a), md5('user:' || q || chr(10) || 'assistant:' || a) FROM qa
UNION ALL SELECT 'nemotron', 2, length(q) + length(a), md5('user:' || q || chr(10) || 'assistant:' || a) FROM qa""", G)
def preset_sources(spark, sf):
    """Named presets and a hub spec over a data root."""
    base = scratch(spark, "presets")
    chats = _chats(spark, sf)
    raw = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    u = raw.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = raw.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    qa = u.join(a, ["conv_id", "turn"])
    specs = conversations.PRESETS
    at = lambda name: conversations._dataset_dir(f"{base}/root", specs[name].dataset_id, specs[name].subset, specs[name].split)
    lines = lambda df, path: _named(spark, df.select(F.to_json(F.struct("*")).alias("value")), path, "data.jsonl")
    lines(chats.select(_turns().alias("messages")), at("ultrachat"))
    lines(qa.select("question", "answer"), at("gsm8k"))
    lines(qa.select(F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"))).alias("input"), F.col("answer").alias("output")), at("nemotron"))
    lines(chats.select(_turns().alias("conversations")), f"{base}/root/own/chats/extra/held")
    out = None
    for name, source in (("ultrachat", "ultrachat"), ("gsm8k", "gsm8k"), ("nemotron", "nemotron"), ("hub", "hf:own/chats:extra:held")):
        one = _digest(conversations.read_conversations(spark, source, f"{base}/root")).select(F.lit(name).alias("source"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@register("image_chat_parts", """WITH p AS (SELECT page_id, string_split(url, '/') AS s, url FROM pages)
SELECT page_id, CAST(len(s) + 1 AS BIGINT) AS n_user_parts, CAST(1 AS BIGINT) AS n_assistant_parts, 'file://root/' || page_id || '.jpg' AS image_url,
       CAST(1 AS INTEGER) AS multimodal, CAST(2 AS BIGINT) AS n_messages
FROM p WHERE page_id % 3 = 0""", G)
def image_chat_parts(spark, sf):
    """Image turns become parts, requests get file URLs."""
    pages = table(spark, sf, "pages", "page_id", "url")
    image = F.concat(F.when(F.col("page_id") % 3 == 0, "coco/").otherwise("web/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    text = F.concat(F.lit("<image>\n"), F.regexp_replace("url", "/", "\n"))
    conv = F.array(conversations.turn_struct("user", text), conversations.turn_struct("assistant", F.lit("an answer")))
    src = conversations.coco_filter(pages.select("page_id", image.alias("image"), conv.alias("conversations")))
    done = conversations.normalize_image_chat(spark, src, "root", check_exists=False)
    done = done.withColumn("conversations", F.transform("conversations", lambda t: t.withField("parts", conversations.text_parts(t["parts"], t["content"]))))
    req = conversations.request_parts(F.col("conversations")[0]["parts"])
    sent = request_projection(done.select(F.col("page_id").alias("sample_id"), F.array().cast("array<bigint>").alias("input_ids"), "conversations"))
    own = done.select(
        "page_id",
        F.size(F.col("conversations")[0]["parts"]).cast("bigint").alias("n_user_parts"),
        F.size(F.col("conversations")[1]["parts"]).cast("bigint").alias("n_assistant_parts"),
        F.filter(req, lambda p: p["type"] == "image_url")[0]["url"].alias("image_url"),
        conversations.is_multimodal(F.col("conversations")).cast("int").alias("multimodal"),
    )
    return own.join(sent.select(F.col("sample_id").alias("page_id"), F.size("messages").cast("bigint").alias("n_messages")), "page_id")


@register("tools_parsed", """SELECT doc_id, CAST(doc_id % 5 IN (3, 4) AS INTEGER) AS parsed,
       CASE doc_id % 5 WHEN 3 THEN source WHEN 4 THEN lang END AS first_name
FROM documents""", G)
def tools_parsed(spark, sf):
    """Tools JSON; empty, null, empty list and broken text give none."""
    d = table(spark, sf, "documents", "doc_id", "source", "lang")
    k = F.pmod(F.col("doc_id"), F.lit(5))
    good = F.to_json(F.array(F.struct(F.col("source").alias("name")), F.struct(F.lit("other").alias("name"))))
    one = F.to_json(F.array(F.struct(F.col("lang").alias("name"))))
    raw = F.when(k == 0, "").when(k == 1, " [] ").when(k == 2, '[{"name": ').when(k == 3, good).otherwise(one)
    v = conversations.parse_tools(raw)
    return d.select("doc_id", v.isNotNull().cast("int").alias("parsed"), F.try_variant_get(v, "$[0].name", "string").alias("first_name"))


@register("prepared_store", f"""WITH {sql_prepared_chain()}
SELECT sample_id, CAST(seq_len AS INTEGER) AS seq_len, {sql_ids_digest('input_ids')} AS digest, CAST({sql_valid('loss_mask')} AS BIGINT) AS n_valid FROM prepared""", G)
def prepared_store(spark, sf):
    """Rows written and kept by a second write, lengths read alone."""
    path = f"{scratch(spark, 'prepared')}/rows"
    rows = prepared(spark, sf)
    write_prepared(rows, path)
    write_prepared(rows.limit(0), path)  # kept
    back = artefacts.read_prepared(spark, path).select("sample_id", ids_digest(F.col("input_ids")).alias("digest"), F.size(F.filter("loss_mask", lambda m: m)).cast("bigint").alias("n_valid"))
    return artefacts.read_lengths(spark, path).join(back, "sample_id")


@register("vocab_store", f"""WITH {sql_prepared_chain()},
{_SQL_FREQ},
{_sql_select(K_SMALL)}
SELECT draft_id, target_id, target_id - draft_id AS offset FROM d2t""", G)
def vocab_store(spark, sf):
    """Frequencies and maps written, validated, read from the cache."""
    base = scratch(spark, "vocab")
    write_frequencies(token_frequency(prepared(spark, sf)), f"{base}/freq", version="v1")
    freq = spark.read.parquet(f"{base}/freq/version=v1")
    resolve_vocab(spark, cache_dir=f"{base}/maps", freq=freq, draft_vocab_size=K_SMALL)
    d2t, t2d = resolve_vocab(spark, cache_dir=f"{base}/maps")
    validate_vocab_maps(d2t, t2d, K_SMALL, VOCAB)
    return d2t.select("draft_id", "target_id", "offset")


@register("artefact_store", """SELECT vec_id AS sample_id, CAST(len(embedding) AS BIGINT) AS n_values, CAST(vec_id % 3 <> 0 AS INTEGER) AS listed FROM embeddings""", G)
def artefact_store(spark, sf):
    """Payloads as arrays, cast on read; file names listed as ids."""
    path = f"{scratch(spark, 'artefacts')}/data"
    e = table(spark, sf, "embeddings", "vec_id", "embedding")
    e.select(F.col("vec_id").alias("sample_id"), F.array(F.col("vec_id")).alias("token_ids"), F.array("embedding").alias("hidden_states")).write.parquet(path)
    back = cast_states(artefacts.read_artefacts(spark, path), ("hidden_states",), "double")
    name = F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("hs_x"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("hs_"), F.col("vec_id").cast("string")))
    listed = artefact_index(e.select(F.concat(F.lit("store/"), name, F.lit(".safetensors")).alias("path")))
    j = back.join(listed.withColumn("_l", F.lit(1)), "sample_id", "left")
    return j.select("sample_id", F.size(F.col("hidden_states")[0]).cast("bigint").alias("n_values"), F.coalesce("_l", F.lit(0)).alias("listed"))


@register("sample_length_lookup", """SELECT 'known' AS kind, 'data/data_' || doc_id || '.pt' AS path, CAST(n_chars AS BIGINT) AS length FROM documents
UNION ALL
SELECT 'estimated', 'data/data_' || doc_id || '.pt',
       CAST(ceil((n_chars + 1) / CAST((SELECT arg_min(n_chars + 1, 'data/data_' || doc_id || '.pt') FROM documents) AS DOUBLE) * 100) AS BIGINT)
FROM documents""", G)
def sample_length_lookup(spark, sf):
    """Lengths by file name; one that is missing makes all estimated."""
    path = f"{scratch(spark, 'lengths')}/in"
    d = table(spark, sf, "documents", "doc_id", "n_chars")
    entry = F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("n_chars"))))
    _named(spark, _dealt(d, "doc_id").groupBy("part").agg(F.to_json(entry).alias("value")), path, "sample_lengths.json")
    files = d.select(F.concat(F.lit("data/data_"), F.col("doc_id").cast("string"), F.lit(".pt")).alias("path"), (F.col("n_chars").cast("bigint") + 1).alias("length"))
    known = artefacts.sample_lengths(spark, files, f"{path}/*")
    guessed = artefacts.sample_lengths(spark, files, None, first_len=100)
    return known.select(F.lit("known").alias("kind"), "path", "length").unionByName(guessed.select(F.lit("estimated").alias("kind"), "path", "length"))


def _stat(median, mean, total):
    return F.struct(F.struct(mean.cast("double").alias("mean"), median.cast("double").alias("median"), total.cast("double").alias("sum")).alias("successful"))


def _bench_file(spark, rows, path, requests=None):
    """A benchmark result document from sweep rows of one subset."""
    m = lambda c: _stat(F.col(c), F.col(c), F.col(c))
    b = F.struct(
        F.struct(F.struct(F.col("strategy").alias("type_"), F.col("target_rate").cast("double").alias("rate")).alias("strategy")).alias("config"),
        F.struct(*[m(c).alias(k) for k, c in benchmarks.METRICS_TO_EXTRACT], m("total_output_tokens").alias("output_tokens")).alias("metrics"),
    )
    doc = rows.agg(F.collect_list(b).alias("benchmarks"), F.array(F.struct(F.concat(F.lit("data/"), F.first("subset"), F.lit(".jsonl")).alias("data_files"))).alias("d"))
    _document(spark, doc.select(F.to_json(F.struct("benchmarks", F.struct(F.col("d").alias("data_args")).alias("args"))).alias("value")), path)


SUBSETS = ("sub0", "sub1", "sub2", "sub3")  # user_id mod 4, see catalog.evaluation


@register("sweep_files", f"""WITH {_SQL_EVENTS},
{_SQL_SWEEP.replace('SRC', 'ev')}
SELECT subset, strategy, target_rate, round(rps_median, 6) AS rps_median, round(latency_median_s, 6) AS latency_median_s,
       CAST(total_output_tokens AS DOUBLE) AS total_output_tokens FROM sweep""", G)
def sweep_files(spark, sf):
    """Result documents read to rows, appended to a CSV, read back."""
    base = scratch(spark, "sweeps")
    rows = _sweep(_events(spark, sf))
    for s in SUBSETS:
        _bench_file(spark, rows.filter(F.col("subset") == s), f"{base}/in/sweeps_{s}.json")
    got = benchmarks.read_sweeps(spark, f"{base}/in")
    for s in SUBSETS:
        benchmarks.write_result_rows(got.filter(F.col("subset") == s), f"{base}/out", ["acceptance_length"])
    back = spark.read.option("header", True).csv(f"{base}/out")
    num = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    return back.select("subset", "strategy", num("target_rate"), num("rps_median"), num("latency_median_s"), num("total_output_tokens"))


@register("generation_length_files", f"""WITH {_SQL_EVENTS}
SELECT subset, CAST(pow(2, ceil(log2(greatest(median(CAST(round(value * 10) AS BIGINT)), 1)))) AS BIGINT) AS max_tokens FROM ev GROUP BY subset""", G)
def generation_length_files(spark, sf):
    """Request lengths read from documents, budgets written as JSON."""
    base = scratch(spark, "genlen")
    ev = _events(spark, sf).select("event_id", "subset", F.round(F.col("value") * 10).cast("bigint").alias("output_tokens"))
    for s in SUBSETS:
        requests = F.struct(F.struct(F.collect_list(F.struct("output_tokens")).alias("successful")).alias("requests"))
        req = _dealt(ev.filter(F.col("subset") == s), "event_id").groupBy("part").agg(F.array(requests).alias("benchmarks"))
        _named(spark, req.select("part", F.to_json(F.struct("benchmarks")).alias("value")), f"{base}/in/{s}", f"gen_len_{s}.json")
    g = generation_lengths(benchmarks.read_generation_lengths(spark, f"{base}/in/*/*"))
    benchmarks.write_budget(g, f"{base}/budget")
    back = spark.read.schema("max_tokens map<string,bigint>").json(f"{base}/budget")
    return back.select(F.explode("max_tokens").alias("subset", "max_tokens"))


@register("curve_files", f"""WITH {_SQL_EVENTS},
{_SQL_SWEEP.replace('sweep AS', 'sb AS').replace('SRC', "(SELECT * FROM ev WHERE run = 'base')")},
{_SQL_SWEEP.replace('sweep AS', 'ss AS').replace('SRC', "(SELECT * FROM ev WHERE run = 'spec')")},
u AS (SELECT 'B' AS label, * FROM sb UNION ALL SELECT 'B', * FROM ss UNION ALL SELECT 'T', * FROM ss)
SELECT label, subset, round(rps_median, 6) AS x, round(latency_median_s, 6) AS y FROM u""", G)
def curve_files(spark, sf):
    """A CSV and a JSON run pooled under one label."""
    base = scratch(spark, "curves")
    rows = _sweep(_events(spark, sf), ("run", "subset", "event_type"))
    benchmarks.write_result_rows(rows.filter("run = 'base'"), f"{base}/base.csv")
    args = [f"B={base}/base.csv"]
    for s in SUBSETS:
        _bench_file(spark, rows.filter((F.col("run") == "spec") & (F.col("subset") == s)), f"{base}/spec_{s}.json")
        args.append(f"B={base}/spec_{s}.json")
        args.append(f"T={base}/spec_{s}.json")
    got = benchmarks.read_labelled(spark, args, "latency")
    return got.select("label", "subset", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("exposition_files", f"""WITH {_SQL_EVENTS},
fin AS (SELECT name, position, sum(v) AS value FROM (SELECT engine, name, position, arg_max(value, scrape) AS v FROM scr GROUP BY ALL) GROUP BY name, position)
SELECT max(CASE WHEN name = 'num_drafts' THEN value END) AS num_drafts, max(CASE WHEN name = 'num_accepted_tokens' THEN value END) AS num_accepted_tokens,
       CAST(max(position) + 1 AS BIGINT) AS n_positions FROM fin""", G)
def exposition_files(spark, sf):
    """The last scrape as text with comments, timestamps and values
    that are not numbers; every position gets a column."""
    base = scratch(spark, "scrapes")
    lines = _scrape_lines(spark, sf)
    counter = F.regexp_extract("value", r"^(\S+) ", 1)
    last = lines.withColumn("c", counter).groupBy("c").agg(F.max_by("value", "scrape").alias("value")).select(F.concat("value", F.lit(" 1704067200000")).alias("value"))
    more = spark.createDataFrame([("# HELP srv:spec_decode_num_drafts drafts",), ('srv:other{a="b"} NaN',), ("",)], "value string")
    last.unionByName(more).write.text(f"{base}/after")
    wide = acceptance_wide(acceptance_between(spark, None, f"{base}/after"), "all")
    n = len([c for c in wide.columns if c.startswith("acceptance_at_pos_")])
    return wide.select("num_drafts", "num_accepted_tokens", F.lit(n).cast("bigint").alias("n_positions"))


@register("seen_output_ids", """SELECT CAST(conv_id AS VARCHAR) AS key FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id
UNION ALL SELECT 'u-' || CAST(conv_id AS VARCHAR) FROM conversations WHERE conv_id % 2 = 1 GROUP BY conv_id""", G)
def seen_output_ids(spark, sf):
    """Ids of an output of JSON lines, broken lines skipped."""
    base = scratch(spark, "seen")
    ids = table(spark, sf, "conversations", "conv_id").distinct()
    c = F.col("conv_id").cast("string")
    line = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit('{"metadata": {"idx": '), c, F.lit("}}"))).otherwise(F.concat(F.lit('{"id": "u-'), c, F.lit('"}')))
    ids.select(F.explode(F.array(line, F.concat(F.lit('{"id": "cut-'), c))).alias("value")).write.text(base)
    return conversations.seen_ids(spark, base)


@register("training_log_files", """SELECT CAST(event_id AS BIGINT) AS step, k.key, round(CASE k.key WHEN 'train/loss' THEN value WHEN 'train/n' THEN user_id ELSE 0.5 END, 6) AS value
FROM events, (VALUES ('train/loss'), ('train/n'), ('lr')) k(key)""", G)
def training_log_files(spark, sf):
    """Nested JSON-lines records, flattened."""
    base = scratch(spark, "log")
    e = table(spark, sf, "events", "event_id", "value", "user_id")
    e.select(F.col("event_id").alias("step"), F.create_map(F.lit("loss"), F.col("value"), F.lit("n"), F.col("user_id").cast("double")).alias("train"), F.lit(0.5).alias("lr")).write.json(base)
    flat = flatten_record(artefacts.read_training_log(spark, base).select("step", "train", "lr"), ("step",))
    return flat.select("step", "key", F.round("value", 6).alias("value"))


@register("val_metric_files", """SELECT CAST(label AS INTEGER) AS epoch, 'n' AS name, CAST(count(*) AS DOUBLE) AS value FROM embeddings WHERE label IS NOT NULL GROUP BY label""", G)
def val_metric_files(spark, sf):
    """One metrics document per epoch folder (epochs: the labels)."""
    base = scratch(spark, "val")
    n = table(spark, sf, "embeddings", "label").filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    for r in n.select("label").collect():  # the ten labels
        _document(spark, n.filter(F.col("label") == r["label"]).select(F.to_json(F.struct("n")).alias("value")), f"{base}/{r['label']}/val_metrics.json")
    return artefacts.read_val_metrics(spark, base)


@register("regen_source_files", """SELECT text AS prompt, 'prompt' AS field FROM conversations WHERE role = 'user'""", G)
def regen_source_files(spark, sf):
    """A registered regeneration source, read with its prompt field."""
    base = scratch(spark, "regensrc")
    users = table(spark, sf, "conversations", "role", "text").filter("role = 'user'")
    users.select(F.col("text").alias("prompt")).write.json(f"{base}/HuggingFaceH4/ultrachat_200k/train_sft")
    df, field = read_regen_source(spark, "ultrachat", base)
    return df.select(F.col(field).alias("prompt"), F.lit(field).alias("field"))


@register("legacy_files", """SELECT DISTINCT 'data_' || label || '.pt' AS name FROM embeddings WHERE label IS NOT NULL""", G)
def legacy_files(spark, sf):
    """The files of a folder tree whose names end in ``pt``."""
    base = scratch(spark, "legacy")
    labels = table(spark, sf, "embeddings", "label").filter("label IS NOT NULL").distinct()
    for r in labels.collect():  # the ten labels
        one = labels.filter(F.col("label") == r["label"]).select(F.col("label").cast("string").alias("value"))
        _document(spark, one, f"{base}/in/{r['label']}/data_{r['label']}.pt")
        _document(spark, one, f"{base}/in/{r['label']}/notes.txt")
    return artefacts.legacy_sample_files(spark, f"{base}/in").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"))
