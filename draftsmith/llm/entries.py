"""Queries of this package over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from draftsmith.llm.alignment import alignment_counts
from draftsmith.llm.bpe import encode_documents, ids_digest, tokenizer_file
from draftsmith.llm.knn import knn_join
from draftsmith.llm.language import fold, identify
from draftsmith.llm.language import train as language_train
from draftsmith.llm.lines import MIN_WORDS, dedup_lines
from draftsmith.llm.mixing import SEED as MIX_SEED
from draftsmith.llm.mixing import mix_sources
from draftsmith.llm.prefix_trie import rebuilt_trie
from draftsmith.llm.quality import quality_scores
from draftsmith.llm.simhash import hex_fingerprint, simhash_components
from draftsmith.llm.surrogates import replace_entities
from draftsmith.llm.token_counts import token_counts
from draftsmith.llm.toxicity import score as toxicity_score
from draftsmith.llm.toxicity import train as toxicity_train
from draftsmith.llm.wrapper import extract_main_text
from draftsmith.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@register()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"))
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return s.select("doc_id", *[F.col(f"m.{c}").alias(c) for c in measures], "base_failed", "kept", "p_good")


_WS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@register(f"""WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM documents),
t AS (SELECT doc_id, pos, raw, trim(raw, {_WS}) AS line, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS w FROM l),
n AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM t WHERE w > 0),
win AS (
  SELECT doc_id, pos AS s, max(pos) OVER f AS e, sum(w) OVER f AS words, list(line) OVER f AS k
  FROM n WINDOW f AS (PARTITION BY doc_id ORDER BY after - w RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION ALL
  SELECT doc_id, min(pos) OVER b, pos, sum(w) OVER b, list(line) OVER b
  FROM n WINDOW b AS (PARTITION BY doc_id ORDER BY after RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
first AS (SELECT k, min({{'d': doc_id, 's': s, 'e': e}}) AS f FROM win WHERE words >= {MIN_WORDS} GROUP BY k),
cut AS (SELECT DISTINCT doc_id, unnest(generate_series(s, e)) AS pos FROM win JOIN first USING (k)
        WHERE words >= {MIN_WORDS} AND (doc_id > f.d OR s > f.e)),
kept AS (SELECT t.doc_id, string_agg(raw, chr(10) ORDER BY t.pos) FILTER (WHERE cut.pos IS NULL) AS text,
                count(cut.pos) AS cut_lines
         FROM t LEFT JOIN cut ON cut.doc_id = t.doc_id AND cut.pos = t.pos GROUP BY t.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CAST(coalesce(cut_lines, 0) AS BIGINT) AS cut_lines
FROM documents d LEFT JOIN kept USING (doc_id)""")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))


@register()
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


@register()
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return x.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        ids_digest(F.col("token_ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@register(f"""WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
s AS (SELECT sum(sqrt(CAST(n AS DOUBLE))) AS sw, CAST(sum(n) AS DOUBLE) AS sn FROM n),
r AS (SELECT source, sn * sqrt(CAST(n AS DOUBLE)) / sw / n AS rate FROM n, s),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
l AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
d AS (
  SELECT d.*, l.cs, (CAST(CAST('0x' || substr(md5('{MIX_SEED}:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN l ON d.source IS NOT DISTINCT FROM l.source),
x AS (SELECT * EXCLUDE (cs, u), unnest(generate_series(1, len(list_filter(cs, lambda c: c <= u)))) AS copy FROM d)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
       CAST('0x' || substr(md5('{MIX_SEED}:' || doc_id || ':' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM x""")
def op10_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@register()
def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents", "doc_id", "text"))


@register()
def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity_train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity_score(docs, model)


@register()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))


@register("""WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""")
def op5_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return knn_join(data.where(F.col("vec_id") % 20 == 0), data, k=20, scale=64)


@register()
def op6_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return x.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "has_template")


@register()
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_train(docs.where(fold() != 1))
    found = identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")


_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END))), CAST(4294967295 AS BIGINT))"""


@register(f"""WITH k AS (
  SELECT conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, key, w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS pos FROM k),
s AS (SELECT conv_id, max(pos) AS size FROM t GROUP BY conv_id),
c AS (SELECT s.conv_id, h, b.conv_id AS base, least(h, coalesce(b.size, 0)) AS taken
      FROM (SELECT conv_id, {_CRC} % 4 AS h FROM s) s LEFT JOIN s AS b ON b.conv_id = s.conv_id - s.conv_id % 20),
r AS (SELECT conv_id, pos - h + taken AS pos, key, w FROM t JOIN c USING (conv_id) WHERE pos > h
      UNION ALL SELECT c.conv_id, pos, key, w FROM t JOIN c ON t.conv_id = c.base WHERE pos <= taken),
p AS (SELECT conv_id, 0 AS pos, '' AS pk, 0 AS w FROM c
      UNION ALL SELECT conv_id, pos, md5(string_agg(key, ',') OVER (PARTITION BY conv_id ORDER BY pos)), w FROM r),
n AS (SELECT pos AS depth, pk, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w FROM p GROUP BY pos, pk),
m AS (SELECT n.*, u.conv_id AS parent FROM n LEFT JOIN p ON p.conv_id = n.conv_id AND p.pos = n.depth - 1
      LEFT JOIN n AS u ON u.depth = p.pos AND u.pk = p.pk),
d AS (SELECT depth - 1 AS depth, parent, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
v AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN d ON d.depth = m.depth AND d.parent = m.conv_id),
g AS (SELECT p.pos AS depth, p.pk, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved
      FROM v JOIN p ON p.conv_id = v.conv_id AND p.pos <= v.depth GROUP BY p.pos, p.pk),
e AS (SELECT pos AS depth, pk, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ids
      FROM (SELECT * FROM p QUALIFY pos = max(pos) OVER (PARTITION BY conv_id)) GROUP BY pos, pk)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, v.parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ids, sha256('')) AS ends_sha256
FROM v JOIN g USING (depth, pk) LEFT JOIN e USING (depth, pk)""")
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@register()
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@register()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
