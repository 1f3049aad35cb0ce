"""Packing and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from draftsmith.catalog import register
from draftsmith.catalog.derived import SEED, prepared, sql_prepared_chain
from draftsmith.functions.hashing import sql_md5_int, sql_seeded_key
from draftsmith.operators.packing import LEVELS, clip_or_drop, pack_batches, pack_running_sums, pack_summary, skip_batches
from draftsmith.operators.sampling import cod_sample_rows

G = "sampling"
PACK_LEN = 2048
REPLICAS = 2
PACK_SHARDS = 4  # of the running sums; the tables are small, the default is for large ones
COD_DEPTHS = 4
COD_RATIO = 0.7
COD_MIN = 0.2


def _lengths(spark, sf):
    return prepared(spark, sf).select("sample_id", F.col("seq_len").cast("bigint").alias("length"))


@register("clip_or_drop_long", f"""WITH {sql_prepared_chain()}
SELECT sample_id, CAST(least(seq_len, {PACK_LEN}) AS BIGINT) AS clipped, CAST(seq_len > {PACK_LEN} AS INTEGER) AS is_long
FROM prepared""", G)
def clip_or_drop_long(spark, sf):
    lens = _lengths(spark, sf)
    clipped = clip_or_drop(lens, PACK_LEN, True).withColumnRenamed("length", "clipped")
    return clipped.join(lens.select("sample_id", (F.col("length") > PACK_LEN).cast("int").alias("is_long")), "sample_id")


def _sql_running_plan(seed: int) -> str:
    """CTEs up to ``plan(batch_no, replica, sample_id, length, item)``."""
    over = "PARTITION BY shard ORDER BY key, sample_id"
    parts = [f"""k0 AS (SELECT sample_id, CAST(least(seq_len, {PACK_LEN}) AS BIGINT) AS length, {sql_seeded_key(seed, 'sample_id')} AS key FROM prepared),
b0 AS (SELECT *, key % {PACK_SHARDS} AS shard, CAST(NULL AS INTEGER) AS level, CAST(NULL AS BIGINT) AS cut FROM k0)"""]
    for k in range(LEVELS):
        parts.append(f"""e{k} AS (SELECT *, sum(CASE WHEN level IS NULL THEN length ELSE 0 END) OVER ({over} ROWS UNBOUNDED PRECEDING) AS en FROM b{k}),
f{k} AS (SELECT *, (en - length) // {PACK_LEN} AS mark, level IS NULL AND greatest(en - 1, en - length) // {PACK_LEN} = (en - length) // {PACK_LEN} AS inside FROM e{k}),
b{k + 1} AS (SELECT sample_id, length, key, shard, CASE WHEN inside THEN {k} ELSE level END AS level, CASE WHEN inside THEN mark ELSE cut END AS cut FROM f{k})""")
    parts.append(f"""own AS (SELECT sample_id, length, shard, coalesce(level, {LEVELS}) AS level,
  CASE WHEN level IS NULL THEN sum(CASE WHEN level IS NULL THEN 1 ELSE 0 END) OVER ({over} ROWS UNBOUNDED PRECEDING) - 1 ELSE cut END AS cut,
  row_number() OVER ({over}) - 1 AS item FROM b{LEVELS}),
dense AS (SELECT *, dense_rank() OVER (ORDER BY shard, level, cut) - 1 AS bin FROM own),
plan AS (SELECT CAST(bin // {REPLICAS} AS BIGINT) AS batch_no, CAST(bin % {REPLICAS} AS INTEGER) AS replica, sample_id, length, CAST(item AS BIGINT) AS item
  FROM dense WHERE bin < (SELECT (max(bin) + 1) // {REPLICAS} * {REPLICAS} FROM dense))""")
    return ",\n".join(parts)


def _sql_plan(seed: int) -> str:
    """CTEs up to ``plan(batch_no, replica, sample_id, length, item)``: best-fit-
    decreasing sample by sample, bins dealt to batches by the seeded stride."""
    hit = "coalesce(list_position(rooms, list_min(list_filter(rooms, lambda x: x >= size))), 0)"
    return f"""k0 AS (SELECT sample_id, CAST(least(seq_len, {PACK_LEN}) AS BIGINT) AS length, {sql_seeded_key(seed, 'sample_id')} AS key FROM prepared),
ordered AS (SELECT *, greatest(length, 1) AS size, row_number() OVER (ORDER BY greatest(length, 1) DESC, key, sample_id) - 1 AS item FROM k0),
fitted AS (
  SELECT CAST(-1 AS BIGINT) AS item, CAST([] AS BIGINT[]) AS rooms, CAST(0 AS BIGINT) AS bin
  UNION ALL
  SELECT item,
         CASE WHEN hit = 0 THEN list_append(rooms, {PACK_LEN} - size) ELSE list_transform(rooms, lambda x, i: CASE WHEN i = hit THEN x - size ELSE x END) END,
         CASE WHEN hit = 0 THEN len(rooms) ELSE hit - 1 END
  FROM (SELECT ordered.item, size, rooms, {hit} AS hit FROM fitted JOIN ordered ON ordered.item = fitted.item + 1)),
counted AS (SELECT max(bin) + 1 AS bins FROM fitted),
step AS (SELECT bins, (SELECT min(s) FROM unnest(range(greatest(1, CAST(floor(bins * {0.6180339887 + 0.01 * (seed % 7)!r}) AS BIGINT)), 2 * bins + 2)) AS u(s) WHERE gcd(s, bins) = 1) AS step FROM counted),
dealt AS (SELECT ordered.*, (bin * step + {seed * 7919} % bins) % bins AS slot, bins FROM ordered JOIN fitted USING (item), step),
plan AS (SELECT CAST(slot // {REPLICAS} AS BIGINT) AS batch_no, CAST(slot % {REPLICAS} AS INTEGER) AS replica, sample_id, length, CAST(item AS BIGINT) AS item
  FROM dealt WHERE slot < bins // {REPLICAS} * {REPLICAS})"""


@register("pack_running_sums", f"""WITH {sql_prepared_chain()},
{_sql_running_plan(SEED)}
SELECT * FROM plan""", G)
def pack_running_sums_q(spark, sf):
    return pack_running_sums(_lengths(spark, sf), PACK_LEN, REPLICAS, seed=SEED, shards=PACK_SHARDS)


@register("pack_batches", f"""WITH RECURSIVE {sql_prepared_chain()},
{_sql_plan(SEED)}
SELECT * FROM plan""", G)
def pack_batches_q(spark, sf):
    return pack_batches(_lengths(spark, sf), PACK_LEN, REPLICAS, seed=SEED)


@register("pack_summary", f"""WITH RECURSIVE {sql_prepared_chain()},
{_sql_plan(SEED)},
p AS (SELECT CAST(count(*) AS BIGINT) AS n_packed, CAST(sum(length) AS BIGINT) AS used_tokens, CAST(max(batch_no) + 1 AS BIGINT) AS n_batches FROM plan),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_samples, CAST(count(*) FILTER (WHERE seq_len > {PACK_LEN}) AS BIGINT) AS n_long FROM prepared)
SELECT n_samples, n_packed, n_samples - n_packed AS n_dropped, n_long, n_batches, used_tokens,
       n_batches * {REPLICAS * PACK_LEN} AS capacity, CAST(used_tokens AS DOUBLE) / (n_batches * {REPLICAS * PACK_LEN}) AS fill_ratio
FROM p, s""", G)
def pack_summary_q(spark, sf):
    lens = _lengths(spark, sf)
    return pack_summary(pack_batches(lens, PACK_LEN, REPLICAS, seed=SEED), lens, PACK_LEN, REPLICAS)


@register("resume_skip_batches", f"""WITH RECURSIVE {sql_prepared_chain()},
{_sql_plan(SEED + 1)}
SELECT * FROM plan WHERE batch_no >= 3""", G)
def resume_skip_batches(spark, sf):
    return skip_batches(pack_batches(_lengths(spark, sf), PACK_LEN, REPLICAS, seed=SEED, epoch=1), 3)


def _sql_cod(select: str | None = None) -> str:
    parts = [
        sql_prepared_chain(),
        """valid AS (
  SELECT sample_id, seq_len, pos FROM (
    SELECT sample_id, len(input_ids) AS seq_len, UNNEST(loss_mask) AS m, UNNEST(range(len(loss_mask))) AS pos FROM prepared)
  WHERE m
)""",
        "nseed AS (SELECT sample_id, count(*) AS n_seed FROM valid GROUP BY sample_id)",
        "prev1 AS (SELECT sample_id, seq_len, pos FROM valid)",
    ]
    outs = ["SELECT sample_id, 0 AS depth, UNNEST(range(len(input_ids))) AS anchor FROM prepared"]
    for d in range(1, COD_DEPTHS):
        r = max(COD_RATIO**d, COD_MIN)
        key = sql_md5_int(f"'{SEED}' || ':' || CAST(p.sample_id AS VARCHAR) || ':{d}:' || CAST(p.pos AS VARCHAR)")
        parts.append(f"""samp{d} AS (
  SELECT sample_id, seq_len, pos FROM (
    SELECT p.sample_id, p.seq_len, p.pos, floor(greatest(n.n_seed - {d}, 0) * CAST('{r!r}' AS DOUBLE)) AS sz,
           count(*) OVER (PARTITION BY p.sample_id) AS cnt,
           row_number() OVER (PARTITION BY p.sample_id ORDER BY {key}, p.pos) AS rn
    FROM prev{d} p JOIN nseed n ON n.sample_id = p.sample_id)
  WHERE sz > 0 AND (cnt < sz OR rn <= sz)
)""")
        parts.append(f"""prev{d + 1} AS (
  SELECT s.sample_id, s.seq_len, (s.pos + 1) % s.seq_len AS pos FROM samp{d} s
  WHERE (s.pos + 1) % s.seq_len <> 0
    AND EXISTS (SELECT 1 FROM valid v WHERE v.sample_id = s.sample_id AND v.pos = (s.pos + 1) % s.seq_len)
)""")
        outs.append(f"SELECT sample_id, {d} AS depth, pos - {d} AS anchor FROM samp{d} WHERE pos - {d} >= 0")
    body = ",\n".join(parts)
    union = "\nUNION ALL\n".join(outs)
    final = select or """SELECT sample_id, CAST(depth AS INTEGER) AS depth, CAST(count(*) AS BIGINT) AS n, CAST(sum(anchor) AS BIGINT) AS sum_anchor,
       CAST(min(anchor) AS BIGINT) AS min_anchor, CAST(max(anchor) AS BIGINT) AS max_anchor
FROM allx GROUP BY sample_id, depth"""
    return f"""WITH {body},
allx AS ({union})
{final}"""


@register("cod_sampling", _sql_cod(), G)
def cod_sampling(spark, sf):
    s = cod_sample_rows(prepared(spark, sf), COD_DEPTHS, COD_RATIO, COD_MIN, seed=SEED)
    return s.groupBy("sample_id", F.col("depth").cast("int").alias("depth")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("anchor").cast("bigint").alias("sum_anchor"),
        F.min("anchor").cast("bigint").alias("min_anchor"),
        F.max("anchor").cast("bigint").alias("max_anchor"),
    )


@register("training_batches", f"""WITH RECURSIVE {sql_prepared_chain()},
{_sql_plan(SEED)},
d AS (SELECT batch_no, replica, item, loss_mask, greatest(len(input_ids) - 1, 0) AS n FROM plan JOIN prepared USING (sample_id)),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY batch_no, replica ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM d),
k AS (SELECT *, least(n, {PACK_LEN} - st) AS kept FROM o WHERE st < {PACK_LEN}),
c AS (SELECT *, len(list_filter(range(CAST(kept AS BIGINT)), lambda j: loss_mask[j + 2] AND st + j <= {PACK_LEN - 4})) AS open FROM k)
SELECT batch_no, replica, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(kept) AS BIGINT) AS used_tokens,
       CAST(least(sum(open), 4) AS BIGINT) AS n_anchors
FROM c GROUP BY batch_no, replica""", G)
def training_batches(spark, sf):
    """Examples plan end to end on the prepared conversations: packing plan →
    shift (X4) → collated batch rows with anchors and blocks."""
    from draftsmith.plans.examples import build_training_batches

    b = build_training_batches(prepared(spark, sf), PACK_LEN, REPLICAS, seed=SEED, step="shift", anchors=(4, 3, 131072))
    return b.select(
        "batch_no", "replica",
        F.size("lengths").cast("bigint").alias("n_docs"),
        F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("used_tokens"),
        F.size(F.filter("anchors", lambda a: a["anchor_valid"])).cast("bigint").alias("n_anchors"),
    )
