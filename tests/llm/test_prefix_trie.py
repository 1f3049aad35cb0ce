import hashlib
import random
import re
import zlib

import duckdb

from draftsmith.llm import entries
from draftsmith.llm import prefix_trie as P
from tests.conftest import SF_SMALL

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def plain_turns(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0), digest(role, text), role, text))
    return {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    """One node per distinct prefix, by a plain walk."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    rows = []
    below = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves, saved = 0 if p in kids else 1, (len(members[p]) - 1) * words
        for k in kids.get(p, ()):
            leaves, saved = leaves + below[k][0], saved + below[k][1]
        below[p] = leaves, saved
        ends = ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
        rows.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, ())), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLS) for r in df.collect()), key=str)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(entries.QUERIES["op12_conversation_trie"](spark, SF_SMALL)) == plain_trie(plain_rebuilt(plain_turns(rows)))


def made(seed, n_convs, longest, words=2):
    rng = random.Random(seed)
    rows = []
    for c in range(n_convs):
        n = rng.randint(1, longest)
        turns = [(c, i, rng.choice(["user", "assistant"]) if rng.random() < 0.2 else "user", " ".join(rng.choice("ab") for _ in range(rng.randint(0, words)))) for i in range(n)]
        rows += turns
    rng.shuffle(rows)
    return rows


def test_random_tries_of_many_depths(spark):
    for seed, longest in ((1, 1), (2, 2), (3, 5), (4, 13)):
        rows = made(seed, 60, longest)
        got = P.conversation_trie(spark.createDataFrame(rows, SCHEMA))
        assert rows_of(got) == plain_trie(plain_turns(rows)), longest


def test_long_conversations_that_share_most_turns(spark):
    long = [(c, i, "user", f"t{i} x") for c in (0, 1, 2, 700) for i in range(70 - c % 7)] + [(3, 0, "user", "t0 x"), (4, 0, "user", "other")]
    got = P.conversation_trie(spark.createDataFrame(long, SCHEMA))
    assert rows_of(got) == plain_trie(plain_turns(long))


def test_nulls_ties_repeats_negative_ids_and_clashing_columns(spark):
    rows = [
        (5, None, None, None),
        (5, None, None, None),  # a repeated row is a turn of its own
        (5, 0, "user", " \t\x0bone  two\n"),
        (5, 0, "user", "tie"),
        (6, 0, "", ""),
        (6, None, "", None),
        (6, 3, "user", "x" * 100_000),
        (None, 0, "user", "lost"),
        (-25, 1, "user", "a"),
        (-25, -1, "user", "b"),
        (7, 9, "u", "ser"),
        (8, 9, "us", "er"),
    ]
    clash = ["conv", "pos", "k1", "seq", "a", "root", "w", "n"]
    df = spark.createDataFrame([r + ("z",) * len(clash) for r in rows], SCHEMA + "".join(f", {c} string" for c in clash))
    assert rows_of(P.conversation_trie(df)) == plain_trie(plain_turns(rows))


def test_rebuilt_without_base_or_turns(spark):
    lone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    based = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(lone, i, "user", f"t{i}") for i in range(2)]  # no base, fewer turns than cut: empty
    rows += [(40, 0, "user", "only one")] + [(based, i, "user", f"t{i}") for i in range(4)]
    got = rows_of(P.rebuilt_trie(spark.createDataFrame(rows, SCHEMA)))
    convs = plain_rebuilt(plain_turns(rows))
    assert convs[lone] == [] and len(convs[based]) == 3
    assert got == plain_trie(convs)
    only = rows_of(P.rebuilt_trie(spark.createDataFrame(rows[:2], SCHEMA)))
    assert only == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_empty_table(spark):
    assert P.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_conversation_over_many_partitions(spark):
    rows = [(1, i // 3, "user", f"t{i % 7}") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = P.numbered(P.turn_keys(spark.createDataFrame(rows, SCHEMA))).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = [int(digest(r, t)[:15], 16) for r, t in plain_turns(rows)[1]]
    assert [r.k1 for r in got] == want and [r.pos for r in got] == list(range(1, 401))


def test_ends_digest_over_many_blocks(spark):
    rows = [(c * 3, 0, "user", "same") for c in range(1000)]
    got = rows_of(P.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain_trie(plain_turns(rows))


def test_crc_of_the_oracle():
    ids = [0, 7, 19, 20, 12345, -25, 10**15]
    got = duckdb.sql(f"SELECT conv_id, {entries._CRC} AS h FROM (SELECT unnest({ids}) AS conv_id)").fetchall()
    assert got == [(i, zlib.crc32(str(i).encode())) for i in ids]
