import random
import re

import numpy as np
import xxhash

from draftsmith.llm import simhash as S
from draftsmith.llm.components import components
from draftsmith.llm import entries
from tests.conftest import SF_SMALL
from tests.llm.helpers import PROSE, docs_frame, long_text


def plain_fp(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, ids, bits):
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_fingerprint():
    for t in ["", None, "One", "one two three", PROSE, PROSE.upper(), "é É x\x0bY z " * 9, long_text(70_000)]:
        assert S.fingerprint(t) == plain_fp(t)


def test_op7_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()}
    got = entries.QUERIES["op7_simhash_near_dedup"](spark, SF_SMALL).collect()
    ids = sorted(texts)
    fps = [plain_fp(texts[i]) for i in ids]
    want = dict(zip(ids, zip(fps, plain_components(fps, ids, 4))))
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == want
    assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in got)


def test_trie_links_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for b in base for k in range(1, 7)]
    v = np.unique(np.concatenate([base, np.array(near, dtype=np.uint64), np.arange(300, dtype=np.uint64)]))
    a, b = S.trie_links(v, np.array([0, len(v)]), 4)
    root = {i: i for i in range(len(v))}
    root.update(zip(a.tolist(), b.tolist()))
    assert [root[i] for i in range(len(v))] == plain_components(v.tolist(), list(range(len(v))), 4)


def test_near_links_across_groups(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.add(x)
        for k in (2, 4, 5):
            y = x
            for bit in rng.sample(range(64), k):
                y ^= 1 << bit
            fps.add(y)
    fps = sorted(fps)
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    links = S.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    roots = {r.node: r.root for r in components(links).collect()}
    comp = plain_components(fps, list(range(len(fps))), 4)
    for i in range(len(fps)):
        for j in range(i):
            same = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert same == (comp[i] == comp[j])


def test_components_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7), (50, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 90, 90: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    rows = [(9, None), (8, ""), (7, " \n"), (5, PROSE), (5, PROSE), (6, PROSE + " x"), (None, PROSE), (None, long_text(40)), (3, long_text(90_000)), (4, "a b")]
    docs = docs_frame(spark, rows, extra=True)
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_components(docs).collect()), key=str)
    assert len(got) == len(rows)
    assert {c for d, c in got if d in (7, 8, 9)} == {7}
    assert {c for d, c in got if d == 5} == {5}
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    fps = {d: plain_fp(t) for d, t in rows if d is not None}
    linked6 = bin(fps[5] ^ fps[6]).count("1") <= 4
    assert ids == sorted([3, 4, 5, 7, None] + ([] if linked6 else [6]), key=str)
    assert S.keep_one(docs.limit(0)).count() == 0
