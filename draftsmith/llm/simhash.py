"""SimHash near-duplicates by a binary trie self-join.

A text is lower-cased (A-Z), cut into words and ``shingle``-word shingles; a
fingerprint bit is set when it is set in over half of the shingles' XXH64
hashes.  Two texts are near-duplicates when their fingerprints differ in at
most ``max_bits`` bits; components are taken over all texts.

Method.  The distinct fingerprints form a binary trie: a node is a prefix, and
in a sorted array a contiguous range.  The trie is joined with itself by
walking pairs of nodes down together, adding one for each level where the two
differ and dropping the pair once the sum exceeds ``max_bits``.

On Spark the walk is dealt out below chosen bits: the 64 bits are split into
``blocks`` blocks, and a pair that differs in at most ``max_bits`` bits agrees
on at least ``blocks - max_bits`` of them.  For each choice of that many blocks
the fingerprints are hashed by their bits there and every group of equal bits
is one sub-trie, walked with the whole error budget on the other bits; all
groups of a partition are walked at once with numpy.  A pair may be found below
several choices, never below none, so the join is exact.  A group's links leave
the task as one star per local component (a row per fingerprint at most, no
pairs), and the stars are united by ``components``.

Only fingerprints and ids are shuffled until the result; copies of a text share
a fingerprint and are one trie leaf, so a group of copies costs one entry.

Defined results: null and empty texts have fingerprint zero and link like any
other; texts of fewer than ``shingle`` words are one shingle; repeated rows
link with each other; a null id sorts after all others and a component of null
ids alone has a null id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.llm.components import components
from draftsmith.session import checkpoint_dir

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 6
SEED = 42
_STEP = 1 << 16  # shingles hashed, and node pairs walked, at a time
_NO_ID = (1 << 63) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint (unsigned) of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    first, last = starts[:n], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _STEP):
        h = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + _STEP].tolist(), last[at : at + _STEP].tolist())]
        bits = np.unpackbits(np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int((2 * ones > n) @ (1 << np.arange(64, dtype=np.uint64)))


def _fingerprints(shingle: int):
    @F.arrow_udf(T.LongType())
    def fp(text: pa.Array) -> pa.Array:
        got = [fingerprint(t, shingle) for k in range(0, len(text), 256) for t in text.slice(k, 256).to_pylist()]
        return pa.array(np.array(got, dtype=np.uint64).view(np.int64))

    return fp


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """One 64-bit mask for each choice of ``blocks - max_bits`` blocks."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("blocks must exceed max_bits")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in pick) for pick in combinations(range(blocks), blocks - max_bits)]


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indices over edges a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def trie_links(v: np.ndarray, starts: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (index pairs) within each group of ``v``.

    ``v`` (uint64) is sorted and distinct inside each group; ``starts`` are the
    group bounds.  Links are reduced to one star per local component on the
    way, so what is held stays in proportion to ``v``.
    """
    n = len(v)
    root = np.arange(n)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def settle() -> None:
        nonlocal root, held, n_held
        if held:
            a = np.concatenate([x for x, _ in held] + [np.arange(n)])
            b = np.concatenate([y for _, y in held] + [root])
            root, held, n_held = _local_roots(n, a, b), [], 0

    lo, hi = starts[:-1], starts[1:]
    big = hi - lo > 1
    lo, hi = lo[big], hi[big]
    ones: dict[int, np.ndarray] = {}

    def split(bit: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum(((v >> np.uint64(bit)) & np.uint64(1)).astype(np.int32)))).astype(np.int32)
        return hi - (ones[bit][hi] - ones[bit][lo])

    stack = [(63, lo, hi, lo.copy(), hi.copy(), np.zeros(len(lo), dtype=np.int8))]
    while stack:
        bit, al, ah, bl, bh, err = stack.pop()
        if len(al) > 4 * _STEP:  # depth first: what waits is bounded by the depth
            mid = len(al) // 2
            stack.append((bit, al[mid:], ah[mid:], bl[mid:], bh[mid:], err[mid:]))
            stack.append((bit, al[:mid], ah[:mid], bl[:mid], bh[:mid], err[:mid]))
            continue
        # two leaves: compare all bits at once
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            x, y = al[leaf], bl[leaf]
            near = (x != y) & (np.bitwise_count(v[x] ^ v[y]) <= max_bits)
            x, y = x[near], y[near]
            other = root[x] != root[y]
            if other.any():
                held.append((x[other], y[other]))
                n_held += int(other.sum())
                if n_held > 8 * _STEP:
                    settle()
            al, ah, bl, bh, err = (z[~leaf] for z in (al, ah, bl, bh, err))
        if bit < 0 or not len(al):
            continue
        am, bm = split(bit, al, ah), split(bit, bl, bh)
        own = al == bl
        more = err + np.int8(1)
        parts = (
            (al, am, bl, bm, err, None),
            (am, ah, bm, bh, err, None),
            (al, am, bm, bh, more, None),
            (am, ah, bl, bm, more, ~own),  # of a node with itself, the crossed pair once
        )
        out = []
        for l1, h1, l2, h2, e, where in parts:
            ok = (h1 > l1) & (h2 > l2) & (e <= max_bits) & ((l1 != l2) | (h1 - l1 > 1))
            if where is not None:
                ok &= where
            out.append([z[ok] for z in (l1, h1, l2, h2, e)])
        nxt = [np.concatenate(z) for z in zip(*out)]
        if len(nxt[0]):
            stack.append((bit - 1, *nxt))
    settle()
    child = np.flatnonzero(root != np.arange(n))
    return child, root[child]


def near_links(fps: DataFrame, *, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Distinct fingerprints ``fp`` (long) to links ``(a, b)`` that connect
    exactly those at ``max_bits`` or fewer differing bits (as components)."""
    masks = block_masks(blocks, max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(signed)])
    dealt = fps.select("fp", F.explode(keys).alias("x")).select("fp", "x.c", "x.k").repartition("c", "k")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [(p["c"].to_numpy(np.int64), p["k"].to_numpy(np.int64), p["fp"].to_numpy(np.int64)) for p in parts]
        if not got:
            return
        c, k, v = (np.concatenate(x) for x in zip(*got))
        got.clear()
        u = v.view(np.uint64)
        order = np.lexsort((u, k, c))  # within a group the masked bits agree, so this is trie order
        c, k, u = c[order], k[order], u[order]
        new = np.concatenate(([True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])))
        starts = np.append(np.flatnonzero(new), len(u))
        a, b = trie_links(u, starts, max_bits)
        v = u.view(np.int64)
        yield pd.DataFrame({"a": v[a], "b": v[b]}).drop_duplicates()

    return dealt.mapInPandas(walk, "a long, b long")


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``text_key`` (hash of the text),
    ``fp`` (long), ``root`` (smallest fingerprint of the component) and
    ``component_id`` (smallest id reachable, itself included)."""
    checkpoint_dir(docs.sparkSession)
    text = F.col(text_col)
    own = docs.select(F.coalesce(F.col(id_col), F.lit(_NO_ID)).cast("long").alias("id"), F.xxhash64(text).alias("text_key"), _fingerprints(shingle)(text).alias("fp"))
    own = own.checkpoint()  # ids and fingerprints only; the texts are hashed once
    classes = own.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(near_links(classes.select("fp"), max_bits=max_bits, blocks=blocks))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = rooted.checkpoint()
    # written first, so that both sides of the joins are plain exchanges, which AQE splits at a hot root
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id")).checkpoint()
    by_fp = rooted.join(named, "root").select("fp", "root", "component_id").checkpoint()
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return own.join(by_fp, "fp").select(real("id").alias(id_col), "text_key", "fp", "root", real("component_id").alias("component_id"))


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` with the smallest id (then text hash) of their
    component, one row each; columns unchanged."""
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(names)])
    did, text = (F.col(f"__d{names.index(c)}") for c in (id_col, text_col))
    found = simhash_components(hidden, id_col=f"__d{names.index(id_col)}", text_col=f"__d{names.index(text_col)}", **kw)
    i = F.coalesce(F.col(f"__d{names.index(id_col)}"), F.lit(_NO_ID)).cast("long").alias("__i")
    one = found.select(i, F.col("text_key").alias("__t"), "root")
    kept = one.groupBy("root").agg(F.min(F.struct("__i", "__t")).alias("k")).select("k.*")
    keyed = hidden.withColumn("__i", F.coalesce(did, F.lit(_NO_ID)).cast("long")).withColumn("__t", F.xxhash64(text))
    rows = keyed.join(kept, ["__i", "__t"], "left_semi").dropDuplicates(["__i", "__t"])
    return rows.select(*[F.col(f"__d{i}").alias(c) for i, c in enumerate(names)])
