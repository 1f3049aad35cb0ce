"""Alignment of two tokenizers over the same texts by interval coalescing.

Both tokenizers cut the bytes of space + text into tokens.  All tokens of both
sides are sorted by start (``lexsort``), the running maximum of their ends is
taken (``maximum.accumulate``), and a group breaks where a start reaches that
maximum: there tokens of both sides end.  Within the groups the overlapping
pairs are expanded from each A token's range of B tokens.  Many documents are
laid end to end, so one pass over arrays serves all of them.

An id pair's count is the number of documents in which it is linked.

On Spark: one Arrow pass encodes each text once and writes blocks of about
``BLOCK`` characters: per document its numbers, and per block its distinct id
pairs with the number of its documents that hold each, plus the documents'
pairs as positions in that list.  Only the lists of pairs are shuffled: counts
by pair (partial sums first), the highest count per A id, and back to the
blocks, where the documents' sums are formed.  A pair is at most one row per
block, so frequent pairs are no hot keys; nothing is broadcast but the two
vocabularies.  The blocks are written once below the shared checkpoint folder.

Defined results: strings of special tokens in a text are plain text; null and
empty texts, and texts whose joined A or B bytes are not space + text (as when
a text holds U+2581, which B reads as a space), have no tokens: zeros and an
empty digest; repeated rows and repeated ids are documents of their own, each
with its own row; a null id stays null; columns other than id and text are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.llm.bpe import byte_chars
from draftsmith.session import checkpoint_dir

BLOCK = 1 << 22  # characters of a block
_BLOCK_DOCS = 1 << 14
_PART = 1 << 18  # characters encoded and aligned at a time
_PIECE = 1 << 20  # characters of one call of a tokenizer
# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")  # no token of either side spans such a place
_RUN = 4096
_LONG_RUN = regex.compile(rf"\s{{{_RUN}}}")
_BYTE_PIECE = regex.compile(r"<0x([0-9A-F]{2})>")


class TwoTokenizers:
    """A: a tokenizers JSON file (byte-level BPE); B: a sentencepiece model that
    puts a space in front of the text.

    Where A's ids follow its merges (as those of public vocabularies do), tiktoken
    encodes over the same vocabulary: the same ids in a third of the time."""

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece

        self.a_spec = a_spec
        spec = json.loads(a_spec)
        self.fast = self._ranked(spec)
        byte = byte_chars()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in added and all(c in byte for c in t)}
        self.a_bytes |= {i: t.encode() for t, i in added.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = []
        for i, p in enumerate(pieces):
            m = _BYTE_PIECE.fullmatch(p) if self.b.is_byte(i) else None
            self.b_bytes.append(bytes([int(m[1], 16)]) if m else p.replace("▁", " ").encode())
        # a piece that goes on after an inner space would span the places where long texts are cut
        self.cuttable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.n_b = len(pieces)
        top = max(self.a_bytes)
        self.a_len = np.zeros(top + 1, dtype=np.int64)
        for i, b in self.a_bytes.items():
            self.a_len[i] = len(b)
        self.b_len = np.array([len(b) for b in self.b_bytes], dtype=np.int64)
        # decimal digits of every id, right-aligned
        most = max(top + 1, self.n_b)
        width = len(str(most - 1))
        power = 10 ** np.arange(width - 1, -1, -1)
        ids = np.arange(most)[:, None]
        self.digits = (ids // power % 10 + ord("0")).astype(np.uint8)
        self.is_digit = (ids >= power) | (power == 1)

    @functools.cached_property
    def a(self):
        """A's own library."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_str(self.a_spec)
        made.encode_special_tokens = True
        made.no_truncation()
        made.no_padding()
        return made

    def a_encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is None:
            return [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # its pattern matcher runs out of stack on very long runs of white space
        return [self.fast(t) if len(t) < _RUN or not _LONG_RUN.search(t) else self.a.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts]

    @staticmethod
    def _ranked(spec: dict) -> Callable[[str], list[int]] | None:
        model, pre, byte = spec["model"], spec["pre_tokenizer"] or {}, byte_chars()
        plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        if not plain or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges"):
            return None
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {t: i for t, i in model["vocab"].items() if t not in added}
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [ranks.get(t, -1) for t in made]
        whole = set(byte) <= ranks.keys() and len(ranks) == len(byte) + len(set(made)) and all(c in byte for t in made for c in t)
        if not whole or any(x >= y for x, y in zip(ids, ids[1:])):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in ranks.items()}, special_tokens={}).encode_ordinary

    def _pieces(self, text: str) -> Iterator[str]:
        at = 0
        while self.cuttable and len(text) - at > _PIECE:
            cut = _CUT.search(text, at + _PIECE)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space + text by A and of the text by B; none for both where
        there is no text or the bytes differ."""
        a: list[list[int]] = [[] for _ in texts]
        b: list[list[int]] = [[] for _ in texts]
        owners, pieces = [], []
        for k, text in enumerate(texts):
            for p in self._pieces(" " + text) if text else ():
                owners.append(k)
                pieces.append(p)
        if pieces:
            from_a = self.a_encode(pieces)
            from_b = self.b.encode([p[1:] for p in pieces], num_threads=1)
            for k, x, y in zip(owners, from_a, from_b):
                a[k] = a[k] + x if a[k] else x
                b[k] = b[k] + y if b[k] else y
        for k, text in enumerate(texts):
            if text:
                whole = (" " + text).encode("utf-8", "surrogatepass")
                if b"".join(map(self.a_bytes.__getitem__, a[k])) != whole or b"".join(map(self.b_bytes.__getitem__, b[k])) != whole:
                    a[k], b[k] = [], []
        return a, b


def coalesce(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A and of each B token (intervals of one line,
    ascending on either side)."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat(np.array([0, 1], dtype=np.int8), [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.zeros(len(order), dtype=np.int64)
    breaks[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), dtype=np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_start)], group[len(a_start) :]


def links(a_start: np.ndarray, a_end: np.ndarray, b_start: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (A, B) token numbers whose intervals overlap, in A's order."""
    lo = np.searchsorted(b_end, a_start, "right")
    n = np.searchsorted(b_start, a_end, "left") - lo
    of_a = np.repeat(np.arange(len(a_start)), n)
    first = np.cumsum(n) - n
    return of_a, np.arange(len(of_a)) - np.repeat(first - lo, n)


class Aligned(NamedTuple):
    """Some documents' alignment: numbers by document, tokens by side."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    a: np.ndarray  # ids of all documents, end to end
    b: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    link_doc: np.ndarray
    link_a: np.ndarray  # ids of the linked tokens
    link_b: np.ndarray


def align_texts(tok: TwoTokenizers, texts: list[str | None]) -> Aligned:
    a_ids, b_ids = tok.encode(texts)
    n_a, n_b = (np.array([len(x) for x in ids], dtype=np.int64) for ids in (a_ids, b_ids))
    a, b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
    # the documents' bytes end to end: both sides have the same bytes of each
    a_end, b_end = np.cumsum(tok.a_len[a]), np.cumsum(tok.b_len[b])
    a_start, b_start = a_end - tok.a_len[a], b_end - tok.b_len[b]
    a_group, b_group = coalesce(a_start, a_end, b_start, b_end)
    of_a, of_b = links(a_start, a_end, b_start, b_end)
    doc_a = np.repeat(np.arange(len(texts)), n_a)
    ends = np.diff(a_group, append=-1) != 0  # the last A token of each group
    return Aligned(
        n_a,
        n_b,
        np.bincount(doc_a[ends], minlength=len(texts)),
        np.bincount(doc_a[of_a], minlength=len(texts)),
        a,
        b,
        a_group,
        b_group,
        doc_a[of_a],
        a[of_a],
        b[of_b],
    )


def group_texts(tok: TwoTokenizers, x: Aligned) -> Iterator[bytes]:
    """Per document its groups as ``a1,a2|b1;a3|b2,b3`` (empty without tokens)."""
    ids = np.concatenate([x.a, x.b])
    key = np.concatenate([2 * x.a_group, 2 * x.b_group + 1])
    order = np.argsort(key, kind="stable")
    ids, key = ids[order], key[order]
    n = x.n_a + x.n_b
    after = np.append(key[1:], -2)
    sep = np.where(after == key, ord(","), np.where(after == key + 1, ord("|"), ord(";")))
    sep[key % 2 == 1] = np.where(after == key, ord(","), ord(";"))[key % 2 == 1]
    sep[np.cumsum(n)[n > 0] - 1] = 0
    chars = np.concatenate([tok.digits[ids], sep[:, None].astype(np.uint8)], axis=1)
    used = np.concatenate([tok.is_digit[ids], (sep > 0)[:, None]], axis=1)
    flat = chars[used].tobytes()
    ends = np.append(0, np.cumsum(used.sum(axis=1)))[np.append(0, np.cumsum(n))]
    for s, e in zip(ends[:-1], ends[1:]):
        yield flat[s:e]


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as four planes of bytes (the high ones are zeros
    nearly everywhere, which compresses away)."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class _Block:
    """Documents gathered for one block."""

    def __init__(self, n_b: int):
        self.n_b, self.chars, self.docs = n_b, 0, 0
        self.ids: list[pa.Array] = []
        self.numbers: list[list[np.ndarray]] = [[] for _ in range(5)]  # n_a, n_b, n_groups, n_links, held
        self.digests: list[str] = []
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, ids: pa.Array, chars: int, x: Aligned, digests: list[str]) -> None:
        code = x.link_a * self.n_b + x.link_b
        order = np.lexsort((code, x.link_doc))
        code, doc = code[order], x.link_doc[order]
        first = np.ones(len(code), dtype=bool)
        first[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(first)
        self.pairs.append(code[at])
        self.times.append(np.diff(at, append=len(code)))
        held = np.bincount(doc[at], minlength=len(digests))
        for kept, v in zip(self.numbers, (x.n_a, x.n_b, x.n_groups, x.n_links, held)):
            kept.append(v)
        self.ids.append(ids)
        self.digests += digests
        self.chars += chars
        self.docs += len(digests)

    def row(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        code, times, held = np.concatenate(self.pairs), np.concatenate(self.times), np.concatenate(self.numbers[4])
        pairs, at = np.unique(code, return_inverse=True)
        docs = np.bincount(at, minlength=len(pairs))
        order = np.argsort(-docs, kind="stable")  # frequent pairs first: small steps
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(np.arange(len(held)), held)
        at = place[at]
        by = np.lexsort((at, doc))
        at, times = at[by], times[by]
        steps = np.diff(at, prepend=0)
        starts = (np.cumsum(held) - held)[held > 0]
        steps[starts] = at[starts]
        one = lambda v, t: pa.array([v], t)
        ids = pa.concat_arrays(self.ids)
        cols = [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
        cols += [one(np.concatenate(v), pa.list_(pa.int64())) for v in self.numbers]
        cols += [one(self.digests, pa.list_(pa.string()))]
        cols += [one(v, pa.list_(pa.int64())) for v in (pairs[order] // self.n_b, pairs[order] % self.n_b, docs[order])]
        cols += [pa.array([_planes(v)], pa.binary()) for v in (steps, times)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)


_built: dict[int, TwoTokenizers] = {}


def _tokenizers(spec) -> TwoTokenizers:
    """One pair of tokenizers per worker process and pair of files."""
    key, a, b = spec.value
    got = _built.get(key)
    if got is None:
        _built.clear()
        got = _built[key] = TwoTokenizers(a, b)
    return got


def vocabularies(spark: SparkSession, a_path: str, b_path: str):
    """Broadcast of both vocabulary files (read by the driver only)."""
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        a, b = f.read(), g.read()
    TwoTokenizers(a, b)  # fail here, not in the tasks
    return spark.sparkContext.broadcast((hash((a, b)), a, b))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None], int]]:
    """Arrow batches (texts last) in parts of about ``_PART`` characters."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            texts, chars = [], 0
            for v in batch.column(batch.num_columns - 1).slice(at):
                texts.append(v.as_py())
                chars += len(texts[-1] or "")
                if chars >= _PART or len(texts) >= 4096:
                    break
            yield batch.slice(at, len(texts)), texts, chars
            at += len(texts)


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_blocks(docs: DataFrame, vocab, *, id_col: str, text_col: str, block: int = BLOCK) -> DataFrame:
    """Rows of about ``block`` characters of documents: numbers and digests by
    document, distinct pairs (``a``, ``b``, ``docs``) in order of how many of the
    block's documents hold them, and the documents' pairs as steps in that order."""
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType))]
        + [T.StructField(c, longs) for c in (*_NUMBERS, "held")]
        + [T.StructField("digests", T.ArrayType(T.StringType()))]
        + [T.StructField(c, longs) for c in ("a", "b", "docs")]
        + [T.StructField(c, T.BinaryType()) for c in ("steps", "times")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(vocab)
        arrow, held, number = None, _Block(tok.n_b), TaskContext.get().partitionId() << 32
        for part, texts, chars in _parts(batches):
            if arrow is None:
                kinds = [pa.int64(), pa.list_(part.schema.field(0).type), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), *[pa.list_(pa.int64())] * 3, pa.binary(), pa.binary()]
                arrow = pa.schema(list(zip(schema.names, kinds)))
            x = align_texts(tok, texts)
            held.add(part.column(0), chars, x, [hashlib.sha256(g).hexdigest() if g else "" for g in group_texts(tok, x)])
            if held.chars >= block or held.docs >= _BLOCK_DOCS:
                yield held.row(number, arrow)
                held, number = _Block(tok.n_b), number + 1
        if held.docs:
            yield held.row(number, arrow)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def align_documents(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``groups array<struct<a array<int>, b array<int>>>``: the ids of
    each group's tokens on both sides (empty for texts without tokens).  Narrow."""
    vocab = vocabularies(docs.sparkSession, a_path, b_path)
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "groups"])
    ints = T.ArrayType(T.IntegerType())
    group = T.StructType([T.StructField("a", ints), T.StructField("b", ints)])
    schema = T.StructType([*kept.schema.fields, T.StructField("groups", T.ArrayType(group))])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizers(vocab)
        for batch in batches:
            with_texts = pa.RecordBatch.from_arrays([*batch.columns, batch.column(at)], names=[f"c{i}" for i in range(batch.num_columns + 1)])
            for part, texts, _ in _parts([with_texts]):
                x = align_texts(tok, texts)
                n = int(x.n_groups.sum())
                sides = []
                for ids, g in ((x.a, x.a_group), (x.b, x.b_group)):
                    ends = np.append(0, np.cumsum(np.bincount(g, minlength=n)[:n])).astype(np.int32)
                    sides.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))))
                both = pa.StructArray.from_arrays(sides, names=["a", "b"])
                ends = np.append(0, np.cumsum(x.n_groups)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), both)], names=schema.names)

    return kept.mapInArrow(run, schema)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``(a, b, n, best)``: documents that hold each linked id pair, and whether no
    other pair of its A id is held by more."""
    rows = blocks.select(F.explode(F.arrays_zip("a", "b", "docs")).alias("p")).select("p.*")
    counts = rows.groupBy("a", "b").agg(F.sum("docs").alias("n")).checkpoint()  # read for the highest and for the join
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_a``, ``n_b``, ``n_groups``,
    ``n_links``, ``n_best`` (links whose pair has its A id's highest count),
    ``count_sum`` (counts over all links), ``groups_sha256``."""
    spark = docs.sparkSession
    path = f"{checkpoint_dir(spark)}/aligned-{uuid.uuid4().hex}"
    made = aligned_blocks(docs, vocabularies(spark, a_path, b_path), id_col=id_col, text_col=text_col, block=block)
    made.write.option("compression", "zstd").parquet(path)
    blocks = spark.read.schema(made.schema).parquet(path)

    counts = pair_counts(blocks).checkpoint()
    rows = blocks.select("block", F.posexplode(F.arrays_zip("a", "b")).alias("at", "p")).select("block", "at", "p.*")
    scored = rows.join(counts, ["a", "b"]).select("block", "at", (F.col("n") * 2 + F.col("best").cast("long")).alias("v"))
    values = scored.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("values"))

    kind = docs.schema[id_col].dataType
    longs = ("n_best", "count_sum")
    schema = T.StructType([T.StructField(id_col, kind), *[T.StructField(c, T.LongType()) for c in (*_NUMBERS, *longs)], T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                col = {n: batch.column(i)[k] for i, n in enumerate(batch.schema.names)}
                array = lambda c: np.asarray(col[c].values, dtype=np.int64)
                held, steps, times = array("held"), _numbers(col["steps"].as_py()), _numbers(col["times"].as_py())
                v = array("values") if col["values"].is_valid else np.empty(0, dtype=np.int64)
                ends = np.cumsum(held)
                run_on = np.append(0, np.cumsum(steps))
                at = run_on[1:] - np.repeat(run_on[ends - held], held)
                sums = []
                for x in (times * (v[at] & 1), times * (v[at] >> 1)):
                    upto = np.append(0, np.cumsum(x))
                    sums.append(pa.array(upto[ends] - upto[ends - held]))
                out = [col["ids"].values, *[col[c].values for c in _NUMBERS], *sums, col["digests"].values]
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    few = blocks.select("block", "ids", *_NUMBERS, "held", "digests", "steps", "times")
    return few.join(values, "block", "left").select(*few.columns, "values").mapInArrow(run, schema)
