"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

For byte-level BPE with ranked merges, the encoding of a text ends with token
``t`` exactly when the encoding of what is before ``t`` ends with some ``p`` for
which ``p + t`` encodes to the pair ``(p, t)``; one such ``t`` exists for every
prefix.  The last token of each prefix is therefore a state that longer words
inherit: the distinct words of a batch form a trie, each node holds the last
token of its prefix, and a depth-first walk finds the state of a node from the
states on its path, so the encoding of a shared prefix is found once.  A word's
ids are read backwards from its node.

The walk goes over the words in byte order and keeps the states of the current
path only (two neighbours share their longest common prefix), which is the
depth-first order of the trie without holding its nodes.

On Spark: one narrow Arrow pass over the texts, nothing is shuffled.  The
vocabulary file is read by the driver (its path is a parameter) and broadcast;
its size is that of the vocabulary.  A task holds ``_ROWS`` texts, the words of
``_CHUNK`` characters and a word table of about ``_MEMO`` words.

Defined results: a null text is encoded as an empty one (no ids); strings of
special tokens in a text become those tokens, as the tokenizers library does by
default; texts of any length are encoded whole; repeated rows alike.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_WORDS = regex.compile(PATTERN)
_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")  # no word spans such a place
_CHUNK = 1 << 21
_MEMO = 600_000
_MEMO_LEN = 48
_PAIRS = 350_000
_ROWS = 256  # rows encoded at a time


def byte_chars() -> dict[str, int]:
    """Printable stand-in of each byte: printable Latin-1 as it is, the others
    from U+0100 on in byte order."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class TrieEncoder:
    """Encoder and decoder over a tokenizers JSON file (byte-level BPE)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        m, pre = d["model"], d["pre_tokenizer"] or {}
        if m["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or d["normalizer"] or m.get("dropout") or m.get("ignore_merges"):
            raise ValueError("a byte-level BPE vocabulary without prefix space and normalizer is needed")
        byte = byte_chars()
        raw = lambda s: bytes(byte[c] for c in s)
        self.id_of = {raw(s): i for s, i in m["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        pairs = (x.split(" ") if isinstance(x, str) else x for x in m["merges"])
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault((raw(a), raw(b)), k)
        self.split: dict[bytes, tuple[int, tuple[bytes, bytes]]] = {}  # last merge of a token
        for pair, k in self.rank.items():
            self.split.setdefault(pair[0] + pair[1], (k, pair))
        if len(self.split) != len(self.rank):
            raise ValueError("each token must come from one merge")
        self.edges: tuple[dict, dict] = ({}, {})
        self.longest = max(map(len, self.id_of))
        self.special = {}
        for t in d.get("added_tokens", []):
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError("added tokens that strip or need word bounds are not handled")
            self.special[t["content"]] = t["id"]
            self.bytes_of[t["id"]] = t["content"].encode()
        by_length = sorted(self.special, key=len, reverse=True)
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, by_length)) + ")") if by_length else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}  # ids of a word as 32-bit integers
        self.passing: list[str] = []

    def merged(self, word: bytes) -> list[bytes]:
        """Plain merging, smallest rank first (used for single tokens and pairs)."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, -1) for p in zip(parts, parts[1:])]
            least = min((r for r in ranks if r >= 0), default=-1)
            if least < 0:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(ranks) and ranks[i] == least:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _alone(self, t: int) -> bool:
        """Whether a token's text encodes to the token itself."""
        ok = self.alone.get(t)
        if ok is None:
            ok = self.alone[t] = len(self.merged(self.bytes_of[t])) == 1
        return ok

    def _edge(self, t: int, side: int) -> list[tuple[bytes, float]]:
        """Pieces that are at an edge of the token (0: left, 1: right) while it
        is merged, largest first, each with the rank of the merge that ends it."""
        got = self.edges[side].get(t)
        if got is None:
            piece, ends = self.bytes_of[t], float("inf")
            got = [(piece, ends)]
            while piece in self.split:
                ends, pair = self.split[piece]
                piece = pair[side]
                got.append((piece, ends))
            self.edges[side][t] = got
        return got

    def _fits(self, p: int, t: int) -> bool:
        """Whether ``p + t`` encodes to the pair ``(p, t)``: no merge joins a
        piece at the right edge of ``p`` to one at the left edge of ``t`` before
        both are merged away from the border (of equal ranks the left goes first)."""
        ok = self.fits.get((p, t))
        if ok is None:
            if len(self.fits) > _PAIRS:
                self.fits.clear()
            ok = self._alone(p) and self._alone(t)
            if ok:
                rank = self.rank
                right = self._edge(t, 0)
                for x, x_ends in self._edge(p, 1):
                    for y, y_ends in right:
                        r = rank.get((x, y))
                        if r is not None and r < x_ends and r <= y_ends:
                            ok = False
                            break
                    if not ok:
                        break
            self.fits[p, t] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids (32-bit integers) of each of the ``words``, which are sorted and distinct."""
        id_of, longest, known = self.id_of.get, self.longest, self.fits.get
        last: list[int] = [-1]  # last token of the current path's prefix of this length
        back: list[int] = [0]  # length of the prefix before that token
        prev = b""
        for w in words:
            n = min(len(w), len(prev))
            depth = next((i for i in range(n) if w[i] != prev[i]), n)
            del last[depth + 1 :], back[depth + 1 :]
            for end in range(depth + 1, len(w) + 1):
                for start in range(max(0, end - longest), end):
                    t = id_of(w[start:end])
                    if t is None:
                        continue
                    if start:
                        ok = known((last[start], t))
                        if ok is None:
                            ok = self._fits(last[start], t)
                    else:
                        ok = self._alone(t)
                    if ok:
                        last.append(t)
                        back.append(start)
                        break
                else:
                    raise ValueError(f"byte {w[end - 1]} has no token")
            prev, ids, at = w, [], len(w)
            while at:
                ids.append(last[at])
                at = back[at]
            ids.reverse()
            yield array("i", ids).tobytes()

    def _learn(self, lists: list[list[str]]) -> dict[str, bytes]:
        """The word table with all words of ``lists``; words that are long, or
        new when the table is full, leave it with the next call."""
        for w in self.passing:
            del self.memo[w]
        self.passing = []
        new = set(chain.from_iterable(lists)) - self.memo.keys()
        if new:
            pairs = sorted((w.encode("utf-8", "surrogatepass"), w) for w in new)
            for (_, w), ids in zip(pairs, self.encode_words([b for b, _ in pairs])):
                if len(w) > _MEMO_LEN or len(self.memo) >= _MEMO:
                    self.passing.append(w)
                self.memo[w] = ids
        return self.memo

    def _pieces(self, text: str) -> Iterator[str]:
        """``text`` cut where no word can span, in parts of about ``_CHUNK``."""
        at = 0
        while len(text) - at > _CHUNK:
            cut = _CUT.search(text, at + _CHUNK)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def parts(self, text: str) -> Iterator[int | str]:
        """Special ids, and ordinary text between them."""
        if self.special_re is None or not any(s in text for s in self.special):
            yield from self._pieces(text)
            return
        for x in self.special_re.split(text):
            if x in self.special:
                yield self.special[x]
            elif x:
                yield from self._pieces(x)

    def _group(self, group: list[tuple[int, list]], out: list[list], count_only: bool) -> None:
        table = self._learn([x for _, xs in group for x in xs if isinstance(x, list)])
        for k, xs in group:
            for x in xs:
                ids = b"".join(map(table.__getitem__, x)) if isinstance(x, list) else array("i", [x]).tobytes()
                out[k].append(len(ids) // 4 if count_only else ids)

    def encode_batch(self, texts: list[str | None], *, count_only: bool = False) -> list:
        """Per text its ids (int32 array), or their number."""
        out: list[list] = [[] for _ in texts]
        group: list[tuple[int, list]] = []
        held = 0
        for k, text in enumerate(texts):
            for part in self.parts(text) if text else ():
                x = part if isinstance(part, int) else _WORDS.findall(part)
                held += 1 if isinstance(part, int) else len(part)
                group.append((k, [x]))
                if held >= _CHUNK:
                    self._group(group, out, count_only)
                    group, held = [], 0
        self._group(group, out, count_only)
        if count_only:
            return [sum(x) for x in out]
        return [np.frombuffer(x[0] if len(x) == 1 else b"".join(x), dtype=np.int32) for x in out]

    def decode(self, ids) -> str:
        """Text of ``ids``, special tokens included; broken UTF-8 as U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary file (folder: ``DRAFTSMITH_TOKENIZERS``)."""
    return os.path.join(os.environ.get("DRAFTSMITH_TOKENIZERS", "/opt/tokenizers"), name)


_built: dict[int, TrieEncoder] = {}


def _encoder(spec) -> TrieEncoder:
    """One encoder per worker process and vocabulary."""
    got = _built.get(spec.value[0])
    if got is None:
        _built.clear()
        got = _built[spec.value[0]] = TrieEncoder(spec.value[1])
    return got


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of the vocabulary file (read by the driver only)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    TrieEncoder(spec)  # fail here, not in the tasks
    return spark.sparkContext.broadcast((hash(spec), spec))


def _slices(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Arrow batches in parts of ``_ROWS`` rows, with the texts of column ``at``."""
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            part = batch.slice(k, _ROWS)
            yield part, part.column(at).to_pylist()


def _with_columns(docs: DataFrame, text_col: str, added: list[T.StructField], work) -> DataFrame:
    """``docs`` with ``added`` columns, which ``work(encoder, texts)`` gives as
    Arrow arrays; the other columns pass through as they are."""
    names = [f.name for f in added]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    at = kept.columns.index(text_col)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept.schema.fields] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches, at):
            yield pa.RecordBatch.from_arrays([*part.columns, *work(texts)], names=[*part.schema.names, *names])

    return kept.mapInArrow(run, schema)


def encoded_lengths(docs: DataFrame, vocab, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``length``, the number of tokens of the text (null: 0)."""

    def work(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(_encoder(vocab).encode_batch(texts, count_only=True), pa.int64())]

    return _with_columns(docs, text_col, [T.StructField("length", T.LongType())], work)


def decode(ids: Column, vocab) -> Column:
    """Text of an id array (null: null)."""

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        enc = _encoder(vocab)
        return pd.Series([None if x is None else enc.decode(x.tolist()) for x in rows], dtype=object)

    return run(ids)


def encode_documents(docs: DataFrame, vocab_path: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``token_ids array<int>`` and ``decoded`` (the ids' text)."""
    vocab = vocabulary(docs.sparkSession, vocab_path)

    def work(texts: list[str | None]) -> list[pa.Array]:
        enc = _encoder(vocab)
        ids = enc.encode_batch(texts)
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([enc.decode(x.tolist()) for x in ids], pa.string())]

    return _with_columns(docs, text_col, [T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], work)


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
