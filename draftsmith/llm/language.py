"""Language identification by averaged hashed subword embeddings.

A text is its character n-grams (2 to 4 letters, with a mark where a word begins
or ends), hashed into ``2**bits`` rows of an embedding table; the mean of the
rows goes through a linear softmax.  Table and softmax are trained together by
stochastic gradient descent in numpy.  On labelled documents kept apart from the
fit, a temperature is chosen that makes the probabilities fit (least negative
log likelihood), and a threshold above which at least ``target`` of the
predictions are right: what is below it is not accepted (rejection).

On Spark: languages are counted with one aggregate; a sample of the labelled
documents, bounded by ``MAX_TRAIN`` documents and ``MAX_CHARS`` characters in
expectation and shared out evenly over the languages, is drawn by a hash of the
id.  Its hashed counts (never texts) are fitted on the driver.  Prediction is
one narrow Arrow pass over whole texts, in slices of ``_SLICE`` characters, with
the model broadcast (``2**bits * dim`` floats: a constant).

Defined results: a null text and one without a letter is ``und`` with score 0
and not accepted; texts are taken whole whatever their length; rows with null
language, null id or null text teach nothing; copies of a text in the sample
teach once; without labelled rows everything is ``und``; repeated rows alike; an
empty table gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TRAIN = 9000  # documents of the sample, over all languages
MAX_CHARS = 24_000_000
UNKNOWN = "und"
_SIZES = (2, 3, 4)
_SLICE = 1 << 17
_ROWS = 256
_letters: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    """Code points of ``text``, zero where there is no letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(_letters[x], x, 0).astype(np.uint64)


def _hashed(codes: np.ndarray, doc: np.ndarray, old: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``(bucket, doc)`` of the n-grams of ``codes`` (no two zeros in a row), those
    within the first ``old`` codes left out, by document."""
    buckets, docs = [], []
    h = codes + np.uint64(1)
    for n in range(2, max(_SIZES) + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(1)
        inner = codes[1 : len(h) + 1] > 0
        for k in range(2, n - 1):
            inner = inner & (codes[k : len(h) + k] > 0)
        if n == 2:
            inner = inner | (codes[:-1] > 0)
        at = np.flatnonzero(inner)
        at = at[np.searchsorted(at, max(0, old - n + 1)) :]
        if n in _SIZES:
            buckets.append(((h[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits))
            docs.append(doc[at + 1])
    if not buckets:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    docs = np.concatenate(docs)
    order = np.argsort(docs, kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), docs[order]


def hashed_grams(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(bucket, number of the text)`` of all n-grams, in slices; within a slice by text."""

    def squeezed(x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = np.ones(len(x), dtype=bool)
        keep[1:] = (x[1:] > 0) | (x[:-1] > 0)
        return x[keep], doc[keep]

    group: list[tuple[int, str]] = []

    def together() -> tuple[np.ndarray, np.ndarray]:
        # a mark in front, and one after each text, which belongs to it
        doc = np.repeat([k for k, _ in group], [len(t) + 1 for _, t in group])
        x, doc = squeezed(_codes("\0" + "\0".join(t for _, t in group) + "\0"), np.append(doc[:1], doc))
        return _hashed(x, doc, 0, bits)

    held = 0
    for k, text in enumerate(texts):
        if not text:
            continue
        if len(text) <= _SLICE:
            group.append((k, text.casefold()))
            held += len(text)
            if held >= _SLICE:
                yield together()
                group, held = [], 0
            continue
        tail = np.zeros(1, dtype=np.uint64)
        for at in range(0, len(text), _SLICE):
            part = _codes(text[at : at + _SLICE].casefold())
            last = np.zeros(1 if at + _SLICE >= len(text) else 0, dtype=np.uint64)
            x = np.concatenate([tail, part, last])
            x, doc = squeezed(x, np.full(len(x), k))
            yield _hashed(x, doc, len(tail) if at else 0, bits)
            tail = x[-(max(_SIZES) - 1) :]
    if group:
        yield together()


def bag(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text, ascending, with their counts."""
    found = [b for b, _ in hashed_grams([text], bits)]
    return np.unique(np.concatenate(found) if found else np.empty(0, dtype=np.int64), return_counts=True)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # 2**bits rows
    weights: np.ndarray  # a row per language
    bias: np.ndarray
    bits: int
    temperature: float = 1.0
    threshold: float = 0.0

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean embedding of each text and its number of n-grams."""
        sums = np.zeros((len(texts), self.table.shape[1]), dtype=np.float64)
        n = np.zeros(len(texts), dtype=np.int64)
        for bucket, doc in hashed_grams(texts, self.bits):
            if len(doc):
                starts = np.flatnonzero(np.diff(doc, prepend=-1))
                sums[doc[starts]] += np.add.reduceat(self.table[bucket], starts, axis=0)
                n += np.bincount(doc, minlength=len(texts))
        return sums / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of its language (-1: none) and the probability."""
        mean, n = self.means(texts)
        if not self.langs or not texts:
            return np.full(len(texts), -1), np.zeros(len(texts))
        p = _softmax((mean @ self.weights.T + self.bias) / self.temperature)
        best = p.argmax(axis=1)
        return np.where(n > 0, best, -1), np.where(n > 0, p[np.arange(len(texts)), best], 0.0)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str], *, bits: int, dim: int = 16, epochs: int = 6, batch: int = 16, rate: float = 4.0, seed: int = 1, least_steps: int = 1500) -> LanguageModel:
    """Stochastic gradient descent over small batches, with a falling rate; few
    documents are gone over more often, for ``least_steps`` batches."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    weights, bias = np.zeros((len(langs), dim), dtype=np.float32), np.zeros(len(langs), dtype=np.float32)
    share = [(n / n.sum()).astype(np.float32) for _, n in bags]
    batches = -(-len(bags) // batch)
    epochs = max(epochs, -(-least_steps // batches))
    steps, done = epochs * batches, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            now = rate * (1 - done / steps)
            done += 1
            rows = order[at : at + batch]
            key = np.concatenate([bags[r][0] for r in rows])
            part = np.concatenate([share[r] for r in rows])[:, None]
            size = np.array([len(bags[r][0]) for r in rows])
            mean = np.add.reduceat(table[key] * part, np.cumsum(size) - size, axis=0)
            off = _softmax(mean @ weights.T + bias).astype(np.float32)
            off[np.arange(len(rows)), y[rows]] -= 1
            back = off @ weights
            weights -= now / len(rows) * (off.T @ mean)
            bias -= now / len(rows) * off.sum(axis=0)
            # hashed rows are touched by few texts at a time: each gets its full step
            np.subtract.at(table, key, now * part * np.repeat(back, size, axis=0))
    return LanguageModel(langs, table, weights, bias, bits)


def calibrate(model: LanguageModel, bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, *, target: float) -> LanguageModel:
    """Temperature and threshold from documents the fit has not seen (none: as they are)."""
    if not bags:
        return model
    mean = np.stack([(model.table[k] * (n / n.sum())[:, None]).sum(axis=0) for k, n in bags])
    z = mean @ model.weights.T + model.bias
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 241), key=loss))
    p = _softmax(z / model.temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order])
    enough = np.flatnonzero((wrong + 1) / (np.arange(len(y)) + 2) <= 1 - target)
    model.threshold = float(score[order][enough[-1]]) if len(enough) else float(score.max())
    return model


def fold(id_col: str = "doc_id") -> Column:
    """CRC-32 of the id as text, modulo 3 (null id: null)."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 3


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, max_chars: int = MAX_CHARS, bits: int = 16, dim: int = 16, target: float = 0.99) -> LanguageModel:
    """Model of the languages in ``lang_col``; all rows of ``docs`` with a language
    may be drawn, so held-out rows are to be left out before."""
    x = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    sizes = sorted((r.lang, r.n, r.chars) for r in x.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect())
    langs = [s[0] for s in sizes]
    if not langs:
        return LanguageModel([], np.zeros((1 << bits, dim), dtype=np.float32), np.zeros((0, dim)), np.zeros(0), bits)
    rates = {lang: min(1.0, max_train / len(langs) / n, max_chars / len(langs) / max(1, chars)) for lang, n, chars in sizes}
    rate = F.create_map(*[F.lit(v) for lang in langs for v in (lang, rates[lang])])[F.col("lang")]
    drawn = (F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / float(1 << 40)) < rate
    apart = F.pmod(F.xxhash64(F.lit("apart"), "id"), F.lit(5)) == 0
    sample = x.where(drawn).select("lang", "text", apart.alias("apart"))

    def bags_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                found = [bag(t, bits) for t in part.column(1).to_pylist()]
                ends = pa.array(np.cumsum([0, *[len(k) for k, _ in found]]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[i] for f in found]), pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *lists], names=["lang", "apart", "k", "n"])

    bags = sample.mapInArrow(bags_of, "lang string, apart boolean, k array<int>, n array<int>").where(F.size("k") > 0).dropDuplicates(["lang", "k", "n"]).toArrow()
    rows = [(lang, apart, k.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.float64)) for lang, apart, k, n in zip(bags["lang"].to_pylist(), bags["apart"].to_pylist(), bags["k"], bags["n"])]
    rows.sort(key=lambda r: (r[0], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    if not rows:  # labelled texts without a letter
        return LanguageModel([], np.zeros((1 << bits, dim), dtype=np.float32), np.zeros((0, dim)), np.zeros(0), bits)
    langs = sorted({r[0] for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    seen = [r for r in rows if not r[1]] or rows
    model = fit([r[2:] for r in seen], np.array([number[r[0]] for r in seen]), langs, bits=bits, dim=dim)
    kept = [r for r in rows if r[1]]
    return calibrate(model, [r[2:] for r in kept], np.array([number[r[0]] for r in kept], dtype=np.int64), target=target)


def identify(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: list[str] | None = None, reject: bool = False) -> DataFrame:
    """``docs`` (or their columns ``keep``) with ``lang_pred``, ``score`` (calibrated
    probability) and ``accepted``; with ``reject`` what is not accepted is ``und``."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    names = [f.name for f in added]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in kept], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            for at in range(0, b.num_rows, _ROWS):
                part = b.slice(at, _ROWS)
                best, score = m.predict(part.column(part.num_columns - 1).to_pylist())
                accepted = (best >= 0) & (score >= m.threshold)
                shown = [m.langs[i] if i >= 0 and (ok or not reject) else UNKNOWN for i, ok in zip(best.tolist(), accepted.tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shown, pa.string()), pa.array(score), pa.array(accepted)], names=schema.names)

    # the text comes last, under a name that clashes with none
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__li_text")).mapInArrow(run, schema)
