"""Toxicity grades by cumulative-link ordinal regression.

One weight vector ``w`` over sparse word features and ordered thresholds
``t_1 < ... < t_K`` give ``P(grade <= k) = sigmoid(t_{k+1} - w.x)``: all grades
share the weights and differ in the threshold only.  The score of a document is
its expected severity, the sum of ``P(grade >= k)``.

Labels say toxic or not; severity grades of the toxic training documents come
from how much they hold of the words that set toxic documents apart (large and
significant log odds over the sample), split at equal shares.  Only such words
are features, so the length of a document does not weigh.

On Spark: at most ``max_train`` labelled documents (half of each kind, the
smallest by hash of their id; a stated bound) are turned into sparse features,
near-copies among them are dropped and telling words found by joins and
aggregates; the driver gets those words' counts and fits; scoring is one narrow
Arrow pass over all documents with the model broadcast (non-zero weights only).

Defined results: a null or empty text has no features and gets the grade
probabilities of the thresholds alone; null labels take no part; repeated rows
alike; without labels of both kinds nothing is called toxic; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftsmith.session import checkpoint_dir

MAX_TRAIN = 12000
BITS = 24
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")


def bucket(word: str, bits: int = BITS) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass"), 7) >> (32 - bits)


def features(text: str | None, bits: int = BITS) -> dict[int, float]:
    """Word buckets with ``log2(1 + count)``."""
    words = _WORD.findall(text.lower()) if text else []
    out: dict[int, float] = {}
    for w, n in Counter(words).items():
        b = bucket(w, bits)
        out[b] = out.get(b, 0) + n
    return {b: float(np.log2(1 + n)) for b, n in out.items()}


def _sigmoid(z):
    return 0.5 * (1.0 + np.tanh(0.5 * z))


@dataclass
class OrdinalModel:
    thresholds: np.ndarray  # ascending, one per grade above zero
    weights: dict[int, float] = field(default_factory=dict)
    bits: int = BITS

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """``P(grade >= k)`` for k = 1..K, a row per score."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def distinct_rows(feats: DataFrame, *, bands: int = 4, rare: int = 30) -> DataFrame:
    """``feats(row, y, k, v)`` without near-copies of an earlier row: two rows
    count as copies when all their features agree or when, in one of ``bands``
    bands, two minimum hashes of their rare words (in 2 to ``rare`` rows) do.
    Else the words of a copied text would pass for telling."""
    terms = feats.select("row", F.explode("k").alias("k"))
    few = terms.groupBy("k").count().where(F.col("count").between(2, rare)).select("k")
    least = [F.min(F.xxhash64(F.lit(i), "k")).alias(f"h{i}") for i in range(2 * bands)]
    signed = terms.join(few, "k").groupBy("row").agg(*least)
    keys = F.array(*[F.xxhash64(F.lit(b), f"h{2 * b}", f"h{2 * b + 1}") for b in range(bands)])
    marks = signed.select("row", F.explode(keys).alias("key")).unionAll(feats.select("row", F.xxhash64(F.lit(-1), "k", "v")))
    first = marks.groupBy("key").agg(F.min("row").alias("first"))
    copies = marks.join(first, "key").where("row > first").select("row").distinct()
    return feats.join(copies, "row", "left_anti")


def telling_buckets(rows: DataFrame, pos: int, neg: int, *, odds: float = 2.5, gain: float = 16.0) -> DataFrame:
    """``(k)``: buckets whose presence tells toxic rows: log odds over ``odds`` and
    a likelihood ratio (G) over ``gain``, which takes several toxic rows."""
    n = rows.select("y", F.explode("k").alias("k")).groupBy("k").agg(F.count(F.when(F.col("y"), 1)).alias("i"), F.count(F.when(~F.col("y"), 1)).alias("j"))
    i, j, base = F.col("i"), F.col("j"), pos / max(1, pos + neg)
    lo = F.ln((i + 0.5) / (pos - i + 0.5)) - F.ln((j + 0.5) / (neg - j + 0.5))
    part = lambda m, q: F.when(m > 0, m * F.ln(m / (i + j) / q)).otherwise(0.0)
    return n.where((i > 0) & (lo > odds) & (2 * (part(i, base) + part(j, 1 - base)) >= gain)).select("k")


def severity(x: list[dict[int, float]], toxic: np.ndarray, grades: int) -> np.ndarray:
    """Grades of the training rows: 0 if not toxic, else 1..grades by how much
    they hold of telling words (the features of ``x``)."""
    held = np.array([sum(row.values()) for row in x])
    cuts = np.quantile(held[toxic], [i / grades for i in range(1, grades)])
    return np.where(toxic, 1 + np.searchsorted(np.unique(cuts), held, side="left"), 0)


def fit(x: list[dict[int, float]], y: np.ndarray, weight: np.ndarray | None = None, *, bits: int = BITS, rounds: int = 400, l1: float = 5e-5, l2: float = 2e-5, rate: float = 0.1) -> OrdinalModel:
    """Cumulative-link regression by full-batch Adam steps with soft thresholding."""
    top = int(y.max(initial=0))
    if top < 1 or not (y == 0).any() or not any(x):
        return OrdinalModel(np.array([6.0]), {}, bits)
    grades = np.unique(y)
    y, top = np.searchsorted(grades, y), len(grades) - 1  # grades that occur
    df = Counter(k for row in x for k in row)
    col = {k: i for i, k in enumerate(sorted(k for k, n in df.items() if n >= 3))}
    rows = np.repeat(np.arange(len(x)), [sum(k in col for k in r) for r in x])
    cols = np.array([col[k] for r in x for k in r if k in col], dtype=np.int64)
    vals = np.array([v for r in x for k, v in r.items() if k in col])
    n, d = len(x), len(col)
    weight = np.ones(n) if weight is None else np.asarray(weight, dtype=np.float64)
    weight = weight / weight.sum()
    share = np.array([weight[y >= k].sum() for k in range(1, top + 1)])
    t = -np.log(share / (1 - share))  # ascending
    # free parameters: first threshold, log gaps
    par = np.concatenate([np.zeros(d), [t[0]], np.log(np.maximum(np.diff(t), 1e-3))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, rounds + 1):
        w = par[:d]
        gaps = np.exp(par[d + 1 :])
        th = par[d] + np.concatenate([[0.0], np.cumsum(gaps)])
        s = np.bincount(rows, vals * w[cols], minlength=n)
        full = np.concatenate([[-np.inf], th, [np.inf]])
        up, low = full[y + 1] - s, full[y] - s
        su, sl = _sigmoid(up), _sigmoid(low)
        p = np.maximum(su - sl, 1e-12)
        du = np.where(np.isinf(up), 0.0, su * (1 - su)) / p
        dl = np.where(np.isinf(low), 0.0, sl * (1 - sl)) / p
        gs = (du - dl) * weight  # of the loss by the score
        gw = np.bincount(cols, vals * gs[rows], minlength=d) + l2 * w
        gth = np.array([(dl * weight)[y == k].sum() - (du * weight)[y == k - 1].sum() for k in range(1, top + 1)])
        rest = np.cumsum(gth[::-1])[::-1]
        g = np.concatenate([gw, [gth.sum()], rest[1:] * gaps])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        lr = rate * min(1.0, 4.0 * (1 - step / (rounds + 1)))
        scale = lr / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        par = par - scale * m / (1 - 0.9**step)
        shrink = np.minimum(scale[:d] * l1, lr)
        par[:d] = np.sign(par[:d]) * np.maximum(0.0, np.abs(par[:d]) - shrink)
    w = par[:d]
    th = par[d] + np.concatenate([[0.0], np.cumsum(np.exp(par[d + 1 :]))])
    return OrdinalModel(th, {k: float(w[i]) for k, i in col.items() if w[i]}, bits)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN, grades: int = GRADES, bits: int = BITS) -> OrdinalModel:
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).alias("__y"))
    few = None
    for y in (True, False):  # the stated bound, half for each kind
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(max_train // 2)
        few = part if few is None else few.unionAll(part)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text")).join(F.broadcast(few), F.col(id_col) == F.col("__id")).select("__id", "__y", "__text")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [features(t, bits) for t in p["__text"]]
            yield pd.DataFrame({"id": p["__id"], "y": p["__y"], "k": [list(f) for f in got], "v": [list(f.values()) for f in got]})

    checkpoint_dir(docs.sparkSession)
    feats = rows.mapInPandas(run, "id long, y boolean, k array<int>, v array<float>")
    one = F.min_by(F.struct("k", "v"), F.xxhash64("k", "v"))  # of rows that share an id, one
    feats = feats.groupBy("id", "y").agg(one.alias("f")).select("id", "y", "f.*")
    feats = feats.withColumn("row", F.monotonically_increasing_id()).checkpoint()
    kept = distinct_rows(feats).checkpoint()
    n = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}  # two rows
    pos, neg = n.get(True, 0), n.get(False, 0)
    if not pos or not neg:
        return OrdinalModel(np.array([6.0]), {}, bits)
    telling = telling_buckets(kept, pos, neg)
    parts = kept.select("row", "y", F.explode(F.arrays_zip("k", "v")).alias("f")).select("row", "y", "f.*").join(telling, "k")
    x: dict[int, dict[int, float]] = {}
    y: dict[int, bool] = {}
    for r in parts.collect():  # telling words of at most max_train rows
        x.setdefault(r["row"], {})[r["k"]] = r["v"]
        y[r["row"]] = r["y"]
    rows_x = list(x.values())
    toxic = np.array(list(y.values()) + [True] * (pos - sum(y.values())) + [False] * (neg - len(y) + sum(y.values())), dtype=bool)
    rows_x += [{}] * (len(toxic) - len(rows_x))
    # both kinds weigh alike, so a grade is called where it is likelier than not on even odds
    weight = np.where(toxic, 1.0 / pos, 1.0 / neg)
    return fit(rows_x, severity(rows_x, toxic, grades), weight, bits=bits)


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, expected_severity, grade, p_toxic, toxic`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = T.StructType([T.StructField("expected_severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("p_toxic", T.DoubleType())])

    @F.pandas_udf(out)
    def graded(text: pd.Series) -> pd.DataFrame:
        mod = sent.value
        known: dict[str, float] = {}
        scores = np.zeros(len(text))
        for i, t in enumerate(text):
            if not t:
                continue
            hits: dict[int, tuple[float, int]] = {}
            for w, n in Counter(_WORD.findall(t.lower())).items():
                wt = known.get(w)
                if wt is None:
                    wt = known[w] = mod.weights.get(bucket(w, mod.bits), 0.0)
                if wt:
                    b = bucket(w, mod.bits)
                    hits[b] = (wt, hits.get(b, (wt, 0))[1] + n)
            scores[i] = sum(wt * np.log2(1 + n) for wt, n in hits.values())
        ge = mod.at_least(scores)
        grade = (ge >= 0.5).sum(axis=1)
        return pd.DataFrame({"expected_severity": ge.sum(axis=1), "grade": grade.astype(np.int32), "p_toxic": ge[:, 0]})

    x = docs.select(F.col(id_col), graded(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    return x.select(id_col, "s.expected_severity", "s.grade", "s.p_toxic", (F.col("s.grade") >= 1).alias("toxic"))
