"""Quality rules as weak supervision.

Each rule votes *good* (1), *bad* (-1) or abstains (0) on a document.  A
two-class latent model (good / bad; votes independent given the class) is
fitted by expectation-maximisation on the counts of vote patterns over **all**
documents that pass the base rules, and a document is kept when its posterior probability of being good
reaches ``threshold`` and the base rules hold.

How it runs on Spark: one Arrow pass measures each text (narrow, nothing is
shuffled but pattern counts), the rules are Catalyst expressions on the
measures, patterns are counted with map-side combine.  With ``K`` rules there
are at most ``3**K`` patterns whatever the input size, so the driver receives
a bounded table of counts and sends back a table of posteriors of the same
bound (a broadcast join).

Defined results: a null text counts as an empty one (no words, base rules
fail); repeated rows are scored alike; an empty table gives an empty result;
all other columns, also null ones, pass through unread.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_upper", "n_letters", "n_digits", "n_bang", "n_ended", "n_marked", "n_stutter",
)
_ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "»", "”", "…")


def repeated_words(words: list[str], size: int = REPEAT_WINDOW) -> int:
    """Words inside ``size``-word windows that occur twice or more in the text
    (first occurrence included).  Windows are screened by a rolling 64-bit
    combination of word hashes; only those that screen as repeated are
    compared word by word, so the count is exact."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        key *= np.uint64(0x9E3779B97F4A7C15)
        key += h[k : k + n]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, dtype=bool)
    again[1:] |= same
    again[:-1] |= same
    seen: dict[tuple, list[int]] = {}
    for i in order[again].tolist():
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for at in seen.values():
        if len(at) > 1:
            at = np.asarray(at)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: str | None) -> tuple:
    """The measures of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return (0,) * len(MEASURES)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    upper = letters = 0
    if text.isascii():
        b = np.frombuffer(text.encode("ascii"), dtype=np.uint8)
        up = int(((b >= 65) & (b <= 90)).sum())
        upper, letters = up, up + int(((b >= 97) & (b <= 122)).sum())
    else:
        low = text.lower()
        cp = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lw = np.frombuffer(low.encode("utf-32-le"), dtype=np.uint32)
        upper = int((cp != lw).sum()) if len(cp) == len(lw) else sum(c.isupper() for c in text)
        letters = int((((cp | 32) >= 97) & ((cp | 32) <= 122)).sum() + (cp >= 0xC0).sum())
    digits = sum(text.count(c) for c in "0123456789")
    symbols = sum(text.count(c) for c in SYMBOLS)
    return (
        n,
        sum(map(len, words)),
        symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        letters,
        digits,
        text.count("!"),
        sum(x.rstrip().endswith(_ENDS) for x in lines),
        sum(w[-1] in SYMBOLS for w in words) if symbols else 0,
        sum(map(eq, words, islice(words, 1, None))),
    )


_ROWS = 256  # texts held as Python strings at a time


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in MEASURES]))
def _measured(text: pa.Array) -> pa.Array:
    rows = [measure(t) for k in range(0, len(text), _ROWS) for t in text.slice(k, _ROWS).to_pylist()]
    columns = np.array(rows, dtype=np.int64).reshape(len(rows), len(MEASURES))
    return pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(len(MEASURES))], names=list(MEASURES))


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are conditions on the measures; neither: abstain."""

    name: str
    good: Column
    bad: Column


def default_rules() -> list[Rule]:
    c = lambda n: F.col(f"m.{n}")
    words = F.greatest(c("n_words"), F.lit(1))
    letters = F.greatest(c("n_letters"), F.lit(1))
    lines = F.greatest(c("n_lines"), F.lit(1))
    return [
        Rule("symbols", c("n_symbols") * 100 <= words, c("n_symbols") * 10 > words),
        Rule("marked_words", c("n_marked") * 100 <= words, c("n_marked") * 10 > words),
        Rule("letter_share", (c("n_letters") + c("n_digits")) * 100 >= c("word_chars") * 93, (c("n_letters") + c("n_digits")) * 100 < c("word_chars") * 89),
        Rule("stutter", c("n_stutter") * 100 <= words * 2, c("n_stutter") * 100 > words * 20),
        Rule("shouting", c("n_upper") * 100 <= letters * 10, c("n_upper") * 100 > letters * 40),
        Rule("exclaiming", c("n_bang") * 100 <= words, c("n_bang") * 5 > words),
        Rule("line_copies", c("n_dup_lines") * 100 <= lines * 10, c("n_dup_lines") * 100 > lines * 50),
        Rule("word_length", (c("word_chars") >= words * 4) & (c("word_chars") <= words * 8), (c("word_chars") < words * 2) | (c("word_chars") > words * 15)),
        Rule("line_ends", c("n_ended") * 10 >= lines * 7, c("n_ended") * 10 < lines * 2),
        Rule("digits", c("n_digits") * 50 <= c("word_chars"), c("n_digits") * 5 > c("word_chars")),
    ]


def _vote(rule: Rule) -> Column:
    return F.when(F.coalesce(rule.bad, F.lit(False)), -1).when(F.coalesce(rule.good, F.lit(False)), 1).otherwise(0)


def pattern_code(rules: list[Rule]) -> Column:
    """The votes as one base-3 number."""
    code = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        code = code + (_vote(r) + 1).cast("long") * F.lit(3**k)
    return code


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``m`` of measures (null text: empty)."""
    return docs.withColumn("m", _measured(F.coalesce(F.col(text_col), F.lit(""))))


def fit(counts: list[tuple[int, int]], n_rules: int, *, rounds: int = 200, tol: float = 1e-9, belief: float = 0.05) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over pattern counts.

    Returns the prior of *good* and ``p[class, rule, vote + 1]`` (class 0 bad,
    1 good).  The start and a weak belief (``belief`` of the documents, so it
    weighs alike at every size) say that a bad vote is rare on good documents;
    this fixes which latent class is which.
    """
    start = np.empty((2, n_rules, 3))
    start[1] = (0.02, 0.08, 0.90)
    start[0] = (0.35, 0.15, 0.50)
    p, prior = start.copy(), 0.85
    if not counts:
        return prior, p
    counts = sorted(counts)
    code = np.array([c for c, _ in counts], dtype=np.int64)
    n = np.array([k for _, k in counts], dtype=np.float64)
    votes = np.stack([(code // 3**k) % 3 for k in range(n_rules)], axis=1)
    total, last = n.sum(), -math.inf
    weight = belief * total
    for _ in range(rounds):
        ll = np.stack([np.log(p[c][np.arange(n_rules), votes]).sum(axis=1) for c in (0, 1)])
        ll += np.log([[1 - prior], [prior]])
        top = ll.max(axis=0)
        e = np.exp(ll - top)
        z = e.sum(axis=0)
        post = e / z
        now = float((n * (top + np.log(z))).sum()) / total
        r = post * n
        for c in (0, 1):
            for v in range(3):
                p[c, :, v] = (r[c][:, None] * (votes == v)).sum(axis=0) + weight * start[c, :, v]
            p[c] /= p[c].sum(axis=1, keepdims=True)
        prior = float((r[1].sum() + weight * 0.85) / (total + weight))
        if abs(now - last) < tol:
            break
        last = now
    return prior, p


def posteriors(codes: list[int], prior: float, p: np.ndarray) -> list[tuple[int, float]]:
    out = []
    for code in codes:
        ll = [math.log(1 - prior), math.log(prior)]
        x = code
        for k in range(p.shape[1]):
            v, x = x % 3, x // 3
            ll[0] += math.log(p[0, k, v])
            ll[1] += math.log(p[1, k, v])
        out.append((int(code), 1.0 / (1.0 + math.exp(min(700.0, ll[0] - ll[1])))))
    return out


def base_failed() -> Column:
    return (F.col("m.n_words") < 20) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * 30)


def score(coded: DataFrame, n_rules: int, *, threshold: float = 0.5) -> DataFrame:
    """``coded`` (columns ``m`` and ``pattern``) with ``p_good`` and ``kept``.

    ``coded`` is read twice: for the pattern counts and for the result.
    """
    passed = F.count(F.when(~base_failed(), 1)).alias("n")  # the base rules have already judged the others
    counts = [(r["pattern"], r["n"]) for r in coded.groupBy("pattern").agg(passed).collect()]  # 3**n_rules rows at most
    prior, p = fit([(c, n) for c, n in counts if n], n_rules)
    table = coded.sparkSession.createDataFrame(posteriors([c for c, _ in counts], prior, p), "pattern long, p_good double")
    out = coded.join(F.broadcast(table), "pattern", "left")  # as many rows as counts
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("p_good"), F.lit(0.0)) >= F.lit(threshold)))


def quality_scores(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """Measures, posterior and verdict of every row; the measures (no texts)
    are written once to the checkpoint folder and read for both passes."""
    from draftsmith.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    rules = default_rules()
    m = measured(docs.select(*keep, F.col(text_col).alias("__text")), "__text").drop("__text")
    coded = m.withColumn("pattern", pattern_code(rules)).checkpoint()
    return score(coded, len(rules), threshold=threshold)


def quality_filter(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept, columns unchanged.  Rows and measures
    are written once to the checkpoint folder and read for the verdicts, so no
    text is measured twice or shuffled."""
    from draftsmith.session import checkpoint_dir

    checkpoint_dir(docs.sparkSession)
    rules = default_rules()
    names = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(names)])
    m = measured(hidden, f"__d{names.index(text_col)}").withColumn("pattern", pattern_code(rules)).checkpoint()
    kept = score(m, len(rules), threshold=threshold).where("kept")
    return kept.select(*[F.col(f"__d{i}").alias(c) for i, c in enumerate(names)])
