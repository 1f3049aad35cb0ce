"""Distribution losses over logit arrays as Column expressions.

Logits are ``array<double>`` columns; everything is a higher-order array
function (``transform`` / ``zip_with`` / ``aggregate``) evaluated in the
JVM.  Log-sum-exp subtracts the row max first, so large logits are safe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-5  # fixed value: floor of the overlap inside -log(alpha)


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """Bind ``value`` once per row and use it in ``body`` (a lambda).

    A per-row scalar captured inside a ``transform`` lambda is re-evaluated
    for every element; binding it through a one-element ``transform`` keeps
    each softmax linear in the vocabulary size.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def logsumexp(x: Column) -> Column:
    return let(F.array_max(x), lambda m: m + F.log(_sum(F.transform(x, lambda v: F.exp(v - m)))))


def log_softmax(x: Column) -> Column:
    """``x - logsumexp(x)``."""
    return let(logsumexp(x), lambda lse: F.transform(x, lambda v: v - lse))


def softmax(x: Column) -> Column:
    return let(logsumexp(x), lambda lse: F.transform(x, lambda v: F.exp(v - lse)))


def _kl_terms(la: Column, lb: Column) -> Column:
    """``sum exp(a) * (a - b)`` over two log-probability arrays; ``exp(a)=0`` terms are 0."""
    return _sum(F.zip_with(la, lb, lambda a, b: F.when(F.exp(a) > 0, F.exp(a) * (a - b)).otherwise(0.0)))


def kl(draft: Column, target: Column) -> Column:
    """``sum p (log p - log q)``, ``p = softmax(target)``, ``q = softmax(draft)``; ``p=0`` terms are 0."""
    return let(log_softmax(draft), lambda lq: let(log_softmax(target), lambda lp: _kl_terms(lp, lq)))


def rkl(draft: Column, target: Column) -> Column:
    """KL with the arguments swapped, ``sum q (log q - log p)``."""
    return let(log_softmax(draft), lambda lq: let(log_softmax(target), lambda lp: _kl_terms(lq, lp)))


def argmax(x: Column) -> Column:
    """0-based index of the first maximum."""
    return let(x, lambda a: (F.array_position(a, F.array_max(a)) - 1).cast("int"))


def ce(draft: Column, target: Column) -> Column:
    """cross-entropy of the draft against the argmax of the target."""
    return let(argmax(target), lambda idx: -F.element_at(log_softmax(draft), idx + 1))


def overlap(draft: Column, target: Column) -> Column:
    """Acceptance rate ``alpha = sum min(p, q)``."""
    return _sum(F.zip_with(softmax(draft), softmax(target), lambda a, b: F.least(a, b)))


def tv(draft: Column, target: Column) -> Column:
    """``1 - alpha``."""
    return F.lit(1.0) - overlap(draft, target)


def nla(draft: Column, target: Column) -> Column:
    """``-log(max(alpha, 1e-5))``."""
    return -F.log(F.greatest(overlap(draft, target), F.lit(EPS)))


def lk_hybrid(draft: Column, target: Column, eta: float = 3.0) -> Column:
    """``lam*KL + (1-lam)*TV`` with ``lam = exp(-eta*alpha)``."""
    return let(
        overlap(draft, target),
        lambda a: F.exp(-eta * a) * kl(draft, target) + (F.lit(1.0) - F.exp(-eta * a)) * (F.lit(1.0) - a),
    )


def block_decay(pos: Column, gamma: float) -> Column:
    """F8: 0 at position 0, 1 at 1, ``exp(-(p-1)/gamma)`` after."""
    return F.when(pos == 0, F.lit(0.0)).otherwise(F.exp(-F.greatest(pos - 1, F.lit(0)) / F.lit(gamma)))


def power_decay(pos: Column, gamma: float) -> Column:
    """``gamma ** p``."""
    return F.pow(F.lit(gamma), pos)


def step_weights(num_steps: int = 3, beta: float = 0.6) -> list[float]:
    """normalised ``beta**k / sum_j beta**j`` (a model constant, K rows)."""
    raw = [beta**k for k in range(num_steps)]
    tot = sum(raw)
    return [w / tot for w in raw]


def bce_with_logits(x: Column, z: Column) -> Column:
    """``max(x,0) - x*z + log1p(exp(-|x|))``."""
    return F.greatest(x, F.lit(0.0)) - x * z + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


LOSSES = {"kl": kl, "rkl": rkl, "ce": ce, "tv": tv, "nla": nla, "lk_hybrid": lk_hybrid}


def parse_loss_spec(spec) -> dict[str, float]:
    """F11 + X8: a loss name, or a JSON object / dict ``{name: weight}`` over
    the pluggable loss table ``LOSSES``.

    Unknown names, non-numeric weights and empty specs raise ``ValueError``.
    """
    import json

    if isinstance(spec, str):
        s = spec.strip()
        if not s:
            raise ValueError("empty loss spec")
        if s.startswith("{"):
            try:
                spec = json.loads(s)
            except json.JSONDecodeError as e:
                raise ValueError(f"bad loss spec JSON: {e}") from e
        else:
            spec = {s: 1.0}
    if not isinstance(spec, dict) or not spec:
        raise ValueError("loss spec must be a name or a non-empty mapping")
    out = {}
    for name, w in spec.items():
        if name not in LOSSES:
            raise ValueError(f"unknown loss {name!r}; choose from {sorted(LOSSES)}")
        if isinstance(w, bool) or not isinstance(w, (int, float)):
            raise ValueError(f"weight of {name!r} must be a number")
        out[name] = float(w)
    return out
