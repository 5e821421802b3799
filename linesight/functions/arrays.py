"""Array / numeric column functions built from Spark higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def pair_with(arr, scalar, name: str = "s") -> Column:
    """Pair every element with a per-row scalar: array<struct<v, name>>.

    A lambda must not reference a non-trivial expression from outside: the
    optimizer inlines it into the lambda body and re-evaluates it for every
    element (quadratic work).  ``array_repeat`` evaluates the scalar once
    per row, so lambdas read it as a field instead."""
    a = _c(arr)
    return F.arrays_zip(a.alias("v"), F.array_repeat(scalar, F.size(a)).alias(name))


def softmax_argmax(logits) -> Column:
    """logits -> struct<probs, pred, proba>; pred is the first arg-max (0-based),
    proba the max class probability."""
    x = _c(logits)
    exps = F.transform(pair_with(x, F.array_max(x), "m"), lambda e: F.exp(e["v"] - e["m"]))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    probs = F.transform(pair_with(exps, total, "t"), lambda e: e["v"] / e["t"])
    pmax = F.array_max(probs)
    pred = (F.array_position(probs, pmax) - 1).cast("int")
    return F.struct(probs.alias("probs"), pred.alias("pred"), pmax.alias("proba"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm2(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, v: acc + v * v))


def cosine_similarity(a, b) -> Column:
    """Cosine of two equal-length vectors; 0 when either has zero norm
    (the convention of the usual library implementation)."""
    den = norm2(a) * norm2(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def zero_special_tokens(scores, padding: bool = True) -> Column:
    """First value := 0; last non-zero value := 0 (padding) or last value := 0."""
    s = _c(scores)
    n = F.size(s)
    if padding:
        # 1-based position of the last non-zero value, 0 when there is none
        rev = F.array_position(F.reverse(F.transform(s, lambda v: v != 0)), True)
        last_nz = F.when(rev > 0, n - rev).otherwise(F.lit(-1))
    else:
        last_nz = n - 1
    return F.transform(pair_with(s, last_nz, "z"), lambda e, i: F.when(
        (i == 0) | (i == e["z"]), F.lit(0.0)).otherwise(e["v"].cast("double")))


def pad_sequence(arr, n: int, pad=0) -> Column:
    """Post-pad with ``pad`` to length n, truncate longer sequences."""
    a = _c(arr)
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad).cast("int"), F.lit(n))), 1, n)


def fbeta(precision, recall, beta: float = 2.0) -> Column:
    p, r = _c(precision), _c(recall)
    b2 = beta * beta
    den = b2 * p + r
    return F.when(den == 0, F.lit(0.0)).otherwise((1 + b2) * p * r / den)


def percent(col, digits: int = 2) -> Column:
    return F.round(_c(col) * 100.0, digits)
