"""Scalar helpers shared by the feature, audit and report operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def to_double(col: Column) -> Column:
    """Coercing numeric parse: unreadable text and NaN both become NULL."""
    number = col.try_cast("double")
    return F.when(~F.isnan(number), number)


def positive_or_null(col: Column) -> Column:
    number = to_double(col)
    return F.when(number > 0, number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is NULL when the denominator is zero or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clipped_bin(col: Column, width: float, low: float, high: float) -> Column:
    """Left edge of the histogram bin, tails folded into the end bins; NULL stays NULL."""
    edge = F.floor(col / width).cast("double") * width
    return F.when(col.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), edge)))


def band(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open ``[edge, next)`` bands; the last one is open above."""
    if len(edges) != len(labels):
        raise ValueError("give one label per lower edge")
    value = F.lit(None).cast("string")
    for edge, label in zip(edges, labels):
        value = F.when(col >= edge, F.lit(label)).otherwise(value)
    return value


def lookup(col: Column, mapping: Mapping, default: Column) -> Column:
    """Constant lookup table with a default for other and missing keys."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), default)


def joined_reasons(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Texts of the rules that hold, separated by ``"; "``."""
    text = F.concat_ws("; ", *[F.when(rule, F.lit(reason)) for rule, reason in rules])
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def mean_of_present(cols: Sequence[Column]) -> Column:
    """Row-wise mean over the values that are there; NULL if none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.try_divide(total, present.cast("double"))


def sum_of_flags(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


def running_minimum(cols: Sequence[str]) -> list[Column]:
    """Each column lowered to the smallest of it and its predecessors.

    A missing value makes the rest of the chain missing.
    """
    out = [F.col(cols[0])]
    for name in cols[1:]:
        both = out[-1].isNotNull() & F.col(name).isNotNull()
        out.append(F.when(both, F.least(out[-1], F.col(name))))
    return out


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(p / (1.0 - p))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def risk_points(score: Column, reference: Column) -> Column:
    """Log-odds effect as percentage points of risk at a reference risk."""
    return (sigmoid(clip(logit(reference) + score, -30.0, 30.0)) - reference) * 100.0


def log_loss(label: Column, probability: Column, eps: float = 1e-7) -> Column:
    p = clip(probability, eps, 1.0 - eps)
    return F.when(label == 1, -F.ln(p)).when(label == 0, -F.ln(1.0 - p))


def linear_score(weights: Mapping[str, float], intercept: float) -> Column:
    """Probability of a fixed additive model over named columns."""
    total = reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in weights.items()], F.lit(float(intercept)))
    return sigmoid(total)


def display_name(term: Column, names: Mapping[str, str]) -> Column:
    """Presentation name of a term; ``a & b`` is shown as a product of both."""
    part_name = lambda part: lookup(part, names, F.initcap(F.replace(part, F.lit("_"), F.lit(" "))))
    return F.array_join(F.transform(F.split(term, " & "), part_name), " × ")


def seeded_hash(key: Column, seed: int) -> Column:
    """Random-looking hex order that depends only on the key and the seed."""
    return F.md5(F.concat(key, F.lit(f"-{seed}")))
