"""Column functions: labels, scores and rounding. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_key(c: Column | str) -> Column:
    """Lower case without outer blanks."""
    return F.lower(F.trim(col(c)))


def clean_label(c: Column | str) -> Column:
    """Underscores become blanks; outer blanks go."""
    return F.trim(F.translate(col(c), "_", " "))


def capitalize(c: Column | str) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.lower(F.substring(col(c), 2, 1 << 30)))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def one_decimal(c: Column | str) -> Column:
    """A number that isn't negative as text with one decimal, halves up."""
    tenths = round_half_up(col(c) * 10)
    return F.concat(F.floor(tenths / 10), F.lit("."), tenths % 10)


def confidence_pct(c: Column | str) -> Column:
    return F.round(col(c) * 100, 2)


def confidence_band(c: Column | str) -> Column:
    return F.when(col(c) > 80, "high").otherwise("medium")


def softmax(logits: Column | str) -> Column:
    """Of an array; the largest logit is taken off first, so large ones don't overflow. Null for null and empty arrays stay empty."""
    x = col(logits)
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_softmax(logits: Column | str) -> Column:
    x = col(logits)
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: v - top - F.log(total))


def top_k(probs: Column | str, classes: Column | str, k: int = 3) -> Column:
    """The k (or all, if fewer) most probable classes as (label, confidence in percent); of equal ones the lower index comes first. A score beyond the classes has a null label."""
    p, names = col(probs), col(classes)
    rows = F.transform(p, lambda v, i: F.struct((-v).alias("p"), i.alias("i"), F.get(names, i).alias("label")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda r: F.struct(clean_label(r["label"]).alias("label"), confidence_pct(-r["p"]).alias("confidence")))


def smoothed_cross_entropy(logits: Column | str, label: Column | str, eps: float = 0.1) -> Column:
    """Label-smoothed: (1 - eps) of the weight on the label, eps spread over all classes."""
    lp = log_softmax(logits)
    return -(1 - eps) * F.get(lp, col(label)) - eps / F.size(lp) * F.aggregate(lp, F.lit(0.0), lambda a, b: a + b)


def is_correct(logits: Column | str, label: Column | str) -> Column:
    """Whether the largest logit (the first of equal ones) is the label's."""
    x = col(logits)
    return F.array_position(x, F.array_max(x)) - 1 == col(label)


def discount_pct(price: Column | str, mrp: Column | str) -> Column:
    """Whole percent off the list price, halves up; null if it's not over 0, or there's no list price or one of 0."""
    pct = round_half_up((1 - F.try_divide(col(price), col(mrp))) * 100)
    return F.when(pct > 0, pct)


def stars(rating: Column | str) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(5), round_half_up(col(rating)).cast("int")))
