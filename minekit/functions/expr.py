"""Column builders: scalar functions of the tabular pipelines. Nulls pass through unless a name says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    return F.round(c, 6)


def indicator(cond: Column) -> Column:
    return cond.cast("int")


def clip_low(c: Column, low: float) -> Column:
    """Null stays null, which greatest() would not keep."""
    return F.when(c < low, F.lit(float(low))).otherwise(c)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def log_base(c: Column, base: float) -> Column:
    return F.ln(c) / F.ln(F.lit(base))


def ratio(a: Column, b: Column) -> Column:
    """Null on division by zero."""
    return F.try_divide(a, b)


def logit(p: Column, eps: float | None = 1e-7) -> Column:
    """ln(p / (1 - p)) of p kept eps from 0 and 1; without eps infinite at 0 and 1, and NaN outside."""
    if eps is None:
        odds = F.ln(p / (F.lit(1.0) - p))
        return F.when(p == 0, F.lit(float("-inf"))).when(p == 1, F.lit(float("inf"))).when((p < 0) | (p > 1), F.lit(float("nan"))).otherwise(odds)
    p = F.when(p < eps, F.lit(eps)).when(p > 1 - eps, F.lit(1 - eps)).otherwise(p)
    return F.ln(p / (F.lit(1.0) - p))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax(logits: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logits)
    powers = [F.exp(x - top) for x in logits]
    total = sum(powers[1:], powers[0])
    return [p / total for p in powers]


def argmax_label(scores: Sequence[Column], labels: Sequence[str]) -> Column:
    """The first label of the greatest score."""
    top = F.greatest(*scores)
    out = F.lit(labels[-1])
    for s, label in reversed(list(zip(scores[:-1], labels[:-1], strict=True))):
        out = F.when(s == top, F.lit(label)).otherwise(out)
    return out


def linear(intercept: float, terms: Sequence[tuple[Column, float]]) -> Column:
    out = F.lit(float(intercept))
    for c, w in terms:
        out = out + c * F.lit(float(w))
    return out


def map_default(c: Column, mapping: dict, default: object) -> Column:
    out = F.lit(default)
    for k, v in mapping.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def case3(c: Column, low: float, mid: float, labels: tuple[str, str, str]) -> Column:
    return F.when(c <= low, labels[0]).when(c <= mid, labels[1]).otherwise(labels[2])


def id_fold(c: Column, k: int) -> Column:
    """A fold from 28 bits of the md5 of the key as text; the same in any SQL engine."""
    return (F.conv(F.substring(F.md5(c.cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % k).cast("long")


def acceptance(kind: str, old: Column, new: Column, t: Column) -> Column:
    """Annealing acceptance: exponential, custom (a logistic curve) or linear."""
    delta = new - old
    return {"EXP": F.exp(delta / t), "CUSTOM": F.lit(1.0) / (F.lit(1.0) + F.exp(-delta / t)), "LINEAR": (t * new > old).cast("double")}[kind]


# Text and set functions


def shingles(text: Column, k: int) -> Column:
    """Distinct k-character substrings but for the last start (len - k starts); empty for texts of k characters or fewer."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    return F.when(F.length(text) > k, F.array_distinct(F.slice(every, F.lit(1), F.length(text) - k))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def signature_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a).cast("double")


def minhash(items: Column, params: Sequence[tuple[int, int]], prime: int = 2147483647) -> Column:
    """min((a x + b) mod prime) for each (a, b); null for empty sets. Items are longs under prime."""
    table = F.array(*[F.struct(F.lit(int(a)).cast("long").alias("a"), F.lit(int(b)).cast("long").alias("b")) for a, b in params])
    return F.when(F.size(items) > 0, F.transform(table, lambda p: F.array_min(F.transform(items, lambda x: F.pmod(x * p["a"] + p["b"], F.lit(prime).cast("long"))))))


def band_sums(signature: Column, n: int, rows: int) -> Column:
    """Array of the bands' sums; a band holds rows entries."""
    return F.array(*[F.aggregate(F.slice(signature, i + 1, min(rows, n - i)), F.lit(0).cast("long"), lambda s, x: s + x) for i in range(0, n, rows)])
