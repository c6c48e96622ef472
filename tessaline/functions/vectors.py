"""Distances and scalar functions over vectors, as column expressions. A vector is an array of numbers; all maths is in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DIMS = 4096


def vec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def hamming(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: ((x > 0.5) != (y > 0.5)).cast("double")))


def cosine_distance(a: Column, b: Column, on_zero: str = "one") -> Column:
    """1 - cosine. A zero vector is at distance one, infinity ("inf") or null ("null") of all others."""
    zero = {"one": F.lit(1.0), "inf": F.lit(float("inf")), "null": F.lit(None).cast("double")}[on_zero]
    n = norm(a) * norm(b)
    return F.when(n == 0, zero).otherwise(1 - dot(a, b) / F.nullif(n, F.lit(0.0)))


def distance(metric: str, a: Column, b: Column, on_zero: str = "one") -> Column:
    try:
        return {"l2": l2, "l1": l1, "hamming": hamming, "dot": lambda x, y: -dot(x, y), "cosine": lambda x, y: cosine_distance(x, y, on_zero)}[metric](a, b)
    except KeyError:
        raise ValueError(f"unknown metric {metric}") from None


def normalize(a: Column) -> Column:
    """Unit length; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def strided(a: Column, dims: int) -> Column:
    step = max(1, dims // 64)
    return a if step == 1 else F.filter(a, lambda x, i: i % step == 0)


def approximate_l2(a: Column, b: Column, dims: int) -> Column:
    """Over every (dims / 64)-th component, scaled up."""
    step = max(1, dims // 64)
    x, y = strided(a, dims), strided(b, dims)
    return F.sqrt(total(F.zip_with(x, y, lambda p, q: (p - q) * (p - q))) * step)


def approximate_cosine(a: Column, b: Column, dims: int) -> Column:
    return cosine_distance(strided(a, dims), strided(b, dims))


def prunes(a: Column, b: Column, dims: int, subset: int, threshold: float) -> Column:
    """True where the scaled distance over evenly spaced components is above the threshold. Lossy: only on request."""
    step = max(1, dims // subset)
    keep = lambda c: F.filter(c, lambda x, i: (i % step == 0) & (i / step < subset))
    partial = total(F.zip_with(keep(a), keep(b), lambda x, y: (x - y) * (x - y)))
    return F.sqrt(partial * (dims / subset)) > threshold


def score(distance_: Column, kind: str = "one_minus") -> Column:
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return {
        "one_minus": lambda d: 1 - d, "inverse": lambda d: 1 / (1 + d), "exponential": lambda d: F.exp(-d), "clamped": lambda d: 1 - clamp(d), "shifted": lambda d: (d + 1) / 2, "capped": lambda d: 1 - F.least(d, F.lit(1.0)),
    }[kind](distance_)


def sparsity(a: Column, eps: float = 1e-6) -> Column:
    return F.size(F.filter(a, lambda x: F.abs(x) < eps)) / F.size(a)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def spread(a: Column) -> Column:
    """Population standard deviation of the components."""
    m = mean(a)
    return F.sqrt(total(F.transform(a, lambda x: (x - m) * (x - m))) / F.size(a))


def entropy(a: Column, bins: int = 10) -> Column:
    """Shannon entropy in bits of |x| / max * (bins - 1), cut down to a bin each."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x)))
    binned = F.transform(a, lambda x: F.when(top > 0, F.floor(F.abs(x) / top * (bins - 1))).otherwise(F.lit(0)).cast("int"))
    shares = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(binned, lambda b: b == k)) / F.size(binned))
    return total(F.transform(shares, lambda p: F.when(p > 0, -p * F.log2(p)).otherwise(0.0)))


def to_float(kind: str, a: Column) -> Column:
    """Stored components as numbers: int8 / 127, int16 / 32767, binary != 0."""
    return {"int8": F.transform(a, lambda x: x / 127), "int16": F.transform(a, lambda x: x / 32767), "binary": F.transform(a, lambda x: (x != 0).cast("double")), "float32": vec(a)}[kind]


def parse(text: Column) -> Column:
    """A vector written as "a,b,c"."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x).cast("double"))


def poly31(values: Column, modulus: int = 1 << 32) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: (s * 31 + x.cast("long")) % modulus)


def byte_sum(values: Column, modulus: int = 1 << 32) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: (s + x.cast("long")) % modulus)


def cache_key(a: Column) -> Column:
    """A hash that is equal for vectors equal to four decimals."""
    return F.xxhash64(F.transform(a, lambda x: (x * 10000).cast("long")))


def clamped_cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 where it is negative or a vector is zero."""
    return F.greatest(F.lit(0.0), 1 - cosine_distance(a, b))


def equal_share(a: Column, b: Column) -> Column:
    """The share of equal components of two code arrays, over the longer one."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e)) / F.greatest(F.size(a), F.size(b))


def byte_entropy(text: Column) -> Column:
    """Shannon entropy of the bytes of a string, over 8 bits: 0 to 1. An empty string has 0."""
    h = F.hex(F.encode(text, "UTF-8"))
    each = F.when(F.length(h) > 0, F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.substring(h, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    shares = F.transform(F.array_distinct(each), lambda b: F.size(F.filter(each, lambda x: x == b)) / F.size(each))
    return total(F.transform(shares, lambda p: -p * F.log2(p))) / 8


def cache_value(frequency: Column, size: Column, compression: Column, priority: Column) -> Column:
    return frequency / F.sqrt(size) * compression * (1 + priority)


def query_class(dims: Column, k: Column, filtered: Column, approximate: Column) -> Column:
    """simple, moderate, complex or heavy, by points for dimensions, k, a filter and exactness."""
    points = (dims > 512).cast("int") + (dims > 1024).cast("int") + (k > 100).cast("int") + filtered.cast("int") + (~approximate).cast("int")
    return F.when(points <= 1, "simple").when(points == 2, "moderate").when(points == 3, "complex").otherwise("heavy")
