"""Vector codecs as column expressions: each encode has a decode, and a known bound of its error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(a: Column, bits: int) -> Column:
    """struct(low, step, codes): linear codes of 0 .. 2**bits - 1 between the least and largest component; a constant vector has codes 0."""
    top = (1 << bits) - 1
    low, high = F.array_min(a), F.array_max(a)
    codes = F.transform(a, lambda x: F.when(high > low, F.least(F.lit(top), F.greatest(F.lit(0), F.floor((x - low) / (high - low) * top + 0.5).cast("int")))).otherwise(F.lit(0)))
    return F.struct(low.alias("low"), ((high - low) / top).alias("step"), codes.alias("codes"))


def dequantize(q: Column) -> Column:
    return F.transform(q["codes"], lambda c: q["low"] + c * q["step"])


def subspaces(a: Column, dims: int, parts: int = 8, bits: int = 8) -> Column:
    """An array of quantised slices; the last takes what is left over."""
    size = max(1, dims // parts)
    cuts = [(i * size + 1, size if i < parts - 1 else dims - size * (parts - 1)) for i in range(parts)]
    return F.array(*[quantize(F.slice(a, s, n), bits) for s, n in cuts])


def from_subspaces(q: Column) -> Column:
    return F.flatten(F.transform(q, dequantize))


def sparse(a: Column, eps: float = 1e-6) -> Column:
    """An array of struct(i, x) of the components beyond eps."""
    return F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda e: F.abs(e["x"]) > eps)


def from_sparse(s: Column, dims: int) -> Column:
    m = F.map_from_arrays(s["i"], s["x"])
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def delta(values: Column) -> Column:
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def from_delta(values: Column) -> Column:
    step = lambda s, x: F.concat(s, F.array(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + x))
    return F.aggregate(values, F.array().cast("array<int>"), step)


def run_lengths(values: Column) -> Column:
    """An array of struct(value, n)."""
    starts = F.filter(F.transform(values, lambda x, i: F.when((i == 0) | (x != F.get(values, i - 1)), i)), lambda i: i.isNotNull())
    return F.transform(starts, lambda s, k: F.struct(F.get(values, s).alias("value"), (F.coalesce(F.get(starts, k + 1), F.size(values)) - s).alias("n")))


def from_run_lengths(runs: Column) -> Column:
    return F.flatten(F.transform(runs, lambda r: F.array_repeat(r["value"], r["n"])))


def scalar_codes(a: Column, scale: float, offset: float = 0.0, signed: bool = True) -> Column:
    low, high = (-128, 127) if signed else (0, 255)
    return F.transform(a, lambda x: F.least(F.lit(high), F.greatest(F.lit(low), F.floor((x - offset) / scale + 0.5).cast("int"))))


def binary_codes(a: Column, threshold: float = 0.0) -> Column:
    """64 components a long, first ones in the low bits."""
    bits = F.transform(a, lambda x: (x >= threshold).cast("long"))
    words = F.sequence(F.lit(0), F.ceil(F.size(a) / 64).cast("int") - 1)
    return F.transform(words, lambda w: F.aggregate(F.transform(F.slice(bits, w * 64 + 1, F.lit(64)), lambda b, i: F.struct(b.alias("b"), i.alias("i"))), F.lit(0).cast("long"), lambda s, e: s.bitwiseOR(F.call_function("shiftleft", e["b"], e["i"]))))


def binary_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def choose(sparsity: Column, entropy: Column, dims: Column) -> Column:
    """The codec that suits a vector: many zeros, little variety, many dimensions, or none of these."""
    return F.when(sparsity > 0.5, "sparse").when(entropy < 1.5, "run_length").when(dims >= 1024, "subspace").when(dims >= 256, "quantize4").when(dims >= 16, "quantize8").otherwise("none")
