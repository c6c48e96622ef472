"""Embedding providers: a registry of text-to-vector functions, and a hash embedding that needs no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessaline.functions import vectors as V

PROVIDERS: dict[str, tuple[int, int, Callable[[Column], Column]]] = {}


def register(name: str, priority: int = 0, kind: int = 0):
    def add(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        PROVIDERS[name] = (kind, priority, f)
        return f

    return add


def best(kind: int = 0) -> Callable[[Column], Column]:
    return max((p, n, f) for n, (k, p, f) in PROVIDERS.items() if k == kind)[2]


def word_hash(word: Column, modulus: int = 1 << 32) -> Column:
    """31-polynomial over UTF-8 bytes."""
    h = F.hex(F.encode(word, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("long"))
    return F.when(F.length(word) > 0, V.poly31(bytes_, modulus)).otherwise(F.lit(0).cast("long"))


@register("hash")
def hash_embedding(text: Column, dims: int = 384) -> Column:
    """Each word adds 1 / (place + 1) at its hash; unit length, null for a text without words. Arrow batches: sums by hash have no built-in form."""

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        known: dict[str, int] = {}

        def place(word: str) -> int:
            if word not in known:
                h = 0
                for c in word.encode():
                    h = (h * 31 + c) & 0xFFFFFFFF
                known[word] = h % dims
            return known[word]

        out = []
        for t in texts:
            v = np.zeros(dims)
            words = (t or "").split()
            np.add.at(v, [place(w) for w in words], 1 / np.arange(1, len(words) + 1))
            n = np.sqrt((v * v).sum())
            out.append(v / n if n else None)
        return pd.Series(out)

    return embed(text)


def file_embedding_text(kind: Column, properties: Column) -> Column:
    from tessaline.sources.tables import node_text

    return node_text(kind, properties)
