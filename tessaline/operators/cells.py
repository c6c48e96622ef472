"""Every query with every row, as matrix products of dealt blocks.

Rows are dealt by a hash of their id to parts, queries too, and each cell of the grid, a part of the rows with a part of the
queries, is one task's group: only vectors travel, never pairs. In a cell one matrix product bounds the distances of
all pairs from below; only pairs within the k-th best so far, give or take the error of the product and the rounding,
are measured exactly. So the answer is exact, ties go to the smaller id, and what leaves a cell is k rows a query.

Defined cases: a null id, a null vector or a null component takes no part; only vectors of equal length meet; a
distance that is not a number comes after all others. Of equal vectors in a part only the first ids can be answers, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Components of a part, and rows and queries of one matrix product.
PART_VALUES, TILE = 1 << 21, 2048
#: Pairs that are measured at once, and pairs of a cell that gives a row for each.
AT_ONCE, LISTED = 1 << 15, 1 << 20
#: Components beyond this are measured without products, whose squares would overflow.
LARGE = 1e100
ROUNDING = 1.2e-6
NOT_A_NUMBER, INFINITE = 1.7e308, 1.6e308

Cell = Callable[[pa.Array, np.ndarray, pa.Array, np.ndarray], list[pa.Array]]


def met(data: DataFrame, queries: DataFrame, work: Cell, schema: str, id_col: str, vector_col: str, listed: bool = False) -> DataFrame:
    """What `work` (ids, vectors, query ids, query vectors) makes of each cell; `listed`: cells are small, since each pair gives a row."""

    def plain(df: DataFrame) -> DataFrame:
        kind = dict(df.dtypes)[vector_col]
        return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("v")).where("id is not null and v is not null").withColumn("dim", F.size("v"))

    d, q = plain(data), plain(queries)
    (n, dims), (m, _) = (x.agg(F.count("*"), F.max("dim")).first() for x in (d, q))
    cores = max(1, data.sparkSession.sparkContext.defaultParallelism)
    most = max(64, PART_VALUES // max(1, dims or 1))
    most = min(most, 1 << (LISTED.bit_length() // 2)) if listed else most
    across = max(1, -(-m // most))
    down = max(1, -(-n // most), min(-(-3 * cores // across), -(-n // 1024)))
    width = 4 * across * down if across * down > 1 else 1
    part = lambda of: F.pmod(F.xxhash64("id"), F.lit(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    dealt = d.withColumn("a", part(down)).withColumn("b", each(across)).repartition(width, "dim", "a", "b")
    asked = q.withColumn("b", part(across)).withColumn("a", each(down)).repartition(width, "dim", "a", "b")
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        (ids, x), (query_ids, y) = _columns(rows), _columns(wanted)
        if not len(ids) or not len(query_ids):
            return fields.empty_table()
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in work(ids, x, query_ids, y)], names=fields.names)

    return dealt.groupBy("dim", "a", "b").cogroup(asked.groupBy("dim", "a", "b")).applyInArrow(run, schema)


def _columns(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """Ids, and vectors as a matrix; rows with a null component are left out."""
    ids, v = (c.combine_chunks() for c in (t.column("id"), t.column("v")))
    ids, v = ((pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)) if isinstance(c, pa.ChunkedArray) else c for c in (ids, v))
    dims, values = (len(v[0]) if len(v) else 0), v.flatten()
    whole = np.ones(len(ids), bool)
    if values.null_count:
        whole = ~np.asarray(values.is_null()).reshape(len(ids), dims).any(axis=1)
    x = np.asarray(values.fill_null(0) if values.null_count else values, dtype=np.float64).reshape(len(ids), dims)
    return (ids, x) if whole.all() else (ids.filter(pa.array(whole)), x[whole])


def half_up(d: np.ndarray) -> np.ndarray:
    """Rounded to six digits as Spark's round() does: half up, of the shortest decimal."""
    with np.errstate(invalid="ignore", over="ignore"):
        s = np.abs(d) * 1e6
        low = np.floor(s)
        out = np.copysign(np.floor(s + 0.5) / 1e6, d) + 0.0
        unsure = (np.abs(s - low - 0.5) < 1e-6 + s * 4e-16) | (s > 1e12)
    large = ~(np.abs(d) < 1e15)
    out[large] = d[large]
    for i in np.flatnonzero(unsure & ~large):
        out[i] = float(Decimal(repr(float(d[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0
    return out


def measure(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of `a` from the same rows of `b`, as `functions.vectors.distance` defines them."""
    with np.errstate(all="ignore"):
        if metric == "l2":
            diff = a - b
            return np.sqrt(np.einsum("ij,ij->i", diff, diff))
        if metric == "l1":
            return np.abs(a - b).sum(axis=1)
        if metric == "hamming":
            return (~(a <= 0.5) != ~(b <= 0.5)).sum(axis=1).astype(np.float64)  # as in Spark, NaN is over all numbers
        dot = np.einsum("ij,ij->i", a, b)
        if metric == "dot":
            return -dot
        n = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
        return np.where(n == 0, 1.0, 1 - dot / np.where(n == 0, 1.0, n))


def measured_pairs(metric: str, x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for s in range(0, len(i), AT_ONCE):
        out[s : s + AT_ONCE] = measure(metric, x[i[s : s + AT_ONCE]], y[j[s : s + AT_ONCE]])
    return out


class Bounds:
    """Lower bounds of all distances of a tile, in an order-preserving scale: squares for l2, else the distance itself."""

    def __init__(self, metric: str, x: np.ndarray, y: np.ndarray):
        self.metric, self.x, self.y = metric, x, y
        self.odd_x, self.odd_y = (~(np.abs(z) <= LARGE).all(axis=1) for z in (x, y))
        self.direct = metric not in ("l2", "dot", "cosine")
        if self.direct:
            return
        u, w = np.where(self.odd_x[:, None], 0.0, x), np.where(self.odd_y[:, None], 0.0, y)
        uu, ww = np.einsum("ij,ij->i", u, u), np.einsum("ij,ij->i", w, w)
        ones, delta = np.ones, (x.shape[1] + 16) * 1e-15
        if metric == "l2":
            self.u, self.w = np.column_stack([u, uu, ones(len(u))]), np.column_stack([-2 * w, ones(len(w)), ww])
            self.error = delta * 2 * (uu.max(initial=0.0) + ww)
        elif metric == "dot":
            self.u, self.w = u, -w
            self.error = delta * np.sqrt(uu.max(initial=0.0) * ww)
        else:
            unit = lambda z, zz: z / np.where(zz > 0, np.sqrt(zz), 1.0)[:, None]
            self.u, self.w = np.column_stack([unit(u, uu), ones(len(u))]), np.column_stack([-unit(w, ww), ones(len(w))])
            self.error = np.full(len(w), delta * 4)
            tiny = lambda z, zz: (zz > 0) & (zz < 1e-200)
            self.odd_x, self.odd_y = self.odd_x | tiny(u, uu), self.odd_y | tiny(w, ww)

    def tile(self, rows: slice, asked: slice) -> np.ndarray:
        """One line a query."""
        x, y = self.x[rows], self.y[asked]
        if self.direct:
            i, j = np.divmod(np.arange(len(y) * len(x)), len(x))
            return self._scaled(measured_pairs(self.metric, x, y, j, i)).reshape(len(y), len(x))
        k = self.w[asked] @ self.u[rows].T
        for j in np.flatnonzero(self.odd_y[asked]):
            k[j] = self._scaled(measured_pairs(self.metric, x, y, np.arange(len(x)), np.full(len(x), j)))
        for i in np.flatnonzero(self.odd_x[rows]):
            k[:, i] = self._scaled(measured_pairs(self.metric, x, y, np.full(len(y), i), np.arange(len(y))))
        return k

    def _scaled(self, d: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            out = d * d if self.metric == "l2" else d
        return np.where(np.isnan(d), NOT_A_NUMBER, np.clip(out, -INFINITE, INFINITE))

    def limit(self, k: np.ndarray, asked: slice) -> np.ndarray:
        """What a bound must not exceed, where some row's bound is `k`, to be as near when rounded."""
        with np.errstate(over="ignore", invalid="ignore"):
            e = 0.0 if self.direct else 2 * self.error[asked]
            if self.metric == "l2":
                return (np.sqrt(np.maximum(k + e, 0.0)) + ROUNDING) ** 2 * (1 + 1e-12) + e
            return k + e + ROUNDING


def nearest(k: int, metric: str, exclude_self: bool, admit: Callable[[np.ndarray, np.ndarray], Callable[[slice, slice], np.ndarray]] | None = None) -> Cell:
    """The k nearest rows of each query in a cell; `admit` gives, for a cell's vectors, the pairs of a tile that may meet at all."""

    def work(ids: pa.Array, x: np.ndarray, query_ids: pa.Array, y: np.ndarray) -> list[pa.Array]:
        code, query_code = _codes(ids, query_ids)
        first = np.argsort(code, kind="stable")
        first = first[_first_copies(x[first], code[first], k + 1)]
        x, code = x[first], code[first]
        bounds, allowed = Bounds(metric, x, y), admit(x, y) if admit else None
        found: list[tuple[np.ndarray, ...]] = []
        for s in range(0, len(y), TILE):
            asked = slice(s, min(s + TILE, len(y)))
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            top = np.full(asked.stop - s, np.inf)  # what a row must not exceed, by query
            low, high = (np.searchsorted(code, query_code[asked], side) for side in ("left", "right"))
            for r in range(0, len(x), TILE):
                rows = slice(r, min(r + TILE, len(x)))
                key = bounds.tile(rows, asked)
                if allowed is not None:
                    key[~allowed(rows, asked)] = np.inf
                if exclude_self:
                    for j in np.flatnonzero((high > low) & (low < rows.stop) & (high > r)):
                        key[j, max(low[j], r) - r : high[j] - r] = np.inf
                if np.isinf(top).any() and k < key.shape[1]:
                    top = np.minimum(top, bounds.limit(np.partition(key, k - 1, axis=1)[:, k - 1], asked))
                j, i = np.nonzero(key <= np.minimum(top, np.finfo(np.float64).max)[:, None])
                if not len(i):
                    continue
                d = half_up(measured_pairs(metric, x, y, i + r, j + s))
                best = _best(*(np.concatenate(z) for z in zip(best, (j, i + r, d))), k)
                full = np.flatnonzero(np.diff(np.flatnonzero(np.r_[True, np.diff(best[0]) != 0, True])) >= k) if len(best[0]) else []
                if len(full):
                    ends = np.flatnonzero(np.r_[np.diff(best[0]) != 0, True])[full]
                    worst = best[2][ends] + ROUNDING
                    with np.errstate(over="ignore"):
                        worst = np.where(np.isnan(worst), np.inf, worst * worst * np.sign(worst) if metric == "l2" else worst)
                    e = 0.0 if bounds.direct else 2 * bounds.error[asked][best[0][ends]]
                    top[best[0][ends]] = np.minimum(top[best[0][ends]], np.where(worst >= INFINITE, np.inf, worst * (1 + 1e-12 * np.sign(worst)) + e))
            found.append((best[0] + s, best[1], best[2]))
        j, i, d = (np.concatenate(z) for z in zip(*found))
        return [query_ids.take(pa.array(j)), ids.take(pa.array(first[i])), pa.array(d)]

    return work


def _best(j: np.ndarray, i: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k first of each query by distance and place, in that order. Rows stand in the order of their ids."""
    order = np.lexsort((i, d, j))
    j, i, d = j[order], i[order], d[order]
    starts = np.flatnonzero(np.r_[True, np.diff(j) != 0])
    rank = np.arange(len(j)) - np.repeat(starts, np.diff(np.r_[starts, len(j)]))
    keep = rank < k
    return j[keep], i[keep], d[keep]


def _codes(ids: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in the order of the ids, equal for equal ones."""
    values = pc.unique(pa.concat_arrays([ids, others]))
    order = np.asarray(pc.sort_indices(values))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return tuple(rank[np.asarray(pc.index_in(x, value_set=values))] for x in (ids, others))


def _equal_rows(x: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal ones."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64)
    return np.unique(np.ascontiguousarray(x + 0.0).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)[1].ravel()


def _first_copies(x: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows that have one of the n first ids among those of equal vectors. `code` ascends."""
    same = _equal_rows(x)
    order = np.lexsort((code, same))
    new_vector = np.r_[True, np.diff(same[order]) != 0]
    new_id = new_vector | np.r_[True, np.diff(code[order]) != 0]
    count = np.cumsum(new_id)
    start = np.maximum.accumulate(np.where(new_vector, count, 0))
    return np.sort(order[count - start < n])


def every_metric(metrics: list[str]) -> Cell:
    """Every pair of different ids, with its distances."""

    def work(ids: pa.Array, x: np.ndarray, query_ids: pa.Array, y: np.ndarray) -> list[pa.Array]:
        code, query_code = _codes(ids, query_ids)
        out = {m: np.empty((len(y), len(x))) for m in metrics}
        with np.errstate(all="ignore"):
            high_x, high_y = ((~(z <= 0.5)).astype(np.float64) for z in (x, y))
            differ = high_y.sum(axis=1)[:, None] + high_x.sum(axis=1) - 2 * (high_y @ high_x.T)  # counts, exact in doubles
            across = np.ascontiguousarray(x.T)
            dot = y @ x.T if {"dot", "cosine"} & set(metrics) else None
            norm, query_norm = (np.sqrt(np.einsum("ij,ij->i", z, z)) for z in (x, y))
            for j in range(len(y)):
                diff = across - y[j][:, None] if {"l2", "l1"} & set(metrics) else None
                for m in metrics:
                    if m == "l2":
                        d = np.sqrt((diff * diff).sum(axis=0))
                    elif m == "l1":
                        d = np.abs(diff).sum(axis=0)
                    elif m == "hamming":
                        d = differ[j]
                    elif m == "dot":
                        d = -dot[j]
                    else:
                        n = norm * query_norm[j]
                        d = np.where(n == 0, 1.0, 1 - dot[j] / np.where(n == 0, 1.0, n))
                    out[m][j] = d
        for m, d in out.items():
            for j in range(0, len(y) if m != "hamming" else 0, 16):
                d[j : j + 16] = half_up(d[j : j + 16].ravel()).reshape(-1, len(x))
        other = (query_code[:, None] != code[None, :]).ravel()
        j, i = np.repeat(np.arange(len(y), dtype=np.int32), len(x)), np.tile(np.arange(len(x), dtype=np.int32), len(y))
        columns = [ids.take(pa.array(i)), query_ids.take(pa.array(j)), *(pa.array(d.ravel()) for d in out.values())]
        return columns if other.all() else [c.filter(pa.array(other)) for c in columns]

    return work


def forest(least: float) -> Cell:
    """Links that connect what pairs of a cosine similarity over `least` connect: a spanning forest of a cell, no link twice and at most one a row."""

    def work(ids: pa.Array, x: np.ndarray, query_ids: pa.Array, y: np.ndarray) -> list[pa.Array]:
        bounds, n = Bounds("cosine", x, y), len(x)
        parent = np.arange(n + len(y))
        links: list[np.ndarray] = []
        code, query_code = _codes(ids, query_ids)
        for s in range(0, len(y), TILE):
            asked = slice(s, min(s + TILE, len(y)))
            for r in range(0, n, TILE):
                rows = slice(r, min(r + TILE, n))
                key = bounds.tile(rows, asked)
                j, i = np.nonzero(key < 1 - least + 1e-9)
                j, i, key = j + s, i + r, key[j, i]
                fresh = code[i] != query_code[j]
                j, i, key = j[fresh], i[fresh], key[fresh]
                sure = key < 1 - least - 1e-9
                sure[~sure] = 1 - measured_pairs("cosine", x, y, i[~sure], j[~sure]) > least
                links += _joined(parent, i[sure], j[sure] + n)
        pairs = np.concatenate(links) if links else np.empty((0, 2), np.int64)
        return [ids.take(pa.array(pairs[:, 0])), query_ids.take(pa.array(pairs[:, 1] - n))]

    return work


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Joins the classes of all pairs (a, b), rounds at a time; the pairs that did it. `parent` holds the least node of each class."""
    used = []
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        chosen = np.unique(high, return_index=True)[1]  # each class joins one with a smaller root: no cycles
        used.append(np.column_stack([a[chosen], b[chosen]]))
        parent[high[chosen]] = low[chosen]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
    return used
