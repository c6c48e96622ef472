"""Exact top-k by inner product, with dual cover trees.

Vectors and queries are cut in blocks of near ones (around pivots, and evenly within a pivot's cell), and
each block is indexed by a cover tree: a node's children are a net of half its radius, each point belongs
to one within that radius, and a node knows the exact radius around its centre that covers its points.
Two nodes are searched together: no product between a query near q and a vector near v exceeds
q.v + |q| r_v + r_q |v| + r_q r_v, so a pair of nodes is pruned if that is below the worst k-th score of
the node's queries. Each query block first meets its own cell, so later pairs start from good k-th
scores, and whole pairs of blocks are pruned by the same bound before any vector travels.

Scale: the queries are a stated set, and blocks of them meet blocks of vectors; a cell that many equal or
near vectors share is cut by a hash into blocks of `block_rows`. Of a block pair, the queries travel, in
groups of `query_group` blocks, and a data block goes to the groups that it has a surviving pair with. A block
carries its tree, which is built once. Pivots are a bounded sample (`MAX_PIVOTS`); they decide only what lies
together, every row is indexed, and the result is exact.

Defined cases: rows with a null id, a null or empty vector, or a null or non-finite component take no
part; only vectors of equal length are compared; ties go to the smaller id; a candidate row counts as often as
it stands, a query that stands several times is asked once; a query is never its own answer (equal id);
rows of one id and different vectors are candidates and queries of their own; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessaline.llm.blocks import unzip_bytes, zip_bytes
from tessaline.session import ship, written

MAX_PIVOTS = 256
LEAF = 48


class CoverTree:
    """Nodes over points in an order in which each node's points stand together."""

    def __init__(self, points: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(points))
        self.center: list[int] = []
        self.radius: list[float] = []
        self.begin: list[int] = []
        self.end: list[int] = []
        self.children: list[list[int]] = []
        x = points.astype(np.float64)
        square = (x * x).sum(axis=1)

        def far(at: np.ndarray, c: int) -> np.ndarray:
            return np.sqrt(np.maximum(square[at] + square[c] - 2 * (x[at] @ x[c]), 0.0))

        def node(members: np.ndarray, center: int, distance: np.ndarray, offset: int) -> int:
            me = len(self.center)
            radius = float(distance.max())
            self.center.append(center)
            self.radius.append(radius * (1 + 1e-9) + (1e-6 if radius else 0.0))
            self.begin.append(offset)
            self.end.append(offset + len(members))
            self.children.append([])
            todo.append((me, members, distance, offset, center, radius))
            return me

        todo: list = []
        every = np.arange(len(points))
        start = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        node(every, start, far(every, start), 0)
        while todo:
            me, members, distance, offset, center, radius = todo.pop()
            if len(members) <= LEAF or radius <= 1e-6:
                self.order[offset : offset + len(members)] = members
                continue
            left, d, c = members, distance, center  # the centre is in its own net
            while len(left):
                near = d <= radius / 2
                self.children[me].append(node(left[near], c, d[near], offset))
                offset += int(near.sum())
                left = left[~near]
                if len(left):
                    c = int(left[np.argmax(d[~near])])
                    d = far(left, c)
        self.points, self.ids = points[self.order], ids[self.order]
        self.places = x[self.center]
        self.norms = np.sqrt(square[self.center])
        self.radii = np.asarray(self.radius)
        self.begins, self.ends = np.asarray(self.begin), np.asarray(self.end)
        self.least = np.array([self.ids[b:e].min() for b, e in zip(self.begin, self.end)])


class Best:
    """The k best (score, id) of each query so far: larger scores first, then smaller ids."""

    def __init__(self, n: int, k: int, score: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.k = k
        self.score = np.full((n, k), -np.inf) if score is None else score
        self.ids = np.full((n, k), np.iinfo(np.int64).max) if ids is None else ids

    def offer(self, a: int, b: int, scores: np.ndarray, ids: np.ndarray) -> None:
        worst, last = self.score[a:b, -1], self.ids[a:b, -1]
        good = (scores > worst[:, None]) | ((scores == worst[:, None]) & (ids[None, :] < last[:, None]))
        for i in np.flatnonzero(good.any(axis=1)):
            s = np.concatenate([self.score[a + i], scores[i][good[i]]])
            d = np.concatenate([self.ids[a + i], ids[good[i]]])
            keep = np.lexsort((d, -s))[: self.k]
            self.score[a + i], self.ids[a + i] = s[keep], d[keep]


def dual_search(q: CoverTree, v: CoverTree, best: Best) -> int:
    """Improve `best` by the vectors of v; returns how many products were taken."""
    taken = 0
    x, y = q.points.astype(np.float64), v.points.astype(np.float64)
    exact = max(1.0, np.abs(x).max()) * max(1.0, np.abs(y).max()) * x.shape[1] < 2.0**52
    stack = [(0, np.array([0]))]
    while stack:
        a, many = stack.pop()
        b, e = q.begins[a], q.ends[a]
        worst = best.score[b:e, -1].min()
        bound = v.places[many] @ q.places[a] + q.norms[a] * v.radii[many] + q.radii[a] * (v.norms[many] + v.radii[many])
        bound += np.abs(bound) * 1e-9 + 1e-6
        tied = best.ids[b:e, -1][best.score[b:e, -1] == worst].max()
        slack = 2e-6 + abs(worst) * 2e-9 if np.isfinite(worst) else 0.0
        keep = (bound > worst + slack) | ((bound >= worst) & ((v.least[many] < tied) | (e - b > 1)))
        many, bound = many[keep], bound[keep]
        if not len(many):
            continue
        if q.children[a] and q.radii[a] > v.radii[many].max():
            stack += [(c, many) for c in q.children[a]]
            continue
        inner = np.array([bool(v.children[m]) for m in many])
        leaves = many[~inner]
        deeper = many[inner]
        if len(deeper):
            order = np.argsort(bound[inner])
            stack += [(a, np.asarray(v.children[m])) for m in deeper[order]]
        if len(leaves):
            if q.children[a]:
                stack += [(c, leaves) for c in q.children[a]]
                continue
            at = np.concatenate([np.arange(v.begins[m], v.ends[m]) for m in leaves])
            scores = x[b:e] @ y[at].T if exact else (q.points[b:e] @ v.points[at].T).astype(np.float64)
            scores = np.where(q.ids[b:e, None] == v.ids[None, at], -np.inf, scores)
            best.offer(b, e, scores, v.ids[at])
            taken += scores.size
    return taken


def _rows(t: pa.Table, once: bool) -> tuple[np.ndarray, np.ndarray]:
    """Points and ids in one order, whatever order they came in; `once`: equal rows are one."""
    v = t.column("v").combine_chunks()
    points = np.asarray(v.flatten(), dtype=np.int64).reshape(t.num_rows, -1)
    ids = t.column("vec_id").to_numpy()
    both = np.concatenate([ids[:, None], points], axis=1)
    both = np.unique(both, axis=0) if once else both[np.lexsort(both.T[::-1])]
    return both[:, 1:], both[:, 0]


BLOCK = "dim int, cell int, part int, center array<double>, norm double, radius double, n long, payload binary"


def _build(t: pa.Table, once: bool) -> pa.Table:
    points, ids = _rows(t, once)
    tree = CoverTree(points, ids)
    payload = zip_bytes(pickle.dumps(tree))
    first = {k: pa.array([t.column(k)[0].as_py()], pa.int32()) for k in ("dim", "cell", "part")}
    return pa.table({**first, "center": pa.array([tree.places[0].tolist()], pa.list_(pa.float64())), "norm": [float(tree.norms[0])], "radius": [float(tree.radii[0])], "n": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})


def _tree(payload: bytes) -> CoverTree:
    return pickle.loads(unzip_bytes(payload))  # noqa: S301  written by this job


ANSWER = "qdim int, qcell int, qpart int, qplace int, query_id long, vec_id long, score long"


def _answers(q: CoverTree, best: Best, dim: int, cell: int, part: int, above: np.ndarray | None = None) -> pa.Table:
    found = np.isfinite(best.score)
    if above is not None:
        found &= best.score >= above[:, None]
    row, col = np.nonzero(found)
    place = q.order[row]
    one = lambda x: pa.array(np.full(len(row), x), pa.int32())
    return pa.table({"qdim": one(dim), "qcell": one(cell), "qpart": one(part), "qplace": pa.array(place, pa.int32()), "query_id": q.ids[row], "vec_id": best.ids[row, col], "score": pa.array(best.score[row, col].astype(np.int64))})


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, block_rows: int = 4096, query_rows: int = 1024, query_group: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row for which is_query (on vec_id) holds. Components are floor(scale * x)."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite))
    rows = rows.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"), F.size("v").alias("dim"))
    some = rows.select("dim", "v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(MAX_PIVOTS).collect()
    pivots: dict[int, list] = {}
    for r in some:
        pivots.setdefault(r["dim"], []).append(list(r["v"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {d: np.asarray(p, dtype=np.float64) for d, p in pivots.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cells = np.zeros(batch.num_rows, dtype=np.int32)
            for d in np.unique(dims).tolist():
                if d in tables:
                    mine = np.flatnonzero(dims == d)
                    x = np.asarray(batch.column("v").take(pa.array(mine)).flatten(), dtype=np.float64).reshape(len(mine), d)
                    cells[mine] = np.argmin((tables[d] ** 2).sum(axis=1)[None, :] - 2 * x @ tables[d].T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=["vec_id", "v", "dim", "cell"])

    # few vectors need few pivots: neighbouring ones share a cell
    per = max(1, -(-rows.count() // block_rows))
    pivots = {d: p[: min(MAX_PIVOTS, per)] for d, p in pivots.items()}
    placed = written(rows.mapInArrow(place, "vec_id long, v array<long>, dim int, cell int"), "vectors")

    def cut(df: DataFrame, most: int, once: bool) -> DataFrame:
        # a row for each cell and length of vectors, small unless lengths are many: Spark broadcasts the written table if its file is small
        sizes = written(df.groupBy("dim", "cell").count().withColumn("parts", F.ceil(F.col("count") / most).cast("int")).drop("count"), "cells")
        # queries that are equal must meet; candidates that are equal may be dealt apart, so that one row many times over is no hot part
        salt = F.xxhash64("vec_id") if once else F.xxhash64("vec_id", F.monotonically_increasing_id())
        dealt = df.withColumn("salt", salt).join(sizes, ["dim", "cell"])
        dealt = dealt.select("vec_id", "v", "dim", "cell", F.pmod("salt", F.col("parts")).cast("int").alias("part"))
        return dealt.groupBy("dim", "cell", "part").applyInArrow(lambda t: _build(t, once), BLOCK)

    data = written(cut(placed, block_rows, False), "data-blocks")
    queries = written(cut(placed.where(is_query).distinct(), query_rows, True), "query-blocks")
    n_query_blocks = max(1, queries.count())

    # Each query block meets the first block of its own cell.
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = _tree(r["q_payload"])
                best = Best(len(q.ids), k)
                dual_search(q, _tree(r["payload"]), best)
                yield from _answers(q, best, r["dim"], r["cell"], r["q_part"]).to_batches()

    q_side = queries.select("dim", "cell", F.col("part").alias("q_part"), F.col("payload").alias("q_payload"))
    seeded = written(q_side.join(data.where("part = 0").select("dim", "cell", "payload"), ["dim", "cell"]).select("dim", "cell", "q_part", "q_payload", "payload").mapInArrow(seed, ANSWER), "seeded")
    kth = seeded.groupBy("qdim", "qcell", "qpart", "qplace").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    kth = kth.groupBy("qdim", "qcell", "qpart").agg(F.min("n").alias("fewest"), F.min("worst").alias("worst"), F.collect_list(F.struct("qplace", "n", "worst")).alias("each"))

    groups = -(-n_query_blocks // query_group)
    q = queries.join(kth, (F.col("dim") == F.col("qdim")) & (F.col("cell") == F.col("qcell")) & (F.col("part") == F.col("qpart")), "left")
    q = q.select(
        F.col("dim").alias("q_dim"), F.col("cell").alias("q_cell"), F.col("part").alias("q_part"), F.col("center").alias("q_center"), F.col("norm").alias("q_norm"), F.col("radius").alias("q_radius"), F.col("n").alias("q_n"),
        F.col("payload").alias("q_payload"), F.when((F.col("fewest") >= k) & (F.size("each") >= F.col("n")), F.col("worst")).alias("worst"), "each", F.pmod(F.xxhash64("dim", "cell", "part"), F.lit(groups)).cast("int").alias("grp"),
    )
    summary = data.select("dim", "cell", "part", "center", "norm", "radius")
    # every query block against every data block, by their summaries; data blocks are dealt evenly and query blocks copied to each share
    shares = max(1, min(64, n_query_blocks))
    left = summary.withColumn("share", F.pmod(F.xxhash64("cell", "part"), F.lit(shares)))
    right = q.drop("q_payload", "each", "q_n").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    dot = F.aggregate(F.zip_with("center", "q_center", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    bound = dot + F.col("norm") * F.col("q_radius") + F.col("radius") * F.col("q_norm") + F.col("radius") * F.col("q_radius")
    met = (F.col("part") == 0) & (F.col("cell") == F.col("q_cell"))
    pairs = left.join(right, (left["share"] == right["share"]) & (F.col("dim") == F.col("q_dim"))).where(~met & (F.col("worst").isNull() | (bound * (1 + 1e-9) + 1.0 >= F.col("worst"))))
    pairs = written(pairs.select("dim", "cell", "part", "q_cell", "q_part", "grp"), "pairs")
    full = pairs.join(q.select(F.col("q_dim").alias("dim"), "q_cell", "q_part", "q_payload", "each"), ["dim", "q_cell", "q_part"])
    copies = data.select("dim", "cell", "part", "payload").join(pairs.select("dim", "cell", "part", "grp").distinct(), ["dim", "cell", "part"])
    copies = copies.select(F.col("dim").alias("v_dim"), F.col("cell").alias("v_cell"), F.col("part").alias("v_part"), F.col("grp").alias("v_grp"), "payload")

    def meet(one: pa.Table, many: pa.Table) -> pa.Table:
        empty = pa.schema([("qdim", pa.int32()), ("qcell", pa.int32()), ("qpart", pa.int32()), ("qplace", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]).empty_table()
        if not one.num_rows or not many.num_rows:
            return empty
        tree, out = _tree(one.column("payload")[0].as_py()), [empty]
        for r in many.to_pylist():
            t = _tree(r["q_payload"])
            best, place = Best(len(t.ids), k), np.empty(len(t.ids), dtype=np.int64)
            place[t.order] = np.arange(len(t.ids))
            above = np.full(len(t.ids), -np.inf)
            for x in r["each"] or []:
                if x["n"] >= k:
                    above[place[x["qplace"]]] = x["worst"]
            best.score[:] = above[:, None]  # ids stand as the largest number: ties with the k-th score are still looked at
            dual_search(t, tree, best)
            best.score[best.ids == np.iinfo(np.int64).max] = -np.inf
            out.append(_answers(t, best, r["dim"], r["q_cell"], r["q_part"], above))
        return pa.concat_tables(out)

    later = copies.groupBy("v_dim", "v_cell", "v_part", "v_grp").cogroup(full.groupBy("dim", "cell", "part", "grp")).applyInArrow(meet, ANSWER)
    order = Window.partitionBy("qdim", "qcell", "qpart", "qplace").orderBy(F.col("score").desc(), "vec_id")
    ranked = seeded.unionByName(later).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS asked, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
