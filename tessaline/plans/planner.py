"""Choice of a search strategy, and queries that combine a graph part with a vector part."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.operators import graph, search

EXACT_ROWS = 1000


def strategy(rows: int, approximate: bool = False, indexed: bool = False) -> str:
    if approximate and indexed:
        return "index"
    return "two_phase" if approximate and rows > EXACT_ROWS else "exact"


def search_by_strategy(data: DataFrame, key: int, k: int, approximate: bool = False, indexed: bool = False, metric: str = "l2") -> DataFrame:
    """vec_id, distance of the k rows nearest to a stored one, itself included where it is found, by the strategy that suits the table's size."""
    chosen = strategy(data.count() if approximate else 0, approximate, indexed)
    query = search.vector_of(data, key)
    if chosen == "index":
        own = data.where(F.col("vec_id") == key)
        return search.index_search(data, own, k, metric).select(F.col("id").alias("vec_id"), "distance")
    if chosen == "two_phase":
        return search.two_phase(data, query, k).select("vec_id", "distance")
    return search.knn(data, query, k, metric).select("vec_id", "distance")


@dataclass
class UnifiedQuery:
    """A builder: graph part, vector part, how they combine, order and limit."""

    start: list[int] = field(default_factory=list)
    depth: int = 3
    vector: list[float] | None = None
    k: int = 10
    threshold: float | None = None
    how: str = "intersection"
    weights: tuple[float, float] = (0.5, 0.5)
    condition: Column | None = None
    size: int = 10

    def from_nodes(self, *ids: int, depth: int = 3) -> UnifiedQuery:
        self.start, self.depth = list(ids), depth
        return self

    def near(self, vector: list[float], k: int = 10, threshold: float | None = None) -> UnifiedQuery:
        self.vector, self.k, self.threshold = vector, k, threshold
        return self

    def combined(self, how: str, graph_weight: float = 0.5, vector_weight: float = 0.5) -> UnifiedQuery:
        self.how, self.weights = how, (graph_weight, vector_weight)
        return self

    def where(self, condition: Column) -> UnifiedQuery:
        self.condition = condition
        return self

    def limit(self, n: int) -> UnifiedQuery:
        self.size = n
        return self

    def run(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """id, score; nodes have id and embedding. Depths run from 0 to depth - 1; conditions filter results, not expansion."""
        parts = []
        if self.start:
            reached = graph.bfs(edges, nodes.where(F.col("id").isin(self.start)), self.depth, inclusive=False)
            parts.append(reached.select("id", (1 / (F.col("depth") + 1)).alias("score")))
        if self.vector is not None:
            near = search.knn(nodes, self.vector, self.k, "cosine", id_col="id")
            near = near.select("id", (1 - F.col("distance")).alias("score"))
            parts.append(near.where(F.col("score") >= self.threshold) if self.threshold is not None else near)
        out = graph.combine(parts[0], parts[1], self.how, *self.weights) if len(parts) == 2 else parts[0].select("id", F.round("score", 6).alias("score"))
        if self.condition is not None:
            out = out.join(nodes.where(self.condition).select("id"), "id", "left_semi")
        return out.orderBy(F.col("score").desc(), "id").limit(self.size)
