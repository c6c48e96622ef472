"""Property-graph operators over nodes (id, type, ...) and edges (src, dst, type, weight).

Traversals are loops over frontiers: one join by level, nodes seen before removed by an anti-join. Each
level is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.operators.components import connected_components
from tessaline.session import written


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))


def bfs(edges: DataFrame, start: DataFrame, max_depth: int, edge_condition: Column | None = None, nodes: DataFrame | None = None, inclusive: bool = True) -> DataFrame:
    """id, depth, weight, path for nodes within max_depth of `start` (id). `nodes` prunes expansion. Ties: the least path."""
    steps = (edges.where(edge_condition) if edge_condition is not None else edges).select(F.col("src").alias("id"), "dst", F.col("weight").cast("double").alias("w"))
    level = written(start.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(0.0).alias("weight"), F.array("id").alias("path")), "bfs")
    seen = level
    for depth in range(1, max_depth + (1 if inclusive else 0)):
        new = level.join(steps, "id").select(F.col("dst").alias("id"), F.lit(depth).alias("depth"), (F.col("weight") + F.col("w")).alias("weight"), F.concat("path", F.array("dst")).alias("path"))
        if nodes is not None:
            new = new.join(nodes.select("id"), "id", "left_semi")
        new = new.join(seen.select("id"), "id", "left_anti").groupBy("id").agg(F.min(F.struct("path", "weight")).alias("m"))
        level = written(new.select("id", F.lit(depth).alias("depth"), F.col("m.weight").alias("weight"), F.col("m.path").alias("path")), "bfs")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id, depth over edges in both directions."""
    return bfs(undirected(edges), start, hops).select("id", "depth")


def shortest_paths(edges: DataFrame, start: DataFrame, max_edges: int | None = None, max_distance: float | None = None) -> DataFrame:
    """id, distance from the nearest start, over paths of any length or of at most max_edges edges; only improved nodes are expanded again.

    Weights below 0 are an error: a round that improves nodes need not be followed by a last one then.
    """
    steps = edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("w"))
    steps = steps.withColumn("w", F.when(F.col("w") < 0, F.raise_error(F.lit("negative weight"))).otherwise(F.col("w")))
    best = written(start.select("id").distinct().select("id", F.lit(0.0).alias("distance")), "paths")
    front = best
    for _ in range(max_edges) if max_edges is not None else count():
        reach = front.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("distance") + F.col("w")).alias("distance"))
        if max_distance is not None:
            reach = reach.where(F.col("distance") <= max_distance)
        reach = reach.groupBy("id").agg(F.min("distance").alias("new"))
        front = written(reach.join(best, "id", "left").where(F.col("distance").isNull() | (F.col("new") < F.col("distance"))).select("id", F.col("new").alias("distance")), "paths")
        if front.isEmpty():
            break
        best = written(best.unionByName(front).groupBy("id").agg(F.min("distance").alias("distance")), "paths")
    return best


def topological_levels(edges: DataFrame) -> DataFrame:
    """id, level: nodes without edges from nodes of the same or a later level. A cycle is an error."""
    left = edges.select("src", "dst").distinct()
    todo = written(left.select(F.col("src").alias("id")).unionAll(left.select(F.col("dst").alias("id"))).distinct(), "topo")
    out = None
    for level in count():
        if todo.isEmpty():
            break
        blocked = left.join(todo.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        now = written(todo.join(blocked, "id", "left_anti").withColumn("level", F.lit(level)), "topo")
        if now.isEmpty():
            raise ValueError("the graph has a cycle")
        out = now if out is None else out.unionByName(now)
        todo = written(todo.join(now, "id", "left_anti").select("id"), "topo")
    return out if out is not None else todo.withColumn("level", F.lit(0))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """id, rank after a fixed number of rounds; ranks sum to 1, and nodes without out-edges give theirs to all."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count("*").alias("n"))
    ids = written(e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct(), "rank")
    n = ids.count()
    steps = written(e.join(out, "src"), "rank")
    rank = ids.withColumn("rank", F.lit(1.0 / max(1, n)))
    for i in range(rounds):
        got = steps.join(rank, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        lost = rank.join(out, F.col("id") == F.col("src"), "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        rank = ids.join(got, F.col("id") == F.col("dst"), "left").join(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        rank = written(rank, "rank")
    return rank


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community by label propagation: each node takes the label with most weight around it, the least one of ties."""
    e = written(undirected(edges).groupBy("src", "dst").agg(F.sum("weight").alias("w")), "labels")
    label = e.select(F.col("src").alias("id")).distinct().withColumn("community", F.col("id"))
    for _ in range(rounds):
        votes = e.join(label, F.col("dst") == F.col("id")).groupBy("src", "community").agg(F.sum("w").alias("w"))
        label = written(votes.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("w")).alias("w"), "community"))["community"].alias("community")), "labels")
    return label


def modularity(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Standard modularity of an undirected weighted graph under labels (id, community), as one row."""
    e = edges.select("src", "dst", F.col("weight").cast("double").alias("w"))
    a, b = label.select(F.col("id").alias("src"), F.col("community").alias("c1")), label.select(F.col("id").alias("dst"), F.col("community").alias("c2"))
    named = e.join(a, "src").join(b, "dst")
    inside = named.groupBy(F.col("c1").alias("c")).agg(F.sum(F.when(F.col("c1") == F.col("c2"), F.col("w")).otherwise(0.0)).alias("inside"))
    ends = named.select(F.col("c1").alias("c"), "w").unionAll(named.select(F.col("c2").alias("c"), "w")).groupBy("c").agg(F.sum("w").alias("ends"))
    m = e.agg(F.sum("w").alias("m"))
    return ends.join(inside, "c", "left").join(F.broadcast(m)).agg(F.round(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), 2)), 6).alias("modularity"))


def density(edges: DataFrame) -> DataFrame:
    """By edge type: edges, nodes and directed density."""
    nodes = edges.select("type", F.explode(F.array("src", "dst")).alias("id")).groupBy("type").agg(F.count_distinct("id").alias("nodes"))
    count = edges.groupBy("type").agg(F.count("*").alias("edges"))
    return count.join(nodes, "type").select("type", "edges", "nodes", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0), 6).alias("density"))


def clustering(edges: DataFrame) -> DataFrame:
    """id, triangles, coefficient: how many pairs of a node's neighbours are neighbours. Triangles are found from their node of least degree."""
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = written(e, "triangles")
    degree = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    x, y = degree.select(F.col("id").alias("a"), F.col("d").alias("da")), degree.select(F.col("id").alias("b"), F.col("d").alias("db"))
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    up = written(e.join(x, "a").join(y, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v")), "triangles")
    p, q = up.select("u", F.col("v").alias("v1")), up.select("u", F.col("v").alias("v2"))
    wedges = p.join(q, "u").where("v1 < v2").select("u", F.col("v1").alias("a"), F.col("v2").alias("b"))
    found = wedges.join(e, ["a", "b"]).select(F.explode(F.array("u", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    return degree.join(found, "id", "left").select("id", F.coalesce("t", F.lit(0)).alias("triangles"), F.round(F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0), 6).alias("coefficient"))


def combine(graph: DataFrame, vector: DataFrame, strategy: str, graph_weight: float = 0.5, vector_weight: float = 0.5) -> DataFrame:
    """id, score of (id, score) rows of a graph part and a vector part: intersection, union, graph_first, vector_first or weighted."""
    g, v = graph.select("id", F.col("score").alias("g")), vector.select("id", F.col("score").alias("v"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    how, score = {
        "intersection": ("inner", (F.col("g") + F.col("v")) / 2), "union": ("full", F.coalesce("g", "v")), "graph_first": ("left", 0.7 * F.col("g") + 0.3 * zero("v")),
        "vector_first": ("right", 0.7 * F.col("v") + 0.3 * zero("g")), "weighted": ("inner", graph_weight * F.col("g") + vector_weight * F.col("v")),
    }[strategy]
    return g.join(v, "id", how).select("id", F.round(score, 6).alias("score"))


def fixpoint(facts: DataFrame, rules: list, max_rounds: int | None = None) -> DataFrame:
    """Forward chaining over facts (predicate, a, b, confidence), until a round finds nothing new. A fact keeps its best confidence.

    A rule maps (known, new) to facts; new are those that the round before added or made surer, so a rule joins new ones
    with known ones and not all with all. With `max_rounds`, a closure that is not reached by then is an error.
    """
    key = ["predicate", "a", "b"]
    known = written(facts.groupBy(*key).agg(F.max("confidence").alias("confidence")), "facts")
    new = known
    for n in count():
        if max_rounds is not None and n >= max_rounds:
            raise RuntimeError(f"the facts did not settle in {max_rounds} rounds")
        made = None
        for rule in rules:
            out = rule(known, new).select(*key, "confidence")
            made = out if made is None else made.unionByName(out)
        if made is None:
            return known
        made = made.groupBy(*key).agg(F.max("confidence").alias("confidence"))
        before = known.withColumnRenamed("confidence", "before")
        # sums and products of doubles: what is surer by less than 1e-12 is not new
        new = written(made.join(before, key, "left").where(F.col("before").isNull() | (F.col("confidence") > F.col("before") + 1e-12)).drop("before"), "facts")
        if new.isEmpty():
            return known
        known = written(known.unionByName(new).groupBy(*key).agg(F.max("confidence").alias("confidence")), "facts")


@dataclass
class Graph:
    """Nodes (id, type, ...) and edges (src, dst, type, weight) with checked changes; each change returns a new graph."""

    nodes: DataFrame
    edges: DataFrame

    def add_nodes(self, new: DataFrame) -> Graph:
        kept = self.nodes.join(new.select("id"), "id", "left_anti")
        return Graph(kept.unionByName(new, allowMissingColumns=True), self.edges)

    def add_edges(self, new: DataFrame, strict: bool = False) -> Graph:
        """Edges whose ends exist; others are left out, or an error if strict."""
        ends = self.nodes.select("id").distinct()
        good = new.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
        if strict and good.count() < new.count():
            raise KeyError("an edge has an unknown end")
        return Graph(self.nodes, self.edges.unionByName(good.select(*new.columns), allowMissingColumns=True))

    def remove_nodes(self, gone: DataFrame) -> Graph:
        """Nodes go with all their edges."""
        left = self.edges
        for end in ("src", "dst"):
            left = left.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        return Graph(self.nodes.join(gone.select("id"), "id", "left_anti"), left.select(*self.edges.columns))

    def remove_edges(self, gone: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(gone.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti").select(*self.edges.columns))

    def neighbours(self, start: DataFrame, direction: str = "both", types: list[str] | None = None, depth: int = 1) -> DataFrame:
        """id, depth of nodes within `depth` edges of `start`, without the start itself."""
        e = self.edges.where(F.col("type").isin(types)) if types else self.edges
        ways = {"out": e, "in": e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), "both": undirected(e)}
        return bfs(ways[direction], start, depth).where("depth > 0").select("id", "depth")

    def constrained(self, results: DataFrame, allowed: DataFrame | None = None, around: DataFrame | None = None, hops: int = 2, types: list[str] | None = None, properties: dict | None = None) -> DataFrame:
        """Rows of results (id, ...) on allowed nodes, near other nodes, of some types and with equal properties."""
        if allowed is not None:
            results = results.join(allowed.select("id"), "id", "left_semi")
        if around is not None:
            results = results.join(k_hop(self.edges, around, hops).select("id"), "id", "left_semi")
        condition = F.col("type").isin(types) if types else F.lit(True)
        for name, value in (properties or {}).items():
            condition = condition & (F.col(name) == F.lit(value))
        return results.join(self.nodes.where(condition).select("id"), "id", "left_semi")


def dfs(edges: DataFrame, start: int, max_nodes: int = 10_000) -> list[int]:
    """Nodes in depth-first order, the least neighbour first. The order is one walk, so the reachable part is collected: an error beyond max_nodes."""
    reached = k = bfs(edges, edges.sparkSession.createDataFrame([(start,)], "id long"), 1 << 30).select("id")
    if reached.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes are reachable")
    near: dict[int, list[int]] = {}
    for r in edges.join(k, F.col("src") == F.col("id"), "left_semi").select("src", "dst").distinct().collect():
        near.setdefault(r["src"], []).append(r["dst"])
    out, seen, stack = [], set(), [start]
    while stack:
        x = stack.pop()
        if x not in seen:
            seen.add(x)
            out.append(x)
            stack += sorted(near.get(x, []), reverse=True)
    return out


def all_distances(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source, id, depth, ways: edges to each node that a source reaches, and how many shortest paths lead there. One join by level for all sources."""
    e = edges.where("src <> dst").select(F.col("src").alias("at"), "dst").distinct()
    start = sources.select("id") if sources is not None else edges.select(F.col("src").alias("id")).unionAll(edges.select("dst"))
    level = written(start.distinct().select(F.col("id").alias("source"), "id", F.lit(0).alias("depth"), F.lit(1.0).alias("ways")), "distances")
    seen = level
    for depth in count(1):
        new = level.join(e, F.col("id") == F.col("at")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
        level = written(new.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth).alias("depth"), "ways"), "distances")
        if level.isEmpty():
            return seen
        seen = written(seen.unionByName(level), "distances")


def closeness(distances: DataFrame) -> DataFrame:
    """id, closeness (reached nodes by the sum of distances to them) and harmonic (the sum of 1 / distance), of each source."""
    d = F.col("depth")
    out = distances.groupBy(F.col("source").alias("id")).agg(F.count(F.when(d > 0, 1)).alias("n"), F.sum(d).alias("total"), F.sum(F.when(d > 0, 1 / d).otherwise(0.0)).alias("harmonic"))
    return out.select("id", F.round(F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0), 6).alias("closeness"), F.round("harmonic", 6).alias("harmonic"))


def betweenness(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """id, betweenness: over all ordered pairs, the share of shortest paths that pass the node. Shares run back from the furthest level."""
    e = edges.where("src <> dst").select("src", "dst").distinct()
    a = distances.select("source", F.col("id").alias("src"), F.col("depth").alias("da"), F.col("ways").alias("wa"))
    b = distances.select("source", F.col("id").alias("dst"), F.col("depth").alias("db"), F.col("ways").alias("wb"))
    steps = written(a.join(e, "src").join(b, ["source", "dst"]).where("db = da + 1"), "paths")
    share = distances.select("source", "id", F.lit(0.0).alias("share")).where("1 = 0")
    last = distances.agg(F.max("depth")).first()[0] or 0
    every = share
    for depth in range(last, 0, -1):
        here = steps.where(F.col("db") == depth).join(share.withColumnRenamed("id", "dst"), ["source", "dst"], "left")
        share = written(here.groupBy("source", F.col("src").alias("id")).agg(F.sum(F.col("wa") / F.col("wb") * (1 + F.coalesce("share", F.lit(0.0)))).alias("share")), "shares")
        every = every.unionByName(share)
    passed = every.where("source <> id").groupBy("id").agg(F.sum("share").alias("share"))
    return distances.select("id").distinct().join(passed, "id", "left").select("id", F.round(F.coalesce("share", F.lit(0.0)), 6).alias("betweenness"))


def eigenvector(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """id, centrality after a fixed number of rounds of x + Ax (the shift lets bipartite graphs settle), scaled to length 1."""
    e = written(edges.groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w")), "eigen")
    x = written(e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct().withColumn("x", F.lit(1.0)), "eigen")
    for _ in range(rounds):
        got = e.join(x, F.col("src") == F.col("id")).groupBy("dst").agg(F.sum(F.col("w") * F.col("x")).alias("got"))
        new = x.join(got, F.col("id") == F.col("dst"), "left").select("id", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("x"))
        length = new.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))  # one row
        x = written(new.join(F.broadcast(length)).select("id", (F.col("x") / F.col("length")).alias("x")), "eigen")
    return x.select("id", F.round("x", 6).alias("centrality"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, average degree, density, components, the largest of them, and diameter, all without direction."""
    both = undirected(edges)
    n = both.select("src").distinct().agg(F.count("*").alias("nodes"))
    m = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().agg(F.count("*").alias("edges"))
    parts = connected_components(edges).groupBy("component").agg(F.count("*").alias("n")).agg(F.count("*").alias("components"), F.max("n").alias("largest"))
    wide = all_distances(both).agg(F.max("depth").alias("diameter"))
    row = n.join(F.broadcast(m)).join(F.broadcast(parts)).join(F.broadcast(wide))  # one row each
    return row.select("nodes", "edges", F.round(2 * F.col("edges") / F.col("nodes"), 6).alias("average_degree"), F.round(2 * F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1)), 6).alias("density"), "components", "largest", "diameter")


def louvain_moves(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """id, community: every round, nodes move to the neighbouring community that gains most modularity, until none gains.

    Half of the nodes, by a hash of node and round, may move at a time, so that two nodes don't swap places for ever; ties go to the least community.
    """
    e = written(undirected(edges).where("src <> dst").groupBy("src", "dst").agg(F.sum("weight").cast("double").alias("w")), "louvain")
    degree = written(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")), "louvain")
    twice = degree.agg(F.sum("k")).first()[0] or 1.0
    label = written(degree.select("id", F.col("id").alias("community")), "louvain")
    still = 0
    for n in range(rounds):
        size = degree.join(label, "id").groupBy("community").agg(F.sum("k").alias("total"))
        links = e.join(label.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "community").agg(F.sum("w").alias("w"))
        own = label.withColumnRenamed("community", "own")
        options = links.unionByName(label.withColumn("w", F.lit(0.0))).groupBy("id", "community").agg(F.sum("w").alias("w"))
        options = options.join(degree, "id").join(size, "community").join(own, "id")
        rest = F.col("total") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * rest / twice, 9)
        best = options.groupBy("id").agg(F.min(F.struct((-gain).alias("g"), (F.col("community") != F.col("own")).alias("moves"), "community"))["community"].alias("to"))
        turn = F.pmod(F.xxhash64("id", F.lit(n)), F.lit(2)) == 0
        moved = written(label.join(best, "id").select("id", F.when(turn, F.col("to")).otherwise(F.col("community")).alias("community"), (F.col("to") != F.col("community")).alias("would")), "louvain")
        still = 0 if moved.where("would").limit(1).count() else still + 1
        label = moved.select("id", "community")
        if still:
            break
    names = label.groupBy("community").agg(F.min("id").alias("name"))
    return label.join(names, "community").select("id", F.col("name").alias("community"))
