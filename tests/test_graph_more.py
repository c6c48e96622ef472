"""Long paths, closures, changes, order and communities of graphs; and the folder that a cluster must name."""

import random

import pytest
from pyspark.sql import functions as F

from tessaline.operators import graph


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w), "x") for a, b, w in rows], "src long, dst long, weight double, type string")


def test_paths_and_levels_have_no_cap(spark):
    e = edges(spark, [(i, i + 1, 1) for i in range(24)])
    start = spark.createDataFrame([(0,)], "id long")
    assert {r.id: r.distance for r in graph.shortest_paths(e, start).collect()} == {i: float(i) for i in range(25)}
    assert {r.id: r.distance for r in graph.shortest_paths(e, start, max_edges=3).collect()} == {i: float(i) for i in range(4)}
    assert {r.id: r.level for r in graph.topological_levels(e).collect()} == {i: i for i in range(25)}


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        graph.topological_levels(edges(spark, [(1, 2, 1), (2, 3, 1), (3, 1, 1)]))


def test_closure_settles_or_raises_and_keeps_the_best_confidence(spark):
    facts = spark.createDataFrame([("in", i, i + 1, 0.9) for i in range(8)] + [("in", 0, 2, 0.1)], "predicate string, a long, b long, confidence double")

    def through(known, new):
        left, right = (lambda f: f.select("a", F.col("b").alias("m"), F.col("confidence").alias("c1"))), (lambda f: f.select(F.col("a").alias("m"), "b", F.col("confidence").alias("c2")))
        met = left(new).join(right(known), "m").unionByName(left(known).join(right(new), "m"))
        return met.select(F.lit("in").alias("predicate"), "a", "b", (F.col("c1") * F.col("c2")).alias("confidence"))

    got = {(r.a, r.b): r.confidence for r in graph.fixpoint(facts, [through]).collect()}
    assert len(got) == 36 and all(abs(c - 0.9 ** (b - a)) < 1e-9 for (a, b), c in got.items())
    with pytest.raises(RuntimeError):
        graph.fixpoint(facts, [through], max_rounds=2)


def test_changes_are_checked(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id long, type string")
    g = graph.Graph(nodes, edges(spark, [(1, 2, 1), (2, 3, 1)]))
    with pytest.raises(KeyError):
        g.add_edges(edges(spark, [(1, 9, 1)]), strict=True)
    g = g.add_edges(edges(spark, [(1, 9, 1), (3, 1, 2)])).add_nodes(spark.createDataFrame([(3, "c"), (4, "d")], "id long, type string"))
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(1, 2), (2, 3), (3, 1)]
    assert sorted((r.id, r.type) for r in g.nodes.collect()) == [(1, "a"), (2, "a"), (3, "c"), (4, "d")]
    assert g.remove_edges(edges(spark, [(1, 2, 1)])).edges.count() == 2
    assert [(r.id, r.depth) for r in g.neighbours(spark.createDataFrame([(1,)], "id long"), "out").collect()] == [(2, 1)]


def test_depth_first_order(spark):
    e = edges(spark, [(1, 5, 1), (1, 2, 1), (2, 3, 1), (3, 1, 1), (5, 4, 1), (2, 4, 1), (8, 9, 1)])
    assert graph.dfs(e, 1) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        graph.dfs(e, 1, max_nodes=3)


def test_betweenness_against_brute_force(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(22)} - {(i, i) for i in range(9)})
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    want = dict.fromkeys({x for p in pairs for x in p}, 0.0)
    for s in want:
        paths = {s: [[s]]}
        level = [s]
        while level:
            new = {}
            for x in level:
                for y in near.get(x, []):
                    if y not in paths:
                        new.setdefault(y, []).extend([*p, y] for p in paths[x])
            paths |= new
            level = list(new)
        for t, ps in paths.items():
            for p in ps:
                for x in p[1:-1]:
                    want[x] += 1 / len(ps)
    e = edges(spark, [(a, b, 1) for a, b in pairs])
    got = {r.id: r.betweenness for r in graph.betweenness(e, graph.all_distances(e)).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-5 for x in want)


def test_moves_find_planted_groups(spark):
    rows = [(10 * g + a, 10 * g + b, 5) for g in range(3) for a in range(6) for b in range(a)] + [(0, 10, 1), (11, 20, 1), (21, 1, 1)]
    e = edges(spark, rows)
    label = graph.louvain_moves(e)
    assert len({(r.id // 10, r.community) for r in label.collect()}) == 3
    alone = label.withColumn("community", F.col("id"))
    assert graph.modularity(e, label).first()[0] > graph.modularity(e, alone).first()[0]


def test_statistics_of_two_parts(spark):
    r = graph.statistics(edges(spark, [(1, 2, 1), (2, 3, 1), (3, 4, 1), (7, 8, 1), (8, 7, 1)])).first()
    assert (r.nodes, r.edges, r.components, r.largest, r.diameter) == (6, 4, 2, 4, 3)


def test_a_hub_and_a_long_chain_are_one_component(spark):
    from tessaline.operators.components import connected_components

    e = edges(spark, [(0, i, 1) for i in range(1, 400)] + [(399 + i, 400 + i, 1) for i in range(40)] + [(1000, 1001, 1)])
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert len(got) == 442 and {got[i] for i in range(440)} == {0} and got[1001] == got[1000] == 1000


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    from tessaline import session

    class Context:
        master = "spark://host:7077"
        _jsc = property(lambda self: self)
        sc = lambda self: self
        getCheckpointDir = lambda self: self
        isDefined = lambda self: False
        getConf = lambda self: self
        get = lambda self, key, other=None: other

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_intermediate_tables_can_be_removed(spark):
    from tessaline import session

    rows = spark.range(5)
    one, two = session.written(rows, "test"), session.written_by_key(rows, "test", "id", 2)
    assert one.count() == two.count() == 5
    assert session.clean_up(spark) >= 2 and session.clean_up(spark) == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tessaline_test")]
