"""Readers and writers of `tessaline.sources.tables`, on small files."""

import pytest
from pyspark.sql import functions as F

from tessaline.operators import search
from tessaline.sources import tables


def test_vectors(spark, tmp_path):
    (tmp_path / "v.txt").write_text("1, 2,3\n\n4,5,6\n")
    assert sorted(r.embedding for r in tables.vectors_from_text(spark, str(tmp_path / "v.txt"), 3).collect()) == [[1, 2, 3], [4, 5, 6]]
    with pytest.raises(Exception, match="dimension"):
        tables.vectors_from_text(spark, str(tmp_path / "v.txt"), 2).collect()
    (tmp_path / "v.json").write_text('{"id": "a", "embedding": [1, 2], "metadata": {"k": "v"}, "content": "x"}\n')
    assert tables.vectors_from_json(spark, str(tmp_path / "v.json")).first().metadata == {"k": "v"}


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.txt", "é"), ("b.md", "long" * 10), ("c.bin", "no")):
        (tmp_path / "d" / name).write_text(text)
    got = {r.path.rsplit("/", 1)[1]: r for r in tables.text_files(spark, str(tmp_path / "d"), 30).collect()}
    assert set(got) == {"a.txt", "b.md"} and got["a.txt"].content == "é" and not got["a.txt"].skipped
    assert got["b.md"].skipped and got["b.md"].content is None and got["b.md"].size == 40


def test_query_files(spark, tmp_path):
    (tmp_path / "q1").write_text("vector: 1, 2.5\nk: 7\n")
    (tmp_path / "q2").write_text("# note\nvector: 3\n")
    assert sorted((r.vector, r.k) for r in tables.query_files(spark, str(tmp_path)).collect()) == [([1.0, 2.5], 7), ([3.0], 5)]


def test_sinks_and_backups(spark, tmp_path):
    rows = spark.createDataFrame([("p1", [1.0, 2.0]), ("p2", [3.0])], "path string, embedding array<double>")
    tables.embedding_sink(rows, str(tmp_path / "sink"))
    tables.embedding_sink(rows, str(tmp_path / "sink"))
    assert tables.checked_embeddings(spark, str(tmp_path / "sink")).count() == 4
    spark.read.parquet(str(tmp_path / "sink")).withColumn("embedding", F.array(F.lit(9.0), F.lit(1.0))).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="damaged"):
        tables.checked_embeddings(spark, str(tmp_path / "bad")).collect()
    tables.backup({"a": rows}, str(tmp_path / "backup"))
    assert sorted(tables.restore(spark, str(tmp_path / "backup"), ["a"])["a"].collect()) == sorted(rows.collect())
    nodes = spark.createDataFrame([(1, "t", {"k": "v"})], "id long, type string, properties map<string,string>")
    links = spark.createDataFrame([(1, 2, "e", 0.5)], "src long, dst long, type string, weight double")
    tables.graph_to_json(nodes, links, str(tmp_path / "g"))
    back = tables.graph_from_json(spark, str(tmp_path / "g"))
    assert back[0].collect() == nodes.collect() and back[1].collect() == links.collect()
    tables.export(rows, str(tmp_path / "out"), "json", ["path"], 1)
    assert spark.read.json(str(tmp_path / "out")).columns == ["path"]


def test_renderers(spark):
    rows = spark.createDataFrame([(1, "a"), (22, None)], "id int, name string")
    assert tables.render(rows, "json") == '{"id":1,"name":"a"}\n{"id":22}'
    assert tables.render(rows, "compact") == "1\ta\n22\tNone"
    assert tables.render(rows) == "id: 1\nname: a\n\nid: 22\nname: None"
    assert tables.render(rows, "table") == "id | name\n---+-----\n1  | a\n22 | None"
    with pytest.raises(ValueError):
        tables.render(rows, "odd")


def test_recall_of_the_approximate_indexes(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    exact = search.batch_knn(e, q, 10)
    for found in (search.lsh_candidates(e, q, tables=24, bits=4), search.ivf_candidates(e, q, cells=16, probes=11)):
        assert search.recall(search.rerank(found, e, q, 10), exact, 10).agg(F.avg("recall")).first()[0] >= 0.9


def test_strategies(spark):
    from tessaline.plans.planner import search_by_strategy, strategy

    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    exact = [r.vec_id for r in search_by_strategy(e, 20, 10).collect()]
    rough = [r.vec_id for r in search_by_strategy(e.unionAll(e.selectExpr("vec_id + 10000 as vec_id", "embedding", "label")).unionAll(e.selectExpr("vec_id + 20000 as vec_id", "embedding", "label")), 20, 10, approximate=True).collect()]
    found = [r.vec_id for r in search_by_strategy(e, 20, 9, approximate=True, indexed=True).collect()]
    assert strategy(5000, True) == "two_phase" and strategy(5, True) == "exact" and strategy(5, True, True) == "index"
    assert rough[:3] == [20, 10020, 20020] and len(set(found) & set(exact)) >= 5


def test_ranges_rank_as_one_sort_does(spark):
    from tessaline.operators.scoring import ranked_overall

    rows = spark.range(5000).select("id", (F.xxhash64("id") % 700).alias("score")).repartition(7)
    one, many = (sorted(tuple(r) for r in ranked_overall(rows, F.col("score").desc(), F.col("id"), alone=n).collect()) for n in (10_000, 10))
    assert one == many and sorted(r[2] for r in one) == list(range(1, 5001))
