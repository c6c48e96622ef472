import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessaline.llm.topk import Best, CoverTree, dual_search, top_k


def brute(rows, every, k):
    good = sorted((i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v))
    ints = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in good]
    out = []
    for i, q in sorted(set(ints)):
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i and len(v) == len(q))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]
    rows += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [1.0] * 8), (2200, [1.0, 2.0]), (2201, [0.5, 2.0]), (2250, [0.0] * 8), (50, rows[50][1]), (2300, [])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(4)
    for block in (64, 4096):
        got = top_k(df, F.col("vec_id") % 50 == 0, k=5, block_rows=block, query_rows=5, query_group=2).collect()
        assert sorted(map(tuple, got)) == brute(rows, 50, 5)


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_trees_cover_and_prune():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1000, (12, 16))
    x = np.rint(centers[rng.integers(0, 12, 3000)] + rng.normal(0, 5, (3000, 16))).astype(np.int64)
    t = CoverTree(x, np.arange(3000))
    assert sorted(t.order.tolist()) == list(range(3000))
    for c, r, b, e in zip(t.places, t.radii, t.begins, t.ends):
        assert np.sqrt(((t.points[b:e] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
    q = CoverTree(x[:60], np.arange(60))
    best = Best(60, 5)
    taken = dual_search(q, t, best)
    assert taken < 0.5 * 60 * 3000
    for i in range(60):
        s = x @ q.points[i]
        want = sorted((-v, j) for j, v in enumerate(s.tolist()) if j != q.ids[i])[:5]
        assert list(zip((-best.score[i]).astype(int).tolist(), best.ids[i].tolist())) == want


def test_repeated_rows_count_as_often_as_they_stand_and_sql_agrees(spark, tmp_path):
    import duckdb

    from tessaline.llm.topk import ORACLE

    rows = [(50, [1.0, 0.0])] * 2 + [(1, [0.9, 0.1])] * 3 + [(2, [0.8, 0.2])] + [(50, [0.0, 1.0])] + [(i, [0.1, i / 100]) for i in range(3, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 50 == 0, k=5).collect())
    assert [x[2] for x in got if x[0] == 50].count(1) >= 3 and got == brute(rows, 50, 5)
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    assert sorted((q, r, v, s) for q, r, v, s in con.execute(ORACLE).fetchall()) == got
