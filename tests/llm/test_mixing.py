import re

import duckdb

from tessaline.llm.mixing import ORACLE, mix_sources

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def aim(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, budget * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def check(rows, got, tolerance):
    size = lambda t: len(WORD.findall(t or ""))
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = aim(sizes)
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(d), size(t)) for d, t, _ in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2 and r.copies >= int(want[r.source] / max(1, sizes[r.source]) - 1e-9) * (r.size > 0)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= tolerance, (s, taken[s], want[s])


def test_small(spark):
    rows = [(i, "word " * (i % 17 + 1), "a" if i % 3 else "b") for i in range(300)]
    rows += [(1000 + i, "x y z", None) for i in range(40)] + [(2000, None, "c"), (2001, "", "c"), (2002, "é ù", "é"), (None, "q " * 30, "a"), (5, "word " * 6, "a")]
    df = spark.createDataFrame([(d, t, s, 1.0) for d, t, s in rows], "doc_id long, text string, source string, size double").repartition(4)
    out = mix_sources(df)
    assert out.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    got = out.collect()
    check(rows, got, 17)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(7)).collect()))
    plain = mix_sources(df, broadcast_sources=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, plain))


def test_table_and_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    got = mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect()
    check([(r.doc_id, r.text, r.source) for r in docs.collect()], got, 2000)
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{path}'")
    want = duckdb.sql(ORACLE).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_empty_and_wordless(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).count() == 0
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mix_sources(none).collect()] == [(0, 0.0, 0)] * 2
