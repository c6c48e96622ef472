from collections import Counter

import corpus_pipeline as P
from test_line_dedup import brute as lines_brute
from test_mixing import aim
from test_ngram_join import brute as classes_brute


def test_each_stage_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(90).persist()
    columns = docs.columns
    after = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name != "best-fit packing":
            assert out.columns == columns
        after[name] = (docs.collect(), rows)
        docs = spark.createDataFrame(rows, out.schema)
    before, rows = after["language ID"]
    assert {r.doc_id for r in rows} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
    before, rows = after["line dedup"]
    want = {d: t for d, t, n, gone in lines_brute([(r.doc_id, r.text) for r in before]) if not gone or (t or "").strip()}
    assert {r.doc_id: r.text for r in rows} == want
    before, rows = after["n-gram Jaccard join"]
    assert sorted(r.doc_id for r in rows) == [d for d, n, c in classes_brute([(r.doc_id, r.text) for r in before]) if d == c]
    before, rows = after["mixing sources to target weights"]
    size = {r.doc_id: len((r.text or "").encode().split()) for r in before}
    sizes, taken = Counter(), Counter()
    for r in before:
        sizes[r.source] += size[r.doc_id]
    for r in rows:
        taken[r.source] += size[r.doc_id]
    for s, t in aim(dict(sizes)).items():
        assert abs(taken[s] - t) <= max(size[r.doc_id] for r in before if r.source == s) / 2 + 1
    before, rows = after["best-fit packing"]
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in before)


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 5), (2, None, "en", None, 0), (3, "", None, "b", 0), (None, "eins zwei drei vier", "de", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert {r.doc_id for r in docs.collect()} <= {1, None}


def test_columns_of_the_user_survive(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, f"{text} {'abcdefghij'[i % 10] * 4} {i}", "en", "a", 0, 9.5, 77, -1, "k", "l", 3, 5) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, score double, copies int, size int, key string, lang_pred string, n_removed int, column1 int")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == columns
        got = docs.collect()
        assert got and all((r.score, r.copies, r["size"], r.key, r.lang_pred, r.n_removed, r.column1) == (9.5, 77, -1, "k", "l", 3, 5) for r in got), name


def test_empty_table_and_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    long = spark.createDataFrame([(1, "many different words of a long text " * 20_000 + "end", "en", "a", 1), (2, "another text in english with its own words", "en", "b", 1)], empty.schema)
    for _, stage in P.STAGES:
        empty, long = stage(spark, empty, ""), stage(spark, long, "")
        assert empty.count() == 0
    total = {r.doc_id: sum(x.length for x in long.collect() if x.doc_id == r.doc_id) for r in long.collect()}
    assert total[1] > 20_000


def test_ids_of_the_last_stage(spark, sf):
    import zlib

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(50)
    for r in P.sequences(spark, docs, sf).collect():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32


def test_registered_and_runs(spark, sf):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is P.run
    out = P.run(spark, sf)
    assert out.count() > 0 and out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]


def test_lines_behind_a_hub_go_in_the_stage(spark):
    docs = spark.createDataFrame(list(enumerate(["reing", "esing", "eding"])), "doc_id long, text string")
    assert sorted(r.text for r in P.fuzzy_lines(spark, docs, "").collect()) == ["esing", "reing"]
