from pyspark.sql import functions as F

from tessaline.llm.language import identify_language, in_fold


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify_language(docs).where(in_fold(F.col("doc_id"))).select("lang", "lang_pred", "score").collect()
    right = sum(r.lang == r.lang_pred for r in out) / len(out)
    assert right >= 0.95, right
    assert abs(sum(r.score for r in out) / len(out) - right) < 0.05
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog that was", "en") for i in range(30)] + [(100 + i, "der hund und die katze das ist", "de") for i in range(30)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !! —", None), (203, "é", None), (None, "und der", "xx"), (204, "the dog", None), (204, "the dog", None), (205, "der hund " * 20000, None)]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, score double").repartition(4)
    out = identify_language(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: (r.lang_pred, r.score) for r in out}
    assert by[200] == by[201] == by[202] == ("und", 0.0)
    assert by[203][0] in ("en", "de") and by[204][0] == "en" and by[205][0] == "de"
    assert "xx" not in {r.lang_pred for r in out}


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify_language(df).collect()] == [("und", 0.0)]
    assert identify_language(df.where("doc_id > 1")).count() == 0
