"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, operator by operator."""

import hashlib
from collections import Counter

from tessaline.llm.language import identify_language
from tessaline.llm.mixing import mix_sources
from tessaline.llm.ngram_join import ngram_jaccard_join
from tessaline.llm.packing import pack, pack_documents
from tessaline.llm.substring_dedup import substring_dedup

LONG = " ".join(f"word{i % 977} of{i}" for i in range(150_000))


def test_mixing_keeps_columns_and_counts_long_texts(spark):
    rows = [(1, LONG, "a", 9, "k", "s", 3), (2, "few words", "a", 9, "k", "s", 3), (None, None, None, 9, "k", "s", 3), (3, "", "b", 9, "k", "s", 3), (3, "", "b", 9, "k", "s", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix0 int, __key string, __source string, __size int")
    out = mix_sources(df)
    got = out.collect()
    assert out.columns[:7] == df.columns and len(got) == 5
    assert all((r.mix0, r["__key"], r["__source"], r["__size"]) == (9, "k", "s", 3) for r in got)
    assert {r.doc_id: r["size"] for r in got} == {1: 300_000, 2: 2, None: 0, 3: 0}
    assert mix_sources(spark.createDataFrame([], df.schema)).count() == 0


def test_ngram_join(spark):
    rows = [(None, LONG), (7, LONG + " end"), (5, LONG), (8, None), (9, " \n"), (None, "one two three four five six"), (4, "a b"), (2, "A  B"), (2, "A  B"), (None, None)]
    got = ngram_jaccard_join(spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, n_shingles int, component_id int")).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter([(None, 5), (7, 5), (5, 5), (8, 8), (9, 9), (None, None), (4, 2), (2, 2), (2, 2), (None, None)])
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_substring_dedup(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(None, passage), (1, f"x {passage} y"), (2, LONG), (3, None), (4, ""), (5, "short"), (5, "short")]
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, kept_text string")).collect()}
    assert got == {(None, 40, 40, ""), (1, 42, 40, "x y"), (2, 300_000, 0, LONG), (3, 0, 0, ""), (4, 0, 0, ""), (5, 1, 0, "short")}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_packing(spark):
    rows = [(None, "a b c"), (None, None), (1, LONG), (2, "")]
    df = spark.createDataFrame([(d, t, -1, "z") for d, t in rows], "doc_id long, text string, piece int, offset string")
    got = pack_documents(df).collect()
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter([None, None, 1, 2])
    assert pack_documents(spark.createDataFrame([], df.schema), keep_ids=True).count() == 0


def test_every_capacity_binds(spark):
    """Pieces and attention cost, not only tokens, decide how many sequences there are."""
    sizes = [100] * 40 + [10] * 200
    items = spark.createDataFrame(list(enumerate(sizes)), "uid long, length long")
    for how in ({}, {"max_pieces": 5}, {"max_attention": 25_000}, {"max_pieces": 6, "max_attention": 30_000, "rule": "dot"}):
        rows = pack(items, 1000, **how).collect()
        bins = Counter(r.sequence_id for r in rows)
        cost = Counter()
        for r in rows:
            cost[r.sequence_id] += r.length**2
        assert max(bins.values()) <= how.get("max_pieces", 1000) and max(cost.values()) <= how.get("max_attention", 1000**2)
        tokens, pieces, attention = -(-sum(sizes) // 1000), -(-len(sizes) // how.get("max_pieces", 1000)), -(-sum(x * x for x in sizes) // how.get("max_attention", 1000**2))
        assert max(tokens, pieces, attention) <= len(bins) <= 1.25 * max(tokens, pieces, attention) + 1


def test_language_with_clashing_columns_nulls_and_many_labels(spark):
    rows = [(i, "the quick brown fox and the lazy dog" if i % 2 else "der schnelle braune fuchs und der faule hund", ["en", "de"][1 - i % 2], 0.5, "k") for i in range(80)]
    rows += [(100 + i, "some text", f"odd{i}", 0.5, "k") for i in range(30)] + [(None, None, "en", None, None), (200, "12 34", None, None, None), (201, LONG, "en", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, label string")
    got = identify_language(df, languages=2).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert {r.lang_pred for r in got if r.doc_id in (None, 200)} == {"und"} and all(0 <= r.score <= 1 for r in got)
