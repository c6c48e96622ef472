import random
import re
from collections import Counter

from tessaline.llm.substring_dedup import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def check(spark, texts, window, minimiser):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup(df, window=window, minimiser=minimiser).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, window)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "b", "cé", "d", "ee"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 4, 6, 30, 200]))) for _ in range(60)]
    texts += [None, "", "  \t\n ", texts[5], texts[5], "a " * 300, "x y z"]
    check(spark, texts, 6, 3)


def test_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = [r.text for r in rows]
    check(spark, texts, 35, 5)


def test_empty_table_and_null_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup(empty).count() == 0
    one = spark.createDataFrame([(None, "a b c a b c")], "doc_id long, text string")
    r = substring_dedup(one, window=3, minimiser=2).collect()[0]
    assert (r.doc_id, r.n_words, r.n_removed, r.kept_text) == (None, 6, 6, "")
