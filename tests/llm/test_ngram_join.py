import random
import re

from tessaline.llm.ngram_join import ngram_jaccard_join

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall((text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n=5, percent=80):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and min(len(sets[i]), len(sets[j])) * 100 >= percent * max(len(sets[i]), len(sets[j])):
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def run(spark, rows, n=5):
    df = spark.createDataFrame([(t, d, 1) for d, t in rows], "text string, doc_id long, component_id int").repartition(3)
    return sorted(tuple(r) for r in ngram_jaccard_join(df, n=n).select("doc_id", "n_shingles", "component_id").collect())


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy).upper() if rng.random() < 0.3 else "  ".join(copy))
    shared = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [shared + " " + " ".join(rng.choice(vocab) for _ in range(40)) for _ in range(30)]
    rows += [None, "", " \n", "a", "A", "a b", rows[0], rows[0], "x " * 100, "x " * 120]
    rng.shuffle(rows)
    rows = [(i * 7 + 3, t) for i, t in enumerate(rows)]
    assert run(spark, rows) == brute(rows)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chains_whose_links_pass_by_the_leaders(spark):
    """Sets that link with a follower, not with its leader: their answers are derived."""
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(6):
        at = [rng.choice(vocab) for _ in range(160)]
        for _ in range(14):
            rows.append(" ".join(at))
            for _ in range(rng.choice([0, 1, 3])):
                copy = list(at)
                copy[rng.randrange(160)] = rng.choice(vocab)
                rows.append(" ".join(copy))
            for _ in range(rng.choice([2, 3, 4])):
                at[rng.randrange(160)] = rng.choice(vocab)
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    assert run(spark, rows) == brute(rows)


def test_derived_overlaps_are_the_whole_ones():
    import numpy as np
    import pyarrow as pa

    from tessaline.llm.ngram_join import _derived, _overlaps

    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 400, n).astype(np.uint64))
    raw = lambda x: x.astype(np.uint64).tobytes()
    for _ in range(60):
        leader, r = draw(rng.integers(1, 300)), draw(rng.integers(1, 300))
        f = np.unique(np.concatenate([leader[rng.random(len(leader)) < 0.95], draw(3)]))
        pair = lambda x, y: next(iter(_overlaps(1)(iter([pa.RecordBatch.from_pydict({"x": [1], "y": [2], "x_n": [len(x)], "y_n": [len(y)], "x_grams": [raw(x)], "y_grams": [raw(y)]})])))).to_pylist()[0]
        follows, met = pair(f, leader), pair(r, leader)
        if follows["less"] is None:
            continue
        got = next(iter(_derived(iter([pa.RecordBatch.from_pydict({"x": [1], "y": [2], "x_n": [len(r)], "y_n": [len(f)], "both": [met["both"]], "less": [follows["less"]], "plus": [follows["plus"]], "grams": [raw(r)]})])))).to_pylist()[0]
        assert got["both"] == len(np.intersect1d(f, r))
