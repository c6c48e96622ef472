"""Recall of line dedup against brute-force edit similarity, without any condition on sketches."""

import random

from test_line_dedup import edits, normal

from tessaline.llm.line_dedup import line_dedup, within


def changed(rng, line, share):
    """The line with whole words replaced, as many as fit into that share of its length."""
    w = line.split()
    left = int(share * len(line)) - 2
    for i in rng.sample(range(len(w)), len(w)):
        new = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in w[i])
        if len(new) <= left:
            w[i], left = new, left - len(new)
    return " ".join(w)


def planted(rng, sizes, share, n):
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    vocab = [word() for _ in range(4000)]
    lines = []
    for _ in range(n):
        line = " ".join(rng.choice(vocab) for _ in range(rng.choice(sizes)))
        lines.append((line, changed(rng, line, share)))
    return [(a, b) for a, b in lines if a != b and edits(a, b) * 5 <= max(len(a), len(b))]


def recall(spark, pairs):
    rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    got = {r.doc_id: r.n_removed for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert not any(got[2 * i] for i in range(len(pairs)))  # nothing but the planted partner is near
    return sum(got[2 * i + 1] for i in range(len(pairs))) / len(pairs)


def test_finds_lines_of_the_edit_similarity(spark):
    rng = random.Random(4)
    for sizes, share, least in (([20, 27, 40], 0.1, 0.98), ([80, 200], 0.1, 0.98), ([20, 27, 40], 0.18, 0.9), ([4, 6, 8], 0.2, 0.85)):
        pairs = planted(rng, sizes, share, 300)
        assert len(pairs) > 150
        got = recall(spark, pairs)
        print(sizes, share, len(pairs), got)
        assert got >= least


def test_one_group_of_many_near_lines(spark):
    rng = random.Random(6)
    base = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(30)]
    lines = []
    for _ in range(200):
        w = list(base)
        w[rng.randrange(30)] = "".join(rng.choice("abcdefgh") for _ in range(5))
        lines.append(" ".join(w))
    out = line_dedup(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert sum(r.n_removed for r in out) == 199


def test_every_similar_pair_of_real_lines(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    seen = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if n := " ".join(x for x in normal(line) if x):
                seen.setdefault(n, len(seen))
    names = list(seen)
    parent = list(range(len(names)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for j in range(i):
            b = names[j]
            most = max(len(a), len(b)) // 5
            if abs(len(a) - len(b)) <= most and len(set(a.split()) & set(b.split())) * 3 > len(set(a.split())) and within(a, b, most):
                parent[find(j)] = find(i)
    want = len({find(i) for i in range(len(names))})
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len({" ".join(y for y in normal(x) if y) for r in out for x in (r.text or "").split("\n") if any(normal(x))}) == want
