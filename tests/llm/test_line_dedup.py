import random
import re

import numpy as np
import pyarrow as pa

from tessaline.llm import line_dedup as module
from tessaline.llm import textkernel as K
from tessaline.llm.line_dedup import LINE_BITS, WORDS, _cells, _small_simhashes, all_within, line_base, line_dedup, lines_of, meetings, neighbours, settle, simhash_blocks, simhashes, sketches, within


def normal(line):
    s = re.sub("[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), line)
    return re.sub(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]", " ", s).split(" ")


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, percent=80):
    """By edit similarity alone: no sketch, no candidates. `within` is held to the plain table below."""
    seen = {}
    for at, (d, t) in enumerate(rows):
        for k, line in enumerate((t or "").split("\n")):
            n = " ".join(x for x in normal(line) if x)
            if n:
                seen.setdefault(n, []).append((d is None, d or 0, at, k))
    names = list(seen)
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            most = max(len(a), len(b)) * (100 - percent) // 100
            if abs(len(a) - len(b)) <= most and within(a, b, most):
                parent[find(a)] = find(b)
    stay = {}
    for n in names:
        g = find(n)
        stay[g] = min([stay.get(g, (True, 1 << 60, 0, 0)), *seen[n]])
    gone = {(p[2], p[3]) for n in names for p in seen[n] if p != stay[find(n)]}
    out = []
    for at, (d, t) in enumerate(rows):
        lines = t.split("\n") if t is not None else []
        keep = [x for k, x in enumerate(lines) if (at, k) not in gone]
        out.append((d, None if t is None else "\n".join(keep), len(lines), len(lines) - len(keep)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(t, d, 9, "x") for d, t in rows], "text string, doc_id long, n_lines int, lang string").repartition(3)
    out = line_dedup(df)
    assert out.columns == ["text", "doc_id", "lang", "n_lines", "n_removed"]
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéö") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 8, 40]))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.choice([0, 1, 3, 6])):
            w = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            line = " ".join(w)
            lines.append(rng.choice([line, line.upper(), line + " 12!", "", " -- "]))
        rows.append((i * 3, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "12:30\n99:01\n1"), (504, "É\né"), (505, "same line\nsame line\nsame line"), (1, "x " * 3000)]
    assert run(spark, rows) == brute(rows)


def test_whole_table_and_repeated_rows(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    assert run(spark, rows) == brute(rows)
    twice = spark.createDataFrame([(7, "a b c\nd"), (7, "a b c\nd"), (None, "a b c\ne")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in line_dedup(twice).collect())
    assert got == [("7", "", 2), ("7", "a b c\nd", 0), ("None", "e", 1)]


def test_empty_table(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_with_few_changed_words_share_a_block():
    """d changed words touch at most 2 d blocks: with more blocks than that, every pair shares one, if it holds enough words."""
    rng = np.random.default_rng(1)
    for n, d in ((13, 1), (26, 2), (50, 4), (200, 4)):
        for _ in range(40):
            words = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            other = words.copy()
            other[rng.choice(n, d, replace=False)] = rng.integers(0, 1 << 63, d, dtype=np.uint64)
            keys = [set(simhash_blocks(x, np.array([0, n]), WORDS, 64, 1)[1].tolist()) for x in (words, other)]
            assert keys[0] & keys[1]


def test_lines_of_near_lengths_are_dealt_alike():
    for n in range(3, 300):
        p = K.mix(np.arange(n, dtype=np.uint64))
        one, two = (set(simhash_blocks(x, np.array([0, len(x)]), 1.0, 20, 1)[1].tolist()) for x in (p, p[: n - n // 16]))
        assert n < 8 or one & two


def test_tiny_lines_within_one_edit_share_a_block():
    def keys(text):
        for _, w, _, _, first in lines_of(pa.array([text])):
            return set().union(*(k.tolist() for _, _, k in sketches(w, first[:1], first[1:], 20)))

    for a, b in (("la ra", "la ja"), ("abcde", "abcdef"), ("éüß abc", "éß abc"), ("abcdefghi", "xbcdefghi")):
        assert keys(a) & keys(b)


def test_ids_of_lines_sort_as_their_blocks_do():
    blocks = [0, 1, 8191, 1 << 20, (1 << 20) + 7, ((1 << 20) - 1) << 20]
    base = [line_base(b) for b in blocks]
    assert base == sorted(set(base)) and all(b < 1 << 63 and b % (1 << LINE_BITS) == 0 for b in base)
    for bad in (8192, 1 << 40):
        try:
            line_base(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_small_simhashes_agree_with_counted_ones():
    prints = K.mix(np.arange(3000, dtype=np.uint64))
    size = np.random.default_rng(4).integers(1, 40, 120)
    first = np.concatenate(([0], np.cumsum(size)))
    assert (_small_simhashes(prints, first[:-1], size) == simhashes(prints[: first[-1]], first)).all()


def test_columns_digits_and_very_long_texts(spark):
    schema = "doc_id long, text string, N_LINES string, gone boolean, lid long, line int, bucket int"
    rows = [(1, "Revenue 2019: 45\nkeep", "a", True, 1, 2, 3), (2, "Revenue 2020: 99\nother", "b", None, None, None, None), (3, "word " * 200_000 + "\n" + "x\n" * 50_000, None, False, 7, 8, 9)]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in line_dedup(df, fold_digits=False, percent=95).collect()}
    assert (got[1].text, got[2].text) == ("Revenue 2019: 45\nkeep", "Revenue 2020: 99\nother") and got[1].lid == 1 and got[2].gone is None and got[3].bucket == 9
    assert got[3].n_lines == 50_002 and got[3].n_removed == 49_999
    assert {r.doc_id: r.n_removed for r in line_dedup(df, fold_digits=True).collect()}[2] == 1


def test_neighbours_of_large_runs_agree_with_small_ones():
    rng = np.random.default_rng(2)
    sim = rng.integers(0, 1 << 10, 200, dtype=np.uint64)
    lid, weight, size = np.arange(200), rng.integers(0, 4, 200).astype(np.uint8), rng.integers(80, 120, 200)
    at, hub, nearest = neighbours(np.zeros(200, dtype=np.uint32), lid, sim, size, weight, 3, 80)
    got = dict(zip(at.tolist(), zip(hub.tolist(), nearest.tolist())))
    for i in range(200):
        near = [j for j in range(200) if j != i and int(sim[i] ^ sim[j]).bit_count() <= 3 and 5 * abs(size[i] - size[j]) <= max(size[i], size[j])]
        assert got.get(i) == ((min(near, key=lambda j: (-int(weight[j]), j)), min(near, key=lambda j: (int(sim[i] ^ sim[j]).bit_count(), j))) if near else None)
    same = [neighbours(np.arange(200, dtype=np.uint32) // 40, lid, sim, size, weight, 3, 80), neighbours(np.arange(200, dtype=np.uint32)[::-1] // 40, lid[::-1], sim[::-1], size[::-1], weight[::-1], 3, 80)]
    assert [sorted(zip(lid[a].tolist(), h.tolist(), n.tolist())) for a, h, n in same[:1]] == [sorted(zip(lid[::-1][a].tolist(), h.tolist(), n.tolist())) for a, h, n in same[1:]]


def test_simhash_counts_every_word_of_long_lines():
    prints = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2)
    first = np.array([0, 1, 256, 511, 512, 1300, 4999, 5000])
    got = simhashes(prints, first)
    for i in range(len(first) - 1):
        bits = np.unpackbits(prints[first[i] : first[i + 1]].view(np.uint8).reshape(-1, 8), axis=1).astype(int)
        assert got[i] == np.packbits(2 * bits.sum(axis=0) > len(bits)).view(np.uint64)[0]


def test_edit_bound_agrees_with_the_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(400):
        x = "".join(rng.choice(list("ab é"), rng.integers(0, 90)))
        y = list(x)
        for _ in range(rng.integers(0, 12)):
            at = int(rng.integers(0, len(y) + 1))
            y[at : at + int(rng.integers(0, 2))] = rng.choice(list("ab é"), rng.integers(0, 3)).tolist()
        y = "".join(y)
        true = edits(x, y)
        for most in {0, 1, 5, max(true - 1, 0), true, true + 1}:
            assert within(x, y, most) == (true <= most)


def test_lines_that_meet_behind_a_hub_are_linked(spark):
    """Lines of each list link, but meet only where the first one is the hub and the nearest of all, and is near none."""
    lists = [["reing", "esing", "eding"], ["thatnd", "thatan", "thaten", "thaton"], ["reble", "enble", "erble"], ["ereare", "ereaea", "ereaed"], ["to to", "or to", "of to"], ["chver", "scher", "cher"]]
    rows = [(i, x) for i, x in enumerate(x for some in lists for x in some)]
    assert run(spark, rows) == brute(rows) and sum(r[3] for r in brute(rows)) == 8


def test_cells_join_the_classes_that_all_near_pairs_join(monkeypatch):
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(40)).strip() + "x" for _ in range(12)]
    texts = []
    for _ in range(300):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(9)):
            t[rng.randrange(len(t))] = rng.choice("ijklmnop")
        texts.append("".join(t))
    lid, sim = np.arange(300) * 7, np.random.default_rng(5).integers(0, 1 << 12, 300).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    near = lambda i, j: int(sim[i] ^ sim[j]).bit_count() <= 6 and within(texts[i], texts[j], max(size[i], size[j]) // 5)
    pairs = [(i, j) for i in range(300) for j in range(i) if near(i, j)]

    def classes(links):
        root = list(range(300))
        for i, j in links:
            a, b = root[i], root[j]
            root = [min(a, b) if r in (a, b) else r for r in root]
        return root

    want = classes(pairs)
    assert 12 < len(set(want)) < 200
    code = np.zeros(300, dtype=np.uint32)
    for part in (4096, 70):
        monkeypatch.setattr(module, "PART", part)
        at, hub, nearest, rest, borders = meetings(code, lid, sim, size, np.ones(300, np.uint8), 6, 80)
        first = [(a, b // 7) for a, b in [*zip(at.tolist(), hub.tolist()), *zip(at.tolist(), nearest.tolist())] if near(a, b // 7)]
        some = classes(first)
        cells = _cells(lid[rest], sim[rest], borders).to_pylist()
        assert (len(cells) > 1) == (part == 70)
        rows = [(c, x["split"], p, i, s, some[i // 7], texts[i // 7]) for c, x in enumerate(cells) for p, (i, s) in enumerate(zip(x["lids"], x["sims"]))]
        got = settle(pa.table(dict(zip(("cell", "split", "place", "lid", "sim", "grp", "line_text"), map(list, zip(*rows))))), 6, 80)
        links = [(x // 7, y // 7) for x, y in zip(got.column("x").to_pylist(), got.column("y").to_pylist())]
        assert classes(first + links) == want and some != want and len(links) < 300


def test_many_pairs_at_once_agree_with_one_at_a_time():
    rng = random.Random(3)
    pairs = []
    for size in (1, 5, 63, 64, 65, 128, 129, 300, 2000):
        for _ in range(120 if size < 1000 else 6):
            x = [rng.choice("abcdé漢 𝒳") for _ in range(size)]
            y = list(x)
            for _ in range(rng.randint(0, size // 3 + 1)):
                k = rng.randrange(len(y) + 1)
                y[k : k + rng.choice([0, 1])] = rng.choice(["", "q", "ü"])
            pairs.append(("".join(x), "".join(y)))
    got = all_within(pairs, 80)
    assert got.tolist() == [within(x, y, max(len(x), len(y)) // 5) for x, y in pairs] and 100 < got.sum() < len(pairs) - 100
    assert all(edits(x, y) * 5 <= max(len(x), len(y)) if yes else edits(x, y) * 5 > max(len(x), len(y)) for (x, y), yes in zip(pairs, got.tolist()) if len(x) < 150)


def test_most_pairs_are_told_without_a_column(monkeypatch):
    """Unlike texts are told by bounds from below, texts with other words inserted, deleted and replaced by one from above."""
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéö") for _ in range(rng.randint(3, 9))) for _ in range(400)]
    unlike, like = [], []
    for n in (10, 40, 200):
        for _ in range(60):
            x, y = ([rng.choice(vocab) for _ in range(n)] for _ in range(2))
            unlike.append((" ".join(x), " ".join(y)))
            z = list(x)
            for _ in range(n // 20):
                k = rng.randrange(1, len(z))
                z[k : k + rng.choice([0, 1])] = rng.choice([[], [rng.choice(vocab)]])
            like.append((" ".join(["begin", *x, "end"]), " ".join(["begun", *z, "ende"])))
    asked = []
    one, many = module._columns, module._many_columns
    monkeypatch.setattr(module, "_columns", lambda *a: asked.append(a) or one(*a))
    monkeypatch.setattr(module, "_many_columns", lambda pairs, *a: asked.extend(pairs) or many(pairs, *a))
    assert not all_within(unlike, 80).any() and all_within(like, 80).all()
    assert len(asked) < len(unlike + like) // 10


def test_bounds_and_bands_agree_with_the_plain_table():
    rng = random.Random(22)
    for alphabet in ("ab ", "abcdefgh ", "aé漢𝒳 "):
        pairs = []
        for _ in range(250):
            x = [rng.choice(alphabet) for _ in range(rng.choice([3, 20, 70, 140, 330]))]
            y = list(x)
            for _ in range(rng.randrange(1 + len(x) // 3)):
                k = rng.randrange(len(y) + 1)
                y[k : k + rng.randrange(3)] = [rng.choice(alphabet) for _ in range(rng.randrange(3))]
            cut = rng.randrange(len(y) + 1)
            pairs.append(("".join(x), "".join(rng.choice([y, y, y[cut:] + y[:cut]]))))
        true = [edits(x, y) for x, y in pairs]
        for percent in (50, 80, 95):
            most = [max(len(x), len(y)) * (100 - percent) // 100 for x, y in pairs]
            want = [e <= m for e, m in zip(true, most)]
            assert all_within(pairs, percent).tolist() == want
            for bound in (module._surely_apart, module._apart):
                assert not any(a and w for a, w in zip(bound(pairs, np.array(most)), want))
            assert not any(module._by_words(x.split(" "), y.split(" "), m) and not w for (x, y), m, w in zip(pairs, most, want))
            for (x, y), m, w in zip(pairs, most, want):
                assert not x or not y or abs(len(x) - len(y)) > m or module._columns(x, y, m) == w
