import random
import re

from tessaline.llm.licenses import PHRASES, TEMPLATES, license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def base(text):
    w = WORD.findall(lower(text))
    places = [(i, label) for label, p in PHRASES for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def check(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string").repartition(3)
    got = {r.doc_id: r for r in license_scan(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    return got


def test_small_texts(spark):
    texts = [None, "", "Under the MIT License.", "under_the-mit\nlicense under the mit license x", "CC BY-NC 4.0", "apache license version 2.0", "apache License, Version 2", "cc by nc cc by nc", "under the mit under the mit license", "the mit license", "éapache license version 2"]
    got = check(spark, texts + texts)
    assert got[2].score == 1.0 and got[9].score == 0.0


def test_templates_are_found_and_noise_is_not(spark):
    rng = random.Random(1)
    texts = []
    for _, t in TEMPLATES:
        w = t.split()
        for _ in range(len(w) // 40):
            w[rng.randrange(len(w))] = "changed"
        if len(w) > 20:
            w.insert(len(w) // 2, "inserted")
        texts.append("some words before it " + " ".join(w) + " and more after")
    words = " ".join(t for _, t in TEMPLATES).split()
    noise = [" ".join(rng.choice(words) for _ in range(2000)) for _ in range(3)]
    got = check(spark, texts + noise)
    for i, (label, _) in enumerate(TEMPLATES):
        assert got[i].labels == ",".join(sorted({label, *filter(None, got[i].base_labels.split(","))})), (label, got[i])
    assert all(got[len(texts) + i].labels == got[len(texts) + i].base_labels for i in range(3))


def test_each_notice_has_its_own_label_alone_in_pairs_and_repeated(spark):
    rng = random.Random(3)
    texts, want = [], []
    for label, t in TEMPLATES:
        texts += [t, f"see below {t.upper()} the end", " ".join([t] * 6), f"{t} " + "filler text " * 30 + t]
        want += [{label}] * 4
    for _ in range(25):
        (l1, t1), (l2, t2) = rng.sample(TEMPLATES, 2)
        texts.append(f"{t1}\n\n{t2}")
        want.append({l1, l2})
    texts += ["licensed under the Affero General Public License " * n for n in (1, 6)]
    want += [{"agpl"}] * 2
    got = check(spark, texts)
    for i, w in enumerate(want):
        assert set(filter(None, got[i].labels.split(","))) == w | set(filter(None, base(texts[i])[4].split(","))), texts[i]


def test_no_words_of_a_license_alone_make_its_label(spark):
    got = check(spark, ["the work is licensed by its author under terms of the public", "permission is granted to any person", "general public license of the road", None, ""])
    assert all(r.labels == "" and r.score == 0 for r in got.values())


def test_many_templates_are_joined_by_a_shuffle(spark, monkeypatch):
    from tessaline.llm import licenses

    want = check(spark, [t for _, t in TEMPLATES])
    monkeypatch.setattr(licenses, "MAX_GRAMS", 0)
    assert check(spark, [t for _, t in TEMPLATES]) == want


def test_null_ids_long_texts_and_clashing_columns(spark):
    long = "words of no license " * 60_000 + TEMPLATES[0][1]
    rows = [(None, long, 1, "x"), (None, long, 1, "x"), (3, "", 2, None)]
    got = license_scan(spark.createDataFrame(rows, "doc_id long, text string, n_words int, score string")).collect()
    assert sorted((str(r.doc_id), r.labels, r.n_words) for r in got) == [("3", "", 0)] + [("None", "mit", len(WORD.findall(long)))] * 2


def test_whole_table(spark):
    check(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()])


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
