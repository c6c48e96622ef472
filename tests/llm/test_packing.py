import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessaline.llm.packing import best_fit, pack, pack_documents


def check(spark, texts, most=2048):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    rows = pack_documents(df, max_tokens=most).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), most):
            part = np.array(ids[k : k + most], dtype="<u4")
            want[i, k // most] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for o, n in sorted(x):
            assert o == at
            at += n
        assert at <= most
    return len(bins), sum(r.length for r in rows)


def test_ids_and_places(spark):
    texts = ["It's A test, don't <|endoftext|> panic!", None, "", "  \n\t", "café café ́x İSTANBUL ΣΑΣ", "a b c 12345 ###!! 日本語 🙂", "w " * 5000, "same", "same", "\x1c\x1d a\x85b"]
    check(spark, texts)
    check(spark, texts, 16)


def test_parts_give_the_same_ids():
    import pyarrow as pa

    from tessaline.llm import textkernel as K
    from tessaline.llm.packing import lower_parts
    from tessaline.llm.tokens import WordCache

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    odd = ["a", "B", "'s", "'", "LL", "1", "22", ".", "!!", "é", "É", "×", "÷", "ß", "Ä", "\u0301", "\u0323", "—", " ", "\n", "\u00a0", "\x85", "\x1c", "日", "²", "½", "ǅ", "İ", "K", "$", "|", "\x01", "Σ", "_"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    more = [x + rng.choice(["<|endoftext|>", "<|ENDOFTEXT|>", "<|", "<|startoftext|>a"]) for x in texts[:200]]
    words = WordCache("word_bpe_49k.json")
    for some in (texts, more):
        for a, b, w in K.of_array(pa.array(some), limit=2000, refine=lower_parts):
            ids, sizes = words.of(w)
            ends = np.concatenate(([0], np.cumsum(sizes)))[w.first]
            for i in range(a, b):
                assert ids[ends[i - a] : ends[i - a + 1]].tolist() == t.encode(some[i], add_special_tokens=False).ids, some[i]


def test_whole_table(spark, sf):
    n, total = check(spark, [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])
    assert n <= 1.02 * -(-total // 2048) + 1


def test_every_capacity_holds():
    rng = np.random.default_rng(1)
    n = rng.integers(1, 100, 400).astype(float)
    sizes = np.stack([n, np.ones(400), n * n], axis=1)
    for rule in ("norm", "dot"):
        bins, order = best_fit(sizes, (100, 3, 6000) if n.max() ** 2 <= 6000 else (100, 3, 9801), (1, 1, 1), rule)
        assert sorted(order.tolist()) == list(range(400))
        for b in set(bins.tolist()):
            assert (sizes[bins == b].sum(axis=0) <= (100, 3, 9801)).all()
    with pytest.raises(ValueError):
        best_fit(sizes * 100, (100, 3, 9801), (1, 1, 1))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_piece_count_capacity(spark):
    items = spark.createDataFrame([(i, random.Random(i).randint(1, 9)) for i in range(50)], "uid long, length long")
    assert max(r["count"] for r in pack(items, 64, max_pieces=3).groupBy("sequence_id").count().collect()) <= 3
