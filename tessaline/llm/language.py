"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are UTF-8 n-grams of letters and word borders, hashed to a fixed number of places; a text's
value for one is its share of the text's n-grams times the inverse document frequency. Document
frequencies are counted over every labelled training row. Weights are learned by
follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties, on at most about
`per_language` training rows of each language, chosen by a hash of their id: that bound makes the fit a
task of fixed size whatever the input. One in five of these rows is kept from the weights and sets the
temperature that makes scores honest probabilities. Every row of the input is then scored from its whole text.

Defined cases: a null text, or one without any letter, is `und` with score 0; with no labelled row at
all every text is `und`; rows with a null id or label are scored but never learned from; repeated rows
get equal results; a tie goes to the language that sorts first; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessaline.llm import textkernel as K
from tessaline.session import ship, written

PLACES = 1 << 15
SIZES = (2, 3, 4)
SCALE = 200.0
#: Letters of ASCII in lower case and all other bytes of UTF-8 stay; the rest of ASCII is one word border.
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of each n-gram, borders by text) for each size of n-gram."""
    spread, begin, end = K.spread(data, offsets)
    folded = _FOLD[spread]
    value = K.BYTE_VALUES[0][folded]
    code = value.copy()
    base = K.U64(K.BASES[0])
    for n in range(2, max(SIZES) + 1):
        code = code[:-1] * base + value[n - 1 :]
        if n not in SIZES:
            continue
        # an n-gram may end with the border after its text
        keep = np.ones(len(code), dtype=bool)
        last = end - n + 2
        keep[K.ragged(np.maximum(last, begin), np.minimum(end + 1, len(code)).clip(min=0) - np.minimum(np.maximum(last, begin), len(code)))] = False
        places = ((code ^ (code >> K.U64(31))) * K.U64(0x9FB21C651E98DF25) >> K.U64(64 - 15)).astype(np.int32)
        count = np.minimum(np.maximum(last - begin, 0), end + 1 - begin)
        yield places[keep], np.concatenate(([0], np.cumsum(count)))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(PLACES, dtype=np.int64), 0
    seen = np.zeros(PLACES, dtype=bool)
    for batch in batches:
        data, offsets = K.flat_bytes(batch.column("text"))
        for a, b in K.chunks(offsets):
            sizes = list(grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            for i in range(b - a):
                seen[:] = False
                for places, borders in sizes:
                    seen[places[borders[i] : borders[i + 1]]] = True
                df += seen
            n += b - a
    K.release()
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"place": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(df[some], n), pa.int64())})


def _vector(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    every = np.concatenate([p for p, _ in grams(data, np.array([0, len(data)]))])
    places, times = np.unique(every, return_counts=True)
    return places, (times / max(1, len(every))).astype(np.float32)


def train(rows: list[tuple[str, str]], idf: np.ndarray, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, weights, bias, temperature) from (text, language) rows, by FTRL-proximal and temperature scaling."""
    names = sorted({x for _, x in rows})
    vectors = [(p, (v * idf[p] * SCALE).astype(np.float32)) for p, v in map(_vector, (t for t, _ in rows))]
    label = np.array([names.index(x) for _, x in rows])
    z, n = np.zeros((PLACES + 1, len(names))), np.zeros((PLACES + 1, len(names)))

    def weights(at):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) > l1, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2), 0.0)

    def softmax(s):
        e = np.exp(s - s.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    learn = [i for i in range(len(rows)) if i % 5 != 4] or list(range(len(rows)))
    for _ in range(epochs):
        for i in learn:
            at, v = np.append(vectors[i][0], PLACES), np.append(vectors[i][1], 1.0)
            w = weights(at)
            g = softmax(v @ w)
            g[label[i]] -= 1
            step = v[:, None] * g[None, :]
            nn = n[at]
            sigma = (np.sqrt(nn + step * step) - np.sqrt(nn)) / alpha
            z[at] += step - sigma * w
            n[at] = nn + step * step
    w = weights(np.arange(PLACES + 1))
    held = [i for i in range(len(rows)) if i % 5 == 4] or learn
    scores = np.array([vectors[i][1] @ w[vectors[i][0]] + w[PLACES] for i in held])
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.05, 20, 121):
        p = softmax(scores / t)[np.arange(len(held)), label[held]]
        loss = -np.log(np.maximum(p, 1e-12)).mean()
        if loss < best - 1e-9:
            best, temperature = loss, float(t)
    return names, w[:PLACES], w[PLACES], temperature


def fit(training: DataFrame, per_language: int = 1000, languages: int = 256) -> dict | None:
    """A model from rows (doc_id, text, lang) without nulls in lang; None if there is none.

    It is trained in one task on a bounded sample: about `per_language` whole texts of each of the `languages` most
    frequent labels (ties: by code point), so of some 256,000 texts at most; document frequencies cover all rows.
    """
    spark = training.sparkSession
    ship(spark)
    shares = training.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    shares = written(shares.select(F.col("lang").alias("label"), F.least(F.lit(1.0), per_language / F.col("count")).alias("share")), "language-shares")
    found = training.select("text").mapInArrow(_frequencies, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(PLACES)
    total = next(r["n"] for r in found if r["place"] == -1)
    for r in found:
        if r["place"] >= 0:
            df[r["place"]] = r["n"]
    idf = np.log((1 + total) / (1 + df)) + 1
    even = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    # at most `languages` rows of a label and a number are broadcast
    sample = training.join(F.broadcast(shares), F.col("lang") == F.col("label")).where(even < F.col("share")).select("doc_id", "text", "lang").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist())]
        if not rows:
            return
        rows.sort(key=lambda r: (K.mix(np.array([r[0]], dtype=np.int64).view(np.uint64))[0], r[1]))
        names, w, bias, temperature = train([(t, x) for _, t, x in rows], idf)
        K.release()
        out = io.BytesIO()
        np.savez(out, w=w.astype(np.float32), bias=bias, temperature=temperature)
        yield pa.RecordBatch.from_pydict({"names": [names], "model": [out.getvalue()]})

    got = sample.mapInArrow(run, "names array<string>, model binary").collect()
    if not got:
        return None
    saved = np.load(io.BytesIO(bytes(got[0]["model"])))
    return {"names": list(got[0]["names"]), "weights": (saved["w"] * idf[:, None] * SCALE).astype(np.float32), "bias": saved["bias"], "temperature": float(saved["temperature"])}


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.concatenate(([0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) & (data < 0x80))))
    other = np.concatenate(([0], np.cumsum(data >= 0x80)))
    out = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
    for i in np.flatnonzero(~out & (other[offsets[1:]] > other[offsets[:-1]])):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode())
    return out


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` (or its columns `keep`) with lang_pred and score for each row."""
    ship(docs.sparkSession)
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("lang_pred", "score", "__text")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = K.flat_bytes(batch.column("__text"))
            names, scores = [], []
            for a, b in K.chunks(offsets):
                part, borders = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                letters = _has_letter(part, borders)
                if m is None:
                    names += ["und"] * (b - a)
                    scores += [0.0] * (b - a)
                    continue
                total, n = np.zeros((b - a, len(m["names"]))), np.zeros(b - a, dtype=np.int64)
                for places, at in grams(part, borders):
                    size = np.diff(at)
                    some = size > 0
                    if some.any():
                        total[some] += np.add.reduceat(m["weights"][places], at[:-1][some], axis=0, dtype=np.float64)
                    n += size
                s = (total / np.maximum(n, 1)[:, None] + m["bias"]) / m["temperature"]
                p = np.exp(s - s.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                names += [m["names"][k] if yes else "und" for k, yes in zip(best, letters)]
                scores += np.where(letters, p[np.arange(b - a), best], 0.0).tolist()
            out = [batch.column(i) for i in range(len(kept))] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "lang_pred", "score"])
        K.release()

    return rows.mapInArrow(run, (fields + ", " if fields else "") + "lang_pred string, score double")


def in_fold(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether a row is held out: the crc32 of its id as text leaves `fold`. A null id is held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(True))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = 1000, languages: int = 256, keep: list[str] | None = None) -> DataFrame:
    """Learn from the labelled rows that are not held out, then score every row."""
    training = docs.where(~in_fold(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    training = training.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("lang"))
    return predict(docs, fit(training, per_language, languages), id_col, text_col, keep)
