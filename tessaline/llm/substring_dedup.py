"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of one text. Each window has a minimiser: the least
fingerprint of the `minimiser` words that start at any place where they fit into the window. Two equal
windows have the same minimiser, and neighbouring windows mostly share theirs. A super-k-mer, the
longest run of windows of a text with one minimiser, travels as one packed string of words to the
bucket of its minimiser. The bucket sorts the windows of all strings it got and counts them; a window
that occurs at two places or more is repeated, in one text or in several. The verdicts, one bit for
each window, go back to the block that the string came from, and each word covered by a repeated
window is removed.

Scale: strings carry about three times the text, compressed by block and bucket. Equal strings of a
block travel once, with a mark that says that they were several, so a passage that all texts share
puts one string for each block of texts in a bucket, not one for each text. The number of buckets
follows the number of blocks, so a bucket holds as much at any input size. Windows are compared by two
independent 64-bit fingerprints (128 bits).

Defined cases: null and empty texts have no words and come back with an empty kept text; texts
shorter than a window lose nothing; repeated rows are places of their own, so both lose every word
that a window covers; an empty table gives an empty result; other columns are neither read nor kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import textkernel as K
from tessaline.llm.blocks import bucket_count, blocks, deal, over, unzip_bytes, with_answers, zip_bytes

OUT = "doc_id long, n_words long, n_removed long, kept_text string"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, in about log2(width) passes."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def super_kmers(w: K.Words, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer; a window is named by its first word."""
    starts = np.flatnonzero(K.window_starts(w.first, window))
    if not len(starts):
        return starts, starts, np.zeros(0, dtype=np.uint64)
    grams = K.window_fingerprints(w.fingerprints(), minimiser)
    least = sliding_min(grams, window - minimiser + 1)[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1) | (w.text_of_word()[starts[1:]] != w.text_of_word()[starts[:-1]])
    at = np.flatnonzero(new)
    return starts[at], np.diff(np.append(at, len(starts))), least[at]


def _strings(w: K.Words, window: int, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    packed, begin, end = w.packed()
    view = packed.tobytes()
    return [view[a:b] for a, b in zip(begin[first].tolist(), end[first + n + window - 2].tolist())]


def _of_block(rows: pa.Table, window: int, minimiser: int) -> Iterator[tuple[int, int, K.Words, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    for a, b, w in K.of_array(rows.column("text")):
        first, n, key = super_kmers(w, window, minimiser)
        yield a, b, w, first, n, key, _strings(w, window, first, n) if len(first) else []


def _numbered(strings: list[bytes], seen: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((seen.setdefault(s, len(seen)) for s in strings), dtype=np.int64, count=len(strings))


def _send(block_id: int, rows: pa.Table, window: int, minimiser: int, buckets: int) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = {}
    keys, times = [], []
    for _, _, _, _, _, key, strings in _of_block(rows, window, minimiser):
        had = len(seen)
        number = _numbered(strings, seen)
        new, at = np.unique(number, return_index=True)
        keys.append(key[at[new >= had]])
        times.append(number)
    if not seen:
        return
    # new numbers of a chunk count up in order of first sight, so keys stand in order of number
    order, used, borders = deal(np.concatenate(keys), buckets)
    many = np.minimum(np.bincount(np.concatenate(times), minlength=len(seen)), 2).astype(np.uint8)
    strings = list(seen)
    out: dict[str, list] = {"bucket": [], "block_id": [], "strings": [], "many": []}
    for k, bucket in enumerate(used.tolist()):
        mine = order[borders[k] : borders[k + 1]]
        out["bucket"].append(bucket)
        out["block_id"].append(block_id)
        out["strings"].append(zip_bytes(b"\n".join([strings[i] for i in mine.tolist()])))
        out["many"].append(many[mine].tobytes())
    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("block_id", pa.int64()), ("strings", pa.binary()), ("many", pa.binary())]))


def count_windows(strings: list[bytes], times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, first): whether each window of each string occurs at two places; first[i]:first[i + 1] are string i's windows."""
    sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    prints, number = [[], []], [np.zeros(0, dtype=np.int64)]
    for a, b in K.chunks(offsets):
        w = K.words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
        start = K.window_starts(w.first, window)
        number.append(a + w.text_of_word()[start])
        for which in (0, 1):
            prints[which].append(K.window_fingerprints(w.fingerprints(which), window, which)[start[: max(0, len(start) - window + 1)]])
    string = np.concatenate(number)
    one, two = np.concatenate(prints[0] or [np.zeros(0, np.uint64)]), np.concatenate(prints[1] or [np.zeros(0, np.uint64)])
    order = np.argsort(one, kind="stable")
    same = one[order][1:] == one[order][:-1]
    if (same & (two[order][1:] != two[order][:-1])).any():  # two different windows share 64 bits: sort by all 128
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    repeated = np.zeros(len(one), dtype=bool)
    repeated[order[1:][same]] = True
    repeated[order[:-1][same]] = True
    repeated |= times[string] > 1
    return repeated, np.concatenate(([0], np.cumsum(np.bincount(string, minlength=len(strings)))))


def _judge(window: int):
    def run(rows: pa.Table) -> pa.Table:
        blobs = [unzip_bytes(x.as_py()).split(b"\n") for x in rows.column("strings")]
        times = np.frombuffer(b"".join(x.as_py() for x in rows.column("many")), dtype=np.uint8)
        repeated, first = count_windows([s for x in blobs for s in x], times, window)
        bits, at = [], 0
        for x in blobs:
            bits.append(zip_bytes(np.packbits(repeated[first[at] : first[at + len(x)]])))
            at += len(x)
        return pa.table({"block_id": rows.column("block_id"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def _remove(block_id: int, rows: pa.Table, answers: pa.Table, window: int, minimiser: int, buckets: int) -> pa.Table:
    verdict = {b: x for b, x in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist())}
    parts = list(_of_block(rows, window, minimiser))
    seen: dict[bytes, int] = {}
    numbers = [_numbered(x[6], seen) for x in parts]
    n_windows = np.zeros(len(seen), dtype=np.int64)
    key_of = np.zeros(len(seen), dtype=np.uint64)
    for x, number in zip(parts, numbers):
        n_windows[number], key_of[number] = x[4], x[5]
    order, used, borders = deal(key_of, buckets)
    begin = np.zeros(len(seen), dtype=np.int64)
    flags, total = [], 0
    for k, bucket in enumerate(used.tolist()):
        mine = order[borders[k] : borders[k + 1]]
        n = n_windows[mine]
        begin[mine] = total + np.concatenate(([0], np.cumsum(n)[:-1]))
        flags.append(np.unpackbits(np.frombuffer(unzip_bytes(verdict[bucket]), dtype=np.uint8), count=int(n.sum())))
        total += int(n.sum())
    flag = np.concatenate(flags) if flags else np.zeros(0, dtype=np.uint8)
    n_words, n_removed, kept = [], [], []
    for (a, b, w, first, n, _, _), number in zip(parts, numbers):
        count = int(w.first[-1])
        depth = np.zeros(count + 1, dtype=np.int64)
        if len(first):
            hit = K.ragged(first, n)[flag[K.ragged(begin[number], n)].astype(bool)]
            np.add.at(depth, hit, 1)
            np.add.at(depth, hit + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        packed, begin_at, end_at = w.packed()
        packed = packed.tobytes()
        removed = np.concatenate(([0], np.cumsum(gone)))
        n_words.append(w.counts())
        n_removed.append(removed[w.first[1:]] - removed[w.first[:-1]])
        for i in range(b - a):
            f, t = int(w.first[i]), int(w.first[i + 1])
            if f == t or n_removed[-1][i] == t - f:
                kept.append(b"")
            elif not n_removed[-1][i]:
                kept.append(packed[begin_at[f] : end_at[t - 1]])
            else:
                keep = ~gone[f:t]
                runs = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).astype(np.int8))) + f
                kept.append(b" ".join([packed[begin_at[x] : end_at[y - 1]] for x, y in zip(runs[0::2].tolist(), runs[1::2].tolist())]))
    return pa.table({
        "doc_id": rows.column("doc_id"),
        "n_words": pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
        "n_removed": pa.array(np.concatenate(n_removed) if n_removed else [], pa.int64()),
        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, minimiser: int = 5) -> DataFrame:
    """Remove every word covered by a window of `window` words that also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space) for each row.
    """
    if not 1 <= minimiser <= window:
        raise ValueError("minimiser must be from 1 to window")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = blocks(rows, label="substrings")
    buckets = bucket_count(packed)
    sent = over(packed, lambda i, t: _send(i, t, window, minimiser, buckets), "bucket int, block_id long, strings binary, many binary")
    bits = sent.groupBy("bucket").applyInArrow(_judge(window), "block_id long, bucket int, bits binary")
    return with_answers(packed, bits, lambda i, t, x: _remove(i, t, x, window, minimiser, buckets), OUT)
