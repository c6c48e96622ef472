"""Best-fit packing of token pieces into sequences, under several capacities at once.

A sequence has residual capacities: tokens, pieces (documents), and attention cost (the sum of
squared piece lengths). Pieces, longest first, each go to an open sequence that has room in every
dimension; among those the weighted rule decides: `norm` takes the least weighted norm of what would
stay free, `dot` the largest weighted dot product of the piece with what is free. If none has room, a
new sequence is opened.

Texts are tokenised word by word through a vocabulary's word cache, end in one id 0, and are cut only
if longer than a sequence. Pieces are dealt evenly, by their row number, to groups of about
`group_pieces`, and each group is packed alone, so memory is bounded and no group grows with the input;
a group of thousands of pieces wastes less than one sequence.

Defined cases: a null or empty text is the one id 0; repeated rows are packed as often as they stand
there; equal lengths keep the order of their rows; a null doc_id is kept as it is; an empty table gives an empty
result; other columns are not read. Texts are read whole; one text's memory is that of its ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessaline.llm import textkernel as K
from tessaline.session import ship, shuffle_width, written, written_by_key

PIECES = "uid long, doc_id long, piece int, start long, length long, ids binary"


def best_fit(sizes: np.ndarray, capacity: tuple[float, ...], weights: tuple[float, ...], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, order): the bin of each item and the order in which items were placed. sizes: one row an item, one column a dimension."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    cap, weight = np.asarray(capacity, dtype=np.float64), np.asarray(weights, dtype=np.float64)
    if (sizes > cap).any():
        raise ValueError("an item is larger than an empty sequence")
    order = np.argsort(-sizes[:, 0], kind="stable")
    chosen = np.zeros(len(sizes), dtype=np.int64)
    free = np.zeros((len(sizes), len(cap)))
    name = np.zeros(len(sizes), dtype=np.int64)
    open_, bins = 0, 0
    least = sizes.min(axis=0) if len(sizes) else cap
    for i in order.tolist():
        item = sizes[i]
        at = -1
        if open_:
            room = free[:open_]
            fits = np.flatnonzero((room >= item).all(axis=1))
            if len(fits):
                if rule == "norm":
                    at = fits[np.argmin((((room[fits] - item) / cap) ** 2) @ weight)]
                else:
                    at = fits[np.argmax(((room[fits] / cap) * (item / cap)) @ weight)]
        if at < 0:
            at, open_, bins = open_, open_ + 1, bins + 1
            free[at], name[at] = cap, bins - 1
        free[at] -= item
        chosen[i] = name[at]
        if (free[at] < least).any():  # nothing fits any more: the last open one takes its place
            open_ -= 1
            free[at], name[at] = free[open_], name[open_]
    return chosen, order


#: Classes of bytes whose borders always part tokens of the word vocabulary: letters, digits, punctuation. 0: may go either way.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27]] = 3


def lower_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of ASCII and Latin-1, and cut between letters, digits and punctuation.

    The vocabulary lower-cases text itself and never joins these classes in one token, so ids are the
    same, but far fewer different words are left to encode. An apostrophe may belong to letters after
    it; a special token is written with <| and keeps its case: both are left alone.
    """
    kind = _CLASS[data]
    second = np.zeros(len(data), dtype=bool)
    second[1:] = data[:-1] == 0xC3
    second &= (data >= 0x80) & (data <= 0xBF) & (data != 0x97) & (data != 0xB7)
    kind[second] = 1
    kind[:-1][second[1:]] = 1
    cut = np.zeros(len(data), dtype=bool)
    cut[1:] = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    if ((data[:-1] == 0x3C) & (data[1:] == 0x7C)).any():
        return data, np.zeros(len(data), dtype=bool)
    upper = second & (data < 0x9F)
    folded = K.LOWER[data]
    folded[upper] += 0x20
    return folded, cut


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Token pieces of each row (see PIECES; ids: unsigned little-endian 32-bit). One pass, nothing is shuffled."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from tessaline.llm.tokens import cache

        words, uid = cache(vocabulary), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, w in K.of_array(batch.column("text"), refine=lower_parts if vocabulary.endswith("word_bpe_49k.json") else None):
                ids, sizes = words.of(w)
                ends = np.concatenate(([0], np.cumsum(sizes)))[w.first]
                length = np.diff(ends) + 1
                begin = np.concatenate(([0], np.cumsum(length)))
                flat = np.full(int(begin[-1]), end_id, dtype="<u4")
                mine = np.ones(len(flat), dtype=bool)
                mine[begin[1:] - 1] = False
                flat[mine] = ids
                n = -(-length // max_tokens)
                doc = np.repeat(np.arange(b - a), n)
                piece = K.ragged(np.zeros(b - a, dtype=np.int64), n)
                start = piece * max_tokens
                size = np.minimum(length[doc] - start, max_tokens)
                offsets = np.append(begin[doc] + start, begin[-1]) * 4
                yield pa.RecordBatch.from_pydict({
                    "uid": pa.array(uid + np.arange(len(doc)), pa.int64()),
                    "doc_id": batch.column("doc_id").slice(a, b - a).take(pa.array(doc)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids": K.binary_array(flat.tobytes(), offsets),
                })
                uid += len(doc)
        words.clear()
        K.release()

    return rows.mapInArrow(run, PIECES)


def pack(items: DataFrame, max_tokens: int = 2048, max_pieces: int | None = None, max_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group_pieces: int = 4096) -> DataFrame:
    """Add sequence_id and offset to rows with a unique long `uid` and a `length`; other columns are kept.

    By default the counts of pieces and attention cost allow whatever the tokens allow. An item that does not fit into an
    empty sequence is an error, so max_attention must be the square of the longest item's length at least.
    """
    ship(items.sparkSession)
    capacity = (max_tokens, max_pieces or max_tokens, max_attention or max_tokens * max_tokens)
    if min(capacity) < 1 or max_tokens**2 > capacity[2] and max_attention is None:
        raise ValueError("capacities must be positive")
    groups = max(1, -(-items.count() // group_pieces))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        rows = rows.take(pa.array(np.argsort(rows.column("uid").to_numpy(), kind="stable")))
        size = rows.column("length").to_numpy().astype(np.float64)
        bins, order = best_fit(np.stack([size, np.ones(len(size)), size * size], axis=1), capacity, weights, rule)
        by_bin = order[np.argsort(bins[order], kind="stable")]
        total = np.concatenate(([0], np.cumsum(size[by_bin])[:-1])).astype(np.int64)
        new = np.concatenate(([True], bins[by_bin][1:] != bins[by_bin][:-1]))
        offset = np.zeros(len(size), dtype=np.int64)
        offset[by_bin] = total - np.maximum.accumulate(np.where(new, total, 0))
        group = int(rows.column("group")[0].as_py())
        rows = rows.drop_columns(["group"])
        return rows.append_column("sequence_id", pa.array((group << 32) + bins, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = items.withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)).cast("int"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    return dealt.groupBy("group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json", max_tokens: int = 2048, keep_ids: bool = False, **rules) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece, and its ids if `keep_ids`.

    The ids lie in buckets of the piece's number, and places come to them: ids are written once and never shuffled.
    """
    cut = pieces(docs, id_col, text_col, vocabulary, max_tokens)
    narrow = ("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    if not keep_ids:
        return pack(written(cut.select(*narrow), "pieces"), max_tokens, **rules).drop("uid")
    cut = written_by_key(cut, "pieces", "uid", shuffle_width(docs.sparkSession))
    packed = pack(cut.select(*narrow), max_tokens, **rules)
    return cut.select("uid", "ids").join(packed.hint("shuffle_hash"), "uid").select(*packed.drop("uid").columns, "ids")
