"""Compressed blocks of rows, and exchanges of packed keys between blocks and buckets.

Several operators look at every word of every text, but need an answer about it that depends on all
other texts. They share one shape:

1. `blocks`: the rows needed are packed in compressed blocks of a few MB of text and written once
   to the shared folder, in hash buckets of the block's id.
2. A pass over the blocks sends fixed-width keys to buckets, all keys of one block and bucket as one
   compressed row.
3. Each bucket answers every key in the order it came, a few bits each.
4. The answers meet their blocks again. The blocks are already laid out by id, so only the answers
   are shuffled; texts travel once at most.

Blocks hold about the same amount of text each, and keys are dealt by their hash, so no stage
depends on how often a text, source or passage repeats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame

from tessaline.llm import textkernel as K
from tessaline.session import ship, shuffle_width, written_by_key

BLOCK_BYTES = 8 << 20
#: block_id * BLOCK_ROWS + place in the block is an id of a row: unique, a long, fixed once the blocks are written.
BLOCK_ROWS = 1 << 16
SCHEMA = "block_id long, n_rows long, payload binary"


def squeeze(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def unsqueeze(payload: bytes | pa.Buffer) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def zip_bytes(data: bytes | np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(data).tobytes() if isinstance(data, np.ndarray) else data)


def unzip_bytes(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def blocks(rows: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES, label: str = "blocks") -> DataFrame:
    """Pack `rows` into written blocks of about `block_bytes` of their column `text` each."""
    spark = rows.sparkSession
    ship(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, n = TaskContext.get().partitionId() << 20, 0
        held: list[pa.RecordBatch] = []
        size = held_rows = 0

        def out() -> pa.RecordBatch:
            nonlocal n, size, held_rows
            t = pa.Table.from_batches(held).combine_chunks()
            row = pa.RecordBatch.from_pydict({"block_id": [base + n], "n_rows": [t.num_rows], "payload": [squeeze(t)]})
            held.clear()
            n, size, held_rows = n + 1, 0, 0
            return row

        for batch in batches:
            lengths = np.diff(K.flat_bytes(batch.column(text))[1])
            at = 0
            total = np.cumsum(lengths)
            while at < batch.num_rows:
                done = int(total[at - 1]) if at else 0
                to = int(np.searchsorted(total, done + block_bytes - size, side="left")) + 1
                to = min(to, batch.num_rows, at + BLOCK_ROWS - held_rows)
                held.append(batch.slice(at, to - at))
                size += int(total[to - 1]) - done
                held_rows += to - at
                at = to
                if size >= block_bytes or held_rows >= BLOCK_ROWS:
                    yield out()
        if held:
            yield out()
        K.release()

    return written_by_key(rows.mapInArrow(pack, SCHEMA), label, "block_id", shuffle_width(spark))


def over(blocks: DataFrame, f: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply f(block_id, rows) to each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from f(batch.column(0)[i].as_py(), unsqueeze(batch.column(2)[i].as_buffer()))
        K.release()

    return blocks.mapInArrow(run, schema)


def with_answers(blocks: DataFrame, answers: DataFrame, f: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Apply f(block_id, rows, answers of the block) to each block; `answers` have a column block_id."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise AssertionError("answers without their block")
        out = f(left.column("block_id")[0].as_py(), unsqueeze(left.column("payload")[0].as_buffer()), right)
        K.release()
        return out

    return blocks.groupBy("block_id").cogroup(answers.groupBy("block_id")).applyInArrow(run, schema)


def bucket_count(blocks: DataFrame) -> int:
    """Buckets enough that each gets about as many keys as half a block holds, at any size of the input."""
    return max(64, 2 * blocks.count())


def deal(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, used, borders): places of the keys sorted by bucket, stably; the buckets that get any; where each one's begin."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    return order, used, np.append(at, len(order))
