"""Packing of tokenised documents by sums of squares (Csirik et al. 2006).

The pieces of all documents are tokenised once and written. Full pieces are sequences of their own. The others are packed
by their lengths alone, in pools of about ``POOL`` pieces dealt by hash, so a pool is as large in a table of many small
partitions as in one of few large ones, and no task holds more than a pool. Longest first, a piece goes where the sum over
all gaps of the squared number of open windows with that gap becomes smallest: into an open window or a new one. Once the
open windows have room for all that is left of the pool, a new one is opened only for a piece that fits in none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, slices, small_batches, written
from .tokens import byte_tokens

WINDOW, POOL = 1024, 50_000
CALL_BYTES = 12_000_000     # of texts that are tokenised together: their common words are looked up once


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Window number and offset of pieces shorter than a window, given longest first, and the number of windows.

    With N(g) open windows of gap g, a piece of length s that goes into gap g changes the sum of squares by
    2 (N(g - s) - N(g)) + 2; full windows and new ones (g = window) are not counted, so there one of the terms is missing.
    Ties go to the smallest gap, and to the window of it that was last open.
    """
    count = np.zeros(window + 1)
    twice = np.full(window + 1, -np.inf)    # 2 N(g) where a window of that gap is open
    open_windows: list[list[int]] = [[] for _ in range(window + 1)]
    numbers, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used, room, left = 0, 0, int(lengths.sum())
    for i, s in enumerate(lengths.tolist()):
        change = 2 * count[:window + 1 - s] - twice[s:] + 2     # of gaps s to window
        change[0] -= 1                      # the piece fills the window: only N(g) changes
        change[-1] = 2 * count[window - s] + 1
        gap = int(change.argmin()) + s
        if gap == window and room >= left and len(change) > 1:
            other = int(change[:-1].argmin())
            if change[other] < np.inf:
                gap = other + s
        if gap == window:
            number, used, room = used, used + 1, room + window
        else:
            number = open_windows[gap].pop()
            count[gap] -= 1
            twice[gap] = 2 * count[gap] if count[gap] else -np.inf
        numbers[i], offsets[i] = number, window - gap
        rest = gap - s
        if rest:
            open_windows[rest].append(number)
            count[rest] += 1
            twice[rest] = 2 * count[rest]
        room, left = room - s, left - s
    return numbers, offsets, used


def pieces_of(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_column: str, text_column: str) -> DataFrame:
    """Pieces with a number ``uid`` of their own: id, piece, start, length, ids, ids_crc32."""
    import zlib
    ddl = f"uid long, {id_column} {dict(docs.dtypes)[id_column]}, piece int, start long, length long, ids binary, ids_crc32 long"
    schema = arrow_schema(ddl)

    def cut(part: pa.RecordBatch, first: int) -> pa.RecordBatch:
        flat, bounds = byte_tokens(tokenizer).ids(pc.fill_null(part.column(1), ""))
        n = np.diff(bounds) + 1
        head = np.where(n > window, (n - 1) % window + 1, n)    # the first piece may be shorter, the others are full
        pieces = (n - head) // window + 1
        owner = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.where(piece > 0, head[owner] + (piece - 1) * window, 0)
        length = np.where(piece > 0, window, head[owner])
        flat = np.insert(flat, bounds[1:], np.uint32(end_id)).astype("<u4", copy=False)
        at = (bounds[:-1] + np.arange(len(n)))[owner] + start
        data = [flat[a:a + k].tobytes() for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        crc = np.fromiter(map(zlib.crc32, data), np.int64, len(data))
        columns = [pa.array(first + np.arange(len(owner))), part.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)),
                   pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(data, pa.binary()), pa.array(crc)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, size = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            for part in slices(batch, 1, CALL_BYTES):
                held.append(part)
                size += part.nbytes
                if size >= CALL_BYTES:
                    out = cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0], first)
                    first, held, size = first + out.num_rows, [], 0
                    yield out
        if held:
            yield cut(pa.Table.from_batches(held).combine_chunks().to_batches()[0], first)

    return docs.select(id_column, text_column).mapInArrow(run, ddl)


def placed(rests: DataFrame, window: int) -> DataFrame:
    """(uid, sequence_id, offset) of rows (pool, uid, length), each pool packed by itself."""
    ddl = "uid long, sequence_id long, offset long"
    schema = arrow_schema(ddl)

    def packed(pool: int, held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        numbers, offsets, _ = place(rows[:, 2], window)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 1]), pa.array(((pool << 32) + numbers) * 2 + 1), pa.array(offsets)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0])) + 1):
                if held and len(part) and held[0][0, 0] != part[0, 0]:
                    yield packed(int(held[0][0, 0]), held)
                    held = []
                if len(part):
                    held.append(part)
        if held:
            yield packed(int(held[0][0, 0]), held)

    return rests.repartition("pool").sortWithinPartitions("pool", F.desc("length"), "uid").mapInArrow(run, ddl)


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 2, pool: int = POOL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    One row per piece: id, piece (from 0), start (ids of its document before it), length, ids (little-endian unsigned
    32-bit), ids_crc32, sequence_id, offset (gapless from 0). Only documents of more than ``window`` ids (with the end id)
    are cut, and only their first piece may be shorter than a window. A null or empty text has only the end id. Rows with
    the same or a null id are separate documents. Ties of length go by the order of the written pieces. Other columns are
    not read. An empty table gives no rows.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    small_batches(docs.sparkSession)
    pieces = written(pieces_of(docs, tokenizer, window, end_id, id_column, text_column))
    rests = pieces.where(F.col("length") < window)
    pools = max(1, -(-rests.count() // pool))
    where = written(placed(rests.select(F.pmod(F.xxhash64("uid"), F.lit(pools)).alias("pool"), "uid", "length"), window))
    columns = [id_column, "piece", "start", "length", "ids", "ids_crc32"]
    full = pieces.where(F.col("length") == window).select(*columns, (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rests.join(where, "uid").select(*columns, "sequence_id", "offset").unionByName(full)
