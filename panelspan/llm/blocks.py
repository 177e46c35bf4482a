"""Look-ups of what texts hold against the whole corpus, without a row for every word or position.

Texts are packed into blocks of some megabytes. A block asks about its distinct keys, dealt by hash into buckets: one row
(bucket, block, payload) holds all keys of the block in the bucket. A bucket sees each key at most once per block, so a key
that is in a third of all texts costs no more than one entry per block; it answers every block in the order it was asked.
The answers meet the block again by its number. Payloads are compressed, and every group is bounded by the sizes chosen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, small_batches, strings, written

BLOCK_BYTES = 16_000_000


def squeeze(data: bytes | np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data if isinstance(data, bytes) else data.tobytes())


def loosen(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def blocks(docs: DataFrame, flag: Column, id_column: str = "doc_id", text_column: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Written rows (block, bucket = -1, ids, flags, ends, payload): the UTF-8 texts of a block in a row; null texts are empty."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_column]
    ddl = f"block long, bucket int, ids array<{kind}>, flags array<boolean>, ends array<long>, payload binary"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, flags, texts, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts])
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), pa.array([ids], schema.field(2).type), pa.array([flags]),
                                               pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([squeeze(b"".join(texts))], pa.binary())], schema=schema)

        for batch in batches:
            for i, f, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strings(batch.column(1)), strict=True):
                t = t.encode("utf-8", "surrogatepass")
                if held and held + len(t) > size:
                    yield out()
                    number, ids, flags, texts, held = number + 1, [], [], [], 0
                ids.append(i)
                flags.append(bool(f))
                texts.append(t)
                held += len(t)
        if ids:
            yield out()

    return written(docs.select(id_column, text_column, flag.alias("_f")).mapInArrow(run, ddl))


def n_buckets(packed: DataFrame) -> int:
    """Buckets for the blocks of ``packed``: each takes what about four blocks hold."""
    return max(8, -(-packed.count() // 4))


def ask(packed: DataFrame, fn: Callable[[list, np.ndarray, bytes, int], list[bytes]], count: int) -> DataFrame:
    """Rows (bucket, block, payload); ``fn`` gets ids, flags, ends and the bytes of a block and gives a payload per bucket."""
    schema = arrow_schema("bucket int, block long, payload binary")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                parts = fn(row["ids"], np.array(row["flags"], bool), np.array(row["ends"], np.int64), loosen(row["payload"]))
                for at in range(0, count, 64):
                    some = parts[at:at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(np.full(len(some), row["block"])),
                                                      pa.array(some, pa.binary())], schema=schema)

    return packed.select("block", "ids", "flags", "ends", "payload").mapInArrow(run, "bucket int, block long, payload binary")


def answer(asked: DataFrame, fn: Callable[[list[bytes]], tuple[list[bytes], bytes | None]]) -> DataFrame:
    """Written rows (block, bucket, payload): ``fn`` gets all payloads of a bucket and gives one for each, and a summary (block -1) or None."""
    schema = arrow_schema("block long, bucket int, payload binary")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        given, summary = fn(group["payload"].to_pylist())
        block, bucket = group["block"].to_pylist(), group["bucket"][0].as_py()
        if summary is not None:
            block, given = [*block, -1], [*given, summary]
        return pa.table([pa.array(block, pa.int64()), pa.array([bucket] * len(block), pa.int32()), pa.array(given, pa.binary())], schema=schema)

    return written(asked.groupBy("bucket").applyInArrow(run, "block long, bucket int, payload binary"))


def met(packed: DataFrame, answers: DataFrame, fn: Callable[[list, np.ndarray, np.ndarray, bytes, list[bytes]], Iterator[pa.RecordBatch]], ddl: str,
        number: str | None = None) -> DataFrame:
    """``fn`` gets a block and the answers of all buckets in their order; it gives batches of ``ddl``. A column named
    ``number`` is filled with the number of the block."""
    schema = arrow_schema(ddl)
    kinds = dict(packed.dtypes)
    both = packed.unionByName(answers.where("block >= 0").select("block", "bucket", F.lit(None).cast(kinds["ids"]).alias("ids"), F.lit(None).cast("array<boolean>").alias("flags"),
                                                                 F.lit(None).cast("array<long>").alias("ends"), "payload"))

    def run(group: pa.Table) -> pa.Table:
        rows = group.sort_by("bucket").to_pylist()
        if rows[0]["bucket"] >= 0:
            return schema.empty_table()
        own = rows[0]
        out = fn(own["ids"], np.array(own["flags"], bool), np.array(own["ends"], np.int64), loosen(own["payload"]), [r["payload"] for r in rows[1:]])
        table = pa.Table.from_batches(out, schema=schema)
        if number is not None:
            at = schema.get_field_index(number)
            table = table.set_column(at, schema.field(at), pa.array([own["block"]] * table.num_rows, schema.field(at).type))
        return table

    return both.groupBy("block").applyInArrow(run, ddl)
