"""Helpers of the text operators: written intermediates, tokens, table access, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BATCH = 2000       # rows of one Arrow batch: whole texts travel in them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of written intermediates: ``spark.checkpoint.dir`` of the session, one of our own only in local mode without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="panelspan-llm-"))
    return _LOCAL[0]


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ROWS_PER_BATCH:
        spark.conf.set(key, ROWS_PER_BATCH)


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files: lineage ends, and its size is known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.llm_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a written intermediate that nothing reads any more."""
    _remove(df.sparkSession, df.llm_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:       # the session is over, its folder goes with the cluster's own cleaning
        return


def lower_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8 bytes (a missing text has none)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of a value written as text, modulo ``n``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def crc32_of(value) -> int:
    return zlib.crc32(b"" if value is None else str(value).encode())


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of a column, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def one_row(rows: Iterable[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=schema)


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``most`` bytes in a text column each; a longer text is a part of its own."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, upto - at)
        at = upto


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(T._parse_datatype_string(ddl))


def map_batches(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``mapInArrow`` with a function from one batch to an iterable of batches or None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out
    return df.mapInArrow(run, ddl)


# --- connected components -------------------------------------------------------------------------------

def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Smallest id reachable over undirected edges (a, b): rows (id, component) of every id in an edge.

    Alternates the large-star and small-star steps (Kiveris et al. 2014): each round is two grouped aggregates whose
    results are again edges, so no neighbourhood is ever gathered and no edge list grows. Ends when the edges repeat.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    before = None
    for _ in range(rounds):
        both = now.select("a", "b").unionByName(now.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b"))
        least_small = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least_small, "a").select(F.explode(F.array(F.struct(a.alias("a"), F.col("m").alias("b")),
                                                                      F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        fresh = written(small.where(a != b).distinct())
        # The checksum of an edge set is an exact long sum of 64-bit hashes; equal sets mean that a fixed point is reached.
        mark = tuple(fresh.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(now)
        now = fresh
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(b.alias("id"), b.alias("component")).distinct()
    return now.select(a.alias("id"), b.alias("component")).unionByName(roots)


def ragged(parts: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated parts and their offsets."""
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.empty(0, dtype)
    return flat.astype(dtype, copy=False), np.concatenate([[0], np.cumsum(sizes)])
