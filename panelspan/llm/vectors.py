"""Near-duplicate vectors by Euclidean p-stable hashing (Datar et al. 2004), confirmed by exact cosines.

A table hashes a unit vector by ``PROJECTIONS`` Gaussian projections, shifted and cut into cells of width ``WIDTH``; vectors
that share all cells of a table share a bucket. With the defaults a pair at cosine 0.93 meets in at least one of the 32
tables with probability 0.998, at 0.95 with 0.9999. Every pair in a bucket is checked by its exact cosine; a link is
counted in the first table that holds it, which the two signatures show without any exchange. Equal vectors are one row
with a weight. A bucket beyond ``CHUNK`` rows is dealt into chunks, and pairs of chunks are checked in separate groups, so
no group grows with the bucket and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, components, map_batches, written

TABLES, PROJECTIONS, WIDTH = 32, 16, 3.0
CHUNK = 1024


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)        # first to a safe range: squares of large numbers overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def signatures(rows: DataFrame, dim: int, seed: int, tables: int, projections: int, width: float) -> DataFrame:
    """``rows`` (id, label, weight, embedding) with ``sig``: the bucket in each table as an int."""
    rng = np.random.default_rng(seed)
    planes, shifts = rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)
    mixers = rng.integers(1, 2 ** 31, projections, dtype=np.int64) | 1

    def run(batch):
        cells = np.floor((unit(matrix(batch.column(3))) @ planes + shifts) / width).astype(np.int64)
        sig = (cells.reshape(-1, tables, projections) * mixers).sum(2)
        sig = (sig ^ (sig >> 31)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, tables, dtype=np.int32)), pa.array(sig.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "sig"])

    types = dict(rows.dtypes)
    return map_batches(rows, run, ", ".join(f"{c} {types[c]}" for c in rows.columns) + ", sig array<int>")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH,
                    chunk: int = CHUNK, seed: int = 7, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept (the id is its component's smallest).

    Only vectors of equal, not null label and equal length are compared. Null or zero vectors and those with null or
    non-finite components link with nothing, and neither do rows with a null id (whose component is null and kept false).
    Rows that repeat an id are vectors of their own for n_links and one id for the component. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_column).alias("_id"), F.col(label_column).alias("_label"), F.col(vector_column).alias("_v"))
    valid = rows.where(usable(F.col("_v")) & F.col("_label").isNotNull() & F.col("_id").isNotNull())
    same = written(valid.groupBy("_label", "_v").agg(F.min(F.col("_id").cast("long")).alias("rep"), F.count(F.lit(1)).alias("weight")))
    # A representative stands for one distinct vector: ids that repeat with other vectors get a number of their own.
    reps = same.select("rep", F.struct("_label", F.size("_v").alias("n")).alias("g"), "weight", "_v")
    sized = [r.n for r in reps.select("g.n").distinct().collect()]
    found = None
    for dim in sized:           # as many passes as there are lengths of vectors, usually one
        part = reps.where(F.col("g.n") == dim).select("rep", F.col("g._label").cast("string").alias("label"), "weight", "_v")
        part = written(signatures(part, dim, seed, tables, projections, width))
        one = _links(part, threshold, tables, chunk)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select(F.col("_id").alias(id_column), F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"), F.col("_id").isNotNull().alias("kept"))
    found = written(found)
    ids = valid.select("_id", "_label", "_v").join(same, ["_label", "_v"]).select(F.col("_id").cast("long").alias("a"), F.col("rep").alias("b"), "weight")
    member = written(ids)
    other = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).unionByName(member.select("a", "b")))
    counts = found.groupBy("rep", "label", "_v").agg(F.sum("links").alias("links"))
    linked = valid.join(same, ["_label", "_v"]).withColumn("label", F.col("_label").cast("string")).join(counts, ["rep", "label", "_v"], "left")
    linked = linked.select("_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rest = rows.where(~(usable(F.col("_v")) & F.col("_label").isNotNull() & F.col("_id").isNotNull())).select("_id", F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(rest).withColumn("id", F.col("_id").cast("long")).join(other, "id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("_id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _links(part: DataFrame, threshold: float, tables: int, chunk: int) -> DataFrame:
    """Partial link counts and a root for each vector that has links in a bucket."""
    keyed = part.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tables - 1)))).withColumn("bucket", F.col("sig")[F.col("t")])
    sizes = written(keyed.groupBy("label", "t", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    several = keyed.join(sizes, ["label", "t", "bucket"])
    parts = F.ceil(F.col("n") / chunk).cast("int")
    several = several.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep", "_v"), "parts").cast("int"))
    several = several.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["label", "t", "bucket", "ca", "cb"]
    dealt = several.select("label", "t", "bucket", F.least("own", "other").alias("ca"), F.greatest("own", "other").alias("cb"), "own", "rep", "weight", "_v", "sig")
    ddl = f"rep long, label string, _v {dict(part.dtypes)['_v']}, root long, links long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            names = batch.column(0).to_pylist()
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)], 1)
            cuts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1] or (key[i] != key[i - 1]).any()], len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = (names[a], *key[a].tolist())
                if now != last and held:
                    out = _group(held, last[1], threshold, schema)
                    if out is not None:
                        yield out
                    held = []
                held, last = [*held, batch.slice(a, b - a)], now
        out = _group(held, last[1], threshold, schema) if held else None
        if out is not None:
            yield out

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def _group(held: list[pa.RecordBatch], t: int, threshold: float, schema: pa.Schema) -> pa.RecordBatch | None:
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    if rows.num_rows < 2:
        return None
    ca, cb, own = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
    u, sig = unit(matrix(rows.column(8))), matrix(rows.column(9)).astype(np.int64)
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    if ca[0] != cb[0]:
        near &= own[:, None] != own[None, :]
    if not near.any():
        return None
    weight = rows.column(7).to_numpy(zero_copy_only=False).astype(np.int64)
    links = np.zeros(len(u), np.int64)
    left, right = np.nonzero(np.triu(near))
    for at in range(0, len(left), 200_000):
        i, j = left[at:at + 200_000], right[at:at + 200_000]
        first = ~(sig[i, :t] == sig[j, :t]).any(1)
        links += np.bincount(i[first], weight[j[first]], len(u)).astype(np.int64) + np.bincount(j[first], weight[i[first]], len(u)).astype(np.int64)
    ids = rows.column(6).to_numpy(zero_copy_only=False)
    root, before = ids.copy(), None
    while before is None or (root != before).any():
        before = root
        root = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(1))
    at = pa.array(np.flatnonzero(near.any(1)))
    pick = at.to_numpy()
    return pa.RecordBatch.from_arrays([rows.column(6).take(at), rows.column(0).take(at), rows.column(8).take(at), pa.array(root[pick]), pa.array(links[pick])], schema=schema)
