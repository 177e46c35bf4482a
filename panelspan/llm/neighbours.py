"""Nearest neighbours by adaptive dimension scan (Gao and Long 2023) over inverted lists.

Unit vectors are turned by a random rotation and stored per list in chunks, each chunk as blocks of columns. A query scans
the chunks of its nearest lists block by block; after each block a hypothesis test on the partial distance abandons the
candidates that are very unlikely to come among the best. Survivors get their exact cosine from the original vectors.

The centroids are fitted on at most ``sample`` vectors, in the order of a hash of the id; all vectors are indexed. The
number of probed lists is the smallest that reaches ``target`` recall on that sample against brute force. Queries and
vectors meet in a join on the list of packed blocks of bounded size, so a crowded list is many rows. A first round over
each query's nearest list gives the distance that the second round prunes with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, map_batches, written
from .vectors import matrix, unit, usable

SAMPLE, MOST_LISTS = 20_000, 1024
CHUNK, QUERY_BLOCK, COLUMNS = 1024, 256, 16
EPSILON = 2.1       # of the hypothesis test: share of true neighbours abandoned is about exp(-c * EPSILON ** 2)


def fit_lists(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of the unit vectors ``x`` by k-means; empty lists keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c, 1)[:, 0]
        sums, n = np.zeros_like(c), np.bincount(own, minlength=lists)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k nearest centroids of each row, nearest first."""
    d = (c * c).sum(1) - 2 * x @ c.T
    return np.argsort(d, 1, kind="stable")[:, :k]


def probes_for(x: np.ndarray, c: np.ndarray, k: int, target: float, queries: int = 300) -> int:
    """Least number of lists that finds ``target`` of the true k nearest of the sample's first rows in the sample."""
    own, q = nearest(x, c, 1)[:, 0], x[:queries]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -9
    best = np.argsort(-near, 1)[:, :k]
    order = np.argsort(nearest(q, c, len(c)), 1)          # rank of each list for each query
    ranks = np.sort(np.take_along_axis(order, own[best], 1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else 1


def search(vectors: DataFrame, is_query: Column, k: int = 5, target: float = 0.98, sample: int = SAMPLE, chunk: int = CHUNK, query_block: int = QUERY_BLOCK,
           seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest found for each row where ``is_query`` holds: query_id, rank (from 1), vec_id, score (cosine in double).

    Ties go to the smaller id. A row is no candidate of a query with its own id. Rows with a null id, null or zero vectors,
    null or non-finite components, or another length than most usable vectors have (of equally frequent ones the longer)
    take no part. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), is_query.alias("q"))
    rows = rows.where(usable(F.col("v")) & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("queries"))
    most = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    ddl = "query_id long, vec_id long, score double"
    if most is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n_queries = most.dim, int(most.queries or 0)
    rows = rows.where(F.size("v") == dim)
    drawn = unit(np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], float))
    lists = max(1, min(MOST_LISTS, round(most.n ** 0.5), len(drawn) // 4))
    centroids = fit_lists(drawn, lists)
    probed = probes_for(drawn, centroids, k, target)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0]

    index = written(_index(rows, centroids, turn, chunk))
    blocks = max(1, -(-n_queries * probed // (lists * query_block)))
    asked = written(_asked(rows.where("q"), centroids, probed))
    schema = arrow_schema(ddl)

    def scan(batch):
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(batch.num_rows):
            ids = np.array(batch.column(0)[i].values)
            turned = np.frombuffer(batch.column(2)[i].as_py()).reshape(dim, len(ids))
            plain = matrix(batch.column(1)[i].values)
            for one in batch.column(3)[i].values:
                q = np.array(one["v"].values, float)
                out.append(_scan(one["id"].as_py(), q, unit(q[None])[0] @ turn, one["far"].as_py(), ids, turned, plain, k))
        query, vec, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(vec), pa.array(score)], schema=schema)

    def scanned(asking: DataFrame) -> DataFrame:
        packed = asking.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v", "far")).alias("queries"))
        # Dealt by what a row holds, so that a task that runs again gets the same rows.
        met = packed.join(index, "list").repartition(F.xxhash64("list", "block", "ids")).select("ids", "plain", "turned", "queries")
        return met.mapInArrow(lambda batches: (scan(b.slice(i, 1)) for b in batches for i in range(b.num_rows)), ddl)

    first = written(scanned(asked.where("nth = 0").withColumn("far", F.lit(float("inf")))))
    far = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.sort_array(F.collect_list("score"), False)[k - 1]).alias("kth"))
    rest = asked.where("nth > 0").join(far, asked["id"] == far["query_id"], "left")
    rest = rest.withColumn("far", F.coalesce(2 - 2 * F.col("kth"), F.lit(float("inf")))).select("list", "id", "v", "far")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = first.unionByName(scanned(rest)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _index(rows: DataFrame, centroids: np.ndarray, turn: np.ndarray, chunk: int) -> DataFrame:
    """Rows (list, ids, plain vectors, turned): chunks of one list, the turned vectors by column."""
    kind = dict(rows.dtypes)["v"]

    def assign(batch):
        own = nearest(unit(matrix(batch.column(1))), centroids, 1)[:, 0].astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own)], names=["id", "v", "list"])

    listed = written(map_batches(rows.select("id", "v"), assign, f"id long, v {kind}, list int"))
    sizes = listed.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    chunks = listed.join(sizes, "list").groupBy("list", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / chunk)).alias("chunk"))
    packed = chunks.agg(F.collect_list(F.struct("id", "v")).alias("m")).select("list", F.col("m.id").alias("ids"), F.col("m.v").alias("plain"))

    def block(batch):
        turned = [np.ascontiguousarray((unit(matrix(x.values)) @ turn).T).tobytes() for x in batch.column(2)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(turned, pa.binary())], names=["list", "ids", "plain", "turned"])

    ddl = f"list int, ids array<long>, plain array<{kind}>, turned binary"
    return packed.mapInArrow(lambda batches: (block(b.slice(i, 1)) for b in batches for i in range(b.num_rows)), ddl)


def _asked(queries: DataFrame, centroids: np.ndarray, probed: int) -> DataFrame:
    kind = dict(queries.dtypes)["v"]

    def run(batch):
        near = nearest(unit(matrix(batch.column(1))), centroids, probed)
        owner = np.repeat(np.arange(len(near)), near.shape[1])
        nth = np.tile(np.arange(near.shape[1], dtype=np.int32), len(near))
        at = pa.array(owner)
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32)), pa.array(nth)], names=["id", "v", "list", "nth"])

    return map_batches(queries.select("id", "v"), run, f"id long, v {kind}, list int, nth int")


def _scan(query: int, q: np.ndarray, turned_q: np.ndarray, far: float, ids: np.ndarray, turned: np.ndarray, plain: np.ndarray, k: int):
    """Best k of one chunk for one query; ``far`` is the squared distance that a candidate should not exceed."""
    dim = len(turned_q)
    alive = np.flatnonzero(ids != query)
    if far == np.inf and len(alive) > 4 * k:        # a threshold from the first candidates
        some = alive[:4 * k]
        far = np.partition(((turned[:, some] - turned_q[:, None]) ** 2).sum(0), k - 1)[k - 1]
    part = np.zeros(len(alive))
    for at in range(0, dim, COLUMNS):
        upto = min(dim, at + COLUMNS)
        part += ((turned[at:upto, alive] - turned_q[at:upto, None]) ** 2).sum(0)
        if upto < dim:
            fine = part * dim / upto <= far * (1 + EPSILON / upto ** 0.5) ** 2
        else:
            fine = part <= far * (1 + 1e-9) + 1e-12
        alive, part = alive[fine], part[fine]
    full = plain[alive]
    score = (full * q).sum(1) / (np.sqrt((full * full).sum(1)) * np.sqrt((q * q).sum()))
    best = np.lexsort((ids[alive], -score))[:k]
    return np.full(len(best), query), ids[alive][best], score[best]
