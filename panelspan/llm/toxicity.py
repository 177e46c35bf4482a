"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (Wang and Manning 2012).

Presence of an n-gram in a labelled document is counted per class; the log ratio of the two smoothed shares scales the
feature, and a ridge logistic regression weighs the scaled features. Fitting takes at most ``fit_rows`` labelled
documents, chosen by a hash of the id, so what is broadcast and what reaches the driver is bounded; scoring runs over
every text without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import arrow_schema, map_batches, slices, small_batches, strings, written

FIT_ROWS = 20_000
ORDERS, BITS = (3, 4, 5), 18
LEAST_RATIO, LEAST_DOCS = 0.7, 4


def labelled_sample(labels: DataFrame, label: str, keep: Column, fit_rows: int, id_column: str = "doc_id") -> DataFrame:
    """At most ``fit_rows`` ids with their label (the larger one if an id has several), in the order of a hash."""
    rows = labels.where(keep & F.col(id_column).isNotNull() & F.col(label).isNotNull())
    one = rows.groupBy(id_column).agg(F.max(F.col(label).cast("double")).alias("_y"))
    return one.orderBy(F.xxhash64(id_column), id_column).limit(fit_rows)


def fit(docs: DataFrame, sample: DataFrame, id_column: str = "doc_id", text_column: str = "text", orders=ORDERS, bits=BITS,
        passes: int = 150, ridge: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weight of each n-gram bucket, and the bias. Without both classes in the sample: no weights, bias of the rate."""
    small_batches(docs.sparkSession)
    rows = docs.select(id_column, text_column).join(F.broadcast(sample.select(id_column, "_y")), id_column).select("_y", text_column)
    schema = arrow_schema("y double, found binary")

    def features(batch):
        lists = [x for part in slices(batch, 1, 500_000) for x in grams.distinct(strings(part.column(1)), orders, bits)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array([x.tobytes() for x in lists], pa.binary())], schema=schema)

    kept = written(map_batches(rows, features, "y double, found binary"))
    counted = arrow_schema("bucket long, pos long, neg long")

    def counts(batches):
        seen, n = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for y, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(y > 0), np.frombuffer(found, np.int32)] += 1
                n[int(y > 0)] += 1
        at = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen[1, at], n[1])), pa.array(np.append(seen[0, at], n[0]))],
                                         schema=counted)

    table = kept.mapInArrow(counts, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos"), F.sum("neg"))
    got = np.array([tuple(r) for r in table.collect()], np.int64).reshape(-1, 3)       # at most 2 ** bits + 1 rows
    size = got[got[:, 0] < 0][:, 1:].sum(0)
    weights = np.zeros(1 << bits, np.float32)
    if not size.all():
        return weights, 8.0 * np.sign(size[0] - size[1]) if size.any() else 0.0
    got = got[got[:, 0] >= 0]
    ratio = np.zeros(1 << bits)
    ratio[got[:, 0]] = np.log((got[:, 1] + 0.5) / (size[0] + 1)) - np.log((got[:, 2] + 0.5) / (size[1] + 1))
    use = np.zeros(1 << bits, bool)
    use[got[got[:, 1] + got[:, 2] >= LEAST_DOCS][:, 0]] = True
    use &= np.abs(ratio) >= LEAST_RATIO

    def chosen(batch):
        lists = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[use[x]].tobytes() for x in lists], pa.binary())], schema=schema)

    data = map_batches(kept, chosen, "y double, found binary").collect()                # bounded by fit_rows
    y = np.array([r.y > 0 for r in data], float)
    index, starts = grams_rows([np.frombuffer(r.found, np.int32) for r in data])
    scale, bias = logistic(index, starts, y, ratio, passes, ridge)
    weights[:] = scale * ratio
    return weights, bias


def grams_rows(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter((len(x) for x in lists), np.int64, len(lists))
    return np.concatenate(lists), np.repeat(np.arange(len(lists)), sizes)


def logistic(index: np.ndarray, owner: np.ndarray, y: np.ndarray, ratio: np.ndarray, passes: int, ridge: float) -> tuple[np.ndarray, float]:
    """Weights of the ratio-scaled features and the bias, by full-gradient Adam steps with a falling rate."""
    features, cell = np.unique(index, return_inverse=True)
    value = ratio[features]
    w, b = np.zeros(len(features)), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(len(w)), np.zeros(len(w)), 0.0, 0.0
    for k in range(1, passes + 1):
        z = np.bincount(owner, (w * value)[cell], len(y)) + b
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad, gb = value * np.bincount(cell, g[owner], len(w)) / len(y) + ridge * w, g.mean()
        m, v, mb, vb = .9 * m + .1 * grad, .99 * v + .01 * grad * grad, .9 * mb + .1 * gb, .99 * vb + .01 * gb * gb
        rate = 0.05 * (1 - k / (passes + 1))
        w -= rate * (m / (1 - .9 ** k)) / (np.sqrt(v / (1 - .99 ** k)) + 1e-9)
        b -= rate * (mb / (1 - .9 ** k)) / (np.sqrt(vb / (1 - .99 ** k)) + 1e-9)
    full = np.zeros(len(ratio))
    full[features] = w
    return full, float(b)


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_column: str = "doc_id", text_column: str = "text", orders=ORDERS, bits=BITS) -> DataFrame:
    """One row per document: its id and ``score`` in 0 to 1. A null or empty text gets the score of no evidence (the bias)."""
    small_batches(docs.sparkSession)
    ddl = f"{id_column} {dict(docs.dtypes)[id_column]}, score double"
    schema = arrow_schema(ddl)

    def run(batch):
        z = np.concatenate([grams.weighed(strings(part.column(1)), weights, orders, bits) for part in slices(batch, 1, 500_000)]) + bias
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema=schema)

    return map_batches(docs.select(id_column, text_column), run, ddl)
