"""Quality: a document classifier combined with host and path rates by hierarchical empirical Bayes.

The classifier gives each document a probability of being good from its own text. Its sums per path and host, grouped
with partial aggregation, give a rate for each host shrunk toward the global rate and a rate for each path shrunk toward
its host's. The strength of either shrinkage comes from the data by the method of moments, so a site with few documents
stays near its parent and a large one speaks for itself. A document's own probability is taken out of the rates that it is
judged by.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, map_batches, slices, small_batches, strings, written

FIT_ROWS = 20_000
THRESHOLD = 0.5
LOWER, UPPER, DIGIT, BLANK, STOP, MARKS, OTHER, HIGH = range(8)
KINDS = np.full(256, OTHER, np.int64)
KINDS[97:123], KINDS[65:91], KINDS[48:58], KINDS[128:] = LOWER, UPPER, DIGIT, HIGH
KINDS[[9, 10, 11, 12, 13, 32]], KINDS[[46, 44, 59, 58, 63, 39, 34, 45, 40, 41]], KINDS[[33]] = BLANK, STOP, MARKS


def evidence(texts: list[str]) -> np.ndarray:
    """Numbers that describe each whole text: shares of kinds of characters, of repeated words and lines, lengths."""
    out = np.zeros((len(texts), 16))
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        words = data.split()
        n, lines = max(len(words), 1), text.split("\n")
        share = np.bincount(KINDS[np.frombuffer(data, np.uint8)], minlength=8) / max(len(data), 1)
        per_word = np.array([share[DIGIT], share[STOP], share[MARKS], share[OTHER], share[UPPER]]) * len(data) / n
        seen = set(words)
        pairs = len(set(zip(words, words[1:], strict=False)))
        alone = sum(1 for w in seen if len(w) == 1) / n
        out[i, :5] = np.log1p(20 * per_word)
        out[i, 5:10] = share[LOWER] + share[HIGH], len(seen) / n, pairs / max(n - 1, 1), len(set(lines)) / len(lines), alone
        out[i, 10:] = (math.log1p(n), math.log1p(len(data) / n), math.log1p(n / len(seen) if seen else 0),
                       sum(len(w) == 1 and not w.isalnum() for w in words) / n, len(lines) / n, not words)
    return out


def fit(docs: DataFrame, sample: DataFrame, id_column: str = "doc_id", text_column: str = "text", steps: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Bias, weights, means and scales of the classifier; ``sample`` holds a bounded number of ids with ``_y``."""
    small_batches(docs.sparkSession)
    rows = docs.select(id_column, text_column).join(F.broadcast(sample.select(id_column, "_y")), id_column).select("_y", text_column)
    schema = arrow_schema("y double, x binary")

    def run(batch):
        x = evidence(strings(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array([r.tobytes() for r in x], pa.binary())], schema=schema)

    got = map_batches(rows, run, "y double, x binary").collect()        # 16 numbers for each row of the bounded sample
    y = np.array([r.y > 0 for r in got], float)
    x = np.array([np.frombuffer(r.x) for r in got]).reshape(len(got), 16)
    mean, scale = (x.mean(0), x.std(0)) if len(got) else (np.zeros(16), np.ones(16))
    scale[scale < 1e-9] = 1
    rate = (y.sum() + 1) / (len(y) + 2)
    beta = np.zeros(33)
    beta[0] = math.log(rate / (1 - rate))
    if 0 < y.sum() < len(y):
        design = _design(x, mean, scale)
        for _ in range(steps):          # Newton steps of the ridge logistic regression
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            hess = (design * (p * (1 - p))[:, None]).T @ design / len(y) + ridge * np.eye(33)
            step = np.linalg.solve(hess, design.T @ (p - y) / len(y) + ridge * beta * (np.arange(33) > 0))
            beta -= step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-8:
                break
    return np.concatenate([beta, mean, scale])


def _design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.column_stack([np.ones(len(x)), z, z * z / 6])


def with_probability(docs: DataFrame, model: np.ndarray, text_column: str = "text", name: str = "p_doc") -> DataFrame:
    """All columns of ``docs`` and the classifier's probability of good. A null text counts as empty."""
    small_batches(docs.sparkSession)
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index(text_column)

    def run(batch):
        p = [1 / (1 + np.exp(-np.clip(_design(evidence(strings(part.column(at))), model[33:49], model[49:]) @ model[:33], -30, 30)))
             for part in slices(batch, at, 1_000_000)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(p))], names=[*batch.schema.names, name])

    return map_batches(docs, run, out)


def strength(stats: DataFrame, parent_mean: Column) -> float:
    """Prior strength (pseudo-documents) of beta-binomial groups with sums ``s`` of ``n`` around their parent's mean."""
    m = F.greatest(F.least(parent_mean, F.lit(1 - 1e-6)), F.lit(1e-6))
    r = stats.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"),
                  F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - m, 2) / (m * (1 - m))).alias("x")).first()
    if not r.g or r.n <= r.g:
        return 1e6
    spread = (r.x - r.g) / (r.n - r.g)         # share of the variance that lies between groups
    return 1 / min(max(spread, 1e-6), 0.999) - 1


def site_rates(p: DataFrame, host: str, path: str) -> tuple[DataFrame, float, float, float]:
    """Written table (host, path, sums of both) with the strengths of both levels and the global rate."""
    paths = written(p.where(F.col(host).isNotNull()).groupBy(host, path).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p_doc").alias("s")))
    hosts = written(paths.groupBy(host).agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    whole = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = (whole[1] + 0.5) / (whole[0] + 1) if whole[0] else 0.5
    a_host = strength(hosts, F.lit(rate))
    named = hosts.select(host, F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    both = paths.join(named, host)
    a_path = strength(both, (F.col("host_s") + a_host * rate) / (F.col("host_n") + a_host))
    table = written(both.select(host, F.col(path), F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s"))
    return table, rate, a_host, a_path


def judge(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", keep: Column | None = None, threshold: float = THRESHOLD,
          fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text", label: str = "quality") -> DataFrame:
    """All columns of ``docs`` with p_doc, host_rate, path_rate, p_good and keep (p_good >= threshold).

    Hosts and paths are compared as they are; a null host has no site evidence and is judged by its text and the global
    rate; a null path is a path of its host. Null or empty texts are judged as empty texts. Repeated ids are separate
    documents (a repeated label counts as good if any says so). Columns of these names in ``docs`` are replaced. Without labels
    p_doc is 0.5 for all. Labels enter only the classifier's fit, on at most ``fit_rows`` labelled documents.
    """
    from .toxicity import labelled_sample
    docs = docs.drop("p_doc", "host_rate", "path_rate", "p_good", "keep")
    model = fit(docs, labelled_sample(labels, label, F.lit(True) if keep is None else keep, fit_rows, id_column), id_column, text_column)
    p = written(with_probability(docs.select(host, path, text_column), model, text_column).select(F.col(host).alias("host"), F.col(path).alias("path"), "p_doc"))
    sites, rate, a_host, a_path = site_rates(p, "host", "path")
    sites = sites.toDF(*[f"_llm_{c}" for c in sites.columns])
    scored = with_probability(docs, model, text_column)
    rows = scored.join(sites, (scored[host] == sites["_llm_host"]) & scored[path].eqNullSafe(sites["_llm_path"]), "left")
    own_p, known = F.col("p_doc"), F.col("_llm_host_n").isNotNull()
    rows = rows.withColumn("host_rate", F.when(known, (F.col("_llm_host_s") - own_p + a_host * rate) / (F.col("_llm_host_n") - 1 + a_host)).otherwise(rate))
    rows = rows.withColumn("path_rate", F.when(known, (F.col("_llm_path_s") - own_p + a_path * F.col("host_rate")) / (F.col("_llm_path_n") - 1 + a_path)).otherwise(rate))
    odds = _logit(own_p) + _logit(F.col("path_rate")) - _logit(F.lit(rate))
    good = (1 / (1 + F.exp(-odds)))
    return (rows.withColumn("p_good", good).withColumn("keep", F.col("p_good") >= threshold)
            .drop(*sites.columns))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(q / (1 - q))
