"""Mixing of domains to target weights with soft memberships.

A classifier fitted on a bounded sample of the labelled table gives each document a posterior over domains. Nonnegative
rates (expected uses of each document) are fitted by projected-gradient least squares so that the expected token totals
of the domains match the targets. A pass needs one small aggregate: with K domains it returns K + 1 numbers, and
because a document's rate depends on nothing but its own posterior and the earlier gradients, the rates of a pass are
replayed from those rather than stored. Steps follow Barzilai and Borwein.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import grams
from .common import arrow_schema, map_batches, slices, small_batches, strings, written

FIT_ROWS, ORDER, BITS, EVIDENCE = 12_000, 3, 15, 24
PASSES, CLOSE, STILL = 60, 1e-6, 1e-11       # most passes; done when totals are that close, or rates move by less (mean square)


def fit_domains(docs: DataFrame, labels: DataFrame, domains: list[str], domain_column: str, keep: Column | None = None, fit_rows: int = FIT_ROWS,
                id_column: str = "doc_id", text_column: str = "text") -> np.ndarray:
    """Log shares of hashed trigrams per domain and, in the last row, the log priors, from at most ``fit_rows`` labelled ids."""
    small_batches(docs.sparkSession)
    ids = (labels if keep is None else labels.where(keep)).where(F.col(id_column).isNotNull()).select(id_column).distinct()
    sample = ids.orderBy(F.xxhash64(id_column), id_column).limit(fit_rows)
    rows = docs.where(F.col(domain_column).isin(domains)).select(id_column, domain_column, text_column).join(F.broadcast(sample), id_column)
    number = {d: i for i, d in enumerate(domains)}
    schema = arrow_schema("domain int, bucket int, n long")

    def run(batches):
        seen, size = np.zeros((len(domains), 1 << BITS), np.int64), np.zeros(len(domains), np.int64)
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                data, _ = grams.joined([text])
                seen[number[own]] += np.bincount(next(grams.hashed(data, (ORDER,), BITS)), minlength=1 << BITS)
                size[number[own]] += 1
        for k in range(len(domains)):
            at = np.flatnonzero(seen[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, k, np.int32)), pa.array(np.append(at, -1).astype(np.int32)),
                                              pa.array(np.append(seen[k][at], size[k]))], schema=schema)

    counted = rows.select(domain_column, text_column).mapInArrow(run, "domain int, bucket int, n long").groupBy("domain", "bucket").agg(F.sum("n").alias("n"))
    counts, size = np.zeros((len(domains), 1 << BITS)), np.zeros(len(domains))
    for r in counted.collect():             # at most domains x 2 ** BITS numbers
        if r.bucket < 0:
            size[r.domain] = r.n
        else:
            counts[r.domain, r.bucket] = r.n
    logs = np.log(counts + 0.1) - np.log(counts.sum(1, keepdims=True) + 0.1 * (1 << BITS))
    return np.vstack([logs.T, np.log((size + 1) / (size + 1).sum())])


def memberships(docs: DataFrame, model: np.ndarray, text_column: str = "text", steps: list[np.ndarray] | None = None, least: float = 0.0) -> DataFrame:
    """All columns of ``docs`` with _llm_p (posterior over domains), _llm_n (words) and, with ``steps``, rate. An empty text has the
    prior and no words.

    The posterior weighs the mean log share of a text's trigrams as if there were at most ``EVIDENCE`` of them, so that long
    texts keep a soft membership.
    """
    small_batches(docs.sparkSession)
    at, k = docs.columns.index(text_column), model.shape[1]
    fields = [T.StructField("_llm_p", T.ArrayType(T.DoubleType())), T.StructField("_llm_n", T.DoubleType()), T.StructField("rate", T.DoubleType())]
    out = T.StructType([*docs.schema.fields, *fields[:2 if steps is None else 3]])

    def run(batch):
        ps, ns = [], []
        for part in slices(batch, at, 1_000_000):
            texts = strings(part.column(at))
            data, bounds = grams.joined(texts)
            n = np.maximum(np.diff(bounds) - grams.GAP - ORDER + 1, 0)
            z = grams.totals(texts, model[:-1], ORDER, BITS) * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None] + model[-1]
            p = np.exp(z - z.max(1, keepdims=True))
            ps.append(p / p.sum(1, keepdims=True))
            ns.append(grams.word_counts(data, bounds))
        p = np.concatenate(ps)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.ravel()))
        added = [lists, pa.array(np.concatenate(ns).astype(float))]
        if steps is not None:
            added.append(pa.array(replayed(p, steps, least)[1]))
        return pa.RecordBatch.from_arrays([*batch.columns, *added], names=out.names)

    return map_batches(docs, run, out)


def replayed(p: np.ndarray, steps: list[np.ndarray], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rates before and after the last step, projected to ``least`` or more; a step holds the gradient of each domain times its length."""
    rate = before = np.ones(len(p))
    for s in steps:
        before, rate = rate, np.maximum(least, rate - p @ s)
    return before, rate


def fit_rates(narrow: DataFrame, k: int, shares: np.ndarray, budget: float | None, least: float = 0.0) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, bool]:
    """Steps, reached and wanted token totals, and whether the fit ended. ``narrow`` is a written table of _llm_p and _llm_n.

    It ends when the totals are the wanted ones (``CLOSE``), or when rates stand still (``STILL``): then the least of rates keeps
    the totals apart. After ``PASSES`` passes it is given up.
    """
    schema = arrow_schema("cell int, v double")

    def totals(steps: list[np.ndarray]) -> tuple[np.ndarray, float]:
        def run(batches):
            sums, moved = np.zeros(k), 0.0
            for batch in batches:
                p, n = np.array(batch.column(0).flatten()).reshape(-1, k), np.array(batch.column(1))
                before, rate = replayed(p, steps, least)
                sums += (n * rate) @ p
                moved += float((n * (rate - before) ** 2).sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(np.append(sums, moved))], schema=schema)

        got = {r.cell: r.v for r in narrow.select("_llm_p", "_llm_n").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()}
        return np.array([got.get(i, 0.0) for i in range(k)]), got.get(k, 0.0)

    have, _ = totals([])
    whole = have.sum()
    if not whole:
        return [], have, have, True
    # Without a budget, a hair above what keeps every rate at 1, so that rounding takes no document away.
    wanted = shares * (budget if budget is not None else (have / np.maximum(shares, 1e-12)).max() * (1 + 1e-5))
    steps: list[np.ndarray] = []
    length, reached, settled = 1.0, have, False
    for _ in range(PASSES):
        steps.append(length * (reached - wanted) / whole)
        now, moved = totals(steps)
        change = now - reached
        reached = now
        settled = bool(np.abs(reached - wanted).max() <= CLOSE * wanted.max() or moved <= STILL * whole)
        if settled:
            break
        length = float(min(max(moved * whole / max((change * change).sum(), 1e-300), 1e-3), 1e3))
    return steps, reached, wanted, settled


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], domain_column: str = "lang", budget: float | None = None, least: float = 0.0,
        keep: Column | None = None, fit_rows: int = FIT_ROWS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of ``docs`` with n_tokens (words), posterior (array in the order of ``targets``), rate, copies, settled and off.

    ``targets`` are positive weights of domains; ``domain_column`` names the domain of labelled documents and is read nowhere
    else. ``budget`` is the expected total of tokens; None takes the least at which no domain has to give any away. Rates
    are at least ``least`` (at most 1; with 1 every document stays). ``copies`` realises the rate: its whole part, and one more with the probability of the
    rest by a hash of id and text. A null or empty text has no tokens, the prior as posterior and a rate like any other.
    Rows of equal id and text get equal copies. Columns of these names are replaced. An empty table gives no rows.
    ``settled`` is false in all rows if the fit of rates was given up before it ended, and ``off`` is the largest distance of
    an expected total from its target, as a part of the largest target (a ``least`` above 0 may keep them apart for good).
    """
    docs = docs.drop("n_tokens", "posterior", "rate", "copies", "settled", "off")
    names = list(targets)
    shares = np.array([float(targets[d]) for d in names])
    if not len(names) or (shares <= 0).any() or not 0 <= least <= 1:
        raise ValueError("targets need positive weights, and least must lie in 0 to 1")
    model = fit_domains(docs, labels, names, domain_column, keep, fit_rows, id_column, text_column)
    steps, reached, wanted, settled = fit_rates(written(memberships(docs.select(text_column), model, text_column).select("_llm_p", "_llm_n")), len(names), shares / shares.sum(), budget, least)
    rated = memberships(docs, model, text_column, steps, least)
    chance = F.pmod(F.xxhash64(F.lit("copies"), id_column, text_column), F.lit(1 << 30)) / (1 << 30)
    off = float(np.abs(reached - wanted).max() / max(wanted.max(), 1e-300)) if len(wanted) else 0.0
    rated = rated.withColumn("settled", F.lit(settled)).withColumn("off", F.lit(off))
    return rated.withColumn("n_tokens", F.col("_llm_n").cast("long")).withColumn("copies", F.floor(F.col("rate") + chance).cast("int")).withColumnRenamed("_llm_p", "posterior").drop("_llm_n")
