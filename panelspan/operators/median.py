"""Median regression (least absolute deviations), exact for groups of any size.

The sum of absolute residuals is convex, and near a given line only rows close to it can change the sign of their residual.
A round therefore takes a line and a reach, and finds with one aggregate how the rows beyond the reach pull: for them the sum
of signs, and of signs times the predictor, says all. The distinct points within the reach are solved with that pull, one
group at a time and never more than ``POINTS`` of them. While there are more, a share of them that hashing picks stands for
all, which gives the next line and a much smaller reach. When all points within the reach take part and the best line lies
within it too, the rows outside have indeed kept their signs, so the line is the best of all rows: this, and not the rounds
before it, decides the result. A group of at most ``POINTS`` distinct rows is done in one round.

Lines are measured in standard units, residual = (y - mean) - shift - slope (x - mean) / sd, and the reach bounds the change
of shift and of slope alike, so a row can change sign only if |residual| <= reach (1 + |x - mean| / sd).
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_numeric, ratio
from ..functions.dist import doubles
from ..plans.scale import attach, exact_quantile, materialise
from .regress import _line_error, line_stats, regression_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINTS = 50_000         # distinct points of a group that one task solves
SPREAD = 8              # the next reach holds this many times the root of the points in the share
ROUNDS = 60             # beyond them a group is reported as not converged
FLAT = 1e-12            # a reach of this part of the sizes involved is rounding
CELLS = 64              # cells per standard unit for points that lie on the line by the thousands
EPS = np.finfo(float).eps


def median_quantile(df: DataFrame, outcome: str, treatment: str, by: Sequence[str] = (), points: int = POINTS) -> DataFrame:
    """Least absolute deviations, one row per group; ``n_iter`` is the number of rounds.

    Where several lines are equally good, one of them is returned. ``converged`` is false for a group whose line could not
    be shown to be the best (more than ``points`` distinct rows that all lie on it, which do not hold it there).
    """
    by = list(by)
    keys = by or ["_all"]
    facts = clean_numeric(df, {"_y": outcome, "_x": treatment}, by)
    facts = materialise((facts if by else facts.withColumn("_all", F.lit(0))).select(*keys, "_y", "_x"))
    stats = line_stats(facts, by)       # without groups one row, also of no rows
    stats = materialise(stats if by else stats.withColumn("_all", F.lit(0)))
    ready = stats.where((F.col("_n") >= 8) & (F.col("_sxx") > 0))
    slope, sd = F.col("_sxy") / F.col("_sxx"), F.sqrt(F.col("_sxx") / F.col("_n"))
    fresh = materialise(ready.select(
        *keys, "_n", "_mx", "_my", sd.alias("_sd"), F.lit(0.0).alias("_c"), (slope * sd).alias("_s"), F.lit(None).cast("double").alias("_reach"),
        F.sqrt(F.col("_syy") / F.col("_n")).alias("_size"), F.lit(False).alias("_flat"), F.lit(False).alias("_proven"), F.lit(0).alias("_iter")))
    done = fresh.limit(0)
    for _ in range(ROUNDS):
        if not fresh.limit(1).count():
            break
        state = materialise(_round(facts, fresh, keys, points))
        # A share without any point says nothing: the next round picks another.
        again = fresh.join(state.select(*keys), keys, "left_anti").withColumn("_iter", F.col("_iter") + 1)
        done = done.unionByName(state.where("_done").drop("_done"))
        fresh = state.where(~F.col("_done")).drop("_done").unionByName(again.select(*fresh.columns))
    done = done.unionByName(fresh)
    lines = materialise(done.select(*keys, (F.col("_my") + F.col("_c") - F.col("_s") / F.col("_sd") * F.col("_mx")).alias("_a"),
                                    (F.col("_s") / F.col("_sd")).alias("_b"), "_c", "_s", "_mx", "_my", "_sd", "_iter", "_proven"))
    return materialise(_rows(facts, stats, lines, by, keys, outcome, treatment))


def _measured(facts: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with their group's line and ``_u`` (x in standard units), ``_z`` (y from its mean) and ``_e``."""
    out = attach(facts, lines, keys).withColumn("_u", (F.col("_x") - F.col("_mx")) / F.col("_sd")).withColumn("_z", F.col("_y") - F.col("_my"))
    return out.withColumn("_e", F.col("_z") - F.col("_c") - F.col("_s") * F.col("_u"))


def _round(facts: DataFrame, state: DataFrame, keys: list[str], points: int) -> DataFrame:
    """The next state of each open group."""
    near = F.col("_reach").isNull() | (F.abs("_e") <= F.col("_reach") * (1 + F.abs("_u")))
    rows = _measured(facts, state, keys)
    if state.where(F.col("_reach").isNotNull() | (F.col("_n") > points)).limit(1).count():
        point = F.when(near, F.xxhash64("_x", "_y"))
        pull = materialise(rows.groupBy(*keys).agg(F.sum(F.when(near, 0.0).otherwise(F.signum("_e"))).alias("_p0"),
                                                   F.sum(F.when(near, 0.0).otherwise(F.signum("_e") * F.col("_u"))).alias("_p1"),
                                                   F.approx_count_distinct(point, 0.02).alias("_m")))
        state = state.join(pull, keys)
    else:           # the first round of small groups: nothing is out of reach, and there are no more points than rows
        state = state.withColumns({"_p0": F.lit(0.0), "_p1": F.lit(0.0), "_m": F.col("_n")})
    state = materialise(state.withColumn("_share", F.when(F.col("_flat"), 1).otherwise(F.ceil(F.col("_m") / points)).cast("long")))
    inside = _measured(facts, state, keys).where(near & (F.pmod(F.xxhash64("_x", "_y", "_iter"), F.col("_share")) == 0))
    # Points on one line by the thousands go by cells; a cell's mean pulls no more than its points, so what it holds they hold.
    cell = F.greatest(F.lit(-32.0 * CELLS), F.least(F.lit(32.0 * CELLS), F.floor(F.col("_u") * CELLS).cast("double")))
    point = [F.when(F.col("_flat"), cell).otherwise(F.col("_u")).alias("_pu"), F.when(F.col("_flat"), F.lit(0.0)).otherwise(F.col("_z")).alias("_pz")]
    held = inside.select(*keys, "_flat", "_u", "_z", *point).groupBy(*keys, "_flat", "_pu", "_pz").agg(
        F.count(F.lit(1)).cast("double").alias("_w"), F.avg("_u").alias("_mu"), F.avg("_z").alias("_mz"))
    held = held.select(*keys, "_w", F.when(F.col("_flat"), F.col("_mu")).otherwise(F.col("_pu")).alias("_u"),
                       F.when(F.col("_flat"), F.col("_mz")).otherwise(F.col("_pz")).alias("_z"))
    carried = ["_p0", "_p1", "_share", "_c", "_s", "_reach", "_size", "_flat", "_n", "_mx", "_my", "_sd", "_iter"]
    schema = T.StructType([*[state.schema[k] for k in keys], *doubles("_c", "_s", "_reach", "_size").fields,
                           *[T.StructField(c, T.BooleanType()) for c in ("_flat", "_proven", "_done")], *[state.schema[c] for c in ("_n", "_mx", "_my", "_sd", "_iter")]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        share, reach = int(first["_share"]), None if pd.isna(first["_reach"]) else float(first["_reach"])
        u, z, w = (pdf[c].to_numpy(dtype=float) for c in ("_u", "_z", "_w"))
        now = (float(first["_c"]), float(first["_s"]))
        size = max(float(first["_size"]), float(np.abs(z).max()), abs(now[0]), abs(now[1]))
        c, s, inner = best_line(u, z, w * share, (float(first["_p0"]), float(first["_p1"])), now, reach)
        flat, proven, after = bool(first["_flat"]), False, reach
        if flat:
            # The cells' own best line may be another where they hold nothing: then the line before stays, unproven.
            proven = max(abs(c - now[0]), abs(s - now[1])) <= FLAT * size * 8
            c, s = (c, s) if proven else now
        elif share == 1:
            proven = inner          # else it went to the end of the reach, where the rows outside still kept their signs
        elif not inner:
            after = reach * 4
        else:
            r = np.sort(np.abs(z - c - s * u) / (1 + np.abs(u)))
            after = max(float(r[min(len(r) - 1, int(SPREAD * np.sqrt(len(r))))]), FLAT * size)
            after = after if reach is None else min(after, reach)
            flat = after <= FLAT * size
        row = {"_c": c, "_s": s, "_reach": after, "_size": float(first["_size"]), "_flat": flat, "_proven": proven,
               "_done": proven or bool(first["_flat"]), "_iter": int(first["_iter"]) + 1}
        return pd.DataFrame([{k: row[k] if k in row else first[k] for k in schema.fieldNames()}])

    return attach(held, state.select(*keys, *carried), keys).groupBy(*keys).applyInPandas(solve, schema)


def _weighted(q: np.ndarray, w: np.ndarray, pull: float) -> float | None:
    """Where the sum of w |t - q| less ``pull`` t is smallest; None if it falls without end."""
    order = np.argsort(q, kind="stable")
    upto = np.cumsum(w[order])
    goal = (upto[-1] + pull) / 2
    if not 0 <= goal <= upto[-1]:
        return None
    return float(q[order[min(int(np.searchsorted(upto, goal)), len(q) - 1)]])


def best_line(u: np.ndarray, z: np.ndarray, w: np.ndarray, pull: tuple[float, float], start: tuple[float, float],
              reach: float | None) -> tuple[float, float, bool]:
    """Shift and slope with the smallest sum of w |z - shift - slope u| less the pull, and whether they lie within the reach.

    From a line that touches points the next one is found along the steepest of the edges there, that is keeping one of the
    touching points, by a weighted median of slopes. A line that no edge leaves downwards is the best one.
    """
    c, s = start
    span, wide = float(np.abs(z).max()), float(np.abs(u).max())
    big = float(w @ (1 + np.abs(u))) + abs(pull[0]) + abs(pull[1])

    def move(dc: float, ds: float, c: float, s: float) -> tuple[float, float] | None:
        k = dc + ds * u
        use = np.abs(k) > 1e-13 * (abs(dc) + abs(ds) * wide)
        if not use.any():
            return None
        step = _weighted((z - c - s * u)[use] / k[use], (w * np.abs(k))[use], pull[0] * dc + pull[1] * ds)
        return None if step is None else (c + step * dc, s + step * ds)

    def loss(c: float, s: float) -> float:
        return float(w @ np.abs(z - c - s * u)) - pull[0] * c - pull[1] * s

    def stopped(c: float, s: float) -> tuple[float, float, bool]:
        """The line itself or, if it is out of reach, where the way to it leaves the reach."""
        far = max(abs(c - start[0]), abs(s - start[1]))
        if reach is None or far < reach:
            return c, s, True
        part = reach / far
        return start[0] + part * (c - start[0]), start[1] + part * (s - start[1]), False

    def edge(dc: float, ds: float, c: float, s: float) -> tuple[float, float, bool]:
        """Downhill for ever: as far as the reach allows."""
        far = 2 * (reach or span) / max(abs(dc), abs(ds))
        return stopped(c + far * dc, s + far * ds)

    first = move(1.0, 0.0, c, s)
    if first is None:
        return edge(np.sign(pull[0]), 0.0, c, s)
    c, s = first
    now = loss(c, s)
    while True:
        e = z - c - s * u
        touch = np.abs(e) <= 64 * EPS * (span + abs(c) + abs(s) * wide)
        g0 = float(w[~touch] @ np.sign(e[~touch])) + pull[0]
        g1 = float(w[~touch] @ (np.sign(e[~touch]) * u[~touch])) + pull[1]
        at, inverse = np.unique(u[touch], return_inverse=True)
        weight = np.bincount(inverse, w[touch], len(at))
        # Sum of weight |at - a| for every a, by sums from both sides.
        before, moment = np.cumsum(weight) - weight, np.cumsum(weight * at) - weight * at
        hold = at * before - moment + (weight @ at - moment - weight * at) - at * (weight.sum() - before - weight)
        along = g1 - at * g0
        rate = np.concatenate([hold - along, hold + along, [weight.sum() - g0, weight.sum() + g0]])
        i = int(rate.argmin())
        if rate[i] >= -1e-12 * big:
            return stopped(c, s)
        n = len(at)
        if i >= 2 * n:
            way = (1.0, 0.0) if i == 2 * n else (-1.0, 0.0)
        else:
            way = (-at[i], 1.0) if i < n else (at[i - n], -1.0)
        found = move(*way, c, s)
        if found is None:
            return edge(*way, c, s)
        better = loss(*found)
        if not better < now:                # only rounding is left
            return stopped(c, s)
        (c, s), now = found, better


def _rows(facts: DataFrame, stats: DataFrame, lines: DataFrame, by: list[str], keys: list[str], outcome: str, treatment: str) -> DataFrame:
    e, half = F.col("_e"), F.col("_k") / 2
    sums = _measured(facts, lines, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_k"), F.sum(F.abs(e)).alias("_loss"), F.stddev_pop(e).alias("_spread"), F.sum((e < 0).cast("long")).alias("_under"),
        F.sum((e > 0).cast("long")).alias("_over"), F.max(F.when(e < 0, e)).alias("_lo0"), F.min(F.when(e >= 0, e)).alias("_hi0"),
        F.max(F.when(e <= 0, e)).alias("_lo1"), F.min(F.when(e > 0, e)).alias("_hi1"))
    # At most half of the rows lie on either side of the best line. Zero is the middle unless one side has exactly half.
    middle = F.when(F.col("_under") == half, (F.col("_lo0") + F.col("_hi0")) / 2).when(F.col("_over") == half, (F.col("_lo1") + F.col("_hi1")) / 2)
    sums = materialise(sums.select(*keys, "_loss", "_spread", F.coalesce(middle, F.lit(0.0)).alias("_mid")))
    centre = materialise(exact_quantile(facts, "_y", 0.5, keys, "_ymed"))
    known = materialise(lines.join(sums, keys).join(centre, keys))
    rows = _measured(facts, known, keys).select(*keys, F.abs(F.col("_e") - F.col("_mid")).alias("_off"), F.abs(F.col("_y") - F.col("_ymed")).alias("_away"))
    rows = materialise(rows)
    mad = exact_quantile(rows, "_off", 0.5, keys, "_mad")
    away = rows.groupBy(*keys).agg(F.sum("_away").alias("_abs0"))
    fit = known.select(*keys, "_a", "_b", "_loss", "_spread", "_iter", "_proven").join(mad, keys).join(away, keys)
    full = stats.join(fit, keys, "left")
    sigma = F.when(F.col("_mad") > 0, F.lit(1.4826) * F.col("_mad")).otherwise(F.col("_spread"))
    return regression_rows(full, by, "median_quantile", outcome, treatment, _line_error(8), dict(
        estimate=F.col("_b"), intercept=F.col("_a"), se=sigma / F.sqrt("_sxx"), df=F.col("_n") - 2,
        r_squared=F.coalesce(1 - ratio(F.col("_loss"), F.col("_abs0")), F.lit(0.0)),
        n_obs=F.col("_n"), x_mean=F.col("_mx"), se_type=F.lit("MAD approximation"),
        converged=F.col("_proven"), n_iter=F.col("_iter"),
        extra=F.create_map(F.lit("quantile"), F.lit(0.5), F.lit("loss"), F.col("_loss"))))
