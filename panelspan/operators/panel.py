"""Two-way fixed effects on (unit, time) cells.

The facts are reduced once to one row per cell: size, means, and sums of squares around the cell
means. Everything after that - effects, slope, R2, cluster scores - needs the cells only.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.columns import clean_numeric, ratio
from ..plans.scale import attach, group_agg, materialise
from .regress import TINY_SD, cluster_scale, line_stats, regression_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-11       # of the normal equations' residual, against the spread of the group's cells
PERIODS = 1_000         # a group of more periods is solved by steps
UNITS = 512             # units whose periods are laid out at once


def panel_cells(df: DataFrame, outcome: str, treatment: str, time: str, unit: str,
                by: Sequence[str] = ()) -> DataFrame:
    """One row per (unit, time): _n, _mx, _my and the sums of squares inside the cell."""
    f = clean_numeric(df, {"_y": outcome, "_x": treatment, "_time": time}, by, [unit])
    return line_stats(f.withColumnRenamed(unit, "_unit"), [*by, "_unit", "_time"])


def _weighted(name: str, value, out: str):
    return (F.sum(F.col("_n") * value) / F.sum("_n")).alias(out)


def panel_facts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sizes per group and whether the panel is balanced (full grid, equal cell sizes)."""
    one = F.lit(1)
    # The time axis and the units are counted from the cells by two small two-level aggregates.
    units = group_agg(cells.groupBy(*by, "_unit").agg(F.max("_n").alias("_m")), by, F.count(one).alias("_units"))
    times = group_agg(cells.groupBy(*by, "_time").agg(F.max("_n").alias("_m")), by, F.count(one).alias("_periods"))
    base = group_agg(cells, by, F.sum("_n").alias("_n"), F.count(one).alias("_cells"),
                     F.min("_n").alias("_min"), F.max("_n").alias("_max"),
                     _weighted("_x", F.col("_mx"), "_gx"), _weighted("_y", F.col("_my"), "_gy"))
    full = attach(attach(base, units, by), times, by)
    return full.withColumn("_even", (F.col("_cells") == F.col("_units") * F.col("_periods"))
                           & (F.col("_min") == F.col("_max")))


def demean_cells(cells: DataFrame, facts: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """Cells with two-way demeaned means ``_dx`` and ``_dy``, and per group ``_settled`` and ``_steps`` (None: closed form).

    If all panels are balanced there is a closed form. Otherwise the unit effects are eliminated and the time effects
    solved for: by one sum of products of periods up to ``PERIODS`` of them, and in steps that write vectors with a row per
    period beyond.
    """
    by = list(by)
    if not facts.where(~F.col("_even")).limit(1).count():
        unit = cells.groupBy(*by, "_unit").agg(_weighted("x", F.col("_mx"), "_ux"), _weighted("y", F.col("_my"), "_uy"))
        time = cells.groupBy(*by, "_time").agg(_weighted("x", F.col("_mx"), "_tx"), _weighted("y", F.col("_my"), "_ty"))
        rows = attach(cells.join(unit, [*by, "_unit"]).join(time, [*by, "_time"]),
                      facts.select(*by, "_gx", "_gy"), by)
        return (rows.withColumn("_dx", F.col("_mx") - F.col("_ux") - F.col("_tx") + F.col("_gx"))
                .withColumn("_dy", F.col("_my") - F.col("_uy") - F.col("_ty") + F.col("_gy"))
                .drop("_ux", "_uy", "_tx", "_ty", "_gx", "_gy"), None)

    time = _time_effects(cells, by)
    unit = (cells.join(time, [*by, "_time"]).groupBy(*by, "_unit")
            .agg(_weighted("x", F.col("_mx") - F.col("_tx"), "_ux"), _weighted("y", F.col("_my") - F.col("_ty"), "_uy")))
    rows = cells.join(unit, [*by, "_unit"]).join(time.drop("_settled", "_steps"), [*by, "_time"])
    how = group_agg(time, by, F.min("_settled").alias("_settled"), F.max("_steps").alias("_steps"))
    return (rows.withColumn("_dx", F.col("_mx") - F.col("_ux") - F.col("_tx"))
            .withColumn("_dy", F.col("_my") - F.col("_uy") - F.col("_ty"))
            .drop("_ux", "_uy", "_tx", "_ty"), materialise(how))


def _normal(cells: DataFrame, vector: DataFrame, by: list[str], x, y) -> DataFrame:
    """Per time: sums of n * (value - unit mean of the value), the time equations with the unit effects eliminated.

    ``x`` and ``y`` are the values, in columns of the cells and of ``vector`` (one row per time).
    """
    valued = cells.join(vector, [*by, "_time"]).select(*by, "_unit", "_time", "_n", x.alias("_vx"), y.alias("_vy"))
    unit = valued.groupBy(*by, "_unit").agg(_weighted("x", F.col("_vx"), "_ux"), _weighted("y", F.col("_vy"), "_uy"))
    n = F.col("_n")
    return (valued.join(unit, [*by, "_unit"]).groupBy(*by, "_time")
            .agg(F.sum(n * (F.col("_vx") - F.col("_ux"))).alias("_qx"), F.sum(n * (F.col("_vy") - F.col("_uy"))).alias("_qy")))


def _time_effects(cells: DataFrame, by: list[str]) -> DataFrame:
    """Time effects of both columns, one row per (group, time) with ``_settled`` and ``_steps``."""
    counts = group_agg(cells.select(*by, "_time").distinct(), by, F.count(F.lit(1)).alias("_k"))
    counts = materialise(counts)
    many = F.col("_k") > PERIODS
    if not counts.where(many).limit(1).count():
        return _summed_effects(cells, by)
    if not by:
        return _stepped_effects(cells, by)
    parts = [fn(cells.join(counts.where(which).select(*by), by, "left_semi"), by) for fn, which in ((_stepped_effects, many), (_summed_effects, ~many))]
    return parts[0].unionByName(parts[1])


def _summed_effects(cells: DataFrame, by: list[str]) -> DataFrame:
    """Time effects from the matrix of the time equations with the unit effects eliminated.

    A unit with n_t rows in period t adds n_t to the diagonal and takes n_t n_s / n off everywhere. Tasks add up the units
    they hold, Spark adds up the tasks, and each group's matrix (at most ``PERIODS`` wide) is solved on one row.
    """
    keys = by or ["_all"]
    cells = cells if by else cells.withColumn("_all", F.lit(0))
    of_group = Window.partitionBy(*keys)
    periods = materialise(cells.select(*keys, "_time").distinct().select(
        *keys, "_time", (F.row_number().over(of_group.orderBy("_time")) - 1).alias("_at"), F.count(F.lit(1)).over(of_group).cast("int").alias("_width")))
    units = cells.join(periods, [*keys, "_time"]).groupBy(*keys, "_width", "_unit").agg(
        F.collect_list(F.struct("_at", F.col("_n").cast("double").alias("_n"), "_mx", "_my")).alias("_cells")).select(*keys, "_width", "_cells")
    schema = T.StructType([*[periods.schema[k] for k in keys], *[T.StructField(c, T.IntegerType()) for c in ("_width", "_i", "_j")], T.StructField("_v", T.DoubleType())])
    out_schema = to_arrow_schema(schema)
    n_keys = len(keys)

    def rows_of(key: tuple, width: int, m: np.ndarray) -> pa.RecordBatch:
        i, j = np.nonzero(m)
        upper = i <= j
        i, j = i[upper], j[upper]
        columns = [pa.array([k] * len(i), f.type) for k, f in zip(key, out_schema)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                           pa.array(m[i, j])], schema=out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(n_keys + 1)
            flat = lists.flatten()
            at, n, x, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            size = np.bincount(owner, n, batch.num_rows)
            mean = [np.bincount(owner, n * v, batch.num_rows) / size for v in (x, y)]
            off = [n * (v - m[owner]) for v, m in zip((x, y), mean)]
            widths = batch.column(n_keys).to_numpy(zero_copy_only=False)
            groups: dict[tuple, list[int]] = {}
            for row, key in enumerate(zip(*[batch.column(k).to_pylist() for k in range(n_keys)])):
                groups.setdefault(key, []).append(row)
            begins = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])
            for key, held in groups.items():
                width = int(widths[held[0]])
                m = total.setdefault(key, np.zeros((width + 2, width + 2)))
                for k in range(0, len(held), UNITS):
                    some = held[k:k + UNITS]
                    take = np.concatenate([np.arange(begins[r], begins[r + 1]) for r in some])
                    laid = np.zeros((len(some), width))
                    laid[np.searchsorted(some, owner[take]), at[take]] = n[take]
                    m[:width, :width] -= laid.T @ (laid / size[some][:, None])
                    np.add.at(m, (at[take], at[take]), n[take])
                    for v in range(2):
                        np.add.at(m, (at[take], np.full(len(take), width + v)), off[v][take])
            if sum(m.size for m in total.values()) > 8_000_000:
                yield from (rows_of(k, len(m) - 2, m) for k, m in total.items())
                total = {}
        yield from (rows_of(k, len(m) - 2, m) for k, m in total.items())

    summed = units.mapInArrow(run, schema).groupBy(*keys, "_width", "_i", "_j").agg(F.sum("_v").alias("_v"))
    matrices = summed.groupBy(*keys, "_width").agg(F.collect_list(F.struct("_i", "_j", "_v")).alias("_m")).select(*keys, "_width", *[F.col("_m")[c].alias(c) for c in ("_i", "_j", "_v")])

    def solve(width: pd.Series, i: pd.Series, j: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for w, a, b, c in zip(width, i, j, v):
            m = np.zeros((w + 2, w + 2))
            m[a, b] = c
            right, m = m[:w, w:], m[:w, :w] + np.triu(m[:w, :w], 1).T
            d = 1 / np.sqrt(np.diag(m) + 1e-300)
            values, vectors = np.linalg.eigh(m * np.outer(d, d))
            good = values > 1e-11 * max(values[-1], 1e-300)         # effects are free by a constant for each part of the panel that hangs together
            out.append((d[:, None] * (vectors[:, good] @ ((vectors[:, good].T @ (d[:, None] * right)) / values[good][:, None]))).ravel())
        return pd.Series(out)

    effects = matrices.select(*keys, F.pandas_udf(solve, "array<double>")("_width", "_i", "_j", "_v").alias("_t"))
    found = periods.join(effects, keys, "left")
    return materialise(found.select(*by, "_time", F.coalesce(F.get("_t", 2 * F.col("_at")), F.lit(0.0)).alias("_tx"),
                                    F.coalesce(F.get("_t", 2 * F.col("_at") + 1), F.lit(0.0)).alias("_ty"), F.lit(1).alias("_steps"), F.lit(True).alias("_settled")))


def _stepped_effects(cells: DataFrame, by: list[str]) -> DataFrame:
    """Time effects of both columns by preconditioned conjugate gradients, every group with its own steps.

    A group is settled when the residual of its normal equations is below ``TOLERANCE`` of the spread of its cells; settled
    groups take no more steps. There are at most as many independent equations as periods, so the steps are bounded by that
    number with room for rounding, and a group still open then is marked as not settled.
    """
    zero = F.lit(0.0)
    size = materialise(cells.groupBy(*by, "_time").agg(F.sum("_n").cast("double").alias("_d")))
    means = group_agg(cells, by, _weighted("x", F.col("_mx"), "_gx"), _weighted("y", F.col("_my"), "_gy"))
    n = F.col("_n")
    scale = materialise(group_agg(attach(cells, materialise(means), by), by, F.sum(n * F.pow(F.col("_mx") - F.col("_gx"), 2)).alias("_scx"),
                                  F.sum(n * F.pow(F.col("_my") - F.col("_gy"), 2)).alias("_scy")))
    r = size.join(_normal(cells, size, by, F.col("_mx"), F.col("_my")), [*by, "_time"])
    state = materialise(r.select(*by, "_time", "_d", *[c for v in "xy" for c in (
        zero.alias(f"_t{v}"), F.col(f"_q{v}").alias(f"_r{v}"), (F.col(f"_q{v}") / F.col("_d")).alias(f"_p{v}"))], F.lit(0).alias("_steps")))

    def energy(rows: DataFrame) -> DataFrame:
        return group_agg(rows, by, *[F.sum(F.col(f"_r{v}") * F.col(f"_r{v}") / F.col("_d")).alias(f"_e{v}") for v in "xy"])

    def is_open(v: str):
        return F.col(f"_e{v}") > TOLERANCE * TOLERANCE * F.col(f"_sc{v}")

    had = materialise(attach(energy(state), scale, by).withColumn("_open", is_open("x") | is_open("y")))
    periods = int(group_agg(size, by, F.count(F.lit(1)).alias("_k")).agg(F.max("_k")).first()[0] or 0)
    for _ in range(2 * periods + 20):
        if not had.where("_open").limit(1).count():
            break
        q = materialise(state.join(_normal(cells, state.select(*by, "_time", "_px", "_py"), by, F.col("_px"), F.col("_py")), [*by, "_time"]))
        along = group_agg(q, by, *[F.sum(F.col(f"_p{v}") * F.col(f"_q{v}")).alias(f"_a{v}") for v in "xy"])
        step = materialise(attach(along, had, by))
        length = {v: F.when(is_open(v) & (F.col(f"_a{v}") > 0), F.col(f"_e{v}") / F.col(f"_a{v}")).otherwise(zero) for v in "xy"}
        lengths = step.select(*by, *[length[v].alias(f"_l{v}") for v in "xy"], F.col("_open").cast("int").alias("_one"))
        moved = materialise(attach(q, lengths, by).select(*by, "_time", "_d", *[c for v in "xy" for c in (
            (F.col(f"_t{v}") + F.col(f"_l{v}") * F.col(f"_p{v}")).alias(f"_t{v}"), (F.col(f"_r{v}") - F.col(f"_l{v}") * F.col(f"_q{v}")).alias(f"_r{v}"),
            F.col(f"_p{v}"))], (F.col("_steps") + F.col("_one")).alias("_steps")))
        now = materialise(attach(attach(energy(moved), had.select(*by, *[F.col(f"_e{v}").alias(f"_b{v}") for v in "xy"]), by), scale, by)
                          .withColumn("_open", is_open("x") | is_open("y")))
        turn = now.select(*by, *[F.when(F.col(f"_b{v}") > 0, F.col(f"_e{v}") / F.col(f"_b{v}")).otherwise(zero).alias(f"_w{v}") for v in "xy"])
        state = materialise(attach(moved, turn, by).select(*by, "_time", "_d", *[c for v in "xy" for c in (
            F.col(f"_t{v}"), F.col(f"_r{v}"), (F.col(f"_r{v}") / F.col("_d") + F.col(f"_w{v}") * F.col(f"_p{v}")).alias(f"_p{v}"))], "_steps"))
        had = now.drop("_bx", "_by")
    settled = had.select(*by, (~F.col("_open")).alias("_settled"))
    return materialise(attach(state.select(*by, "_time", "_tx", "_ty", "_steps"), settled, by))


def panel_ols(df: DataFrame, outcome: str, treatment: str, time: str, unit: str,
              by: Sequence[str] = (), model: str = "panel_ols") -> DataFrame:
    """y = unit + time + b x with unit-clustered errors (df = units - 1)."""
    by = list(by)
    cells = materialise(panel_cells(df, outcome, treatment, time, unit, by))
    facts = materialise(panel_facts(cells, by))
    rows, how = demean_cells(cells, facts, by)
    if how is None:
        facts = facts.withColumn("_settled", F.lit(True)).withColumn("_steps", F.lit(1))
    else:
        facts = attach(facts, how, by)
    n = F.col("_n")
    per_unit = materialise(rows.groupBy(*by, "_unit").agg(
        F.sum(F.col("_sxx") + n * F.col("_dx") * F.col("_dx")).alias("_sxx"),
        F.sum(F.col("_sxy") + n * F.col("_dx") * F.col("_dy")).alias("_sxy"),
        F.sum(F.col("_syy") + n * F.col("_dy") * F.col("_dy")).alias("_syy")))
    total = group_agg(per_unit, by, F.sum("_sxx").alias("_sxx"), F.sum("_sxy").alias("_sxy"),
                      F.sum("_syy").alias("_syy"))
    total = total.withColumn("_b", ratio(F.col("_sxy"), F.col("_sxx")))
    score = F.col("_sxy") - F.col("_b") * F.col("_sxx")
    meat = group_agg(attach(per_unit, total.select(*by, "_b"), by), by, F.sum(score * score).alias("_meat"))
    fit = attach(attach(facts, total, by), meat, by)
    g, count = F.col("_units"), F.coalesce(n, F.lit(0))
    # Below the rounding error of the demeaned predictor there is nothing left to identify b.
    error = (F.when(count < 10, F.concat(F.lit("a two-way fit takes 10 rows, there are "), count.cast("string")))
             .when(g < 2, "only one unit: unit effects need two").when(F.col("_periods") < 2, "only one period: time effects need two")
             .when(~F.col("_settled"), "the effects did not settle")
             .when(~(F.sqrt(F.col("_sxx") / n) >= F.greatest(F.lit(TINY_SD), F.abs("_gx") * 1e-9)),
                   "unit and time effects explain the predictor wholly"))
    return regression_rows(fit, by, model, outcome, treatment, error, dict(
        estimate=F.col("_b"), intercept=F.col("_gy") - F.col("_b") * F.col("_gx"),
        se=cluster_scale("_meat", "_sxx", g), df=g - 1,
        r_squared=F.coalesce(F.col("_b") * ratio(F.col("_sxy"), F.col("_syy")), F.lit(0.0)),
        n_obs=n, n_units=g, n_periods=F.col("_periods"), x_mean=F.col("_gx"),
        se_type=F.lit("clustered (unit level)"), fe_type=F.lit("Two-way fixed effects (unit + time)"),
        converged=F.col("_settled"), n_iter=F.col("_steps")))


def diff_in_diff(df, outcome, treatment, time, unit, by=()):
    """The two-way estimator under its causal label."""
    return panel_ols(df, outcome, treatment, time, unit, by, "diff_in_diff")
