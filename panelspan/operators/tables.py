"""Result tables and summaries as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.scale import attach, group_agg
from ..spec import all_models

ROWS = ("coefficient", "standard error", "R²", "N", "Fixed Effects", "SE type")
LEGEND = "***p < 0.001, **p < 0.01, *p < 0.05, †p < 0.10. Standard errors in parentheses."


def table_cells(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Formatted cells: ``by..., model, row, label, cell``."""
    dash = F.lit("—")
    num = lambda c, f: F.when(F.col(c).isNull(), dash).otherwise(F.format_string(f, c))      # noqa: E731
    cells = (F.concat(num("estimate", "%+.4f"), F.coalesce(X.stars(F.col("pvalue")), F.lit(""))),
             F.concat(F.lit("("), num("se", "%.4f"), F.lit(")")), num("r_squared", "%.4f"), num("n_obs", "%,d"),
             F.coalesce("fe_type", dash), F.coalesce("se_type", F.lit("OLS")))
    packed = F.array(*[F.struct(F.lit(i).alias("row"), F.lit(n).alias("label"), c.alias("cell"))
                       for i, (n, c) in enumerate(zip(ROWS, cells), 1)])
    return results.select(*by, "model", F.explode(packed).alias("c")).select(*by, "model", "c.*")


def regression_table(results: DataFrame, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Models side by side, one row per line of the table."""
    return (table_cells(results, by).groupBy(*by, "row", "label").pivot("model", list(models)).agg(F.first("cell")))


def table_lines(table: DataFrame, models: Sequence[str], predictor: str, outcome: str, latex: bool = False) -> DataFrame:
    """Lines of the Markdown or LaTeX table: ``line_no, line``."""
    cells = [F.coalesce(F.col(f"`{m}`"), F.lit("—")) for m in models]
    label = F.when(F.col("row") == 1, predictor).when(F.col("row") == 2, "").otherwise(F.col("label"))
    heads = [f"({i}) {outcome}" for i in range(1, len(models) + 1)]
    if latex:
        tidy = [F.replace(F.replace(F.replace(c, F.lit("†"), F.lit(r"$^{\dagger}$")), F.lit("*"), F.lit("$^{*}$")), F.lit("_"), F.lit(" "))
                for c in cells]
        body = F.concat(F.concat_ws(" & ", F.replace(label, F.lit("_"), F.lit(" ")), *tidy), F.lit(r" \\"))
        top = [r"\begin{table}[htbp]", r"\centering", r"\begin{tabular}{l" + "c" * len(models) + "}", r"\hline\hline",
               " & ".join(["", *heads]) + r" \\", r"\hline"]
        bottom = [r"\hline\hline", r"\end{tabular}", r"\end{table}"]
    else:
        body = F.concat(F.lit("| "), F.concat_ws(" | ", label, *cells), F.lit(" |"))
        top = ["| Variable | " + " | ".join(heads) + " |", "|---" * (len(models) + 1) + "|"]
        bottom = ["", LEGEND]
    lines = F.array(*[F.struct(F.lit(i).alias("line_no"), F.lit(t).alias("line")) for i, t in enumerate(top)],
                    *[F.struct(F.lit(1000 + i).alias("line_no"), F.lit(t).alias("line")) for i, t in enumerate(bottom)])
    fixed = table.agg(F.count(F.lit(1)).alias("_")).select(F.explode(lines).alias("l")).select("l.line_no", "l.line")
    return fixed.unionByName(table.select((F.col("row") + 100).alias("line_no"), body.alias("line"))).orderBy("line_no")


def result_texts(results: DataFrame, by: Sequence[str] = (), causal: bool = False) -> DataFrame:
    """Verdict, plain-English bullets and summary of every result row."""
    c = F.col
    names = F.create_map(*[F.lit(v) for m in all_models().values() for v in (m.name, m.display_name)])
    label = F.coalesce(F.try_element_at(names, c("model")), c("model"))
    args = (c("estimate"), c("pvalue"), c("ci_lower"), c("ci_upper"))
    return results.where(c("status") == "ok").select(
        *by, "model", X.verdict(c("outcome"), c("treatment"), *args).alias("verdict"),
        X.plain_english(*args, c("r_squared")).alias("plain_english"),
        X.regression_summary(c("outcome"), c("treatment"), label, *args, c("r_squared"), c("n_obs"), causal).alias("summary"),
        X.effect_strength(c("estimate"), c("ci_lower"), c("ci_upper")).alias("strength"),
        X.stars(c("pvalue")).alias("stars"), X.infer_domain(c("outcome"), c("treatment")).alias("domain"),
        X.r2_context(c("r_squared"), F.coalesce(X.infer_domain(c("outcome"), c("treatment")), F.lit(""))).alias("r2_context"))


def forecast_summary(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Direction, change, mean forecast and RMSE of each forecast."""
    ok = forecasts.where(F.col("status") == "ok")
    a = group_agg(ok, [*by, "model"], F.min_by("forecast", "h").alias("next_value"), F.max("last_value").alias("last_value"),
                  F.avg("forecast").alias("mean_forecast"), F.count(F.lit(1)).alias("periods"), F.max("rmse").alias("rmse"))
    change = F.col("next_value") - F.col("last_value")
    way = F.when(change > 0, "up").when(change < 0, "down").otherwise("level")
    pct = F.coalesce(F.try_divide(change * 100, F.col("last_value")), F.lit(0.0))
    text = F.concat(F.format_string("next %,.4f after %,.4f: %s, %+.2f%%\n", "next_value", "last_value", way, pct),
                    F.format_string("mean of %d steps %,.4f\n", "periods", "mean_forecast"), F.format_string("one-step error %,.4f", "rmse"))
    return a.select(*by, "model", way.alias("direction"), pct.alias("pct_change"), "next_value", "last_value", "mean_forecast", "periods",
                    "rmse", text.alias("summary"))


def diagnostics_summary(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A line per check, then the failed ones and what to do: one text per group."""
    line = F.concat(F.when(F.col("status") == "violated", "failed: ").when(F.col("status") == "ok", "passed: ").otherwise("not run: "), F.col("interpretation"))
    bad = F.col("status") == "violated"
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(c)), lambda s: s["v"])      # noqa: E731
    place = F.struct(F.col("check_id").alias("k"), F.coalesce("series_name", F.lit("")).alias("n"))
    a = group_agg(checks, by, ordered(F.struct(place.alias("k"), line.alias("v"))).alias("_l"),
                  ordered(F.when(bad, F.struct(place.alias("k"), F.concat(F.lit("- "), F.col("test")).alias("v")))).alias("_v"),
                  ordered(F.when(bad, F.struct(place.alias("k"), F.concat(F.lit("- "), F.col("correction")).alias("v")))).alias("_c"),
                  F.count_if(bad).alias("n_violated"), F.count_if(F.col("status") == "ok").alias("n_ok"),
                  F.count_if(F.col("status") == "not_run").alias("n_not_run"))
    tail = F.when(F.size("_v") > 0, F.concat(F.lit("\n\nfailed checks:\n"), F.array_join("_v", "\n"), F.lit("\n\nwhat to do:\n"),
                                             F.array_join("_c", "\n"))).otherwise(F.lit("\n\nno check failed"))
    return a.select(*by, "n_ok", "n_violated", "n_not_run", F.concat(F.array_join("_l", "\n"), tail).alias("summary"))


def strongest_pair(matrix: DataFrame, by: Sequence[str] = (), least: float = 0.4) -> DataFrame:
    """The pair of columns with the largest |r|, whether it is worth a call-out, and its named pattern."""
    best = group_agg(matrix.where(F.col("r").isNotNull()), by, F.max_by(F.struct("a", "b", "r"), F.struct(F.abs("r"), "a", "b")).alias("m"))
    return best.select(*by, "m.a", "m.b", "m.r", (F.abs("m.r") >= least).alias("called_out"),
                       X.pair_law(F.col("m.a"), F.col("m.b")).alias("pattern"))


def sanity(results: DataFrame, df: DataFrame, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Plausibility notes per result row, with the outcome mean from the data."""
    from ..functions.columns import as_double, finite
    y = df.select(*by, as_double(df, outcome).alias("_y"))
    mean = group_agg(y, by, F.avg(F.when(finite("_y"), F.col("_y"))).alias("_ym"))
    rows = attach(results.where(F.col("status") == "ok"), mean, by)
    c = F.col
    notes = X.sanity_notes(c("outcome"), c("treatment"), c("estimate"), c("_ym"), c("n_obs"), c("ci_lower"), c("ci_upper"), c("pvalue"), c("r_squared"))
    return rows.select(*by, "model", F.array_join(notes, "\n").alias("notes"), F.size(notes).alias("n_notes"))
