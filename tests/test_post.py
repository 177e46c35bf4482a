import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from panelspan import ModelSpec, PanelSpec, analyze, register_estimator, run_model, unregister_estimator, whatif
from panelspan.operators import forecast as FC
from panelspan.operators import post as PO
from panelspan.operators import prepare as PP
from panelspan.operators import regress as R
from panelspan.operators import tables as TB

MODEL = "status string, model string, intercept double, estimate double, se double, x_mean double"


def test_regression_scenario_exact_values(spark):
    m = spark.createDataFrame([("ok", "ols", 2.0, 0.5, 0.1, 5.0)], MODEL)
    r = whatif(m, {"x": 10}).first()
    assert r["predicted"] == pytest.approx(7.0) and r["delta_vs_baseline"] == pytest.approx(2.5)
    assert r["pred_lower"] == pytest.approx(7.0 - 0.98) and r["pred_upper"] == pytest.approx(7.0 + 0.98)
    assert whatif(spark.createDataFrame([("ok", "ols", 1.0, 0.25, 0.0, None)], MODEL), {"treatment_value": 4}).first()["predicted"] == pytest.approx(2.0)
    with pytest.raises(ValueError):
        whatif(m, {"frob": 1})


def test_log_models_predict_on_the_scale_of_the_outcome(spark):
    x = np.linspace(1, 20, 50)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 3 * x ** 0.5}))
    assert whatif(R.log_log(df, "y", "x"), {"x": 9}).first()["predicted"] == pytest.approx(9.0, rel=1e-8)
    quad = spark.createDataFrame(pd.DataFrame({"x": x, "y": 1 + 2 * x + 0.5 * x * x}))
    assert whatif(R.polynomial_ols(quad, "y", "x"), {"x": 4}).first()["predicted"] == pytest.approx(17.0, rel=1e-8)


def test_shock_fades(spark):
    f = spark.createDataFrame([("ok", "ar1", h, float(h), v, 10.0, 0.5) for h, v in ((1, 11.0), (2, 11.5), (3, 12.0))],
                              "status string, model string, h int, time double, forecast double, last_value double, ar1 double")
    r = whatif(f, {"shock": 2.0}).orderBy("h").collect()
    assert [x["forecast"] for x in r] == pytest.approx([13.0, 12.5, 12.5]) and r[0]["shocked_last"] == 12.0


def test_score_counts_certainty_and_only_checks_that_ran(spark):
    res = spark.createDataFrame([("ols", 0.0, 1000)], "model string, pvalue double, n_obs long")
    checks = spark.createDataFrame([("ok",), ("not_run",)], "status string")
    eras = spark.createDataFrame([(1.0,), (-5.0,)], "estimate double")
    r = PO.confidence_score(res, checks, eras).first()
    assert (r["sig"], r["diag"], r["samp"], r["era"], r["score"], r["label"]) == (40, 25, 20, 0, 85, "High confidence")


def test_eras_do_not_share_their_borders(spark):
    eras = PO.era_table(1990, 2020, [(2008, "Global Financial Crisis of the century")])
    assert [(e["lo"], e["hi"]) for e in eras] == [(1990, 2008), (2008, 2020)]
    assert [e["label"] for e in eras] == ["first span", "Global Financial Crisis"[:22]]
    assert PO.era_table(2000, 2008) == []
    rows = [(t, float(i), (1.0 if t < 2005 else -4.0) * i + 0.01 * (i * t % 7)) for t in range(1990, 2021) for i in range(6)]
    df = spark.createDataFrame(rows, "t int, x double, y double")
    e = PO.era_effects(df, "ols", "y", "x", "t", events=[(2005, "break")])
    got = {r["era"]: r for r in e.collect()}
    assert sum(r["n_obs"] for r in got.values()) == len(rows)
    assert got[1]["estimate"] > 0.9 and got[2]["estimate"] < -3.9
    b = PO.structural_break(e).first()
    assert b["structural_break"] and b["sign_reversal"]


def test_outliers_are_residuals_of_y_on_x(spark):
    x = np.arange(30.0)
    y = 2 * x
    y[7] += 50
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "id": np.arange(30)}))
    assert [r["id"] for r in PO.outlier_rows(df, R.ols(df, "y", "x"), "y", "x", ["id"]).collect()] == [7]


def test_registered_model_runs(spark):
    register_estimator("twice", lambda df, y, x, t, u, by: R.ols(df, y, x, by, "twice"))
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(9.0), "y": 2 * np.arange(9.0) + np.arange(9) % 2}))
    assert run_model(df, "twice", "y", "x").first()["model"] == "twice"


def test_table_lines(spark):
    df = spark.createDataFrame(pd.DataFrame({"x": np.arange(9.0), "y": 2 * np.arange(9.0) + np.arange(9) % 2}))
    t = TB.regression_table(R.ols(df, "y", "x"), ["ols"])
    md = [r["line"] for r in TB.table_lines(t, ["ols"], "x", "y").collect()]
    assert md[0] == "| Variable | (1) y |" and md[2].startswith("| x | +") and md[2].endswith("*** |")
    tex = [r["line"] for r in TB.table_lines(t, ["ols"], "x", "y", latex=True).collect()]
    assert tex[0] == r"\begin{table}[htbp]" and r"$^{*}$$^{*}$$^{*}$" in tex[6]


def test_analysis_switches_on_diverging_trends(spark):
    rng = np.random.default_rng(1)
    rows = [(u, t, int(u == "A" and t >= 2018), float((0.8 if u == "A" else 0.1) * (t - 2010) + 0.1 * rng.normal()))
            for u in ("A", "B") for t in range(2010, 2022)]
    a = analyze(spark.createDataFrame(rows, "u string, t int, d int, y double"), PanelSpec("y", "d", "u", "t", "causal_effect"))
    assert a.model == "first_difference" and "parallel_trends" in a.notes[0]
    assert a.texts.count() == 1 and a.followups.count() == 4


def test_analysis_falls_back_to_association(spark):
    df = spark.createDataFrame([(50 + 5 * i + i % 3, 8 + i) for i in range(8)], "income int, years int")
    a = analyze(df, PanelSpec("income", "years", question_type="causal_effect"))
    assert a.model == "ols" and "association" in a.notes[0] and a.result.first()["estimate"] > 0


SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 100


@pytest.mark.parametrize("name", ["ols_by_group", "panel_ols_unbalanced", "entity_fe", "kpss_test", "ljung_box",
                                  "histogram", "confidence_score", "verdict", "classify_question"])
def test_queries_match_their_sql(spark, name):
    from tools.check_oracles import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cur.fetchall())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["status"] == "ok"


def test_several_models_need_keys(spark):
    df = spark.createDataFrame([(g, float(x), 2.0 * x + x % 3 + (g == "b")) for g in "ab" for x in range(20)], "g string, x double, y double")
    models = R.ols(df, "y", "x", ["g"])
    grid = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    with pytest.raises(ValueError, match="several models"):
        PO.whatif_regression(models, grid)
    with pytest.raises(ValueError, match="several models"):
        PO.fit_line(df, models, "y", "x")
    got = {r["g"]: r["predicted"] for r in PO.whatif(models, {"x": 3}).collect()}
    assert got["b"] == pytest.approx(got["a"] + 1)
    paths = FC.forecast_ar1(df.withColumn("t", F.col("x")), "y", "t", 2, ["g"])
    shocked = PO.whatif(paths, {"shock": 1.0}).collect()
    assert sorted((r["g"], r["h"]) for r in shocked) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]
    with pytest.raises(ValueError, match="several series"):
        PO.whatif_shock(paths, grid.withColumnRenamed("x", "shock"))


def test_an_added_model_with_a_spec_is_chosen_by_analyze(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{u}", 2000 + t, float(np.exp(1 + 0.3 * x + 0.05 * u + rng.normal() * 0.1)), float(x)) for u in range(6) for t in range(10) for x in [rng.normal() + t / 5]]
    df = spark.createDataFrame(rows, "unit string, year int, sales double, price double")
    own = ModelSpec("log_within", "association", "Logs within units", ("outcome", "treatment", "unit"), needs_variation=True, positive_outcome=True)

    def fit(df, y, x, t, u, by):
        rows = R.entity_fe(df.withColumn(y, F.log(y)), y, x, u, by)
        return rows.withColumn("model", F.lit("log_within"))

    panel = PanelSpec("sales", "price", "unit", "year")
    try:
        register_estimator("log_within", fit, own, before="panel_ols")
        a = analyze(df, panel)
        assert a.model == "log_within" and a.result.first()["estimate"] == pytest.approx(0.3, abs=0.03)
        ranks = [r["model"] for r in a.admissible.orderBy("rank").collect()]
        assert ranks[:2] == ["log_within", "panel_ols"] and len(ranks) == 11
        chosen = PP.choose_model(a.admissible).first()
        assert chosen["model"] == "log_within" and chosen["display_name"] == "Logs within units"
        below = PP.admissible_models(df.withColumn("sales", F.col("sales") - 100), panel).where("model = 'log_within'").first()
        assert below["status"] == "rejected" and "strictly positive" in below["reason"]
        gone = PP.admissible_models(df.drop("unit"), panel).where("model = 'log_within'").first()
        assert gone["reason"] == "Columns not in data: unit=unit"
        register_estimator("log_within", fit, own)                 # again, now after all others
        assert PP.admissible_models(df, panel).orderBy(F.desc("rank")).first()["model"] == "log_within"
    finally:
        unregister_estimator("log_within")
    assert PP.admissible_models(df, panel).count() == 10
    for odd in (ModelSpec("ols", "association", "x", ("outcome",)), ModelSpec("own", "nothing", "x", ("outcome",)), ModelSpec("own", "association", "x", ("price",))):
        with pytest.raises(ValueError):
            register_estimator(odd.name, fit, odd)
    with pytest.raises(ValueError):
        register_estimator("own", fit, ModelSpec("own", "forecast", "x", ("outcome",)), before="ols")
    with pytest.raises(ValueError):
        run_model(df, "own", "sales", "price")
