import pytest
from pyspark.sql import functions as F

from panelspan import PanelSpec, load_table, write_results
from panelspan.functions import text as T
from panelspan.operators import prepare as P
from panelspan.operators import profile as PR
from panelspan.sources import files as S


@pytest.fixture(scope="module")
def wide(spark):
    return spark.createDataFrame([("A", "GDP growth", 1.0, 2.0), ("A", "Rate (real)", 5.0, 6.0), ("B", "GDP growth", 3.0, None),
                                  ("B", "Rate (real)", 7.0, 8.0), ("B", "Rate (nominal)", 9.0, 9.0)], "country string, indicator string, `2000` double, `2001` double")


def test_year_labels_and_indicator_tiers():
    assert P.year_columns(["1980", "2020", "x", "99", "21000", "1799"]) == ["1980", "2020"]
    assert [P.indicator_tier(c) for c in ("Indicator", "indicator_code", "SERIES_NAME", "series_x_name", "name", "series", "q")] == [1, None, 1, 3, 4, 5, None]


def test_unpivot_filter_and_join(wide):
    long = P.unpivot_years(wide)
    assert long.count() == 10 and dict(long.dtypes)["year"] == "int"
    assert P.indicator_filter(long, "indicator", "rate (REAL)").count() == 4
    got = {(r["country"], r["year"]): (r["gdp"], r["rate (real)"]) for r in P.indicator_join(long, "country", "indicator", "gdp", "rate (real)").collect()}
    assert got == {("A", 2000): (1.0, 5.0), ("A", 2001): (2.0, 6.0), ("B", 2000): (3.0, 7.0), ("B", 2001): (None, 8.0)}
    with pytest.raises(ValueError, match="2 indicators match"):
        P.indicator_join(long, "country", "indicator", "gdp", "rate")


def test_admissible_models_and_choice(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.0), ("a", 2, 2.0, 0.0), ("b", 1, 3.0, 1.0), ("b", 2, -4.0, 1.0)], "u string, t int, y double, x double")
    rows = {r["model"]: r for r in P.admissible_models(df, PanelSpec("y", "x", "u", "t")).collect()}
    assert rows["panel_ols"]["reason"] == "Predictor 'x' does not vary within units"
    assert rows["log_linear"]["reason"] == "Outcome 'y' must be strictly positive"
    assert rows["time_fe"]["status"] == "valid" and rows["panel_ols"]["rank"] < rows["ols"]["rank"]
    a = P.admissible_models(df, PanelSpec("y", "x", "u", "t"))
    assert P.choose_model(a).first()["model"] == "time_fe"
    assert P.choose_model(a, override="ols").first()["model"] == "ols"
    assert P.choose_model(a, override="panel_ols").first()["error"].startswith("Override 'panel_ols' cannot run")
    gone = {r["model"]: r["reason"] for r in P.admissible_models(df, PanelSpec("y", "zz", "u", "t")).collect()}
    assert gone["ols"] == "Columns not in data: treatment=zz"


def test_lag_stays_in_the_unit(spark):
    df = spark.createDataFrame([("a", 2, 20.0), ("a", 1, 10.0), ("b", 1, 5.0)], "u string, t int, x double")
    assert {(r["u"], r["t"]): r["x_lag1"] for r in P.lag_predictor(df, "x", "t", "u").collect()} == {("a", 1): None, ("a", 2): 10.0, ("b", 1): None}


def test_resolve_unit(spark):
    units = spark.createDataFrame([("Korea, Republic of",), ("Kingdom of Norway",), ("Guinea",), ("Papua New Guinea",)], "u string")
    asked = spark.createDataFrame([("norway",), ("Guinea",), ("new guinea",), ("atlantis",)], "q string")
    got = {r["request"]: r["unit"] for r in P.resolve_unit(units, "u", asked, "q").collect()}
    assert got == {"norway": "Kingdom of Norway", "Guinea": "Guinea", "new guinea": "Guinea"}


def test_semantic_types_and_structure(spark):
    rows = [(i, 2000 + i % 5, f"u{i % 3}", i % 2, i * 1.5, f"id{i}", f"2020-01-{i % 28 + 1:02d}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "n int, year int, unit string, flag int, y double, code string, day string, nothing string")
    want = {"n": "integer", "year": "year", "unit": "categorical", "flag": "boolean", "y": "numeric", "code": "identifier", "day": "datetime", "nothing": "text"}
    for exact in (True, False):
        p = PR.column_profile(df, exact=exact)
        assert {r["name"]: r["semantic_type"] for r in p.collect()} == want
    s = PR.dataset_structure(p).first()
    assert s["structure"] == "panel" and s["time_columns"] == "year,day" and "flag" in s["treatment_columns"]
    small = PR.dataset_structure(PR.column_profile(df.limit(5))).first()
    assert "under 20 rows" in small["notes"]


def test_general_number_format(spark):
    df = spark.createDataFrame([(1234.5,), (0.00012345,), (12.0,), (1e-7,), (0.5,)], "x double")
    assert [r[0] for r in df.select(T.general(F.col("x"), 3)).collect()] == ["1.23e+03", "0.000123", "12", "1e-07", "0.5"]


def test_rules(spark):
    df = spark.createDataFrame([("Will GDP grow in future?", "unemployment", "gdp_growth"), ("Does X affect Y", "gdp", "unemployment"), ("hello", "zzz", None)],
                               "q string, o string, t string")
    got = df.select(T.classify_question(F.col("q")), T.infer_domain(F.col("o"), F.col("t")), T.known_law(F.col("o"), F.col("t"))["law"]).collect()
    assert [tuple(r) for r in got] == [("forecast", "macroeconomics", "Okun's Law"), ("causal_effect", "macroeconomics", "Okun's Law"), ("association", None, None)]


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("A", 2000, 1.5, "2020-01-02"), ("B", 2001, 2.5, "2020/02/03")], "country string, year int, value double, day string")
    write_results(df, str(tmp_path / "x.csv"), "csv")
    back = load_table(spark, str(tmp_path / "x.csv"))
    assert dict(back.dtypes) == {"country": "string", "year": "int", "value": "double", "day": "timestamp"}
    assert sorted(r["day"].month for r in back.collect()) == [1, 2]
    df.write.option("header", True).option("sep", "\t").csv(str(tmp_path / "x.tsv"))
    assert S.load_table(spark, str(tmp_path / "x.tsv")).count() == 2
    assert S.detect_format("a/b.JSON") == "unknown" and S.detect_format("a/b.PQ") == "parquet" and S.detect_format("a/*.tab") == "tsv"
    with pytest.raises(ValueError, match="nothing to read at"):
        load_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="no reader for '.json' files"):
        load_table(spark, str(tmp_path / "x.json"))
