import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspan.plans.scale import Series, exact_quantile, materialise, shared_dir


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    key = np.where(rng.random(300) < 0.4, 0, rng.integers(1, 5, 300))      # one key with many rows
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(300).astype(float), "v": rng.normal(size=300)})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit", [10_000, 40, 3])
def test_ordered_operations_do_not_depend_on_the_cuts(rows, limit):
    pdf, df = rows
    s = Series.of(df, ["k"], "t", limit)
    assert s.split == (limit < 10_000)
    got = s.number("i").running_sum(s=F.col("v")).lag(l1=("v", 1), l5=("v", 5)).rows().toPandas().sort_values(["k", "t"])
    want = pdf.sort_values(["k", "t"])
    g = want.groupby("k")
    assert (got["i"].to_numpy() == g.cumcount().to_numpy() + 1).all()
    np.testing.assert_allclose(got["s"], g["v"].cumsum(), rtol=1e-9, atol=1e-12)
    np.testing.assert_allclose(got["l1"].astype(float), g["v"].shift(1))
    np.testing.assert_allclose(got["l5"].astype(float), g["v"].shift(5))


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile_by_counting(rows, q):
    pdf, df = rows
    got = {r["k"]: r["m"] for r in exact_quantile(df, "v", q, ["k"], "m", max_rows=5).collect()}
    for k, v in pdf.groupby("k")["v"]:
        assert got[k] == pytest.approx(np.quantile(v, q), rel=1e-12)


def test_exact_quantile_with_ties_and_outliers(spark):
    v = np.concatenate([np.zeros(500), np.ones(499), [1e12], np.linspace(2, 3, 4001)])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    assert exact_quantile(df, "v", 0.5, max_rows=10).first()[0] == pytest.approx(np.median(v), rel=1e-12)
    assert exact_quantile(df, "v", 0.05, max_rows=10).first()[0] == 0.0


def test_tables_are_written_to_the_shared_folder(spark):
    df = materialise(spark.range(5))
    assert df.count() == 5
    assert shared_dir(spark).rstrip("/") in df.inputFiles()[0]


def test_statistics_too_large_to_broadcast_do_not_gather_a_hot_group(spark):
    from panelspan.operators import regress
    from panelspan.plans.scale import attach, materialise
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    rows = [("hot" if i % 10 else f"g{i % 70}", float(2 * v + rng.normal()), float(v)) for i, v in enumerate(x)] + [("hot", 1.0, 1.0)] * 200
    df = spark.createDataFrame(rows, "g string, y double, x double").repartition(6)
    key = lambda r: r["g"]      # noqa: E731
    want = sorted(regress.ols(df, "y", "x", ["g"]).collect(), key=key)
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        got = sorted(regress.ols(df, "y", "x", ["g"]).collect(), key=key)
        assert [r["g"] for r in got] == [r["g"] for r in want]
        assert all(a["estimate"] == pytest.approx(b["estimate"], rel=1e-12) and a["se"] == pytest.approx(b["se"], rel=1e-12) for a, b in zip(got, want, strict=True))
        stats = materialise(df.groupBy("g").agg(F.avg("x").alias("m")))
        joined = attach(df, stats, ["g"])
        assert joined.columns == ["g", "y", "x", "m"] and joined.count() == len(rows)
        sizes = [r["count"] for r in joined.where("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 4 and max(sizes) < 0.5 * sum(sizes)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
