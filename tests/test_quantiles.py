import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.columns import clean_with_statistics
from corpusloom.operators import evaluation, reporting, scores
from corpusloom.plans import quantiles
from corpusloom.plans.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.77, 0.9, 1.0]


@pytest.mark.parametrize("stretches", [4096, 3])
def test_equals_sorting_in_every_group(spark, monkeypatch, stretches):
    monkeypatch.setattr(quantiles, "STRETCHES", stretches)
    rng = np.random.default_rng(stretches)
    values = {"spread": rng.normal(size=401), "ties": rng.integers(0, 4, 300) / 4, "one": np.array([3.5]), None: rng.normal(size=57), "half zero": np.append(np.zeros(500), rng.random(499))}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("ties", None), ("nulls", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["group"]: r for r in exact_quantiles(df, F.col("v"), SHARES, F.col("g")).collect()}
    assert set(got) == set(values)
    for g, xs in values.items():
        assert got[g]["n"] == len(xs) and np.allclose(got[g]["q"], np.quantile(xs, SHARES), rtol=0, atol=1e-12)
    assert exact_quantiles(df.where("g = 'nulls'"), F.col("v"), [0.5]).collect() == []


def test_no_task_holds_all_values_and_no_frequent_value_more_than_a_row(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(0.0)).otherwise(F.xxhash64("id") / 1e18).alias("v"))
    found = exact_quantiles(df, F.col("v"), [0.25, 0.5, 0.75])
    plan = found._jdf.queryExecution().toString()
    assert "percentile(" not in plan
    want = np.quantile([r["v"] for r in df.collect()], [0.25, 0.5, 0.75])
    assert np.allclose(found.first()["q"], want)
    placed = quantiles.running_sum(df.groupBy("v").agg(F.count("*").alias("c")), "c", F.col("v"))
    parts = [r["n"] for r in placed.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(parts) < 13_400  # a third of the rows is one


def test_operators_agree_with_numpy(spark):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=2500), rng.integers(0, 2, 2500)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "id bigint, s double, y int")
    long = scores.to_long(df, ["s"])
    q = reporting.quartiles(long).first()
    assert np.allclose([q["q1"], q["median"], q["q3"]], np.quantile(x, [0.25, 0.5, 0.75]))
    by = {r["label"]: r for r in evaluation.score_distribution(df, "s", "y").collect()}
    assert np.allclose([by[1]["median"], by[1]["p75"], by[1]["p90"]], np.quantile(x[y == 1], [0.5, 0.75, 0.9]))
    assert abs(evaluation.outlier_metrics(df, "s", "y").first()["threshold"] - np.quantile(x, 0.9)) < 1e-12
    grid = np.quantile(x, np.linspace(0, 1, 1000))
    got = {r["id"]: r["value"] for r in scores.quantile_transform(long).collect()}
    want = np.interp(x, grid, np.linspace(0, 1, 1000))
    assert max(abs(got[i] - want[i]) for i in range(2500)) < 1e-9


def test_cleaning_with_statistics(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 2.0), (4, None), (5, float("nan")), (6, float("inf")), (7, float("-inf"))], "id int, v double")
    assert [r["v"] for r in clean_with_statistics(df, "v").orderBy("id").collect()] == [1.0, 5.0, 2.0, 2.0, 2.0, 5.0, 1.0]
    bad = df.where("id > 5")
    assert [r["v"] for r in clean_with_statistics(bad, "v").orderBy("id").collect()] == [None, None]
