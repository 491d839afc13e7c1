"""The boosted-tree query: every fold, default settings, and predictions of folds that were really fitted."""

import pytest
from pyspark.sql import functions as F

from tests.test_backtest_registry import frame
from tidemark.operators import backtest, models
from tidemark.operators.features import LABEL
from tidemark.operators.models import GbtModel
from tidemark.plans import catalogue


def test_every_fold_with_default_settings(spark, monkeypatch):
    seen = {}
    folds = spark.createDataFrame([(k,) for k in range(5)], "fold int")
    monkeypatch.setattr(catalogue.a, "order_features", lambda *_: spark.range(1))
    monkeypatch.setattr(catalogue, "_folds", lambda *_: folds)
    monkeypatch.setattr(catalogue.backtest, "run_backtest", lambda rows, trees, given: seen.update(trees=trees, folds=given))
    catalogue.gbt_backtest(spark, "unused")
    assert sorted(r.fold for r in seen["folds"].collect()) == [0, 1, 2, 3, 4]
    assert [m.settings for m in seen["trees"]] == [GbtModel("plain", []).settings] * 2
    assert (GbtModel("plain", []).settings["rounds"], GbtModel("plain", []).settings["depth"]) == (50, 5)


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark, months=15, step=6)


def test_folds_fitted_together_equal_folds_fitted_alone(data):
    """Each fold's model, fitted by itself on the fold's training rows, gives the same predictions."""
    inputs = ["target_local_hour", "demand_same_hour_minus_7d"]
    make = lambda: [GbtModel("plain", inputs, rounds=6, depth=3), models.GbtRatioModel("ratio", inputs, baseline="f1", rounds=6, depth=3), models.GbtRatioModel("short", inputs, baseline="f1", rounds=2, depth=2)]
    folds = backtest.monthly_folds(data.select("forecast_date"))
    made = backtest.run_backtest(data, [models.published_benchmark(), *make()], folds).cache()
    assert {r.model: r["count"] for r in made.groupBy("model").count().collect()} == dict.fromkeys(("eia_df", "plain", "ratio", "short"), made.filter("model = 'eia_df'").count())
    fold = folds.filter("fold = 1").first()
    train = data.filter(F.col("forecast_date").between(fold.train_start, fold.train_end))
    test = data.filter(F.col("forecast_date").between(fold.test_start, fold.test_end))
    for model in make():
        alone = {r.target_timestamp_utc: r.prediction_mwh for r in model.fit(train).transform(test).collect()}
        together = {r.target_timestamp_utc: r.prediction_mwh for r in made.filter((F.col("model") == model.name) & (F.col("fold") == 1)).collect()}
        assert together == alone and len(alone) > 0
    errors = {r.model: r.e for r in made.groupBy("model").agg(F.avg("abs_error_mwh").alias("e")).collect()}
    level = data.agg(F.stddev(LABEL)).first()[0]
    assert errors["plain"] < level and errors["ratio"] < 0.1 * level


def test_the_future_changes_no_fold(data):
    """Labels after a fold's training window do not reach its model."""
    inputs = ["target_local_hour", "f2"]
    folds = backtest.monthly_folds(data.select("forecast_date")).filter("fold < 2")
    cut = folds.filter("fold = 0").first().train_end
    bent = data.withColumn(LABEL, F.when(F.col("forecast_date") <= F.lit(cut), F.col(LABEL)).otherwise(F.col(LABEL) * 3)).withColumn("f2", F.when(F.col("forecast_date") <= F.lit(cut), F.col("f2")).otherwise(F.col("f2") + 0.5))
    fit = lambda rows: models.fit_models(rows, [GbtModel("m", inputs, rounds=2, depth=2)], [(f.train_start, f.train_end) for f in folds.orderBy("fold").collect()])
    one, two = fit(data), fit(bent)
    same = lambda k: one["m", k].trees.value.tolist() == two["m", k].trees.value.tolist() and one["m", k].trees.cut.tolist() == two["m", k].trees.cut.tolist()
    assert same(0) and not same(1)
