"""Folds, backtests, scores, forecast tables, models and the registry."""

import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, evaluate, forecast, models
from tidemark.operators.features import LABEL
from tidemark.operators.registry import Registry, decide_promotion, describe_comparison

SCHEMA = "region_id string, forecast_date date, cutoff_utc timestamp, target_timestamp_utc timestamp, target_local_date date, target_local_hour int, hours_ahead double, is_weekend boolean, is_holiday boolean, days_to_nearest_holiday int, demand_same_hour_minus_7d double, benchmark_eia_df_mwh double, f1 double, f2 double, label_demand_mwh double, label_is_suspect boolean"


def frame(spark, start=date(2021, 1, 1), months=20, step=3):
    rows, day = [], start
    while day < start + timedelta(days=30 * months):
        for h in range(24):
            label = 100000 + 20000 * math.sin(2 * math.pi * h / 24) + 500 * (day.month - 6)
            target = datetime(day.year, day.month, day.day) + timedelta(days=1, hours=h)
            rows.append(("R0", day, datetime(day.year, day.month, day.day, 15), target, target.date(), h, 9.0 + h, target.weekday() >= 5, False, 0, 0.98 * label, 1.01 * label, 0.99 * label, float(h), label, False))
        day += timedelta(days=step)
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def data(spark):
    return frame(spark)


@pytest.fixture(scope="module")
def folds(data):
    return backtest.monthly_folds(data.select("forecast_date"))


@pytest.fixture(scope="module")
def scored(data, folds):
    return backtest.run_backtest(data, [models.seasonal_naive(), models.published_benchmark()], folds).cache()


def test_folds_never_see_the_future_and_expand(data, folds):
    rows = folds.orderBy("fold").collect()
    assert all(r.train_end < r.test_start <= r.test_end for r in rows)
    assert {r.train_start for r in rows} == {date(2021, 1, 1)} and rows[0].fold_label == "2022-01" and [r.fold for r in rows] == list(range(len(rows)))


def test_sliding_and_embargo(data):
    rows = backtest.monthly_folds(data.select("forecast_date"), window_months=6, embargo_days=1).orderBy("fold").collect()
    assert rows[1].train_start == date(2021, 8, 1) and rows[1].train_end == date(2022, 1, 30)


def test_no_dates_no_folds(data):
    assert backtest.monthly_folds(data.select("forecast_date").limit(0)).isEmpty()


def test_models_share_rows(scored):
    counts = scored.groupBy("fold", "target_timestamp_utc").count().select("count").distinct().collect()
    assert [r[0] for r in counts] == [2]


def test_threshold_is_from_training_labels(data, folds, scored):
    fold = folds.filter("fold = 2").first()
    labels = sorted(r[0] for r in data.filter(F.col("forecast_date").between(fold.train_start, fold.train_end)).select(LABEL).collect())
    place = 0.95 * (len(labels) - 1)
    low = int(place)
    want = labels[low] + (place - low) * (labels[low + 1] - labels[low])
    assert scored.filter("fold = 2").first().extreme_threshold_mwh == pytest.approx(want)


def test_a_perfect_model_scores_zero(data, folds):
    perfect = backtest.run_backtest(data, [models.ColumnModel("perfect", LABEL)], folds)
    row = evaluate.overall(perfect).first()
    assert (row.MAE_mwh, row.RMSE_mwh, row.bias_mwh) == (0, 0, 0)


def test_errors_and_baseline(scored):
    rows = {r.model: r for r in evaluate.versus(scored).collect()}
    assert rows["seasonal_naive"].MAPE_pct == pytest.approx(2) and rows["eia_df"].MAPE_pct == pytest.approx(1)
    assert rows["eia_df"].MAE_vs_baseline_pct == 0 and rows["seasonal_naive"].MAE_vs_baseline_pct == pytest.approx(100)
    assert [r.model for r in evaluate.display_order(evaluate.overall(scored)).collect()] == ["seasonal_naive", "eia_df"]


def test_scoreable_needs_the_benchmark(scored):
    holed = scored.withColumn("prediction_mwh", F.when(~((F.col("model") == "eia_df") & (F.col("target_local_hour") == 3)), F.col("prediction_mwh")))
    kept = backtest.scoreable(holed)
    assert kept.filter("target_local_hour = 3").isEmpty()
    assert not backtest.scoreable(holed, require_benchmark=False).filter("target_local_hour = 3").isEmpty()


def test_peaks_need_whole_days(scored):
    first = scored.agg(F.min("target_local_date")).first()[0]
    part = scored.filter(~((F.col("target_local_date") == first) & (F.col("target_local_hour") < 5)))
    assert evaluate.peak_metrics(part).filter(F.col("target_local_date") == first).isEmpty()
    row = evaluate.peak_summary(evaluate.peak_metrics(scored, tz="UTC")).filter("model = 'eia_df'").first()
    assert row.pk_timing_hit_pct == 100 and row.pk_MAPE_pct == pytest.approx(1)


def test_equal_peaks_take_the_first_hour(spark, scored):
    flat = scored.withColumn(LABEL, F.lit(1.0)).withColumn("prediction_mwh", F.lit(2.0))
    assert {(r.actual_peak_hour, r.pred_peak_hour) for r in evaluate.peak_metrics(flat).collect()} == {(0, 0)}


def test_slices(scored):
    assert {r.day_type for r in evaluate.by_day_type(scored).collect()} == {"weekday", "weekend"}
    assert {r.regime for r in evaluate.by_regime(scored).collect()} <= {"extreme", "normal"}
    assert evaluate.worst_hours(scored).count() == 8


def test_forecast_tables(scored):
    made = forecast.build_all(scored)
    run = made["forecast_run"].orderBy("forecast_run_id").first()
    assert run.forecast_run_id == f"R0__eia_df__v1.0.0__{run.cutoff_utc:%Y%m%dT%H%MZ}" and run.n_targets == 24
    assert made["forecast_prediction"].count() == scored.count()
    peaks = made["forecast_accuracy"].filter("is_peak").groupBy("model", "target_local_date").count().select("count").distinct().collect()
    assert [r[0] for r in peaks] == [1]


def test_regions_stay_apart(scored):
    two = scored.withColumn("region_id", F.when(F.col("target_local_hour") < 12, "R0").otherwise("R1"))
    made = forecast.build_all(two)
    runs = made["forecast_run"].collect()
    assert {(r.region_id, r.n_targets) for r in runs} == {("R0", 12), ("R1", 12)}
    assert all(r.forecast_run_id.startswith(f"{r.region_id}__") for r in runs) and len({r.forecast_run_id for r in runs}) == len(runs)
    run_of = {r.forecast_run_id: r.region_id for r in runs}
    assert all(run_of[r.forecast_run_id] == r.region_id for r in made["forecast_prediction"].collect())
    peaks = made["forecast_accuracy"].filter("is_peak").groupBy("region_id", "model", "target_local_date").count().select("region_id", "count").distinct().collect()
    assert sorted(map(tuple, peaks)) == [("R0", 1), ("R1", 1)]
    assert forecast.peak_hit(made["forecast_accuracy"]).filter("model = 'eia_df'").first().days == 2 * scored.select("target_local_date").distinct().count()


def test_threshold_is_per_region(spark):
    hours = [(r, datetime(2024, 1, 1) + timedelta(hours=k), float(k + 1000 * n), False, False, k % 24) for n, r in enumerate(("R0", "R1", "R2")) for k in range(48)]
    silver = spark.createDataFrame(hours, "region_id string, event_timestamp_utc timestamp, actual_demand_mwh double, is_demand_anomaly_suspect boolean, is_above_historical_record boolean, local_hour int")
    runs = spark.createDataFrame([("R0", date(2024, 1, 2)), ("R1", date(2024, 1, 3)), ("R1", None), ("R2", None)], "region_id string, training_data_end date")
    found = {r.region_id: r.extreme_threshold_mwh for r in forecast.serving_threshold(silver, runs, 0.5).collect()}
    assert found == {"R0": 12.0, "R1": 1023.5}


def test_version_comes_from_the_predictions(scored):
    assert forecast.forecast_runs(scored.withColumn("model_version", F.lit("7"))).first().model_version == "7"


def small(data):
    return data.filter("forecast_date < date'2021-03-01'")


def test_trees_are_repeatable_and_guard_their_input(data):
    train = small(data)
    fit = lambda: models.GbtModel("gbt", ["f1", "f2"], rounds=3, depth=3).fit(train)
    a, b = fit(), fit()
    score = lambda m: m.transform(train).agg(F.sum("prediction_mwh")).first()[0]
    assert score(a) == score(b)
    assert a.importance()[0][0] == "f1"
    with pytest.raises(ValueError, match="lacks f2"):
        a.transform(train.drop("f2"))
    with pytest.raises(RuntimeError):
        models.GbtModel("new", ["f1"]).transform(train)
    with pytest.raises(ValueError, match="no labelled row"):
        models.GbtModel("none", ["f1"]).fit(train.withColumn(LABEL, F.lit(None).cast("double")))
    holed = train.withColumn("f1", F.when(F.col("f2") > 3, F.col("f1")))
    assert a.transform(holed).filter("prediction_mwh is null").isEmpty()


def test_ratio_model_ignores_the_level(data):
    train = small(data).withColumn("level", F.lit(100000.0))
    ratio = models.GbtRatioModel("ratio", ["f2"], baseline="level", rounds=3, depth=3).fit(train)
    one = ratio.transform(train).agg(F.avg("prediction_mwh")).first()[0]
    two = ratio.transform(train.withColumn("level", F.lit(200000.0))).agg(F.avg("prediction_mwh")).first()[0]
    assert two == pytest.approx(2 * one)


def test_gate_score(data):
    train = small(data)
    holdout = data.filter("forecast_date >= date'2021-03-01' and forecast_date < date'2021-03-15'")
    make = lambda: models.GbtModel("gate", ["f1", "f2"], rounds=3, depth=3)
    assert evaluate.gate_score(make(), train, holdout) == evaluate.gate_score(make(), train, holdout)
    for bad in (train.limit(0), holdout.limit(0)):
        with pytest.raises(ValueError):
            evaluate.gate_score(make(), bad if bad.isEmpty() else train, holdout.limit(0))
    with pytest.raises(ValueError, match="without label"):
        evaluate.gate_score(make(), train, holdout.withColumn(LABEL, F.lit(None).cast("double")))


@pytest.mark.parametrize(("candidate", "champion", "promote"), [(100, None, True), (102, 100, True), (102.1, 100, False), (90, 100, True)])
def test_promotion_band(candidate, champion, promote):
    assert decide_promotion(candidate, champion).promote is promote


def test_comparison_basis():
    assert [describe_comparison("a", x).informative for x in (None, "a", "b")] == [False, False, True]


def test_registry(spark, data, tmp_path):
    registry = Registry(spark, str(tmp_path))
    assert registry.aliased("m") is None and registry.champion_training_cutoff("m") is None
    model = models.GbtModel("gbt", ["f1", "f2"], rounds=2, depth=2)
    with pytest.raises(ValueError):
        registry.register("m", model, "first")
    model.fit(small(data))
    assert registry.register("m", model, "first") == 1
    assert registry.aliased("m") is None  # registering does not promote
    assert registry.register("m", model, "second", {"gate_model_trained_through": "2021-02-28"}, {"mae": 1}) == 2
    registry.set_alias("m", 1)
    with pytest.raises(RuntimeError, match="does not record"):
        registry.champion_training_cutoff("m")
    registry.set_alias("m", 2)
    assert registry.champion_training_cutoff("m") == "2021-02-28"
    with pytest.raises(ValueError):
        registry.set_alias("m", 9)
    loaded, rows = registry.load("m"), small(data)
    shuffled = rows.select("f2", "f1", *[c for c in rows.columns if c not in ("f1", "f2")]).withColumn("extra", F.lit(1))
    assert loaded.transform(shuffled).agg(F.sum("prediction_mwh")).first()[0] == pytest.approx(model.transform(rows).agg(F.sum("prediction_mwh")).first()[0])


def test_a_ratio_model_comes_back_whole(spark, data, tmp_path):
    rows = small(data).withColumn("level", F.lit(90000.0))
    registry = Registry(spark, str(tmp_path))
    model = models.GbtRatioModel("ratio", ["f1", "f2"], "level", rounds=2, depth=2).fit(rows)
    registry.set_alias("m", registry.register("m", model, "first"))
    loaded = registry.load("m")
    assert isinstance(loaded, models.GbtRatioModel) and loaded.baseline == "level" and loaded.features == ["f1", "f2"]
    mean = lambda m: m.transform(rows).agg(F.avg("prediction_mwh")).first()[0]
    assert mean(loaded) == mean(model) > 50000
    with pytest.raises(ValueError, match="lacks level"):
        loaded.transform(rows.drop("level"))
    with pytest.raises(ValueError, match="no model class"):
        models.restored("m", ["f1"], {"class": "Other"}, model.fitted)


def test_promotions_as_a_table(spark):
    scores = spark.createDataFrame([(1, "a", 102.0), (1, "b", 100.0), (2, "a", 103.0), (2, "b", 100.0), (3, "a", 5.0)], "fold int, model string, MAE_mwh double")
    assert {r.fold: r.promote for r in registry_promotions(scores).collect()} == {1: True, 2: False, 3: True}


def registry_promotions(scores):
    from tidemark.operators.registry import promotions

    return promotions(scores, "a", "b", keys=("fold",))
