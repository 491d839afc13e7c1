"""Rolling-origin backtests: monthly folds, thresholds from training labels, predictions on identical rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.operators.features import BENCHMARK, LABEL
from tidemark.operators.models import GbtModel, Model, fit_models
from tidemark.operators.orderstats import order_statistics, segments_of

CARRY = ["region_id", "forecast_date", "cutoff_utc", "target_timestamp_utc", "target_local_date", "target_local_hour", "hours_ahead", "is_weekend", "is_holiday", "days_to_nearest_holiday", LABEL, "label_is_suspect"]
BENCHMARK_MODEL = "eia_df"


def monthly_folds(dates: DataFrame, min_train_months: int = 12, window_months: int | None = None, embargo_days: int = 0, column: str = "forecast_date") -> DataFrame:
    """(fold, fold_label, train_start, train_end, test_start, test_end): one per month after a warm-up.

    ``window_months`` makes the training window slide; ``embargo_days`` ends it earlier, so that the
    last training labels do not reach past the first test cutoff.
    """
    ends = dates.agg(F.min(F.to_date(column)).alias("first"), F.max(F.to_date(column)).alias("last")).filter("first is not null")
    months = ends.select("first", "last", F.posexplode(F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))).alias("number", "month"))
    months = months.filter(F.col("number") >= min_train_months)
    start = F.greatest("first", F.add_months("month", -window_months)) if window_months is not None else F.col("first")
    folds = months.select("month", start.alias("train_start"), F.date_sub("month", 1 + embargo_days).alias("train_end"), F.greatest("month", "first").alias("test_start"), F.least(F.last_day("month"), "last").alias("test_end"))
    folds = folds.filter("test_start <= test_end and train_end >= train_start")
    number = (F.row_number().over(Window.orderBy("month")) - 1).cast("int")
    return folds.select(number.alias("fold"), F.date_format("month", "yyyy-MM").alias("fold_label"), "train_start", "train_end", "test_start", "test_end")


def training_stats(features: DataFrame, folds: DataFrame, quantile: float = DEFAULT.extreme_quantile) -> DataFrame:
    """Per fold: labelled training rows and the threshold of extremes, from training labels alone.

    Labels are counted by stretch of days between the folds' ends, and a fold is a range of stretches, so no
    label is copied into the folds that hold it. Folds are as many as months.
    """
    labels = features.filter(F.col(LABEL).isNotNull()).select(F.to_date("forecast_date").alias("day"), F.col(LABEL).alias("v"))
    days, windows = segments_of(folds.withColumn("window", F.col("fold")), "train_start", "train_end")
    found = order_statistics(labels.join(days, "day"), windows, {"extreme_threshold_mwh": quantile}, [])
    return found.select(F.col("window").alias("fold"), F.col("n").alias("train_rows"), "extreme_threshold_mwh")


def test_rows(features: DataFrame, folds: DataFrame, quantile: float = DEFAULT.extreme_quantile) -> DataFrame:
    """Test rows of all folds with their fold's columns. A date is in one test month at most, so this is an equi-join on the month."""
    keyed = folds.withColumn("_month", F.trunc("test_start", "MM")).join(training_stats(features, folds, quantile), "fold")
    rows = features.withColumn("_month", F.trunc(F.to_date("forecast_date"), "MM")).join(keyed, "_month")
    inside = rows.filter(F.to_date("forecast_date").between(F.col("test_start"), F.col("test_end")))
    return inside.withColumn("is_extreme", F.coalesce(F.col(LABEL) >= F.col("extreme_threshold_mwh"), F.lit(False))).drop("_month")


def with_errors(predictions: DataFrame) -> DataFrame:
    error = F.col("prediction_mwh") - F.col(LABEL)
    ape = F.when(F.abs(LABEL) > 0, F.try_divide(F.abs(error), F.abs(LABEL)))
    return predictions.withColumns({"error_mwh": error, "abs_error_mwh": F.abs(error), "ape": ape})


def run_backtest(features: DataFrame, models: list[Model], folds: DataFrame, quantile: float = DEFAULT.extreme_quantile) -> DataFrame:
    """Long predictions, one row per (fold, model, target).

    Models that fit nothing score all folds in one plan. Boosted trees of all folds and models grow together
    and score all folds in one plan a model. Other models fit once per fold, on the driver's list of folds, a
    row for each month.
    """
    tests = test_rows(features, folds, quantile)
    carry = [c for c in CARRY if c in features.columns]
    columns = [*carry, "fold", "fold_label", "train_end", "train_rows", "extreme_threshold_mwh", "is_extreme"]
    long = lambda m, rows: rows.select(*columns, F.lit(m.name).alias("model"), "prediction_mwh")
    parts = [long(m, m.transform(tests)) for m in models if not m.needs_fit]
    trees = [m for m in models if isinstance(m, GbtModel)]
    others = [m for m in models if m.needs_fit and not isinstance(m, GbtModel)]
    held = folds.orderBy("fold").collect() if trees or others else []
    if trees and held:
        boosters = fit_models(features, trees, [(f["train_start"], f["train_end"]) for f in held])
        for m in trees:
            parts.append(long(m, m.predict_by(tests, F.col("fold"), {f["fold"]: boosters[m.name, w] for w, f in enumerate(held)})))
    elif trees:
        parts += [long(m, tests.withColumn("prediction_mwh", F.lit(None).cast("double"))) for m in trees]
    for fold in held if others else []:
        train = features.filter(F.to_date("forecast_date").between(F.lit(fold["train_start"]), F.lit(fold["train_end"])))
        parts += [long(m, m.fit(train).transform(tests.filter(F.col("fold") == fold["fold"]))) for m in others]
    return with_errors(reduce(DataFrame.unionByName, parts))


def scoreable(predictions: DataFrame, require_benchmark: bool = True, benchmark: str = BENCHMARK_MODEL) -> DataFrame:
    """Rows with label and prediction, where the benchmark also has one."""
    scored = predictions.filter(F.col(LABEL).isNotNull() & F.col("prediction_mwh").isNotNull())
    if not require_benchmark:
        return scored
    key = [c for c in ("region_id", "forecast_date", "target_timestamp_utc") if c in predictions.columns]
    return scored.join(scored.filter(F.col("model") == benchmark).select(*key).distinct(), key, "left_semi")


__all__ = ["BENCHMARK", "monthly_folds", "run_backtest", "scoreable", "test_rows", "training_stats"]
