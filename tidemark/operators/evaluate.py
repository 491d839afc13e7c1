"""Scores of predictions: errors overall and by slice, peaks, comparisons with a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import expected_hours
from tidemark.functions.measures import day_type, regime, share_of
from tidemark.operators.features import LABEL
from tidemark.operators.models import Model

# Models in the order of reports.
MODEL_ORDER = ["seasonal_naive", "eia_df", "xgb_a", "xgb_b"]


def error_measures(actual: str = LABEL, forecast: str = "prediction_mwh") -> list[Column]:
    error = F.col(forecast) - F.col(actual)
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("MAE_mwh"),
        F.sqrt(F.avg(error * error)).alias("RMSE_mwh"),
        (F.avg(F.try_divide(F.abs(error), F.abs(actual))) * 100).alias("MAPE_pct"),
        F.avg(error).alias("bias_mwh"),
    ]


def by(predictions: DataFrame, *dims: str) -> DataFrame:
    return predictions.groupBy("model", *dims).agg(*error_measures())


def overall(predictions: DataFrame) -> DataFrame:
    return by(predictions)


def by_day_type(predictions: DataFrame) -> DataFrame:
    return by(predictions.withColumn("day_type", day_type(F.col("is_holiday"), F.col("is_weekend"))), "day_type")


def by_regime(predictions: DataFrame) -> DataFrame:
    return by(predictions.withColumn("regime", regime(F.col("is_extreme"))), "regime")


def display_place(order: list[str] = MODEL_ORDER) -> Column:
    """A known model's place, or the one after all of them."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def display_order(scores: DataFrame, order: list[str] = MODEL_ORDER) -> DataFrame:
    """Known models in their fixed order, then the others by name."""
    return scores.orderBy(display_place(order), "model")


def versus(predictions: DataFrame, baseline: str = "eia_df") -> DataFrame:
    """Overall scores beside the baseline's, which a window over the few models pins to each row."""
    every = Window.partitionBy()
    pinned = lambda c: F.max(F.when(F.col("model") == baseline, F.col(c))).over(every)
    scores = overall(predictions).withColumns({"_mae": pinned("MAE_mwh"), "_mape": pinned("MAPE_pct")})
    return scores.withColumns({"MAE_vs_baseline_pct": F.try_divide(100 * (F.col("MAE_mwh") - F.col("_mae")), F.col("_mae")), "MAPE_vs_baseline_pp": F.col("MAPE_pct") - F.col("_mape")}).drop("_mae", "_mape")


def peak_metrics(predictions: DataFrame, require_full_day: bool = True, tz: str | None = None) -> DataFrame:
    """Per (model, local day): actual and predicted peak, their hours, errors. Of equal values the earliest target counts.

    A day counts only if whole: by its clock when ``tz`` is given, else if no local hour occurs
    twice and 23 are there (which also drops days of 25 hours).
    """
    keys = [c for c in ("region_id",) if c in predictions.columns] + ["model", "target_local_date"]
    first = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("target_timestamp_utc").cast("long")).alias("t"), F.col("target_local_hour").alias("h")))
    rows = predictions.filter(F.col(LABEL).isNotNull() & F.col("prediction_mwh").isNotNull())
    days = rows.groupBy(*keys).agg(first(LABEL).alias("a"), first("prediction_mwh").alias("p"), F.count(F.lit(1)).alias("hours"), F.size(F.collect_set("target_local_hour")).alias("clock_hours"), F.max("is_extreme").alias("is_extreme_day"))
    if require_full_day:
        days = days.filter(F.col("hours") == expected_hours(F.col("target_local_date"), tz) if tz else (F.col("hours") == F.col("clock_hours")) & (F.col("clock_hours") >= 23))
    gap = F.col("p.v") - F.col("a.v")
    return days.select(
        *keys,
        F.col("a.v").alias("actual_peak_mwh"),
        F.col("a.h").alias("actual_peak_hour"),
        F.col("p.v").alias("pred_peak_mwh"),
        F.col("p.h").alias("pred_peak_hour"),
        gap.alias("peak_magnitude_error_mwh"),
        F.try_divide(100 * gap, F.col("a.v")).alias("peak_magnitude_error_pct"),
        (F.col("p.h") - F.col("a.h")).cast("int").alias("peak_timing_error_hours"),
        "is_extreme_day",
    )


def peak_summary(peaks: DataFrame) -> DataFrame:
    pct, late = F.col("peak_magnitude_error_pct"), F.col("peak_timing_error_hours")
    return peaks.groupBy("model").agg(
        F.count(F.lit(1)).alias("days"),
        F.avg(pct).alias("pk_bias_pct"),
        F.avg(F.abs(pct)).alias("pk_MAPE_pct"),
        F.avg(F.abs(late)).alias("pk_timing_MAE_h"),
        share_of(late == 0).alias("pk_timing_hit_pct"),
        share_of(F.abs(late) <= 1).alias("pk_timing_within_1h_pct"),
    )


def error_pivot(predictions: DataFrame, rows: Column, models: list[str], value: str = "abs_error_mwh") -> DataFrame:
    """Mean error, a column for each of the given models."""
    return predictions.groupBy(rows.alias("slice")).pivot("model", models).agg(F.avg(value))


def worst_hours(predictions: DataFrame, n: int = 8) -> DataFrame:
    return predictions.orderBy(F.col("abs_error_mwh").desc_nulls_last(), "target_timestamp_utc", "model").limit(n)


def event_window(silver: DataFrame, start: str, end: str, reference_start: str, reference_end: str) -> DataFrame:
    """Daily shape of an event and its size against the reference window's maximum, in one pass over the table."""
    day, demand = F.col("local_date"), F.col("actual_demand_mwh")
    reference = day.between(F.lit(reference_start).cast("date"), F.lit(reference_end).cast("date"))
    days = silver.groupBy("region_id", "local_date").agg(F.max(demand).alias("max_mwh"), F.avg(demand).alias("mean_mwh"), F.min(demand).alias("min_mwh"))
    top = F.max(F.when(reference, F.col("max_mwh"))).over(Window.partitionBy("region_id"))
    shaped = days.withColumn("pct_of_reference", F.try_divide(F.col("max_mwh") * 100, top))
    return shaped.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def gate_scores(model: Model, train: DataFrame, scored: DataFrame) -> DataFrame:
    """Fit on ``train`` and score on one labelled holdout, as a row; empty or unlabelled input raises."""
    if train.isEmpty():
        raise ValueError("gate_score: no training row")
    if scored.isEmpty():
        raise ValueError("gate_score: no row to score")
    if not scored.filter(F.col(LABEL).isNull()).isEmpty():
        raise ValueError("gate_score: the holdout has rows without label")
    row = model.fit(train).transform(scored).agg(*error_measures())
    return row.select(F.lit(model.name).alias("model"), F.col("MAE_mwh").alias("gate_holdout_mae"), F.col("MAPE_pct").alias("gate_holdout_mape_pct"), F.col("bias_mwh").alias("gate_holdout_bias"), F.col("n").cast("double").alias("gate_holdout_rows"))


def gate_score(model: Model, train: DataFrame, scored: DataFrame) -> dict[str, float]:
    """``gate_scores`` as numbers for a registry."""
    return gate_scores(model, train, scored).drop("model").first().asDict()
