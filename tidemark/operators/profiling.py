"""Profiles of a feed and of hourly tables, each in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.functions.calendar import expected_hours
from tidemark.functions.measures import share_of
from tidemark.operators.orderstats import group_quantiles
from tidemark.sources.tables import staged


def facets(feed: DataFrame) -> DataFrame:
    """(respondent, type) with rows and first and last period."""
    return feed.groupBy("respondent", "type").agg(F.count(F.lit(1)).alias("rows"), F.min("period").alias("first_period"), F.max("period").alias("last_period"))


def yearly_coverage(hours: DataFrame, value: str = "actual_demand_mwh") -> DataFrame:
    """Hours present per region and year against the hours that the year has."""
    year = F.year("event_timestamp_utc")
    leap = F.dayofyear(F.make_date(F.col("year"), F.lit(12), F.lit(31))) * 24
    return hours.groupBy("region_id", year.alias("year")).agg(F.count(value).alias("hours")).withColumn("expected", leap)


def value_percentiles(feed: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of each type's numeric values, exact, without a type's values in one task."""
    values = staged(feed.select("type", F.col("value").try_cast("double").alias("v")).filter("v is not null"), "values")
    ends = values.groupBy("type").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    ranks = group_quantiles(values, ["type"], "v", {"p01": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}, continuous=False)
    return ranks.drop("n").join(ends, "type")


def first_seen(feed: DataFrame) -> DataFrame:
    """First period with a value, per type."""
    return feed.filter("value is not null").groupBy("type").agg(F.min("period").alias("first_period"))


def hour_profile(silver: DataFrame, value: str = "actual_demand_mwh") -> DataFrame:
    return silver.groupBy("region_id", "local_hour").agg(F.avg(value).alias("mean_mwh"), F.count(value).alias("hours"))


def cross_lag(spine: DataFrame, shifts: tuple[int, ...] = (-2, -1, 0, 1), demand: str = "actual_demand_mwh", forecast: str = "day_ahead_forecast_mwh") -> DataFrame:
    """Error and correlation of the forecast moved by each of a few hours; the shifts are joined on time, so no window is needed."""
    left = spine.select("region_id", "event_timestamp_utc", F.col(demand).alias("d"))
    moved = spine.select("region_id", F.col(forecast).alias("f"), F.col("event_timestamp_utc").alias("at"), F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    moved = moved.select("region_id", "f", "shift", F.timestamp_seconds(F.col("at").cast("long") + F.col("shift") * 3600).alias("event_timestamp_utc"))
    both = left.join(moved, ["region_id", "event_timestamp_utc"]).filter("d is not null and f is not null")
    return both.groupBy("shift").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("d") - F.col("f"))).alias("mae"), F.corr("d", "f").alias("corr"))


def publication_lag(feed: DataFrame, period_format: str = "yyyy-MM-dd'T'HH") -> DataFrame:
    """Hours between the newest ingestion and the newest period with a value, per type."""
    period = F.try_to_timestamp("period", F.lit(period_format)).cast("long")
    landed = F.try_to_timestamp("ingested_at").cast("long")
    ends = feed.filter("value is not null").groupBy("type").agg(F.max(landed).alias("landed"), F.max(period).alias("period"))
    return ends.select("type", ((F.col("landed") - F.col("period")) / 3600).alias("lag_hours"))


def null_rate_by_day_length(silver: DataFrame, tz: str = DEFAULT.tz, value: str = "actual_demand_mwh") -> DataFrame:
    """Share of hours without value on days of 24 hours and on the others."""
    ordinary = expected_hours(F.col("local_date"), tz) == 24
    return silver.groupBy(ordinary.alias("ordinary_day")).agg(F.count(F.lit(1)).alias("hours"), share_of(F.col(value).isNull()).alias("null_pct"))


def vintage_gap(weather: DataFrame, first: int = 1, second: int = 2, measure: str = "temperature_c") -> DataFrame:
    """Difference and correlation of two leads of one forecast hour."""
    at = lambda lead: F.max(F.when(F.col("forecast_lead_days") == lead, F.col(measure)))
    pairs = weather.groupBy("point_id", "valid_timestamp_utc").agg(at(first).alias("a"), at(second).alias("b")).filter("a is not null and b is not null")
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"), F.corr("a", "b").alias("corr"))


def training_bias_correlation(predictions: DataFrame, model: str) -> DataFrame:
    """Correlation over folds of training rows with the mean error."""
    folds = predictions.filter(F.col("model") == model).groupBy("fold").agg(F.max("train_rows").alias("rows"), F.avg("error_mwh").alias("bias"))
    return folds.agg(F.count(F.lit(1)).alias("folds"), F.corr("rows", "bias").alias("corr"))


def metric_coverage(silver: DataFrame, metrics: list[str]) -> DataFrame:
    """(region, metric, hours with a value) of each metric, in one pass."""
    counts = silver.groupBy("region_id").agg(F.count(F.lit(1)).alias("hours"), *[F.count(m).alias(m) for m in metrics])
    return counts.select("region_id", "hours", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("present")) for m in metrics])).alias("s")).select("region_id", "hours", "s.*")


def growth(daily: DataFrame) -> DataFrame:
    """Yearly mean of daily peaks and its change on the year before."""
    years = daily.groupBy("region_id", "year").agg(F.avg("peak_demand_mwh").alias("mean_peak"))
    before = F.lag("mean_peak").over(Window.partitionBy("region_id").orderBy("year"))
    return years.withColumn("growth_pct", F.try_divide(100 * (F.col("mean_peak") - before), before))
