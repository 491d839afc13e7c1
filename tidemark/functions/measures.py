"""Row-level measures shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import DEGREE_DAY_BASE_C


def cooling_degrees(t: Column, base: float = DEGREE_DAY_BASE_C) -> Column:
    """NULL stays NULL: greatest() alone would turn a missing temperature into a mild one."""
    return F.when(t.isNotNull(), F.greatest(t - F.lit(base), F.lit(0.0)))


def heating_degrees(t: Column, base: float = DEGREE_DAY_BASE_C) -> Column:
    return F.when(t.isNotNull(), F.greatest(F.lit(base) - t, F.lit(0.0)))


def clean_value(value: str, *flags: str) -> Column:
    """The value where no flag is up; an unknown flag counts as up."""
    usable = F.col(value).isNotNull()
    for flag in flags:
        usable = usable & ~F.coalesce(F.col(flag), F.lit(True))
    return F.when(usable, F.col(value))


def signed_error(forecast: str, actual: str) -> Column:
    return F.col(forecast) - F.col(actual)


def absolute_percentage(forecast: str, actual: str) -> Column:
    return F.try_divide(F.abs(signed_error(forecast, actual)), F.abs(actual))


def run_id(region: Column, model: Column, version: Column, cutoff: Column) -> Column:
    return F.concat_ws("__", region, model, version, F.date_format(cutoff, "yyyyMMdd'T'HHmm'Z'"))


def day_type(is_holiday: Column, is_weekend: Column) -> Column:
    return F.when(is_holiday, F.lit("holiday")).when(is_weekend, F.lit("weekend")).otherwise(F.lit("weekday"))


def regime(is_extreme: Column) -> Column:
    return F.when(is_extreme, F.lit("extreme")).otherwise(F.lit("normal"))


def share_of(condition: Column) -> Column:
    """Percentage of rows that meet a condition, as an aggregate."""
    return F.avg(condition.cast("int")) * 100
