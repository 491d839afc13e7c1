"""Local days, holidays and the forecast contract as Catalyst expressions; no Python rows, no UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT



def one_hour() -> Column:
    return F.expr("interval 1 hour")

# How each holiday's date follows from its year.
HOLIDAY_DATES = {
    "new_year": "make_date({y}, 1, 1)",
    "memorial": "date_sub(next_day(make_date({y}, 5, 31), 'MO'), 7)",
    "independence": "make_date({y}, 7, 4)",
    "labor": "next_day(make_date({y}, 8, 31), 'MO')",
    "thanksgiving": "date_add(next_day(make_date({y}, 10, 31), 'TH'), 21)",
    "christmas": "make_date({y}, 12, 25)",
}


def local_midnight_utc(day: Column, tz: str = DEFAULT.tz) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), tz)


def expected_hours(day: Column, tz: str = DEFAULT.tz) -> Column:
    """Hours of a local day: 23, 24 or 25, from its two midnights."""
    seconds = local_midnight_utc(F.date_add(day, 1), tz).cast("long") - local_midnight_utc(day, tz).cast("long")
    return (seconds / 3600).cast("int")


def local_hours(day: Column, tz: str = DEFAULT.tz) -> Column:
    """All UTC hours of a local day, in order."""
    return F.sequence(local_midnight_utc(day, tz), local_midnight_utc(F.date_add(day, 1), tz) - one_hour(), one_hour())


def cutoff_utc(day: Column, hour: int = DEFAULT.cutoff_local_hour, tz: str = DEFAULT.tz) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr(f"interval {hour} hours"), tz)


def hours_between(earlier: Column, later: Column) -> Column:
    return (later.cast("long") - earlier.cast("long")) / F.lit(3600)


def holiday_date(name: str, year: Column | str) -> Column:
    return F.expr(HOLIDAY_DATES[name].format(y=year))


def holiday_name(day: str) -> Column:
    """Name of the holiday that a date column is, else NULL."""
    return F.coalesce(*[F.when(F.col(day) == holiday_date(name, f"year({day})"), F.lit(name)) for name in HOLIDAY_DATES])


def days_to_nearest_holiday(day: str) -> Column:
    """Signed distance to the closest holiday, negative before it; the earlier one wins a tie."""
    near = [F.struct(F.abs(gap).alias("far"), F.lit(rank).alias("rank"), gap.alias("gap")) for rank, gap in enumerate(F.datediff(F.col(day), holiday_date(name, f"(year({day}) + {shift})")) for shift in (-1, 0, 1) for name in HOLIDAY_DATES)]
    return F.array_min(F.array(*near))["gap"]


def iso_weekday(day: Column) -> Column:
    return F.weekday(day) + 1


def days_between(spark: SparkSession, start: str, end: str, name: str = "local_date") -> DataFrame:
    """One row per date, both ends included, generated on the executors."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))).alias(name))


def with_calendar(days: DataFrame, day: str = "local_date", tz: str = DEFAULT.tz) -> DataFrame:
    d = F.col(day)
    return days.withColumns({"expected_hours": expected_hours(d, tz), "is_weekend": F.weekday(d) >= 5, "day_of_week": iso_weekday(d), "month": F.month(d), "year": F.year(d)})


def calendar_frame(spark: SparkSession, start: str, end: str, tz: str = DEFAULT.tz) -> DataFrame:
    """local_date, expected_hours, is_weekend, day_of_week, month, year."""
    return with_calendar(days_between(spark, start, end), tz=tz)


def with_holidays(days: DataFrame, day: str = "local_date") -> DataFrame:
    name = holiday_name(day)
    return days.withColumns({"holiday_name": name, "is_holiday": name.isNotNull(), "days_to_nearest_holiday": days_to_nearest_holiday(day)})


def contract_frame(spark: SparkSession, start: str, end: str, tz: str = DEFAULT.tz, cutoff_hour: int = DEFAULT.cutoff_local_hour) -> DataFrame:
    """One row per (forecast date, UTC hour of the next local day), with the clock features of the target."""
    dates = days_between(spark, start, end, "forecast_date")
    hours = dates.select("forecast_date", cutoff_utc(F.col("forecast_date"), cutoff_hour, tz).alias("cutoff_utc"), F.date_add("forecast_date", 1).alias("target_local_date"))
    hours = hours.select("*", F.explode(local_hours(F.col("target_local_date"), tz)).alias("target_timestamp_utc"))
    target = F.col("target_local_date")
    hours = hours.withColumns(
        {
            "target_local_hour": F.hour(F.from_utc_timestamp("target_timestamp_utc", tz)),
            "hours_ahead": F.round(hours_between(F.col("cutoff_utc"), F.col("target_timestamp_utc")), 2),
            "day_of_week": iso_weekday(target),
            "month": F.month(target),
            "day_of_year": F.dayofyear(target),
            "is_weekend": F.weekday(target) >= 5,
            "is_holiday": holiday_name("target_local_date").isNotNull(),
            "days_to_nearest_holiday": days_to_nearest_holiday("target_local_date"),
        }
    )
    first = ["forecast_date", "cutoff_utc", "target_timestamp_utc", "target_local_date", "target_local_hour", "hours_ahead"]
    return hours.select(*first, "day_of_week", "month", "day_of_year", "is_weekend", "is_holiday", "days_to_nearest_holiday")


def month_windows(spark: SparkSession, start: str, end: str, months: int = 1) -> DataFrame:
    """(window_start, window_end): blocks of whole calendar months, cut to the range."""
    first = F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.lit(end).cast("date"), F.expr(f"interval {months} month"))
    blocks = spark.range(1).select(F.explode(first).alias("m"))
    last = F.last_day(F.add_months("m", months - 1))
    return blocks.select(F.greatest("m", F.lit(start).cast("date")).alias("window_start"), F.least(last, F.lit(end).cast("date")).alias("window_end"))


def month_chunks(spark: SparkSession, start: str, end: str, months: int = 6) -> DataFrame:
    """As ``month_windows``, counted from the start date instead of the calendar's months."""
    steps = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"interval {months} month"))
    blocks = spark.range(1).select(F.explode(steps).alias("window_start"))
    return blocks.select("window_start", F.least(F.date_sub(F.add_months("window_start", months), 1), F.lit(end).cast("date")).alias("window_end"))
