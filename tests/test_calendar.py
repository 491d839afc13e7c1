"""Day lengths, holidays and the contract, against the standard library's zones."""

from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal

TZ = "America/New_York"


def test_day_lengths_follow_the_clock(spark):
    rows = cal.calendar_frame(spark, "1995-01-01", "2027-12-31", TZ).collect()
    zone = ZoneInfo(TZ)
    for r in rows:
        ends = [datetime(d.year, d.month, d.day, tzinfo=zone).astimezone(UTC) for d in (r.local_date, r.local_date + timedelta(days=1))]
        assert r.expected_hours == (ends[1] - ends[0]).total_seconds() / 3600
    assert len(rows) == 12053


@pytest.mark.parametrize(("day", "hours"), [("2023-03-12", 23), ("2023-11-05", 25), ("2026-03-08", 23), ("2026-11-01", 25), ("2023-07-01", 24)])
def test_known_days(spark, day, hours):
    assert spark.range(1).select(cal.expected_hours(F.lit(day).cast("date"), TZ).alias("h")).first().h == hours


@pytest.mark.parametrize(("year", "total"), [(2023, 8760), (2024, 8784)])
def test_a_year_has_its_hours(spark, year, total):
    assert cal.calendar_frame(spark, f"{year}-01-01", f"{year}-12-31").agg(F.sum("expected_hours")).first()[0] == total


def test_holidays(spark):
    names = {r.local_date: r.holiday_name for r in cal.with_holidays(cal.days_between(spark, "2024-01-01", "2026-12-31")).filter("is_holiday").collect()}
    assert {d for d in names if d.year == 2024} == {date(2024, 1, 1), date(2024, 5, 27), date(2024, 7, 4), date(2024, 9, 2), date(2024, 11, 28), date(2024, 12, 25)}
    assert {names[d] for d in (date(2026, 5, 25), date(2026, 9, 7), date(2026, 11, 26))} == {"memorial", "labor", "thanksgiving"}


@pytest.mark.parametrize(("day", "gap"), [("2024-11-28", 0), ("2024-11-29", 1), ("2024-11-27", -1), ("2024-12-27", 2), ("2024-12-31", -1)])
def test_distance_to_holiday(spark, day, gap):
    assert cal.with_holidays(cal.days_between(spark, day, day)).first().days_to_nearest_holiday == gap


def test_contract_moves_with_the_clock(spark):
    rows = cal.contract_frame(spark, "2026-03-07", "2026-03-08", TZ).collect()
    first = [r for r in rows if r.forecast_date == date(2026, 3, 7)]
    assert len(first) == 23 and len(rows) == 47
    assert 2 not in {r.target_local_hour for r in first}
    cutoffs = {r.forecast_date.day: r.cutoff_utc.hour for r in cal.contract_frame(spark, "2026-03-07", "2026-03-08", TZ).select("forecast_date", "cutoff_utc").collect()}
    assert cutoffs == {7: 15, 8: 14}
    assert len(cal.contract_frame(spark, "2026-10-31", "2026-10-31", TZ).collect()) == 25


def test_horizon(spark):
    low, high = cal.contract_frame(spark, "2024-01-01", "2025-12-31", TZ).agg(F.min("hours_ahead"), F.max("hours_ahead")).first()
    assert 13 <= low and high <= 39


def test_windows(spark):
    found = [(str(r[0]), str(r[1])) for r in cal.month_windows(spark, "2024-01-15", "2024-03-10").collect()]
    assert found == [("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-10")]
    chunks = [(str(r[0]), str(r[1])) for r in cal.month_chunks(spark, "2021-03-24", "2021-12-31").collect()]
    assert chunks == [("2021-03-24", "2021-09-23"), ("2021-09-24", "2021-12-31")]
