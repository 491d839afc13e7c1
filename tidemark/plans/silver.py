"""From landed feed rows to the silver tables and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FeedConfig
from tidemark.operators.hourly import add_local_time, align_day_ahead, attach_spine, flag_anomalies, pivot_hourly
from tidemark.operators.quality import classify, split_quarantine
from tidemark.operators.revisions import resolve_revisions

SILVER = ["region_id", "event_timestamp_utc", "local_timestamp", "local_date", "local_hour", "timezone", "actual_demand_mwh", "day_ahead_forecast_mwh", "day_ahead_forecast_as_published_mwh", "net_generation_mwh", "interchange_mwh", "is_missing_hour", "is_demand_anomaly_suspect", "is_above_historical_record", "revision_count", "ingested_at"]


def judged(feed: DataFrame, config: FeedConfig = DEFAULT, fallback_to_valid: bool = False) -> DataFrame:
    """The newest vintage of each key with the reason that rejects it, if any. Vintages are resolved before validation, so the newest counts even if it is invalid; ``fallback_to_valid`` validates first and keeps every rejected vintage."""
    if not fallback_to_valid:
        return classify(resolve_revisions(feed), config)
    rows = classify(feed, config)
    counts = {c: F.lit(None).cast(kind) for c, kind in (("vintage_count", "long"), ("revision_count", "int"), ("revision_count_nullsafe", "int"))}
    return resolve_revisions(rows.filter("reason is null")).unionByName(rows.filter("reason is not null").withColumns(counts))


def silver_hours(rows: DataFrame, config: FeedConfig = DEFAULT, spine: DataFrame | None = None) -> DataFrame:
    """The silver table of ``judged`` rows that pass. ``spine`` gives the hours to build where they are not those of the rows themselves."""
    hours = add_local_time(attach_spine(pivot_hourly(rows, config), config, spine), config.tz)
    return flag_anomalies(align_day_ahead(hours), config).select(*SILVER)


def build_silver(feed: DataFrame, config: FeedConfig = DEFAULT, fallback_to_valid: bool = False, spine: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(silver, quarantine) of a feed, as ``judged`` tells them apart."""
    valid, quarantine = split_quarantine(judged(feed, config, fallback_to_valid))
    return silver_hours(valid, config, spine), quarantine
