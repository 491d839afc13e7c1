"""Latest vintage per key and counts of revisions, in one aggregation with map-side combining."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FEED_KEY = ["period", "respondent", "type"]
WEATHER_KEY = ["valid_timestamp_utc", "point_id", "forecast_lead_days"]


def resolve_revisions(feed: DataFrame, key: list[str] = FEED_KEY, order: list[str] | None = None, value: str = "value") -> DataFrame:
    """The newest vintage of each key with ``vintage_count`` and the two revision counts.

    Newest by ``order``, most significant first; ties are settled by all other columns, so the
    result does not depend on row order. ``revision_count`` does not see NULL values (a key with
    NULL only has -1); ``revision_count_nullsafe`` counts NULL as a value.
    """
    order = order or [c for c in ("ingested_at", "source_file", value) if c in feed.columns]
    rest = [c for c in feed.columns if c not in key and c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_newest")
    values = F.size(F.collect_set(value))
    counted = feed.groupBy(*key).agg(
        newest,
        F.count(F.lit(1)).alias("vintage_count"),
        (values - 1).alias("revision_count"),
        (values + F.max(F.col(value).isNull().cast("int")) - 1).alias("revision_count_nullsafe"),
    )
    wide = counted.select(*key, "_newest.*", "vintage_count", "revision_count", "revision_count_nullsafe")
    return wide.select(*feed.columns, "vintage_count", "revision_count", "revision_count_nullsafe")


def latest_vintage(rows: DataFrame, key: list[str] = WEATHER_KEY, order: list[str] | None = None) -> DataFrame:
    """Top row per key by window; the planner limits each group before the shuffle."""
    order = order or ["ingested_at", *[c for c in ("source_file",) if c in rows.columns]]
    by = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn")


def repeated_keys(feed: DataFrame, key: list[str] = FEED_KEY) -> DataFrame:
    """Keys that have more than one vintage, with their counts."""
    return feed.groupBy(*key).agg(F.count(F.lit(1)).alias("vintages")).filter("vintages > 1")


def revision_report(silver: DataFrame) -> DataFrame:
    return silver.agg(F.sum((F.col("revision_count") > 0).cast("long")).alias("revised_rows"), F.max("revision_count").alias("most_revisions"))
