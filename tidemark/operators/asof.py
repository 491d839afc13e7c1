"""As-of joins, and features as they were known when the forecast was made.

A request asks, for a key and an instant, for the newest vintage that was known by then. Requests and vintages
are put into one order and the last vintage is carried forward. That runs per key and stretch of time, and a
second pass carries the newest vintage of each stretch over the small table of stretches, so that a key with
very many vintages or requests is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FeedConfig
from tidemark.operators.features import PREVIOUS_WEEK, PREVIOUS_WEEK_DAYS, ROLLING, ROLLING_ANCHOR_HOURS, ROLLING_HOURS, FeatureSpec, offsets, previous_week_mean
from tidemark.operators.hourly import REGION, TIME
from tidemark.operators.quality import classify

STRETCH_SECONDS = 7 * 24 * 3600


def as_of(requests: DataFrame, vintages: DataFrame, keys: list[str], at: str, known: str, values: list[str], seconds: int = STRETCH_SECONDS) -> DataFrame:
    """``requests`` with ``values`` and ``known`` of the newest vintage with ``known <= at``; NULLs where there is none.

    Of vintages known at one instant the one with the greatest values, in their order, counts. A vintage
    without an instant is known never; a request without one gets nothing; NULL keys match each other.
    """
    stretch = lambda c: F.floor(F.col(c).cast("double") / seconds).alias("_stretch")
    vintage = F.struct(F.col(known), *[F.col(v) for v in values]).alias("_vintage")
    given = vintages.filter(F.col(known).isNotNull()).select(*keys, stretch(known), F.col(known).alias("_at"), F.lit(0).alias("_kind"), vintage)
    own = F.struct(*[F.col(c) for c in requests.columns]).alias("_request")
    asked = requests.select(*keys, stretch(at), F.col(at).alias("_at"), F.lit(1).alias("_kind"), own)
    both = given.unionByName(asked, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_kind", "_vintage").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_near", F.last("_vintage", ignorenulls=True).over(inside)).filter("_kind = 1")
    newest = both.groupBy(*keys, "_stretch").agg(F.max("_vintage").alias("_newest"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.select(*[F.col(k).alias(f"_key_{n}") for n, k in enumerate(keys)], F.col("_stretch").alias("_of"), F.last("_newest", ignorenulls=True).over(earlier.partitionBy(*keys)).alias("_far"))
    same = F.col("_stretch").eqNullSafe(F.col("_of"))
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{n}"))
    got = found.join(carried, same, "left").withColumn("_got", F.when(F.col("_at").isNotNull(), F.coalesce("_near", "_far")))
    return got.select("_request.*", *[F.col("_got")[c].alias(c) for c in (known, *values)])


def known_demand(feed: DataFrame, config: FeedConfig = DEFAULT, kind: str = "D") -> DataFrame:
    """(region, hour, known_at, source_file, demand) of all vintages of a metric; an invalid one is NULL, and hides what was known before it."""
    rows = classify(feed.filter(F.col("type") == kind), config).filter(F.col(TIME).isNotNull() & F.col("respondent").isNotNull())
    valid = F.when(F.col("reason").isNull(), F.col("value_mwh"))
    return rows.select(F.col("respondent").alias(REGION), TIME, F.try_to_timestamp("ingested_at").alias("known_at"), "source_file", valid.alias("demand"))


def _asked(frame: DataFrame, row: list[str], wanted: dict[str, Column]) -> DataFrame:
    """A request for each named hour of each row."""
    hours = F.array(*[F.struct(F.lit(name).alias("name"), hour.alias(TIME)) for name, hour in wanted.items()])
    return frame.select(*row, F.col("cutoff_utc").alias("at"), F.explode(hours).alias("h")).select(*row, "at", "h.name", f"h.{TIME}")


def _answered(asked: DataFrame, vintages: DataFrame, row: list[str], names: list[str]) -> DataFrame:
    got = as_of(asked, vintages, [REGION, TIME], "at", "known_at", ["source_file", "demand"])
    return got.groupBy(*row).agg(*[F.max(F.when(F.col("name") == n, F.col("demand"))).alias(n) for n in names], F.max("known_at").alias("newest"))


def features_as_known(feed: DataFrame, contract: DataFrame, specs: list[FeatureSpec], config: FeedConfig = DEFAULT) -> DataFrame:
    """One row per (region, forecast date, target hour): the demand features from the vintages known at the cutoff.

    What was ingested later, a revision or a first value, changes nothing. ``newest_known_at`` is the ingestion
    of the newest vintage used. Flags of suspect values are not looked at, since they need the next day.
    """
    at_cutoff, at_target = offsets([s for s in specs if s.metric in (None, "D")])
    vintages = known_demand(feed, config)
    regions = vintages.select(REGION).distinct().agg(F.collect_set(REGION).alias("regions"))
    frame = contract.join(regions, F.lit(True)).withColumn(REGION, F.explode("regions")).drop("regions")
    back = lambda anchor, hours: F.timestamp_seconds(F.col(anchor).cast("long") - hours * 3600)
    rolling = {f"_hour_{k}": back("cutoff_utc", ROLLING_ANCHOR_HOURS + k) for k in range(ROLLING_HOURS)}
    by_date = {name: back("cutoff_utc", hours) for name, hours in at_cutoff.items()} | rolling
    by_target = {name: back("target_timestamp_utc", hours) for name, hours in at_target.items()} | {f"_day_{d}": back("target_timestamp_utc", 24 * d) for d in PREVIOUS_WEEK_DAYS}
    date_row, target_row = [REGION, "forecast_date"], [REGION, "forecast_date", "target_timestamp_utc"]
    dates = frame.select(*date_row, "cutoff_utc").distinct()
    of_date = _answered(_asked(dates, date_row, by_date), vintages, date_row, list(by_date)).withColumnRenamed("newest", "_newest_by_date")
    known = F.filter(F.array(*rolling), lambda v: v.isNotNull())
    size = F.size(known)
    mean = F.try_divide(F.aggregate(known, F.lit(0.0), lambda s, v: s + v), size)
    spread = F.aggregate(known, F.lit(0.0), lambda s, v: s + (v - F.col(ROLLING[0])) * (v - F.col(ROLLING[0])))
    of_date = of_date.withColumn(ROLLING[0], mean).withColumn(ROLLING[1], F.when(size > 1, F.sqrt(spread / (size - 1)))).drop(*rolling)
    of_target = _answered(_asked(frame, target_row, by_target), vintages, target_row, list(by_target)).withColumnRenamed("newest", "_newest_by_target")
    parts = [f"_day_{d}" for d in PREVIOUS_WEEK_DAYS]
    of_target = of_target.withColumn(PREVIOUS_WEEK, previous_week_mean(parts)).drop(*parts)
    out = frame.join(of_date, date_row, "left").join(of_target, target_row, "left")
    return out.withColumn("newest_known_at", F.greatest("_newest_by_date", "_newest_by_target")).drop("_newest_by_date", "_newest_by_target")
