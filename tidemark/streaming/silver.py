"""Silver hours as a stream: one state, keyed by the hour that a row tells something about.

An hour of silver needs its own values, the day-ahead forecast of the hour before, and the demand a day before and
after. Instead of joining the stream with itself three times, each vintage is sent to every hour that needs it, with
its role there; the watermark is on that hour. Two aggregations follow: the newest vintage of each key and role, then
all roles of an hour in one row, which is written once the watermark has passed it.

A vintage for hour h tells something about h - 24 hours, while one for the newest hour moves the watermark to 24 hours
beyond it: ``delay`` must hold 48 hours and the lateness of revisions. What comes later than that is dropped, so a feed
whose revisions are later is for ``rebuild``, which has no such bound. Hours without any row, and the range of hours,
are not known to a stream; ``finished`` adds them to the table that it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import DEFAULT, FeedConfig
from tidemark.operators.hourly import REGION, TIME, add_local_time, anomaly_flags, hour_spine
from tidemark.operators.quality import PERIOD_FORMAT, classify
from tidemark.plans.silver import SILVER

DEMAND, FORECAST, PUBLISHED = "actual_demand_mwh", "day_ahead_forecast_mwh", "day_ahead_forecast_as_published_mwh"


def hours_told(feed: DataFrame, config: FeedConfig = DEFAULT) -> DataFrame:
    """Each row of the feed for every hour (``told``) that it tells something about, with its ``role`` there."""
    kind = {name: code for code, name in config.metrics.items()}
    part = lambda role, shift: F.struct(F.lit(role).alias("role"), F.lit(shift).alias("shift"))
    only = lambda name, role, shift: F.when(F.col("type") == kind[name], part(role, shift))
    roles = F.array_compact(F.array(part("own", 0), only(FORECAST, "moved", 1), only(DEMAND, "before", 24), only(DEMAND, "after", -24)))
    hour = F.try_to_timestamp("period", F.lit(PERIOD_FORMAT))
    sent = feed.select("*", F.explode(roles).alias("sent"))
    return sent.select(*feed.columns, "sent.role", F.timestamp_seconds(hour.cast("long") + F.col("sent.shift") * 3600).alias("told"))


def silver_stream(feed: DataFrame, config: FeedConfig = DEFAULT, delay: str = "4 days") -> DataFrame:
    """A row for each region and hour that the feed tells something about, on a stream as soon as no more is waited for; append mode."""
    told = hours_told(feed, config)
    told = told.withWatermark("told", delay) if feed.isStreaming else told
    newest = F.max(F.struct("ingested_at", "source_file", "value")).alias("newest")
    vintages = told.groupBy("told", "role", "period", "respondent", "type").agg(newest, (F.size(F.collect_set("value")) - 1).alias("revision_count"))
    rows = classify(vintages.select("told", "role", "period", "respondent", "type", "newest.value", "newest.ingested_at", "revision_count"), config).filter("reason is null")
    own = F.col("role") == "own"
    of = lambda condition: F.max(F.when(condition, F.col("value_mwh")))
    metrics = [of(own & (F.col("type") == code)).alias(name) for code, name in config.metrics.items()]
    around = [of(F.col("role") == role).alias(role) for role in ("moved", "before", "after")]
    hours = rows.groupBy("told", "respondent").agg(*metrics, *around, F.max(F.when(own, F.col("ingested_at"))).alias("ingested_at"), F.max(F.when(own, F.col("revision_count"))).alias("revision_count"), F.max(own).alias("present"))
    return hours.withColumnsRenamed({"told": TIME, "respondent": REGION})


def finished(hours: DataFrame, config: FeedConfig = DEFAULT) -> DataFrame:
    """The silver table of what ``silver_stream`` wrote: every hour from the first to the last that has a row of its own, with its flags."""
    spine = hour_spine(hours.filter("present").select(REGION, TIME))
    rows = spine.join(hours.withColumnRenamed(FORECAST, PUBLISHED).withColumnRenamed("moved", FORECAST), [REGION, TIME], "left")
    own = [PUBLISHED if name == FORECAST else name for name in config.metrics.values()]
    missing = F.lit(True)
    for name in own:
        missing = missing & F.col(name).isNull()
    flagged = rows.withColumns({"is_missing_hour": missing, **anomaly_flags(F.col(DEMAND), F.col("before"), F.col("after"), config)})
    return add_local_time(flagged, config.tz).select(*SILVER)


def follow(spark: SparkSession, landed: str, schema: str | T.StructType, target: str, checkpoint: str, config: FeedConfig = DEFAULT, delay: str = "4 days") -> DataFrame:
    """Read the files that are new in ``landed``, write the hours that are done by then to ``target``, and stop; gives the table so far."""
    hours = silver_stream(spark.readStream.schema(schema).parquet(landed), config, delay)
    hours.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(hours.schema).parquet(target)
