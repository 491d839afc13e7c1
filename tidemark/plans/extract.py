"""Fetching the feed and the weather archive into the landing zone: backfill, incremental, probe.

An incremental run asks again for a stretch of days that it has seen, since sources revise recent
hours: each run lands a new vintage and the silver build picks the newest.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.landing import flatten_weather, normalise_records, write_landing
from tidemark.sources.rest import RestFeed
from tidemark.sources.weather_feed import WeatherFeed

# First days of the two archives.
FEED_START, WEATHER_START = date(2019, 1, 1), date(2021, 3, 24)
MODES = ("backfill", "incremental")


@dataclass(frozen=True)
class ExtractSettings:
    """``feed`` and ``weather`` are transports, ``module:function``. ``today`` and ``run_at`` default to the clock in UTC."""

    feed: str
    weather: str
    mode: str = "incremental"
    look_back_days: int = 14
    respondent: str = "R0"
    types: str = "D,DF,NG,TI"
    start: date | None = None
    today: date | None = None
    run_at: str | None = None


def ranges(mode: str, today: date, look_back_days: int = 14, start: date | None = None) -> dict[str, tuple[date, date]]:
    """First and last day of either source. The weather archive lags: yesterday is its last whole day."""
    if mode not in MODES:
        raise ValueError(f"mode is {mode!r}, not one of {', '.join(MODES)}")
    back = today - timedelta(days=look_back_days)
    first = lambda floor: max(floor, (start or floor) if mode == "backfill" else back)
    return {"feed": (first(FEED_START), today), "weather": (first(WEATHER_START), today - timedelta(days=1))}


def _files(spark: SparkSession, root: str) -> set[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return set()
    return set(spark.read.schema("period string").parquet(root).inputFiles())  # a schema spares reading any footer


def _land(rows: DataFrame, root: str, span: tuple[date, date], **options) -> dict:
    """Write, then count what was added from the files themselves, so nothing is fetched twice."""
    spark = rows.sparkSession
    before = _files(spark, root)
    write_landing(rows, root, **options)
    new = sorted(_files(spark, root) - before)
    count = spark.read.parquet(*new).count() if new else 0
    return {"rows": count, "files": len(new), "from": str(span[0]), "to": str(span[1])}


def _source(spark: SparkSession, kind: type, span: tuple[date, date], transport: str, **options: str) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(start=str(span[0]), end=str(span[1]), transport=transport, **options).load()


def extract_feed(spark: SparkSession, landing: str, span: tuple[date, date], settings: ExtractSettings, run_at: str) -> dict:
    raw = _source(spark, RestFeed, span, settings.feed, types=settings.types, respondent=settings.respondent)
    of_month = F.concat(F.lit("feed/"), F.substring("period", 1, 7), F.lit(".parquet"))
    return _land(normalise_records(raw, run_at, of_month), f"{landing}/feed", span)


def extract_weather(spark: SparkSession, landing: str, span: tuple[date, date], settings: ExtractSettings, run_at: str) -> dict:
    answers = _source(spark, WeatherFeed, span, settings.weather)
    rows = flatten_weather(answers, run_at, f"weather/{span[0]}_{span[1]}.parquet")
    return _land(rows, f"{landing}/weather", span, time="valid_timestamp_utc", partitions=("region_id",))


def extract(spark: SparkSession, landing: str, settings: ExtractSettings) -> dict:
    """Fetch both sources. A run that lands no file of either raises: a fetch of nothing is no success."""
    now = datetime.now(UTC).replace(microsecond=0)
    run_at = settings.run_at or now.isoformat()
    spans = ranges(settings.mode, settings.today or now.date(), settings.look_back_days, settings.start)
    out = {"feed": extract_feed(spark, landing, spans["feed"], settings, run_at), "weather": extract_weather(spark, landing, spans["weather"], settings, run_at)}
    empty = [name for name, done in out.items() if not done["files"]]
    if empty:
        raise RuntimeError(f"nothing was landed for {', '.join(empty)}: {out}")
    return {"mode": settings.mode, **out}


def probe(spark: SparkSession, settings: ExtractSettings, day: date) -> dict[str, DataFrame]:
    """One day of either source as it comes, without landing it: feed records, and present values of each weather series."""
    raw = _source(spark, RestFeed, (day, day), settings.feed, types=settings.types, respondent=settings.respondent)
    hours = flatten_weather(_source(spark, WeatherFeed, (day, day), settings.weather), "probe", "probe")
    measures = [c for c, kind in hours.dtypes if kind == "double" and c not in ("latitude", "longitude")]
    present = hours.groupBy("point_id", "forecast_lead_days").agg(F.count(F.lit(1)).alias("hours"), *[F.count(c).alias(c) for c in measures])
    return {"feed": raw, "weather": present}
