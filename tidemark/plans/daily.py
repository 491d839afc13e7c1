"""The daily run: landing, bronze, silver, gold, features, audit, forecast, accuracy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FeedConfig
from tidemark.functions.calendar import contract_frame
from tidemark.operators.audit import joined_gate, leakage_gate
from tidemark.operators.daily import daily_summary, peak_history
from tidemark.operators.features import KNOWN_LEAKY, LABEL, MODEL_A, build_features, weather_specs
from tidemark.operators.forecast import forecast_predictions, forecast_runs, served_accuracy
from tidemark.operators.quality import split_quarantine
from tidemark.operators.registry import Registry
from tidemark.operators.weather import build_weather
from tidemark.plans.extract import ExtractSettings, extract
from tidemark.plans.pipeline import DAILY_CHECKS, Task
from tidemark.plans.refit import forecast_month
from tidemark.plans.silver import judged, silver_hours
from tidemark.sources.landing import FEED_SCHEMA, WEATHER_SCHEMA
from tidemark.sources.tables import replace, staged
from tidemark.streaming.ingest import ingest


@dataclass(frozen=True)
class DailySettings:
    """Where landed files lie (``feed`` and ``weather`` below ``landing``) and where tables go.

    ``region`` narrows the forecast to one region. With ``registry`` (a path) the champion of
    ``model`` is served beside the baselines, and a run without a champion fails. ``extract`` fetches
    before anything is read; without it the files that are there are counted.
    """

    landing: str
    tables: str
    region: str | None = None
    config: FeedConfig = field(default_factory=lambda: DEFAULT)
    points: list[str] | None = None
    warm_up_days: int = 14
    registry: str | None = None
    model: str = "xgb_b"
    extract: ExtractSettings | None = None


def daily_tasks(spark: SparkSession, settings: DailySettings) -> list[Task]:
    at = lambda name: f"{settings.tables}/{name}"
    read = lambda name: spark.read.parquet(at(name))
    kinds = {"feed": FEED_SCHEMA + ", date string", "weather": WEATHER_SCHEMA + ", date string"}

    def write(rows: DataFrame, name: str) -> int:
        replace(rows, at(name))
        return read(name).count()

    specs = [*MODEL_A, *weather_specs(points=settings.points)]

    def landed(_: dict) -> dict:
        if settings.extract is not None:
            return extract(spark, settings.landing, settings.extract)
        return {k: {"rows": spark.read.schema(s).parquet(f"{settings.landing}/{k}").count()} for k, s in kinds.items()}

    def bronze(_: dict) -> dict:
        added = {k: ingest(spark, f"{settings.landing}/{k}", s, at(f"bronze_{k}"), at(f"_checkpoints/{k}")) for k, s in kinds.items()}
        return {"added": added, "rows": read("bronze_feed").count()}

    def silver(_: dict) -> dict:
        drop = ["date", "_source_file", "_file_modified", "_bronze_loaded_at"]
        # Both tables come from the judged rows, which are worked out once.
        valid_rows, rejected = split_quarantine(staged(judged(read("bronze_feed").drop(*drop), settings.config), "judged"))
        hours = silver_hours(valid_rows, settings.config)
        valid, _ = build_weather(read("bronze_weather").drop(*drop))
        return {"electricity_hourly": write(hours, "electricity_hourly"), "electricity_quarantine": write(rejected, "electricity_quarantine"), "weather_forecast_hourly": write(valid, "weather_hourly")}

    def gold(_: dict) -> dict:
        return {"daily_summary": write(daily_summary(read("electricity_hourly"), settings.config.tz), "daily_summary"), "peak_history": write(peak_history(read("daily_summary")), "peak_history")}

    def features(_: dict) -> dict:
        hours = read("electricity_hourly")
        ends = hours.agg(F.date_add(F.to_date(F.min("event_timestamp_utc")), settings.warm_up_days).alias("a"), F.date_sub(F.to_date(F.max("event_timestamp_utc")), 1).alias("b")).first()
        frame = contract_frame(spark, str(ends["a"]), str(ends["b"]), settings.config.tz, settings.config.cutoff_local_hour)
        rows = write(build_features(hours, frame, read("weather_hourly"), specs, tz=settings.config.tz, points=settings.points, sources=True), "features")
        return {"rows": rows, "labelled": read("features").filter(F.col(LABEL).isNotNull()).count()}

    def audit(_: dict) -> dict:
        done = leakage_gate(read("features"), specs, KNOWN_LEAKY, settings.config)
        joined_gate(read("features"), specs, settings.config)
        return {"pairs": done["checks"], "violations": done["violations"], "known_leaky_caught": done["known_leaky_caught"]}

    def forecast(_: dict) -> dict:
        rows = read("features")
        rows = rows if settings.region is None else rows.filter(F.col("region_id") == settings.region)
        held = settings.registry and Registry(spark, settings.registry)
        made = forecast_month(rows, held or None, settings.model if held else None)
        write(forecast_runs(made), "forecast_run")
        return {"predictions": write(forecast_predictions(made, read("forecast_run")), "forecast_prediction")}

    def accuracy(_: dict) -> dict:
        # Baselines record no training end, so no threshold exists without a champion; its rows would be NULL.
        return {"rows": write(served_accuracy(read("forecast_prediction"), read("forecast_run"), read("electricity_hourly"), settings.config.extreme_quantile), "forecast_accuracy")}

    steps = [("ingest", landed, ()), ("bronze", bronze, ("ingest",)), ("silver", silver, ("bronze",)), ("gold", gold, ("silver",)), ("features", features, ("silver",)), ("leakage_audit", audit, ("features",)), ("forecast", forecast, ("leakage_audit",)), ("accuracy", accuracy, ("forecast", "silver"))]
    return [Task(name, run, needs, DAILY_CHECKS[name]) for name, run, needs in steps]
