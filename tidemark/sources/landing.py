"""Landing zone: normalise API records, flatten weather payloads, write and read partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import WEATHER_POINTS, WEATHER_VARIABLES

FEED_SCHEMA = "period string, respondent string, respondent_name string, type string, type_name string, value string, value_units string, source string, source_file string, ingested_at string"
WEATHER_SCHEMA = "valid_timestamp_utc string, forecast_lead_days int, region_id string, point_id string, latitude double, longitude double, " + ", ".join(f"{c} double" for c in WEATHER_VARIABLES.values()) + ", source string, source_file string, ingested_at string"
LEADS = (1, 2)
_RECORD = ("period", "respondent", "respondent-name", "type", "type-name", "value", "value-units")


def normalise_records(records: DataFrame, run_ts: str, source_file: str | Column, source: str = "api") -> DataFrame:
    """API records (names with hyphens or underscores, any types) as feed rows: all text, an absent field NULL. ``source_file`` is a name or follows from the record."""
    own = {c.lower().replace("_", "-"): c for c in records.columns}
    field = lambda name: F.col(f"`{own[name]}`").cast("string") if name in own else F.lit(None).cast("string")
    columns = [field(name).alias(name.replace("-", "_")) for name in _RECORD]
    return records.select(*columns, F.lit(source).alias("source"), (F.lit(source_file) if isinstance(source_file, str) else source_file).alias("source_file"), F.lit(run_ts).alias("ingested_at"))


def payload_schema(leads: tuple[int, ...] = LEADS) -> T.StructType:
    """Schema of one location of a weather payload."""
    series = T.ArrayType(T.DoubleType())
    hourly = T.StructType([T.StructField("time", T.ArrayType(T.StringType())), *[T.StructField(f"{stem}_previous_day{lead}", series) for lead in leads for stem in WEATHER_VARIABLES]])
    return T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("hourly", hourly), T.StructField("error", T.BooleanType()), T.StructField("reason", T.StringType())])


def flatten_weather(payloads: DataFrame, run_ts: str, source_file: str, region: str = "R0", leads: tuple[int, ...] = LEADS, column: str = "payload", source: str = "api") -> DataFrame:
    """JSON text, a list of locations or one location, to a row per (hour, point, lead). Short series give NULLs; a location beyond the known points is ``unknown_<n>``; an error payload raises."""
    one = payload_schema(leads)
    text = F.when(F.trim(column).startswith("["), F.col(column)).otherwise(F.concat(F.lit("["), F.col(column), F.lit("]")))
    places = payloads.select(F.posexplode(F.from_json(text, T.ArrayType(one))).alias("n", "place"))
    checked = F.when(F.col("place.error"), F.raise_error(F.concat(F.lit("weather payload: "), F.coalesce("place.reason", F.lit("no reason"))))).otherwise(F.col("place.hourly"))
    names = F.array(*map(F.lit, WEATHER_POINTS))
    point = F.coalesce(F.get(names, F.col("n")), F.concat(F.lit("unknown_"), F.col("n").cast("string")))
    hours = places.select(point.alias("point_id"), "place.latitude", "place.longitude", checked.alias("hourly"))
    hours = hours.select("point_id", "latitude", "longitude", "hourly", F.posexplode("hourly.time").alias("k", "valid_timestamp_utc"))
    vintages = F.array(*[F.struct(F.lit(lead).alias("forecast_lead_days"), *[F.get(F.col(f"hourly.{stem}_previous_day{lead}"), F.col("k")).alias(name) for stem, name in WEATHER_VARIABLES.items()]) for lead in leads])
    rows = hours.select("valid_timestamp_utc", "point_id", "latitude", "longitude", F.explode(vintages).alias("v"))
    return rows.select("valid_timestamp_utc", "v.forecast_lead_days", F.lit(region).alias("region_id"), "point_id", "latitude", "longitude", *[f"v.{c}" for c in WEATHER_VARIABLES.values()], F.lit(source).alias("source"), F.lit(source_file).alias("source_file"), F.lit(run_ts).alias("ingested_at"))


def write_landing(rows: DataFrame, root: str, time: str = "period", partitions: tuple[str, ...] = ("respondent",)) -> None:
    """Append to ``root``, partitioned by the given columns and the date of ``time``; earlier files stay. Rows without a date are left out."""
    day = F.substring(time, 1, 10)
    keyed = rows.filter(F.length(F.trim(F.coalesce(day, F.lit("")))) == 10).withColumn("date", day)
    # The partition columns leave the files, so a copy keeps them readable as data.
    keyed.repartition(*partitions, "date").write.mode("append").partitionBy(*partitions, "date").option("compression", "snappy").parquet(root)


def read_landing(spark: SparkSession, root: str, schema: str | None = None) -> DataFrame:
    """The landing tree with its partition columns; a declared schema spares the inference."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(root)


def with_file_columns(rows: DataFrame) -> DataFrame:
    """Lineage of each row: file name, the file's time, load time."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return rows.select("*", name.alias("_source_file"), F.col("_metadata.file_modification_time").alias("_file_modified"), F.current_timestamp().alias("_bronze_loaded_at"))
