"""Feeds, weather and predictions made of the star-schema tables, in Spark and in SQL.

``events`` becomes a revisable hourly feed with defects, moved by 58 days so that it spans a change
of clock; it also becomes a two-vintage weather forecast. ``orders`` becomes several years of
predictions. The SQL constants define the same rows for any engine with ANSI SQL.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT
from tidemark.operators.features import BENCHMARK, LABEL
from tidemark.sources.tables import load

TZ = DEFAULT.tz
EVENTS = replace(DEFAULT, bounds={"D": (1.0, 300.0), "DF": (1.0, 300.0), "NG": (0.0, 300.0), "TI": (-100.0, 250.0)}, anomaly_ratio=3.0, record_ceiling=200.0)
SHIFT_DAYS = 58
TYPES = {"click": "D", "view": "DF", "purchase": "NG", "error": "TI", "signup": "XX"}
POINTS = [f"p{k}" for k in range(8)]


def _types(column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " END"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("t", F.col("ts") + F.expr(f"interval {SHIFT_DAYS} days"))
    every = lambda n: F.col("event_id") % n == 0
    return events.select(
        F.when(every(211), "not-a-timestamp").otherwise(F.date_format(F.date_trunc("hour", "t"), "yyyy-MM-dd'T'HH")).alias("period"),
        F.when(~every(307), F.concat(F.lit("R"), (F.col("user_id") % 3).cast("string"))).alias("respondent"),
        F.expr(_types("event_type")).alias("type"),
        F.when(every(97), "n/a").when(~every(89), F.col("value").cast("string")).alias("value"),
        F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".parquet")).alias("source_file"),
        F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ingested_at"),
    )


#: Hours by which a vintage is ingested later than its event, for a feed with revisions after the cutoff.
LATE_HOURS = "CASE WHEN event_id % 3 = 0 THEN (event_id % 7) * 9 ELSE 0 END"


def late_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feed`` in which a third of the vintages are ingested up to 54 hours later."""
    event = F.regexp_extract("source_file", r"^0*(\d+)", 1).cast("long")
    late = F.to_timestamp("ingested_at") + F.make_dt_interval(hours=F.expr(LATE_HOURS).cast("int"))
    return feed(spark, sf_dir).withColumn("event_id", event).withColumn("ingested_at", F.date_format(late, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).drop("event_id")


FEED_SQL = f"""
feed AS (
  SELECT CASE WHEN event_id % 211 = 0 THEN 'not-a-timestamp' ELSE strftime(date_trunc('hour', t), '%Y-%m-%dT%H') END AS period,
         CASE WHEN event_id % 307 <> 0 THEN 'R' || (user_id % 3) END AS respondent, {_types('event_type')} AS type,
         CASE WHEN event_id % 97 = 0 THEN 'n/a' WHEN event_id % 89 <> 0 THEN CAST(value AS VARCHAR) END AS value,
         lpad(CAST(event_id AS VARCHAR), 8, '0') || '.parquet' AS source_file, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') AS ingested_at
  FROM (SELECT *, ts + INTERVAL {SHIFT_DAYS} DAY AS t FROM events))"""
LATE_SQL = FEED_SQL.replace("feed AS (", "late_feed AS (").replace("strftime(t, '%Y-%m-%dT%H:%M:%S.%f') AS ingested_at", f"t + to_hours(CAST({LATE_HOURS} AS INTEGER)) AS known_at")
RESOLVED_SQL = f"""{FEED_SQL},
vintages AS (SELECT period, respondent, type, count(*) AS vintage_count, count(DISTINCT value) - 1 AS revision_count,
                    count(DISTINCT value) + max(CASE WHEN value IS NULL THEN 1 ELSE 0 END) - 1 AS revision_count_nullsafe FROM feed GROUP BY ALL),
newest AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY period, respondent, type ORDER BY ingested_at DESC, source_file DESC) = 1),
resolved AS (SELECT n.*, v.vintage_count, v.revision_count, v.revision_count_nullsafe FROM newest n JOIN vintages v
             ON n.period = v.period AND n.type = v.type AND n.respondent IS NOT DISTINCT FROM v.respondent)"""


def _bounds_sql() -> str:
    return "CASE type " + " ".join(f"WHEN '{k}' THEN num < {lo} OR num > {hi}" for k, (lo, hi) in EVENTS.bounds.items()) + " ELSE false END"


CLASSIFIED_SQL = f"""{RESOLVED_SQL},
typed AS (SELECT *, try_strptime(period, '%Y-%m-%dT%H') AS hour_at, try_cast(value AS DOUBLE) AS num FROM resolved),
classified AS (SELECT *, CASE WHEN period IS NULL OR respondent IS NULL OR type IS NULL THEN 'MISSING_REQUIRED_FIELD' WHEN hour_at IS NULL THEN 'INVALID_TIMESTAMP'
                      WHEN type NOT IN ('D', 'DF', 'NG', 'TI') THEN 'UNKNOWN_TYPE' WHEN value IS NOT NULL AND num IS NULL THEN 'INVALID_NUMERIC'
                      WHEN num IS NOT NULL AND {_bounds_sql()} THEN 'IMPOSSIBLE_VALUE' END AS reason FROM typed)"""
WIDE_SQL = f"""{CLASSIFIED_SQL},
wide AS (SELECT respondent AS region_id, hour_at AS event_timestamp_utc, {', '.join(f"max(CASE WHEN type = '{k}' THEN num END) AS {v}" for k, v in EVENTS.metrics.items())},
                max(ingested_at) AS ingested_at, max(revision_count) AS revision_count FROM classified WHERE reason IS NULL GROUP BY ALL)"""
SPINE_SQL = f"""{WIDE_SQL},
spine AS (SELECT region_id, h AS event_timestamp_utc FROM (SELECT DISTINCT region_id FROM wide) CROSS JOIN
          (SELECT unnest(generate_series(min(event_timestamp_utc), max(event_timestamp_utc), INTERVAL 1 HOUR)) AS h FROM wide)),
hours AS (SELECT s.*, {', '.join(f'w.{m}' for m in EVENTS.metrics.values())}, w.ingested_at, w.revision_count,
                 coalesce({', '.join(EVENTS.metrics.values())}) IS NULL AS is_missing_hour FROM spine s LEFT JOIN wide w USING (region_id, event_timestamp_utc))"""
SILVER_SQL = f"""{SPINE_SQL},
local AS (SELECT *, timezone('{TZ}', timezone('UTC', event_timestamp_utc)) AS local_timestamp FROM hours),
near AS (SELECT *, lag(day_ahead_forecast_mwh) OVER r AS moved, lag(actual_demand_mwh, 24) OVER r AS p, lead(actual_demand_mwh, 24) OVER r AS n
         FROM local WINDOW r AS (PARTITION BY region_id ORDER BY event_timestamp_utc)),
silver AS (SELECT region_id, event_timestamp_utc, local_timestamp, CAST(local_timestamp AS DATE) AS local_date, hour(local_timestamp) AS local_hour, '{TZ}' AS timezone,
                  actual_demand_mwh, moved AS day_ahead_forecast_mwh, day_ahead_forecast_mwh AS day_ahead_forecast_as_published_mwh, net_generation_mwh, interchange_mwh, is_missing_hour,
                  coalesce((actual_demand_mwh > {EVENTS.anomaly_ratio} * p AND actual_demand_mwh > {EVENTS.anomaly_ratio} * n)
                           OR (actual_demand_mwh * {EVENTS.anomaly_ratio} < p AND actual_demand_mwh * {EVENTS.anomaly_ratio} < n), false) AS is_demand_anomaly_suspect,
                  coalesce(actual_demand_mwh > {EVENTS.record_ceiling}, false) AS is_above_historical_record, revision_count, ingested_at FROM near)"""


def day_hours_sql(day: str) -> str:
    """Hours of a local day."""
    at = lambda d: f"epoch(timezone('{TZ}', CAST({d} AS TIMESTAMP)))"
    return f"CAST(({at(f'({day}) + INTERVAL 1 DAY')} - {at(day)}) / 3600 AS BIGINT)"


CLEAN_SQL = "CASE WHEN NOT is_demand_anomaly_suspect AND NOT is_above_historical_record THEN actual_demand_mwh END"
DAILY_SQL = f"""{SILVER_SQL},
marked AS (SELECT *, {CLEAN_SQL} AS clean FROM silver),
days AS (SELECT region_id, local_date, count(*) AS actual_hours, count(clean) AS demand_hours, sum(is_demand_anomaly_suspect::INT) AS suspect_hours,
                sum(is_above_historical_record::INT) AS above_record_hours, sum(is_missing_hour::INT) AS missing_hours, max(clean) AS peak_demand_mwh,
                min(clean) AS min_demand_mwh, avg(clean) AS mean_demand_mwh, max(day_ahead_forecast_mwh) AS day_ahead_peak_mwh,
                arg_max(local_hour, (clean, local_hour, event_timestamp_utc)) FILTER (clean IS NOT NULL) AS peak_local_hour,
                arg_max(event_timestamp_utc, (clean, local_hour, event_timestamp_utc)) FILTER (clean IS NOT NULL) AS peak_timestamp_utc,
                arg_max(local_hour, (day_ahead_forecast_mwh, local_hour)) FILTER (day_ahead_forecast_mwh IS NOT NULL) AS day_ahead_peak_local_hour
         FROM marked GROUP BY ALL),
daily AS (SELECT *, {day_hours_sql('local_date')} AS expected_hours, isodow(local_date) >= 6 AS is_weekend, isodow(local_date) AS day_of_week, month(local_date) AS month, year(local_date) AS year,
                 mean_demand_mwh / nullif(peak_demand_mwh, 0) AS load_factor, day_ahead_peak_mwh - peak_demand_mwh AS peak_magnitude_error_mwh,
                 100 * (day_ahead_peak_mwh - peak_demand_mwh) / nullif(peak_demand_mwh, 0) AS peak_magnitude_error_pct, day_ahead_peak_local_hour - peak_local_hour AS peak_timing_error_hours,
                 actual_hours = {day_hours_sql('local_date')} AND demand_hours = {day_hours_sql('local_date')} AS is_complete FROM days)"""


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed two-vintage forecasts of eight points; a temperature is out of bounds now and then, a time unreadable."""
    events = load(spark, sf_dir, "events").withColumn("t", F.col("ts") + F.expr(f"interval {SHIFT_DAYS} days"))
    every = lambda n: F.col("event_id") % n == 0
    return events.select(
        F.when(every(499), "no time").otherwise(F.date_format(F.date_trunc("hour", "t"), "yyyy-MM-dd HH:mm:ss")).alias("valid_timestamp_utc"),
        (1 + F.col("event_id") % 2).cast("int").alias("forecast_lead_days"),
        F.lit("R0").alias("region_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 8).cast("string")).alias("point_id"),
        F.lit(40.0).alias("latitude"),
        F.lit(-75.0).alias("longitude"),
        F.when(~every(53), F.when(every(101), F.lit(999.0)).otherwise(F.col("value") / 10 - 10)).alias("temperature_c"),
        (F.col("value") / 10 - 12).alias("apparent_temperature_c"),
        F.lit(None).cast("double").alias("dew_point_c"),
        (F.col("value") / 2).alias("relative_humidity_pct"),
        (F.col("value") / 5).alias("wind_speed_kmh"),
        F.when(every(3), F.col("value") - 20).alias("precipitation_mm"),
        F.lit("api").alias("source"),
        F.concat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(".parquet")).alias("source_file"),
        F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ingested_at"),
    )


_MEASURES = {"temperature_c": (-60.0, 60.0), "apparent_temperature_c": (-75.0, 75.0), "dew_point_c": (-60.0, 45.0), "relative_humidity_pct": (0.0, 100.0), "wind_speed_kmh": (0.0, 500.0), "precipitation_mm": (0.0, 500.0)}
WEATHER_SQL = f"""
landed AS (
  SELECT CASE WHEN event_id % 499 = 0 THEN 'no time' ELSE strftime(date_trunc('hour', t), '%Y-%m-%d %H:%M:%S') END AS valid_text, CAST(1 + event_id % 2 AS BIGINT) AS forecast_lead_days,
         'R0' AS region_id, 'p' || (user_id % 8) AS point_id, CASE WHEN event_id % 53 <> 0 THEN CASE WHEN event_id % 101 = 0 THEN 999.0::DOUBLE ELSE value / 10 - 10 END END AS temperature_c,
         value / 10 - 12 AS apparent_temperature_c, CAST(NULL AS DOUBLE) AS dew_point_c, value / 2 AS relative_humidity_pct, value / 5 AS wind_speed_kmh,
         CASE WHEN event_id % 3 = 0 THEN value - 20 END AS precipitation_mm, lpad(CAST(event_id AS VARCHAR), 8, '0') || '.parquet' AS source_file, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') AS ingested_at
  FROM (SELECT *, ts + INTERVAL {SHIFT_DAYS} DAY AS t FROM events)),
parsed AS (SELECT *, try_strptime(valid_text, '%Y-%m-%d %H:%M:%S') AS valid_timestamp_utc FROM landed),
latest AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY valid_timestamp_utc, CASE WHEN valid_timestamp_utc IS NULL THEN valid_text END, point_id, forecast_lead_days ORDER BY ingested_at DESC, source_file DESC) = 1),
bounded AS (SELECT region_id, valid_timestamp_utc, valid_text, point_id, forecast_lead_days, ingested_at, {', '.join(f'CASE WHEN NOT coalesce({c} < {lo} OR {c} > {hi}, false) THEN {c} END AS {c}' for c, (lo, hi) in _MEASURES.items())},
                   concat_ws(',', {', '.join(f"CASE WHEN {c} < {lo} OR {c} > {hi} THEN '{c}' END" for c, (lo, hi) in _MEASURES.items())}) AS out_of_bounds FROM latest),
w AS (SELECT *, CASE WHEN temperature_c IS NOT NULL THEN greatest(temperature_c - 18.333333, 0) END AS cdd_c, CASE WHEN temperature_c IS NOT NULL THEN greatest(18.333333 - temperature_c, 0) END AS hdd_c
      FROM bounded WHERE valid_timestamp_utc IS NOT NULL)"""


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six target hours a day over the years of ``orders``, with label, benchmark and a naive column."""
    day = F.to_date("o_orderdate")
    slots = load(spark, sf_dir, "orders").groupBy(day.alias("forecast_date"), (F.col("o_orderkey") % 6).cast("int").alias("slot")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    target = F.date_add("forecast_date", 1)
    raw = F.col("cents") / F.lit(100.0)
    number = F.dayofmonth("forecast_date") + F.col("slot")
    rows = slots.withColumns({"target_local_date": target, "raw": raw, "number": number})
    hour = F.col("slot") * 4
    return rows.select(
        F.lit("R0").alias("region_id"),
        "forecast_date",
        (F.col("forecast_date").cast("timestamp") + F.expr("interval 15 hours")).alias("cutoff_utc"),
        F.timestamp_seconds(F.col("target_local_date").cast("timestamp").cast("long") + hour * 3600).alias("target_timestamp_utc"),
        "target_local_date",
        hour.alias("target_local_hour"),
        (F.lit(9.0) + hour).alias("hours_ahead"),
        (F.weekday("target_local_date") >= 5).alias("is_weekend"),
        ((F.month("target_local_date") == 7) & (F.dayofmonth("target_local_date") == 4)).alias("is_holiday"),
        F.lit(0).alias("days_to_nearest_holiday"),
        (F.col("raw") * (F.lit(1.0) + (F.col("number") * 7 % 11 - 5) / F.lit(100.0))).alias("demand_same_hour_minus_7d"),
        F.when(F.dayofmonth("forecast_date") % 13 != 0, F.col("raw") * (F.lit(1.0) + (F.col("number") * 3 % 7 - 3) / F.lit(100.0))).alias(BENCHMARK),
        F.when(~((F.dayofmonth("forecast_date") == 17) & (F.col("slot") == 2)), F.col("raw")).alias(LABEL),
        F.lit(False).alias("label_is_suspect"),
    )


ORDERS_SQL = """
slots AS (SELECT CAST(o_orderdate AS DATE) AS forecast_date, o_orderkey % 6 AS slot, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY ALL),
raws AS (SELECT *, forecast_date + 1 AS target_local_date, cents / 100.0::DOUBLE AS raw, day(forecast_date) + slot AS number FROM slots),
features AS (
  SELECT 'R0' AS region_id, forecast_date, CAST(forecast_date AS TIMESTAMP) + INTERVAL 15 HOUR AS cutoff_utc, CAST(target_local_date AS TIMESTAMP) + to_hours(CAST(slot * 4 AS INTEGER)) AS target_timestamp_utc,
         target_local_date, slot * 4 AS target_local_hour, 9.0::DOUBLE + slot * 4 AS hours_ahead, isodow(target_local_date) >= 6 AS is_weekend, month(target_local_date) = 7 AND day(target_local_date) = 4 AS is_holiday,
         raw * (1.0::DOUBLE + (number * 7 % 11 - 5) / 100.0::DOUBLE) AS naive, CASE WHEN day(forecast_date) % 13 <> 0 THEN raw * (1.0::DOUBLE + (number * 3 % 7 - 3) / 100.0::DOUBLE) END AS benchmark,
         CASE WHEN NOT (day(forecast_date) = 17 AND slot = 2) THEN raw END AS label FROM raws)"""
FOLDS_SQL = f"""{ORDERS_SQL},
ends AS (SELECT min(forecast_date) AS first, max(forecast_date) AS last FROM features),
months AS (SELECT first, last, CAST(unnest(generate_series(date_trunc('month', first), date_trunc('month', last), INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
late AS (SELECT * FROM months QUALIFY row_number() OVER (ORDER BY month) > 12),
folds AS (SELECT row_number() OVER (ORDER BY month) - 1 AS fold, strftime(month, '%Y-%m') AS fold_label, first AS train_start, month - 1 AS train_end, greatest(month, first) AS test_start, least(last_day(month), last) AS test_end FROM late)"""
STATS_SQL = f"""{FOLDS_SQL},
stats AS (SELECT fold, count(label) AS train_rows, quantile_cont(label, 0.95) AS extreme_threshold_mwh FROM folds JOIN features ON forecast_date BETWEEN train_start AND train_end WHERE label IS NOT NULL GROUP BY fold)"""
PREDICTIONS_SQL = f"""{STATS_SQL},
tests AS (SELECT f.*, fold, fold_label, train_end, train_rows, extreme_threshold_mwh, coalesce(label >= extreme_threshold_mwh, false) AS is_extreme
          FROM features f JOIN folds ON forecast_date BETWEEN test_start AND test_end JOIN stats USING (fold)),
raw_predictions AS (SELECT *, 'seasonal_naive' AS model, naive AS prediction FROM tests UNION ALL SELECT *, 'eia_df' AS model, benchmark AS prediction FROM tests),
predictions AS (SELECT *, prediction - label AS error, abs(prediction - label) AS abs_error, CASE WHEN abs(label) > 0 THEN abs(prediction - label) / abs(label) END AS ape FROM raw_predictions)"""
SCORED_SQL = f"""{PREDICTIONS_SQL},
ok AS (SELECT * FROM predictions WHERE label IS NOT NULL AND prediction IS NOT NULL),
scored AS (SELECT * FROM ok WHERE (forecast_date, target_timestamp_utc) IN (SELECT (forecast_date, target_timestamp_utc) FROM ok WHERE model = 'eia_df'))"""
