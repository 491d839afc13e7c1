"""All queries over the star-schema tables, each with its SQL.

A query is declared with its result columns, ``name:kind`` with kind ``s`` text, ``i`` integer,
``r`` number (six decimals), ``b`` boolean, ``t`` instant, ``d`` date; instants and dates are given
as text. Spark and SQL results are cast by that one declaration.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import asof, audit, backtest, daily, evaluate, features, forecast, hourly, models, profiling, quality, registry, revisions, weather
from tidemark.plans import adapters as a
from tidemark.plans.silver import build_silver
from tidemark.plans.refit import split_holdout
from tidemark.session import utc
from tidemark.sources import landing
from tidemark.sources.tables import load, place, staged
from tidemark.streaming.ingest import hourly_counts, ingest
from tidemark.streaming.rebuild import rebuild_days
from tidemark.streaming.silver import finished, follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_SPARK = {"s": lambda c: F.col(c).cast("string"), "i": lambda c: F.col(c).cast("long"), "r": lambda c: F.round(F.col(c).cast("double"), 6), "b": lambda c: F.col(c).cast("boolean"), "t": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "d": lambda c: F.date_format(c, "yyyy-MM-dd")}
_SQL = {"s": "CAST({0} AS VARCHAR)", "i": "CAST({0} AS BIGINT)", "r": "round(CAST({0} AS DOUBLE), 6)", "b": "CAST({0} AS BOOLEAN)", "t": "strftime({0}, '%Y-%m-%d %H:%M:%S')", "d": "strftime({0}, '%Y-%m-%d')"}


def query(columns: str, sql: str | None = None):
    """Register a function as a query of its name. ``sql`` may start with a chain of common tables."""
    pairs = [c.rsplit(":", 1) for c in columns.split()]

    def register(build: Callable[[SparkSession, str], DataFrame]):
        def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
            with utc(spark):
                return build(spark, sf_dir).select(*[_SPARK[kind](name).alias(name) for name, kind in pairs])

        QUERIES[build.__name__] = shaped
        if sql is not None:
            chosen = ", ".join(f"{_SQL[kind].format(name)} AS {name}" for name, kind in pairs)
            chain, _, last = sql.rpartition(";;")
            ORACLES[build.__name__] = (f"WITH {chain.strip()} " if chain.strip() else "") + f"SELECT {chosen} FROM ({last.strip()}) AS result"
        return build

    return register


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_silver(a.feed(spark, sf_dir), a.EVENTS)[0]


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_silver(a.feed(spark, sf_dir), a.EVENTS)[1]


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.resolve_revisions(a.feed(spark, sf_dir))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.split_quarantine(quality.classify(resolved(spark, sf_dir), a.EVENTS))[0]


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.pivot_hourly(valid(spark, sf_dir), a.EVENTS)


def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.attach_spine(wide(spark, sf_dir), a.EVENTS)


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.daily_summary(silver(spark, sf_dir), a.TZ)


def clean_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weather.build_weather(a.weather(spark, sf_dir))[0]


# ---- silver


@query("period:s respondent:s type:s value:s ingested_at:s", f"{a.RESOLVED_SQL} ;; SELECT * FROM newest")
def revision_latest(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("period:s respondent:s type:s vintage_count:i revision_count:i revision_count_nullsafe:i", f"{a.RESOLVED_SQL} ;; SELECT * FROM resolved")
def revision_counts(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("period:s respondent:s type:s vintages:i", f"{a.FEED_SQL} ;; SELECT period, respondent, type, count(*) AS vintages FROM feed GROUP BY 1, 2, 3 HAVING count(*) > 1")
def repeated_keys(spark, sf_dir):
    return revisions.repeated_keys(a.feed(spark, sf_dir))


@query("period:s respondent:s type:s value:s reason:s", f"{a.CLASSIFIED_SQL} ;; SELECT * FROM classified")
def classify_reasons(spark, sf_dir):
    return quality.classify(resolved(spark, sf_dir), a.EVENTS)


@query("source_file:s period:s region_id:s metric_type:s raw_value:s reason:s", f"{a.CLASSIFIED_SQL} ;; SELECT *, respondent AS region_id, type AS metric_type, value AS raw_value FROM classified WHERE reason IS NOT NULL")
def quarantine_rows(spark, sf_dir):
    return quarantine(spark, sf_dir)


@query("reason:s n:i", f"{a.CLASSIFIED_SQL} ;; SELECT reason, count(*) AS n FROM classified WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_by_reason(spark, sf_dir):
    return quality.quarantine_by_reason(quarantine(spark, sf_dir))


_METRICS = "actual_demand_mwh:r day_ahead_forecast_mwh:r net_generation_mwh:r interchange_mwh:r"


@query(f"region_id:s event_timestamp_utc:t {_METRICS} ingested_at:s revision_count:i", f"{a.WIDE_SQL} ;; SELECT * FROM wide")
def pivot_hourly(spark, sf_dir):
    return wide(spark, sf_dir)


@query(f"region_id:s event_timestamp_utc:t {_METRICS} is_missing_hour:b", f"{a.SPINE_SQL} ;; SELECT * FROM hours")
def hour_spine_gaps(spark, sf_dir):
    return spine(spark, sf_dir)


@query("region_id:s event_timestamp_utc:t local_timestamp:t local_date:d local_hour:i timezone:s", f"{a.SILVER_SQL} ;; SELECT * FROM silver")
def local_time(spark, sf_dir):
    return hourly.add_local_time(spine(spark, sf_dir), a.TZ)


@query("region_id:s event_timestamp_utc:t day_ahead_forecast_mwh:r day_ahead_forecast_as_published_mwh:r", f"{a.SILVER_SQL} ;; SELECT * FROM silver")
def align_lag1(spark, sf_dir):
    return hourly.align_day_ahead(spine(spark, sf_dir))


@query("region_id:s event_timestamp_utc:t actual_demand_mwh:r is_demand_anomaly_suspect:b", f"{a.SILVER_SQL} ;; SELECT * FROM silver")
def anomaly_both_sides(spark, sf_dir):
    return hourly.flag_anomalies(spine(spark, sf_dir), a.EVENTS)


@query("region_id:s event_timestamp_utc:t is_above_historical_record:b", f"{a.SILVER_SQL} ;; SELECT * FROM silver WHERE is_above_historical_record")
def record_ceiling(spark, sf_dir):
    return hourly.flag_anomalies(spine(spark, sf_dir), a.EVENTS).filter("is_above_historical_record")


@query(f"region_id:s event_timestamp_utc:t local_date:d local_hour:i {_METRICS} day_ahead_forecast_as_published_mwh:r is_missing_hour:b is_demand_anomaly_suspect:b is_above_historical_record:b revision_count:i ingested_at:s", f"{a.SILVER_SQL} ;; SELECT * FROM silver")
def silver_hourly(spark, sf_dir):
    return silver(spark, sf_dir)


@query("region_id:s local_date:d actual_hours:i demand_hours:i missing_hours:i suspect_hours:i expected_hours:i", f"{a.SILVER_SQL} ;; SELECT region_id, local_date, count(*) AS actual_hours, count(actual_demand_mwh) AS demand_hours, sum(is_missing_hour::INT) AS missing_hours, sum(is_demand_anomaly_suspect::INT) AS suspect_hours, any_value({a.day_hours_sql('local_date')}) AS expected_hours FROM silver GROUP BY ALL")
def completeness(spark, sf_dir):
    return hourly.completeness(silver(spark, sf_dir), a.TZ)


@query("revised_rows:i most_revisions:i", f"{a.SILVER_SQL} ;; SELECT sum((revision_count > 0)::INT) AS revised_rows, max(revision_count) AS most_revisions FROM silver")
def revision_report(spark, sf_dir):
    return revisions.revision_report(silver(spark, sf_dir))


@query("region_id:s hours:i metric:s present:i", f"{a.SILVER_SQL} ;; SELECT region_id, (SELECT count(*) FROM silver x WHERE x.region_id = u.region_id) AS hours, metric, count(v) AS present FROM (SELECT region_id, {', '.join(a.EVENTS.metrics.values())} FROM silver) UNPIVOT INCLUDE NULLS (v FOR metric IN ({', '.join(a.EVENTS.metrics.values())})) AS u GROUP BY ALL")
def metric_coverage(spark, sf_dir):
    return profiling.metric_coverage(silver(spark, sf_dir), list(a.EVENTS.metrics.values()))


# ---- landing


@query("period:s respondent:s respondent_name:s type:s type_name:s value:s value_units:s source:s source_file:s ingested_at:s", "SELECT strftime(ts, '%Y-%m-%dT%H') AS period, 'R' || (user_id % 3) AS respondent, 'Region ' || (user_id % 3) AS respondent_name, upper(event_type) AS type, event_type AS type_name, CASE WHEN event_id % 89 <> 0 THEN CAST(value AS VARCHAR) END AS value, NULL AS value_units, 'api' AS source, 'feed/' || strftime(ts, '%Y-%m') || '.parquet' AS source_file, 'run' AS ingested_at FROM events")
def normalised_records(spark, sf_dir):
    """Events as records of an API, with its names and types, made feed rows."""
    region = (F.col("user_id") % 3).cast("string")
    columns = {"Period": F.date_format("ts", "yyyy-MM-dd'T'HH"), "respondent": F.concat(F.lit("R"), region), "respondent-name": F.concat(F.lit("Region "), region), "type": F.upper("event_type"), "type-name": F.col("event_type"), "value": F.when(F.col("event_id") % 89 != 0, F.col("value")), "extra": F.col("event_id")}
    records = load(spark, sf_dir, "events").select(*[c.alias(name) for name, c in columns.items()])
    return landing.normalise_records(records, "run", F.concat(F.lit("feed/"), F.substring("Period", 1, 7), F.lit(".parquet")))


@query("valid_timestamp_utc:s forecast_lead_days:i region_id:s point_id:s latitude:r longitude:r temperature_c:r dew_point_c:r source_file:s", "h AS (SELECT date_trunc('hour', ts) AS t, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1), w AS (SELECT t, 1 AS forecast_lead_days, cents / 100.0::DOUBLE AS temperature_c FROM h UNION ALL SELECT t, 2, CASE WHEN cents % 5 <> 0 THEN cents / 100.0::DOUBLE - 1 END FROM h) ;; SELECT strftime(t, '%Y-%m-%dT%H:%M') AS valid_timestamp_utc, forecast_lead_days, 'R0' AS region_id, 'chicago_comed' AS point_id, 40.5 AS latitude, -75.25 AS longitude, temperature_c, NULL AS dew_point_c, 'weather/' || strftime(t, '%Y-%m-%d') AS source_file FROM w")
def flattened_payloads(spark, sf_dir):
    """A JSON payload for each day of events, made rows by (hour, point, lead)."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    hours = load(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("t")).agg(cents.alias("cents"))
    days = hours.groupBy(F.to_date("t").alias("day")).agg(F.sort_array(F.collect_list(F.struct("t", "cents"))).alias("h"))
    series = lambda f: F.transform("h", f)
    hourly = F.struct(
        series(lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        series(lambda x: x["cents"] / 100).alias("temperature_2m_previous_day1"),
        series(lambda x: F.when(x["cents"] % 5 != 0, x["cents"] / 100 - 1)).alias("temperature_2m_previous_day2"),
    )
    payloads = days.select(F.to_json(F.struct(F.lit(40.5).alias("latitude"), F.lit(-75.25).alias("longitude"), hourly.alias("hourly"))).alias("payload"))
    flat = landing.flatten_weather(payloads, "run", "weather")
    return flat.withColumn("source_file", F.concat(F.lit("weather/"), F.substring("valid_timestamp_utc", 1, 10)))


# ---- calendar and contract

_ORDER_ENDS = "(SELECT CAST(min(o_orderdate) AS DATE) AS low, CAST(max(o_orderdate) AS DATE) AS high FROM orders)"
_CALENDAR_DAYS = f"SELECT CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS local_date FROM {_ORDER_ENDS}"


def _order_ends(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """First and last day of the orders."""
    day = F.to_date("o_orderdate")
    ends = load(spark, sf_dir, "orders").agg(F.min(day).alias("low"), F.max(day).alias("high")).first()
    return str(ends["low"]), str(ends["high"])


_HOLIDAYS = """
y AS (SELECT unnest(range(1993, 2031)) AS y),
holidays AS (SELECT y, 0 AS k, 'new_year' AS name, make_date(y, 1, 1) AS h FROM y UNION ALL
  SELECT y, 1, 'memorial', make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM y UNION ALL
  SELECT y, 2, 'independence', make_date(y, 7, 4) FROM y UNION ALL
  SELECT y, 3, 'labor', make_date(y, 9, 1) + CAST((8 - isodow(make_date(y, 9, 1))) % 7 AS INTEGER) FROM y UNION ALL
  SELECT y, 4, 'thanksgiving', make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INTEGER) FROM y UNION ALL
  SELECT y, 5, 'christmas', make_date(y, 12, 25) FROM y)"""


@query("local_date:d expected_hours:i is_weekend:b day_of_week:i month:i year:i", f"SELECT local_date, {a.day_hours_sql('local_date')} AS expected_hours, isodow(local_date) >= 6 AS is_weekend, isodow(local_date) AS day_of_week, month(local_date) AS month, year(local_date) AS year FROM ({_CALENDAR_DAYS})")
def calendar_dim(spark, sf_dir):
    return cal.calendar_frame(spark, *_order_ends(spark, sf_dir), a.TZ)


@query("local_date:d holiday_name:s is_holiday:b days_to_nearest_holiday:i", f"{_HOLIDAYS}, d AS ({_CALENDAR_DAYS}), near AS (SELECT local_date, arg_min(local_date - h, (abs(local_date - h), y, k)) AS gap FROM d JOIN holidays ON y BETWEEN year(local_date) - 1 AND year(local_date) + 1 GROUP BY local_date) ;; SELECT near.local_date, name AS holiday_name, name IS NOT NULL AS is_holiday, gap AS days_to_nearest_holiday FROM near LEFT JOIN holidays ON h = local_date")
def holiday_distance(spark, sf_dir):
    return cal.with_holidays(cal.days_between(spark, *_order_ends(spark, sf_dir)))


_CONTRACT = f"""{_HOLIDAYS},
dates AS (SELECT CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS forecast_date FROM {_ORDER_ENDS}),
cut AS (SELECT forecast_date, timezone('UTC', timezone('{a.TZ}', CAST(forecast_date AS TIMESTAMP) + INTERVAL 10 HOUR)) AS cutoff_utc, forecast_date + 1 AS target_local_date,
               timezone('UTC', timezone('{a.TZ}', CAST(forecast_date + 1 AS TIMESTAMP))) AS low, timezone('UTC', timezone('{a.TZ}', CAST(forecast_date + 2 AS TIMESTAMP))) AS high FROM dates),
contract AS (SELECT forecast_date, cutoff_utc, target_local_date, unnest(generate_series(low, high - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS target_timestamp_utc FROM cut),
gaps AS (SELECT target_local_date AS g, arg_min(target_local_date - h, (abs(target_local_date - h), y, k)) AS gap FROM cut JOIN holidays ON y BETWEEN year(target_local_date) - 1 AND year(target_local_date) + 1 GROUP BY 1)"""


def _contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.contract_frame(spark, *_order_ends(spark, sf_dir), a.TZ)


@query("forecast_date:d cutoff_utc:t target_timestamp_utc:t target_local_date:d target_local_hour:i hours_ahead:r day_of_week:i month:i day_of_year:i is_weekend:b is_holiday:b days_to_nearest_holiday:i", f"{_CONTRACT} ;; SELECT *, hour(timezone('{a.TZ}', timezone('UTC', target_timestamp_utc))) AS target_local_hour, (epoch(target_timestamp_utc) - epoch(cutoff_utc)) / 3600 AS hours_ahead, isodow(target_local_date) AS day_of_week, month(target_local_date) AS month, dayofyear(target_local_date) AS day_of_year, isodow(target_local_date) >= 6 AS is_weekend, gap = 0 AS is_holiday, gap AS days_to_nearest_holiday FROM contract JOIN gaps ON g = target_local_date")
def contract_frame(spark, sf_dir):
    return _contract(spark, sf_dir)


@query("window_start:d window_end:d", f"e AS {_ORDER_ENDS}, m AS (SELECT low, high, CAST(unnest(generate_series(date_trunc('month', low), high, INTERVAL 1 MONTH)) AS DATE) AS m FROM e) ;; SELECT greatest(m, low) AS window_start, least(last_day(m), high) AS window_end FROM m")
def month_windows(spark, sf_dir):
    return cal.month_windows(spark, *_order_ends(spark, sf_dir))


@query("window_start:d window_end:d", f"e AS {_ORDER_ENDS}, m AS (SELECT high, CAST(unnest(generate_series(low, high, INTERVAL 6 MONTH)) AS DATE) AS m FROM e) ;; SELECT m AS window_start, least(CAST(m + INTERVAL 6 MONTH AS DATE) - 1, high) AS window_end FROM m")
def month_chunks(spark, sf_dir):
    return cal.month_chunks(spark, *_order_ends(spark, sf_dir))


# ---- gold

_DAY = "region_id:s local_date:d actual_hours:i demand_hours:i suspect_hours:i above_record_hours:i missing_hours:i peak_demand_mwh:r min_demand_mwh:r mean_demand_mwh:r day_ahead_peak_mwh:r expected_hours:i is_weekend:b day_of_week:i month:i year:i peak_local_hour:i peak_timestamp_utc:t day_ahead_peak_local_hour:i peak_magnitude_error_mwh:r peak_timing_error_hours:i is_complete:b"


@query(_DAY, f"{a.DAILY_SQL} ;; SELECT * FROM daily")
def daily_summary(spark, sf_dir):
    return days(spark, sf_dir)


def _loose_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed has hardly a whole day; half a day's hours count as whole here, so that records have rows."""
    return days(spark, sf_dir).withColumn("is_complete", F.col("demand_hours") >= 12)


_LOOSE = f"{a.DAILY_SQL}, loose AS (SELECT * REPLACE (demand_hours >= 12 AS is_complete) FROM daily)"


@query("region_id:s local_date:d peak_demand_mwh:r peak_local_hour:i running_peak_mwh:r is_new_record:b", f"{_LOOSE}, r AS (SELECT *, max(peak_demand_mwh) OVER (PARTITION BY region_id ORDER BY local_date ROWS UNBOUNDED PRECEDING) AS running_peak_mwh FROM loose WHERE is_complete) ;; SELECT *, peak_demand_mwh = running_peak_mwh AS is_new_record FROM r")
def peak_history(spark, sf_dir):
    return daily.peak_history(_loose_days(spark, sf_dir))


@query("region_id:s local_date:d peak_demand_mwh:r", f"{a.DAILY_SQL} ;; SELECT * FROM daily ORDER BY peak_demand_mwh DESC NULLS LAST, region_id, local_date LIMIT 5")
def top_peaks(spark, sf_dir):
    return daily.top_peaks(days(spark, sf_dir))


@query("region_id:s year:i peak_demand_mwh:r peak_date:d complete_pct:r days:i", f"{_LOOSE} ;; SELECT region_id, year, max(peak_demand_mwh) AS peak_demand_mwh, arg_max(local_date, (peak_demand_mwh, local_date)) FILTER (peak_demand_mwh IS NOT NULL) AS peak_date, 100.0 * avg(is_complete::INT) AS complete_pct, count(*) AS days FROM loose GROUP BY ALL")
def yearly_peaks(spark, sf_dir):
    return daily.yearly_peaks(_loose_days(spark, sf_dir))


@query("region_id:s days:i timing_mae_h:r hit_pct:r", f"{_LOOSE} ;; SELECT region_id, count(*) AS days, avg(abs(peak_timing_error_hours)) AS timing_mae_h, 100.0 * avg((peak_timing_error_hours = 0)::INT) AS hit_pct FROM loose WHERE is_complete GROUP BY 1")
def benchmark_peaks(spark, sf_dir):
    return daily.benchmark_peaks(_loose_days(spark, sf_dir))


# ---- weather


@query("valid_timestamp_utc:t point_id:s forecast_lead_days:i ingested_at:s", f"{a.WEATHER_SQL} ;; SELECT * FROM w")
def weather_vintage(spark, sf_dir):
    return clean_weather(spark, sf_dir)


@query("valid_timestamp_utc:t point_id:s forecast_lead_days:i temperature_c:r apparent_temperature_c:r dew_point_c:r relative_humidity_pct:r wind_speed_kmh:r precipitation_mm:r out_of_bounds:s", f"{a.WEATHER_SQL} ;; SELECT * FROM w")
def weather_bounds(spark, sf_dir):
    return clean_weather(spark, sf_dir).withColumn("out_of_bounds", F.array_join("out_of_bounds_columns", ","))


@query("valid_timestamp_utc:t point_id:s forecast_lead_days:i cdd_c:r hdd_c:r", f"{a.WEATHER_SQL} ;; SELECT * FROM w")
def degree_days(spark, sf_dir):
    return clean_weather(spark, sf_dir)


@query("valid_timestamp_utc:s point_id:s forecast_lead_days:i reason:s", f"{a.WEATHER_SQL} ;; SELECT valid_text AS valid_timestamp_utc, point_id, forecast_lead_days, 'INVALID_TIMESTAMP' AS reason FROM latest WHERE valid_timestamp_utc IS NULL")
def weather_quarantine(spark, sf_dir):
    return weather.build_weather(a.weather(spark, sf_dir))[1]


@query("target_timestamp_utc:t " + " ".join(f"temp_c_{p}_lead2:r" for p in a.POINTS) + " temp_c_region_mean_lead2:r cdd_region_lead2:r hdd_region_lead2:r", f"{a.WEATHER_SQL} ;; SELECT valid_timestamp_utc AS target_timestamp_utc, {', '.join(f'''max(CASE WHEN point_id = '{p}' THEN temperature_c END) AS temp_c_{p}_lead2''' for p in a.POINTS)}, avg(temperature_c) AS temp_c_region_mean_lead2, avg(cdd_c) AS cdd_region_lead2, avg(hdd_c) AS hdd_region_lead2 FROM w WHERE forecast_lead_days = 2 GROUP BY 1")
def weather_wide(spark, sf_dir):
    return weather.weather_wide(clean_weather(spark, sf_dir), 2, a.POINTS)


@query("target_local_date:d temp_c_target_day_max_lead2:r temp_c_target_day_min_lead2:r cdd_target_day_sum_lead2:r hdd_target_day_sum_lead2:r", f"{a.WEATHER_SQL}, h AS (SELECT CAST(timezone('{a.TZ}', timezone('UTC', valid_timestamp_utc)) AS DATE) AS d, valid_timestamp_utc, avg(temperature_c) AS t, avg(cdd_c) AS c, avg(hdd_c) AS x FROM w WHERE forecast_lead_days = 2 GROUP BY ALL) ;; SELECT d AS target_local_date, CASE WHEN count(t) = count(*) THEN max(t) END AS temp_c_target_day_max_lead2, CASE WHEN count(t) = count(*) THEN min(t) END AS temp_c_target_day_min_lead2, CASE WHEN count(t) = count(*) THEN sum(c) END AS cdd_target_day_sum_lead2, CASE WHEN count(t) = count(*) THEN sum(x) END AS hdd_target_day_sum_lead2 FROM h GROUP BY 1")
def weather_daily_whole(spark, sf_dir):
    return weather.weather_daily(clean_weather(spark, sf_dir), 2, a.TZ)


# ---- features

#: Days of hours before the first forecast date.
WARM_UP_DAYS = 5
_FRAME = f"""{a.SILVER_SQL},
fd AS (SELECT CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS forecast_date FROM (SELECT CAST(min(event_timestamp_utc) AS DATE) + {WARM_UP_DAYS} AS low, CAST(max(event_timestamp_utc) AS DATE) AS high FROM silver)),
fc AS (SELECT forecast_date, timezone('UTC', timezone('{a.TZ}', CAST(forecast_date AS TIMESTAMP) + INTERVAL 10 HOUR)) AS cutoff_utc, forecast_date + 1 AS target_local_date,
              timezone('UTC', timezone('{a.TZ}', CAST(forecast_date + 1 AS TIMESTAMP))) AS low, timezone('UTC', timezone('{a.TZ}', CAST(forecast_date + 2 AS TIMESTAMP))) AS high FROM fd),
frame AS (SELECT region_id, forecast_date, cutoff_utc, target_local_date, unnest(generate_series(low, high - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS target_timestamp_utc FROM fc CROSS JOIN (SELECT DISTINCT region_id FROM silver)),
lookup AS (SELECT region_id, event_timestamp_utc AS h, {a.CLEAN_SQL} AS demand, day_ahead_forecast_mwh AS forecast, is_demand_anomaly_suspect AS suspect, is_above_historical_record AS above_record FROM silver),
rolled AS (SELECT *, avg(demand) OVER r AS roll_mean, stddev_samp(demand) OVER r AS roll_std FROM lookup WINDOW r AS (PARTITION BY region_id ORDER BY h RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW))"""
_KEY = "region_id:s forecast_date:d target_timestamp_utc:t"


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The silver hours, written once for all that read them."""
    return staged(silver(spark, sf_dir), "silver")


def _frame(spark: SparkSession, hours: DataFrame) -> DataFrame:
    """The contract of all forecast dates that the hours allow."""
    day = F.to_date("event_timestamp_utc")
    ends = hours.agg(F.date_add(F.min(day), WARM_UP_DAYS).alias("low"), F.max(day).alias("high")).first()
    return cal.contract_frame(spark, str(ends["low"]), str(ends["high"]), a.TZ)


def _feature_rows(spark: SparkSession, sf_dir: str, hours: DataFrame | None = None, specs: list[features.FeatureSpec] = features.MODEL_A, sources: bool = False) -> DataFrame:
    hours = _hours(spark, sf_dir) if hours is None else hours
    return features.build_features(hours, _frame(spark, hours), None, specs, tz=a.TZ, sources=sources)


def _at(anchor: str, hours: int, column: str = "demand", table: str = "lookup") -> str:
    return f"(SELECT x.{column} FROM {table} x WHERE x.region_id = f.region_id AND x.h = f.{anchor} - INTERVAL {hours} HOUR)"


_LAGS = {f"demand_cutoff_minus_{h}h": ("cutoff_utc", h) for h in (3, 4, 5, 6, 27)} | {f"demand_same_hour_minus_{d}d": ("target_timestamp_utc", 24 * d) for d in (2, 7, 14)}


@query(f"{_KEY} " + " ".join(f"{n}:r" for n in _LAGS), f"{_FRAME} ;; SELECT *, {', '.join(f'{_at(*v)} AS {n}' for n, v in _LAGS.items())} FROM frame f")
def lag_features(spark, sf_dir):
    return _feature_rows(spark, sf_dir)


@query(f"{_KEY} demand_rolling_mean_24h_to_cutoff:r demand_rolling_std_24h_to_cutoff:r", f"{_FRAME} ;; SELECT *, {_at('cutoff_utc', 3, 'roll_mean', 'rolled')} AS demand_rolling_mean_24h_to_cutoff, {_at('cutoff_utc', 3, 'roll_std', 'rolled')} AS demand_rolling_std_24h_to_cutoff FROM frame f")
def rolling_24h(spark, sf_dir):
    return _feature_rows(spark, sf_dir)


@query(f"{_KEY} demand_same_hour_prev_week_mean:r", f"{_FRAME} ;; SELECT *, (SELECT avg(x.demand) FROM lookup x WHERE x.region_id = f.region_id AND x.h IN ({', '.join(f'f.target_timestamp_utc - INTERVAL {24 * d} HOUR' for d in range(2, 8))})) AS demand_same_hour_prev_week_mean FROM frame f")
def prev_week_mean(spark, sf_dir):
    return _feature_rows(spark, sf_dir)


@query(f"{_KEY} label_demand_mwh:r benchmark_eia_df_mwh:r label_is_suspect:b label_above_record:b", f"{_FRAME} ;; SELECT f.*, demand AS label_demand_mwh, forecast AS benchmark_eia_df_mwh, suspect AS label_is_suspect, above_record AS label_above_record FROM frame f LEFT JOIN lookup x ON x.region_id = f.region_id AND x.h = f.target_timestamp_utc")
def feature_label(spark, sf_dir):
    return _feature_rows(spark, sf_dir)


@query(f"{_KEY} target_local_date:d temp_c_region_mean_lead2:r temp_c_target_day_max_lead2:r", f"{_FRAME}, {a.WEATHER_SQL}, ww AS (SELECT valid_timestamp_utc AS h, avg(temperature_c) AS m FROM w WHERE forecast_lead_days = 2 GROUP BY 1), wh AS (SELECT CAST(timezone('{a.TZ}', timezone('UTC', valid_timestamp_utc)) AS DATE) AS d, valid_timestamp_utc, avg(temperature_c) AS t FROM w WHERE forecast_lead_days = 2 GROUP BY ALL), wd AS (SELECT d, CASE WHEN count(t) = count(*) THEN max(t) END AS mx FROM wh GROUP BY 1) ;; SELECT f.*, m AS temp_c_region_mean_lead2, mx AS temp_c_target_day_max_lead2 FROM frame f LEFT JOIN ww ON ww.h = f.target_timestamp_utc AND f.region_id = 'R0' LEFT JOIN wd ON wd.d = f.target_local_date AND f.region_id = 'R0'")
def feature_weather(spark, sf_dir):
    hours = _hours(spark, sf_dir)
    return features.build_features(hours, _frame(spark, hours), clean_weather(spark, sf_dir), tz=a.TZ, points=a.POINTS)


@query("feature:s coverage_pct:r", f"{_FRAME}, l AS (SELECT {', '.join(f'{_at(*v)} AS {n}' for n, v in _LAGS.items())} FROM frame f) ;; SELECT feature, 100.0 * count(v) / count(*) AS coverage_pct FROM l UNPIVOT INCLUDE NULLS (v FOR feature IN ({', '.join(_LAGS)})) GROUP BY 1")
def feature_coverage(spark, sf_dir):
    return features.feature_coverage(_feature_rows(spark, sf_dir), list(_LAGS))


# ---- audit


def _audit_sql(specs: list[features.FeatureSpec]) -> str:
    rows = []
    for s in specs:
        if s.anchor is features.Anchor.CALENDAR:
            at = "CAST(NULL AS TIMESTAMP)"
        elif s.anchor is features.Anchor.WEATHER:
            at = f"timezone('UTC', timezone('{a.TZ}', CAST(target_local_date + {1 - s.lead_days} AS TIMESTAMP)))"
        else:
            anchor = "cutoff_utc" if s.anchor is features.Anchor.CUTOFF else "target_timestamp_utc"
            at = f"{anchor} + INTERVAL ({a.EVENTS.publication_lag_hours[s.metric] - s.offset_hours}) HOUR"
        rows.append(f"SELECT '{s.name}' AS feature, cutoff_utc, target_timestamp_utc, {at} AS available_at FROM contract")
    return f"{_FRAME}, contract AS (SELECT DISTINCT cutoff_utc, target_timestamp_utc, target_local_date FROM frame), known AS ({' UNION ALL '.join(rows)}), late AS (SELECT *, coalesce(available_at > cutoff_utc, false) AS is_late, (epoch(available_at) - epoch(cutoff_utc)) / 3600 AS hours FROM known)"


_REPORT = "SELECT feature, count(*) AS pairs, sum(is_late::INT) AS violations, max(CASE WHEN is_late THEN hours END) AS max_hours_late FROM late GROUP BY 1"


@query("feature:s pairs:i violations:i max_hours_late:r", f"{_audit_sql(features.MODEL_B)} ;; {_REPORT}")
def leakage_audit(spark, sf_dir):
    return audit.audit_report(_feature_rows(spark, sf_dir), features.MODEL_B)


@query("feature:s pairs:i violations:i max_hours_late:r", f"{_audit_sql([*features.KNOWN_LEAKY, *features.LEAD1_VARIANT])} ;; {_REPORT}")
def leakage_known_bad(spark, sf_dir):
    return audit.audit_report(_feature_rows(spark, sf_dir), [*features.KNOWN_LEAKY, *features.LEAD1_VARIANT])


@query("feature:s cutoff_utc:t target_timestamp_utc:t hours_late:r", f"{_audit_sql(features.KNOWN_LEAKY)} ;; SELECT *, hours AS hours_late FROM late WHERE is_late ORDER BY hours DESC, feature, cutoff_utc, target_timestamp_utc LIMIT 50")
def leakage_worst(spark, sf_dir):
    return audit.worst_first(audit.violations(_feature_rows(spark, sf_dir), features.KNOWN_LEAKY)).limit(50)


_READ_SPECS = [*features.DEMAND, *[s for s in features.KNOWN_LEAKY if s.metric == "D"]]


def _joined_sql() -> str:
    """The hour that each feature reads, NULL where there is no value, beside the hour that its spec declares."""
    rows = []
    for spec in _READ_SPECS:
        anchor = "cutoff_utc" if spec.anchor is features.Anchor.CUTOFF else "target_timestamp_utc"
        read = _at(anchor, spec.offset_hours, "rolled_read" if spec.name in features.ROLLING else "read", "known")
        if spec.name == features.PREVIOUS_WEEK:
            read = f"greatest({', '.join(_at(anchor, 24 * d, 'read', 'known') for d in features.PREVIOUS_WEEK_DAYS)})"
        rows.append(f"SELECT '{spec.name}' AS feature, cutoff_utc, {read} AS read, {anchor} - INTERVAL {spec.offset_hours} HOUR AS declared FROM frame f")
    lag = a.EVENTS.publication_lag_hours["D"]
    return f"""{_FRAME},
marked AS (SELECT region_id, h, CASE WHEN demand IS NOT NULL THEN h END AS read FROM lookup),
known AS (SELECT *, max(read) OVER (PARTITION BY region_id ORDER BY h RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS rolled_read FROM marked),
each AS ({' UNION ALL '.join(rows)}) ;;
SELECT feature, count(*) AS values, sum((read + INTERVAL {lag} HOUR > cutoff_utc)::INT) AS violations,
       max(CASE WHEN read + INTERVAL {lag} HOUR > cutoff_utc THEN (epoch(read) - epoch(cutoff_utc)) / 3600 + {lag} END) AS max_hours_late, sum((read > declared)::INT) AS later_than_declared
FROM each WHERE read IS NOT NULL GROUP BY 1"""


@query("feature:s values:i violations:i max_hours_late:r later_than_declared:i", _joined_sql())
def joined_audit(spark, sf_dir):
    """What every feature really read, leaky ones among them."""
    return audit.joined_report(_feature_rows(spark, sf_dir, None, _READ_SPECS, True), _READ_SPECS, a.EVENTS)


_KNOWN_LAGS = [*_LAGS, *features.ROLLING, features.PREVIOUS_WEEK]


def _as_known_sql() -> str:
    asked = {name: f"{anchor} - INTERVAL {hours} HOUR" for name, (anchor, hours) in _LAGS.items()}
    asked |= {f"hour_{k}": f"cutoff_utc - INTERVAL {features.ROLLING_ANCHOR_HOURS + k} HOUR" for k in range(features.ROLLING_HOURS)}
    asked |= {f"day_{d}": f"target_timestamp_utc - INTERVAL {24 * d} HOUR" for d in features.PREVIOUS_WEEK_DAYS}
    hours = ", ".join(f"{{'name': '{name}', 'h': {hour}}}" for name, hour in asked.items())
    picked = ", ".join(f"max(demand) FILTER (name = '{name}') AS {name}" for name in _LAGS)
    rolled, week = "starts_with(name, 'hour_')", "starts_with(name, 'day_')"
    low, high = a.EVENTS.bounds["D"]
    return f"""{_FRAME}, {a.LATE_SQL.strip()},
readings AS (SELECT respondent AS region_id, try_strptime(period, '%Y-%m-%dT%H') AS h, known_at, source_file, CASE WHEN num BETWEEN {low} AND {high} THEN num END AS demand
             FROM (SELECT *, try_cast(value AS DOUBLE) AS num FROM late_feed) WHERE type = 'D' AND respondent IS NOT NULL AND try_strptime(period, '%Y-%m-%dT%H') IS NOT NULL),
asked AS (SELECT region_id, forecast_date, cutoff_utc, target_timestamp_utc, unnest([{hours}], recursive := true) FROM frame),
got AS (SELECT a.*, v.demand, v.known_at FROM asked a LEFT JOIN readings v ON v.region_id = a.region_id AND v.h = a.h AND v.known_at <= a.cutoff_utc
        QUALIFY row_number() OVER (PARTITION BY a.region_id, a.forecast_date, a.target_timestamp_utc, a.name ORDER BY v.known_at DESC NULLS LAST, v.source_file DESC) = 1) ;;
SELECT region_id, forecast_date, target_timestamp_utc, {picked}, avg(demand) FILTER ({rolled}) AS {features.ROLLING[0]}, stddev_samp(demand) FILTER ({rolled}) AS {features.ROLLING[1]},
       avg(demand) FILTER ({week}) AS {features.PREVIOUS_WEEK}, max(known_at) AS newest_known_at FROM got GROUP BY 1, 2, 3"""


@query(f"{_KEY} " + " ".join(f"{n}:r" for n in _KNOWN_LAGS) + " newest_known_at:t", _as_known_sql())
def features_as_known(spark, sf_dir):
    """Features from the vintages that were there at the cutoff, of a feed with revisions after it."""
    return asof.features_as_known(a.late_feed(spark, sf_dir), _frame(spark, spine(spark, sf_dir)), features.MODEL_A, a.EVENTS)


# ---- backtest and evaluation


def _folds(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return backtest.monthly_folds(a.order_features(spark, sf_dir).select("forecast_date"), **options)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.run_backtest(a.order_features(spark, sf_dir), [models.seasonal_naive(), models.published_benchmark()], _folds(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backtest.scoreable(predictions(spark, sf_dir))


_FOLD = "fold:i fold_label:s train_start:d train_end:d test_start:d test_end:d"


@query(_FOLD, f"{a.FOLDS_SQL} ;; SELECT * FROM folds")
def folds_monthly(spark, sf_dir):
    return _folds(spark, sf_dir)


@query(_FOLD, f"{a.FOLDS_SQL} ;; SELECT * REPLACE (greatest(train_start, CAST(CAST(fold_label || '-01' AS DATE) - INTERVAL 6 MONTH AS DATE)) AS train_start, train_end - 1 AS train_end) FROM folds")
def folds_sliding(spark, sf_dir):
    return _folds(spark, sf_dir, window_months=6, embargo_days=1)


@query("fold:i train_rows:i extreme_threshold_mwh:r", f"{a.STATS_SQL} ;; SELECT * FROM stats")
def fold_threshold(spark, sf_dir):
    return backtest.training_stats(a.order_features(spark, sf_dir), _folds(spark, sf_dir))


@query("fold:i model:s target_timestamp_utc:t prediction_mwh:r error_mwh:r ape:r is_extreme:b train_rows:i", f"{a.PREDICTIONS_SQL} ;; SELECT *, prediction AS prediction_mwh, error AS error_mwh FROM predictions")
def backtest_column_models(spark, sf_dir):
    return predictions(spark, sf_dir)


@query("model:s forecast_date:d target_timestamp_utc:t", f"{a.SCORED_SQL} ;; SELECT * FROM scored")
def scoreable_semi(spark, sf_dir):
    return scored(spark, sf_dir)


_ERRORS = "n:i MAE_mwh:r RMSE_mwh:r MAPE_pct:r bias_mwh:r"
_ERRORS_SQL = "count(*) AS n, avg(abs_error) AS MAE_mwh, sqrt(avg(error * error)) AS RMSE_mwh, 100 * avg(abs_error / abs(label)) AS MAPE_pct, avg(error) AS bias_mwh"


@query(f"model:s {_ERRORS}", f"{a.SCORED_SQL} ;; SELECT model, {_ERRORS_SQL} FROM scored GROUP BY 1")
def eval_overall(spark, sf_dir):
    return evaluate.overall(scored(spark, sf_dir))


@query(f"model:s day_type:s {_ERRORS}", f"{a.SCORED_SQL} ;; SELECT model, CASE WHEN is_holiday THEN 'holiday' WHEN is_weekend THEN 'weekend' ELSE 'weekday' END AS day_type, {_ERRORS_SQL} FROM scored GROUP BY 1, 2")
def eval_by_day_type(spark, sf_dir):
    return evaluate.by_day_type(scored(spark, sf_dir))


@query(f"model:s regime:s {_ERRORS}", f"{a.SCORED_SQL} ;; SELECT model, CASE WHEN is_extreme THEN 'extreme' ELSE 'normal' END AS regime, {_ERRORS_SQL} FROM scored GROUP BY 1, 2")
def eval_by_regime(spark, sf_dir):
    return evaluate.by_regime(scored(spark, sf_dir))


@query(f"model:s target_local_hour:i {_ERRORS}", f"{a.SCORED_SQL} ;; SELECT model, target_local_hour, {_ERRORS_SQL} FROM scored GROUP BY 1, 2")
def eval_by_hour(spark, sf_dir):
    return evaluate.by(scored(spark, sf_dir), "target_local_hour")


@query("model:s MAE_mwh:r MAE_vs_baseline_pct:r MAPE_vs_baseline_pp:r", f"{a.SCORED_SQL}, o AS (SELECT model, {_ERRORS_SQL} FROM scored GROUP BY 1), b AS (SELECT * FROM o WHERE model = 'eia_df') ;; SELECT o.model, o.MAE_mwh, 100 * (o.MAE_mwh - b.MAE_mwh) / b.MAE_mwh AS MAE_vs_baseline_pct, o.MAPE_pct - b.MAPE_pct AS MAPE_vs_baseline_pp FROM o CROSS JOIN b")
def versus_baseline(spark, sf_dir):
    return evaluate.versus(scored(spark, sf_dir))


_PEAKS_SQL = f"""{a.SCORED_SQL},
peaks AS (SELECT model, target_local_date, max(label) AS actual_peak_mwh, arg_max(target_local_hour, (label, -epoch(target_timestamp_utc))) AS actual_peak_hour, max(prediction) AS pred_peak_mwh,
                 arg_max(target_local_hour, (prediction, -epoch(target_timestamp_utc))) AS pred_peak_hour, bool_or(is_extreme) AS is_extreme_day FROM scored GROUP BY ALL),
pk AS (SELECT *, pred_peak_mwh - actual_peak_mwh AS peak_magnitude_error_mwh, 100 * (pred_peak_mwh - actual_peak_mwh) / actual_peak_mwh AS peak_magnitude_error_pct, pred_peak_hour - actual_peak_hour AS peak_timing_error_hours FROM peaks)"""


@query("model:s target_local_date:d actual_peak_mwh:r actual_peak_hour:i pred_peak_mwh:r pred_peak_hour:i peak_magnitude_error_mwh:r peak_magnitude_error_pct:r peak_timing_error_hours:i is_extreme_day:b", f"{_PEAKS_SQL} ;; SELECT * FROM pk")
def peak_metrics(spark, sf_dir):
    return evaluate.peak_metrics(scored(spark, sf_dir), require_full_day=False)


@query("model:s days:i pk_bias_pct:r pk_MAPE_pct:r pk_timing_MAE_h:r pk_timing_hit_pct:r pk_timing_within_1h_pct:r", f"{_PEAKS_SQL} ;; SELECT model, count(*) AS days, avg(peak_magnitude_error_pct) AS pk_bias_pct, avg(abs(peak_magnitude_error_pct)) AS pk_MAPE_pct, avg(abs(peak_timing_error_hours)) AS pk_timing_MAE_h, 100.0 * avg((peak_timing_error_hours = 0)::INT) AS pk_timing_hit_pct, 100.0 * avg((abs(peak_timing_error_hours) <= 1)::INT) AS pk_timing_within_1h_pct FROM pk GROUP BY 1")
def peak_summary(spark, sf_dir):
    return evaluate.peak_summary(evaluate.peak_metrics(scored(spark, sf_dir), require_full_day=False))


@query("slice:i seasonal_naive:r eia_df:r", f"{a.SCORED_SQL} ;; SELECT year(target_local_date) AS slice, avg(CASE WHEN model = 'seasonal_naive' THEN abs_error END) AS seasonal_naive, avg(CASE WHEN model = 'eia_df' THEN abs_error END) AS eia_df FROM scored GROUP BY 1")
def error_pivot(spark, sf_dir):
    return evaluate.error_pivot(scored(spark, sf_dir), F.year("target_local_date"), ["seasonal_naive", "eia_df"])


@query("model:s target_timestamp_utc:t abs_error_mwh:r", f"{a.SCORED_SQL} ;; SELECT model, target_timestamp_utc, abs_error AS abs_error_mwh FROM scored ORDER BY abs_error DESC, target_timestamp_utc, model LIMIT 8")
def worst_hours(spark, sf_dir):
    return evaluate.worst_hours(scored(spark, sf_dir))


@query("region_id:s local_date:d max_mwh:r mean_mwh:r min_mwh:r pct_of_reference:r", f"{a.SILVER_SQL}, d AS (SELECT region_id, local_date, max(actual_demand_mwh) AS max_mwh, avg(actual_demand_mwh) AS mean_mwh, min(actual_demand_mwh) AS min_mwh FROM silver GROUP BY ALL), top AS (SELECT region_id, max(max_mwh) AS top FROM d WHERE local_date BETWEEN DATE '2024-03-01' AND DATE '2024-03-09' GROUP BY 1) ;; SELECT d.*, 100 * max_mwh / top AS pct_of_reference FROM d JOIN top USING (region_id) WHERE local_date BETWEEN DATE '2024-03-10' AND DATE '2024-03-14'")
def event_window(spark, sf_dir):
    return evaluate.event_window(silver(spark, sf_dir), "2024-03-10", "2024-03-14", "2024-03-01", "2024-03-09")


@query("folds:i corr:r", f"{a.PREDICTIONS_SQL}, f AS (SELECT fold, max(train_rows) AS rows, avg(error) AS bias FROM predictions WHERE model = 'seasonal_naive' GROUP BY 1) ;; SELECT count(*) AS folds, corr(rows, bias) AS corr FROM f")
def training_bias(spark, sf_dir):
    return profiling.training_bias_correlation(predictions(spark, sf_dir), "seasonal_naive")


# ---- forecast tables

def regional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three regions: the hours of a day are dealt to them in turn."""
    return predictions(spark, sf_dir).withColumn("region_id", F.concat(F.lit("R"), F.expr("cast(target_local_hour div 4 % 3 as string)")))


_RUNS_SQL = f"""{a.PREDICTIONS_SQL},
regional AS (SELECT * REPLACE ('R' || ((target_local_hour // 4) % 3) AS region_id) FROM predictions),
runs AS (SELECT region_id, model, cutoff_utc, region_id || '__' || model || '__v1.0.0__' || strftime(cutoff_utc, '%Y%m%dT%H%MZ') AS forecast_run_id, 'v1.0.0' AS model_version, 2 AS weather_lead_days,
                min(train_end) AS training_data_end, min(train_rows) AS training_rows, min(fold) AS fold, count(DISTINCT target_timestamp_utc) AS n_targets FROM regional GROUP BY region_id, model, cutoff_utc)"""


@query("forecast_run_id:s region_id:s cutoff_utc:t model:s model_version:s weather_lead_days:i training_data_end:d training_rows:i fold:i n_targets:i", f"{_RUNS_SQL} ;; SELECT * FROM runs")
def forecast_run(spark, sf_dir):
    return forecast.forecast_runs(regional(spark, sf_dir))


_RUN_OF = "r.region_id = p.region_id AND r.model = p.model AND r.cutoff_utc = p.cutoff_utc"


@query("forecast_run_id:s region_id:s target_timestamp_utc:t target_local_date:d target_local_hour:i hours_ahead:r predicted_p50_mwh:r", f"{_RUNS_SQL} ;; SELECT p.*, forecast_run_id, prediction AS predicted_p50_mwh FROM regional p JOIN runs r ON {_RUN_OF}")
def forecast_prediction(spark, sf_dir):
    made = regional(spark, sf_dir)
    return forecast.forecast_predictions(made, forecast.forecast_runs(made))


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = regional(spark, sf_dir)
    return forecast.backtest_accuracy(made, forecast.forecast_runs(made))


_ACCURACY_SQL = f"""{_RUNS_SQL},
acc AS (SELECT p.*, forecast_run_id, row_number() OVER (PARTITION BY p.region_id, p.model, target_local_date ORDER BY label DESC, target_timestamp_utc) = 1 AS is_peak
        FROM regional p JOIN runs r ON {_RUN_OF} WHERE label IS NOT NULL AND prediction IS NOT NULL)"""


@query("forecast_run_id:s region_id:s target_timestamp_utc:t model:s hour_of_day:i forecast_mwh:r actual_mwh:r error_mwh:r absolute_error_mwh:r ape:r is_extreme:b is_peak:b", f"{_ACCURACY_SQL} ;; SELECT *, target_local_hour AS hour_of_day, prediction AS forecast_mwh, label AS actual_mwh, error AS error_mwh, abs_error AS absolute_error_mwh FROM acc")
def forecast_accuracy(spark, sf_dir):
    return accuracy(spark, sf_dir)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of silver hours, as a serving run would have left them: the lag of a week and the published forecast."""
    hours = _hours(spark, sf_dir)
    rows = _feature_rows(spark, sf_dir, hours)
    both = F.explode(F.array(F.struct(F.lit("seasonal_naive").alias("model"), F.col("demand_same_hour_minus_7d").alias("p")), F.struct(F.lit("eia_df").alias("model"), F.col("benchmark_eia_df_mwh").alias("p"))))
    made = rows.withColumn("m", both).select("*", "m.model", F.col("m.p").alias("prediction_mwh")).drop("m")
    end = F.when(F.col("model") == "eia_df", F.lit(None)).otherwise(F.lit("2024-03-15")).cast("date")
    made = made.withColumns({"train_end": end, "train_rows": F.lit(1).cast("long"), "fold": F.lit(0)})
    runs = forecast.forecast_runs(made)
    return forecast.served_accuracy(forecast.forecast_predictions(made, runs).filter("predicted_p50_mwh is not null"), runs, hours)


_SERVED_SQL = f"""{_FRAME},
sp AS (SELECT f.*, 'seasonal_naive' AS model, {_at('target_timestamp_utc', 168)} AS forecast_mwh FROM frame f
       UNION ALL SELECT f.*, 'eia_df', {_at('target_timestamp_utc', 0, 'forecast')} FROM frame f),
th AS (SELECT region_id, quantile_cont(demand, 0.95) AS extreme_threshold_mwh FROM lookup WHERE h <= TIMESTAMP '2024-03-15' AND demand IS NOT NULL GROUP BY region_id),
served AS (SELECT sp.*, demand AS actual_mwh, forecast_mwh - demand AS error_mwh, abs(forecast_mwh - demand) AS absolute_error_mwh, abs(forecast_mwh - demand) / nullif(abs(demand), 0) AS ape,
                  model = 'seasonal_naive' AND target_timestamp_utc <= TIMESTAMP '2024-03-15' AS is_in_sample, extreme_threshold_mwh, demand >= extreme_threshold_mwh AS is_extreme,
                  row_number() OVER (PARTITION BY sp.region_id, model, target_local_date ORDER BY demand DESC, target_timestamp_utc) = 1 AS is_peak,
                  hour(timezone('{a.TZ}', timezone('UTC', target_timestamp_utc))) AS hour_of_day
           FROM sp JOIN lookup x ON x.region_id = sp.region_id AND x.h = sp.target_timestamp_utc LEFT JOIN th ON th.region_id = sp.region_id WHERE forecast_mwh IS NOT NULL AND demand IS NOT NULL)"""


@query("region_id:s model:s target_timestamp_utc:t forecast_mwh:r actual_mwh:r error_mwh:r ape:r is_in_sample:b extreme_threshold_mwh:r is_extreme:b is_peak:b", f"{_SERVED_SQL} ;; SELECT * FROM served")
def served_accuracy(spark, sf_dir):
    return _served(spark, sf_dir)


@query("model:s n:i MAE_mwh:r MAPE_pct:r bias_mwh:r", f"{_SERVED_SQL} ;; SELECT model, count(*) AS n, avg(absolute_error_mwh) AS MAE_mwh, 100 * avg(ape) AS MAPE_pct, avg(error_mwh) AS bias_mwh FROM served GROUP BY 1")
def accuracy_summary(spark, sf_dir):
    return forecast.accuracy_summary(_served(spark, sf_dir))


@query("model:s rows_scored:i mae:r rmse:r mape_pct:r bias:r peak_mape_pct:r extreme_mape_pct:r benchmark_mae:r gap_pct:r", f"{_SERVED_SQL}, o AS (SELECT model, count(*) AS rows_scored, avg(absolute_error_mwh) AS mae, sqrt(avg(error_mwh * error_mwh)) AS rmse, 100 * avg(ape) AS mape_pct, avg(error_mwh) AS bias, 100 * avg(ape) FILTER (is_peak) AS peak_mape_pct, 100 * avg(ape) FILTER (is_extreme) AS extreme_mape_pct FROM served WHERE NOT is_in_sample GROUP BY 1), b AS (SELECT mae AS benchmark_mae FROM o WHERE model = 'eia_df') ;; SELECT *, 100 * (mae - benchmark_mae) / benchmark_mae AS gap_pct FROM o CROSS JOIN b")
def bi_measures(spark, sf_dir):
    return forecast.report_measures(_served(spark, sf_dir))


@query("model:s days:i peak_hit_pct:r", f"{_SERVED_SQL}, d AS (SELECT region_id, model, target_local_date, arg_max(hour_of_day, (actual_mwh, -epoch(target_timestamp_utc))) AS x, arg_max(hour_of_day, (forecast_mwh, -epoch(target_timestamp_utc))) AS y FROM served GROUP BY ALL) ;; SELECT model, count(*) AS days, 100.0 * avg((x = y)::INT) AS peak_hit_pct FROM d GROUP BY 1")
def peak_hit(spark, sf_dir):
    return forecast.peak_hit(_served(spark, sf_dir))


# ---- profiles


@query("region_id:s local_hour:i mean_mwh:r hours:i", f"{a.SILVER_SQL} ;; SELECT region_id, local_hour, avg(actual_demand_mwh) AS mean_mwh, count(actual_demand_mwh) AS hours FROM silver GROUP BY ALL")
def hour_profile(spark, sf_dir):
    return profiling.hour_profile(silver(spark, sf_dir))


@query("shift:i n:i mae:r corr:r", f"{a.SPINE_SQL} ;; SELECT shift, count(*) AS n, avg(abs(l.actual_demand_mwh - r.day_ahead_forecast_mwh)) AS mae, corr(l.actual_demand_mwh, r.day_ahead_forecast_mwh) AS corr FROM hours l CROSS JOIN (SELECT unnest([-2, -1, 0, 1]) AS shift) s JOIN hours r ON l.region_id = r.region_id AND l.event_timestamp_utc = r.event_timestamp_utc + to_hours(CAST(shift AS INTEGER)) WHERE l.actual_demand_mwh IS NOT NULL AND r.day_ahead_forecast_mwh IS NOT NULL GROUP BY 1")
def cross_lag(spark, sf_dir):
    return profiling.cross_lag(spine(spark, sf_dir))


@query("type:s lag_hours:r", f"{a.FEED_SQL} ;; SELECT type, (max(epoch_us(try_strptime(ingested_at, '%Y-%m-%dT%H:%M:%S.%f')) // 1000000) - max(epoch_us(try_strptime(period, '%Y-%m-%dT%H')) // 1000000)) / 3600 AS lag_hours FROM feed WHERE value IS NOT NULL GROUP BY 1")
def publication_lag(spark, sf_dir):
    return profiling.publication_lag(a.feed(spark, sf_dir))


@query("ordinary_day:b hours:i null_pct:r", f"{a.SILVER_SQL} ;; SELECT {a.day_hours_sql('local_date')} = 24 AS ordinary_day, count(*) AS hours, 100.0 * avg((actual_demand_mwh IS NULL)::INT) AS null_pct FROM silver GROUP BY 1")
def null_rate_by_daytype(spark, sf_dir):
    return profiling.null_rate_by_day_length(silver(spark, sf_dir), a.TZ)


@query("n:i mae:r corr:r", f"{a.WEATHER_SQL}, p AS (SELECT point_id, valid_timestamp_utc, max(CASE WHEN forecast_lead_days = 1 THEN temperature_c END) AS x, max(CASE WHEN forecast_lead_days = 2 THEN temperature_c END) AS y FROM w GROUP BY ALL) ;; SELECT count(*) AS n, avg(abs(x - y)) AS mae, corr(x, y) AS corr FROM p WHERE x IS NOT NULL AND y IS NOT NULL")
def vintage_gap(spark, sf_dir):
    return profiling.vintage_gap(clean_weather(spark, sf_dir))


@query("type:s p01:r p50:r p95:r p99:r low:r high:r", f"{a.FEED_SQL} ;; SELECT type, quantile_disc(v, 0.01) AS p01, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, quantile_disc(v, 0.99) AS p99, min(v) AS low, max(v) AS high FROM (SELECT type, try_cast(value AS DOUBLE) AS v FROM feed) WHERE v IS NOT NULL GROUP BY 1")
def source_profile(spark, sf_dir):
    return profiling.value_percentiles(a.feed(spark, sf_dir))


@query("respondent:s type:s rows:i first_period:s last_period:s", f"{a.FEED_SQL} ;; SELECT respondent, type, count(*) AS rows, min(period) AS first_period, max(period) AS last_period FROM feed GROUP BY 1, 2")
def source_facets(spark, sf_dir):
    return profiling.facets(a.feed(spark, sf_dir))


@query("type:s first_period:s", f"{a.FEED_SQL} ;; SELECT type, min(period) AS first_period FROM feed WHERE value IS NOT NULL GROUP BY 1")
def source_first_seen(spark, sf_dir):
    return profiling.first_seen(a.feed(spark, sf_dir))


@query("region_id:s year:i hours:i expected:i", f"{a.SILVER_SQL} ;; SELECT region_id, year(event_timestamp_utc) AS year, count(actual_demand_mwh) AS hours, dayofyear(make_date(any_value(year(event_timestamp_utc)), 12, 31)) * 24 AS expected FROM silver GROUP BY 1, 2")
def yearly_coverage(spark, sf_dir):
    return profiling.yearly_coverage(silver(spark, sf_dir))


@query("region_id:s year:i mean_peak:r growth_pct:r", f"{a.ORDERS_SQL}, d AS (SELECT region_id, target_local_date, max(label) AS peak FROM features GROUP BY 1, 2), y AS (SELECT region_id, year(target_local_date) AS year, avg(peak) AS mean_peak FROM d GROUP BY 1, 2) ;; SELECT *, 100 * (mean_peak - lag(mean_peak) OVER (PARTITION BY region_id ORDER BY year)) / lag(mean_peak) OVER (PARTITION BY region_id ORDER BY year) AS growth_pct FROM y")
def growth(spark, sf_dir):
    peaks = a.order_features(spark, sf_dir).groupBy("region_id", "target_local_date").agg(F.max(features.LABEL).alias("peak_demand_mwh"))
    return profiling.growth(peaks.withColumn("year", F.year("target_local_date")))


# ---- long lags, gates and ingestion


@query("region_id:s event_timestamp_utc:t demand:r demand_minus_100d:r demand_minus_365d:r", f"{a.ORDERS_SQL}, x AS (SELECT region_id, target_timestamp_utc AS h, label AS demand FROM features) ;; SELECT x.region_id, x.h AS event_timestamp_utc, x.demand, y.demand AS demand_minus_100d, z.demand AS demand_minus_365d FROM x LEFT JOIN x y ON y.region_id = x.region_id AND y.h = x.h - INTERVAL 2400 HOUR LEFT JOIN x z ON z.region_id = x.region_id AND z.h = x.h - INTERVAL 8760 HOUR WHERE x.demand IS NOT NULL")
def yearly_lag(spark, sf_dir):
    """Lags beyond one stretch of the window pass, on the hours of several years."""
    hours = a.order_features(spark, sf_dir).select("region_id", F.col("target_timestamp_utc").alias("event_timestamp_utc"), F.col(features.LABEL).alias("actual_demand_mwh"))
    flags = {"day_ahead_forecast_mwh": F.lit(None).cast("double"), **{name: F.lit(False) for name in features.FLAGS}}
    whole = hourly.hour_spine(hours).join(hours, ["region_id", "event_timestamp_utc"], "left").withColumns(flags)
    far = features.lagged(features.demand_lookup(whole), {"demand_minus_100d": ("demand", 2400), "demand_minus_365d": ("demand", 8760)})
    return far.filter("demand is not null")


@query("part:s rows:i first_date:d last_date:d trained_through:s", f"{a.ORDERS_SQL}, cut AS (SELECT date_trunc('month', max(forecast_date)) AS cut FROM features WHERE label IS NOT NULL), p AS (SELECT *, CASE WHEN forecast_date < cut THEN 'train' ELSE 'holdout' END AS part FROM features CROSS JOIN cut WHERE forecast_date < cut OR label IS NOT NULL) ;; SELECT part, count(*) AS rows, min(forecast_date) AS first_date, max(forecast_date) AS last_date, (SELECT strftime(max(forecast_date), '%Y-%m-%d') FROM p WHERE part = 'train') AS trained_through FROM p GROUP BY part")
def holdout_split(spark, sf_dir):
    train, holdout, through = split_holdout(a.order_features(spark, sf_dir))
    parts = train.withColumn("part", F.lit("train")).unionByName(holdout.withColumn("part", F.lit("holdout")))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.min("forecast_date").alias("first_date"), F.max("forecast_date").alias("last_date")).withColumn("trained_through", F.lit(through))


@query("model:s gate_holdout_mae:r gate_holdout_mape_pct:r gate_holdout_bias:r gate_holdout_rows:r", f"{a.ORDERS_SQL}, cut AS (SELECT date_trunc('month', max(forecast_date)) AS cut FROM features WHERE label IS NOT NULL) ;; SELECT 'seasonal_naive' AS model, avg(abs(naive - label)) AS gate_holdout_mae, 100 * avg(abs(naive - label) / abs(label)) AS gate_holdout_mape_pct, avg(naive - label) AS gate_holdout_bias, count(*) AS gate_holdout_rows FROM features CROSS JOIN cut WHERE forecast_date >= cut AND label IS NOT NULL")
def gate_score(spark, sf_dir):
    train, holdout, _ = split_holdout(a.order_features(spark, sf_dir))
    return evaluate.gate_scores(models.seasonal_naive(), train, holdout)


@query("fold:i candidate_mae:r champion_mae:r promote:b", f"{a.SCORED_SQL}, m AS (SELECT fold, avg(CASE WHEN model = 'seasonal_naive' THEN abs_error END) AS candidate_mae, avg(CASE WHEN model = 'eia_df' THEN abs_error END) AS champion_mae FROM scored GROUP BY fold) ;; SELECT *, champion_mae IS NULL OR candidate_mae <= 1.02 * champion_mae AS promote FROM m")
def promotion_rule(spark, sf_dir):
    return registry.promotions(evaluate.by(scored(spark, sf_dir), "fold"), "seasonal_naive", "eia_df", keys=("fold",))


@query("place:i model:s MAE_mwh:r", f"{a.SCORED_SQL}, o AS (SELECT model, avg(abs_error) AS MAE_mwh FROM scored GROUP BY 1) ;; SELECT row_number() OVER (ORDER BY CASE model WHEN 'seasonal_naive' THEN 1 WHEN 'eia_df' THEN 2 ELSE 9 END, model) AS place, * FROM o")
def display_order(spark, sf_dir):
    ordered = evaluate.display_order(evaluate.overall(scored(spark, sf_dir)))
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(evaluate.display_place(), "model")))


@query(f"region_id:s event_timestamp_utc:t local_date:d local_hour:i {_METRICS} day_ahead_forecast_as_published_mwh:r is_missing_hour:b is_demand_anomaly_suspect:b is_above_historical_record:b revision_count:i ingested_at:s", f"{a.SILVER_SQL} ;; SELECT * FROM silver")
def silver_by_touched_days(spark, sf_dir):
    """The silver hours in two batches: all but the last days' rows, then these, which rebuild only the days that they touch."""
    feed = staged(a.feed(spark, sf_dir), "feed")
    cut = feed.agg(F.date_format(F.date_sub(F.to_date(F.to_timestamp(F.max("ingested_at"))), 2), "yyyy-MM-dd").alias("cut")).first()["cut"]
    target = place(spark, "silver")
    early, late = feed.filter(F.col("ingested_at") < cut), feed.filter(F.col("ingested_at") >= cut)
    rebuild_days(spark, early, early, target, a.EVENTS)
    rebuild_days(spark, feed, late, target, a.EVENTS)
    return spark.read.parquet(target)


@query(f"region_id:s event_timestamp_utc:t local_date:d local_hour:i {_METRICS} day_ahead_forecast_as_published_mwh:r is_missing_hour:b is_demand_anomaly_suspect:b is_above_historical_record:b revision_count:i ingested_at:s", f"{a.SILVER_SQL} ;; SELECT * FROM silver")
def silver_by_stream(spark, sf_dir):
    """The silver hours by the stream of a landed feed; two rows of no type, far ahead, let it end."""
    at = place(spark, "silver-stream")
    feed = staged(a.feed(spark, sf_dir), "feed")
    last = F.date_add(F.to_date(F.to_timestamp(F.max("ingested_at"))), 400)
    for number in range(3):
        rows = feed
        if number:
            beat = feed.agg(F.date_format(F.date_add(last, number), "yyyy-MM-dd'T'HH").alias("period"))
            rows = beat.select("period", *[F.lit(None).cast(f.dataType).alias(f.name) for f in feed.schema if f.name != "period"])
        rows.select(*feed.columns).write.mode("append").parquet(f"{at}/landed")
        hours = follow(spark, f"{at}/landed", feed.schema, f"{at}/hours", f"{at}/checkpoint", a.EVENTS, "60 days")
    return finished(hours, a.EVENTS)


@query("event_type:s rows:i event_ids:i rows_of_second_run:i", "SELECT event_type, count(*) AS rows, count(DISTINCT event_id) AS event_ids, 0 AS rows_of_second_run FROM events GROUP BY 1")
def stream_ingest_rows(spark, sf_dir):
    """The events file as a landing tree, streamed twice into a table: the second run adds nothing."""
    at = place(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ingested = [ingest(spark, f"{sf_dir}/event[s].parquet", schema, f"{at}/bronze", f"{at}/checkpoint") for _ in range(2)]
    rows = spark.read.parquet(f"{at}/bronze").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_id").alias("event_ids"))
    return rows.withColumn("rows_of_second_run", F.lit(ingested[1]))


@query("event_type:s hour:t n:i cents:i", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL")
def tumbling_hours(spark, sf_dir):
    return hourly_counts(load(spark, sf_dir, "events"))


# ---- fitted models: no SQL


@query("model:s fold:i target_timestamp_utc:t prediction_mwh:r abs_error_mwh:r")
def gbt_backtest(spark, sf_dir):
    """All folds of the backtest with boosted trees, plain and as a ratio."""
    rows = a.order_features(spark, sf_dir)
    inputs = ["target_local_hour", "is_weekend", "demand_same_hour_minus_7d", "benchmark_eia_df_mwh"]
    trees = [models.GbtModel("gbt", inputs), models.GbtRatioModel("gbt_ratio", inputs, baseline="demand_same_hour_minus_7d")]
    return backtest.run_backtest(rows, trees, _folds(spark, sf_dir))
