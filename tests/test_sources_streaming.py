"""Landing, REST paging, tables, streaming ingestion, the task runner."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.plans import pipeline
from tidemark.sources import landing, rest, tables
from tidemark.streaming import ingest

RECORDS = [{"period": f"2024-01-0{d}T0{h}", "respondent": "R0", "respondent-name": "Region", "type": "D", "type-name": "Demand", "value": None if h == 1 else 1000 * d + h, "value-units": "MWh"} for d in (1, 2) for h in range(3)]


def transport(params):
    rows = [r for r in RECORDS if params["start"] <= r["period"] <= params["end"] and r["type"] in params["facets"]["type"]]
    return {"response": {"total": len(rows), "data": rows[params["offset"] : params["offset"] + params["length"]]}}


def test_pages_stop_at_the_total():
    got = list(rest.pages(transport, "2024-01-01T00", "2024-01-31T23", ["D"], "R0", page=4))
    assert [len(p) for p in got] == [4, 2]
    assert list(rest.pages(transport, "2025-01-01T00", "2025-01-31T23", ["D"], "R0")) == []


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky(params):
        calls.append(1)
        if len(calls) < 4:
            raise rest.TransportError("busy", 503)
        return {"response": {"total": 0, "data": []}}

    rest.call(flaky, {}, waits.append)
    assert waits == [1, 2, 4]

    def broken(params):
        raise rest.TransportError("no", 403)

    with pytest.raises(rest.TransportError):
        rest.call(broken, {}, waits.append)
    assert len(waits) == 3

    def silent(params):
        raise rest.TransportError("no answer")

    waits.clear()
    with pytest.raises(rest.TransportError):
        rest.call(silent, {}, waits.append)
    assert waits == [1, 2, 4, 8]


def test_month_list():
    from datetime import date

    assert rest.months(date(2023, 12, 15), date(2024, 2, 3)) == [("2023-12-15T00", "2023-12-31T23"), ("2024-01-01T00", "2024-01-31T23"), ("2024-02-01T00", "2024-02-03T23")]


def test_data_source(spark):
    spark.dataSource.register(rest.RestFeed)
    rows = spark.read.format("rest_feed").option("start", "2023-12-01").option("end", "2024-01-31").option("transport", "tests.test_sources_streaming:transport").option("page", "4").load()
    assert rows.count() == 6 and rows.filter("value is null").count() == 2


def test_normalise_keeps_values_as_text(spark):
    raw = spark.createDataFrame([json.dumps(r) for r in RECORDS], "string")
    parsed = raw.select(F.from_json("value", "period string, respondent string, `respondent-name` string, type string, value long").alias("r")).select("r.*")
    rows = landing.normalise_records(parsed, "now", "f.parquet")
    assert dict(rows.dtypes) == {n: "string" for n in (c.split()[0] for c in landing.FEED_SCHEMA.split(", "))}
    assert rows.filter("value is null").count() == 2 and rows.first().value_units is None


def feed(spark, days=(1, 2)):
    rows = [(r["period"], "R0", "n", "D", "t", None if r["value"] is None else str(r["value"]), "u", "api", "f", "now") for r in RECORDS if int(r["period"][9]) in days]
    return spark.createDataFrame(rows, landing.FEED_SCHEMA)


def test_landing_appends_and_skips_blank_days(spark, tmp_path):
    root = str(tmp_path / "landing")
    blank = feed(spark).limit(1).withColumn("period", F.lit(" "))
    landing.write_landing(feed(spark).union(blank), root)
    landing.write_landing(feed(spark), root)
    back = landing.read_landing(spark, root)
    assert back.count() == 12 and {str(r.date) for r in back.select("date").distinct().collect()} == {"2024-01-01", "2024-01-02"}
    pruned = back.filter("date = '2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in pruned


def test_stream_ingests_each_file_once(spark, tmp_path):
    root, target, checkpoint = (str(tmp_path / x) for x in ("landing", "bronze", "checkpoint"))
    landing.write_landing(feed(spark, (1,)), root)
    schema = landing.FEED_SCHEMA + ", date string"
    assert ingest.ingest(spark, root, schema, target, checkpoint) == 3
    ingest.assert_idempotent(spark, root, schema, target, checkpoint)
    landing.write_landing(feed(spark, (2,)), root)
    assert ingest.ingest(spark, root, schema, target, checkpoint) == 3
    bronze = spark.read.parquet(target)
    assert bronze.count() == 6 and bronze.filter("_source_file not like '%.parquet' or _file_modified is null").isEmpty()


def test_streaming_hours_equal_batch(spark, tmp_path):
    rows = spark.range(200).select(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 97).alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"), (F.col("id") / 8).alias("value"))
    source = str(tmp_path / "events")
    rows.repartition(4).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    query = ingest.hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r.hour, r.event_type)
    assert sorted(spark.table("hours").collect(), key=key) == sorted(ingest.hourly_counts(rows).collect(), key=key)


def test_tables(spark, tmp_path):
    tables.use_namespace(spark, "tidemark_test")
    tables.rebuild(feed(spark), "feed")
    tables.rebuild(feed(spark).select("period"), "feed")
    assert spark.table("feed").columns == ["period"]
    spark.sql("DROP DATABASE tidemark_test CASCADE")
    spark.catalog.setCurrentDatabase("default")
    tables.append(feed(spark).select("period"), str(tmp_path / "t"))
    tables.append(feed(spark).select("period", "type"), str(tmp_path / "t"))
    assert tables.read(spark, str(tmp_path / "t")).columns == ["period", "type"]
    tables.export_single(feed(spark), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1


def test_naive_times_become_instants(spark, tmp_path):
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(str(tmp_path / "events.parquet"))
    assert dict(tables.load(spark, str(tmp_path), "events").dtypes) == {"ts": "timestamp"}


def test_runner():
    seen = []
    task = lambda name, *needs, **kw: pipeline.Task(name, lambda results: seen.append(name) or {"rows": len(results)}, needs, **kw)
    pipeline.run([task("c", "a", "b"), task("b", "a"), task("a")])
    assert seen == ["a", "b", "c"]
    with pytest.raises(ValueError, match="circle"):
        pipeline.ordered([task("a", "b"), task("b", "a")])
    with pytest.raises(ValueError, match="no task"):
        pipeline.ordered([task("a", "x")])
    with pytest.raises(RuntimeError, match="rows is 0"):
        pipeline.run([task("a", check=pipeline.at_least("rows", 1))])


def test_post_conditions():
    good = {"ingest": {"feed": {"rows": 1}, "weather": {"rows": 2}}, "bronze": {"rows": 1}, "silver": {"electricity_hourly": 1, "weather_forecast_hourly": 1, "electricity_quarantine": 0}, "gold": {"daily_summary": 1}, "features": {"rows": 1, "labelled": 1}, "leakage_audit": {"pairs": 1, "violations": 0, "known_leaky_caught": 5}, "forecast": {"predictions": 1}, "accuracy": {"rows": 1}}
    assert pipeline.evaluate({k: json.dumps(v) for k, v in good.items()}, pipeline.DAILY_CHECKS) == []
    assert pipeline.evaluate(good | {"leakage_audit": {"pairs": 0, "violations": 0, "known_leaky_caught": 5}}, pipeline.DAILY_CHECKS)
    assert pipeline.evaluate(good | {"bronze": "not json"}, pipeline.DAILY_CHECKS) == ["bronze: the summary is no object"]
    assert pipeline.evaluate(good | {"gold": {"daily_summary": "many"}}, pipeline.DAILY_CHECKS)
    del good["accuracy"]
    assert pipeline.evaluate(good, pipeline.DAILY_CHECKS) == ["accuracy: no summary"]
