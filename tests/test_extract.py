"""The weather data source, and the modes of extraction, against transports that answer from memory."""

import json
from datetime import date

import pytest

from tests.test_sources_streaming import feed
from tidemark.plans import extract
from tidemark.plans.daily import DailySettings, daily_tasks
from tidemark.sources import landing, rest, tables, weather_feed
from tidemark.streaming import ingest

HERE = "tests.test_extract"


def feed_answer(params):
    day = params["start"][:10]
    rows = [{"period": f"{day}T{h:02}", "respondent": params["facets"]["respondent"][0], "type": t, "value": 70000 + h} for t in params["facets"]["type"] for h in range(3)]
    return {"response": {"total": len(rows), "data": rows[params["offset"] : params["offset"] + params["length"]]}}


def weather_answer(params):
    assert params["timezone"] == "UTC"
    series = {name: [float(k), None] for k, name in enumerate(params["hourly"].split(","))}
    hours = [f"{params['start_date']}T00:00", f"{params['start_date']}T01:00"]
    return [{"latitude": float(a), "longitude": float(b), "hourly": {"time": hours, **series}} for a, b in zip(params["latitude"].split(","), params["longitude"].split(","))]


def nothing(params):
    return {"response": {"total": 0, "data": []}}


def settings(**own):
    return extract.ExtractSettings(f"{HERE}:feed_answer", f"{HERE}:weather_answer", today=date(2024, 3, 20), run_at="2024-03-20T06:00:00", **own)


def test_request_names_all_points_and_leads():
    asked = weather_feed.request(date(2024, 1, 1), date(2024, 1, 2))
    assert len(asked["latitude"].split(",")) == 8 and len(asked["hourly"].split(",")) == 12 and asked["timezone"] == "UTC"


def test_a_reason_is_an_error_and_is_not_asked_again():
    calls = []

    def wrong(params):
        calls.append(1)
        return {"error": True, "reason": "too far back"}

    with pytest.raises(weather_feed.PayloadError, match="too far back"):
        weather_feed.fetch(wrong, date(2024, 1, 1), date(2024, 1, 1))
    assert len(calls) == 1


def test_weather_is_asked_again_after_a_failure():
    waits, calls = [], []

    def flaky(params):
        calls.append(1)
        if len(calls) < 3:
            raise rest.TransportError("busy", 503)
        return weather_answer(params)

    assert len(weather_feed.fetch(flaky, date(2024, 1, 1), date(2024, 1, 1), waits.append)) == 8 and waits == [1, 2]


def test_chunks_cover_the_range():
    found = weather_feed.chunks(date(2021, 3, 24), date(2022, 5, 3))
    assert found == [(date(2021, 3, 24), date(2021, 8, 31)), (date(2021, 9, 1), date(2022, 2, 28)), (date(2022, 3, 1), date(2022, 5, 3))]


def test_ranges():
    day = date(2024, 3, 20)
    assert extract.ranges("incremental", day) == {"feed": (date(2024, 3, 6), day), "weather": (date(2024, 3, 6), date(2024, 3, 19))}
    assert extract.ranges("backfill", day) == {"feed": (date(2019, 1, 1), day), "weather": (date(2021, 3, 24), date(2024, 3, 19))}
    assert extract.ranges("incremental", date(2019, 1, 5))["feed"] == (date(2019, 1, 1), date(2019, 1, 5))
    with pytest.raises(ValueError, match="mode is"):
        extract.ranges("probe", day)


def test_an_incremental_run_lands_new_vintages(spark, tmp_path):
    root = str(tmp_path)
    first = extract.extract(spark, root, settings())
    assert first["feed"]["rows"] == 12 and first["weather"]["rows"] == 8 * 2 * 2 and first["feed"]["from"] == "2024-03-06"
    again = extract.extract(spark, root, settings())
    assert again["feed"]["files"] > 0 and spark.read.parquet(f"{root}/feed").count() == 24
    rows = spark.read.schema(landing.FEED_SCHEMA).parquet(f"{root}/feed")
    assert rows.filter("ingested_at is null or value is null or source_file not like 'feed/2024-03%'").isEmpty()


def test_nothing_landed_is_a_failure(spark, tmp_path):
    empty = extract.ExtractSettings(f"{HERE}:nothing", f"{HERE}:weather_answer", today=date(2024, 3, 20), run_at="now")
    with pytest.raises(RuntimeError, match="nothing was landed for feed"):
        extract.extract(spark, str(tmp_path), empty)


def test_the_daily_run_can_fetch(spark, tmp_path):
    task = daily_tasks(spark, DailySettings(str(tmp_path / "landing"), str(tmp_path / "tables"), extract=settings()))[0]
    summary = json.loads(json.dumps(task.run({})))
    assert task.check(summary) == [] and summary["mode"] == "incremental"


def test_probe_lands_nothing(spark, tmp_path):
    found = extract.probe(spark, settings(), date(2024, 3, 1))
    assert found["feed"].count() == 12
    row = found["weather"].filter("point_id = 'newark_pseg' and forecast_lead_days = 1").first()
    assert (row.hours, row.temperature_c) == (2, 1)


def test_pages_warn_of_a_wrong_total():
    with pytest.warns(UserWarning, match="1 rows of 5 announced"):
        list(rest.pages(lambda params: {"response": {"total": 5, "data": [{}]}}, "a", "b", ["D"], "R0"))


def test_a_later_column_widens_the_table(spark, tmp_path):
    root, target, checkpoint = (str(tmp_path / x) for x in ("landing", "bronze", "checkpoint"))
    landing.write_landing(feed(spark, (1,)), root)
    assert ingest.ingest(spark, root, None, target, checkpoint) == 3
    landing.write_landing(feed(spark, (2,)).selectExpr("*", "'new' as quality"), root)
    assert ingest.ingest(spark, root, None, target, checkpoint) == 3
    rows = tables.read(spark, target)
    assert rows.filter("quality = 'new'").count() == 3 and rows.filter("quality is null").count() == 3
