"""Filters that reach the source's requests, first days by search, and the feed as a stream; requests are counted in a file, since tasks make them in other processes."""

import json
import os
import tempfile
from datetime import date, datetime, timedelta

import pytest

from tests.test_extract import weather_answer
from tidemark.sources import rest, weather_feed

HERE = "tests.test_rest_pushdown"
FIRST = datetime(2023, 11, 20)
#: Where the requests are noted, and how many hours the source has.
NOTES = os.path.join(tempfile.gettempdir(), f"tidemark-test-notes-{os.getuid()}")


def hours():
    with open(NOTES + ".hours") as held:
        return int(held.read())


def grown(n):
    with open(NOTES + ".hours", "w") as held:
        held.write(str(n))


def source(params):
    with open(NOTES, "a") as notes:
        notes.write(json.dumps(params) + "\n")
    rows = [{"period": f"{FIRST + timedelta(hours=h):%Y-%m-%dT%H}", "respondent": "R0", "type": t, "value": h} for h in range(hours()) for t in ("D", "DF", "NG", "TI")]
    rows = [r for r in rows if params["start"] <= r["period"] <= params["end"] and r["type"] in params["facets"]["type"]]
    rows = sorted(rows, key=lambda r: r["period"], reverse=params["sort"][0]["direction"] == "desc")
    return {"response": {"total": len(rows), "data": rows[params["offset"] : params["offset"] + params["length"]]}}


def asked():
    with open(NOTES) as notes:
        return [json.loads(line) for line in notes]


@pytest.fixture
def notes(spark):
    open(NOTES, "w").close()
    grown(24 * 90)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(rest.RestFeed)
    yield
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def batch(spark, **options):
    return rest.read_feed(spark, start="2023-11-01", end="2024-02-29", transport=f"{HERE}:source", **options)


@pytest.fixture
def reader():
    def made(*filters):
        held = rest._NarrowingReader({"start": "2023-11-01", "end": "2024-02-29", "transport": f"{HERE}:source"})
        assert list(held.pushFilters(list(filters))) == list(filters)  # Spark applies every filter itself
        return held

    return made


def test_filters_narrow_windows_and_types(reader):
    E, G, L, I = rest.EqualTo, rest.GreaterThanOrEqual, rest.LessThan, rest.In  # noqa: E741
    windows = lambda *f: [(p.start, p.end) for p in reader(*f).partitions()]
    assert len(windows()) == 4
    assert windows(G(("period",), "2024-01-10T05"), L(("period",), "2024-02-02T00")) == [("2024-01-10T05", "2024-01-31T23"), ("2024-02-01T00", "2024-02-02T00")]
    assert windows(E(("period",), "2023-12-24T10")) == [("2023-12-24T10", "2023-12-24T10")]
    assert windows(G(("period",), "2024-02-10")) == [("2024-02-01T00", "2024-02-29T23")]
    assert reader(I(("type",), ("NG", "D", "XX"))).requests.types == ["D", "NG"]
    assert windows(E(("type",), "XX")) == [] and windows(E(("respondent",), "R1")) == [] and len(windows(E(("respondent",), "R0"))) == 4
    assert len(windows(E(("value",), "5"))) == 4


def test_a_query_asks_for_what_can_pass(spark, notes):
    rows = batch(spark).filter("type = 'D' and period >= '2024-01-10T00' and period < '2024-01-12T00'").collect()
    assert len(rows) == 48 and {r.type for r in rows} == {"D"}
    requests = asked()
    assert {(r["start"], r["end"]) for r in requests} == {("2024-01-10T00", "2024-01-12T00")} and {tuple(r["facets"]["type"]) for r in requests} == {("D",)}
    assert batch(spark).filter("respondent = 'other'").count() == 0 and asked() == requests


def test_first_day_by_halving():
    calls = []

    def since(first):
        def has(day):
            calls.append(day)
            return day >= first

        return has

    low, high = date(2020, 1, 1), date(2022, 1, 1)
    for first in (low, date(2020, 1, 2), date(2021, 3, 24), high):
        calls.clear()
        assert rest.first_day(since(first), low, high) == first
        assert len(calls) <= 12 and len(set(calls)) == len(calls)
    assert rest.first_day(since(date(2030, 1, 1)), low, high) is None


def test_first_days_are_asked_of_the_source(notes):
    found = rest.first_days(source, ["D", "XX"], "R0", date(2019, 1, 1), date(2024, 1, 1))
    assert found == {"D": FIRST.date(), "XX": None}
    requests = asked()
    assert len(requests) <= 14 and {r["length"] for r in requests} == {1}


def test_first_weather_day():
    def archive(params):
        if params["start_date"] < "2021-01-01":
            raise rest.TransportError("out of range", 400)
        answer = weather_answer(params)
        if params["start_date"] < "2021-03-24":
            for place in answer:
                place["hourly"] = {k: v if k == "time" else [None] * len(v) for k, v in place["hourly"].items()}
        return answer

    assert weather_feed.first_weather_day(archive, date(2020, 1, 1), date(2022, 1, 1)) == date(2021, 3, 24)


def streamed(spark, place, **options):
    rows = spark.readStream.format("rest_feed").options(start="2023-11-01", transport=f"{HERE}:source", **options).load()
    rows.writeStream.format("parquet").option("path", f"{place}/table").option("checkpointLocation", f"{place}/checkpoint").trigger(once=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/table")


def test_a_stream_of_hours_equals_the_batch_and_asks_for_nothing_twice(spark, notes, tmp_path):
    place = str(tmp_path / "s")
    grown(24 * 30)
    assert streamed(spark, place).count() == 24 * 30 * 4
    before = len(asked())
    grown(24 * 75 + 5)
    rows = streamed(spark, place)  # a new query on the same checkpoint: a restart
    fresh = [r for r in asked()[before:] if r["length"] > 1]
    end = f"{FIRST + timedelta(days=30):%Y-%m-%dT%H}"
    assert fresh and min(r["start"] for r in fresh) == end
    assert streamed(spark, place).count() == rows.count() == (24 * 75 + 5) * 4
    key = ["period", "respondent", "type", "value"]
    want = batch(spark).select(*key)
    assert rows.select(*key).exceptAll(want).isEmpty() and want.exceptAll(rows.select(*key)).isEmpty()


def test_the_look_back_asks_again_for_recent_hours_only(spark, notes, tmp_path):
    place = str(tmp_path / "s")
    grown(24 * 30)
    streamed(spark, place, look_back_hours="48")
    before = len(asked())
    grown(24 * 31)
    assert streamed(spark, place, look_back_hours="48").count() == (24 * 31 + 48) * 4
    again = [r for r in asked()[before:] if r["length"] > 1]
    assert min(r["start"] for r in again) == f"{FIRST + timedelta(days=28):%Y-%m-%dT%H}"
