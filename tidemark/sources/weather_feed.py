"""Archived weather forecasts as a Python data source: one input partition per stretch of months.

A request covers all points and leads of a stretch and is pinned to UTC, since a local zone would
hide the days of 23 and 25 hours. Each answer is one row of JSON text, which
``landing.flatten_weather`` turns into hours. Options: ``start``, ``end`` (dates), ``months`` of a
stretch, and ``transport`` as for the REST feed.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.config import WEATHER_POINTS, WEATHER_VARIABLES
from tidemark.sources.landing import LEADS
from tidemark.sources.rest import TransportError, call, first_day

CHUNK_MONTHS = 6


class PayloadError(RuntimeError):
    """An answer that says what is wrong instead of giving hours. Asking again does not mend it."""


def request(start: date, end: date, points: dict[str, tuple[float, float]] = WEATHER_POINTS, leads: tuple[int, ...] = LEADS) -> dict:
    """Parameters of one call: all points, all variables of all leads, hours in UTC."""
    places = list(points.values())
    series = [f"{stem}_previous_day{lead}" for lead in leads for stem in WEATHER_VARIABLES]
    joined = lambda k: ",".join(str(p[k]) for p in places)
    return {"latitude": joined(0), "longitude": joined(1), "start_date": start.isoformat(), "end_date": end.isoformat(), "hourly": ",".join(series), "timezone": "UTC"}


def fetch(transport: Callable[[dict], object], start: date, end: date, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """The locations of one stretch, with the waits of ``rest.call`` between attempts."""
    answer = call(transport, request(start, end), sleep)
    places = answer if isinstance(answer, list) else [answer]
    wrong = next((p for p in places if p.get("error") or "reason" in p), None)
    if wrong is not None:
        raise PayloadError(str(wrong.get("reason", "no reason"))[:300])
    return places


def chunks(start: date, end: date, months: int = CHUNK_MONTHS) -> list[tuple[date, date]]:
    """Stretches of whole months after the first, cut to the range."""
    out, first = [], start
    while first <= end:
        number = first.year * 12 + first.month - 1 + months
        following = date(number // 12, number % 12 + 1, 1)
        last = min(end, following - timedelta(days=1))
        out.append((first, last))
        first = last + timedelta(days=1)
    return out


class _Stretch(InputPartition):
    def __init__(self, start: date, end: date) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[InputPartition]:
        span = (date.fromisoformat(self.options[k]) for k in ("start", "end"))
        return [_Stretch(a, b) for a, b in chunks(*span, int(self.options.get("months", CHUNK_MONTHS)))]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        module, _, name = self.options["transport"].partition(":")
        places = fetch(getattr(importlib.import_module(module), name), partition.start, partition.end)
        yield (f"weather/{partition.start}_{partition.end}.parquet", json.dumps(places))


class WeatherFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "weather_feed"

    def schema(self) -> str:
        return "chunk string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def first_weather_day(transport: Callable[[dict], dict], low: date, high: date) -> date | None:
    """The first day for which the archive has a value of the first lead, asked of the source itself; a day that it refuses has none."""

    def has_data(day: date) -> bool:
        try:
            places = fetch(transport, day, day)
        except (PayloadError, TransportError):
            return False
        series = [s for place in places for name, s in place.get("hourly", {}).items() if name.endswith("_previous_day1")]
        return any(v is not None for s in series for v in s)

    return first_day(has_data, low, high)
