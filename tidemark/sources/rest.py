"""A paged REST feed as a Python data source: one input partition per month window.

Options: ``start``, ``end`` (dates), ``types`` (comma-separated), ``respondent``, ``page`` (rows of a
page) and ``transport``, a ``module:function`` that answers ``f(params: dict) -> dict`` and stands
for the network. Register with ``spark.dataSource.register(RestFeed)`` and read with
``spark.read.format("rest_feed")``.

With the option ``narrow`` filters on ``period``, ``type`` and ``respondent`` reach the requests, in sessions that hand
them down (``spark.sql.python.filterPushdown.enabled``; ``read_feed`` sets the option by that): months outside are not asked for, the others only for the
hours and types that can pass. Spark still applies every filter itself.

``spark.readStream.format("rest_feed")`` reads the same feed as a stream whose offsets are hours. Each batch
asks for the hours from where the last one ended to the newest that the source has, ``look_back_hours`` before
them too, since sources revise recent hours. The checkpoint holds the offset, so a restart asks for no hour twice
but those of the look-back.
"""

from __future__ import annotations

import importlib
import time
import warnings
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

PAGE = 5000
ATTEMPTS = 5
FIRST_WAIT, LONGEST_WAIT = 1.0, 60.0
RETRIED = frozenset({429, 500, 502, 503, 504})


class TransportError(RuntimeError):
    """A failed call; ``status`` is the HTTP status, or None if there was no answer."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def call(transport: Callable[[dict], dict], params: dict, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One request with growing waits between attempts; a status that retrying cannot mend raises at once."""
    wait = FIRST_WAIT
    for attempt in range(1, ATTEMPTS + 1):
        try:
            return transport(params)
        except TransportError as error:
            if attempt == ATTEMPTS or (error.status is not None and error.status not in RETRIED):
                raise
        sleep(wait)
        wait = min(2 * wait, LONGEST_WAIT)
    raise AssertionError("unreachable")


def query(start: str, end: str, types: list[str], respondent: str, offset: int, length: int, direction: str = "asc") -> dict:
    return {"frequency": "hourly", "data": ["value"], "facets": {"respondent": [respondent], "type": types}, "start": start, "end": end, "sort": [{"column": "period", "direction": direction}], "offset": offset, "length": length}


def pages(transport: Callable[[dict], dict], start: str, end: str, types: list[str], respondent: str, page: int = PAGE, sleep: Callable[[float], None] = time.sleep) -> Iterator[list[dict]]:
    """Pages until the total that the first answer announces, an empty page or a short one. Fewer or more rows than announced give a warning."""
    seen, total = 0, None
    while True:
        answer = call(transport, query(start, end, types, respondent, seen, min(page, PAGE)), sleep)["response"]
        total = int(answer.get("total", 0)) if total is None else total
        rows = answer.get("data") or []
        if rows:
            yield rows
        seen += len(rows)
        if len(rows) < min(page, PAGE) or seen >= total:
            break
    if seen != total:
        warnings.warn(f"{start} to {end}: {seen} rows of {total} announced", stacklevel=2)


def has_hours(transport: Callable[[dict], dict], day: date, types: list[str], respondent: str, sleep: Callable[[float], None] = time.sleep) -> bool:
    """Whether the source has a row of a day, in one request for one row."""
    answer = call(transport, query(f"{day}T00", f"{day}T23", types, respondent, 0, 1), sleep)["response"]
    return bool(answer.get("data"))


def first_day(has_data: Callable[[date], bool], low: date, high: date) -> date | None:
    """The first day with data from ``low`` to ``high``, by halving; None if ``high`` has none. Data that once begin are taken to go on, so about log2 of the days are asked for."""
    if not has_data(high):
        return None
    while low < high:
        middle = low + timedelta(days=(high - low).days // 2)
        low, high = (low, middle) if has_data(middle) else (middle + timedelta(days=1), high)
    return high


def first_days(transport: Callable[[dict], dict], types: list[str], respondent: str, low: date, high: date) -> dict[str, date | None]:
    """``first_day`` of each type of the feed, asked of the source itself."""
    return {t: first_day(lambda day, t=t: has_hours(transport, day, [t], respondent), low, high) for t in types}


def newest(transport: Callable[[dict], dict], types: list[str], respondent: str, start: str, end: str, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The newest hour that the source has in a range, in one request for one row."""
    rows = call(transport, query(start, end, types, respondent, 0, 1, "desc"), sleep)["response"].get("data")
    return rows[0]["period"] if rows else None


def months(start: date, end: date) -> list[tuple[str, str]]:
    """Calendar-month windows with hours, cut to the range."""
    out, first = [], start
    while first <= end:
        following = (first.replace(day=28) + timedelta(days=4)).replace(day=1)
        out.append((f"{first:%Y-%m-%d}T00", f"{min(end, following - timedelta(days=1)):%Y-%m-%d}T23"))
        first = following
    return out


class _Window(InputPartition):
    def __init__(self, start: str, end: str) -> None:
        super().__init__((start, end))
        self.start, self.end = start, end


class _Requests:
    """What the options ask for, and how a window of it is read."""

    def __init__(self, options: dict) -> None:
        self.options = options
        self.types = [t for t in options.get("types", "D,DF,NG,TI").split(",") if t]
        self.respondent = options.get("respondent", "R0")

    def transport(self) -> Callable[[dict], dict]:
        module, _, name = self.options["transport"].partition(":")
        return getattr(importlib.import_module(module), name)

    def rows(self, window: _Window) -> Iterator[tuple]:
        for page in pages(self.transport(), window.start, window.end, self.types, self.respondent, int(self.options.get("page", PAGE))):
            for row in page:
                value = row.get("value")
                yield (row.get("period"), row.get("respondent"), row.get("respondent-name"), row.get("type"), row.get("type-name"), None if value is None else str(value), row.get("value-units"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.requests = _Requests(options)
        self.windows = months(date.fromisoformat(options["start"]), date.fromisoformat(options["end"]))

    def partitions(self) -> list[InputPartition]:
        return [_Window(a, b) for a, b in self.windows] if self.requests.types else []

    def read(self, partition: _Window | None) -> Iterator[tuple]:
        return self.requests.rows(partition) if partition is not None else iter(())


class _NarrowingReader(_Reader):
    """A reader that takes filters. Spark refuses it where the session does not hand filters down."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows windows and types by what can pass; every filter also stays with Spark."""
        for f in filters:
            self._narrow(f)
            yield f

    def _narrow(self, f: Filter) -> None:
        name = getattr(f, "attribute", ())
        if name == ("period",) and isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
            # Only an hour can begin or end a request; a part of one still prunes.
            self.windows = [(max(a, f.value) if len(f.value) == len(a) else a, b) for a, b in self.windows if b >= f.value]
        if name == ("period",) and isinstance(f, LessThan | LessThanOrEqual | EqualTo):
            self.windows = [(a, min(b, f.value) if len(f.value) == len(b) else b) for a, b in self.windows if a <= f.value]
        if isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            if name == ("type",):
                self.requests.types = [t for t in self.requests.types if t in values]
            if name == ("respondent",) and self.requests.respondent not in values:
                self.windows = []


HOUR = "%Y-%m-%dT%H"


def _moved(period: str, hours: int) -> str:
    return (datetime.strptime(period, HOUR) + timedelta(hours=hours)).strftime(HOUR)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the next hour to ask for. ``start`` is the first day; ``end``, if given, the last."""

    def __init__(self, options: dict) -> None:
        self.requests, self.options = _Requests(options), options
        self.begin = f"{options['start']}T00"
        self.end = f"{options.get('end', '9999-12-31')}T23"
        self.look_back = int(options.get("look_back_hours", 0))

    def initialOffset(self) -> dict:
        return {"next": self.begin}

    def latestOffset(self) -> dict:
        last = newest(self.requests.transport(), self.requests.types, self.requests.respondent, self.begin, self.end)
        return {"next": self.begin if last is None else _moved(last, 1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A window for each month of the new hours and those looked back on."""
        first, last = max(self.begin, _moved(start["next"], -self.look_back)), _moved(end["next"], -1)
        whole = months(date.fromisoformat(first[:10]), date.fromisoformat(last[:10]))
        return [_Window(max(a, first), min(b, last)) for a, b in whole]

    def read(self, partition: _Window) -> Iterator[tuple]:
        return self.requests.rows(partition)


class RestFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rest_feed"

    def schema(self) -> str:
        return "period string, respondent string, respondent_name string, type string, type_name string, value string, value_units string"

    def reader(self, schema) -> DataSourceReader:
        return _NarrowingReader(self.options) if self.options.get("narrow") == "true" else _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read_feed(spark: SparkSession, **options: str) -> DataFrame:
    """The feed as a table, with filters in its requests where the session hands them down."""
    spark.dataSource.register(RestFeed)
    handed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(RestFeed.name()).options(narrow=handed, **options).load()
