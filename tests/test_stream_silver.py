"""The streaming silver table equals the batch one, after each of its files has come and the watermark has passed."""

import random
from datetime import datetime, timedelta

import pytest

from tests.test_rebuild import KINDS, frame
from tidemark.plans.silver import SILVER, build_silver
from tidemark.sources import landing
from tidemark.streaming import silver

START = datetime(2024, 3, 4)


def row(draw, hour, seen, region=None, value=None):
    value = value or draw.choice([str(draw.randrange(20_000, 60_000)), str(draw.randrange(20_000, 60_000)), str(draw.randrange(120_000, 200_000)), None, "n/a", "1"])
    return (f"{hour:%Y-%m-%dT%H}", region or draw.choice(["R0", "R1"]), "n", draw.choice(KINDS), "t", value, "u", "api", f"{seen:06}.parquet", f"{hour + timedelta(hours=1):%Y-%m-%dT%H:%M:%S}")


def days(seed, count):
    """A list of rows a day, with gaps, revisions of the days before, and odd rows."""
    draw, seen = random.Random(seed), iter(range(10**6))
    out = []
    for d in range(count):
        now = [row(draw, START + timedelta(days=d, hours=h), next(seen)) for h in range(24) for _ in range(draw.randrange(14))]
        now += [row(draw, START + timedelta(days=d, hours=-draw.randrange(30)), next(seen)) for _ in range(12)]
        now += [("no time", "R0", "n", "D", "t", "1", "u", "api", "x", "2024"), (f"{START + timedelta(days=d):%Y-%m-%dT%H}", None, "n", "D", "t", "1", "u", "api", "x", "2024"), (f"{START + timedelta(days=d):%Y-%m-%dT%H}", "R0", "n", "XX", "t", "1", "u", "api", "x", "2024")]
        out.append(now)
    return out


def far(days_on):
    """A row that only moves the watermark: of a type that is none."""
    return [(f"{START + timedelta(days=days_on):%Y-%m-%dT%H}", "R0", "n", "clock", "t", None, "u", "api", "x", "2024")]


def run(spark, place):
    return silver.follow(spark, f"{place}/landed", landing.FEED_SCHEMA, f"{place}/hours", f"{place}/checkpoint")


@pytest.mark.parametrize("seed", [1])
def test_after_the_last_file_the_stream_equals_the_batch(spark, tmp_path, seed):
    place, rows, seen = str(tmp_path), [], 0
    batches = days(seed, 9)
    for number, fresh in enumerate([*batches, far(60), far(61)]):
        frame(spark, fresh).coalesce(1).write.mode("append").parquet(f"{place}/landed")
        if number < len(batches):
            rows += fresh
        hours = run(spark, place)  # a restart on the same checkpoint for each file
        found = hours.count()
        assert found == hours.select("region_id", "event_timestamp_utc").distinct().count() and found >= seen
        seen = found
        if number == len(batches) - 1:
            assert seen > 0  # hours are written before the end
    want = build_silver(frame(spark, rows))[0].select(*SILVER)
    got = silver.finished(hours).select(*SILVER)
    assert want.filter("is_demand_anomaly_suspect").count() > 0 and want.filter("is_missing_hour").count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_table_gives_the_same(spark):
    rows = [r for d in days(3, 6) for r in d]
    want = build_silver(frame(spark, rows))[0].select(*SILVER)
    got = silver.finished(silver.silver_stream(frame(spark, rows))).select(*SILVER)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
