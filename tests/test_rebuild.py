"""Silver days rebuilt by batch equal a full rebuild; files of other days stay."""

import os
import random
from datetime import datetime, timedelta

import pytest

from tidemark.plans.silver import SILVER, build_silver
from tidemark.sources import landing
from tidemark.streaming import rebuild

START = datetime(2024, 3, 1)
KINDS = ("D", "DF", "NG")


def vintage(draw, region, hour, seen):
    value = draw.choice([str(draw.randrange(20_000, 60_000)), str(draw.randrange(20_000, 60_000)), None, "n/a", "1"])
    return (f"{hour:%Y-%m-%dT%H}", region, "n", draw.choice(KINDS), "t", value, "u", "api", f"{seen}.parquet", f"2024-05-01T{seen % 24:02}:{seen // 24 % 60:02}:00")


def batches(seed):
    """Batches of rows: a first one over 20 days, then revisions, late hours, hours before and after, a new region, rows that say nothing."""
    draw, seen = random.Random(seed), iter(range(10**6))
    at = lambda low, high: START + timedelta(hours=draw.randrange(24 * low, 24 * high))
    many = lambda n, regions, low, high: [vintage(draw, draw.choice(regions), at(low, high), next(seen)) for _ in range(n)]
    first = many(1500, ["R0", "R1"], 3, 20)
    return [first, many(6, ["R0"], 8, 9), many(10, ["R1"], 20, 24), many(5, ["R0"], 0, 2), many(30, ["R2"], 5, 15), [("no time", "R0", "n", "D", "t", "1", "u", "api", "x", "2024-05-01"), (f"{START:%Y-%m-%dT%H}", None, "n", "D", "t", "1", "u", "api", "x", "2024-05-01")], []]


def frame(spark, rows):
    return spark.createDataFrame(rows, landing.FEED_SCHEMA)


def same(spark, target, rows):
    want = build_silver(frame(spark, rows))[0].select(*SILVER)
    got = spark.read.schema(want.schema).parquet(target).select(*SILVER)
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def files(target):
    return {os.path.join(folder, n) for folder, _, names in os.walk(target) for n in names if n.endswith(".parquet")}


@pytest.mark.parametrize("seed", [1])
def test_every_batch_leaves_what_a_full_rebuild_gives(spark, tmp_path, seed):
    target, rows = str(tmp_path / "silver"), []
    for fresh in batches(seed):
        rows += fresh
        rebuild.rebuild_days(spark, frame(spark, rows), frame(spark, fresh), target)
        assert same(spark, target, rows)


def test_other_days_keep_their_files(spark, tmp_path):
    target = str(tmp_path / "silver")
    first, fresh = batches(3)[:2]
    rebuild.rebuild_days(spark, frame(spark, first), frame(spark, first), target)
    before = files(target)
    assert rebuild.rebuild_days(spark, frame(spark, first + fresh), frame(spark, fresh), target) == 3
    gone = before - files(target)
    assert {f.split(f"{target}/")[1].rsplit("/", 1)[0] for f in gone} == {f"region_id=R0/day=2024-03-{d:02}" for d in (8, 9, 10)}
    assert same(spark, target, first + fresh)


def test_an_end_that_moves_inwards_takes_days_away(spark, tmp_path):
    target = str(tmp_path / "silver")
    draw = random.Random(1)
    first = [vintage(draw, r, START + timedelta(hours=h), h) for r in ("R0", "R1") for h in range(72)]
    last = (f"{START + timedelta(days=5):%Y-%m-%dT%H}", "R0", "n", "D", "t", "30000", "u", "api", "a", "2024-05-02T00:00:00")
    back = (*last[:5], "n/a", *last[6:9], "2024-05-03T00:00:00")
    rows = []
    for fresh in (first, [last], [back]):
        rows += fresh
        rebuild.rebuild_days(spark, frame(spark, rows), frame(spark, fresh), target)
        assert same(spark, target, rows)
    assert not any("day=2024-03-06" in f for f in files(target))


def test_a_stream_over_bronze(spark, tmp_path):
    bronze, target, checkpoint = (str(tmp_path / n) for n in ("bronze", "silver", "checkpoint"))
    rows = []
    for fresh in batches(4)[:4]:
        rows += fresh
        frame(spark, fresh).coalesce(1).write.mode("append").parquet(bronze)
        rebuild.stream_silver(spark, bronze, landing.FEED_SCHEMA, target, checkpoint)
        assert same(spark, target, rows)
    before = files(target)
    rebuild.stream_silver(spark, bronze, landing.FEED_SCHEMA, target, checkpoint)
    assert files(target) == before


def test_nothing_that_can_be_placed_touches_nothing(spark, tmp_path):
    odd = batches(1)[5]
    assert rebuild.rebuild_days(spark, frame(spark, odd), frame(spark, odd), str(tmp_path / "s")) == 0
    assert not os.path.exists(tmp_path / "s")
