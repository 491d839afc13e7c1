"""As-of joins against a plain loop, features as they were known, and the audit of what was really read."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import contract_frame
from tidemark.operators import asof, audit, features
from tidemark.plans.silver import build_silver

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("seconds", [3600, 7 * 86_400])
def test_as_of_equals_a_plain_loop(spark, seconds):
    draw = random.Random(4)
    moment = lambda: START + timedelta(minutes=15 * draw.randrange(4 * 24 * 20))
    key = lambda: (draw.choice(["hot"] * 8 + ["a", None]), draw.choice([1, 2, None]))
    vintages = [(*key(), draw.choice([None, *[moment() for _ in range(20)]]), draw.choice(["x", "y", "z"]), draw.choice([None, 1.0, 2.0])) for _ in range(500)]
    requests = [(k, *key(), draw.choice([None, *[moment() for _ in range(20)]])) for k in range(400)] + [(900, "none", 1, START)]
    got = asof.as_of(spark.createDataFrame(requests, "id int, k string, n int, at timestamp"), spark.createDataFrame(vintages, "k string, n int, known timestamp, s string, v double"), ["k", "n"], "at", "known", ["s", "v"], seconds).collect()
    assert len(got) == len(requests)
    rank = lambda x: (x is not None, x if x is not None else 0)
    for r in got:
        mine = [(t, s, v) for k, n, t, s, v in vintages if (k, n) == (r.k, r.n) and t is not None and r.at is not None and t <= r.at]
        want = max(mine, key=lambda x: (x[0], x[1], rank(x[2])), default=(None, None, None))
        assert (r.known, r.s, r.v) == want


def landed(spark, rows):
    return spark.createDataFrame([(f"{at:%Y-%m-%dT%H}", "R0", "D", value, f"{k}.parquet", f"{seen:%Y-%m-%dT%H:%M:%S}") for k, (at, value, seen) in enumerate(rows)], "period string, respondent string, type string, value string, source_file string, ingested_at string")


def history():
    return [(START + timedelta(hours=h), str(20_000 + 7 * h % 97), START + timedelta(hours=h + 2)) for h in range(24 * 24)]


def known(spark, rows):
    frame = contract_frame(spark, "2024-01-18", "2024-01-20")
    return {(r.forecast_date, r.target_timestamp_utc): r.asDict() for r in asof.features_as_known(landed(spark, rows), frame, features.MODEL_A).collect()}


def test_a_revision_after_the_cutoff_changes_no_feature(spark):
    before = known(spark, history())
    cutoff = max(r["cutoff_utc"] for r in before.values())
    later = [(at, "99999", cutoff + timedelta(seconds=1)) for at, _, _ in history()]
    assert known(spark, history() + later) == before


def test_a_revision_before_the_cutoff_counts_and_an_invalid_one_hides_the_value(spark):
    one = next(iter(known(spark, history()).values()))
    hour = one["cutoff_utc"] - timedelta(hours=3)
    moved = [(hour, "31000", one["cutoff_utc"]), (hour - timedelta(hours=1), "n/a", one["cutoff_utc"])]
    got = known(spark, history() + moved)[one["forecast_date"], one["target_timestamp_utc"]]
    assert got["demand_cutoff_minus_3h"] == 31000 and got["demand_cutoff_minus_4h"] is None
    assert got["newest_known_at"] == one["cutoff_utc"]


def test_features_as_known_equal_a_plain_loop(spark):
    draw = random.Random(8)
    rows = history() + [(START + timedelta(hours=draw.randrange(24 * 24)), draw.choice([None, "25000", "26000", "1", "n/a"]), START + timedelta(hours=draw.randrange(24 * 24), minutes=30)) for _ in range(600)]

    def value(hour, cutoff):
        mine = [(seen, f"{k}.parquet", v) for k, (at, v, seen) in enumerate(rows) if at == hour and seen <= cutoff]
        v = max(mine)[2] if mine else None
        number = None if v in (None, "n/a") else float(v)
        return number if number is not None and 10_000 <= number <= 300_000 else None

    for r in list(known(spark, rows).values())[::5]:
        at = lambda anchor, hours: value(r[anchor] - timedelta(hours=hours), r["cutoff_utc"])  # noqa: B023, E731
        assert r["demand_cutoff_minus_27h"] == at("cutoff_utc", 27) and r["demand_same_hour_minus_2d"] == at("target_timestamp_utc", 48)
        day = [v for v in (at("cutoff_utc", 3 + k) for k in range(24)) if v is not None]
        assert r["demand_rolling_mean_24h_to_cutoff"] == pytest.approx(sum(day) / len(day))
        week = [v for v in (at("target_timestamp_utc", 24 * d) for d in range(2, 8)) if v is not None]
        assert r["demand_same_hour_prev_week_mean"] == pytest.approx(sum(week) / len(week))


@pytest.fixture(scope="module")
def rows(spark):
    silver, _ = build_silver(landed(spark, history()))
    leaky = [s for s in features.KNOWN_LEAKY if s.metric == "D"]
    return features.build_features(silver, contract_frame(spark, "2024-01-18", "2024-01-20"), None, [*features.MODEL_A, *leaky], sources=True).cache()


def test_honest_features_pass_and_say_what_they_read(rows):
    done = audit.joined_gate(rows, features.DEMAND)
    assert done["checks"] > 0 and done["violations"] == 0
    r = rows.filter("demand_same_hour_minus_2d is not null").first()
    assert r["read__demand_same_hour_minus_2d"] == r.target_timestamp_utc - timedelta(hours=48)
    assert r["read__demand_rolling_mean_24h_to_cutoff"] == r.cutoff_utc - timedelta(hours=3)
    found = {x.feature: x for x in audit.joined_report(rows, features.DEMAND).collect()}
    assert all(x.violations == 0 and x.later_than_declared == 0 for x in found.values())


def test_leaks_are_caught_by_what_they_read(rows):
    leaky = [s for s in features.KNOWN_LEAKY if s.metric == "D"]
    found = {x.feature: x for x in audit.joined_report(rows, leaky).collect()}
    assert found["demand_cutoff_minus_1h"].violations == found["demand_cutoff_minus_1h"]["values"] > 0
    assert found["demand_cutoff_minus_1h"].max_hours_late == 2
    with pytest.raises(ValueError, match="not known at the cutoff"):
        audit.joined_gate(rows, leaky)


def test_a_spec_that_lies_about_its_offset_is_caught(rows):
    """Declared as five hours before the cutoff, read one hour before it: the audit of declared offsets passes, that of what was joined does not."""
    lying = rows.drop("demand_cutoff_minus_5h", "read__demand_cutoff_minus_5h").withColumnsRenamed({"demand_cutoff_minus_1h": "demand_cutoff_minus_5h", "read__demand_cutoff_minus_1h": "read__demand_cutoff_minus_5h"})
    assert audit.violations(lying, features.DEMAND).isEmpty()
    with pytest.raises(ValueError, match="later hours than declared"):
        audit.joined_gate(lying, features.DEMAND)


def test_an_early_lie_that_leaks_nothing_is_caught_too(rows):
    lying = rows.drop("demand_cutoff_minus_6h", "read__demand_cutoff_minus_6h").withColumns({"demand_cutoff_minus_6h": F.col("demand_cutoff_minus_4h"), "read__demand_cutoff_minus_6h": F.col("read__demand_cutoff_minus_4h")})
    report = {x.feature: x for x in audit.joined_report(lying, features.DEMAND).collect()}["demand_cutoff_minus_6h"]
    assert report.violations == 0 and report.later_than_declared == report["values"]


def test_nothing_to_check_is_no_pass(rows):
    with pytest.raises(ValueError, match="saw no value"):
        audit.joined_gate(rows.limit(0), features.DEMAND)
    with pytest.raises(ValueError, match="carries what was read"):
        audit.joined_gate(rows.select("cutoff_utc"), features.DEMAND)
