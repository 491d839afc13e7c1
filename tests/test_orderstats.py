"""Exact quantiles of groups and windows against sorted lists, and the plan of folds."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, orderstats
from tidemark.operators.features import LABEL

QUANTILES = {"p00": 0.0, "p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def continuous(values, q):
    v, at = sorted(values), q * (len(values) - 1)
    low, high = v[math.floor(at)], v[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def discrete(values, q):
    v = sorted(values)
    return v[max(1, len(v) - math.floor(len(v) - q * len(v))) - 1]


def kinds():
    draw = np.random.default_rng(2)
    return {
        "normal": draw.normal(size=700).tolist(),
        "heavy tail": (draw.pareto(0.3, 500) * draw.choice([-1, 1], 500)).tolist(),
        "one value": [3.5] * 90,
        "two values": [1.0] * 70 + [2.0] * 3,
        "huge": [-1.7e308, 1.7e308, 0.0, 1e-300, 5e-324, -5e-324] * 9,
        "single": [7.0],
        "neighbours": [1.0 + k * 2**-52 for k in range(60)],
        "not a number": [float("nan"), 1.0, 2.0, None, 4.0],
    }


@pytest.mark.parametrize("small", [1, 10_000])
def test_groups(spark, small):
    rows = [(k, v) for k, values in kinds().items() for v in values] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    for exact, is_continuous in ((continuous, True), (discrete, False)):
        got = {r.k: r for r in orderstats.group_quantiles(df, ["k"], "x", QUANTILES, is_continuous, small).collect()}
        assert set(got) == set(kinds())
        for k, values in kinds().items():
            known = [v for v in values if v is not None and not math.isnan(v)]
            assert got[k].n == len(known)
            for name, q in QUANTILES.items():
                want = exact(known, q)
                assert got[k][name] == want or (math.isinf(want) or math.isnan(want)) or got[k][name] == pytest.approx(want, rel=1e-12), (k, name)


def test_no_rows(spark):
    assert orderstats.group_quantiles(spark.createDataFrame([], "k string, x double"), ["k"], "x", QUANTILES).collect() == []


@pytest.mark.parametrize("small", [3, 10_000])
def test_overlapping_windows_without_copies(spark, small):
    draw = np.random.default_rng(6)
    first = date(2024, 1, 1)
    rows = [(draw.choice(["a", "b"]).item(), first + timedelta(days=int(d)), float(x)) for d, x in zip(draw.integers(0, 90, 900), draw.normal(size=900).round(2))]
    spans = [(0, 20), (0, 40), (10, 40), (0, 89), (35, 35), (-5, 200), (300, 400)]
    df = spark.createDataFrame(rows, "k string, day date, v double")
    windows = spark.createDataFrame([(w, first + timedelta(days=a), first + timedelta(days=b)) for w, (a, b) in enumerate(spans)], "window int, a date, b date")
    days, ranged = orderstats.segments_of(windows, "a", "b")
    regions = ranged.join(df.select("k").distinct(), F.lit(True))
    got = {(r.k, r.window): r for r in orderstats.order_statistics(df.join(days, "day"), regions, QUANTILES, ["k"], small=small).collect()}
    for k in "ab":
        for w, (a, b) in enumerate(spans):
            values = [v for name, d, v in rows if name == k and first + timedelta(days=a) <= d <= first + timedelta(days=b)]
            if not values:
                assert (k, w) not in got
                continue
            assert got[k, w].n == len(values)
            for name, q in QUANTILES.items():
                assert got[k, w][name] == pytest.approx(continuous(values, q), abs=1e-12)


@pytest.mark.parametrize(("window_months", "embargo"), [(None, 0), (4, 1)])
def test_fold_thresholds_are_those_of_the_training_labels(spark, window_months, embargo):
    draw = np.random.default_rng(3)
    rows = [(date(2022, 1, 5) + timedelta(days=d), None if draw.random() < 0.1 else float(draw.integers(0, 10_000))) for d in range(700) for _ in range(draw.integers(1, 12))]
    data = spark.createDataFrame(rows, f"forecast_date date, {LABEL} double")
    folds = backtest.monthly_folds(data, 6, window_months, embargo)
    got = {r.fold: r for r in backtest.training_stats(data, folds).collect()}
    for f in folds.collect():
        values = [v for d, v in rows if v is not None and f.train_start <= d <= f.train_end]
        assert got[f.fold].train_rows == len(values) and got[f.fold].extreme_threshold_mwh == pytest.approx(continuous(values, 0.95))


def test_no_range_join_and_no_percentile_in_the_plan(spark, capsys):
    rows = [(date(2022, 1, 1) + timedelta(days=d), float(d)) for d in range(500)]
    data = spark.createDataFrame(rows, f"forecast_date date, {LABEL} double")
    backtest.training_stats(data, backtest.monthly_folds(data)).explain()
    plan = capsys.readouterr().out
    assert "percentile" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
