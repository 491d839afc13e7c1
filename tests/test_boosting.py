"""Boosted trees grown for many fits at once against a plain booster; quantile summaries against exact ranks."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import boosting as b
from tidemark.operators import quantiles as q

FEATURES = ("x", "y", "z", "flag")


def rows(n, seed):
    draw = np.random.default_rng(seed)
    x, y = draw.normal(size=n), draw.integers(0, 30, n).astype(float)
    z, flag = draw.normal(size=n), draw.integers(0, 2, n).astype(float)
    x[draw.random(n) < 0.2] = np.nan
    z[draw.random(n) < 0.5] = np.nan
    label = 50 + 3 * np.where(np.isnan(x), 4.0, x) + y + 10 * flag * np.isnan(z) + draw.normal(scale=0.1, size=n)
    label[draw.random(n) < 0.05] = np.nan
    days = [date(2024, 1, 1) + timedelta(days=int(d)) for d in draw.integers(0, 60, n)]
    return [(k, days[k], *[None if math.isnan(v) else float(v) for v in (x[k], y[k], z[k], flag[k], label[k])]) for k in range(n)]


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, "target_timestamp_utc long, forecast_date date, x double, y double, z double, flag double, label double").repartition(parts)


def plain_booster(x, labels, keys, settings):
    """One fit on one machine: every node counted from its own rows, no siblings, no blocks. ``x`` is (feature, row)."""
    base = sum(int(v) for v in np.rint(labels * b.LABEL_UNIT)) / len(labels) / b.LABEL_UNIT
    edges = [q.cuts(q.summary(v), settings.bins) for v in x]
    codes = np.array([np.where(np.isnan(v), settings.bins, np.searchsorted(e, v, side="left")) for v, e in zip(x, edges)])
    step, prediction, trees = b.unit(float(np.abs(labels).max())), np.full(len(labels), base), []
    for number in range(settings.rounds):
        seen = b.drawn_rows(keys, number, settings)
        chosen = b.drawn_features(len(x), number, settings)
        gradient = np.rint((labels - prediction) * step).astype(np.int64)
        tree, node = {}, np.zeros(len(labels), int)

        def worth(mine):
            return settings.rate * (int(gradient[mine].sum()) / step) / (int(mine.sum()) + settings.penalty)

        tree[0] = [-1, None, None, worth(seen), 0.0]
        for level in range(settings.depth):
            for at in range(2**level - 1, 2 ** (level + 1) - 1):
                if at not in tree:
                    continue
                mine = seen & (node == at)
                g, n = int(gradient[mine].sum()), int(mine.sum())
                best = (0.0, None)
                for f in chosen:
                    for cut in range(settings.bins):
                        for left_too in (True, False):
                            left = mine & np.where(codes[f] == settings.bins, left_too, codes[f] <= cut)
                            gl, nl = int(gradient[left].sum()), int(left.sum())
                            if nl < settings.min_child or n - nl < settings.min_child:
                                continue
                            score = lambda a, c: float(a) * float(a) / (c + settings.penalty)
                            gain = score(gl, nl) + score(g - gl, n - nl) - score(g, n)
                            if gain > best[0]:
                                best = (gain, (f, cut, left_too))
                if best[1] is None:
                    continue
                f, cut, left_too = best[1]
                goes = np.where(codes[f] == settings.bins, left_too, codes[f] <= cut)
                tree[at][:3] = [int(f), cut, left_too]
                tree[at][4] = best[0] / step**2
                for child, side in ((2 * at + 1, goes), (2 * at + 2, ~goes)):
                    tree[child] = [-1, None, None, worth(mine & side), 0.0]
                node = np.where(node == at, np.where(goes, 2 * at + 1, 2 * at + 2), node)
        prediction = prediction + np.array([tree[k][3] for k in node])
        trees.append(tree)
    return prediction, trees


@pytest.mark.parametrize("settings", [b.Settings(rounds=7, depth=3, bins=8, min_child=3, write_every=3), b.Settings(rounds=3, depth=4, bins=16, min_child=20, subsample=1.0, colsample=0.5, write_every=1)], ids=["three levels", "four levels"])
def test_all_fits_at_once_equal_a_plain_booster(spark, settings):
    data = rows(700, 3)
    df = frame(spark, data).withColumn("other", F.when(F.col("y") > 3, F.col("label") / F.col("y")))
    cut = date(2024, 2, 10)
    fits = [b.Fit(FEATURES, "label"), b.Fit(FEATURES, "label", date(2024, 1, 10), cut), b.Fit(("y", "x"), "other", None, cut), b.Fit(FEATURES, "label", date(2030, 1, 1))]
    found = b.fit_boosters(df, fits, settings)
    assert found[3] is None
    keyed = df.withColumn("key", F.xxhash64("target_timestamp_utc", "forecast_date")).toPandas()
    for fit, booster in zip(fits[:3], found):
        mine = keyed[keyed[fit.label].notna()]
        if fit.first:
            mine = mine[mine["forecast_date"] >= fit.first]
        if fit.last:
            mine = mine[mine["forecast_date"] <= fit.last]
        x = mine[list(fit.features)].to_numpy(float).T
        want, trees = plain_booster(x, mine[fit.label].to_numpy(float), mine["key"].to_numpy(), settings)
        for number, tree in enumerate(trees):
            for at, (feature, _, left_too, value, gain) in tree.items():
                assert booster.trees.feature[number, at] == feature and booster.trees.value[number, at] == value
                if feature >= 0:
                    assert booster.trees.missing_left[number, at] == left_too and booster.trees.gain[number, at] == gain
        assert booster.predict(list(x)).tolist() == want.tolist()


def test_the_same_trees_however_rows_are_dealt(spark):
    settings = b.Settings(rounds=3, depth=3, bins=16)
    data = rows(900, 5)
    one = b.fit_boosters(frame(spark, data, 1), [b.Fit(FEATURES, "label")], settings)[0]
    many = b.fit_boosters(frame(spark, data[::-1], 7), [b.Fit(FEATURES[:2], "label"), b.Fit(FEATURES, "label")], settings)[1]
    for name in ("feature", "cut", "missing_left", "value", "gain"):
        assert getattr(one.trees, name).tolist() == getattr(many.trees, name).tolist()


def test_missing_values_that_say_something_are_learned(spark):
    draw = np.random.default_rng(1)
    known = draw.random(600) < 0.5
    data = [(k, date(2024, 1, 1), float(draw.normal()) if known[k] else None, 0.0, None, 0.0, 100.0 if known[k] else 10.0) for k in range(600)]
    booster = b.fit_boosters(frame(spark, data), [b.Fit(("x", "y"), "label")], b.Settings(rounds=40, depth=2, colsample=1.0, subsample=1.0, rate=0.3))[0]
    low, high = booster.predict([np.array([np.nan, 0.3]), np.zeros(2)])
    assert low == pytest.approx(10, abs=0.5) and high == pytest.approx(100, abs=0.5)
    assert booster.gains()["x"] > 0 and booster.gains()["y"] == 0


def test_a_feature_that_is_not_drawn_is_not_used(spark):
    settings = b.Settings(rounds=6, depth=2, colsample=0.25, bins=8)
    booster = b.fit_boosters(frame(spark, rows(400, 9)), [b.Fit(FEATURES, "label")], settings)[0]
    for number in range(settings.rounds):
        used = set(booster.trees.feature[number].tolist()) - {-1}
        assert used <= set(b.drawn_features(4, number, settings).tolist())


def test_boosters_are_saved_whole(spark, tmp_path):
    booster = b.fit_boosters(frame(spark, rows(300, 2)), [b.Fit(FEATURES, "label")], b.Settings(rounds=2, depth=2))[0]
    booster.save(spark, str(tmp_path / "m"))
    back = b.Booster.load(spark, str(tmp_path / "m"))
    x = [np.array([0.1, np.nan]), np.array([3.0, 4.0]), np.array([np.nan, 1.0]), np.array([1.0, 0.0])]
    assert back.features == FEATURES and back.predict(x).tolist() == booster.predict(x).tolist() and back.gains() == booster.gains()


def test_nothing_is_left_in_the_shared_folder(spark):
    from tidemark.sources.tables import scratch

    b.fit_boosters(frame(spark, rows(200, 2)), [b.Fit(FEATURES, "label")], b.Settings(rounds=2, depth=1, write_every=1))
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/boosting-*")
    assert len(place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)) == 0


def rank_error(values, weights, held):
    """Largest gap between a summary's weight up to any value and the true one."""
    order = np.argsort(values)
    v, w = values[order], np.cumsum(weights[order])
    points, upto = held[0], np.cumsum(held[1])
    worst = 0.0
    for x in np.unique(values):
        true = w[np.searchsorted(v, x, side="right") - 1]
        place = np.searchsorted(points, x, side="right") - 1
        worst = max(worst, abs(true - (upto[place] if place >= 0 else 0.0)))
    return worst


@pytest.mark.parametrize("kind", ["normal", "few", "heavy", "sorted"])
def test_summaries_keep_ranks(kind):
    draw = np.random.default_rng(7)
    values = {"normal": draw.normal(size=20_000), "few": draw.integers(0, 7, 20_000).astype(float), "heavy": draw.pareto(1, 20_000), "sorted": np.arange(20_000.0)}[kind]
    weights = draw.integers(1, 5, 20_000).astype(float)
    if kind == "heavy":
        weights[:5] = 5000.0
    parts = [q.compressed(q.summary(v, w), 200) for v, w in zip(np.array_split(values, 13), np.array_split(weights, 13))]
    assert all(len(p[0]) <= 2 * 200 + 2 for p in parts)
    whole = q.merged(parts)
    assert whole[1].sum() == pytest.approx(weights.sum())
    assert rank_error(values, weights, whole) <= weights.sum() / 200
    again = q.compressed(q.merged([q.merged(parts[:6]), q.merged(parts[6:])]), 400)
    assert rank_error(values, weights, again) <= weights.sum() * (1 / 200 + 1 / 400)


def test_cuts_split_evenly_and_never_at_the_end():
    held = q.summary(np.arange(1000.0))
    sizes = np.diff(np.concatenate(([0], np.searchsorted(np.arange(1000.0), q.cuts(held, 8), side="right"), [1000])))
    assert sizes.tolist() == [125] * 8
    assert q.cuts(q.summary(np.array([np.nan, 5.0, 5.0])), 8).tolist() == [] and q.cuts(q.summary(np.array([1.0, 2.0, 2.0, 2.0])), 8).tolist() == [1.0]
    assert q.merged([])[0].tolist() == []


def test_a_level_has_no_more_tasks_than_fits(spark, monkeypatch):
    """Levels are many and small: a task for each of the session's shuffle partitions made most of the time."""
    kind, dealt = type(spark.range(1)), []
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda df, *a: dealt.append(df.rdd.getNumPartitions()) or persist(df, *a))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        b.fit_boosters(frame(spark, rows(120, 9)), [b.Fit(FEATURES, "label"), b.Fit(FEATURES[:2], "label")], b.Settings(rounds=1, depth=2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt == [2, 2]


def test_ways_of_a_tree_are_its_routes():
    """Rows in bins, sent by tables, end where the tree sends them, step by step."""
    draw = np.random.default_rng(8)
    tree = b.Trees.of(1, 3)
    tree.feature[0, :5], tree.cut[0, :5], tree.missing_left[0, :5] = [0, 2, -1, 1, 2], draw.integers(0, 9, 5), draw.integers(0, 2, 5)
    coded = draw.integers(0, 10, (3, 500)).astype(np.uint8)
    assert b._followed(b._ways(tree, 0, 9), coded, 3, 9).tolist() == b._routed(tree, 0, coded, coded == 9).tolist()
