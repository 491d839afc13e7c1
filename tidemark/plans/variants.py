"""Pre-registered variants of the boosted trees, and what a provably available lead costs.

Each variant is declared before it is scored: a training window (expanding or sliding) and a target
(plain or as a ratio). The lead-one specs are scored only to price the safety margin; the audit must
reject them and accept the served ones before any number is made.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FeedConfig
from tidemark.operators.audit import violations
from tidemark.operators.backtest import monthly_folds, run_backtest, scoreable
from tidemark.operators.evaluate import overall
from tidemark.operators.features import FeatureSpec
from tidemark.operators.models import GbtModel, GbtRatioModel, Model, published_benchmark

WINDOW_MONTHS = 24


def run_variants(features: DataFrame, inputs: list[str], baseline: str, window_months: int = WINDOW_MONTHS, min_train_months: int = 12, **settings) -> DataFrame:
    """Scoreable predictions of the benchmark and of four variants: plain and ratio, expanding and sliding."""
    plain = lambda name: GbtModel(name, inputs, **settings)
    ratio = lambda name: GbtRatioModel(name, inputs, baseline, **settings)
    dates = features.select("forecast_date")
    sliding = f"slide{window_months}"
    runs: list[tuple[int | None, list[Model]]] = [(None, [published_benchmark(), plain("xgb_b"), ratio("xgb_b_ratio")]), (window_months, [plain(f"xgb_b_{sliding}"), ratio(f"xgb_b_ratio_{sliding}")])]
    made = [run_backtest(features, models, monthly_folds(dates, min_train_months, window)) for window, models in runs]
    return scoreable(reduce(DataFrame.unionByName, made))


def lead_sensitivity(features: DataFrame, served: list[FeatureSpec], rejected: list[FeatureSpec], config: FeedConfig = DEFAULT, make: Callable[[str, list[str]], Model] = GbtModel, min_train_months: int = 12) -> DataFrame:
    """(model, MAE_mwh, gap_pct, price_pct): the served and the rejected specs against the benchmark on the same rows.

    ``gap_pct`` is the distance to the benchmark's error, ``price_pct`` how much worse the served specs
    are than the rejected ones. Raises if the audit does not tell the two apart.
    """
    if not violations(features, served, config).isEmpty():
        raise ValueError("the served specs use what is not known at the cutoff")
    if violations(features, rejected, config).isEmpty():
        raise ValueError("the audit passes the specs that it should reject")
    models = [published_benchmark(), make("served", [s.name for s in served]), make("rejected", [s.name for s in rejected])]
    scores = overall(scoreable(run_backtest(features, models, monthly_folds(features.select("forecast_date"), min_train_months))))
    of = lambda name: F.max(F.when(F.col("model") == name, F.col("MAE_mwh")))
    pinned = scores.agg(of(models[0].name).alias("benchmark"), of("served").alias("served_mae"), of("rejected").alias("rejected_mae"))
    # One row beside three: the cross product is three rows, whatever the input.
    joined = scores.join(pinned, F.lit(True))
    percent = lambda a, b: F.try_divide(100 * (F.col(a) - F.col(b)), F.col(b))
    return joined.select("model", "n", "MAE_mwh", percent("MAE_mwh", "benchmark").alias("gap_pct"), percent("served_mae", "rejected_mae").alias("price_pct"))
