"""Monthly refit with a gate, and the forecast of the newest month."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.evaluate import gate_score
from tidemark.operators.features import LABEL
from tidemark.operators.models import GbtModel, Model, published_benchmark, seasonal_naive
from tidemark.operators.registry import TRAINED_THROUGH, ComparisonBasis, PromotionVerdict, Registry, decide_promotion, describe_comparison


@dataclass(frozen=True)
class RefitResult:
    version: int
    verdict: PromotionVerdict
    basis: ComparisonBasis
    candidate: dict[str, float]
    incumbent: dict[str, float] | None


def split_holdout(features: DataFrame, months: int = 1, embargo_days: int = 0) -> tuple[DataFrame, DataFrame, str]:
    """(rows before the last ``months`` months, labelled rows of them, the last training date). The cut is a month's first day."""
    day = F.to_date("forecast_date")
    last = features.filter(F.col(LABEL).isNotNull()).agg(F.max(day).alias("last")).first()["last"]
    if last is None:
        raise ValueError("no labelled row to split")
    cut = F.add_months(F.trunc(F.lit(last), "MM"), 1 - months)
    train = features.filter(day < F.date_sub(cut, embargo_days))
    through = train.agg(F.max(day).alias("d")).first()["d"]
    return train, features.filter((day >= cut) & F.col(LABEL).isNotNull()), str(through)


def refit(features: DataFrame, registry: Registry, name: str, make: Callable[[str], GbtModel], months: int = 1, tolerance_pct: float = 2.0, embargo_days: int = 0) -> RefitResult:
    """Score a candidate and, refitted on its own window, the incumbent on one holdout; register a model of all labels; move the alias if the rule says so."""
    train, holdout, through = split_holdout(features, months, embargo_days)
    candidate = gate_score(make("gate"), train, holdout)
    incumbent_through = registry.champion_training_cutoff(name)
    incumbent = None
    if incumbent_through is not None:
        day = F.to_date("forecast_date")
        if not holdout.filter(day <= F.lit(incumbent_through).cast("date")).isEmpty():
            raise RuntimeError(f"the incumbent was trained through {incumbent_through}, inside the holdout")
        incumbent = gate_score(make("incumbent"), features.filter(day <= F.lit(incumbent_through).cast("date")), holdout)
    served = make(name).fit(features)
    label_end = features.filter(F.col(LABEL).isNotNull()).agg(F.max("target_timestamp_utc").alias("t")).first()["t"]
    version = registry.register(name, served, f"refit through {through}", {TRAINED_THROUGH: through, "training_data_end": str(label_end)}, candidate)
    verdict = decide_promotion(candidate["gate_holdout_mae"], incumbent and incumbent["gate_holdout_mae"], tolerance_pct)
    if verdict.promote:
        registry.set_alias(name, version)
    return RefitResult(version, verdict, describe_comparison(through, incumbent_through), candidate, incumbent)


def forecast_month(features: DataFrame, registry: Registry | None = None, name: str | None = None, baselines: tuple[Model, ...] | None = None) -> DataFrame:
    """Predictions of the newest month by the champion and the baselines, with the columns that forecast tables need. A named model without champion, or a champion that does not say what it was trained on, raises."""
    if name is not None and registry is None:
        raise ValueError(f"{name}: no registry to take its champion from")
    day = F.to_date("forecast_date")
    newest = features.agg(F.trunc(F.max(day), "MM").alias("_first"))
    rows = features.join(newest, day >= F.col("_first")).drop("_first")
    blank = {"train_end": F.lit(None).cast("date"), "train_rows": F.lit(None).cast("long"), "fold": F.lit(None).cast("int"), "model_version": F.lit("baseline")}
    parts = [m.transform(rows).withColumns({"model": F.lit(m.name), **blank}) for m in (baselines or (seasonal_naive(), published_benchmark()))]
    if name is not None:
        held = registry.aliased(name)
        if held is None:
            raise LookupError(f"{name} has no champion")
        if "training_data_end" not in held["params"]:
            raise RuntimeError(f"{name} version {held['version']} does not record training_data_end")
        own = {"model": F.lit(name), "train_end": F.to_date(F.lit(held["params"]["training_data_end"])), "train_rows": F.lit(None).cast("long"), "fold": F.lit(None).cast("int"), "model_version": F.lit(str(held["version"]))}
        parts.append(registry.load(name).transform(rows).withColumns(own))
    return reduce(DataFrame.unionByName, parts)
