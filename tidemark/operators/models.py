"""Forecast models with one interface: ``fit(train)`` and ``transform(rows)`` adding ``prediction_mwh``."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.boosting import Booster, Fit, Settings, fit_boosters, predicted
from tidemark.operators.features import BENCHMARK, LABEL

SEED = 41


class Model:
    name: str
    needs_fit = True

    def fit(self, train: DataFrame) -> Model:
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        raise NotImplementedError


class ColumnModel(Model):
    """The prediction is a column; nothing is fitted."""

    needs_fit = False

    def __init__(self, name: str, column: str) -> None:
        self.name, self.column = name, column

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction_mwh", F.col(self.column).cast("double"))


def seasonal_naive() -> ColumnModel:
    return ColumnModel("seasonal_naive", "demand_same_hour_minus_7d")


def published_benchmark() -> ColumnModel:
    return ColumnModel("eia_df", BENCHMARK)


class GbtModel(Model):
    """Boosted trees over a declared list of features (``boosting``).

    Missing values are routed by each split as training says. A feature that is not in the input raises;
    other columns are ignored.
    """

    def __init__(self, name: str, features: list[str], rounds: int = 50, depth: int = 5, rate: float = 0.1, subsample: float = 0.8, min_instances: int = 5, seed: int = SEED, colsample: float = 0.8, bins: int = 64) -> None:
        self.name, self.features, self.seed = name, list(features), seed
        self.tree_settings = Settings(rounds=rounds, depth=depth, rate=rate, subsample=subsample, colsample=colsample, min_child=min_instances, bins=bins, seed=seed)
        self.fitted: Booster | None = None

    @property
    def settings(self) -> dict:
        return asdict(self.tree_settings)

    @property
    def needed(self) -> list[str]:
        """Columns without which ``transform`` cannot work."""
        return self.features

    def described(self) -> dict[str, str]:
        """What, beside the fitted trees, makes this model again; ``restored`` reads it."""
        return {"class": type(self).__name__}

    def checked(self, rows: DataFrame) -> DataFrame:
        missing = [f for f in self.needed if f not in rows.columns]
        if missing:
            raise ValueError(f"{self.name}: the input lacks {', '.join(missing)}")
        return rows

    def target(self) -> Column:
        """What the trees learn; NULL where a row is none to learn from."""
        return F.col(LABEL).cast("double")

    def scaled(self, prediction: Column) -> Column:
        return prediction

    def fit(self, train: DataFrame) -> GbtModel:
        self.fitted = fit_models(train, [self], [None])[self.name, 0]
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise RuntimeError(f"{self.name}: transform() before fit()")
        return self.predict_by(rows, F.lit(0), {0: self.fitted})

    def predict_by(self, rows: DataFrame, which: Column, boosters: dict[int, Booster]) -> DataFrame:
        """Predictions of rows by the booster that ``which`` numbers for each."""
        raw = predicted(boosters, which, tuple(self.features), rows.sparkSession)
        return self.checked(rows).withColumn("prediction_mwh", self.scaled(raw))

    def importance(self) -> list[tuple[str, float]]:
        """Features with the gain of their splits, largest first."""
        gains = self.fitted.gains() if self.fitted is not None else {}
        return sorted(gains.items(), key=lambda x: (-x[1], x[0]))


class GbtRatioModel(GbtModel):
    """Learns the label's ratio to a recent level and multiplies back, so a shift of the level is no error."""

    def __init__(self, name: str, features: list[str], baseline: str = "demand_rolling_mean_24h_to_cutoff", **settings) -> None:
        super().__init__(name, features, **settings)
        self.baseline = baseline

    @property
    def needed(self) -> list[str]:
        return [*self.features, *([self.baseline] if self.baseline not in self.features else [])]

    def described(self) -> dict[str, str]:
        return {**super().described(), "baseline": self.baseline}

    def target(self) -> Column:
        return F.when(F.col(self.baseline) > 0, F.col(LABEL).cast("double") / F.col(self.baseline))

    def scaled(self, prediction: Column) -> Column:
        return prediction * F.col(self.baseline)


def fit_models(rows: DataFrame, models: list[GbtModel], windows: list[tuple | None]) -> dict[tuple[str, int], Booster]:
    """(model's name, number of the window): booster, for each model on each window of dates (first, last; None: all rows). Models of equal settings grow in the same passes. A model without a row to train on raises."""
    found: dict[tuple[str, int], Booster] = {}
    for settings in dict.fromkeys(m.tree_settings for m in models):
        alike = [m for m in models if m.tree_settings == settings]
        labelled = rows
        for k, m in enumerate(alike):
            labelled = m.checked(labelled).withColumn(f"_learned_{k}", m.target())
        jobs = [(m, w, Fit(tuple(m.features), f"_learned_{k}", *(window or (None, None)))) for k, m in enumerate(alike) for w, window in enumerate(windows)]
        for (m, w, _), booster in zip(jobs, fit_boosters(labelled, [fit for _, _, fit in jobs], settings), strict=True):
            if booster is None:
                raise ValueError(f"{m.name}: no labelled row to train on")
            found[m.name, w] = booster
    return found


def restored(name: str, features: list[str], described: dict[str, str], fitted: Booster) -> GbtModel:
    """A model from what ``described`` says and its fitted trees. An unknown class raises."""
    kind = described.get("class", GbtModel.__name__)
    if kind == GbtRatioModel.__name__:
        model: GbtModel = GbtRatioModel(name, features, described["baseline"])
    elif kind == GbtModel.__name__:
        model = GbtModel(name, features)
    else:
        raise ValueError(f"{name}: no model class {kind}")
    model.fitted = fitted
    return model
