"""A registry of model versions kept in tables, with aliases, and the promotion rule.

Versions and aliases are append-only Parquet tables; the newest row of an alias holds. Fitted trees are
saved beside them, each model in a folder of its own. A version's number is claimed by creating a file that
must not exist yet, so two runs at once get two numbers.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.boosting import Booster
from tidemark.operators.models import GbtModel, restored

CHAMPION = "champion"
TRAINED_THROUGH = "gate_model_trained_through"
VERSIONS = "name string, version int, run_name string, features array<string>, params map<string,string>, metrics map<string,double>, model_path string, created_at timestamp"
ALIASES = "name string, alias string, version int, sequence int, set_at timestamp"


@dataclass(frozen=True)
class PromotionVerdict:
    promote: bool
    reason: str
    candidate_mae: float
    champion_mae: float | None


@dataclass(frozen=True)
class ComparisonBasis:
    informative: bool
    description: str


def decide_promotion(candidate_mae: float, champion_mae: float | None, tolerance_pct: float = 2.0) -> PromotionVerdict:
    """Promote if there is no champion, or if the candidate's error is within the tolerance of the champion's."""
    if champion_mae is None:
        return PromotionVerdict(True, "there is no champion yet", candidate_mae, None)
    good = candidate_mae <= champion_mae * (1 + tolerance_pct / 100)
    reason = f"{'within' if good else 'worse by more than'} {tolerance_pct:g}% of the champion"
    return PromotionVerdict(good, reason, candidate_mae, champion_mae)


def promotions(scores: DataFrame, candidate: str, champion: str, tolerance_pct: float = 2.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """``decide_promotion`` for each group of a table of scores (model, MAE_mwh, keys)."""
    mae = lambda name: F.max(F.when(F.col("model") == name, F.col("MAE_mwh")))
    pairs = scores.groupBy(*keys).agg(mae(candidate).alias("candidate_mae"), mae(champion).alias("champion_mae"))
    good = F.col("candidate_mae") <= F.col("champion_mae") * (1 + tolerance_pct / 100)
    return pairs.withColumn("promote", F.col("champion_mae").isNull() | good)


def describe_comparison(candidate_through: str, incumbent_through: str | None) -> ComparisonBasis:
    """Two gate models say something about each other only if their training windows differ."""
    if incumbent_through is None:
        return ComparisonBasis(False, "no champion to compare with")
    if incumbent_through == candidate_through:
        return ComparisonBasis(False, f"both gate models are trained through {candidate_through}, so they are the same")
    return ComparisonBasis(True, f"incumbent through {incumbent_through}, candidate through {candidate_through}, one holdout")


class Registry:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def versions(self) -> DataFrame:
        return self._table("versions", VERSIONS)

    def register(self, name: str, model: GbtModel, run_name: str, params: dict[str, str] | None = None, metrics: dict[str, float] | None = None) -> int:
        """Save a fitted model as the next version. Registering does not promote."""
        if model.fitted is None:
            raise ValueError("only a fitted model can be registered")
        path = f"{self.root}/models/{name}/{uuid.uuid4().hex}"
        model.fitted.save(self.spark, path)
        version = self._claim(name)
        own = {"model": model.name, **model.described(), "n_features": str(len(model.features)), "seed": str(model.seed), "settings": json.dumps(model.settings, sort_keys=True), **(params or {})}
        row = (name, version, run_name, model.features, own, {k: float(v) for k, v in (metrics or {}).items()}, path)
        schema = VERSIONS.rsplit(",", 1)[0]
        self.spark.createDataFrame([row], schema).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/versions")
        return version

    def _claim(self, name: str) -> int:
        """The next number of a name that no other run has: a file for it is created, which fails if it is there."""
        last = self.versions().filter(F.col("name") == name).agg(F.max("version").alias("v")).first()["v"]
        version, path = (last or 0) + 1, self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        while not files.createNewFile(path(f"{self.root}/claims/{name}/{version}")):
            version += 1
        return version

    def set_alias(self, name: str, version: int, alias: str = CHAMPION) -> None:
        if self.versions().filter((F.col("name") == name) & (F.col("version") == version)).isEmpty():
            raise ValueError(f"{name} has no version {version}")
        last = self._table("aliases", ALIASES).agg(F.max("sequence").alias("s")).first()["s"]
        row = (name, alias, version, (last or 0) + 1)
        self.spark.createDataFrame([row], ALIASES.rsplit(",", 1)[0]).withColumn("set_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/aliases")

    def aliased(self, name: str, alias: str = CHAMPION) -> dict | None:
        """The version that an alias points to, or None."""
        held = self._table("aliases", ALIASES).filter((F.col("name") == name) & (F.col("alias") == alias)).agg(F.max_by("version", "sequence").alias("v")).first()["v"]
        if held is None:
            return None
        return self.versions().filter((F.col("name") == name) & (F.col("version") == held)).first().asDict(recursive=True)

    def champion_training_cutoff(self, name: str, alias: str = CHAMPION) -> str | None:
        """Last training date of the champion's gate model. A champion that does not record it raises, since no fair comparison is left."""
        held = self.aliased(name, alias)
        if held is None:
            return None
        if TRAINED_THROUGH not in held["params"]:
            raise RuntimeError(f"{name} version {held['version']} does not record {TRAINED_THROUGH}")
        return held["params"][TRAINED_THROUGH]

    def load(self, name: str, alias: str = CHAMPION) -> GbtModel:
        """The aliased model, ready to transform; it checks its inputs by name."""
        held = self.aliased(name, alias)
        if held is None:
            raise LookupError(f"{name} has no {alias}")
        return restored(held["params"]["model"], held["features"], held["params"], Booster.load(self.spark, held["model_path"]))
