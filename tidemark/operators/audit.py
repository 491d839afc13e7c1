"""Leakage audit as a set operation: each (cutoff, target) pair meets the specs in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FeedConfig
from tidemark.functions.calendar import hours_between, local_midnight_utc
from tidemark.operators.features import READ, Anchor, FeatureSpec


def spec_frame(spark: SparkSession, specs: list[FeatureSpec]) -> DataFrame:
    rows = [(s.name, s.anchor.value, s.offset_hours, s.metric, s.lead_days) for s in specs]
    return spark.createDataFrame(rows, "feature string, anchor string, offset_hours int, metric string, lead_days int")


def available_at(spec: FeatureSpec, config: FeedConfig = DEFAULT) -> Column:
    """When a feature's newest input can be known; NULL for the calendar, known forever. A forecast of lead n is known at the end of the local day n days before the target's."""
    if spec.anchor is Anchor.CALENDAR:
        return F.lit(None).cast("timestamp")
    if spec.anchor is Anchor.WEATHER:
        return local_midnight_utc(F.date_add("target_local_date", 1 - spec.lead_days), config.tz)
    anchor = F.col("cutoff_utc" if spec.anchor is Anchor.CUTOFF else "target_timestamp_utc")
    hours = config.publication_lag_hours[spec.metric] - spec.offset_hours
    return anchor + F.expr(f"interval {hours} hours")


def availability(pairs: DataFrame, specs: list[FeatureSpec], config: FeedConfig = DEFAULT) -> DataFrame:
    """(cutoff, target, target day, feature, available_at) of all specs. The specs are a short list of the program, so they are exploded from a literal and nothing is joined."""
    known = F.array(*[F.struct(F.lit(s.name).alias("feature"), available_at(s, config).alias("available_at")) for s in specs])
    base = pairs.select("cutoff_utc", "target_timestamp_utc", "target_local_date").distinct()
    return base.select("*", F.explode(known).alias("s")).select("cutoff_utc", "target_timestamp_utc", "target_local_date", "s.*")


def violations(pairs: DataFrame, specs: list[FeatureSpec], config: FeedConfig = DEFAULT) -> DataFrame:
    """Features known only after the cutoff; equality passes."""
    late = availability(pairs, specs, config).filter("available_at > cutoff_utc")
    return late.withColumn("hours_late", hours_between(F.col("cutoff_utc"), F.col("available_at")))


def worst_first(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("hours_late").desc(), "feature", "cutoff_utc", "target_timestamp_utc")


def audit_report(pairs: DataFrame, specs: list[FeatureSpec], config: FeedConfig = DEFAULT) -> DataFrame:
    """Per feature: pairs checked, pairs violated, the latest hour."""
    rows = availability(pairs, specs, config)
    late = F.col("available_at") > F.col("cutoff_utc")
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.coalesce(late, F.lit(False)).cast("long")).alias("violations"), F.max(F.when(late, hours_between(F.col("cutoff_utc"), F.col("available_at")))).alias("max_hours_late"))


def joined_report(rows: DataFrame, specs: list[FeatureSpec], config: FeedConfig = DEFAULT) -> DataFrame:
    """Per feature, from feature rows that carry what was read: values, those read from an hour published only after the cutoff, the latest hour, and those read from a later hour than the spec declares.

    The specs only name the features and what they declare; the verdict is on the hours really joined.
    """
    held = [s for s in specs if READ + s.name in rows.columns]

    def entry(s: FeatureSpec) -> Column:
        read = F.col(READ + s.name)
        known = read + F.expr(f"interval {config.publication_lag_hours[s.metric]} hours")
        declared = available_at(s, config)
        return F.struct(F.lit(s.name).alias("feature"), read.alias("read"), known.alias("known"), declared.alias("declared"))

    if not held:
        raise ValueError("no feature of the specs carries what was read")
    each = rows.select("cutoff_utc", F.explode(F.array(*[entry(s) for s in held])).alias("s")).select("cutoff_utc", "s.*").filter("read is not null")
    late, beyond = F.col("known") > F.col("cutoff_utc"), F.col("known") > F.col("declared")
    return each.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sum(late.cast("long")).alias("violations"), F.max(F.when(late, hours_between(F.col("cutoff_utc"), F.col("known")))).alias("max_hours_late"), F.sum(beyond.cast("long")).alias("later_than_declared"))


def joined_gate(rows: DataFrame, specs: list[FeatureSpec], config: FeedConfig = DEFAULT) -> dict[str, int]:
    """Raise if any value was read from an hour not yet published at the cutoff or later than its spec says, or if no value was checked."""
    done = joined_report(rows, specs, config).agg(F.sum("values").alias("checks"), F.sum("violations").alias("late"), F.sum("later_than_declared").alias("beyond")).first()
    if not done["checks"]:
        raise ValueError("the audit saw no value")
    if done["late"] or done["beyond"]:
        raise ValueError(f"of {done['checks']} values {done['late']} were read from hours not known at the cutoff, {done['beyond']} from later hours than declared")
    return {"checks": done["checks"], "violations": 0}


def leakage_gate(pairs: DataFrame, specs: list[FeatureSpec], leaky: list[FeatureSpec], config: FeedConfig = DEFAULT) -> dict[str, int]:
    """Raise on any violation, on an empty audit, and if a known leak goes unnoticed. Two aggregate rows reach the driver."""
    done = audit_report(pairs, specs, config).agg(F.sum("pairs").alias("checked"), F.sum("violations").alias("violations")).first()
    if not done["checked"]:
        raise ValueError("the audit saw no pair")
    if done["violations"]:
        raise ValueError(f"{done['violations']} of {done['checked']} checks use what was not known at the cutoff")
    caught = audit_report(pairs, leaky, config).filter("violations > 0").count()
    if caught < len(leaky):
        raise ValueError(f"only {caught} of {len(leaky)} known leaks were caught")
    return {"checks": done["checked"], "violations": 0, "known_leaky_caught": caught}
