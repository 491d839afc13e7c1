"""Session factory: UTC clock, adaptive execution, few shuffle partitions for one machine."""

from __future__ import annotations

import contextlib

from pyspark.sql import SparkSession


def local_session(app: str = "tidemark", cores: int | str = "*", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.extraJavaOptions", "-Duser.timezone=UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Zone-less strings are read in the session's zone, so results hold only under UTC."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "+00:00", "Z"):
        raise ValueError(f"spark.sql.session.timeZone is {zone!r}; it must be UTC")


@contextlib.contextmanager
def utc(spark: SparkSession):
    """Plans made inside use UTC; the session's own time zone is put back afterwards. Expressions keep the zone they were made in."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
