"""Silver days rebuilt where new vintages touch them, and nowhere else.

An hour of silver takes its values from the feed's same hour, its day-ahead forecast from the hour before, and
its anomaly flag from the hours a day before and after. So a new vintage on a day can change that day and its two
neighbours, and these need the feed of one more day on either side. The table is partitioned by region and day;
a batch replaces the partitions it touches and leaves the files of all others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import DEFAULT, FeedConfig
from tidemark.functions.calendar import one_hour
from tidemark.operators.hourly import REGION, TIME
from tidemark.plans.silver import SILVER, build_silver
from tidemark.operators.quality import classify
from tidemark.operators.revisions import resolve_revisions
from tidemark.sources.tables import exists, staged

DAY = "day"


def _around(days: DataFrame, reach: int) -> DataFrame:
    """(region, day) of the given ones and of those up to ``reach`` days away."""
    near = F.explode(F.sequence(F.date_sub(DAY, reach), F.date_add(DAY, reach)))
    return days.select(REGION, near.alias(DAY)).distinct()


def _period_day() -> Column:
    return F.to_date(F.try_to_timestamp("period", F.lit("yyyy-MM-dd'T'HH")))


def _of_days(feed: DataFrame, days: DataFrame) -> DataFrame:
    """The feed rows of the given regions and days."""
    keyed = feed.withColumn("_day", _period_day())
    wanted = days.select(F.col(REGION).alias("_region"), F.col(DAY).alias("_wanted"))
    return keyed.join(wanted, (F.col("respondent") == F.col("_region")) & (F.col("_day") == F.col("_wanted")), "left_semi").drop("_day")


def _ends(hours: DataFrame) -> DataFrame:
    return hours.agg(F.min(TIME).alias("low"), F.max(TIME).alias("high"))


def rebuild_days(spark: SparkSession, feed: DataFrame, fresh: DataFrame, target: str, config: FeedConfig = DEFAULT) -> int:
    """Bring the silver table at ``target`` up to date after ``fresh`` rows have come into ``feed``; gives the partitions rebuilt.

    The result is that of a full rebuild: hours run from the first to the last valid one of any region, so
    where ``fresh`` moves an end, the days beyond the old one are built, or taken away, for every region.
    Rows without a readable period or region touch nothing.
    """
    touched = staged(fresh.select(F.col("respondent").alias(REGION), _period_day().alias(DAY)).filter(f"{REGION} is not null and {DAY} is not null").distinct(), "touched")
    if touched.isEmpty():
        return 0
    # The ends of all hours that have a valid row: of the touched days from the feed, of the others from the table.
    valid = classify(resolve_revisions(_of_days(feed, touched)), config).filter("reason is null").select(F.col("respondent").alias(REGION), TIME)
    seen = valid
    if exists(spark, target):
        table = spark.read.parquet(target)
        others = table.filter("ingested_at is not null").join(touched, [REGION, DAY], "left_anti").select(REGION, TIME)
        seen = valid.unionByName(others)
    seen = staged(seen.groupBy(REGION).agg(F.min(TIME).alias("low"), F.max(TIME).alias("high")), "ends")  # a row a region
    ends = seen.agg(F.min("low").alias("low"), F.max("high").alias("high"))
    old = _ends(table.select(TIME)) if exists(spark, target) else ends.filter("false").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    both = ends.select(F.col("low").alias("new_low"), F.col("high").alias("new_high")).join(old, F.lit(True))
    # Days between an old and a new end of the hours: of every region, also where it has no row there.
    day = lambda c: F.to_date(c)
    spans = F.array(*[F.struct(F.least(day(a), day(b)).alias("a"), F.greatest(day(a), day(b)).alias("b")) for a, b in (("new_low", "low"), ("high", "new_high"))])
    moved = both.select(F.explode(F.filter(spans, lambda s: s["a"] < s["b"])).alias("s"))
    changed_hour = both.select(F.explode(F.filter(F.array(F.when(F.col("low") != F.col("new_low"), F.struct(day("low").alias("a"), day("low").alias("b"))), F.when(F.col("high") != F.col("new_high"), F.struct(day("high").alias("a"), day("high").alias("b")))), lambda s: s.isNotNull())).alias("s"))
    beyond = moved.union(changed_hour).select(F.explode(F.sequence("s.a", "s.b")).alias(DAY))
    regions = seen.select(REGION).union(touched.select(REGION)).distinct()
    if exists(spark, target):
        regions = regions.union(table.select(REGION)).distinct()
    everywhere = regions.join(beyond.distinct(), F.lit(True)).select(REGION, DAY)  # regions beside a few days
    new_regions = seen.select(REGION)
    if exists(spark, target):
        new_regions = new_regions.join(table.select(REGION).distinct(), REGION, "left_anti")
    whole = new_regions.join(ends, F.lit(True)).select(REGION, F.explode(F.sequence(F.to_date("low"), F.to_date("high"))).alias(DAY))
    days = staged(_around(touched, 1).union(everywhere).union(whole).distinct(), "days")
    held = staged(_around(days, 1), "halo")
    bounded = held.join(ends, F.lit(True)).join(seen.select(REGION), REGION, "left_semi")
    hours = F.explode(F.sequence(F.col(DAY).cast("timestamp"), F.col(DAY).cast("timestamp") + F.expr("interval 23 hours"), one_hour()))
    spine = bounded.select(REGION, "low", "high", hours.alias(TIME)).filter(F.col(TIME).between(F.col("low"), F.col("high"))).select(REGION, TIME)
    silver, _ = build_silver(_of_days(feed, held), config, spine=spine)
    rows = staged(silver.withColumn(DAY, F.to_date(TIME)).join(days, [REGION, DAY], "left_semi").select(*SILVER, DAY), "silver_days")
    rows.repartition(REGION, DAY).sortWithinPartitions(TIME).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(REGION, DAY).parquet(target)
    _take_away(spark, days.join(rows.select(REGION, DAY).distinct(), [REGION, DAY], "left_anti"), target)
    return days.count()


def _take_away(spark: SparkSession, days: DataFrame, target: str) -> None:
    """Remove the partitions of days that have no hour any more; there are some only where an end of the hours moves inwards."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in days.toLocalIterator():
        files.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, f"{REGION}={row[REGION]}/{DAY}={row[DAY]}"), True)


def stream_silver(spark: SparkSession, bronze: str, schema: str, target: str, checkpoint: str, config: FeedConfig = DEFAULT, max_files: int | None = None) -> None:
    """Follow a bronze table: each batch of its new files rebuilds the days that they touch, from the whole table. A batch that is run again does the same again."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def batch(fresh: DataFrame, _: int) -> None:
        session = fresh.sparkSession
        rebuild_days(session, session.read.schema(schema).parquet(bronze), fresh, target, config)

    reader.parquet(bronze).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
