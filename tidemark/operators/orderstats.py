"""Exact quantiles of groups and windows of any size.

An aggregate like ``percentile`` keeps all different values of a group in one task. Here each wanted rank has
an interval that holds it, at first the whole range. Rows in an interval are counted by bucket of its width
(map-side combined, at most ``BUCKETS`` numbers an interval), the bucket in which the rank falls becomes the next
interval, cut to the values really in it, until it is one value or has at most ``SMALL`` rows, which are then
sorted. So no group's state grows with its rows, whatever their distribution.

Rows may lie in numbered segments, and a window is a range of segments. Counts are by (bucket, segment), and a
window's count is the sum of its segments' counts, so that many overlapping windows, like expanding folds, do
not copy a row.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import staged

BUCKETS = 256
SMALL = 4096


def _ranks(quantiles: dict[str, float], continuous: bool, n: Column) -> Column:
    """(name, side, rank, share): the ranks, from 1, of each quantile among n rows, and the share of the upper one."""
    found = []
    for name, q in quantiles.items():
        if continuous:
            place = F.lit(float(q)) * (n - 1)
            for side, at in (("low", F.floor(place)), ("high", F.ceil(place))):
                found.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (at + 1).cast("long").alias("rank"), (place - F.floor(place)).alias("share")))
        else:
            at = F.greatest(n - F.floor(n - F.lit(float(q)) * n), F.lit(1))
            found.append(F.struct(F.lit(name).alias("name"), F.lit("low").alias("side"), at.cast("long").alias("rank"), F.lit(0.0).alias("share")))
    return F.array(*found)


def _counted(rows: DataFrame, place: list[str]) -> DataFrame:
    """(place, low, high, rows, parts) of ``rows`` (place, segment, v): least and largest value, number of rows, and that of each segment."""
    counts = rows.groupBy(*place, "segment").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    parts = F.collect_list(F.struct("segment", "n")).alias("parts")
    return counts.groupBy(*place).agg(F.min("least").alias("low"), F.max("most").alias("high"), F.sum("n").alias("rows"), parts)


def _in_window() -> Column:
    """Rows of the segments from ``first`` to ``last``."""
    inside = F.filter("parts", lambda p: p["segment"].between(F.col("first"), F.col("last")))
    return F.aggregate(inside, F.lit(0).cast("long"), lambda n, p: n + p["n"])


def _narrowed(held: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted ranks with the bucket in which each falls as their interval."""
    place = [*keys, "from", "to"]
    asked = wanted.withColumnsRenamed({"low": "from", "high": "to"}).drop("rows")
    inside = held.join(asked.select(*place).distinct(), keys).filter(F.col("v").between(F.col("from"), F.col("to")))
    # Halves where the width of a range of very large numbers would be none.
    part = lambda scale: (F.col("v") * scale - F.col("from") * scale) / (F.col("to") * scale - F.col("from") * scale)
    share = F.when(F.col("to") - F.col("from") < F.lit(float("inf")), part(1.0)).otherwise(part(0.5))
    buckets = _counted(inside.withColumn("bucket", F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")), [*place, "bucket"])
    order = Window.partitionBy(*keys, "window", "name", "side").orderBy("bucket")
    both = asked.join(buckets, place).withColumn("own", _in_window()).withColumn("reached", F.col("below") + F.sum("own").over(order))
    found = both.filter("reached >= rank and reached - own < rank").withColumn("below", F.col("reached") - F.col("own"))
    return found.select(*[c for c in wanted.columns])


def order_statistics(rows: DataFrame, windows: DataFrame, quantiles: dict[str, float], keys: list[str], continuous: bool = True, small: int = SMALL) -> DataFrame:
    """(keys, window, n, a column for each quantile) of the windows that hold a value.

    ``rows`` has the keys, ``segment`` (from 0) and ``v``; NULL and what is no number is left out. ``windows``
    has the keys, ``window`` and its ``first`` and ``last`` segment, and is small: a row a group or fold.
    Continuous quantiles lie between two values, others are the least value that enough rows do not exceed.
    """
    whole = keys or ["_whole"]
    held = rows if keys else rows.withColumn("_whole", F.lit(0))
    asked = windows if keys else windows.withColumn("_whole", F.lit(0))
    held = held.select(*whole, F.col("segment").cast("int").alias("segment"), F.col("v").cast("double").alias("v")).filter("v is not null and not isnan(v)")
    held = staged(held, "order_values")
    sized = asked.select(*whole, "window", "first", "last").join(_counted(held, whole), whole).withColumn("n", _in_window()).filter("n > 0")
    wanted = sized.select("*", F.explode(_ranks(quantiles, continuous, F.col("n"))).alias("r")).select("*", "r.*", F.lit(0).cast("long").alias("below"))
    columns = [*whole, "window", "first", "last", "n", "name", "side", "rank", "share", "below", "low", "high", "rows"]
    wanted = staged(wanted.select(*columns), "order_wanted")
    open_ones = F.col("low") < F.col("high")
    wide = open_ones & (F.col("rows") > small)
    while not wanted.filter(wide).isEmpty():
        wanted = staged(_narrowed(held, wanted.filter(wide), whole).unionByName(wanted.filter(~wide)), "order_wanted")
    done = wanted.filter(~open_ones).withColumn("value", F.col("low"))
    rest = wanted.filter(open_ones)
    near = held.join(rest.select(*whole, "low", "high").distinct(), whole).filter(F.col("v").between(F.col("low"), F.col("high")))
    near = near.join(rest, [*whole, "low", "high"]).filter("segment between first and last")
    place = F.row_number().over(Window.partitionBy(*whole, "window", "name", "side").orderBy("v"))
    picked = near.withColumn("place", place).filter("place = rank - below").withColumn("value", F.col("v"))
    found = done.select(*whole, "window", "n", "name", "side", "share", "value").unionByName(picked.select(*whole, "window", "n", "name", "side", "share", "value"))
    of = lambda name, side: F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("value")))
    between = lambda name: of(name, "low") + (of(name, "high") - of(name, "low")) * F.max(F.when(F.col("name") == name, F.col("share"))) if continuous else of(name, "low")
    return found.groupBy(*keys, "window").agg(F.max("n").alias("n"), *[between(name).alias(name) for name in quantiles])


def group_quantiles(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], continuous: bool = True, small: int = SMALL) -> DataFrame:
    """(keys, n, a column for each quantile) of each group that holds a value. Groups with a NULL key are left out."""
    used = rows.select(*keys, F.lit(0).alias("segment"), F.col(value).alias("v"))
    used = staged(used.filter(F.col("v").isNotNull()), "order_rows")
    groups = used.select(*keys, F.lit(0).alias("window"), F.lit(0).alias("first"), F.lit(0).alias("last")).distinct()
    return order_statistics(used, groups, quantiles, keys, continuous, small).drop("window")


def segments_of(windows: DataFrame, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """Cut the days of all windows at every start and end: (day, segment), and the windows with ``first`` and ``last`` as numbers of segments.

    Both tables are as long as a calendar, whatever the data.
    """
    ends = F.explode(F.array(F.col(first), F.date_add(last, 1)))
    cuts = windows.select(ends.alias("cut")).distinct().agg(F.sort_array(F.collect_list("cut")).alias("cuts")).filter(F.size("cuts") > 1)
    days = cuts.select("cuts", F.explode(F.sequence(F.array_min("cuts"), F.date_sub(F.array_max("cuts"), 1))).alias("day"))
    numbered = days.select("day", F.size(F.filter("cuts", lambda c: c <= F.col("day"))).alias("segment"))
    place = lambda c: F.array_position("cuts", c).cast("int")
    # One row of cuts beside each window.
    ranged = windows.join(cuts, F.lit(True)).withColumns({"first": place(F.col(first)), "last": place(F.date_add(last, 1)) - 1}).drop("cuts")
    return numbered, ranged


__all__ = ["group_quantiles", "order_statistics", "segments_of"]
