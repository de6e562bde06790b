"""Step functions over time, per key: running sums, as-of and interval joins, occupancy, windows of area.

A key may hold a third of all rows, so nothing here gathers a key in one task. Time is cut into buckets; what a bucket inherits from the earlier
ones of its key (a running total, the last value) comes from one row per bucket, and only rows of one (key, bucket) meet in a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wayflow.session import cut

BUCKET_S = 6 * 3600


def _bucket(time: str, width: int) -> Column:
    return F.floor(F.col(time) / width).cast("bigint")


def running_sum(rows: DataFrame, keys: list[str], time: str, value: str, out: str, width: int = BUCKET_S) -> DataFrame:
    """Sum of value over all rows of the key up to and including the row's time."""
    rows = rows.withColumn("_b", _bucket(time, width))
    totals = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_c", F.coalesce(F.sum("_t").over(before), F.lit(0).cast("bigint"))).drop("_t")
    within = Window.partitionBy(*keys, "_b").orderBy(time).rangeBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_w", F.sum(value).over(within)).join(carried, [*keys, "_b"])
    return summed.withColumn(out, F.col("_w") + F.col("_c")).drop("_w", "_c", "_b")


def as_of(probes: DataFrame, steps: DataFrame, keys: list[str], time: str, value: str, width: int = BUCKET_S, default: int | None = 0) -> DataFrame:
    """For each probe the value (a whole number or a struct) of the last step at or before its time; ``default`` before the first.

    One step per (keys, time). Buckets without steps inherit along the key's list of buckets.
    """
    extra = [c for c in probes.columns if c not in (*keys, time)]
    kind = steps.schema[value].dataType
    kind = kind if kind.typeName() == "struct" else LongType()
    a = probes.select(*keys, time, F.lit(1).alias("_p"), F.lit(None).cast(kind).alias("_v"), F.struct(*extra, F.lit(1).alias("_one")).alias("_x"))
    b = steps.select(*keys, time, F.lit(0).alias("_p"), F.col(value).cast(kind).alias("_v"), F.lit(None).cast(a.schema["_x"].dataType).alias("_x"))
    both = a.unionAll(b).withColumn("_b", _bucket(time, width))
    last = both.groupBy(*keys, "_b").agg(F.max_by("_v", F.when(F.col("_p") == 0, F.col(time))).alias("_l"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("_c", F.last("_l", True).over(before)).drop("_l")
    within = Window.partitionBy(*keys, "_b").orderBy(time, "_p").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_w", F.last("_v", True).over(within)).where("_p = 1").join(carried, [*keys, "_b"])
    return found.select(*keys, time, *(F.col(f"_x.{c}").alias(c) for c in extra), F.coalesce("_w", "_c", F.lit(default).cast(kind)).alias(value))


def interval_join(points: DataFrame, spans: DataFrame, keys: list[str], time: str, start: str, end: str, width: int = BUCKET_S, closed: bool = False) -> DataFrame:
    """Points of the same key with start <= time < end (<= end if closed). Each span is listed in the buckets it touches, so the join is an equi join."""
    last = F.col(end) if closed else F.col(end) - 1
    spread = spans.where(last >= F.col(start)).withColumn("_b", F.explode(F.sequence(_bucket(start, width), F.floor(last / width).cast("bigint"))))
    inside = F.col(time).between(F.col(start), last)
    return points.withColumn("_b", _bucket(time, width)).join(spread, [*keys, "_b"]).where(inside).drop("_b")


def occupancy(stays: DataFrame, keys: list[str], enter: str = "enter", exit_: str = "exit", final: str | None = None) -> DataFrame:
    """keys, time, flow after all changes at that time, is_entry: the step function of how many stay. ``final``: stays that are never released."""
    entered = stays.select(*keys, F.col(enter).alias("time"), F.lit(1).cast("bigint").alias("d"), F.lit(1).alias("e"))
    left = (stays.where(~F.col(final)) if final else stays).select(*keys, F.col(exit_).alias("time"), F.lit(-1).cast("bigint").alias("d"), F.lit(0).alias("e"))
    changes = entered.unionAll(left).groupBy(*keys, "time").agg(F.sum("d").alias("d"), F.max("e").alias("e"))
    return running_sum(changes, keys, "time", "d", "flow").select(*keys, "time", F.col("flow").cast("bigint").alias("flow"), (F.col("e") == 1).alias("is_entry"))


def occupants(stays: DataFrame, steps: DataFrame, keys: list[str], who: str) -> DataFrame:
    """The sorted set of those present after each step."""
    met = interval_join(steps.select(*keys, "time"), stays, keys, "time", "enter", "exit")
    return met.groupBy(*keys, "time").agg(F.array_sort(F.collect_set(who)).alias("occupants"))


def areas(steps: DataFrame, keys: list[str], width: int = BUCKET_S) -> DataFrame:
    """The steps with ``area``, the integral of flow from the key's first step on."""
    w = Window.partitionBy(*keys, "_b").orderBy("time")
    rows = steps.withColumn("_b", _bucket("time", width))
    ends = rows.groupBy(*keys, "_b").agg(F.max_by(F.struct("time", "flow"), "time").alias("_e"))
    carried = ends.withColumn("_e", F.lag("_e").over(Window.partitionBy(*keys).orderBy("_b")))
    rows = rows.join(carried, [*keys, "_b"])
    since = F.col("time") - F.coalesce(F.lag("time").over(w), F.col("_e.time"), F.col("time"))
    held = F.coalesce(F.lag("flow").over(w), F.col("_e.flow"), F.lit(0))
    rows = rows.withColumn("_a", (since * held).cast("bigint")).drop("_e", "_b")
    return running_sum(rows, keys, "time", "_a", "area", width).drop("_a")


def trailing_areas(steps: DataFrame, keys: list[str], window: int) -> DataFrame:
    """The steps with ``duration``, how far the trailing window reaches back within the key's life, and ``window_area`` over it."""
    summed = cut(areas(steps, keys))
    first = summed.groupBy(*keys).agg(F.min("time").alias("first"))
    asked = summed.join(first, keys).select(*keys, F.greatest(F.col("first"), F.col("time") - window).alias("t"), "time", "flow", "is_entry", "area")
    # the state at the window's start: time, flow and area of the last step at or before it
    states = summed.select(*keys, F.col("time").alias("t"), F.struct("time", "flow", "area").alias("s"))
    at = as_of(asked, states, keys, "t", "s", default=None)
    start = F.col("s.area") + F.col("s.flow") * (F.col("t") - F.col("s.time"))
    return at.select(*keys, "time", "flow", "is_entry", (F.col("time") - F.col("t")).alias("duration"), (F.col("area") - start).cast("bigint").alias("window_area"))
