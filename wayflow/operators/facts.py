"""Comparison of experiment results: curves, roll-ups, best rows, joins of methods, shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflow.functions import scalar


def distinct_facts(facts: DataFrame) -> DataFrame:
    """Rows with hop, seed and a total, copies under another fact_id dropped."""
    return facts.where("hop is not null and seed is not null and total_after >= 0").drop("fact_id").distinct()


def best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, iteration, total: iteration 0 is the first row's total_before, iteration k + 1 the total_after of k."""
    first = rows.groupBy(*keys).agg(F.min_by("total_before", "iteration").alias("total")).withColumn("iteration", F.lit(0))
    rest = rows.groupBy(*keys, (F.col("iteration") + 1).alias("iteration")).agg(F.min("total_after").alias("total"))
    return first.unionByName(rest)


def curve_metrics(points: DataFrame, keys: list[str]) -> DataFrame:
    """final_reduction, speed and rebound of a curve (iteration, total); null where the start is not positive or nothing follows."""
    per = points.groupBy(*keys).agg(F.min_by("total", "iteration").alias("t0"), F.max_by("total", "iteration").alias("last"), F.min(F.when(F.col("iteration") > 0, F.col("total"))).alias("least"), F.avg(F.when(F.col("iteration") > 0, F.col("total"))).alias("mean"))
    ok = (F.col("t0") > 0) & F.col("least").isNotNull()
    return per.select(*keys, F.when(ok, F.round(1 - F.col("last") / F.col("t0"), 6)).alias("final_reduction"), F.when(ok, F.round(1 - F.col("mean") / F.col("t0"), 6)).alias("speed"), F.when(ok, F.col("last") - F.col("least")).alias("rebound"))


def volatility(points: DataFrame, keys: list[str]) -> DataFrame:
    """Upward steps of a curve: the largest, their sum and number, and the range, also as shares of the start."""
    w = Window.partitionBy(*keys).orderBy("iteration")
    up = F.greatest(F.lit(0), F.col("total") - F.lag("total").over(w))
    per = points.withColumn("up", up).groupBy(*keys).agg(F.max("up").alias("max_up"), F.sum("up").alias("sum_up"), F.count_if(F.col("up") > 0).alias("num_up_steps"), (F.max("total") - F.min("total")).alias("range"), F.min_by("total", "iteration").alias("t0"))
    base = F.nullif(F.col("t0"), F.lit(0))
    return per.select(*keys, "max_up", "sum_up", "num_up_steps", F.round(F.col("max_up") / base, 6).alias("max_up_ratio"), F.round(F.col("sum_up") / base, 6).alias("sum_up_ratio"), F.round(F.col("range") / base, 6).alias("range_ratio"))


def rolled_up(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Per key over its iterations: best and final total, reduction, fluctuation, time; keys with fewer than ``least`` iterations are left out."""
    per = rows.groupBy(*keys).agg(
        F.countDistinct("iteration").alias("iterations"), F.min_by("total_before", "iteration").alias("start"), F.min("total_after").alias("best"),
        F.max_by("total_after", F.struct("iteration", "total_after")).alias("final"), F.sum("method_total_sec").alias("sec"), F.avg("selected_fraction").alias("fraction"),
    )
    return per.where(F.col("iterations") >= least).select(*keys, "iterations", "best", "final", F.round(scalar.safe_ratio(F.col("start") - F.col("best"), "start"), 4).alias("reduction_percent"), (F.col("final") - F.col("best")).alias("fluctuation"), F.round("sec", 6).alias("total_sec"), F.round(F.col("fraction") + 1e-9, 6).alias("mean_fraction"))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean with population deviation (0 for a single row) and sample deviation."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"), F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), 4).alias("std_pop"), F.round(F.stddev_samp(value), 4).alias("std_samp"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; evaluating them fails if a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit(f"repeated key in {keys}")).isNull()).drop("_n")


def compared(left: DataFrame, right: DataFrame, keys: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Two methods side by side on their common keys, with the ratio of their values."""
    a = left.groupBy(*keys).agg(F.min(value).alias(names[0]))
    b = right.groupBy(*keys).agg(F.min(value).alias(names[1]))
    return a.join(b, keys).withColumn("ratio", F.round(scalar.safe_ratio(names[0], names[1]), 4))


def share_of_total(rows: DataFrame, keys: list[str], part: str, whole: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(F.sum(part), 6).alias("part"), F.round(scalar.safe_ratio(F.sum(part), F.sum(whole)), 4).alias("share"))


def scaled(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Min-max scale within the key; no range gives a half."""
    span = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.join(span, keys)
    return joined.withColumn(out, F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)).drop("_lo", "_hi")


def tiered(rows: DataFrame, tiers: list[tuple[str, int]], item: str, score: str) -> DataFrame:
    """Up to so many rows per tier's condition by falling score; what a tier took is gone for the next."""
    out, taken = None, None
    for k, (where, most) in enumerate(tiers):
        pool = rows.where(where) if taken is None else rows.where(where).join(taken, item, "left_anti")
        part = pool.orderBy(F.desc(score), item).limit(most).withColumn("tier", F.lit(k))
        out = part if out is None else out.unionAll(part)
        taken = out.select(item)
    return out


def completeness(rows: DataFrame, keys: list[str], unit: str, expected: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.countDistinct(unit).alias("found"), F.count("*").alias("rows")).withColumn("complete", F.col("found") >= expected)


def group_means(rows: DataFrame, keys: list[str], value: str, won: Column) -> DataFrame:
    """Number, mean, median and largest of a value, and how often a row won."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(value), 3).alias("mean"), F.round(F.median(value), 3).alias("median"), F.max(value).alias("most"), F.round(F.avg(F.when(won, 1.0).otherwise(0.0)), 6).alias("win_rate"))


def to_group_mean(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Every row with its value in units of its group's mean."""
    back = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return rows.join(back, keys, "left").withColumn(out, F.col(value) / F.nullif("_mean", F.lit(0.0))).drop("_mean")


def picked(rows: DataFrame, keys: list[str], parameter: str, score: str) -> DataFrame:
    """The rows of each key at the parameter with which its score is least, the smaller parameter of equal ones."""
    pick = rows.where(F.col(parameter).isNotNull()).groupBy(*keys).agg(F.min_by(parameter, F.struct(score, parameter)).alias(parameter))
    return rows.join(pick, [*keys, parameter])


def by_state(rows: DataFrame, keys: list[str], unit: str, expected: int) -> DataFrame:
    """The keys with state 'complete' if they have so many units, else 'missing'."""
    done = rows.groupBy(*keys).agg(F.countDistinct(unit).alias("n")).where(F.col("n") >= expected).select(*keys)
    every = rows.select(*keys).distinct()
    return every.join(done, keys, "left_anti").withColumn("state", F.lit("missing")).unionAll(every.join(done, keys, "left_semi").withColumn("state", F.lit("complete")))
