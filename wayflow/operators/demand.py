"""Demand: from pings and taxi trips to trip sets. Matching, filtering, sampling, amplification, rescaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflow.functions import scalar
from wayflow.operators.nearby import EARTH_M, haversine_m


def nearest_node(points: DataFrame, nodes: DataFrame, most_m: float) -> DataFrame:
    """points (id, lon, lat) with the nearest node within ``most_m`` and its distance; ties go to the smaller node.

    Bands of latitude are as high as the reach, cells of a band as wide as the reach where it is widest in degrees, at its end nearer to the pole. A node is listed
    in every cell of the three bands around it that its reach touches, across the date line too, which makes it an equi join that keeps each point once.
    Bands that touch a pole are one cell.
    """
    high = max(most_m, 1.0) / (EARTH_M * math.pi / 180) * (1 + 1e-9)
    band = lambda c: f"cast(floor(({c} + 90) / {high}) as bigint)"
    # degrees of longitude that the reach spans in a band, at most; 360 where it may span a pole
    edge = lambda y: f"least(90, greatest(abs({y} * {high} - 90), abs(({y} + 1) * {high} - 90)) + {high})"
    wide = lambda y: f"if({edge(y)} >= 89.9, 360D, least(360D, {high} / cos(radians({edge(y)})) * 1.001))"
    count = lambda y: f"greatest(1L, cast(floor(360 / {wide(y)}) as bigint))"
    cell = lambda c, y: f"cast(floor(({c} + 180) / 360 * {count(y)}) as bigint)"
    listed = nodes.selectExpr("node", "lon as nlon", "lat as nlat", f"explode(sequence({band('lat')} - 1, {band('lat')} + 1)) as y")
    listed = listed.selectExpr("*", f"{count('y')} as n").selectExpr("*", f"floor((nlon + 180) / 360 * n) as x0")
    around = F.expr("explode(array_distinct(transform(array(-1L, 0L, 1L), d -> pmod(cast(x0 as bigint) + d, n))))")
    listed = listed.select("node", "nlon", "nlat", "y", around.alias("x"))
    met = points.selectExpr("*", f"{band('lat')} as y").selectExpr("*", f"pmod({cell('lon', 'y')}, {count('y')}) as x").join(listed, ["x", "y"])
    met = met.withColumn("snap_m", haversine_m(F.col("lon"), F.col("lat"), F.col("nlon"), F.col("nlat"))).where(F.col("snap_m") <= most_m)
    return met.groupBy("id").agg(F.min(F.struct("snap_m", "node")).alias("m")).select("id", "m.node", "m.snap_m")


def without_repeats(points: DataFrame, who: str, time: str, value: str, order: str, day: int = 86400) -> DataFrame:
    """Rows in order of time without those that repeat the row before in value and second."""
    b = F.floor(F.col(time) / day)
    w = Window.partitionBy(who, "_b").orderBy(time, order)
    # an equal second lies in the same bucket, so the row before in the bucket is the one that can be repeated
    return points.withColumn("_b", b).withColumn("_p", F.lag(F.struct(value, time)).over(w)).where(~F.coalesce((F.col(f"_p.{value}") == F.col(value)) & (F.col(f"_p.{time}") == F.col(time)), F.lit(False))).drop("_p", "_b")


def paired_trips(points: DataFrame, shortest: int, longest: int, tries: int, least_km: float) -> DataFrame:
    """A start with the first of its ``tries`` next points, shortest..longest seconds later, that is another node and ``least_km`` away.

    points: id, who, t, node, lon, lat. Points are listed per bucket of ``longest`` seconds, so a busy vehicle spreads over tasks.
    """
    b = lambda c: F.floor(F.col(c) / longest).cast("bigint")
    starts = points.select("who", F.col("id").alias("s_id"), F.col("t").alias("s_t"), F.col("node").alias("s_node"), F.col("lon").alias("s_lon"), F.col("lat").alias("s_lat"), F.explode(F.array(b("t"), b("t") + 1)).alias("b"))
    met = starts.join(points.withColumn("b", b("t")), ["who", "b"]).where(F.col("t").between(F.col("s_t") + shortest, F.col("s_t") + longest))
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("s_id").orderBy("t", "id"))).where(F.col("k") <= tries)
    km = haversine_m(F.col("s_lon"), F.col("s_lat"), F.col("lon"), F.col("lat")) / 1000
    good = met.withColumn("km", km).where((F.col("node") != F.col("s_node")) & (F.col("km") >= least_km))
    one = good.groupBy("s_id").agg(F.min_by(F.struct("who", F.col("s_node").alias("origin"), F.col("node").alias("destination"), F.col("s_t").alias("depart"), (F.col("t") - F.col("s_t")).alias("duration"), "km"), "k").alias("m"))
    return one.select("s_id", "m.*")


#: Reasons in the order in which they apply (fixed values).
REASONS = ("bad_time", "bad_duration", "bad_coordinate", "outside_bbox", "bad_haversine", "bad_trip_distance", "snap_failed", "same_node")


def first_reason(tests: dict[str, Column]) -> Column:
    """The first failing test's name, null if all hold; a test that is null fails."""
    out = None
    for name in REASONS:
        if name in tests:
            bad = ~F.coalesce(tests[name], F.lit(False))
            out = F.when(bad, name) if out is None else out.when(bad, name)
    return out


def bounding_box(nodes: DataFrame, pad_km: float) -> DataFrame:
    dy = F.lit(pad_km / 111)
    dx = F.lit(pad_km) / (111 * F.cos(F.radians(F.avg("lat"))))
    return nodes.agg((F.min("lon") - dx).alias("lon0"), (F.max("lon") + dx).alias("lon1"), (F.min("lat") - dy).alias("lat0"), (F.max("lat") + dy).alias("lat1"))


def within_radius(trips: DataFrame, nodes: DataFrame, lon: float, lat: float, km: float) -> DataFrame:
    """Trips with both ends known and within the radius; a radius of 0 keeps all."""
    if km <= 0:
        return trips
    near = nodes.where(haversine_m(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)) <= km * 1000).select("node")
    return trips.join(near.toDF("origin"), "origin", "left_semi").join(near.toDF("destination"), "destination", "left_semi")


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows drawn at random, the same for the same seed."""
    return rows.orderBy(scalar.hash_order(key, seed), key).limit(n)


def slices(rows: DataFrame, key: str, parts: int, seed: int) -> DataFrame:
    """Rows in random order cut into ``part`` 0.. of equal size, the first ones larger by one where it doesn't divide. Places are counted by ranges of the hash."""
    h = scalar.hash_order(key, seed)
    rows = rows.withColumns({"_h": h, "_b": F.shiftright(h, 48)})
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # at most 65,536 rows
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n")).withColumns({"_f": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy())}).drop("_n")
    at = F.col("_f") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    own = rows.join(F.broadcast(sizes), "_b").withColumn("_i", at)
    part = F.expr(f"if(_i < (_all % {parts}) * (_all div {parts} + 1), _i div (_all div {parts} + 1), (_i - _all % {parts}) div (_all div {parts}))")
    return own.withColumn("part", part.cast("int")).drop("_h", "_b", "_f", "_all", "_i")


def amplified(rows: DataFrame, key: str, rep: int, jitter: int, seed: int, extra: int = 0) -> DataFrame:
    """Every row ``rep`` times, copies after the first moved by up to ``jitter`` seconds; ``extra`` percent of the rows once more."""
    more = F.when(F.pmod(scalar.hash_order(key, seed + 1), F.lit(100)) < extra, 1).otherwise(0)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), rep - 1 + more)))
    move = F.when(F.col("copy") == 0, 0).otherwise(F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("copy")), F.lit(2 * jitter + 1)) - jitter)
    return copies.withColumn("depart", F.greatest(F.lit(0), F.col("depart") + move))


def rescaled(trips: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Departures of each set mapped linearly onto 0..window."""
    span = trips.groupBy(*keys).agg(F.min("depart").alias("_lo"), F.max("depart").alias("_hi"))
    return trips.join(F.broadcast(span), keys).withColumn("depart", scalar.rescaled("depart", "_lo", "_hi", window)).drop("_lo", "_hi")


def popular(trips: DataFrame, n: int) -> DataFrame:
    return trips.groupBy("destination").agg(F.count("*").alias("trips")).orderBy(F.desc("trips"), "destination").limit(n)


def local_pairs(nodes: DataFrame, origin: tuple[float, float], destination: tuple[float, float], n: int, seed: int, km: float = 1.0, most_km: float = 64.0) -> DataFrame:
    """n origins and destinations (node, lon, lat) drawn around two places and matched in their random orders.

    The radius around a place doubles until it holds n nodes, or to ``most_km``; n rows of each side are numbered, which is what the caller asks for.
    """

    def drawn(at: tuple[float, float], name: str, s: int) -> DataFrame:
        away = nodes.withColumn("_m", haversine_m(F.col("lon"), F.col("lat"), F.lit(at[0]), F.lit(at[1])) / 1000)
        rings = away.select(F.greatest(F.lit(0), F.ceil(F.log2(F.col("_m") / km))).alias("r")).groupBy("r").count().where(F.col("r") <= math.ceil(math.log2(most_km / km))).collect()
        reach, held = 0, 0
        for r, c in sorted((x["r"], x["count"]) for x in rings if x["r"] is not None):
            reach, held = r, held + c
            if held >= n:
                break
        near = sample(away.where(F.col("_m") <= km * 2**reach), "node", n, s)
        return near.select(F.col("node").alias(name), F.row_number().over(Window.orderBy(scalar.hash_order("node", s), "node")).alias("k"))

    return drawn(origin, "origin", seed).join(drawn(destination, "destination", seed + 1), "k").where("origin <> destination").select("origin", "destination")
