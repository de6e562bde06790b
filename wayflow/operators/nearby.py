"""Points near other points or regions: a dual-tree join on the sphere.

Every point becomes a unit vector; a node of a side's octree holds the count, the exact bounding box and the range of radii of the
points below it, and the ball around the box. From a pair of upper levels on, pairs of nodes are replaced by the pairs of their children, level by level, as equi joins on the
parent's key. A pair whose balls are farther apart than the largest radius is discarded. One whose balls lie wholly within the smallest
is accepted for good: it leaves the descent, and the points below its two nodes are joined by the range of keys without being measured. What is still
uncertain at the leaves is refined point against point. Chords replace great-circle distances in the bounds, which order alike and know neither
poles nor a date line.

A leaf is a cell of about 400 m, or of 12 m where a place holds more than CROWDED rows; a leaf of more than FULL rows is split over salts, so that no two
parts that meet in a task have more than FULL rows a side. Lists of such places are broadcast only if they are small as measured. No step emits pairs before
the tree has confined them: the descent starts at the deepest level at which all pairs of nodes, by a count of distinct keys that is off by a few percent, are fewer than ROOTS.

Defined results: rows whose coordinates or radius are null, not finite or out of range take part in nothing; equal rows give a case once;
empty sides give no rows; points may share a place without limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayflow.session import cut, measured

EARTH_M = 6371008.8
BITS = 20
COARSE = 15
LEVELS = (0, 4, 8, 11, 13, COARSE, 17, BITS)
#: Rows of a place above which its leaves are fine, rows of a leaf's part in one task, pairs of nodes with which the descent may start, and nodes of the right side among them.
CROWDED, FULL, ROOTS, HEADS = 300, 2000, 2_000_000, 20_000
#: Marks the keys of fine leaves.
FINE = 1 << 3 * BITS


def usable(lon: Column, lat: Column) -> Column:
    return lon.between(-180, 180) & lat.between(-90, 90)


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def chord(metres: str) -> str:
    return f"(2 * sin(least(({metres}) / {2 * EARTH_M}, pi() / 2)))"


# Expressions of many parts are written as SQL text, which costs the driver a fraction of their assembly from columns.


def _key(level: int) -> Column:
    x, y, z = (f"cast(shiftright(i{c}, {BITS - level}) as bigint)" for c in "xyz")
    return F.expr(f"shiftleft({x}, {2 * BITS}) | shiftleft({y}, {BITS}) | {z}")


def _vectors(points: DataFrame) -> DataFrame:
    """set, id, r (metres), the unit vector and its cell numbers at the finest level."""
    points = points.where("lon between -180 and 180 and lat between -90 and 90 and r >= 0 and r < double('inf')")
    points = points.selectExpr("set", "id", "r", "cos(radians(lat)) * cos(radians(lon)) as x", "cos(radians(lat)) * sin(radians(lon)) as y", "sin(radians(lat)) as z")
    return points.selectExpr("*", *(f"cast(least(floor(({c} + 1) * {2 ** (BITS - 1)}), {2**BITS - 1}) as int) as i{c}" for c in "xyz"))


def _boxes(again: bool = False) -> list[Column]:
    sides = [f"{f}({c}{k if again else ''}) as {c}{k}" for c in ("r", *"xyz") for k, f in ((0, "min"), (1, "max"))]
    return [F.expr(x) for x in ("sum(n) as n" if again else "count(*) as n", *sides)]


def _leaves(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """set, coarse, leaf, n and box of every leaf, and (set, coarse) of the places with fine leaves."""
    coarse = cut(points.groupBy("set", _key(COARSE).alias("coarse")).agg(*_boxes()))
    full = measured(coarse.where(F.col("n") > CROWDED).select("set", "coarse"))
    fine = points.withColumn("coarse", _key(COARSE)).join(full, ["set", "coarse"]).groupBy("set", "coarse", (_key(BITS) + FINE).alias("leaf")).agg(*_boxes())
    own = coarse.where(F.col("n") <= CROWDED).withColumn("leaf", F.col("coarse"))
    return own.unionByName(fine), full


def _up(level: int) -> str:
    """The key of a leaf's ancestor."""
    if level > COARSE:  # a coarse leaf stands for itself
        x, y, z = (f"shiftleft(shiftright(shiftright(leaf, {BITS * k}) & {(1 << BITS) - 1}, {BITS - level}), {BITS * k})" for k in (2, 1, 0))
        return f"if(leaf >= {FINE}, {FINE} + ({x} | {y} | {z}), leaf)" if level < BITS else "leaf"
    x, y, z = (f"shiftright(shiftright(coarse, {BITS * k}) & {(1 << BITS) - 1}, {COARSE - level})" for k in (2, 1, 0))
    return f"shiftleft({x}, {2 * BITS}) | shiftleft({y}, {BITS}) | {z}" if level < COARSE else "coarse"


def _pyramid(leaves: DataFrame, levels: list[int]) -> DataFrame:
    """A row per leaf and level, with the ancestor there and in the level before."""
    rows = ", ".join(f"named_struct('level', {l}, 'cell', {_up(l)}, 'parent', {_up(levels[max(0, i - 1)])})" for i, l in enumerate(levels))
    return leaves.withColumn("at", F.expr(f"explode(array({rows}))"))


def dual_tree_join(left: DataFrame, right: DataFrame, sets: list[tuple[str, str]], once: bool = False) -> DataFrame:
    """Pairs (lset, lid, rset, rid) at most left.r + right.r metres apart, for each pair of sets named.

    Both sides have (set STRING, id BIGINT, lon, lat, r DOUBLE). once: no id occurs twice in a set, so that no pair can.
    """
    spark = left.sparkSession
    columns = ["set", "id", "lon", "lat", "r"]
    # one forest for both sides; a set is named by its side, too
    both = _vectors(left.select(F.concat(F.lit("l"), "set").alias("set"), *columns[1:]).unionAll(right.select(F.concat(F.lit("r"), "set").alias("set"), *columns[1:])))
    leaves, full = _leaves(both)
    leaves = cut(leaves)
    starts = [l for l in LEVELS if 8 <= l <= COARSE]
    # a row per set: about how many nodes it has on every level
    told = leaves.groupBy("set").agg(F.max(F.col("leaf") >= FINE).alias("fine"), *(F.expr(f"approx_count_distinct({_up(l)}) as n{l}") for l in starts)).collect()
    size = {r["set"]: r for r in told}
    wanted = [(f"l{a}", f"r{b}") for a, b in sets if f"l{a}" in size and f"r{b}" in size]
    met = lambda level: sum(size[a][f"n{level}"] * size[b][f"n{level}"] for a, b in wanted)
    heads = lambda level: sum(size[b][f"n{level}"] for b in {b for _, b in wanted})
    start = max((l for l in starts if met(l) <= ROOTS and heads(l) <= HEADS), default=0)
    levels = [l for l in LEVELS if l >= start and (l <= COARSE or any(r["fine"] for r in told))]
    last = levels[-1]
    below = _pyramid(leaves.select("set", "coarse", "leaf", F.col("n").alias("leaf_n")), levels).select("set", "at.level", "at.cell", "leaf", "leaf_n")
    nodes = _pyramid(leaves, levels).groupBy("set", "at.level", "at.cell", "at.parent").agg(*_boxes(True))
    ball = f"sqrt({' + '.join(f'({c}1 - {c}0) * ({c}1 - {c}0)' for c in 'xyz')}) / 2 as ball"
    nodes = cut(nodes.selectExpr("set", "level", "cell", "parent", "n", "r0", "r1", *(f"({c}0 + {c}1) / 2 as {c}" for c in "xyz"), ball))

    def side(s: str, level: int) -> DataFrame:
        return nodes.where(f"level = {level}").selectExpr(*(f"{c} as {s}_{c}" for c in nodes.columns if c != "level"))

    def judged(pairs: DataFrame, level: int) -> DataFrame:
        # short enough to be compiled: a ball around each box, which bounds the distance as safely
        apart = f"sqrt({' + '.join(f'(l_{c} - r_{c}) * (l_{c} - r_{c})' for c in 'xyz')})"
        # an arc is no shorter than its chord, so it may stand for it where too much does no harm, and is cheaper
        own = pairs.where(f"sure or {apart} - l_ball - r_ball <= (l_r1 + r_r1) * {(1 + 1e-9) / EARTH_M} + 1e-12")
        within = f"({apart} + l_ball + r_ball <= (l_r0 + r_r0) / {EARTH_M} and {apart} + l_ball + r_ball <= {chord('l_r0 + r_r0')} * (1 - 1e-9) - 1e-12)"
        return own.selectExpr("l_set", "l_cell", "l_n", "r_set", "r_cell", "r_n", f"if(sure, level, {level}) as level", f"sure or {within} as sure")

    def away(s: str, where: str) -> str:
        """The key of a node, or where it is to meet nothing a negative one, spread like the others."""
        return f"if({where}, -1 - pmod(xxhash64(l_cell, r_cell), {1 << 31}L), {s}_cell)"

    asked = F.broadcast(spark.createDataFrame(wanted, "l_set string, r_set string"))
    pairs = side("l", start).join(asked, "l_set").join(F.broadcast(side("r", start)), "r_set")  # bounded by ROOTS and HEADS, or a single root per set
    pairs = judged(pairs.withColumns({"sure": F.lit(False), "level": F.lit(start)}), start)
    for level in levels[1:]:
        for s, o in ("lr", "rl"):
            kept = [f"{o}_{c}" for c in pairs.columns for c in [c[2:]] if f"{o}_{c}" in pairs.columns]
            old = pairs.selectExpr("level", "sure", f"{s}_set", f"{s}_cell as old", f"{s}_n as old_n", f"{away(s, 'sure')} as {s}_parent", *dict.fromkeys(kept))
            joined = old.join(side(s, level), [f"{s}_set", f"{s}_parent"], "left")
            box = [f"{s}_{c}" for c in ("r0", "r1", "x", "y", "z", "ball")]
            pairs = joined.selectExpr("level", "sure", f"{s}_set", f"coalesce({s}_cell, old) as {s}_cell", f"coalesce({s}_n, old_n) as {s}_n", *box, *dict.fromkeys(kept))
        pairs = cut(judged(pairs, level))  # also keeps the compiled code of a level small enough for the machine to optimise
    # accepted nodes are replaced by the leaves below them, at once
    for s in "lr":
        low = below.where(f"level < {last}").selectExpr(f"set as {s}_set", "level as low", f"cell as {s}_at", f"leaf as {s}_leaf", f"leaf_n as {s}_size")
        pairs = pairs.selectExpr("*", f"{away(s, f'not sure or level = {last}')} as {s}_at", "level as low").join(low, [f"{s}_set", "low", f"{s}_at"], "left").drop("low")
    parts = lambda s: f"explode(sequence(0, cast(ceil(coalesce({s}_size, {s}_n) / {FULL}) as int) - 1)) as {s}salt"
    pairs = pairs.selectExpr("l_set as lset", "coalesce(l_leaf, l_cell) as lleaf", "r_set as rset", "coalesce(r_leaf, r_cell) as rleaf", "sure", parts("l"), "r_size", "r_n")
    pairs = pairs.selectExpr("lset", "lleaf", "lsalt", "rset", "rleaf", parts("r"), "sure")

    hot = measured(leaves.where(f"n > {FULL}").selectExpr("set", "leaf", f"ceil(n / {FULL}) as salts"))
    points = both.withColumn("coarse", _key(COARSE)).join(full.withColumn("fine", F.lit(True)), ["set", "coarse"], "left")
    points = points.withColumn("leaf", F.when(F.col("fine"), _key(BITS) + FINE).otherwise(F.col("coarse"))).join(hot, ["set", "leaf"], "left")
    points = points.selectExpr("set", "id", "x", "y", "z", "r", "leaf", "cast(pmod(xxhash64(id), coalesce(salts, 1L)) as int) as salt")
    ends = {s: points.where(F.col("set").startswith(s)).toDF(*(f"{s}{c}" for c in points.columns)) for s in "lr"}
    # the smaller product first: nodes near a leaf, then each point once
    refs = pairs.join(ends["r"], ["rset", "rleaf", "rsalt"]).select("lset", "lleaf", "lsalt", "sure", "rset", "rid", "rx", "ry", "rz", "rr")
    met = ends["l"].join(refs, ["lset", "lleaf", "lsalt"])
    off = " + ".join(f"(l{c} - r{c}) * (l{c} - r{c})" for c in "xyz")
    close = f"{off} <= (lr + rr) * (lr + rr) * {(1 + 1e-9) / EARTH_M**2} and {off} <= {chord('lr + rr')} * {chord('lr + rr')}"
    out = met.where(f"sure or ({close})").selectExpr("substring(lset, 2) as lset", "lid", "substring(rset, 2) as rset", "rid")
    return out if once else out.distinct()
