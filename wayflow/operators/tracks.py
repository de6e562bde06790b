"""Trips and stops from location pings.

The pings are range-partitioned by (taxi, hour) and sorted by (taxi, time), so that a taxi with a third of all pings spreads over many tasks like any
other. Where two successive pings are over 1800 s or over twice the stop radius apart no stop reaches across; where that falls on a change of taxi, a gap
or a change of the hour a track may be cut. Each task works on what lies between its first and last such cut; the pings before the first and after
the last, a few hours of one taxi per task, are joined with those of the neighbouring tasks and worked on by the same code, one group per boundary.
What a trip needs from another task (its outermost stops, gaps and path lengths) is a handful of rows per task, joined by a window.

Time-synchronised Douglas-Peucker simplification keeps, within each hour of a gap session, the pings that matter at a tolerance; all hours of a task are
simplified together, level by level. The first and last ping of an hour are always kept, which ties the result to the data and not to the tasks. Slow
stretches of the simplified track, where it moves on by little over the shortest stay (the tolerance makes this bound safe), form the stops: each begins
at the first ping of a stretch that holds one, and its exact extent is then refined on the pings. The segments that remain define the trips: they run
from stop to stop, and their distance is the length of the simplified track.

Defined results: pings without taxi, time or plausible coordinates are ignored; equal pings count once; several places at one time are
ordered by longitude, then latitude; no pings give no rows; results don't depend on the number of partitions. One dwell that never moves by over 200 m
between pings nor falls silent, over several whole partitions, is measured in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayflow.session import cut

EARTH_M = 6371008.8
STAY_M, STAY_S, GAP_S, FAST_KMH = 100.0, 300, 1800, 250.0
TOLERANCE_M, HOUR_US = 30.0, 3_600_000_000
GAP, PATH, STOP = 0, 1, 2
COLUMNS = ["kind", "side", "pid", "taxi", "t0", "t1", "lon0", "lat0", "lon1", "lat1", "metres", "own"]
SCHEMA = "kind string, side int, pid int, taxi string, t0 bigint, t1 bigint, lon0 double, lat0 double, lon1 double, lat1 double, metres double, own boolean"


def haversine(lon1, lat1, lon2, lat2):
    p, q = np.radians(lat1), np.radians(lat2)
    h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin((np.radians(lon2) - np.radians(lon1)) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1, h)))


def clean(pings: DataFrame) -> DataFrame:
    """taxi, t (microseconds), lon, lat of the usable pings."""
    taxi = F.upper(F.regexp_replace("taxi_id", r"^\s+|\s+$", ""))
    return pings.where((taxi != "") & F.col("timestamp").isNotNull() & F.col("lon").between(115, 118) & F.col("lat").between(38.5, 41.5)).select(
        taxi.alias("taxi"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("t"), "lon", "lat"
    )


def strays(taxi: np.ndarray, t: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    n = len(t)

    def fast(gap: int) -> np.ndarray:
        """Whether ping i and ping i + gap are over FAST_KMH apart; False where they are not of one taxi."""
        out = np.zeros(n, bool)
        if n > gap:
            d, s = haversine(lon[:-gap], lat[:-gap], lon[gap:], lat[gap:]), (t[gap:] - t[:-gap]) / 1e6
            out[: n - gap] = (d * 3.6 > FAST_KMH * s) & (taxi[:-gap] == taxi[gap:])
        return out

    one, two, three = fast(1), fast(2), fast(3)
    drop = np.zeros(n, bool)
    if n > 2:
        ok = (taxi[:-2] == taxi[2:]) & one[:-2] & one[1:-1] & ~two[:-2]
        drop[1:-1] |= ok
    if n > 3:
        ok = (taxi[:-3] == taxi[3:]) & one[:-3] & one[2:-1] & ~three[:-3]
        drop[1:-2] |= ok
        drop[2:-1] |= ok
    return drop


def simplify(t: np.ndarray, x: np.ndarray, y: np.ndarray, unit: np.ndarray, tolerance: float = TOLERANCE_M) -> np.ndarray:
    """Mask of the vertices that time-synchronised Douglas-Peucker keeps in each unit (equal numbers stand together); all units are split at once, level by level."""
    n = len(t)
    keep = np.ones(n, bool)
    if n > 2:
        keep[1:-1] = (unit[1:-1] != unit[:-2]) | (unit[1:-1] != unit[2:])
    open_ = np.flatnonzero(~keep)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(keep, at, 0))[open_]
    after = np.minimum.accumulate(np.where(keep, at, n)[::-1])[::-1][open_]
    while len(open_):
        s = (t[open_] - t[before]) / np.maximum(t[after] - t[before], 1e-9)
        off = (x[open_] - x[before] - s * (x[after] - x[before])) ** 2 + (y[open_] - y[before] - s * (y[after] - y[before])) ** 2
        first = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        size = np.diff(np.append(first, len(open_)))
        most = np.maximum.reduceat(off, first)
        split = np.repeat(most > tolerance * tolerance, size)
        hit = np.flatnonzero(split & (off == np.repeat(most, size)))
        hit = hit[np.concatenate([[True], before[hit][1:] != before[hit][:-1]])] if len(hit) else hit  # the first of equal ones
        keep[open_[hit]] = True
        mid = np.repeat(np.where(most > tolerance * tolerance, 0, -1), size)
        mid[split] = np.repeat(open_[hit], size[most > tolerance * tolerance])
        left = split & (open_ != mid)
        before = np.where(open_ > mid, mid, before)[left]
        after = np.where(open_ < mid, mid, after)[left]
        open_ = open_[left]
    return keep


def events(taxi: np.ndarray, t: np.ndarray, lon: np.ndarray, lat: np.ndarray, start: int, stop: int) -> list[tuple]:
    """Gaps, path lengths and stops in order, of the pings start..stop of a sequence without strays; the hop into a ping belongs to it."""
    if stop <= start:
        return []
    gap, into = True, 0.0
    if start and taxi[start] == taxi[start - 1] and t[start] - t[start - 1] <= GAP_S * 1_000_000:
        gap, into = False, float(haversine(lon[start - 1], lat[start - 1], lon[start], lat[start]))
    taxi, t, lon, lat = (v[start:stop] for v in (taxi, t, lon, lat))
    n = len(t)
    gaps, hours, hop = np.full(n, gap), np.zeros(n, bool), np.zeros(n)
    gaps[1:] = (taxi[1:] != taxi[:-1]) | (t[1:] - t[:-1] > GAP_S * 1_000_000)
    hours[1:] = t[1:] // HOUR_US != t[:-1] // HOUR_US
    hop[1:] = haversine(lon[:-1], lat[:-1], lon[1:], lat[1:])
    unit, piece = np.cumsum(gaps | hours), np.cumsum(gaps | (hop > 2 * STAY_M))
    sec = (t - t[0]) / 1e6
    head = np.maximum.accumulate(np.where(np.concatenate([[True], unit[1:] != unit[:-1]]), np.arange(n), 0))
    x = np.radians(lon) * EARTH_M * np.cos(np.radians(lat[head]))
    y = np.radians(lat) * EARTH_M
    keep = simplify(sec, x, y, unit)
    at = np.flatnonzero(keep)
    a = at[np.searchsorted(at, np.arange(n), "right") - 1]
    b = at[np.searchsorted(at, np.arange(n))]
    share = (sec - sec[a]) / np.maximum(sec[b] - sec[a], 1e-9)
    slon, slat = lon[a] + share * (lon[b] - lon[a]), lat[a] + share * (lat[b] - lat[a])
    # the first ping from which a stay would be long enough; taxis follow one another, so time is made to grow across them
    clock = t + np.cumsum(np.concatenate([[False], taxi[1:] != taxi[:-1]])) * (int(t.max()) - int(t.min()) + 2 * STAY_S * 1_000_000)
    later = np.searchsorted(clock, clock + STAY_S * 1_000_000)
    inside = np.minimum(later, n - 1)
    slow = (later < n) & (piece[inside] == piece) & (haversine(slon, slat, slon[inside], slat[inside]) <= (STAY_M + 2 * TOLERANCE_M) * 1.1)
    # of the slow stretches, the pings whose stay is not over before it is long enough
    starts = np.flatnonzero(slow)
    starts = starts[haversine(lon[starts], lat[starts], lon[inside[starts]], lat[inside[starts]]) <= STAY_M]
    stops = []
    i = k = 0
    while (k := k + int(np.searchsorted(starts[k:], i))) < len(starts):
        i = int(starts[k])
        last, step = i, 32
        end = int(np.searchsorted(piece, piece[i], "right"))
        while last + 1 < end:
            upto = min(end, last + 1 + step)
            far = haversine(lon[i], lat[i], lon[last + 1 : upto], lat[last + 1 : upto]) > STAY_M
            if far.any():
                last += int(far.argmax())
                break
            last, step = upto - 1, step * 2
        if t[last] - t[i] >= STAY_S * 1_000_000:
            stops.append((i, last))
            keep[i] = keep[last] = True
            i = last + 1
        else:
            i += 1
    at = np.flatnonzero(keep)
    length = np.zeros(n)
    length[at[1:]] = np.where(gaps[at[1:]], 0.0, haversine(lon[at[:-1]], lat[at[:-1]], lon[at[1:]], lat[at[1:]]))
    cum = np.cumsum(length) + into
    out, s = [], 0
    bounds = np.unique([0, *np.flatnonzero(gaps), n])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        who = taxi[a]
        if gaps[a]:
            out.append((GAP, who, t[a], t[a], lon[a], lat[a], lon[a], lat[a], 0.0))
        done = cum[a] if gaps[a] else 0.0
        while s < len(stops) and stops[s][0] < b:
            i, k = stops[s]
            out.append((PATH, who, t[a], t[i], lon[a], lat[a], lon[i], lat[i], cum[i] - done))
            out.append((STOP, who, t[i], t[k], lon[i], lat[i], lon[k], lat[k], 0.0))
            done, s = cum[k], s + 1
        out.append((PATH, who, t[a], t[b - 1], lon[a], lat[a], lon[b - 1], lat[b - 1], cum[b - 1] - done))
    return out


def paired(found: list[tuple], pid: int) -> list[tuple]:
    """Stops, the trips between them that are settled here, and the outermost events, from which the other trips follow."""
    out, last, metres = [], None, 0.0
    stops = [k for k, e in enumerate(found) if e[0] == STOP]
    for e in found:
        if e[0] == GAP:
            last = None
        elif e[0] == PATH:
            metres += e[8]
        else:
            out.append(("stop", None, pid, *e[1:9], None))
            if last:
                out.append(("trip", None, pid, e[1], last[3], e[2], last[6], last[7], e[4], e[5], metres, None))
            last, metres = e, 0.0
    first, final = (stops[0], stops[-1]) if stops else (len(found) - 1, 0)
    gaps = [k for k, e in enumerate(found) if e[0] == GAP]
    head = found[: min(first, gaps[0] if gaps else len(found)) + 1]
    tail_from = max(final if stops else -1, gaps[-1] if gaps else -1)
    tail = found[max(tail_from, 0) :]
    if not stops and not gaps:  # passed through
        head, tail = found, []
    elif tail_from == len(head) - 1:  # one event ends the head and begins the tail
        tail = tail[1:]
    elif tail:
        e = tail[0]
        out.append(("open", GAP, pid, e[1], e[2], e[2], e[4], e[5], e[4], e[5], 0.0, None))
    for e in head + tail:
        out.append(("open", e[0], pid, *e[1:9], None))
    return out


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    if not rows:
        return pa.RecordBatch.from_pylist([], schema=ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)


ARROW = pa.schema(
    [("kind", pa.string()), ("side", pa.int32()), ("pid", pa.int32()), ("taxi", pa.string()), ("t0", pa.int64()), ("t1", pa.int64())]
    + [(c, pa.float64()) for c in ("lon0", "lat0", "lon1", "lat1", "metres")]
    + [("own", pa.bool_())]
)


def _partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted range of pings: its inner part as events, its ends as raw pings (side 0 before, 1 after the inner part, 2 all)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    data = pa.Table.from_batches(got)
    pid = data.column("pid")[0].as_py()
    names = data.column("taxi").combine_chunks().dictionary_encode()
    words = np.array(names.dictionary.to_pylist(), object)
    code = names.indices.to_numpy()
    t, lon, lat = (data.column(c).to_numpy() for c in ("t", "lon", "lat"))
    same = np.zeros(len(t), bool)
    same[1:] = (code[1:] == code[:-1]) & (t[1:] == t[:-1]) & (lon[1:] == lon[:-1]) & (lat[1:] == lat[:-1])
    code, t, lon, lat = (x[~same] for x in (code, t, lon, lat))
    n = len(t)
    left = np.flatnonzero(~strays(code, t, lon, lat))
    a, b = left[:-1], left[1:]
    away = (haversine(lon[a], lat[a], lon[b], lat[b]) > 2 * STAY_M) & (t[a] // HOUR_US != t[b] // HOUR_US)
    safe = (code[a] != code[b]) | (t[b] - t[a] > GAP_S * 1_000_000) | away
    safe &= (a >= 2) & (b <= n - 3)  # what is stray at the very ends shows only with the neighbours
    cuts = np.flatnonzero(safe) + 1  # positions in left

    def raw(lo: int, hi: int, own_lo: int, own_hi: int, side: int) -> pa.RecordBatch:
        k = np.arange(max(lo, 0), min(hi, n))
        of = lambda v: pa.array(v[k])
        fixed = [pa.array(np.full(len(k), v), kind) for v, kind in ((side, pa.int32()), (pid, pa.int32()))]
        own = pa.array((own_lo <= k) & (k < own_hi))
        names = pa.array(words[code[k]], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(["raw"] * len(k), pa.string()), *fixed, names, of(t), of(t), of(lon), of(lat), of(lon), of(lat), pa.array(np.zeros(len(k))), own], schema=ARROW)

    rows = [("sum", int(len(cuts) > 0), pid, None, None, None, None, None, None, None, None, None)]
    if not len(cuts):
        yield raw(0, n, 0, n, 2)
    else:
        first, last = left[cuts[0]], left[cuts[-1]]
        found = events(*(x[left] for x in (code, t, lon, lat)), int(cuts[0]), int(cuts[-1]))
        rows += paired([(e[0], words[e[1]], *e[2:]) for e in found], pid)
        yield raw(0, first + 2, 0, first, 0)
        yield raw(min(left[cuts[-1] - 1], last - 2), n, last, n, 1)
    yield _frame(rows)


def _boundary(key: tuple, raw: pd.DataFrame) -> pd.DataFrame:
    raw = raw.sort_values(["pid", "side", "taxi", "t0", "lon0", "lat0"], kind="stable")
    # context repeats pings that the other side owns; an own ping comes before its copy
    raw = raw.sort_values(["taxi", "t0", "lon0", "lat0", "own"], ascending=[True, True, True, True, False], kind="stable")
    raw = raw.drop_duplicates(["taxi", "t0", "lon0", "lat0"])
    code, words = pd.factorize(raw.taxi)
    t, lon, lat, own = (raw[c].to_numpy() for c in ("t0", "lon0", "lat0", "own"))
    left = np.flatnonzero(~strays(code, t, lon, lat))
    mine = np.flatnonzero(own[left].astype(bool))
    if not len(mine):
        return pd.DataFrame(columns=COLUMNS)
    found = events(*(x[left] for x in (code, t, lon, lat)), int(mine[0]), int(mine[-1]) + 1)
    return pd.DataFrame(paired([(e[0], words[e[1]], *e[2:]) for e in found], int(key[0])), columns=COLUMNS)


def trips_and_stops(pings: DataFrame) -> DataFrame:
    """taxi_id, kind ('stop' or 'trip'), start_us, end_us, duration_sec, metres, and the places where each starts and ends."""
    spark = pings.sparkSession
    hour = F.floor(F.col("t") / HOUR_US).alias("hour")
    ordered = clean(pings).select("*", hour).repartitionByRange("taxi", "hour").sortWithinPartitions("taxi", "t", "lon", "lat").drop("hour")
    worked = cut(ordered.withColumn("pid", F.spark_partition_id()).mapInArrow(_partition, SCHEMA))
    # one row per task of the step above: which tasks were cut, hence to which boundary their ends belong
    cuts = dict(worked.where("kind = 'sum'").select("pid", "side").collect())
    before, group = -1, []
    for pid in sorted(cuts):
        group += [(pid, 0, before), (pid, 2, before), (pid, 1, pid)]
        before = pid if cuts[pid] else before
    groups = spark.createDataFrame(group or [(-1, 0, -1)], "pid int, side int, boundary int")
    edges = worked.where("kind = 'raw'").join(F.broadcast(groups), ["pid", "side"]).groupBy("boundary").applyInPandas(_boundary, SCHEMA)
    every = worked.where("kind in ('stop', 'trip', 'open')").unionByName(cut(edges))
    w = Window.partitionBy("taxi").orderBy("at", "side", "t1")
    opened = every.where("kind = 'open'").withColumn("at", F.when(F.col("side") == STOP, F.col("t0")).otherwise(F.col("t1")))
    opened = opened.withColumns({"gaps": F.count(F.when(F.col("side") == GAP, 1)).over(w), "run": F.sum("metres").over(w)}).where(F.col("side") == STOP)
    before = {c: F.lag(c).over(w).alias(f"p_{c}") for c in ("t1", "lon1", "lat1", "gaps", "run")}
    across = opened.select("*", *before.values()).where("p_gaps = gaps")
    across = across.selectExpr("taxi", "'trip' as kind", "p_t1 as t0", "t0 as t1", "p_lon1 as lon0", "p_lat1 as lat0", "lon0 as lon1", "lat0 as lat1", "run - p_run as metres")
    settled = every.where("kind != 'open'").select("taxi", "kind", "t0", "t1", "lon0", "lat0", "lon1", "lat1", "metres")
    return settled.unionByName(across).select(
        F.col("taxi").alias("taxi_id"), "kind", F.col("t0").alias("start_us"), F.col("t1").alias("end_us"), ((F.col("t1") - F.col("t0")) / 1e6).alias("duration_sec"),
        "metres", F.col("lon0").alias("start_lon"), F.col("lat0").alias("start_lat"), F.col("lon1").alias("end_lon"), F.col("lat1").alias("end_lat"),
    )
