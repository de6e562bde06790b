"""New routes for selected trips against the flows of a traffic result.

A batch's trips all see the same flows and prices; between batches they join the dependency graph and the prices are renewed. Batches of a run
follow one another, so a run of several is one task and runs are the parallel axis; the trips of a single batch are spread over tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from math import floor, log1p

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflow.functions import scalar
from wayflow.model import AlgorithmOptions, TrafficOptions
from wayflow.operators.live import Live
from wayflow.operators.paths import Network, _shared
from wayflow.session import fresh

ROUTE = "run_id bigint, trip_id int, depart bigint, edges array<int>"


class Timelines:
    """Flow and price of the nodes of each edge (by position in the network), in order of time."""

    def __init__(self, net: Network, rows: pd.DataFrame, traffic: TrafficOptions):
        rows = rows.sort_values(["edge_id", "time"])
        self.net, self.traffic = net, traffic
        self.time: dict[int, list[int]] = {}
        self.first: dict[int, int] = {}
        self.edge = [net.index[e] for e in rows.edge_id]
        self.at, self.flow = rows.time.tolist(), rows.flow.tolist()
        self.price = rows.penalty.tolist() if "penalty" in rows else [0] * len(rows)
        for k, (e, t) in enumerate(zip(self.edge, self.at, strict=True)):
            self.time.setdefault(e, []).append(t)
            self.first.setdefault(e, k)

    def delay(self, e: int, now: int) -> int:
        k = bisect_right(self.time.get(e, ()), now)
        on = self.flow[self.first[e] + k - 1] if k else 0
        return self.traffic.delay(int(self.net.fft[e]), int(self.net.cap[e]), on)

    def toll(self, e: int, start: int, end: int) -> int:
        """The largest price on the edge within start..end."""
        if e not in self.time:
            return 0
        lo, hi, f = bisect_left(self.time[e], start), bisect_right(self.time[e], end), self.first[e]
        return max(self.price[f + lo : f + hi], default=0)

    def passed(self, path: list[int], start: int) -> list[int]:
        out, now = [], start
        for e in path:
            end = now + self.delay(e, now)
            if e in self.time:
                lo, hi = bisect_left(self.time[e], now), bisect_left(self.time[e], end)
                out += range(self.first[e] + lo, self.first[e] + hi)
            now = end
        return out

    def renew(self, impact: list[int], base: list[int], options: AlgorithmOptions) -> None:
        """Prices from the flows as they now are."""
        cap, gate = self.net.cap, options.reroute_congestion_gate
        rank = lambda xs, p: sorted(xs)[p * (len(xs) - 1) // 100] if xs else 0
        clip, unit, g = rank(impact, 99), rank([max(1, b) for b in base], 90), gate / 100
        for k, (e, f) in enumerate(zip(self.edge, self.flow, strict=True)):
            share = log1p(min(impact[k], clip)) / log1p(clip) if clip > 0 else 0.0
            load = min(1.0, max(0.0, (f / max(1, int(cap[e])) - g) / (1 - g))) if 0 <= gate < 100 else 1.0
            self.price[k] = min(max(0, floor(share * unit * load + 0.5)), scalar.IMPACT_CAP)


def reroute(selected: DataFrame, priced: DataFrame, arcs: DataFrame, edges: DataFrame, options: AlgorithmOptions = AlgorithmOptions(), traffic: TrafficOptions = TrafficOptions(), priced_paths: bool = True, one_batch: bool = False) -> DataFrame:
    """selected: run_id, trip_id, origin, destination, depart, batch; priced: nodes with flow and penalty. Unreachable trips get an empty route.

    After each batch its trips join the graph, and the prices are renewed. one_batch: all trips are of one batch, and are spread over tasks.
    """
    net = _shared(edges)
    weight = options.impact_weight if priced_paths else 0
    # same-edge arcs follow from the flows; only those along trips are told
    links = arcs.where("kind = 'route'")
    rows = priced.select("run_id", "edge_id", "time", "flow", "penalty", *(F.lit(None).cast("bigint").alias(c) for c in ("dst_edge", "dst_time"))).unionAll(
        links.select("run_id", F.col("src_edge"), F.col("src_time"), F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), F.col("dst_edge").cast("bigint"), "dst_time")
    )

    def work(key: tuple, trips: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        n = net.value
        line = Timelines(n, own[own.dst_edge.isna()], traffic)
        number = {k: i for i, k in enumerate(zip(line.edge, line.at, strict=True))}
        along = own[own.dst_edge.notna()]
        ends = ((number.get((n.index[a], s)), number.get((n.index[int(b)], int(t)))) for a, s, b, t in zip(along.edge_id, along.time, along.dst_edge, along.dst_time, strict=True))
        live = Live(line.edge, line.at, line.flow, [int(n.fft[e]) for e in line.edge], [int(n.cap[e]) for e in line.edge], [(a, b) for a, b in ends if a is not None and b is not None], traffic)
        line.flow = live.flow

        def cost(e: int, now: int) -> tuple[int, int]:
            tt = line.delay(e, now)
            return tt, tt + (weight * line.toll(e, now, now + tt) // 100 if weight else 0)

        out = []
        groups = [g for _, g in trips.sort_values(["batch", "trip_id"]).groupby("batch", sort=True)]
        for k, batch in enumerate(groups):
            found = [n.timed(int(r.origin), int(r.destination), int(r.depart), cost) for r in batch.itertuples()]
            out += [(key[0], r.trip_id, r.depart, [int(n.edge_id[e]) for e in p]) for r, p in zip(batch.itertuples(), found, strict=True)]
            # what each passes is told by the flows that the whole batch saw
            for nodes in [line.passed(p, int(r.depart)) for r, p in zip(batch.itertuples(), found, strict=True)]:
                live.insert(nodes)
            if weight and k + 1 < len(groups):
                line.renew(live.impacts(options.lambda_percent), [live.delay(i) for i in range(len(live.flow))], options)
        return pd.DataFrame(out, columns=["run_id", "trip_id", "depart", "edges"])

    if not one_batch:
        return fresh(selected).groupBy("run_id").cogroup(fresh(rows).groupBy("run_id")).applyInPandas(work, ROUTE)
    # nothing follows the batch, so its trips are independent of one another: each part of them gets the timelines of its run
    parts = edges.sparkSession.sparkContext.defaultParallelism
    asked = selected.withColumn("part", F.pmod(F.xxhash64("trip_id"), F.lit(parts)).cast("int"))
    some = rows.where("dst_edge is null").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return fresh(asked).groupBy("run_id", "part").cogroup(fresh(some).groupBy("run_id", "part")).applyInPandas(lambda key, a, b: work(key, a, b) if len(a) else pd.DataFrame(columns=["run_id", "trip_id", "depart", "edges"]), ROUTE)


def reroute_plain(selected: DataFrame, profile: DataFrame, edges: DataFrame, traffic: TrafficOptions = TrafficOptions()) -> DataFrame:
    """All at once, by travel time alone, against the profile's flows. Trips are spread over tasks; the profile of a run must fit each."""
    one = selected.withColumn("batch", F.lit(0))
    priced = profile.select("run_id", "edge_id", "time", "flow").withColumn("penalty", F.lit(0).cast("bigint"))
    none = profile.limit(0).select("run_id", F.col("edge_id").alias("src_edge"), F.col("time").alias("src_time"), F.col("edge_id").alias("dst_edge"), F.col("time").alias("dst_time"), F.lit("route").alias("kind"))
    return reroute(one, priced, none, edges, AlgorithmOptions(impact_weight=0), traffic, False, True)


def reroute_slots(selected: DataFrame, slots: DataFrame, impacts: DataFrame, edges: DataFrame, width: int, weight: int = 15) -> DataFrame:
    """Cost of an edge: free flow plus weight percent of the impact of the slots its passage touches, which also counts as time. Unreachable trips are left out."""
    net = _shared(edges)

    def work(key: tuple, trips: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        n = net.value
        impact = {(n.index[e], s): v for e, s, v in zip(own.edge_id, own.slot, own.impact, strict=True)}
        slot = lambda t: 0 if t <= 0 else t // width

        def cost(e: int, now: int) -> tuple[int, int]:
            tt = int(n.fft[e])
            total = min(sum(impact.get((e, s), 0) for s in range(slot(now), slot(now + max(tt, 1) - 1) + 1)), scalar.IMPACT_CAP)
            tt += (2 * weight * total + 100) // 200
            return tt, tt

        rows = [(key[0], r.trip_id, r.depart, [int(n.edge_id[e]) for e in n.timed(int(r.origin), int(r.destination), int(r.depart), cost)]) for r in trips.itertuples()]
        return pd.DataFrame([r for r in rows if r[3]], columns=["run_id", "trip_id", "depart", "edges"])

    return fresh(selected).groupBy("run_id").cogroup(fresh(impacts).groupBy("run_id")).applyInPandas(work, ROUTE)
