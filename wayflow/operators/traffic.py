"""Traffic: what a set of routes does to the delays of the edges.

``simulate`` is exact and sequential within a run (an entry's delay depends on all that happened before); runs are the parallel axis.
``simulate_by_rounds`` reaches the same schedules of the canonical order with joins and windows only: every round settles at least the next event.
A trip that arrives stays counted on its last edge unless ``release_last_edge``.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayflow.model import TRAJECTORY, TrafficOptions
from wayflow.operators import timeline
from wayflow.session import cut


class KaryHeap:
    """A plain k-ary min-heap on time alone: which of several equal times comes first follows from its shape."""

    def __init__(self, width: int = 16):
        self.width, self.items = width, []

    def push(self, item: tuple[int, int]) -> None:
        items, i = self.items, len(self.items)
        items.append(item)
        while i and items[(up := (i - 1) // self.width)][0] > items[i][0]:
            items[up], items[i] = items[i], items[up]
            i = up

    def pop(self) -> tuple[int, int]:
        items = self.items
        top, last = items[0], items.pop()
        if items:
            items[0], i = last, 0
            while (first := i * self.width + 1) < len(items):
                down = min(range(first, min(first + self.width, len(items))), key=lambda k: (items[k][0], k))
                if items[down][0] >= items[i][0]:
                    break
                items[down], items[i] = items[i], items[down]
                i = down
        return top


def schedules(routes: list[list[int]], departs: list[int], fft, cap, options: TrafficOptions) -> list[list[int]]:
    """Times at which each trip enters its edges and, last, arrives; routes hold positions into fft and cap. Trips without a route get none."""
    out: list[list[int]] = [[] for _ in routes]
    flow: dict[int, int] = {}
    live = [k for k, r in enumerate(routes) if r]
    if options.tie_order == "heap16":
        heap = KaryHeap()
        for k in live:
            heap.push((departs[k], k))
        push, pop, left = heap.push, heap.pop, heap.items
    else:
        left = [(departs[k], k) for k in live]
        heapq.heapify(left)
        push, pop = (lambda item: heapq.heappush(left, item)), (lambda: heapq.heappop(left))
    delay = options.delay
    while left:
        now, k = pop()
        route, times = routes[k], out[k]
        times.append(now)
        at = len(times) - 1
        if at == len(route):
            if options.release_last_edge:
                flow[route[-1]] -= 1
            continue
        if at:
            flow[route[at - 1]] -= 1
        e = route[at]
        on = flow.get(e, 0)
        flow[e] = on + 1
        push((now + delay(int(fft[e]), int(cap[e]), on), k))
    return out


def simulate(routes: DataFrame, edges: DataFrame, options: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Trajectories of every run. routes: run_id, trip_id, depart, edges."""
    from wayflow.operators.paths import _shared

    net = _shared(edges)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own = net.value
        group = group.sort_values("trip_id")
        paths = [[own.index[e] for e in p] for p in group.edges]
        times = schedules(paths, group.depart.tolist(), own.fft, own.cap, options)
        rows = [
            (r, trip, i, int(own.edge_id[e]), t[i], t[i + 1], i == len(p) - 1)
            for r, trip, p, t in zip(group.run_id, group.trip_id, paths, times, strict=True)
            for i, e in enumerate(p)
        ]
        return pd.DataFrame(rows, columns=["run_id", "trip_id", "pos", "edge_id", "enter", "exit", "last"])

    return routes.groupBy("run_id").applyInPandas(run, TRAJECTORY)


def simulate_by_rounds(routes: DataFrame, edges: DataFrame, options: TrafficOptions = TrafficOptions(), rounds: int = 60) -> DataFrame:
    """The canonical schedules as a fixed point of set operations; edges need a free-flow time of at least 1."""
    by_trip = Window.partitionBy("run_id", "trip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = routes.select("run_id", "trip_id", "depart", F.size("edges").alias("n"), F.posexplode("edges").alias("pos", "edge_id"))
    steps = steps.join(edges.select("edge_id", "fft", "cap"), "edge_id").withColumn("delay", F.col("fft"))

    def timed(rows: DataFrame) -> DataFrame:
        enter = F.col("depart") + F.coalesce(F.sum("delay").over(by_trip), F.lit(0))
        return rows.withColumn("enter", enter).withColumn("exit", F.col("enter") + F.col("delay"))

    now = cut(timed(steps))
    for _ in range(rounds):
        kept = F.lit(True) if options.release_last_edge else F.col("pos") < F.col("n") - 1
        ins = now.select("run_id", "edge_id", F.col("enter").alias("t"), "trip_id", "pos", F.lit(1).alias("d"))
        outs = now.where(kept).select("run_id", "edge_id", F.col("exit").alias("t"), "trip_id", F.lit(-1).alias("pos"), F.lit(-1).alias("d"))
        before = Window.partitionBy("run_id", "edge_id").orderBy("t", "trip_id", "d").rowsBetween(Window.unboundedPreceding, -1)
        seen = ins.unionAll(outs).withColumn("flow", F.coalesce(F.sum("d").over(before), F.lit(0))).where("d = 1")
        new = now.drop("enter", "exit").join(seen.select("run_id", "trip_id", "pos", "flow"), ["run_id", "trip_id", "pos"])
        new = new.withColumnsRenamed({"delay": "old"}).withColumn("delay", options.column("fft", "cap", "flow")).drop("flow")
        new = cut(timed(new))
        if new.where("delay <> old").isEmpty():
            return new.select("run_id", "trip_id", "pos", "edge_id", "enter", "exit", (F.col("pos") == F.col("n") - 1).alias("last"))
        now = new.drop("old")
    raise RuntimeError(f"schedules still change after {rounds} rounds")


def profile(trajectories: DataFrame, keys: list[str] | None = None, release_last_edge: bool = False) -> DataFrame:
    """keys, time, flow, is_entry per edge: equal times are one record."""
    return timeline.occupancy(trajectories, keys or ["run_id", "edge_id"], final=None if release_last_edge else "last")


def totals(trajectories: DataFrame, free: DataFrame) -> DataFrame:
    """Congestion per run: trips, span, free-flow and evaluated travel time, their difference and ratio. free: run_id, trip_id, depart, tt, edges."""
    spent = trajectories.groupBy("run_id", "trip_id").agg(F.sum(F.col("exit") - F.col("enter")).alias("spent"))
    rows = free.join(spent, ["run_id", "trip_id"], "left")
    found = F.size("edges") > 0
    out = rows.groupBy("run_id").agg(
        F.count("*").alias("query_count"), F.min("depart").alias("min_departure"), F.max("depart").alias("max_departure"),
        F.count_if(found).alias("reachable_count"), F.count_if(~found).alias("unreachable_count"),
        F.sum("tt").alias("free_flow_ttt"), F.coalesce(F.sum("spent"), F.lit(0)).alias("evaluated_ttt"),
    )
    return out.withColumns({
        "departure_span_sec": F.col("max_departure") - F.col("min_departure"),
        "congestion_extra_ttt": F.col("evaluated_ttt") - F.col("free_flow_ttt"),
        "inflation_ratio": F.round(F.col("evaluated_ttt") / F.nullif(F.col("free_flow_ttt"), F.lit(0)), 6),
        "avg_free_flow_tt": F.round(F.col("free_flow_ttt") / F.nullif(F.col("reachable_count"), F.lit(0)), 6),
        "avg_evaluated_tt": F.round(F.col("evaluated_ttt") / F.nullif(F.col("reachable_count"), F.lit(0)), 6),
    })


def bucketed(trajectories: DataFrame, step: int, keys: list[str] | None = None) -> DataFrame:
    """Stays per edge and time bucket."""
    from wayflow.functions.scalar import buckets

    keys = keys or ["run_id", "edge_id"]
    return trajectories.select(*keys, F.explode(buckets("enter", "exit", step)).alias("bucket")).groupBy(*keys, "bucket").agg(F.count("*").alias("flow"))


def vertex_flow(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """node, kind, flow: the flow of the edges that leave a node (kind 0) and that reach it (kind 1)."""
    own = flows.groupBy("edge_id").agg(F.sum("flow").alias("flow")).join(edges.select("edge_id", "src", "dst"), "edge_id")
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).cast("bigint").alias("kind")), F.struct(F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("kind"))))
    return own.select(ends.alias("end"), "flow").groupBy("end.node", "end.kind").agg(F.sum("flow").alias("flow"))


def free_flow_schedule(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """Trajectories as they would be on empty roads."""
    steps = routes.select("run_id", "trip_id", "depart", F.size("edges").alias("n"), F.posexplode("edges").alias("pos", "edge_id")).join(edges.select("edge_id", "fft"), "edge_id")
    w = Window.partitionBy("run_id", "trip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("enter", F.col("depart") + F.coalesce(F.sum("fft").over(w), F.lit(0)))
    return steps.select("run_id", "trip_id", "pos", "edge_id", "enter", (F.col("enter") + F.col("fft")).alias("exit"), (F.col("pos") == F.col("n") - 1).alias("last"))


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Routes of ``new`` take the place of those with the same run and trip."""
    return old.join(new, ["run_id", "trip_id"], "left_anti").unionByName(new)
