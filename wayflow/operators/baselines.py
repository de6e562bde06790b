"""One-shot route choosers: greedy by global time order, online by cell prices, and hub labels over flow-aware scores. A run (or a departure bucket) is one task."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right, insort
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflow.model import TrafficOptions
from wayflow.operators.paths import INF, Network, _shared
from wayflow.operators.reroute import ROUTE
from wayflow.session import fresh


#: The scale of prices is not doubled beyond this.
MOST_SCALE = 1e300


def greedy_routes(trips: DataFrame, edges: DataFrame, traffic: TrafficOptions = TrafficOptions()) -> DataFrame:
    """All trips advance edge by edge in order of (time, id); each takes the edge with the least arrival estimate (time so far, delay now, free flow from
    there) among unvisited nodes that lie nearer to its goal, else among all unvisited ones. A trip that is stuck takes the shortest way on at once, at the
    delays of the moment, and is on those edges for the others, too.
    """
    net = _shared(edges)

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        n: Network = net.value
        out_edges = n.out()
        remaining: dict[int, dict[int, int]] = {}
        state, queue, done = {}, [], {}
        for r in own.itertuples():
            d = int(r.destination)
            if d not in remaining:
                remaining[d] = n.tree(d, backward=True)[0]
            if r.origin != d and int(r.origin) in remaining[d]:
                state[r.trip_id] = (d, int(r.origin), {int(r.origin)}, [])
                queue.append((int(r.depart), r.trip_id))
            else:
                done[r.trip_id] = []
        heapq.heapify(queue)
        # times at which vehicles enter and leave each edge, in order; some of a suffix lie ahead
        entered: dict[int, list[int]] = defaultdict(list)
        exited: dict[int, list[int]] = defaultdict(list)

        def delay(e: int, now: int) -> int:
            return traffic.delay(int(n.fft[e]), int(n.cap[e]), bisect_right(entered[e], now) - bisect_right(exited[e], now))

        def ride(e: int, now: int, tt: int) -> int:
            insort(entered[e], now)
            insort(exited[e], now + tt)
            return now + tt

        while queue:
            now, k = heapq.heappop(queue)
            d, u, seen, path = state[k]
            if u == d:
                done[k] = path
                continue
            left = remaining[d]
            choices = []
            for v, e, _ in out_edges.get(u, ()):
                if v in left and v not in seen:
                    tt = delay(e, now)
                    choices.append((left[v] >= left[u], now + tt + left[v], e, v, tt))
            if not choices:
                done[k] = path + n.shortest(u, d)
                for e in done[k][len(path) :]:
                    now = ride(e, now, delay(e, now))
                continue
            _, _, e, v, tt = min(choices)
            state[k] = (d, v, seen | {v}, [*path, e])
            heapq.heappush(queue, (ride(e, now, tt), k))
        return pd.DataFrame([(key[0], r.trip_id, r.depart, [int(n.edge_id[e]) for e in done[r.trip_id]]) for r in own.itertuples()], columns=["run_id", "trip_id", "depart", "edges"])

    return trips.groupBy("run_id").applyInPandas(work, ROUTE)


class Prices:
    """What a cell (edge, time step) costs: exponential in its volume, at a scale that doubles when it proves too small."""

    def __init__(self, net: Network, step: int, horizon: int):
        self.net, self.step, self.volume = net, step, defaultdict(int)
        self.cap = np.maximum(net.cap, 1).tolist()
        self.flat = 2.0 * horizon * max(1, len(net.edge_id))
        self.scale = min((1.0 / c for c in self.cap), default=1.0)

    def cell(self, e: int, s: int) -> float:
        power = self.volume.get((e, s), 0) * math.log1p(1 / (2 * self.scale * self.cap[e]))
        return (math.exp(power) if power < 700 else math.inf) / (self.flat * self.cap[e])

    def steps(self, e: int, now: int) -> range:
        return range(now // self.step, (now + max(1, int(self.net.fft[e])) - 1) // self.step + 1)

    def edge(self, e: int, now: int) -> float:
        return sum(self.cell(e, s) for s in self.steps(e, now))

    def over(self, e: int, s: int) -> bool:
        return self.cell(e, s) > math.exp(0.5) / self.cap[e]

    def route(self, path: list[int], now: int) -> float:
        paid = 0.0
        for e in path:
            paid += self.edge(e, now)
            now += int(self.net.fft[e])
        return paid

    def ride(self, path: list[int], now: int) -> bool:
        """Raises the volumes; whether a cell then is over its bound."""
        over = False
        for e in path:
            for s in self.steps(e, now):
                self.volume[e, s] += 1
                over |= self.over(e, s)
            now += int(self.net.fft[e])
        return over


def cheapest_detour(net: Network, prices: Prices, left: dict[int, int], origin: int, destination: int, depart: int, limit: int, states: int) -> tuple[list[int], bool]:
    """Branch and bound over simple paths of at most ``limit`` seconds: the least price, then the least time. Whether the budget of states ended it."""
    lists = net.out()
    best, found, path, seen, used = (math.inf, math.inf), None, [], {origin}, 1

    def steps(u: int, now: int, spent: int, paid: float):
        out = []
        for v, e, w in lists.get(u, ()):
            if v not in seen and v in left and spent + w + left[v] <= limit and (cost := paid + prices.edge(e, now)) <= best[0]:
                out.append((cost, spent + w + left[v], e, v, spent + w))
        return iter(sorted(out))

    stack = [(steps(origin, depart, 0, 0.0), origin)]
    while stack:
        step = next(stack[-1][0], None)
        if step is None:
            _, u = stack.pop()
            if stack:
                seen.discard(u)
                path.pop()
            continue
        cost, _, e, v, spent = step
        if used >= states:
            return found, True
        used += 1
        if v == destination:
            if (cost, spent) < best:
                best, found = (cost, spent), [*path, e]
            continue
        path.append(e)
        seen.add(v)
        stack.append((steps(v, depart + spent, spent, cost), v))
    return found, False


def priced_routes(trips: DataFrame, edges: DataFrame, step: int = 60, horizon: int = 10080, detour: int = 10, states: int = 20000) -> DataFrame:
    """Trips in order of departure, each by the cheapest path that takes at most ``detour`` percent more than its shortest, where a cell (edge, step) grows
    dearer with its volume.

    The scale of prices begins at the least 1 / capacity, is kept from trip to trip, and doubles while a path costs more than it, or a cell that was filled is over
    its bound. Where the budget of states ends a search, ``exhausted`` is true: the route is the best so far, or the plain shortest one.
    """
    net = _shared(edges)

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        n: Network = net.value
        prices, pending = Prices(n, step, horizon), False
        remaining: dict[int, dict[int, int]] = {}
        out = []
        for r in own.sort_values(["depart", "trip_id"]).itertuples():
            o, d, start = int(r.origin), int(r.destination), int(r.depart)
            if d not in remaining:
                remaining[d] = n.tree(d, backward=True)[0]
            left = remaining[d]
            while pending and prices.scale < MOST_SCALE:
                prices.scale *= 2
                pending = any(prices.over(e, s) for e, s in prices.volume)
            if o == d or o not in left:
                out.append((key[0], r.trip_id, r.depart, [], False))
                continue
            while True:
                path, exhausted = cheapest_detour(n, prices, left, o, d, start, left[o] * (100 + detour) // 100, states)
                path = path or n.shortest(o, d)
                if prices.route(path, start) <= prices.scale or prices.scale >= MOST_SCALE:
                    break
                prices.scale *= 2
            pending |= prices.ride(path, start)
            out.append((key[0], r.trip_id, r.depart, [int(n.edge_id[e]) for e in path], exhausted))
        return pd.DataFrame(out, columns=["run_id", "trip_id", "depart", "edges", "exhausted"])

    return trips.groupBy("run_id").applyInPandas(work, f"{ROUTE}, exhausted boolean")


class HubLabels:
    """Hubs with distances to and from every node, pruned in an order that prefers nodes of high degree and little flow."""

    def __init__(self, net: Network, weight: list[int], vertex_flow: dict[int, int], beta: float):
        self.net, self.weight = net, weight
        ends: dict[int, int] = defaultdict(int)
        for u, v in zip(net.src.tolist(), net.dst.tolist(), strict=True):
            ends[u] += 1
            ends[v] += 1
        most, top = max(ends.values(), default=1), max(vertex_flow.values(), default=0) or 1
        score = {v: (1 - beta) * ends[v] / most + beta * (1 - vertex_flow.get(v, 0) / top) for v in ends}
        self.order = sorted(ends, key=lambda v: (-score[v], v))
        self.out: dict[int, dict[int, int]] = {v: {} for v in ends}
        self.into: dict[int, dict[int, int]] = {v: {} for v in ends}
        for hub in self.order:
            for backward in (False, True):
                self._spread(hub, backward)

    def _spread(self, hub: int, backward: bool) -> None:
        lists, own, other = self.net.out(backward), *((self.out, self.into) if backward else (self.into, self.out))
        mine = other[hub]
        dist, heap, done = {hub: 0}, [(0, hub)], set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            known = own[u]
            if any(h in mine and mine[h] + x <= d for h, x in known.items()):
                continue
            known[hub] = d
            for v, e, _ in lists.get(u, ()):
                if (x := d + self.weight[e]) < dist.get(v, INF):
                    dist[v] = x
                    heapq.heappush(heap, (x, v))

    def cost(self, a: int, b: int) -> tuple[int, int]:
        """(distance, hub), the smallest hub of equal ones."""
        x, y = self.out.get(a, {}), self.into.get(b, {})
        return min(((x[h] + y[h], h) for h in x.keys() & y.keys()), default=(INF, -1))

    def path(self, a: int, b: int) -> list[int]:
        left, route, lists = self.cost(a, b)[0], [], self.net.out()
        if left >= INF:
            return []
        while a != b:
            a, e = next((v, e) for v, e, _ in lists[a] if self.weight[e] + self.cost(v, b)[0] == left)
            left -= self.weight[e]
            route.append(e)
        return route


def label_routes(trips: DataFrame, flows: DataFrame, edges: DataFrame, step: int, alpha: int = 50, beta: float = 0.5) -> DataFrame:
    """Routes by hub labels, one index per departure bucket. flows: edge_id, bucket, flow; edge scores blend scaled distance and flow."""
    net = _shared(edges)
    rows = trips.withColumn("bucket", F.floor(F.col("depart") / step).cast("bigint"))

    def work(key: tuple, own: pd.DataFrame, load: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame(columns=["run_id", "trip_id", "depart", "edges"])
        n: Network = net.value
        flow = dict(zip(load.edge_id, load.flow, strict=True))
        on = [int(flow.get(int(e), 0)) for e in n.edge_id]
        far, most = max(1, int(n.fft.max(initial=1))), max(on, default=0)
        weight = [1 + (alpha * (int(f) * 1_000_000 // far) + (100 - alpha) * (x * 1_000_000 // most if most else 0)) // 100 for f, x in zip(n.fft, on, strict=True)]
        vertex: dict[int, int] = defaultdict(int)
        for u, v, x in zip(n.src.tolist(), n.dst.tolist(), on, strict=True):
            vertex[u] += x
            vertex[v] += x
        index = HubLabels(n, weight, vertex, beta)
        return pd.DataFrame([(r.run_id, r.trip_id, r.depart, [int(n.edge_id[e]) for e in index.path(int(r.origin), int(r.destination))]) for r in own.itertuples()], columns=["run_id", "trip_id", "depart", "edges"])

    return fresh(rows).groupBy("bucket").cogroup(fresh(flows).groupBy("bucket")).applyInPandas(work, ROUTE)


def merge_labels(out: DataFrame, into: DataFrame, pairs: DataFrame) -> DataFrame:
    """Label query as a join: pairs (a, b) with the least cost over common hubs and the smallest such hub. out, into: node, hub, dist."""
    met = pairs.join(out.toDF("a", "hub", "x"), "a").join(into.toDF("b", "hub", "y"), ["b", "hub"])
    return met.groupBy("a", "b").agg(F.min(F.struct((F.col("x") + F.col("y")).alias("cost"), "hub")).alias("m")).select("a", "b", "m.cost", "m.hub")
