"""Path operators on a road network.

The network is a directed multigraph. It is sent to the tasks as arrays, behind a check of its size; searches then run in parallel over origins,
destinations or pairs. ``relaxed_distances`` is the way for networks beyond that size: rounds of joins and minima, no broadcast.
Ties are settled by node, then edge, so that every result is reproducible.
"""

from __future__ import annotations

import heapq
import weakref
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayflow.session import cut

INF = (2**63 - 1) // 4
#: Bytes of the largest network that is broadcast, and what an edge takes: five numbers of eight bytes. A task adds two orders of the edges, of eight bytes each.
MOST_BYTES, EDGE_BYTES = 200 << 20, 40


class _Places:
    """Position of an edge id, by binary search in the sorted ids."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids

    def __getitem__(self, edge_id) -> int:
        k = int(np.searchsorted(self.ids, edge_id))
        if k == len(self.ids) or self.ids[k] != edge_id:
            raise KeyError(edge_id)
        return k


class _Out:
    """node -> (next node, position, fft), by edge: the edges in order of their node, and where each node's begin. Lists are made when a node is first asked for."""

    def __init__(self, a: np.ndarray, b: np.ndarray, fft: np.ndarray):
        self.order = np.argsort(a, kind="stable")
        self.nodes, self.first = np.unique(a[self.order], return_index=True)
        self.last = np.append(self.first[1:], len(a))
        self.b, self.fft, self.made = b, fft, {}

    def get(self, node: int, default=()):
        own = self.made.get(node)
        if own is None:
            k = int(np.searchsorted(self.nodes, node))
            if k == len(self.nodes) or self.nodes[k] != node:
                return default
            at = self.order[self.first[k] : self.last[k]]
            own = self.made[node] = list(zip(self.b[at].tolist(), at.tolist(), self.fft[at].tolist(), strict=True))
        return own

    def __getitem__(self, node: int):
        return self.get(node)


class Network:
    """Edges as arrays by position, in order of their ids; ``index`` maps an edge id to its position."""

    def __init__(self, edge_id, src, dst, fft, cap):
        order = np.argsort(np.asarray(edge_id, np.int64), kind="stable")
        self.edge_id, self.src, self.dst, self.fft, self.cap = (np.asarray(x, np.int64)[order] for x in (edge_id, src, dst, fft, cap))
        self.index = _Places(self.edge_id)
        self._lists: dict[bool, _Out] = {}

    def out(self, backward: bool = False) -> _Out:
        """The edges that leave each node (that reach it, if backward)."""
        if backward not in self._lists:
            a, b = (self.dst, self.src) if backward else (self.src, self.dst)
            self._lists[backward] = _Out(a, b, self.fft)
        return self._lists[backward]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lists"} | {"_lists": {}}

    def tree(self, origin: int, targets: set[int] | None = None, cutoff: int = INF, backward: bool = False) -> tuple[dict[int, int], dict[int, int]]:
        """Distances and the position of the edge each node was reached by; stops once all targets are settled or the cutoff is passed."""
        out = self.out(backward)
        dist, via, done = {origin: 0}, {}, {}
        left = set(targets) if targets is not None else None
        heap = [(0, origin)]
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            if d > cutoff:
                break
            done[u] = d
            if left is not None:
                left.discard(u)
                if not left:
                    break
            for v, i, w in out.get(u, ()):
                if v not in done and d + w < dist.get(v, INF):
                    dist[v] = d + w
                    via[v] = i
                    heapq.heappush(heap, (d + w, v))
        return done, via

    def walk(self, via: dict[int, int], origin: int, node: int, backward: bool = False) -> list[int]:
        """Positions of the edges from origin to node (from node to origin if backward)."""
        path = []
        while node != origin:
            i = via[node]
            path.append(i)
            node = int(self.dst[i] if backward else self.src[i])
        return path if backward else path[::-1]

    def shortest(self, origin: int, destination: int) -> list[int]:
        if origin == destination:
            return []
        done, via = self.tree(origin, {destination})
        return self.walk(via, origin, destination) if destination in done else []

    def timed(self, origin: int, destination: int, start: int, cost) -> list[int]:
        """Time-dependent search: ``cost(position, time)`` gives (travel time, score); labels keep the first settled."""
        if origin == destination:
            return []
        out, done, via = self.out(), set(), {}
        best = {origin: 0}
        heap = [(0, origin, start, -1)]
        while heap:
            score, u, now, came = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if came >= 0:
                via[u] = came
            if u == destination:
                return self.walk(via, origin, destination)
            for v, i, _ in out.get(u, ()):
                if v not in done:
                    travel, price = cost(i, now)
                    if score + price < best.get(v, INF):
                        best[v] = score + price
                        heapq.heappush(heap, (score + price, v, now + travel, i))
        return []

    def diverse(self, origin: int, destination: int, k: int, theta: int) -> list[list[int]]:
        """Up to k simple single-via paths, shortest first, that overlap any accepted one by at most theta percent of the shorter."""
        if origin == destination:
            return []
        fore, via = self.tree(origin)
        if destination not in fore:
            return []
        back, to = self.tree(destination, backward=True)
        kept: list[tuple[list[int], set[int], int]] = []
        for _, node in sorted((fore[v] + back[v], v) for v in fore if v in back):
            path = self.walk(via, origin, node) + self.walk(to, destination, node, True)
            seen = [origin, *(int(self.dst[i]) for i in path)]
            if len(set(seen)) < len(seen) or any(path == p for p, _, _ in kept):
                continue
            size = int(self.fft[path].sum())
            if all(int(self.fft[[i for i in path if i in s]].sum()) * 100 <= min(size, n) * theta for _, s, n in kept):
                kept.append((path, set(path), size))
                if len(kept) == k:
                    break
        return [p for p, _, _ in kept] or [self.shortest(origin, destination)]


def network(edges: DataFrame) -> Network:
    """edges: edge_id, src, dst, fft, cap; refused beyond MOST_BYTES."""
    rows = edges.select("edge_id", "src", "dst", "fft", "cap").limit(MOST_BYTES // EDGE_BYTES + 1).toArrow().to_pandas()
    if len(rows) * EDGE_BYTES > MOST_BYTES:
        raise ValueError(f"over {MOST_BYTES // EDGE_BYTES} edges are too many to broadcast; use relaxed_distances")
    return Network(rows.edge_id, rows.src, rows.dst, rows.fft, rows.cap)


#: Broadcast networks by the table they were made of, so that a loop collects and sends its roads once.
_SENT: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _shared(edges: DataFrame):
    if edges not in _SENT:
        _SENT[edges] = edges.sparkSession.sparkContext.broadcast(network(edges))
    return _SENT[edges]


def _parts(spark: SparkSession) -> int:
    """A given number of parts for searches, since their few small rows would be put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _routes(net, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, last, done, via = net.value, None, {}, {}
        for batch in batches:
            rows = []
            for o, group in batch.groupby("origin", sort=False):
                targets = set(group.destination)
                if o != last or not targets <= done.keys():
                    done, via = own.tree(o, targets)
                    last = o
                for d in group.destination:
                    path = own.walk(via, o, d) if d in done and d != o else []
                    rows.append((o, d, [int(own.edge_id[i]) for i in path], int(done[d]) if path else 0))
            yield pd.DataFrame(rows, columns=["origin", "destination", "edges", "tt"])

    return run


def shortest_routes(edges: DataFrame, trips: DataFrame) -> DataFrame:
    """trips with ``edges`` and ``tt``: one search per origin over the distinct pairs; unreachable and trivial trips have an empty route and 0."""
    pairs = trips.select("origin", "destination").distinct().repartition(_parts(edges.sparkSession), "origin").sortWithinPartitions("origin", "destination")
    found = pairs.mapInPandas(_routes(_shared(edges), "origin"), "origin int, destination int, edges array<int>, tt bigint")
    return trips.join(found, ["origin", "destination"])


def distances(edges: DataFrame, sources: DataFrame, cutoff: int = INF, backward: bool = False) -> DataFrame:
    """source, node, dist from every source (to it, if backward) within the cutoff. sources: source."""
    net = _shared(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.source:
                done, _ = net.value.tree(int(s), None, cutoff, backward)
                yield pd.DataFrame({"source": s, "node": list(done), "dist": list(done.values())})

    return sources.select("source").distinct().repartition(_parts(edges.sparkSession), "source").mapInPandas(run, "source int, node int, dist bigint")


def nodes_in_range(edges: DataFrame, sources: DataFrame, low: int, high: int) -> DataFrame:
    return distances(edges, sources, high).where(F.col("dist") >= low)


def relaxed_distances(edges: DataFrame, sources: DataFrame, rounds: int = 200, doublings: int = 3) -> DataFrame:
    """The same distances by rounds of relaxation of the nodes that improved, for networks that are too large to send around.

    Ways of up to 2^doublings edges are joined to single steps first, so that a round reaches so far.
    """
    hops = edges.groupBy(F.col("src").alias("node"), F.col("dst").alias("next")).agg(F.min("fft").alias("fft"))
    for _ in range(doublings):
        further = hops.join(hops.toDF("next", "after", "more"), "next").select("node", F.col("after").alias("next"), (F.col("fft") + F.col("more")).alias("fft"))
        hops = cut(hops.unionByName(further).where("node <> next").groupBy("node", "next").agg(F.min("fft").alias("fft")))
    known = cut(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("dist")).distinct())
    front = known
    for _ in range(rounds):
        step = front.join(hops, "node").groupBy("source", F.col("next").alias("node")).agg(F.min(F.col("dist") + F.col("fft")).alias("new"))
        both = cut(known.join(step, ["source", "node"], "full").selectExpr("source", "node", "least(dist, new) as dist", "new is not null and (dist is null or new < dist) as better"))
        known, front = both.drop("better"), both.where("better").drop("better")
        if front.isEmpty():
            return known
    raise RuntimeError(f"distances still improve after {rounds} rounds")


def diverse_routes(edges: DataFrame, trips: DataFrame, k: int = 5, theta: int = 80) -> DataFrame:
    """Trips with one of up to k diverse routes of their pair, handed out in turn in trip order."""
    net = _shared(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = net.value
        for batch in batches:
            rows = []
            for o, d in zip(batch.origin, batch.destination, strict=True):
                ways = [p for p in own.diverse(int(o), int(d), k, theta) if p]
                rows.append((o, d, [[int(own.edge_id[i]) for i in p] for p in ways], [int(own.fft[p].sum()) for p in ways]))
            yield pd.DataFrame(rows, columns=["origin", "destination", "ways", "sizes"])

    pairs = trips.select("origin", "destination").distinct().repartition("origin", "destination")
    ways = pairs.mapInPandas(run, "origin int, destination int, ways array<array<int>>, sizes array<bigint>")
    return round_robin(trips, ways)


def round_robin(trips: DataFrame, ways: DataFrame) -> DataFrame:
    """The i-th trip of a pair takes way i modulo the number of ways. A pair's trips are numbered within buckets of trip ids, then shifted."""
    from pyspark.sql import Window

    rows = trips.withColumn("_b", F.expr("trip_id div 100000"))
    sizes = rows.groupBy("origin", "destination", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("origin", "destination").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("origin", "destination", "_b").orderBy("trip_id")) - 1
    rows = rows.withColumn("_i", own).join(sizes, ["origin", "destination", "_b"]).join(ways, ["origin", "destination"], "left")
    at = F.when(F.size("ways") > 0, F.pmod(F.col("_i") + F.col("_first"), F.size("ways")).cast("int"))
    return rows.select(*trips.columns, F.coalesce(F.get("ways", at), F.array().cast("array<int>")).alias("edges"), F.coalesce(F.get("sizes", at), F.lit(0).cast("bigint")).alias("tt"))


def valid(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """routes (trip_id, origin, destination, edges) with ``contiguous``: an unbroken way from origin to destination. No edges are one where nothing need be gone."""
    steps = routes.select("trip_id", "origin", "destination", F.posexplode("edges").alias("pos", "edge_id")).join(edges.select("edge_id", "src", "dst"), "edge_id", "left")
    from pyspark.sql import Window

    w = Window.partitionBy("trip_id").orderBy("pos")
    ok = F.col("src").eqNullSafe(F.coalesce(F.lag("dst").over(w), F.col("origin"))) & F.col("dst").isNotNull()
    end = F.when(F.lead("pos").over(w).isNull(), F.col("dst").eqNullSafe(F.col("destination"))).otherwise(True)
    checked = steps.withColumn("ok", ok & end).groupBy("trip_id").agg(F.bool_and("ok").alias("ok"))
    return routes.join(checked, "trip_id", "left").withColumn("contiguous", F.coalesce("ok", F.col("origin").eqNullSafe(F.col("destination")))).drop("ok")
