"""Which trips to move: candidate filters, selection, batches.

Scores, shares and prefix covers are set operations with a total order (score, then trip). What is greedy by nature (each choice changes the next) runs as
one task per run on rows prepared here; runs are the parallel axis.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflow.functions import scalar
from wayflow.model import TrafficOptions
from wayflow.operators.dependency import KEY, RUN_NODES, loaded, order_statistic, pushed
from wayflow.operators.live import Live
from wayflow.session import cut, fresh

PICKED = "run_id bigint, trip_id int, place int"


def route_scores(visits: DataFrame, scores: DataFrame, value: str, distinct: bool = True) -> DataFrame:
    """run_id, trip_id, score: the sum over the nodes a trip visits, each once or as often as visited. Sums of whole numbers saturate at the cap of impacts."""
    rows = visits.select("run_id", "trip_id", "edge_id", "time")
    rows = (rows.distinct() if distinct else rows).join(scores.select(*KEY, value), KEY)
    if scores.schema[value].dataType.typeName() != "long":
        return rows.groupBy("run_id", "trip_id").agg(F.sum(value).alias("score"))
    total = F.least(F.sum(F.greatest(F.col(value), F.lit(0)).cast("decimal(38,0)")), F.lit(scalar.IMPACT_CAP).cast("decimal(38,0)"))
    return rows.groupBy("run_id", "trip_id").agg(total.cast("bigint").alias("score"))


def mean_scores(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy("run_id", "trip_id").agg(F.avg(value).alias("score"))


def top_share(rows: DataFrame, keys: list[str], mass: str, item: str, k: int) -> DataFrame:
    """Share of the mass that the k largest hold."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(mass), item)))
    return ranked.groupBy(*keys).agg((F.sum(F.when(F.col("_k") <= k, F.col(mass))) / F.nullif(F.sum(mass), F.lit(0.0))).alias("share"))


def prefix_cover(rows: DataFrame, keys: list[str], score: str, item: str, percent: Column | int) -> DataFrame:
    """Rows in order of score, then item, until their sum reaches the percentage of the total; the row that crosses it is in.

    Running sums are taken in bands of the score, so a key is never sorted in one task.
    """
    rows = rows.where(F.col(score) > 0).withColumn("_b", F.floor(F.log2(F.col(score)) * 8))
    bands = rows.groupBy(*keys, "_b").agg(F.sum(score).alias("_t"))
    w = Window.partitionBy(*keys)
    bands = bands.withColumns({"_c": F.coalesce(F.sum("_t").over(w.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_all": F.sum("_t").over(w)}).drop("_t")
    inner = Window.partitionBy(*keys, "_b").orderBy(F.desc(score), item).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(bands, [*keys, "_b"]).withColumn("_before", F.col("_c") + F.coalesce(F.sum(score).over(inner), F.lit(0.0)))
    share = F.lit(percent) if isinstance(percent, int) else percent
    return rows.where(F.col("_before") < F.col("_all") * share / 100).drop("_b", "_c", "_all", "_before")


def top_fraction(rows: DataFrame, keys: list[str], order: list[Column], percent: int) -> DataFrame:
    """The first percent * n div 100 rows of each key."""
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = rows.withColumns({"_n": n, "place": F.row_number().over(Window.partitionBy(*keys).orderBy(*order))})
    return ranked.where(F.col("place") <= F.expr(f"{percent} * _n div 100")).drop("_n")


def most_delayed(trajectories: DataFrame, free: DataFrame, percent: int) -> DataFrame:
    spent = trajectories.groupBy("run_id", "trip_id").agg(F.sum(F.col("exit") - F.col("enter")).alias("spent"))
    rows = spent.join(free.select("run_id", "trip_id", "tt"), ["run_id", "trip_id"]).withColumn("delay", F.col("spent") - F.col("tt"))
    return top_fraction(rows, ["run_id"], [F.desc("delay"), F.col("trip_id")], percent).select("run_id", "trip_id", "delay", "place")


def random_fraction(trips: DataFrame, percent: int, seed: int) -> DataFrame:
    return top_fraction(trips.select("run_id", "trip_id"), ["run_id"], [scalar.hash_order("trip_id", seed), F.col("trip_id")], percent)


def score_top(visits: DataFrame, relief: DataFrame, theta: int) -> DataFrame:
    """Candidates by score: the trips that cover theta percent of all relief."""
    scored = route_scores(visits, relief, "relief")
    return (scored.limit(0) if theta <= 0 else prefix_cover(scored, ["run_id"], "score", "trip_id", theta)).select("run_id", "trip_id", "score")


def source_congestion(visits: DataFrame, nodes: DataFrame, arcs: DataFrame, edges: DataFrame, percentile: int, by_rounds: bool | None = None) -> DataFrame:
    """Trips through a node whose load exceeds the percentile while none of its ancestors' does.

    What lies below loaded nodes is found by one walk per run if every run, as counted, fits a task, else by rounds of joins; by_rounds decides it.
    """
    rows = nodes.join(edges.select("edge_id", "cap"), "edge_id").withColumn("ratio", scalar.ratio_key("flow", "cap"))
    limit = order_statistic(rows, ["run_id"], "ratio", percentile, "theta")
    hot = cut(rows.join(F.broadcast(limit), "run_id").where("ratio > theta").select(*KEY))
    if by_rounds is None:
        by_rounds = (nodes.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0) > RUN_NODES
    sources = hot.join(_below(hot, arcs), KEY, "left_anti") if by_rounds else _sources(hot, arcs)
    return visits.join(sources, KEY, "left_semi").select("run_id", "trip_id").distinct()


def _sources(hot: DataFrame, arcs: DataFrame) -> DataFrame:
    def work(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        loaded = set(zip(own.edge_id, own.time, strict=True))
        children = defaultdict(list)
        for a, s, b, t in zip(links.src_edge, links.src_time, links.dst_edge, links.dst_time, strict=True):
            children[a, s].append((b, t))
        below, left = set(), list(loaded)
        while left:
            for x in children.get(left.pop(), ()):
                if x not in below:
                    below.add(x)
                    left.append(x)
        return pd.DataFrame([(key[0], *x) for x in loaded - below], columns=KEY)

    links = fresh(arcs.select("run_id", "src_edge", "src_time", "dst_edge", "dst_time").distinct())
    return fresh(hot).groupBy("run_id").cogroup(links.groupBy("run_id")).applyInPandas(work, "run_id bigint, edge_id int, time bigint")


def _below(hot: DataFrame, arcs: DataFrame, rounds: int = 10_000) -> DataFrame:
    arcs = cut(arcs.select("run_id", "src_edge", "src_time", "dst_edge", "dst_time").distinct())
    reached, front = None, hot
    for _ in range(rounds):
        step = arcs.join(front.toDF("run_id", "src_edge", "src_time"), ["run_id", "src_edge", "src_time"], "left_semi").selectExpr("run_id", "dst_edge as edge_id", "dst_time as time").distinct()
        front = cut(step if reached is None else step.join(reached, KEY, "left_anti"))
        if front.isEmpty():
            return hot.limit(0) if reached is None else reached
        reached = front if reached is None else cut(reached.unionAll(front))
    raise RuntimeError(f"descendants still grow after {rounds} rounds")


def by_component(visits: DataFrame, relief: DataFrame, labels: DataFrame, gamma: int) -> DataFrame:
    """Per component of active nodes the trips that cover gamma percent of the component's mass."""
    rows = visits.select("run_id", "trip_id", "edge_id", "time").distinct().join(relief, KEY).join(labels, KEY)
    share = rows.groupBy("run_id", "component", "trip_id").agg(F.sum("relief").alias("score"))
    mass = relief.join(labels, KEY).groupBy("run_id", "component").agg(F.sum("relief").alias("mass"))
    before = Window.partitionBy("run_id", "component").orderBy(F.desc("score"), "trip_id").rowsBetween(Window.unboundedPreceding, -1)
    ranked = share.join(mass, ["run_id", "component"]).withColumn("before", F.coalesce(F.sum("score").over(before), F.lit(0.0)))
    return ranked.where(F.col("before") < F.col("mass") * gamma / 100).select("run_id", "trip_id").distinct()


def _active_arcs(arcs: DataFrame, relief: DataFrame) -> DataFrame:
    on = relief.select(*KEY)
    return arcs.join(on.toDF("run_id", "src_edge", "src_time"), ["run_id", "src_edge", "src_time"], "left_semi").join(on.toDF("run_id", "dst_edge", "dst_time"), ["run_id", "dst_edge", "dst_time"], "left_semi")


def component_marginal(visits: DataFrame, relief: DataFrame, labels: DataFrame, gamma: int, mass_percent: int = 100, budget: int | None = None) -> DataFrame:
    """Trips chosen greedily for the mass they add where a component still lacks some of its gamma percent.

    Only components that together hold ``mass_percent`` of the mass count. The gain of a trip only shrinks, so stale gains are bounds.
    """
    mass = relief.join(labels, KEY).groupBy("run_id", "component").agg(F.sum("relief").alias("mass"))
    kept = prefix_cover(mass, ["run_id"], "mass", "component", mass_percent)
    rows = visits.select("run_id", "trip_id", "edge_id", "time").distinct().join(relief, KEY).join(labels, KEY)
    share = rows.groupBy("run_id", "trip_id", "component").agg(F.sum("relief").alias("score")).join(kept, ["run_id", "component"])

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        lack = {c: m * gamma / 100 for c, m in zip(own.component, own.mass, strict=True)}
        parts = defaultdict(list)
        for t, c, s in zip(own.trip_id, own.component, own.score, strict=True):
            parts[t].append((c, s))
        gain = lambda t: sum(min(s, lack[c]) for c, s in parts[t])
        heap = [(-gain(t), t) for t in parts]
        heapq.heapify(heap)
        out = []
        while heap and (budget is None or len(out) < budget) and sum(lack.values()) > 1e-12:
            _, t = heapq.heappop(heap)
            now = gain(t)
            if now <= 1e-12:
                continue
            if heap and (-now, t) > heap[0]:
                heapq.heappush(heap, (-now, t))
                continue
            out.append((key[0], t, len(out)))
            for c, s in parts[t]:
                lack[c] = max(0.0, lack[c] - s)
        return pd.DataFrame(out, columns=["run_id", "trip_id", "place"])

    return share.groupBy("run_id").applyInPandas(work, PICKED)


def flow_floor(original: list[int], gamma: int) -> list[int]:
    """What a node must keep: (100 - gamma) percent of its first flow, rounded down."""
    return [(100 - gamma) * f // 100 for f in original]


def in_rounds(left: set, worth, stays: dict, may, take, mean: bool = False):
    """Items by falling worth of their nodes, each taken if it may be; a round ends after more than sqrt(n) refusals in a row, the last is the one that takes none.

    mean: the worth of an item is the mean over its nodes, and items worth nothing are left out.
    """
    while left:
        value = worth()
        score = {t: sum(value[i] for i in stays[t]) for t in left}
        if mean:
            score = {t: s / len(stays[t]) for t, s in score.items() if s > 0}
        ranked = sorted((-s, t) for t, s in score.items())
        refused, patience, size = 0, math.isqrt(len(ranked)), len(left)
        for _, t in ranked:
            if may(t):
                take(t)
                left.discard(t)
                refused = 0
                yield t
            else:
                refused += 1
                if refused > patience:
                    break
        if len(left) == size:
            break


def by_flow_floor(visits: DataFrame, nodes: DataFrame, arcs: DataFrame, edges: DataFrame, gamma: int, watched: DataFrame | None = None, lambda_percent: int = 45, roads: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Trips by falling sum of impacts, each taken if every (watched) node it visits keeps (100 - gamma) percent of its flow, rounded down. A trip that is taken
    leaves the graph; a round ends after more than sqrt(n) refusals in a row; the next ranks the trips left by the impacts of the traffic that remains, until
    a round takes none. Of the arcs those along trips are read; the others follow from the flows.
    """
    mark = F.lit(True) if watched is None else F.coalesce("watched", F.lit(False))
    marked = nodes.select(*KEY) if watched is None else nodes.select(*KEY).join(fresh(watched.select(*KEY)).withColumn("watched", F.lit(True)), KEY, "left")
    on = visits.select("run_id", "trip_id", "edge_id", "time").join(marked, KEY)
    rows = on.groupBy("run_id", "trip_id").agg(F.collect_list(F.struct("edge_id", "time", mark.alias("watched"))).alias("nodes"))
    own = nodes.join(edges.select("edge_id", "fft", "cap"), "edge_id").selectExpr(*KEY, "false as arc", "cast(flow as bigint) as flow", "cast(original_flow as bigint) as original_flow", "fft", "cap", "0 as to_edge", "0L as to_time")
    along = arcs.where("kind = 'route'").selectExpr("run_id", "src_edge as edge_id", "src_time as time", "true as arc", "0L as flow", "0L as original_flow", "0L as fft", "0 as cap", "dst_edge as to_edge", "dst_time as to_time")

    def work(key: tuple, trips: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        at = graph[~graph.arc].sort_values(["edge_id", "time"])
        place = {k: i for i, k in enumerate(zip(at.edge_id, at.time, strict=True))}
        links = graph[graph.arc]
        ends = ((place.get((a, s)), place.get((b, t))) for a, s, b, t in zip(links.edge_id, links.time, links.to_edge, links.to_time, strict=True))
        live = Live(at.edge_id.tolist(), at.time.tolist(), at.flow.tolist(), at.fft.tolist(), at.cap.tolist(), [(a, b) for a, b in ends if a is not None and b is not None], roads)
        stays, watch = {}, {}
        for t, ns in zip(trips.trip_id, trips.nodes, strict=True):
            stays[t] = [place[x["edge_id"], x["time"]] for x in ns]
            watch[t] = {place[x["edge_id"], x["time"]] for x in ns if x["watched"]}
        least = flow_floor(at.original_flow.tolist(), gamma)
        out = []
        for t in in_rounds(set(stays), lambda: live.impacts(lambda_percent), stays, lambda t: all(live.flow[i] - 1 >= least[i] for i in watch[t]), lambda t: live.remove(list(dict.fromkeys(stays[t])))):
            out.append((key[0], t, len(out)))
        return pd.DataFrame(out, columns=["run_id", "trip_id", "place"])

    return fresh(rows).groupBy("run_id").cogroup(fresh(own.unionByName(along)).groupBy("run_id")).applyInPandas(work, PICKED)


def by_excess_relief(visits: DataFrame, nodes: DataFrame, impacts_norm: DataFrame, relief: DataFrame, edges: DataFrame, gamma: int) -> DataFrame:
    """Trips by the relief they still bring, until at most (100 - gamma) percent of the initial relief is left. Each choice lowers the flow of the nodes it visits."""
    active = relief.join(nodes.select(*KEY, "flow"), KEY).join(impacts_norm.select(*KEY, "impact_norm"), KEY).join(edges.select("edge_id", "cap"), "edge_id")
    rows = visits.select("run_id", "trip_id", "edge_id", "time").distinct().join(active, KEY)

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        node = own.groupby(["edge_id", "time"], sort=True).ngroup().to_numpy()
        first = own.assign(node=node).drop_duplicates("node").sort_values("node")
        flow, cap, norm = first.flow.tolist(), first.cap.tolist(), first.impact_norm.tolist()
        worth = lambda i: norm[i] * max(0.0, (flow[i] - cap[i]) / cap[i]) if cap[i] > 0 else 0.0
        parts = defaultdict(list)
        for t, i in zip(own.trip_id, node, strict=True):
            parts[t].append(int(i))
        total = sum(map(worth, range(len(flow))))
        left, goal, out = total, total * (100 - gamma) / 100, []
        heap = [(-sum(map(worth, p)), t) for t, p in parts.items()]
        heapq.heapify(heap)
        while heap and left > goal:
            _, t = heapq.heappop(heap)
            now = sum(map(worth, parts[t]))
            if now <= 0:
                continue
            if heap and (-now, t) > heap[0]:
                heapq.heappush(heap, (-now, t))
                continue
            out.append((key[0], t, len(out)))
            for i in parts[t]:
                flow[i] -= 1
            left = sum(map(worth, range(len(flow)))) if len(out) % 64 == 0 else left - now + sum(map(worth, parts[t]))
        return pd.DataFrame(out, columns=["run_id", "trip_id", "place"])

    return rows.groupBy("run_id").applyInPandas(work, PICKED)


def by_bpr_relief(visits: DataFrame, relief: DataFrame, gamma: int) -> DataFrame:
    return prefix_cover(route_scores(visits, relief, "relief"), ["run_id"], "score", "trip_id", gamma).select("run_id", "trip_id", "score")


def batches(selected: DataFrame, visits: DataFrame, nodes: DataFrame, edges: DataFrame, percentile: int, conflict: int, hot: DataFrame | None = None) -> DataFrame:
    """run_id, trip_id, batch: trips that share few loaded nodes travel together.

    Largest sketch first, each to the smallest batch it does not meet, else to the one it meets least, unless that is over ``conflict`` percent of its sketch. How
    much it meets a batch is the number of the batch's trips on each node of the sketch, summed. hot: the loaded nodes, if at hand.
    """
    hot = loaded(nodes, edges, percentile) if hot is None else hot
    sketch = visits.join(hot, KEY, "left_semi").groupBy("run_id", "trip_id").agg(F.collect_set(F.struct("edge_id", "time")).alias("sketch"))
    rows = selected.select("run_id", "trip_id").distinct().join(sketch, ["run_id", "trip_id"], "left")

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.assign(sketch=[{(x["edge_id"], x["time"]) for x in s} if s is not None else set() for s in own.sketch])
        own = own.assign(size=own.sketch.map(len)).sort_values(["size", "trip_id"], ascending=[False, True])
        load: list[Counter] = []  # trips of a batch that hold each node
        batches_of: dict[tuple, list[int]] = defaultdict(list)
        members, out = [], []
        for t, s in zip(own.trip_id, own.sketch, strict=True):
            meets = Counter()
            for x in s:
                for b in batches_of[x]:
                    meets[b] += load[b][x]
            free = min(((m, b) for b, m in enumerate(members) if b not in meets), default=None)
            if free is not None:
                b = free[1]
            elif meets and (least := min((m, members[b], b) for b, m in meets.items()))[0] <= conflict * len(s) // 100:
                b = least[2]
            else:
                b = len(members)
                load.append(Counter())
                members.append(0)
            for x in s:
                if not load[b][x]:
                    batches_of[x].append(b)
                load[b][x] += 1
            members[b] += 1
            out.append((key[0], t, b))
        return pd.DataFrame(out, columns=["run_id", "trip_id", "batch"])

    return rows.groupBy("run_id").applyInPandas(work, "run_id bigint, trip_id int, batch int")


def slot_candidates(slots: DataFrame, arcs: DataFrame, trajectories: DataFrame, edges: DataFrame, width: int, percentile: int, ignore: int = 0) -> DataFrame:
    """Trips through the overloaded slots upstream of the overloaded ones without overloaded children."""
    at = ["run_id", "edge_id", "slot"]
    rows = slots.join(edges.select("edge_id", "cap"), "edge_id").where(F.col("cap") > ignore).withColumn("load", F.col("flow") / F.greatest("cap", F.lit(1)))
    limit = order_statistic(rows, ["run_id"], "load", percentile, "theta")
    hot = cut(rows.join(F.broadcast(limit), "run_id").where(F.col("flow") > F.greatest("theta", F.lit(1.0)) * F.col("cap")).select(*at))
    inner = arcs.join(hot.toDF("run_id", "src_edge", "src_slot"), ["run_id", "src_edge", "src_slot"], "left_semi").join(hot.toDF("run_id", "dst_edge", "dst_slot"), ["run_id", "dst_edge", "dst_slot"], "left_semi")
    inner = cut(inner.drop("kind").distinct())
    roots = hot.join(inner.selectExpr("run_id", "src_edge as edge_id", "src_slot as slot"), at, "left_anti")
    reached = front = cut(roots)
    while not front.isEmpty():
        step = inner.join(front.toDF("run_id", "dst_edge", "dst_slot"), ["run_id", "dst_edge", "dst_slot"], "left_semi").selectExpr("run_id", "src_edge as edge_id", "src_slot as slot").distinct()
        front = cut(step.join(reached, at, "left_anti"))
        reached = cut(reached.unionAll(front))
    rootless = hot.join(reached.select("run_id").distinct(), "run_id", "left_anti")
    chosen = reached.unionByName(rootless)
    return trajectories.withColumn("slot", scalar.slot_of("enter", width)).join(chosen, at, "left_semi").select("run_id", "trip_id").distinct()


def slot_scores(trajectories: DataFrame, impacts: DataFrame, width: int) -> DataFrame:
    """Mean impact of the slots a trip enters."""
    return trajectories.withColumn("slot", scalar.slot_of("enter", width)).join(impacts, ["run_id", "edge_id", "slot"]).transform(mean_scores, "impact")


def slot_visits(trajectories: DataFrame, slots: DataFrame, width: int) -> DataFrame:
    """The slots a trip's stays touch."""
    lo, hi = scalar.slot_of("enter", width), scalar.slot_of("exit", width)
    return trajectories.select("run_id", "trip_id", "edge_id", F.explode(F.sequence(lo, hi)).alias("slot")).join(slots, ["run_id", "edge_id", "slot"]).distinct()


def slot_select(trajectories: DataFrame, slots: DataFrame, arcs: DataFrame, candidates: DataFrame, edges: DataFrame, width: int, gamma: int, lambda_percent: int = 45, roads: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Candidates by the mean impact of the slots they enter, each taken if every slot it touches keeps (100 - gamma) percent of its flow, rounded down; in rounds.

    A slot left without flow goes with its arcs, and its neighbours on the edge are linked if the earlier one's delay reaches the later one's time. Candidates
    without a slot or of no worth are never taken.
    """
    touched = slot_visits(trajectories, slots, width).join(candidates, ["run_id", "trip_id"], "left_semi").groupBy("run_id", "trip_id").agg(F.collect_set(F.struct("edge_id", "slot")).alias("touched"))
    entered = trajectories.join(candidates, ["run_id", "trip_id"], "left_semi").groupBy("run_id", "trip_id").agg(F.collect_list(F.struct("edge_id", scalar.slot_of("enter", width).alias("slot"))).alias("entered"))
    own = slots.join(edges.select("edge_id", "fft", "cap"), "edge_id").selectExpr("run_id", "edge_id", "slot", "time", "cast(flow as bigint) as flow", "fft", "cap", "cast(null as int) as to_edge", "cast(null as bigint) as to_slot")
    links = arcs.selectExpr("run_id", "src_edge as edge_id", "src_slot as slot", "0L as time", "0L as flow", "0L as fft", "0 as cap", "dst_edge as to_edge", "dst_slot as to_slot")

    def work(key: tuple, trips: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        at = graph[graph.to_edge.isna()].sort_values(["edge_id", "slot"])
        place = {k: i for i, k in enumerate(zip(at.edge_id, at.slot, strict=True))}
        flow, time, edge = at.flow.tolist(), at.time.tolist(), at.edge_id.tolist()
        fft, cap = at.fft.tolist(), at.cap.tolist()
        delay = lambda i: roads.delay(fft[i], cap[i], flow[i])
        some = graph[graph.to_edge.notna()]
        up: list[set[int]] = [set() for _ in flow]
        down: list[set[int]] = [set() for _ in flow]
        for a, s, b, t in zip(some.edge_id, some.slot, some.to_edge.astype(int), some.to_slot.astype(int), strict=True):
            down[place[a, s]].add(place[b, t])
            up[place[b, t]].add(place[a, s])
        line = defaultdict(list)
        for i, e in enumerate(edge):
            line[e].append(i)
        alive = [True] * len(flow)
        stays = {t: [place[x["edge_id"], x["slot"]] for x in xs if (x["edge_id"], x["slot"]) in place] for t, xs in zip(trips.trip_id, trips.entered, strict=True)}
        reach = {t: [place[x["edge_id"], x["slot"]] for x in xs] if xs is not None else [] for t, xs in zip(trips.trip_id, trips.touched, strict=True)}
        least = flow_floor(flow, min(100, max(0, gamma)))

        def worth() -> list[int]:
            return pushed([delay(i) if alive[i] else 0 for i in range(len(flow))], up, [len(d) for d in down], lambda_percent)

        def may(t) -> bool:
            on = [i for i in reach[t] if alive[i]]
            return bool(on) and all(flow[i] > 0 and flow[i] - 1 >= least[i] for i in on)

        def take(t) -> None:
            on = sorted(i for i in reach[t] if alive[i])
            for i in on:
                flow[i] -= 1
            for i in (i for i in on if flow[i] == 0):
                own = line[edge[i]]
                k = bisect_left(own, i)
                before, after = own[k - 1] if k else None, own[k + 1] if k + 1 < len(own) else None
                for a in up[i]:
                    down[a].discard(i)
                for b in down[i]:
                    up[b].discard(i)
                up[i], down[i], alive[i] = set(), set(), False
                if before is not None and after is not None and time[before] + delay(before) >= time[after]:
                    down[before].add(after)
                    up[after].add(before)
                own.pop(k)

        # a slot that is gone counts neither for the sum nor for the number
        living = _Living(stays, alive)
        out = [(key[0], t, k) for k, t in enumerate(in_rounds(set(stays), worth, living, may, take, True))]
        return pd.DataFrame(out, columns=["run_id", "trip_id", "place"])

    rows = entered.join(touched, ["run_id", "trip_id"], "left")
    return fresh(rows).groupBy("run_id").cogroup(fresh(own.unionByName(links)).groupBy("run_id")).applyInPandas(work, PICKED)


class _Living:
    def __init__(self, stays: dict, alive: list[bool]):
        self.stays, self.alive = stays, alive

    def __getitem__(self, t) -> list[int]:
        return [i for i in self.stays[t] if self.alive[i]]


def candidates(name: str, *, trips: DataFrame, visits: DataFrame, nodes: DataFrame, arcs: DataFrame, edges: DataFrame, relief: DataFrame, options) -> DataFrame:
    """Candidate filters by name."""
    from wayflow.operators.dependency import run_components

    every = trips.select("run_id", "trip_id").distinct()
    if name == "all":
        return every
    if name == "source_congestion":
        return source_congestion(visits, nodes, arcs, edges, options.theta_percentile)
    if name in ("score_top", "global_score"):
        return score_top(visits, relief, options.candidate_theta).select("run_id", "trip_id")
    labels = run_components(relief.select(*KEY), _active_arcs(arcs, relief))
    if name == "component_balanced":
        return by_component(visits, relief, labels, options.gamma)
    if not name.startswith("component_marginal"):
        raise ValueError(f"no candidate filter {name}")
    _, _, rest = name.partition("component_marginal")
    parts = [x for x in rest.split("_") if x]
    share = next((int(x[5:]) for x in parts if x.startswith("major")), 100)
    budget = None
    if (percent := next((int(x[6:]) for x in parts if x.startswith("budget")), None)) is not None:
        budget = -(-every.count() * percent // 100)
    elif "samek" in parts:
        budget = score_top(visits, relief, options.candidate_theta).count()
    return component_marginal(visits, relief, labels, options.gamma, share, budget).select("run_id", "trip_id")


def covering_count(rows: DataFrame, keys: list[str], mass: str, percent: int) -> DataFrame:
    """How many of the largest cover the percentage of the mass."""
    w = Window.partitionBy(*keys).orderBy(F.desc(mass)).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(mass).over(Window.partitionBy(*keys))
    return rows.withColumns({"_b": F.coalesce(F.sum(mass).over(w), F.lit(0)), "_t": total}).where(F.col("_b") < F.col("_t") * percent / 100).groupBy(*keys).agg(F.count("*").alias("items"))
