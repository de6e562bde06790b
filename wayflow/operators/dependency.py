"""The dependency graph of a traffic result: who is slowed down by whom.

A node is a distinct (edge, entry time) of a run; arcs lead along trips (a bag: two trips give two arcs) and from a node to the next on the same edge
if it is still felt there. All of it is joins and windows on (run, edge, time), which is also the key the nodes are shuffled by throughout.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayflow.functions import scalar
from wayflow.model import AlgorithmOptions, TrafficOptions
from wayflow.operators import timeline
from wayflow.operators.paths import _shared
from wayflow.session import cut, fresh

KEY = ["run_id", "edge_id", "time"]


def nodes(profile: DataFrame) -> DataFrame:
    """run_id, edge_id, time, flow, original_flow: the entry events of the profile."""
    return profile.where("is_entry").select(*KEY, "flow", F.col("flow").alias("original_flow"))


def route_arcs(trajectories: DataFrame) -> DataFrame:
    """(edge, time) -> (next edge, next time) along every trip, with multiplicity."""
    w = Window.partitionBy("run_id", "trip_id").orderBy("pos")
    return trajectories.select("run_id", F.col("edge_id").alias("src_edge"), F.col("enter").alias("src_time"), F.lead("edge_id").over(w).alias("dst_edge"), F.lead("enter").over(w).alias("dst_time")).where("dst_edge is not null")


def same_edge_arcs(nodes_: DataFrame, edges: DataFrame, options: TrafficOptions = TrafficOptions(), inclusive: bool = False) -> DataFrame:
    """From a node to the next on its edge, if its delay lasts beyond (or, inclusive, up to) that one's time.

    The node before the first of a time bucket comes from one row per bucket.
    """
    b = F.floor(F.col("time") / timeline.BUCKET_S)
    rows = nodes_.select(*KEY, "flow").withColumn("b", b)
    ends = rows.groupBy("run_id", "edge_id", "b").agg(F.max_by(F.struct("time", "flow"), "time").alias("p"))
    ends = ends.withColumn("p", F.lag("p").over(Window.partitionBy("run_id", "edge_id").orderBy("b")))
    w = Window.partitionBy("run_id", "edge_id", "b").orderBy("time")
    rows = rows.join(ends, ["run_id", "edge_id", "b"]).withColumn("p", F.coalesce(F.lag(F.struct("time", "flow")).over(w), F.col("p"))).where("p is not null")
    rows = rows.join(edges.select("edge_id", "fft", "cap"), "edge_id")
    until = F.col("p.time") + options.column("fft", "cap", "p.flow")
    felt = until >= F.col("time") if inclusive else until > F.col("time")
    return rows.where(felt).select("run_id", F.col("edge_id").alias("src_edge"), F.col("p.time").alias("src_time"), F.col("edge_id").alias("dst_edge"), F.col("time").alias("dst_time"))


def visits(trajectories: DataFrame, nodes_: DataFrame) -> DataFrame:
    """Nodes that lie within each trip's stay on their edge."""
    stays = trajectories.select("run_id", "trip_id", "edge_id", "enter", "exit")
    return timeline.interval_join(nodes_, stays, ["run_id", "edge_id"], "time", "enter", "exit")


def anchors(profile: DataFrame, edges: DataFrame, options: AlgorithmOptions = AlgorithmOptions()) -> DataFrame:
    """run_id, edge_id, time, score of entries whose flow departs from the mean of the trailing window by the threshold; an edge's first entry scores 0."""
    keys = ["run_id", "edge_id"]
    rows = timeline.trailing_areas(profile, keys, options.anchor_window).where("is_entry").join(edges.select("edge_id", F.greatest("cap", F.lit(1)).cast("decimal(19,0)").alias("c")), "edge_id")
    first = profile.where("is_entry").groupBy(*keys).agg(F.min("time").alias("first"))
    rows = rows.join(first, keys)
    dev = F.abs(F.col("flow") * F.col("duration") - F.col("window_area")).cast("decimal(19,0)")
    base = F.col("c") * F.col("duration")
    score = F.when(F.col("time") == F.col("first"), F.lit(0).cast("bigint")).when((F.col("duration") > 0) & (dev * 100 >= base * options.anchor_threshold), F.call_function("div", dev * 1_000_000, base))
    return rows.withColumn("score", score).where("score is not null").select(*KEY, "score")


def important(nodes_: DataFrame, anchors_: DataFrame) -> DataFrame:
    return nodes_.join(anchors_.where("score > 0").select(*KEY), KEY, "left_semi")


def propagated(base: list[int], children: list[list[int]], percent: int) -> list[int]:
    """base + percent of the children's values, each shared among its parents; floors throughout. Nodes on a cycle keep their base."""
    up: list[list[int]] = [[] for _ in base]
    for a, cs in enumerate(children):
        for b in cs:
            up[b].append(a)
    value, open_ = list(base), [len(c) for c in children]
    ready = deque(i for i, n in enumerate(open_) if n == 0)
    while ready:
        i = ready.popleft()
        gained = sum(value[c] // len(up[c]) for c in children[i])
        value[i] = min(base[i] + gained * percent // 100, scalar.IMPACT_CAP)
        for a in up[i]:
            open_[a] -= 1
            if open_[a] == 0:
                ready.append(a)
    return value


def pushed(base: list[int], up: list[set[int]], open_: list[int], percent: int) -> list[int]:
    """The slot variant: from the leaves on every node gives its parents their shares, each rounded half up, saturating. open_: children each node waits for."""
    value, open_ = list(base), list(open_)
    ready = deque(i for i, n in enumerate(open_) if n == 0)
    while ready:
        i = ready.popleft()
        for a in sorted(up[i]):
            share = (2 * percent * value[i] + 100 * len(up[i])) // (200 * len(up[i]))
            value[a] = min(value[a] + share, scalar.MAX_LONG)
            open_[a] -= 1
            if open_[a] == 0:
                ready.append(a)
    return value


def impacts(nodes_: DataFrame, arcs: DataFrame, edges: DataFrame, options: AlgorithmOptions = AlgorithmOptions(), traffic: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Nodes with base (own delay) and impact: base plus lambda percent of the children's, each divided by its number of parents; floors at each step.

    arcs: all route arcs with multiplicity, and same-edge arcs where no equal route arc exists. Time grows along arcs, so a component is worked
    off from the latest node in one task; components are the parallel axis.
    """
    lam = options.lambda_percent
    rows = nodes_.join(edges.select("edge_id", "fft", "cap"), "edge_id").withColumn("base", traffic.column("fft", "cap", "flow"))
    comp = cut(labels(nodes_, arcs))
    rows = rows.join(comp, KEY).select("run_id", "component", "edge_id", "time", "base")
    inner = arcs.join(comp.selectExpr("run_id", "edge_id as src_edge", "time as src_time", "component"), ["run_id", "src_edge", "src_time"])

    def work(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        number = {k: i for i, k in enumerate(zip(own.edge_id, own.time, strict=True))}
        children: list[list[int]] = [[] for _ in number]
        for se, st, de, dt in zip(links.src_edge, links.src_time, links.dst_edge, links.dst_time, strict=True):
            a, b = number.get((se, st)), number.get((de, dt))
            if a is not None and b is not None:
                children[a].append(b)
        base = own.base.tolist()
        value = propagated(base, children, lam)
        return pd.DataFrame({"run_id": own.run_id, "edge_id": own.edge_id, "time": own.time, "base": base, "impact": value})

    groups = fresh(rows).groupBy("run_id", "component").cogroup(fresh(inner).groupBy("run_id", "component"))
    return groups.applyInPandas(work, "run_id bigint, edge_id int, time bigint, base bigint, impact bigint")


def all_arcs(trajectories: DataFrame, nodes_: DataFrame, edges: DataFrame, traffic: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Route arcs as they are and the same-edge arcs that no route arc repeats."""
    return joined_arcs(route_arcs(trajectories), nodes_, edges, traffic)


def joined_arcs(along: DataFrame, nodes_: DataFrame, edges: DataFrame, traffic: TrafficOptions = TrafficOptions()) -> DataFrame:
    felt = same_edge_arcs(nodes_, edges, traffic)
    return along.withColumn("kind", F.lit("route")).unionByName(felt.join(along, felt.columns, "left_anti").withColumn("kind", F.lit("edge")))


def run_components(nodes_: DataFrame, arcs: DataFrame) -> DataFrame:
    """The same labels by one union-find per run: far fewer jobs than the rounds of ``components``, for runs whose graph fits a task."""

    def work(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        number = {k: i for i, k in enumerate(zip(own.edge_id, own.time, strict=True))}
        root = list(range(len(number)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for se, st, de, dt in zip(links.src_edge, links.src_time, links.dst_edge, links.dst_time, strict=True):
            a, b = number.get((se, st)), number.get((de, dt))
            if a is not None and b is not None:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
        names = [f"{e}:{t}" for e, t in number]
        return pd.DataFrame({"run_id": own.run_id, "edge_id": own.edge_id, "time": own.time, "component": [names[find(i)] for i in range(len(root))]})

    own = fresh(nodes_.select(*KEY)).repartition("run_id").sortWithinPartitions(*KEY)
    links = fresh(arcs.select("run_id", "src_edge", "src_time", "dst_edge", "dst_time"))
    return own.groupBy("run_id").cogroup(links.groupBy("run_id")).applyInPandas(work, "run_id bigint, edge_id int, time bigint, component string")


#: Nodes of the largest run whose components are found by one union-find.
RUN_NODES = 2_000_000


def labels(nodes_: DataFrame, arcs: DataFrame) -> DataFrame:
    """Components by one union-find per run if every run, as counted, fits a task; by rounds of joins otherwise."""
    most = nodes_.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    return run_components(nodes_, arcs) if most <= RUN_NODES else components(nodes_, arcs)


def components(nodes_: DataFrame, arcs: DataFrame, rounds: int = 100) -> DataFrame:
    """run_id, edge_id, time, component: weak components by least labels, with pointer jumping, so that rounds grow with the logarithm of the depth."""
    name = lambda e, t: F.concat_ws(":", e, t)
    own = nodes_.select("run_id", "edge_id", "time", name("edge_id", "time").alias("v"), F.xxhash64("edge_id", "time").alias("h"))
    number = cut(own.withColumn("n", F.struct("h", "v")).drop("h"))
    ends = number.select("run_id", "v", "n")
    pairs = arcs.select("run_id", name("src_edge", "src_time").alias("a"), name("dst_edge", "dst_time").alias("b")).distinct()
    pairs = pairs.join(ends.select("run_id", F.col("v").alias("a"), F.col("n").alias("na")), ["run_id", "a"]).join(ends.select("run_id", F.col("v").alias("b"), F.col("n").alias("nb")), ["run_id", "b"])
    both = cut(pairs.select("run_id", "na", "nb").unionAll(pairs.select("run_id", F.col("nb").alias("na"), F.col("na").alias("nb"))))
    label = cut(ends.select("run_id", "n", F.col("n").alias("c")))
    for _ in range(rounds):
        near = both.join(label.select("run_id", F.col("n").alias("nb"), "c"), ["run_id", "nb"]).groupBy("run_id", F.col("na").alias("n")).agg(F.min("c").alias("m"))
        step = label.join(near, ["run_id", "n"], "left").select("run_id", "n", "c", F.least("c", "m").alias("m"))
        # a label's own label is at least as small
        jump = step.join(step.select("run_id", F.col("n").alias("m"), F.col("m").alias("mm")), ["run_id", "m"])
        new = cut(jump.select("run_id", "n", "c", F.least("m", "mm").alias("m")))
        done = new.where("c <> m").isEmpty()
        label = new.select("run_id", "n", F.col("m").alias("c"))
        if done:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    return number.join(label, ["run_id", "n"]).select("run_id", "edge_id", "time", F.col("c.v").alias("component"))


def component_sizes(stays: DataFrame) -> DataFrame:
    """run_id, k: the number of nodes of each weak component of the stays' route arcs.

    The nodes of a trip are one chain, so trips are joined instead of nodes, and only those that share a node: all stays are shuffled once, by node. A component
    has the stays of its trips without those that repeat a node; what repeats a node counts for its first trip.
    """
    # stays without a trip's number are one trip, as in a window
    rows = stays.select("run_id", F.coalesce("trip_id", F.lit(-(2**31))).alias("trip_id"), "edge_id", F.col("enter").alias("time"))
    trips = rows.groupBy("run_id", "trip_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("run_id", "edge_id", "time").orderBy("trip_id")
    told = rows.withColumns({"first": F.first("trip_id").over(w), "place": F.row_number().over(w)}).where("place > 1")
    again = cut(told.groupBy("run_id", "first", "trip_id").agg(F.count("*").alias("n")))
    end = lambda c: F.col(c).alias("edge_id")
    links = again.where("first <> trip_id")
    ends = cut(links.select("run_id", end("first")).unionAll(links.select("run_id", end("trip_id"))).distinct().withColumn("time", F.lit(0).cast("bigint")))
    zero = F.lit(0).cast("bigint")
    label = labels(ends, links.select("run_id", F.col("first").alias("src_edge"), zero.alias("src_time"), F.col("trip_id").alias("dst_edge"), zero.alias("dst_time")))
    parts = trips.unionAll(again.select("run_id", F.col("first").alias("trip_id"), (-F.col("n")).alias("n"))).groupBy("run_id", "trip_id").agg(F.sum("n").alias("n"))
    parts = parts.join(label.select("run_id", F.col("edge_id").alias("trip_id"), "component"), ["run_id", "trip_id"], "left")
    return parts.groupBy("run_id", F.coalesce("component", F.col("trip_id").cast("string")).alias("component")).agg(F.sum("n").alias("k")).select("run_id", "k")


def order_statistic(rows: DataFrame, keys: list[str], value: str, percent: int, out: str) -> DataFrame:
    """keys and the value at index percent * (n - 1) div 100 in ascending order, exact, without sorting a key in one task.

    Equal values are counted first, and running counts are taken over (key, value range).
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_b", F.floor(F.log2(F.abs(F.col(value).cast("double")) + 1) * 16) * F.signum(F.col(value).cast("double")))
    parts = counts.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"_c": F.coalesce(F.sum("_t").over(before), F.lit(0)), "_all": F.sum("_t").over(w)})
    parts = parts.withColumn("_i", scalar.percentile_index("_all", percent)).where((F.col("_c") <= F.col("_i")) & (F.col("_i") < F.col("_c") + F.col("_t")))
    run = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy(value))
    hit = counts.join(parts, [*keys, "_b"]).withColumn("_r", F.col("_c") + run).where("_r > _i")
    return hit.groupBy(*keys).agg(F.min(value).alias(out))


def normalised(impacts_: DataFrame) -> DataFrame:
    """Impacts in 0..1: clipped at the 99th percentile, on a log scale."""
    at = order_statistic(impacts_.withColumn("impact", F.greatest("impact", F.lit(0))), ["run_id"], "impact", 99, "clip")
    return impacts_.join(F.broadcast(at), "run_id").withColumn("impact_norm", scalar.log_share("impact", "clip")).drop("clip")


def penalties(impacts_: DataFrame, nodes_: DataFrame, edges: DataFrame, options: AlgorithmOptions = AlgorithmOptions(), normal: DataFrame | None = None) -> DataFrame:
    """What rerouting pays per node: the normalised impact, in units of the 90th percentile of delays, gated by the load; whole, never negative. normal: the normalised impacts, if at hand."""
    unit = order_statistic(impacts_.withColumn("d", F.greatest("base", F.lit(1))), ["run_id"], "d", 90, "unit")
    rows = (normalised(impacts_) if normal is None else fresh(normal)).join(F.broadcast(unit), "run_id").join(nodes_.select(*KEY, "flow"), KEY).join(edges.select("edge_id", "cap"), "edge_id")
    return rows.select(*KEY, "impact", _penalty(options).alias("penalty"))


def _penalty(options: AlgorithmOptions) -> Column:
    load = F.col("flow") / F.greatest("cap", F.lit(1))
    price = F.round(F.col("impact_norm") * F.col("unit") * scalar.gate(load, options.reroute_congestion_gate)).cast("bigint")
    return F.greatest(F.lit(0).cast("bigint"), F.least(price, F.lit(scalar.IMPACT_CAP)))


def relief(nodes_: DataFrame, impacts_norm: DataFrame, anchors_: DataFrame, edges: DataFrame) -> DataFrame:
    """Excess relief of the nodes that matter: anchors, or the overloaded ones in a run without anchors."""
    marked = important(nodes_, anchors_).select(*KEY, F.lit(True).alias("anchor"))
    runs = marked.select("run_id").distinct().withColumn("some", F.lit(True))
    rows = nodes_.join(marked, KEY, "left").join(runs, "run_id", "left").join(edges.select("edge_id", "cap"), "edge_id").join(impacts_norm.select(*KEY, "impact_norm"), KEY)
    return relieved(rows.withColumns({"anchor": F.coalesce("anchor", F.lit(False)), "some": F.col("some").isNotNull()}))


def relieved(rows: DataFrame) -> DataFrame:
    """rows: nodes with flow, cap, impact_norm; anchor: whether one counts as such; some: whether any of its run does."""
    over = scalar.excess("flow", "cap")
    keep = F.col("anchor") | (~F.col("some") & (over > 0))
    return rows.where(keep & (F.col("impact_norm") > 0) & (over > 0)).select(*KEY, (F.col("impact_norm") * over).alias("relief"))


def bpr_relief(nodes_: DataFrame, impacts_norm: DataFrame, edges: DataFrame) -> DataFrame:
    """Relief by the marginal delay of one vehicle less, on a log scale clipped at the 99th percentile of the positive margins (at least 1)."""
    rows = nodes_.join(edges.select("edge_id", "fft", "cap"), "edge_id")
    margin = scalar.soft_bpr("fft", "cap", "flow") - scalar.soft_bpr("fft", "cap", F.col("flow") - 1)
    rows = rows.withColumn("margin", F.round(margin, 9))
    at = order_statistic(rows.where("margin > 0"), ["run_id"], "margin", 99, "clip")
    rows = rows.join(F.broadcast(at), "run_id").join(impacts_norm.select(*KEY, "impact_norm"), KEY)
    score = scalar.log_share("margin", F.greatest("clip", F.lit(1.0))) * F.col("impact_norm")
    return rows.withColumn("relief", score).where("relief > 0").select(*KEY, "relief")


def stats(nodes_: DataFrame, arcs: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: nodes, arcs, largest out-degree, flow and load."""
    degree = arcs.groupBy("run_id", "src_edge", "src_time").agg(F.count("*").alias("d")).groupBy("run_id").agg(F.sum("d").alias("arcs"), F.max("d").alias("degree_max"))
    rows = nodes_.join(edges.select("edge_id", "cap"), "edge_id").withColumn("ratio", F.col("flow") / F.greatest("cap", F.lit(1)))
    per = rows.groupBy("run_id").agg(F.count("*").alias("nodes"), F.max("flow").alias("flow_max"), F.round(F.avg("flow"), 6).alias("flow_mean"), F.round(F.max("ratio"), 6).alias("ratio_max"), F.round(F.avg("ratio"), 6).alias("ratio_mean"))
    return per.join(degree, "run_id", "left").fillna(0, ["arcs", "degree_max"])


def slot_nodes(profile: DataFrame, width: int) -> DataFrame:
    """The largest flow in each slot of an edge, the later of equal ones."""
    slot = scalar.slot_of("time", width).alias("slot")
    return profile.groupBy("run_id", "edge_id", slot).agg(F.max_by(F.struct("time", "flow"), F.struct("flow", "time")).alias("m")).select("run_id", "edge_id", "slot", F.col("m.time").alias("time"), F.col("m.flow").alias("flow"))


def slot_arcs(trajectories: DataFrame, slots: DataFrame, edges: DataFrame, width: int, traffic: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Distinct arcs along trips and between consecutive slots of an edge, no loops; kind tells which."""
    w = Window.partitionBy("run_id", "trip_id").orderBy("pos")
    at = trajectories.withColumn("slot", scalar.slot_of("enter", width))
    along = at.select("run_id", F.col("edge_id").alias("src_edge"), F.col("slot").alias("src_slot"), F.lead("edge_id").over(w).alias("dst_edge"), F.lead("slot").over(w).alias("dst_slot"))
    along = along.where("dst_edge is not null and (src_edge <> dst_edge or src_slot <> dst_slot)").distinct().withColumn("kind", F.lit("route"))
    known = slots.select("run_id", "edge_id", "slot")
    along = along.join(known.toDF("run_id", "src_edge", "src_slot"), ["run_id", "src_edge", "src_slot"], "left_semi").join(known.toDF("run_id", "dst_edge", "dst_slot"), ["run_id", "dst_edge", "dst_slot"], "left_semi")
    e = Window.partitionBy("run_id", "edge_id").orderBy("slot")
    pairs = slots.withColumn("p", F.lag(F.struct("slot", "time", "flow")).over(e)).where("p.flow > 0").join(edges.select("edge_id", "fft", "cap"), "edge_id")
    felt = pairs.where(F.col("p.time") + traffic.column("fft", "cap", "p.flow") >= F.col("time"))
    felt = felt.select("run_id", F.col("edge_id").alias("src_edge"), F.col("p.slot").alias("src_slot"), F.col("edge_id").alias("dst_edge"), F.col("slot").alias("dst_slot"), F.lit("edge").alias("kind"))
    return along.select(felt.columns).unionAll(felt)


def slot_impacts(slots: DataFrame, arcs: DataFrame, edges: DataFrame, options: AlgorithmOptions = AlgorithmOptions(), traffic: TrafficOptions = TrafficOptions()) -> DataFrame:
    """The slot variant of impacts: pushed from the leaves, each step rounded half up, saturating; one run per task."""
    lam = options.lambda_percent
    rows = slots.join(edges.select("edge_id", "fft", "cap"), "edge_id").select("run_id", "edge_id", "slot", traffic.column("fft", "cap", "flow").alias("base"))

    def work(key: tuple, own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["edge_id", "slot"])
        number = {k: i for i, k in enumerate(zip(own.edge_id, own.slot, strict=True))}
        up: list[set[int]] = [set() for _ in number]
        out = [0] * len(number)
        for se, ss, de, ds in zip(links.src_edge, links.src_slot, links.dst_edge, links.dst_slot, strict=True):
            a, b = number[se, ss], number[de, ds]
            if a not in up[b]:
                up[b].add(a)
                out[a] += 1
        value = pushed(own.base.tolist(), up, out, lam)
        return pd.DataFrame({"run_id": own.run_id, "edge_id": own.edge_id, "slot": own.slot, "impact": value})

    return fresh(rows).groupBy("run_id").cogroup(fresh(arcs).groupBy("run_id")).applyInPandas(work, "run_id bigint, edge_id int, slot bigint, impact bigint")


def loaded(nodes_: DataFrame, edges: DataFrame, percentile: int) -> DataFrame:
    """Nodes whose load reaches the percentile of all loads of their run."""
    rows = nodes_.join(edges.select("edge_id", "cap"), "edge_id").withColumn("ratio", scalar.ratio_key("flow", "cap"))
    limit = order_statistic(rows, ["run_id"], "ratio", percentile, "theta")
    return rows.join(F.broadcast(limit), "run_id").where("ratio >= theta").select(*KEY)


def _width(options: AlgorithmOptions) -> int:
    return options.delta_compress if options.delta_compress > 0 else options.delta_initial if options.delta_initial > 0 else max(1, options.min_slot_width)


def represented(trips: Iterable[tuple], entries: dict[int, list[int]], marked: dict[int, list[int]], width: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Trips (trip, edges, enters, exits, in order) with the nodes that represent them; entries and marked: times per edge, ascending. Those that represent are marked for the trips after."""

    def mark(e: int, t: int) -> tuple[int, int]:
        known = marked.setdefault(e, [])
        if (k := bisect_left(known, t)) == len(known) or known[k] != t:
            known.insert(k, t)
        return e, t

    for trip, e, enter, leave in trips:
        first, last = enter[0], leave[-1]
        route = [mark(e[0], first)]
        best: dict[int, list] = {}
        for x, a, b in zip(e, enter, leave, strict=True):
            for w in range((a - first) // width, (b - 1 - first) // width + 1 if b > a else 0):
                lo, hi = max(a, first + w * width), min(b, first + (w + 1) * width, last)
                found = best.setdefault(w, [None, None])
                for kind, known in enumerate((marked, entries)):
                    times = known.get(x, ())
                    k = bisect_left(times, lo)
                    if k < len(times) and times[k] < hi and (found[kind] is None or times[k] < found[kind][1]):
                        found[kind] = (x, times[k])
        for w in sorted(best):
            if (chosen := best[w][0] or best[w][1]) is not None and mark(*chosen) != route[-1]:
                route.append(chosen)
        if mark(e[-1], enter[-1]) != route[-1]:
            route.append((e[-1], enter[-1]))
        yield trip, route


def compressed_visits(trajectories: DataFrame, profile: DataFrame, anchors_: DataFrame, options: AlgorithmOptions = AlgorithmOptions()) -> DataFrame:
    """run_id, trip_id, place, edge_id, time: trips reduced to their first entry, one representative per window of ``delta_compress`` seconds (the earliest anchor
    on the way, else the earliest entry of anyone) and their last entry, without immediate repeats.

    What represents a trip is an anchor for the trips after it, so the trips of a run follow one another in one task; runs are the parallel axis.
    """
    width = _width(options)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("trip_id", "int"), ("pos", "int"), ("exit", "bigint"))]
    marks = profile.where("is_entry").select(*KEY, F.lit(0).alias("kind")).unionByName(anchors_.select(*KEY, F.lit(1).alias("kind")))
    stays = trajectories.select("run_id", "edge_id", F.col("enter").alias("time"), F.lit(2).alias("kind"), "trip_id", "pos", "exit")

    def work(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        lists: list[dict[int, list[int]]] = [{}, {}]
        for kind in (0, 1):
            rows = own[own.kind == kind].sort_values(["edge_id", "time"])
            for e, t in zip(rows.edge_id.tolist(), rows.time.tolist(), strict=True):
                lists[kind].setdefault(e, []).append(t)
        trips = own[own.kind == 2].sort_values(["trip_id", "pos"])
        trips = ((t, rows.edge_id.tolist(), rows.time.tolist(), rows.exit.astype("int64").tolist()) for t, rows in trips.groupby("trip_id", sort=True))
        out = [(key[0], trip, k, x, t) for trip, route in represented(trips, *lists, width) for k, (x, t) in enumerate(route)]
        return pd.DataFrame(out, columns=["run_id", "trip_id", "place", "edge_id", "time"])

    rows = marks.select(*KEY, "kind", *none).unionByName(stays)
    return rows.groupBy("run_id").applyInPandas(work, "run_id bigint, trip_id int, place int, edge_id int, time bigint")


def compressed_nodes(reduced: DataFrame, profile: DataFrame) -> DataFrame:
    """The nodes that represent trips, with the flow of the profile at their time."""
    at = reduced.select(*KEY).distinct()
    return at.join(profile.select(*KEY, "flow"), KEY).withColumn("original_flow", F.col("flow"))


def compressed_arcs(reduced: DataFrame) -> DataFrame:
    """Distinct arcs along the reduced trips, no loops."""
    w = Window.partitionBy("run_id", "trip_id").orderBy("place")
    rows = reduced.select("run_id", F.col("edge_id").alias("src_edge"), F.col("time").alias("src_time"), F.lead("edge_id").over(w).alias("dst_edge"), F.lead("time").over(w).alias("dst_time"))
    return rows.where("dst_edge is not null and (src_edge <> dst_edge or src_time <> dst_time)").distinct()


#: Stays of the largest run whose graph is built in one task; so many take half a gigabyte there.
RUN_STAYS = 150_000

GRAPH = "run_id bigint, kind string, edge_id int, time bigint, flow bigint, is_entry boolean, node boolean, source boolean, score bigint, base bigint, impact bigint, fft bigint, cap bigint, some boolean, clip bigint, unit bigint, theta bigint, dst_edge int, dst_time bigint"


def run_graph(trajectories: DataFrame, edges: DataFrame, options: AlgorithmOptions = AlgorithmOptions(), roads: TrafficOptions = TrafficOptions(), compressed: bool = False) -> DataFrame:
    """The same profile, anchors, nodes, arcs and impacts by one pass per run, for runs whose stays fit a task: one job instead of dozens.

    kind ``at``: steps of the profile (score of anchors, else -1; node: whether one of the graph; base and impact of nodes; source: loaded without loaded ancestors),
    ``route`` and ``edge``: arcs. Of the run: some (has anchors among its nodes), clip, unit, theta (order statistics of impacts, delays, loads).
    """
    net = _shared(edges)
    width, threshold, wide = options.anchor_window, options.anchor_threshold, _width(options)
    rank = lambda xs, p: sorted(xs)[max(0, min(100, p)) * (len(xs) - 1) // 100] if xs else 0

    def work(own: pd.DataFrame) -> pd.DataFrame:
        n = net.value
        run = int(own.run_id.iloc[0])
        own = own.sort_values(["trip_id", "pos"])
        trip, edge, enter, leave, last = (own[c].tolist() for c in ("trip_id", "edge_id", "enter", "exit", "last"))
        steps: dict[int, dict[int, list]] = defaultdict(dict)
        for e, a, b, end in zip(edge, enter, leave, last, strict=True):
            at = steps[e].setdefault(a, [0, False])
            at[0], at[1] = at[0] + 1, True
            if roads.release_last_edge or not end:
                steps[e].setdefault(b, [0, False])[0] -= 1
        rows, place = [], {}  # edge, time, flow, is_entry, score
        for e in sorted(steps):
            changes, cap = steps[e], max(1, int(n.cap[n.index[e]]))
            times, flows, area, flow, j, first = sorted(changes), [], [], 0, 0, None
            for i, t in enumerate(times):
                area.append(area[-1] + flow * (t - times[i - 1]) if i else 0)
                flow += changes[t][0]
                flows.append(flow)
                score = -1
                if changes[t][1] and first is None:
                    first, score = t, 0
                elif changes[t][1]:
                    since = max(times[0], t - width)
                    while j + 1 < len(times) and times[j + 1] <= since:
                        j += 1
                    lasted = t - since
                    dev = abs(flow * lasted - (area[i] - area[j] - flows[j] * (since - times[j])))
                    if lasted > 0 and dev * 100 >= cap * lasted * threshold:
                        score = dev * 1_000_000 // (cap * lasted)
                place[e, t] = len(rows)
                rows.append((e, t, flow, changes[t][1], score))
        ends = [k for k in range(1, len(trip)) if trip[k] != trip[k - 1]] if trip else []
        if compressed:
            lists: list[dict[int, list[int]]] = [{}, {}]
            for e, t, _, entry, score in rows:
                if entry:
                    lists[0].setdefault(e, []).append(t)
                if score >= 0:
                    lists[1].setdefault(e, []).append(t)
            trips = ((trip[a], edge[a:b], enter[a:b], leave[a:b]) for a, b in zip([0, *ends], [*ends, len(trip)], strict=True))
            routes = [[place[x] for x in route] for _, route in represented(trips, *lists, wide)]
            on = {i for route in routes for i in route}
            along = dict.fromkeys((a, b) for route in routes for a, b in zip(route, route[1:], strict=False) if a != b)
            along = Counter(along.keys())
        else:
            at = [place[x] for x in zip(edge, enter, strict=True)]
            on, cuts = set(at), set(ends)
            along = Counter((at[k - 1], at[k]) for k in range(1, len(at)) if k not in cuts)
        nodes_ = sorted(on)  # by edge and time, as the rows are
        number = {i: k for k, i in enumerate(nodes_)}
        road = [n.index[rows[i][0]] for i in nodes_]
        fft, cap = n.fft[road].tolist(), n.cap[road].tolist()
        base = [roads.delay(f, c, rows[i][2]) for i, f, c in zip(nodes_, fft, cap, strict=True)]
        felt = [(a, b) for k, (a, b) in enumerate(zip(nodes_, nodes_[1:], strict=False)) if rows[a][0] == rows[b][0] and rows[a][1] + base[k] > rows[b][1] and (a, b) not in along]
        children: list[list[int]] = [[] for _ in nodes_]
        for a, b in (*along.elements(), *felt):
            children[number[a]].append(number[b])
        impact = propagated(base, children, options.lambda_percent)
        ratio = [rows[i][2] * 1_000_000 // max(1, c) for i, c in zip(nodes_, cap, strict=True)]
        clip, unit, theta = rank([max(0, x) for x in impact], 99), rank([max(1, x) for x in base], 90), rank(ratio, options.theta_percentile)
        hot = {k for k, x in enumerate(ratio) if x > theta}
        below, left = set(), list(hot)
        while left:
            for k in children[left.pop()]:
                if k not in below:
                    below.add(k)
                    left.append(k)
        some = any(rows[i][4] > 0 for i in nodes_)
        told = pd.DataFrame(rows, columns=["edge_id", "time", "flow", "is_entry", "score"]).assign(kind="at", node=False, source=False, base=0, impact=0, fft=0, cap=0, dst_edge=0, dst_time=0)
        for c, x in (("node", True), ("source", [k in hot and k not in below for k in range(len(nodes_))]), ("base", base), ("impact", impact), ("fft", fft), ("cap", cap)):
            told.loc[nodes_, c] = x
        arcs = [("route", a, b) for a, b in along.elements()] + [("edge", a, b) for a, b in felt]
        arcs = [(kind, *rows[a][:2], *rows[b][:2]) for kind, a, b in arcs]
        links = pd.DataFrame(arcs, columns=["kind", "edge_id", "time", "dst_edge", "dst_time"]).assign(flow=0, is_entry=False, node=False, source=False, score=-1, base=0, impact=0, fft=0, cap=0)
        both = pd.concat([told, links], ignore_index=True) if arcs else told
        return both.assign(run_id=run, some=some, clip=clip, unit=unit, theta=theta)[[c.split()[0] for c in GRAPH.split(", ")]]

    return trajectories.groupBy("run_id").applyInPandas(work, GRAPH)


def told_nodes(told: DataFrame) -> DataFrame:
    """The nodes of ``run_graph`` with their normalised impacts."""
    rows = told.where("node").withColumns({"original_flow": F.col("flow"), "impact_norm": scalar.log_share(F.greatest("impact", F.lit(0)), "clip")})
    return rows.withColumns({"anchor": F.col("score") > 0, "ratio": scalar.ratio_key("flow", "cap")})


def told_penalties(rows: DataFrame, options: AlgorithmOptions = AlgorithmOptions()) -> DataFrame:
    """What ``penalties`` gives, with the flow, of nodes that are told with their run's statistics."""
    return rows.select(*KEY, "impact", _penalty(options).alias("penalty"), "flow")
