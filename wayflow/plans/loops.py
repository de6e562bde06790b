"""Run loops: initial routes, then rounds of simulate, graph, select, batch, reroute, replace. Every round's routes are checkpointed."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayflow.model import AlgorithmOptions, TrafficOptions
from wayflow.operators import dependency, paths, reroute, selection, traffic
from wayflow.session import cut, fresh, release


@dataclass
class Result:
    initial: DataFrame
    final: DataFrame
    #: run_id, iteration, total_travel_time; one row more than iterations
    totals: list[DataFrame] = field(default_factory=list)
    #: a row per run and iteration, with the columns of the ablation facts that the loop knows
    steps: list[DataFrame] = field(default_factory=list)

    def by_iteration(self) -> DataFrame:
        return _stacked(self.totals)

    def facts(self) -> DataFrame:
        """Run, iteration and what was done in it; seconds are those of the whole iteration, in which all runs are worked on together."""
        return _stacked(self.steps)


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for t in parts[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


class Clock:
    """Seconds since the last reading, by name."""

    def __init__(self):
        self.at, self.read = time.monotonic(), {}

    def __call__(self, name: str) -> None:
        now = time.monotonic()
        self.read[name], self.at = round(now - self.at, 6), now


def _step(k: int, clock: Clock, known: dict, trips: DataFrame, pool: DataFrame, chosen: DataFrame, split: DataFrame | None, g: Graph, scores: DataFrame, before: DataFrame, after: DataFrame, options: AlgorithmOptions) -> DataFrame:
    by = lambda rows, name: rows.groupBy("run_id").agg(F.count("*").alias(name))
    rows = by(trips, "query_count").join(by(pool.select("run_id", "trip_id").distinct(), "candidate_count"), "run_id", "left").join(by(chosen, "selected_count"), "run_id", "left")
    rows = rows.join(by(g.nodes, "tdg_node_count"), "run_id", "left").join(by(g.nodes.select("run_id", "edge_id").distinct(), "tdg_edge_timeline_count"), "run_id", "left")
    picked = scores.join(chosen.select("run_id", "trip_id"), ["run_id", "trip_id"], "left_semi")
    for part, name in ((scores, "mean_all_query_impact_score"), (picked, "mean_selected_impact_score")):
        rows = rows.join(part.groupBy("run_id").agg(F.avg("score").alias(name)), "run_id", "left")
    if split is not None:
        rows = rows.join(split.groupBy("run_id").agg(F.countDistinct("batch").alias("batch_count")), "run_id", "left")
    else:
        rows = rows.withColumn("batch_count", F.lit(0).cast("bigint"))
    rows = rows.join(before.select("run_id", F.col("total_travel_time").alias("total_before")), "run_id", "left").join(after.select("run_id", F.col("total_travel_time").alias("total_after")), "run_id", "left")
    rows = rows.fillna(0, ["candidate_count", "selected_count", "tdg_node_count", "tdg_edge_timeline_count", "batch_count"])
    share = lambda c: F.col(c) / F.nullif(F.col("query_count"), F.lit(0))
    told = {**known, "iteration": k, "gamma": options.gamma, "candidate_theta": options.candidate_theta, "impact_weight": options.impact_weight, "selection_fraction": options.baseline_fraction, "random_seed": options.random_seed}
    fixed = {c: F.lit(v) for c, v in told.items()} | {c: F.lit(v) for c, v in clock.read.items()}
    total = sum(clock.read.values())
    return cut(rows.withColumns({"selected_fraction": share("selected_count"), "candidate_fraction": share("candidate_count"), "reduction": F.col("total_before") - F.col("total_after"), **fixed, "method_total_sec": F.lit(float(total))}))


def initial_routes(edges: DataFrame, trips: DataFrame) -> DataFrame:
    return paths.shortest_routes(edges, trips).select("run_id", "trip_id", "depart", "edges")


def _total(trajectories: DataFrame, iteration: int) -> DataFrame:
    return trajectories.groupBy("run_id").agg(F.sum(F.col("exit") - F.col("enter")).alias("total_travel_time")).withColumn("iteration", F.lit(iteration))


@dataclass
class Graph:
    """A traffic result and what is derived from it."""

    trajectories: DataFrame
    profile: DataFrame
    nodes: DataFrame
    arcs: DataFrame
    visits: DataFrame
    anchors: DataFrame
    impacts: DataFrame
    normal: DataFrame
    relief: DataFrame
    #: The nodes as ``run_graph`` tells them, where every run's graph was built in one task; it has further columns.
    told: DataFrame | None = None


def graph_of(trajectories: DataFrame, edges: DataFrame, options: AlgorithmOptions, roads: TrafficOptions, compressed: bool = False) -> Graph:
    """compressed: over the nodes that represent trips instead of all. In one task per run if every run, as counted, fits one; by joins and windows otherwise."""
    most = trajectories.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    if most <= dependency.RUN_STAYS:
        rows = cut(dependency.run_graph(trajectories, edges, options, roads, compressed))
        at, told = fresh(rows.where("kind = 'at'")), dependency.told_nodes(fresh(rows))
        key, steps = dependency.KEY, at.select(*dependency.KEY, "flow", "is_entry")
        arcs = fresh(rows.where("kind <> 'at'").selectExpr("run_id", "edge_id as src_edge", "time as src_time", "dst_edge", "dst_time", "kind"))
        own = lambda *columns: fresh(told.select(*key, *columns))
        nodes = own("flow", "original_flow")
        visits = cut(dependency.visits(trajectories, nodes))
        return Graph(trajectories, steps, nodes, arcs, visits, fresh(at.where("score >= 0").select(*key, "score")), own("base", "impact"), own("base", "impact", "impact_norm"), fresh(dependency.relieved(told)), told)
    profile = cut(traffic.profile(trajectories, release_last_edge=roads.release_last_edge))
    anchors = cut(dependency.anchors(profile, edges, options))
    if compressed:
        reduced = cut(dependency.compressed_visits(trajectories, profile, anchors, options))
        nodes = cut(dependency.compressed_nodes(reduced, profile))
        arcs = cut(dependency.joined_arcs(dependency.compressed_arcs(reduced), nodes, edges, roads))
    else:
        nodes = dependency.nodes(profile)
        arcs = cut(dependency.all_arcs(trajectories, nodes, edges, roads))
    impacts = cut(dependency.impacts(nodes, arcs, edges, options, roads))
    normal = cut(dependency.normalised(impacts))
    relief = cut(dependency.relief(nodes, normal, anchors, edges))
    return Graph(trajectories, profile, nodes, arcs, cut(dependency.visits(trajectories, nodes)), anchors, impacts, normal, relief)


def select(name: str, g: Graph, trips: DataFrame, edges: DataFrame, options: AlgorithmOptions, pool: DataFrame, roads: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Selection methods by name, from the trips of ``pool``."""
    visits = g.visits.join(pool, ["run_id", "trip_id"], "left_semi")
    if name in ("tdg", "tdg_anchor", "tdg_congestion"):
        watched = {"tdg_anchor": lambda: dependency.important(g.nodes, g.anchors), "tdg_congestion": lambda: dependency.loaded(g.nodes, edges, options.theta_percentile)}.get(name, lambda: None)()
        return selection.by_flow_floor(visits, g.nodes, g.arcs, edges, options.gamma, watched, options.lambda_percent, roads)
    if name == "tdg_excess_relief":
        return selection.by_excess_relief(visits, g.nodes, g.normal, g.relief, edges, options.gamma)
    if name == "tdg_bpr_relief":
        return selection.by_bpr_relief(visits, dependency.bpr_relief(g.nodes, g.normal, edges), options.gamma)
    if name == "score_top":
        return selection.score_top(visits, g.relief, options.candidate_theta)
    if name == "random":
        return selection.random_fraction(pool.join(trips, ["run_id", "trip_id"], "left_semi"), options.baseline_fraction, options.random_seed)
    if name == "most_delayed":
        free = paths.shortest_routes(edges, trips).select("run_id", "trip_id", "tt")
        return selection.most_delayed(g.trajectories.join(pool, ["run_id", "trip_id"], "left_semi"), free, options.baseline_fraction)
    raise ValueError(f"no selection method {name}")


def run(edges: DataFrame, trips: DataFrame, options: AlgorithmOptions = AlgorithmOptions(), roads: TrafficOptions = TrafficOptions(), *, candidates: str = "source_congestion", selector: str = "tdg", rerouter: str = "tdg", stop_early: bool = True, compressed: bool = False, facts: bool = True) -> Result:
    """trips: run_id, trip_id, origin, destination, depart. The last routes are the result, not the best.

    rerouter: ``tdg`` (priced, in batches), ``tdg_nobatch`` (priced, one batch) or ``normal`` (travel time alone). facts: whether the steps are recorded beside the totals.
    """
    clock = Clock()
    edges, trips = cut(edges), cut(trips)
    routes = first = cut(initial_routes(edges, trips))
    clock("initial_routes_sec")
    result = Result(first, first)
    now = cut(traffic.simulate(routes, edges, roads))
    clock("evaluate_before_sec")
    result.totals.append(cut(_total(now, 0)))
    known = {"selection_method": selector, "reroute_method": rerouter, "candidate_filter": candidates}
    for k in range(options.max_iterations):
        g = graph_of(now, edges, options, roads, compressed)
        release(edges.sparkSession)
        clock("tdg_prepare_sec")
        if g.told is not None and candidates == "source_congestion":
            pool = cut(g.visits.join(fresh(g.told.where("source").select(*dependency.KEY)), dependency.KEY, "left_semi").select("run_id", "trip_id").distinct())
        else:
            pool = cut(selection.candidates(candidates, trips=trips, visits=g.visits, nodes=g.nodes, arcs=g.arcs, edges=edges, relief=g.relief, options=options))
        clock("candidate_sec")
        # every iteration draws anew
        chosen = cut(select(selector, g, trips, edges, replace(options, random_seed=options.random_seed + k), pool, roads))
        clock("select_sec")
        if stop_early and chosen.isEmpty():
            result.totals.append(cut(_total(now, k + 1)))
            break
        ask, split = trips.join(chosen.select("run_id", "trip_id"), ["run_id", "trip_id"], "left_semi"), None
        if rerouter == "normal":
            new = reroute.reroute_plain(ask, g.profile, edges, roads)
        else:
            single = rerouter != "tdg"
            hot = None if g.told is None else fresh(g.told.where("ratio >= theta").select(*dependency.KEY))
            split = chosen.select("run_id", "trip_id", F.lit(0).alias("batch")) if single else cut(selection.batches(chosen, g.visits, g.nodes, edges, options.theta_percentile, options.conflict_threshold, hot))
            clock("batch_sec")
            if g.told is not None:
                priced = fresh(dependency.told_penalties(g.told, options))
            else:
                priced = cut(dependency.penalties(g.impacts, g.nodes, edges, options, g.normal).join(g.nodes.select(*dependency.KEY, "flow"), dependency.KEY))
            clock("normalize_sec")
            release(edges.sparkSession)
            new = reroute.reroute(ask.join(split, ["run_id", "trip_id"]), priced, g.arcs, edges, options, roads, one_batch=single)
        routes = cut(traffic.replaced(routes, cut(new)))
        clock("reroute_sec")
        now = cut(traffic.simulate(routes, edges, roads))
        clock("evaluate_after_sec")
        before = result.totals[-1]
        result.totals.append(cut(_total(now, k + 1)))
        if facts:
            scores = selection.route_scores(g.visits, g.impacts, "impact", distinct=False)
            result.steps.append(_step(k, clock, known, trips, pool, chosen, split, g, scores, before, result.totals[-1], options))
        del g, pool, chosen, ask, split, new
        priced = None
        release(edges.sparkSession)
        clock = Clock()
    result.final = routes
    return result


#: Loops by the names under which they are asked for: candidate filter, selector, rerouter.
LOOPS = {
    "gro": ("source_congestion", "tdg", "tdg"),
    "baseline": ("all", "random", "normal"),
    "tdg_selection_baseline": ("source_congestion", "tdg", "normal"),
    "tdg_reroute_baseline": ("all", "random", "tdg"),
    "score_pruned": ("score_top", "tdg_excess_relief", "tdg"),
    "compressed": ("score_top", "tdg_excess_relief", "tdg"),
}
#: Loops whose graph is the compressed one.
COMPRESSED = {"compressed"}
ALIASES = {"full": "gro", "random": "baseline", "selection": "tdg_selection_baseline", "reroute": "tdg_reroute_baseline", "score_top": "score_pruned"}


def run_named(name: str, edges: DataFrame, trips: DataFrame, options: AlgorithmOptions = AlgorithmOptions(), roads: TrafficOptions = TrafficOptions(), facts: bool = True) -> Result:
    name = ALIASES.get(name, name)
    pool, pick, way = LOOPS[name]
    return run(edges, trips, options, roads, candidates=pool, selector=pick, rerouter=way, compressed=name in COMPRESSED, facts=facts)


def unselected_total(routes: DataFrame, selected: DataFrame, edges: DataFrame, roads: TrafficOptions = TrafficOptions()) -> DataFrame:
    """Total travel time of the trips left when the selected ones stay at home."""
    return _total(traffic.simulate(routes.join(selected, ["run_id", "trip_id"], "left_anti"), edges, roads), 0)


def slot_loop(edges: DataFrame, trips: DataFrame, width: int = 600, options: AlgorithmOptions = AlgorithmOptions(), roads: TrafficOptions = TrafficOptions()) -> Result:
    """The loop over time slots instead of events."""
    routes = first = cut(initial_routes(edges, trips))
    result = Result(first, first)
    now = cut(traffic.simulate(routes, edges, roads))
    result.totals.append(_total(now, 0))
    for k in range(options.max_iterations):
        profile = cut(traffic.profile(now))
        slots = cut(dependency.slot_nodes(profile, width))
        arcs = cut(dependency.slot_arcs(now, slots, edges, width, roads))
        impact = cut(dependency.slot_impacts(slots, arcs, edges, options, roads))
        pool = selection.slot_candidates(slots, arcs, now, edges, width, options.theta_percentile)
        chosen = cut(selection.slot_select(now, slots, arcs, pool, edges, width, options.gamma, options.lambda_percent, roads))
        ask = trips.join(chosen, ["run_id", "trip_id"], "left_semi")
        routes = cut(traffic.replaced(routes, reroute.reroute_slots(ask, slots, impact, edges, width, options.impact_weight)))
        now = cut(traffic.simulate(routes, edges, roads))
        result.totals.append(_total(now, k + 1))
    result.final = routes
    return result
