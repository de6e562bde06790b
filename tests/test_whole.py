"""Registered queries and their operators do the whole job: every source, every round."""

import random

import pytest
from pyspark.sql import functions as F

from wayflow import session
from wayflow.functions import scalar
from wayflow.model import TRAJECTORY, AlgorithmOptions, TrafficOptions
from wayflow.operators import baselines, dependency, paths, selection, traffic
from wayflow.operators.live import Live
from wayflow.plans import reference


EDGES = "edge_id int, src int, dst int, fft bigint, cap int"


def write_tables(spark, folder, seed=3, nodes=14, far=25):
    """road_edges and query_candidates of a random network; returns (edges, trips) and writes both."""
    r = random.Random(seed)
    edges = [(i, r.randint(0, nodes - 1), r.randint(0, nodes - 1), r.randint(far, 3 * far), 80) for i in range(3 * nodes)]
    trips = [(i, r.randint(0, nodes - 1), r.randint(0, nodes - 1), r.randint(0, 3) * 86400 + r.randint(0, 600)) for i in range(4 * nodes)]
    spark.createDataFrame(edges, "edge_id int, from_node int, to_node int, free_flow_time bigint, capacity int").write.parquet(f"{folder}/road_edges.parquet")
    spark.createDataFrame(trips, "candidate_id bigint, origin int, destination int, departure_abs_seconds bigint").write.parquet(f"{folder}/query_candidates.parquet")
    return edges, trips


def all_distances(edges, nodes=14):
    """Floyd and Warshall."""
    dist = {(a, a): 0 for a in range(nodes)}
    for _, a, b, w, _ in edges:
        dist[a, b] = min(dist.get((a, b), 10**9), w)
    for m in range(nodes):
        for a in range(nodes):
            for b in range(nodes):
                if (a, m) in dist and (m, b) in dist:
                    dist[a, b] = min(dist.get((a, b), 10**9), dist[a, m] + dist[m, b])
    return dist


def test_bounded_from_every_origin(spark, tmp_path):
    edges, trips = write_tables(spark, tmp_path)
    origins = {o for _, o, _, _ in trips}
    assert max(origins) > 8
    got = {(x.source, x.node): x.dist for x in reference.p_bounded(spark, str(tmp_path)).collect()}
    assert got == {(a, b): d for (a, b), d in all_distances(edges).items() if a in origins and d <= 150}


@pytest.mark.parametrize("name", [*(f"r_{n}" for n in reference.loops.LOOPS), "r_slots"])
def test_loops_run_all_rounds(spark, tmp_path, monkeypatch, name):
    write_tables(spark, tmp_path)
    seen = []

    def run(*args):
        seen.extend(a.max_iterations for a in args if isinstance(a, reference.AlgorithmOptions))
        return reference.loops.Result(None, None, [None])

    for f in ("run_named", "slot_loop"):
        monkeypatch.setattr(reference.loops, f, run)
    reference.QUERIES[name](spark, str(tmp_path))
    assert seen == [reference.AlgorithmOptions().max_iterations] == [5]


def test_priced_long_trip_keeps_lambda(spark):
    """A chain longer than the budget, then a short way that grows dear and a way round it; lambda doubled 40 times would hide that."""
    n = 30
    edges = spark.createDataFrame([*((i, i, i + 1, 1, 1) for i in range(n)), (90, 100, 102, 10, 1), (91, 100, 101, 5, 1), (92, 101, 102, 6, 1)], EDGES)
    trips = spark.createDataFrame([(0, 0, 0, n, 0), *((0, k, 100, 102, k) for k in (1, 2, 3))], "run_id bigint, trip_id int, origin int, destination int, depart bigint")
    few = {r.trip_id: r.asDict() for r in baselines.priced_routes(trips, edges, states=20).collect()}
    assert [few[k]["edges"] for k in range(4)] == [list(range(n)), [90], [90], [91, 92]]
    assert [few[k]["exhausted"] for k in range(4)] == [True, False, False, False]
    whole = {r.trip_id: r for r in baselines.priced_routes(trips, edges).collect()}
    assert whole[0].edges == list(range(n)) and not whole[0].exhausted


ARCS = "run_id bigint, src_edge int, src_time bigint, dst_edge int, dst_time bigint, kind string"
NODES = "run_id bigint, edge_id int, time bigint, flow bigint, original_flow bigint"
VISITS = "run_id bigint, trip_id int, edge_id int, time bigint"


def test_flow_floor_goes_on_after_refusals(spark):
    """Trip 0 is taken; 1 to 3 hold a node that has lost too much and are refused, which ends the round before trip 4. Without trip 0 their shared edge is faster, and 4 comes first."""
    edges = spark.createDataFrame([(0, 0, 1, 10, 1), (1, 0, 1, 100, 9), *((e, 0, 1, 10, 9) for e in (2, 3, 4)), (5, 0, 1, 200, 9)], EDGES)
    on = {0: [0, 1], 1: [0, 2], 2: [0, 3], 3: [0, 4], 4: [5]}
    flow = {0: (4, 4), 1: (2, 2), 2: (1, 4), 3: (1, 4), 4: (1, 4), 5: (2, 2)}
    visits = spark.createDataFrame([(0, t, e, 0) for t, es in on.items() for e in es], VISITS)
    nodes = spark.createDataFrame([(0, e, 0, f, o) for e, (f, o) in flow.items()], NODES)
    arcs = spark.createDataFrame([], ARCS)
    got = selection.by_flow_floor(visits, nodes, arcs, edges, 50).orderBy("place").collect()
    assert [(r.trip_id, r.place) for r in got] == [(0, 0), (4, 1)]
    # only edge 2 is watched: 1 alone is refused, all others go
    got = selection.by_flow_floor(visits, nodes, arcs, edges, 50, nodes.where("edge_id = 2")).collect()
    assert {r.trip_id for r in got} == {0, 2, 3, 4}


def test_floor_is_rounded_down(spark):
    """Of half of one vehicle none need stay, of half of three one: one trip of one goes, two of three."""
    edges = spark.createDataFrame([(0, 0, 1, 10, 9), (1, 0, 1, 10, 9)], EDGES)
    visits = spark.createDataFrame([(0, 0, 0, 0), *((0, t, 1, 0) for t in (1, 2, 3))], VISITS)
    nodes = spark.createDataFrame([(0, 0, 0, 1, 1), (0, 1, 0, 3, 3)], NODES)
    got = selection.by_flow_floor(visits, nodes, spark.createDataFrame([], ARCS), edges, 50).collect()
    assert {r.trip_id for r in got} == {0, 1, 2}


def test_batches_count_loads(spark):
    """What a trip meets in a batch is the number of its trips on every node: 1, 2 and 3 vehicles on a node count as such."""
    edges = spark.createDataFrame([(e, 0, 1, 10, 1) for e in (1, 2, 3)], EDGES)
    on = {0: [1, 2, 3], 1: [1, 2, 3], 2: [1, 2], 3: [1]}
    visits = spark.createDataFrame([(0, t, e, 0) for t, es in on.items() for e in es], VISITS)
    nodes = spark.createDataFrame([(0, e, 0, 5, 5) for e in (1, 2, 3)], NODES)
    chosen = spark.createDataFrame([(0, t) for t in on], "run_id bigint, trip_id int")
    got = {r.trip_id: r.batch for r in selection.batches(chosen, visits, nodes, edges, 90, 100).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_live_graph_leaves_and_joins():
    """Edge 0 at 0, 5 and 50 with a delay of 10: 0 is felt at 5. Without the vehicle at 5 its arcs go, and 0 meets 50, which it doesn't reach."""
    live = Live([0, 0, 0, 1], [0, 5, 50, 60], [1, 1, 2, 1], [10] * 4, [9] * 4, [(1, 3), (1, 3), (2, 3)])
    # node 3 has three parents, as 1 leads to it twice; each gets 3, and 1 twice
    one = 10 + (3 + 3) * 45 // 100
    assert live.impacts(45) == [10 + one * 45 // 100, one, 10 + 3 * 45 // 100, 10]
    live.remove([1])
    assert live.flow == [1, 0, 2, 1] and not live.alive[1] and live.into[3] == {2}
    assert live.impacts(45) == [10, 0, 10 + 10 * 45 // 100, 10]
    live.remove([1])
    live.insert([0, 1, 2, 3])
    assert live.flow == [2, 0, 3, 2] and dict(live.out[2]) == {3: 1} and live.original == [1, 1, 2, 1]


def test_exact_compression(spark):
    """Windows of 10: trip 0 is represented by its entries, which are anchors for the trips after it."""
    trajectories = spark.createDataFrame([(0, 0, 0, 7, 0, 12, False), (0, 0, 1, 8, 12, 30, True), (0, 1, 0, 8, 9, 40, True)], TRAJECTORY)
    profile = spark.createDataFrame([(0, 7, 0, 1, True), (0, 8, 9, 1, True), (0, 8, 11, 1, True), (0, 8, 12, 2, True)], "run_id bigint, edge_id int, time bigint, flow bigint, is_entry boolean")
    anchors = spark.createDataFrame([], "run_id bigint, edge_id int, time bigint, score bigint")
    got = dependency.compressed_visits(trajectories, profile, anchors, AlgorithmOptions(delta_compress=10))
    assert sorted((r.trip_id, r.place, r.edge_id, r.time) for r in got.collect()) == [(0, 0, 7, 0), (0, 1, 8, 12), (1, 0, 8, 9)]
    later = trajectories.where("trip_id = 0").unionByName(spark.createDataFrame([(0, 1, 0, 7, 1, 10, False), (0, 1, 1, 8, 10, 40, True)], TRAJECTORY))
    got = dependency.compressed_visits(later, profile.unionByName(spark.createDataFrame([(0, 7, 1, 2, True), (0, 8, 10, 1, True)], profile.schema)), anchors, AlgorithmOptions(delta_compress=10))
    # the representative of trip 0 on edge 8, not the entry at 11 of someone else, and then its own last entry
    assert sorted((r.place, r.edge_id, r.time) for r in got.where("trip_id = 1").collect()) == [(0, 7, 1), (1, 8, 12), (2, 8, 10)]


def test_gate_of_100_is_none(spark):
    assert spark.range(1).select(scalar.gate(F.lit(0.1), 100).alias("x"), scalar.gate(F.lit(0.75), 50).alias("y"), scalar.gate(F.lit(0.1), -5).alias("z")).first()[:] == (1.0, 0.5, 1.0)


def test_every_destination(spark, tmp_path):
    edges, trips = write_tables(spark, tmp_path, nodes=24, far=100)
    ends = {d for _, _, d, _ in trips}
    assert len(ends) > 20
    dist = all_distances(edges, 24)
    got = lambda q: {(x.source, x.node): x.dist for x in q(spark, str(tmp_path)).collect()}
    assert got(reference.p_reverse) == {(b, a): d for (a, b), d in dist.items() if b in ends}
    assert got(reference.p_range) == {(a, b): d for (a, b), d in dist.items() if a in ends and 300 <= d <= 600}
    assert got(reference.p_relaxed) == {(a, b): d for (a, b), d in dist.items() if a in ends}


def test_sources_by_walk_and_by_rounds(spark):
    """0 -> 1 -> 2 -> 3 with 1 and 3 loaded, and 4 loaded alone: 1 and 4 are sources."""
    edges = spark.createDataFrame([(e, 0, 1, 10, 1) for e in range(5)], EDGES)
    nodes = spark.createDataFrame([(0, e, e, f, f) for e, f in enumerate([1, 9, 1, 9, 9])], NODES)
    arcs = spark.createDataFrame([(0, e, e, e + 1, e + 1, "route") for e in range(3)], ARCS)
    visits = spark.createDataFrame([(0, e, e, e) for e in range(5)], VISITS)
    for by_rounds in (True, False, None):
        got = selection.source_congestion(visits, nodes, arcs, edges, 30, by_rounds).collect()
        assert sorted(r.trip_id for r in got) == [1, 4]


def test_cut_tables_do_not_multiply_sizes(spark):
    """The planner's size of a table that was cut from cut tables stays a plain number, and the rows stay what they were."""
    now = spark.range(20).select("id", (F.col("id") % 20).alias("a"))
    for _ in range(8):
        now = session.cut(now.join(now.select(F.col("a").alias("b"), F.col("id").alias("c")), F.col("id") == F.col("b")).select(F.col("c").alias("id"), "a"))
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64
    assert now.schema.simpleString() == "struct<id:bigint,a:bigint>" and sorted(map(tuple, now.collect())) == [(i, i) for i in range(20)]
    assert now.join(now, "id").count() == 20


def test_cut_sizes_within_reach_are_kept(spark):
    cut = session.cut(spark.range(20))
    assert cut._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() == 160


def test_loop_without_facts_has_the_same_totals(spark, tmp_path):
    write_tables(spark, tmp_path)
    em = reference.em
    edges, trips = em.edges(spark, str(tmp_path), em.CAP), em.trips(spark, str(tmp_path))
    done = [reference.loops.run_named("score_pruned", edges, trips, AlgorithmOptions(max_iterations=1), facts=f) for f in (True, False)]
    a, b = ({tuple(x) for x in d.by_iteration().collect()} for d in done)
    assert a == b and len(done[0].steps) == 1 and not done[1].steps


@pytest.mark.parametrize("most", [2_000_000, 1])
def test_component_sizes_label_only_trips_that_meet(spark, tmp_path, monkeypatch, most):
    r = random.Random(5)
    rows = [(i, f"X-{r.randint(0, 1)}", r.randint(0, 39), r.randint(0, 29), 1) for i in range(600)] + [(3, "X-0", 5, 5, 1), (3, "X-0", 5, 5, 1), (4, "X-0", 99, 5, 1), (None, "X-0", 6, 7, 1), (None, "X-0", 30, 8, 1)]
    spark.createDataFrame([(e, 1, 2, 10, 80) for e in range(40)] * 2, "edge_id int, from_node int, to_node int, free_flow_time bigint, capacity int").write.parquet(f"{tmp_path}/road_edges.parquet")
    spark.createDataFrame(rows, "id bigint, dataset string, edge_id int, time_sec bigint, flow int").write.parquet(f"{tmp_path}/tdg_nodes.parquet")
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    trips, nodes = {}, set()
    for i, d, e, t, _ in rows:
        if e < 40:
            trips.setdefault((d, None if i is None else i // 10), []).append((d, e, t))
            nodes.add((d, e, t))
    for own in trips.values():
        for x in own:
            root[find(x)] = find(own[0])
    size = {}
    for x in nodes:
        size[find(x)] = size.get(find(x), 0) + 1
    want = {d: (sum(k for x, k in size.items() if x[0] == d), sum(k * k for x, k in size.items() if x[0] == d)) for d in ("X-0", "X-1")}
    asked, labels = [], dependency.labels
    monkeypatch.setattr(dependency, "labels", lambda n, a: asked.append(n.count()) or labels(n, a))
    monkeypatch.setattr(dependency, "RUN_NODES", most)
    got = {f"X-{x.run_id}": (x.nodes, x.pairs) for x in reference.t_component_sizes(spark, str(tmp_path)).collect()}
    assert got == want
    assert asked[0] <= len(trips) < len(nodes)


@pytest.mark.parametrize("name", ["compressed", "gro"])
def test_routes_of_a_loop_keep_a_plain_size(spark, tmp_path, name):
    write_tables(spark, tmp_path)
    em = reference.em
    done = reference.loops.run_named(name, em.edges(spark, str(tmp_path), em.CAP), em.trips(spark, str(tmp_path)), AlgorithmOptions(max_iterations=1), facts=False)
    sizes = [t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() for t in (done.final, *done.totals)]
    assert len(sizes) == 3 and max(sizes) < 2**64


def jobs_of(spark, group, f):
    """What f returns, and how many jobs it started."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


@pytest.mark.parametrize("compressed, release_last", [(True, False), (False, True)])
def test_graph_in_one_task_equals_that_by_joins(spark, tmp_path, monkeypatch, compressed, release_last):
    write_tables(spark, tmp_path)
    em, loops, key = reference.em, reference.loops, dependency.KEY
    roads, options = TrafficOptions(release_last_edge=release_last), AlgorithmOptions(anchor_window=90, delta_compress=100)
    edges, trips = session.cut(em.edges(spark, str(tmp_path), em.CAP)), em.trips(spark, str(tmp_path))
    now = session.cut(traffic.simulate(loops.initial_routes(edges, trips), edges, roads))
    one, few = jobs_of(spark, f"one {compressed}", lambda: loops.graph_of(now, edges, options, roads, compressed))
    monkeypatch.setattr(dependency, "RUN_STAYS", 0)
    many, most = jobs_of(spark, f"many {compressed}", lambda: loops.graph_of(now, edges, options, roads, compressed))
    assert one.told is not None and many.told is None and few <= 10 < most
    rows = lambda t, columns: sorted(tuple(x) for x in t.select(*columns).collect())
    for name in ("profile", "anchors", "nodes", "arcs", "visits", "impacts", "normal", "relief"):
        a, b = getattr(one, name), getattr(many, name)
        assert a.dtypes == b.dtypes and rows(a, b.columns) == rows(b, b.columns), name
        assert not b.isEmpty(), name
    assert rows(one.told.where("ratio >= theta"), key) == rows(dependency.loaded(many.nodes, edges, options.theta_percentile), key)
    priced = dependency.penalties(many.impacts, many.nodes, edges, options, many.normal)
    assert rows(dependency.told_penalties(one.told, options), priced.columns) == rows(priced, priced.columns)
    by = [selection.source_congestion(many.visits, many.nodes, many.arcs, edges, options.theta_percentile), one.visits.join(one.told.where("source").select(*key), key, "left_semi").select("run_id", "trip_id").distinct()]
    assert rows(by[0], by[0].columns) == rows(by[1], by[0].columns)


def test_graph_of_no_stays(spark, tmp_path):
    edges = spark.createDataFrame([(0, 0, 1, 10, 1)], EDGES)
    g = reference.loops.graph_of(spark.createDataFrame([], TRAJECTORY), edges, AlgorithmOptions(), TrafficOptions(), True)
    assert g.nodes.isEmpty() and g.arcs.isEmpty() and g.relief.isEmpty() and g.visits.isEmpty()


def test_gro_in_few_jobs_keeps_totals_and_routes(spark, tmp_path, monkeypatch):
    write_tables(spark, tmp_path)
    em, loops = reference.em, reference.loops
    edges, trips = session.cut(em.edges(spark, str(tmp_path), em.CAP)), session.cut(em.trips(spark, str(tmp_path)))
    told = []
    monkeypatch.setattr(selection, "batches", lambda *a, f=selection.batches: told.append(a[6]) or f(*a))
    run = lambda: loops.run_named("gro", edges, trips, AlgorithmOptions(max_iterations=2), facts=False)
    one, few = jobs_of(spark, "gro in tasks", run)
    monkeypatch.setattr(dependency, "RUN_STAYS", 0)
    many, most = jobs_of(spark, "gro by joins", run)
    assert len(told) == 4 and all(h is not None for h in told[:2]) and told[2:] == [None, None]
    assert 2 * few < most
    rows = lambda t: sorted(tuple(x) for x in t.select(*sorted(t.columns)).collect())
    assert rows(one.by_iteration()) == rows(many.by_iteration())
    assert rows(one.final) == rows(many.final) and rows(one.final) != rows(one.initial)


def test_searches_of_initial_routes_are_spread(spark, monkeypatch):
    def told(net, key):
        def run(batches):
            from pyspark import TaskContext

            for b in batches:
                yield b.assign(edges=[[TaskContext.get().partitionId()]] * len(b), tt=0)[["origin", "destination", "edges", "tt"]]

        return run

    monkeypatch.setattr(paths, "_routes", told)
    edges = spark.createDataFrame([(0, 0, 1, 10, 1)], EDGES)
    trips = spark.createDataFrame([(0, t, t, 1, 0) for t in range(40)], "run_id bigint, trip_id int, origin int, destination int, depart bigint")
    assert len({r.edges[0] for r in paths.shortest_routes(edges, trips).collect()}) == 4
