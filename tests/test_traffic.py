"""Golden cases and an independent sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from wayflow.functions import scalar
from wayflow.model import AlgorithmOptions, TrafficOptions
from wayflow.operators import dependency, paths, selection, timeline, traffic
from wayflow.plans import loops

EDGES, ROUTES = "edge_id int, src int, dst int, fft bigint, cap int", "run_id bigint, trip_id int, depart bigint, edges array<int>"


def test_delay_table(spark):
    rows = spark.createDataFrame([(f,) for f in (0, 10, 11, 12, 15, 20, 50, 500)], "f int")
    got = rows.select(scalar.bpr(F.lit(60), F.lit(10), "f", max_time=3600, min_capacity=5).alias("a"), scalar.bpr(F.lit(60), F.lit(10), "f").alias("b"), scalar.bpr(F.lit(60), F.lit(5), "f", min_capacity=5).alias("c")).collect()
    assert [r.a for r in got] == [60, 60, 74, 79, 106, 204, 3600, 3600]
    assert [r.b for r in got][-2:] == [5685, 56250060]
    assert all(r.c == 60 for r in got)
    assert [TrafficOptions().delay(60, 10, f) for f in (0, 10, 11, 12, 15, 20, 50, 500)] == [r.b for r in got]
    huge = spark.range(1).select(scalar.bpr(F.lit(10**9), F.lit(1), F.lit(2 * 10**9)).alias("x")).first().x
    assert huge == 2**63 - 1 == TrafficOptions().delay(10**9, 1, 2 * 10**9)


@pytest.mark.parametrize("n, order", [(3, [0, 2, 1]), (5, [0, 4, 1, 2, 3]), (8, [0, 7, 1, 2, 3, 4, 5, 6]), (20, [0, 19, 1, 17, 18, *range(2, 17)])])
def test_heap_order(n, order):
    out = traffic.schedules([[0]] * n, [0] * n, [10], [1], TrafficOptions(tie_order="heap16"))
    assert sorted(range(n), key=lambda k: out[k][1]) == order


def test_congested_chain():
    heap = traffic.schedules([[0, 1]] * 6, [0] * 6, [10, 10], [2, 2], TrafficOptions(max_time=3600, tie_order="heap16"))
    assert heap == [[0, 10, 20], [0, 10, 20], [0, 18, 36], [0, 34, 68], [0, 69, 138], [0, 10, 20]]
    assert sum(t[-1] for t in heap) == 302
    assert sorted(traffic.schedules([[0, 1]] * 6, [0] * 6, [10, 10], [2, 2], TrafficOptions(max_time=3600))) == sorted(heap)


def small(spark):
    ends = [(0, 1), (1, 5), (0, 2), (2, 5), (0, 3), (3, 4), (4, 5), (1, 2), (2, 3)]
    edges = spark.createDataFrame([(i, a, b, 1, 1) for i, (a, b) in enumerate(ends)], EDGES)
    trips = spark.createDataFrame([(0, i, 0, 5, 0) for i in range(6)], "run_id bigint, trip_id int, origin int, destination int, depart bigint")
    return edges, trips


def test_small_network(spark):
    edges, trips = small(spark)
    roads = TrafficOptions(min_bpr_capacity=5)
    out = loops.run(edges, trips, AlgorithmOptions(max_iterations=3), roads)
    assert [r.total_travel_time for r in out.by_iteration().orderBy("iteration").collect()] == [12, 12]
    assert {tuple(r.edges) for r in out.final.collect()} == {(0, 1)}
    profile = traffic.profile(traffic.simulate(out.final, edges, roads))
    assert sorted(tuple(r) for r in profile.collect()) == [(0, 0, 0, 6, True), (0, 0, 1, 0, False), (0, 1, 1, 6, True)]


def random_routes(seed):
    r = random.Random(seed)
    edges = [(e, e, e + 1, r.randint(1, 5), r.randint(1, 3)) for e in range(6)]
    routes = []
    for run in range(2):
        for k in range(20):
            a = r.randint(0, 5)
            routes.append((run, k, r.randint(0, 4), list(range(a, r.randint(a, 5) + 1)) if r.random() < 0.9 else []))
    return edges, routes


def test_rounds_equal_simulation(spark):
    edges, routes = random_routes(4)
    e, r = spark.createDataFrame(edges, EDGES), spark.createDataFrame(routes, ROUTES)
    key = lambda df: sorted(tuple(x) for x in df.select("run_id", "trip_id", "pos", "edge_id", "enter", "exit", "last").collect())
    exact = key(traffic.simulate(r, e))
    assert exact == key(traffic.simulate_by_rounds(r, e)) and len(exact) > 50
    # the model: one event at a time in order of (time, trip)
    for run in (0, 1):
        own = {k: (d, p) for q, k, d, p in routes if q == run and p}
        flow, at, now, want = {}, {k: 0 for k in own}, {k: d for k, (d, _) in own.items()}, []
        while at:
            k = min(at, key=lambda k: (now[k], k))
            p = own[k][1]
            if at[k] == len(p):
                del at[k]
                continue
            if at[k]:
                flow[p[at[k] - 1]] -= 1
            x = p[at[k]]
            f = flow.get(x, 0)
            flow[x] = f + 1
            d = TrafficOptions().delay(edges[x][3], edges[x][4], f)
            want.append((run, k, at[k], x, now[k], now[k] + d, at[k] == len(p) - 1))
            at[k], now[k] = at[k] + 1, now[k] + d
        assert sorted(want) == [x for x in exact if x[0] == run]


def test_timeline_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(timeline, "BUCKET_S", 7)
    for f in (timeline.running_sum, timeline.as_of, timeline.interval_join, timeline.areas):
        monkeypatch.setattr(f, "__defaults__", tuple(7 if d == 21600 else d for d in f.__defaults__))
    r = random.Random(2)
    stays = [(r.randint(0, 1), a, a + r.randint(1, 30)) for a in (r.randint(0, 100) for _ in range(80))]
    steps = timeline.occupancy(spark.createDataFrame(stays, "k int, enter bigint, exit bigint"), ["k"]).collect()
    flow = lambda k, t: sum(a <= t < b for q, a, b in stays if q == k)
    assert all(s.flow == flow(s.k, s.time) for s in steps)
    df = spark.createDataFrame(steps)
    probes = [(i, r.randint(0, 2), r.randint(-5, 140)) for i in range(60)]
    got = timeline.as_of(spark.createDataFrame(probes, "i int, k int, time bigint"), df, ["k"], "time", "flow").collect()
    assert len(got) == 60 and all(x.flow == flow(x.k, x.time) for x in got)
    first = {k: min(s.time for s in steps if s.k == k) for k in (0, 1)}
    area = lambda k, t: sum(flow(k, x) for x in range(first[k], t))
    assert all(x.area == area(x.k, x.time) for x in timeline.areas(df, ["k"]).collect())
    for x in timeline.trailing_areas(df, ["k"], 20).collect():
        start = max(first[x.k], x.time - 20)
        assert (x.duration, x.window_area) == (x.time - start, area(x.k, x.time) - area(x.k, start))


def test_components_and_impacts(spark):
    nodes = [(0, e, t, 1, 1) for e, t in [(0, 0), (1, 5), (2, 9), (3, 0), (4, 4), (9, 9)]]
    arcs = [(0, 0, 0, 1, 5), (0, 0, 0, 1, 5), (0, 1, 5, 2, 9), (0, 3, 0, 4, 4), (0, 4, 4, 2, 9)]
    n = spark.createDataFrame(nodes, "run_id bigint, edge_id int, time bigint, flow bigint, original_flow bigint")
    a = spark.createDataFrame(arcs, "run_id bigint, src_edge int, src_time bigint, dst_edge int, dst_time bigint")
    label = {(r.edge_id, r.time): r.component for r in dependency.components(n, a).collect()}
    assert len(label) == 6 and len({label[k] for k in label if k != (9, 9)}) == 1 and label[9, 9] not in {label[0, 0]}
    edges = spark.createDataFrame([(e, 0, 1, 100, 5) for e in (0, 1, 2, 3, 4, 9)], EDGES)
    got = {(r.edge_id, r.time): r.impact for r in dependency.impacts(n, a, edges).collect()}
    # node (2, 9) has two parents; node (1, 5) counts twice for (0, 0), each half
    one = 100 + (100 // 2) * 45 // 100
    assert got == {(2, 9): 100, (1, 5): one, (4, 4): one, (0, 0): 100 + (one // 2 * 2) * 45 // 100, (3, 0): 100 + one * 45 // 100, (9, 9): 100}


def test_order_statistic_and_cover(spark):
    r = random.Random(8)
    rows = [(k, r.choice([r.randint(0, 50), r.randint(0, 10**6)]), i) for k in (1, 2) for i in range(300)] + [(3, 7, 0), (1, None, 999)]
    df = spark.createDataFrame(rows, "k int, v bigint, i int")
    for p in (0, 37, 50, 99, 100):
        got = {x.k: x.q for x in dependency.order_statistic(df, ["k"], "v", p, "q").collect()}
        for k in (1, 2, 3):
            v = sorted(b for a, b, _ in rows if a == k and b is not None)
            assert got[k] == v[p * (len(v) - 1) // 100]
    scored = df.where("v > 0").select("k", "i", F.col("v").cast("double").alias("s"))
    got = {(x.k, x.i) for x in selection.prefix_cover(scored, ["k"], "s", "i", 60).collect()}
    want = set()
    for k in (1, 2, 3):
        own = sorted(((-b, i) for a, b, i in rows if a == k and b), key=lambda x: x)
        total, run = sum(-b for b, _ in own), 0
        for b, i in own:
            if run < total * 60 / 100:
                want.add((k, i))
            run -= b
    assert got == want


def test_paths(spark):
    r = random.Random(1)
    edges = [(i, r.randint(0, 14), r.randint(0, 14), r.randint(1, 9), 5) for i in range(45)]
    e = spark.createDataFrame(edges, EDGES)
    dist = {(a, a): 0 for a in range(15)}
    for a, b, w in [(s, d, f) for _, s, d, f, _ in edges]:
        dist[a, b] = min(dist.get((a, b), 10**9), w)
    for m in range(15):
        for a in range(15):
            for b in range(15):
                if (a, m) in dist and (m, b) in dist:
                    dist[a, b] = min(dist.get((a, b), 10**9), dist[a, m] + dist[m, b])
    trips = spark.createDataFrame([(0, i, i % 15, (i * 7) % 15, 0) for i in range(60)], "run_id bigint, trip_id int, origin int, destination int, depart bigint")
    found = paths.shortest_routes(e, trips).collect()
    assert len(found) == 60
    for x in found:
        want = dist.get((x.origin, x.destination), 0)
        assert x.tt == want == sum(edges[k][3] for k in x.edges)
    routed = paths.shortest_routes(e, trips).where("size(edges) > 0")
    assert all(x.contiguous for x in paths.valid(routed, e).collect())
    sources = spark.createDataFrame([(0,), (3,)], "source int")
    want = {(a, b): d for (a, b), d in dist.items() if a in (0, 3)}
    assert {(x.source, x.node): x.dist for x in paths.distances(e, sources).collect()} == want
    assert {(x.source, x.node): x.dist for x in paths.relaxed_distances(e, sources).collect()} == want
    ways = paths.diverse_routes(e, trips, 3, 60)
    assert ways.count() == 60
    assert all(x.contiguous for x in paths.valid(ways.where("size(edges) > 0"), e).collect())
