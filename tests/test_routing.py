"""Greedy and priced routing against a plain reading of their rules, loops and sinks."""

import math
import random

import pytest

from wayflow.model import AlgorithmOptions, TrafficOptions, options_from
from wayflow.operators import baselines
from wayflow.operators.paths import Network
from wayflow.plans import loops
from wayflow.sources import readers, writers

EDGES = "edge_id int, src int, dst int, fft bigint, cap int"
TRIPS = "run_id bigint, trip_id int, origin int, destination int, depart bigint"


def test_stuck_trip_goes_on_and_is_counted(spark):
    """Trip 0 runs into a dead end at node 2 and takes the shortest way on, back through node 1; trip 1, a little later, meets it on edge 3."""
    ends = [(0, 0, 1, 1, 1), (1, 1, 2, 1, 1), (2, 2, 1, 1, 1), (3, 1, 3, 50, 1)]
    # from 2 the goal lies nearer over 2 -> 1 only, which is visited
    edges = spark.createDataFrame(ends, EDGES)
    trips = spark.createDataFrame([(0, 0, 0, 3, 0), (0, 1, 0, 3, 1), (0, 2, 3, 0, 0), (0, 3, 2, 2, 0)], TRIPS)
    got = {r.trip_id: r.edges for r in baselines.greedy_routes(trips, edges, TrafficOptions()).collect()}
    assert got == {0: [0, 3], 1: [0, 3], 2: [], 3: []}


def plain_detour(edges, prices, origin, destination, depart, limit):
    best = (math.inf, math.inf, None)
    stack = [(origin, depart, 0, 0.0, (), {origin})]
    while stack:
        u, now, spent, paid, path, seen = stack.pop()
        if u == destination:
            best = min(best, (paid, spent, path))
            continue
        for k, (_, a, b, w, _) in enumerate(edges):
            if a == u and b not in seen and spent + w <= limit:
                stack.append((b, now + w, spent + w, paid + prices.edge(k, now), (*path, k), seen | {b}))
    return best


def test_cheapest_detour_is_exact():
    r = random.Random(5)
    for _ in range(30):
        edges = [(i, r.randint(0, 6), r.randint(0, 6), r.randint(10, 90), r.randint(1, 4)) for i in range(16)]
        net = Network(*zip(*edges))
        prices = baselines.Prices(net, 60, 100)
        assert prices.scale == min(1 / e[4] for e in edges)
        for _ in range(30):
            prices.volume[r.randrange(16), r.randint(0, 4)] += 1
        left = net.tree(6, backward=True)[0]
        if 0 not in left:
            continue
        path, exhausted = baselines.cheapest_detour(net, prices, left, 0, 6, 30, left[0] * 2, 10**6)
        want = plain_detour(edges, prices, 0, 6, 30, left[0] * 2)
        assert not exhausted and prices.route(path, 30) == pytest.approx(want[0]) and sum(edges[k][3] for k in path) == want[1]
        assert baselines.cheapest_detour(net, prices, left, 0, 6, 30, left[0] * 2, 1)[1]


def test_priced_routes_spread_over_parallel_roads(spark):
    edges = spark.createDataFrame([(0, 0, 1, 100, 1), (1, 0, 1, 105, 1), (2, 0, 1, 120, 1)], EDGES)
    trips = spark.createDataFrame([(0, k, 0, 1, 0) for k in range(4)], TRIPS)
    got = {r.trip_id: r.edges for r in baselines.priced_routes(trips, edges).collect()}
    # the third road takes over a tenth more
    assert sorted(got.values()) == [[0], [0], [1], [1]]


def test_loops_make_facts_and_logs(spark):
    """Six trips over a short road that clogs and a longer one beside it."""
    edges = spark.createDataFrame([(0, 0, 1, 10, 1), (1, 1, 2, 10, 1), (2, 0, 3, 11, 1), (3, 3, 2, 11, 1)], EDGES)
    trips = spark.createDataFrame([(0, k, 0, 2, k // 2) for k in range(6)], TRIPS)
    done = loops.run_named("compressed", edges, trips, AlgorithmOptions(max_iterations=2))
    rows = writers.shaped(done.facts(), "ablation").orderBy("iteration").collect()
    assert rows and rows[0].query_count == 6 and 0 < rows[0].selected_count <= 6 and rows[0].total_before - rows[0].total_after == rows[0].reduction
    totals = [r.total_travel_time for r in done.by_iteration().orderBy("iteration").collect()]
    assert totals[0] == rows[0].total_before and totals[1] == rows[0].total_after
    assert min(totals[1:]) < totals[0], "rerouting helps"
    told = readers.log_metrics(writers.log_lines(done.facts().select("iteration", "selected_count", "total_after", "select_sec"), "done").selectExpr("'log' as source", "value"))
    assert {(r.iteration, r.metric): r.value for r in told.collect()}[0, "total_after"] == rows[0].total_after


def test_fact_tables_are_typed(spark, tmp_path):
    one = spark.range(1).selectExpr("'x' as run_id", "id as query_count")
    for kind, columns in writers.FACTS.items():
        out = writers.shaped(one, kind)
        assert out.columns == columns
        types = dict(out.dtypes)
        assert types.get("dataset", "string") == "string" and types.get("total_before", "bigint") == "bigint" and types.get("select_sec", "double") == "double" and types.get("hop", "int") == "int"
        writers.write_facts(one, kind, f"{tmp_path}/{kind}", form="parquet")
        assert spark.read.parquet(f"{tmp_path}/{kind}").columns == columns
    assert [len(writers.FACTS[k]) for k in ("ablation", "one_shot", "congestion", "selection_debug", "reroute_debug", "simple_selection", "slot_legacy", "iterations")] == [42, 18, 18, 30, 24, 14, 31, 10]


def test_option_keys():
    own = options_from({"delta_initial": "900", "eta": "3", "min_slot_width": "300", "timing_log": "yes", "lambda": "0.2", "alpha": "0.15"}, AlgorithmOptions)
    assert (own.delta_initial, own.eta, own.min_slot_width, own.enable_timing_log, own.lambda_percent) == (900, 3, 300, True, 20)
    with pytest.raises(ValueError, match="unheard_of"):
        options_from({"unheard_of": "1"}, AlgorithmOptions)


def test_taxi_columns_by_any_name(spark):
    names = ["trip_pickup_date_time", "trip_dropoff_date_time", "PU_Longitude", "pickup_lat", "drop_off_longitude", "DO_latitude", "distance"]
    raw = spark.createDataFrame([("2013-01-01 00:00:00", "2013-01-01 00:10:00", "1.5", "2.5", "3.5", "4.5", "6")], ", ".join(f"`{n}` string" for n in names))
    r = readers.taxi_trips(raw).first()
    assert (r.pickup_lon, r.pickup_lat, r.dropoff_lon, r.dropoff_lat, r.trip_distance) == (1.5, 2.5, 3.5, 4.5, 6.0)


def test_results_of_many_files(spark, tmp_path):
    for k in range(5):
        (tmp_path / f"r{k}.csv").write_text("a,b\n1,2\n" if k % 2 else "b,c\n3,4\n5,6\n")
    got = readers.results(spark, [str(tmp_path)])
    assert sorted((r.source_file, r.a, r.b, r.c) for r in got.collect())[:3] == [("r0.csv", None, "3", "4"), ("r0.csv", None, "5", "6"), ("r1.csv", "1", "2", None)]
    assert got.count() == 8
