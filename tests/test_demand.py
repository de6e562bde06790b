"""Snapping at any reach and latitude, slices, pairs around two places."""

import math
import random

import pytest

from wayflow.operators import demand, paths
from wayflow.operators.nearby import EARTH_M


def far(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1, h)))


def snapped(spark, points, nodes, reach):
    p = spark.createDataFrame([(i, *x) for i, x in enumerate(points)], "id bigint, lon double, lat double")
    n = spark.createDataFrame([(i, *x) for i, x in enumerate(nodes)], "node int, lon double, lat double")
    return {r.id: r.node for r in demand.nearest_node(p, n, reach).collect()}


@pytest.mark.parametrize("lat, reach", [(39.9, 500), (60.0, 300), (0.0, 5000), (-75.0, 20000), (89.99, 3000), (-90.0, 500), (89.0, 200000)])
def test_nearest_at_any_latitude(spark, lat, reach):
    r = random.Random(int(lat) + reach)
    deg = reach / 111195
    wide = min(170.0, 3 * deg / max(0.02, math.cos(math.radians(lat))))
    at = lambda lon: ((lon + r.uniform(-wide, wide) + 180) % 360 - 180, max(-90.0, min(90.0, lat + r.uniform(-3 * deg, 3 * deg))))
    for lon in (116.0, 180.0):
        points, nodes = [at(lon) for _ in range(120)], [at(lon) for _ in range(60)]
        want = {}
        for i, p in enumerate(points):
            d, k = min((far(p, n), k) for k, n in enumerate(nodes))
            if d <= reach:
                want[i] = k
        assert snapped(spark, points, nodes, reach) == want and want


def test_slices_are_equal(spark):
    rows = spark.range(1003).withColumnRenamed("id", "k")
    got = {r.part: r["count"] for r in demand.slices(rows, "k", 5, 3).groupBy("part").count().collect()}
    assert got == {0: 201, 1: 201, 2: 201, 3: 200, 4: 200}


def test_pairs_widen_their_radius(spark):
    nodes = spark.createDataFrame([(i, 116.0 + i / 100, 39.0) for i in range(40)], "node int, lon double, lat double")
    got = demand.local_pairs(nodes, (116.0, 39.0), (116.39, 39.0), 6, 1).collect()
    assert len(got) == 6 and all(r.origin < 12 and r.destination > 27 for r in got)


def test_network_is_refused_by_bytes(spark, monkeypatch):
    edges = spark.createDataFrame([(7, 0, 1, 5, 1), (3, 1, 2, 6, 1), (9, 0, 1, 4, 1)], "edge_id int, src int, dst int, fft bigint, cap int")
    n = paths.network(edges)
    assert n.edge_id.tolist() == [3, 7, 9] and n.index[9] == 2 and n.out()[0] == [(1, 1, 5), (1, 2, 4)] and n.out().get(5) == ()
    with pytest.raises(KeyError):
        n.index[4]
    assert paths._shared(edges) is paths._shared(edges)
    monkeypatch.setattr(paths, "MOST_BYTES", 80)
    with pytest.raises(ValueError):
        paths.network(edges)
