import math
import random

import pytest

from wayflow.operators import nearby

SCHEMA = "set string, id bigint, lon double, lat double, r double, rset string"


def far(a, b):
    p, q = math.radians(a[3]), math.radians(b[3])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * nearby.EARTH_M * math.asin(math.sqrt(min(1, h)))


def ok(x):
    return None not in x[2:5] and all(map(math.isfinite, x[2:5])) and abs(x[2]) <= 180 and abs(x[3]) <= 90 and x[4] >= 0


def points(seed, sets, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        where = r.random()
        if where < 0.3:
            at = (116.3, 39.9)  # a busy spot
        elif where < 0.4:
            at = (r.choice([-180.0, 180.0, 179.9999]), r.uniform(-1, 1))
        elif where < 0.5:
            at = (r.uniform(-180, 180), r.choice([89.9999, -90.0, 90.0]))
        elif where < 0.55:
            at = (r.choice([None, float("nan"), float("inf"), 200.0]), 10.0)
        else:
            at = (116.3 + r.gauss(0, 0.02), 39.9 + r.gauss(0, 0.02))
        out.append((r.choice(sets), i, *at, r.choice([0.0, 100.0, 500.0, 20000.0, -1.0, None]), "x"))
    return out + out[:5]


@pytest.mark.parametrize("full, roots", [(20, 0), (20, 2000), (2000, 2_000_000)])
def test_against_brute(spark, monkeypatch, full, roots):
    monkeypatch.setattr(nearby, "FULL", full)
    monkeypatch.setattr(nearby, "CROWDED", full // 2)
    monkeypatch.setattr(nearby, "ROOTS", roots)
    left, right = points(1, ["a", "b"], 300), points(2, ["u", "v", "w"], 200)
    sets = [("a", "u"), ("b", "v"), ("a", "v")]
    want = {(x[0], x[1], y[0], y[1]) for x in left for y in right if (x[0], y[0]) in sets and ok(x) and ok(y) and far(x, y) <= x[4] + y[4]}
    got = [tuple(r) for r in nearby.dual_tree_join(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), sets).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_empty(spark):
    one = spark.createDataFrame(points(1, ["a"], 20), SCHEMA)
    assert nearby.dual_tree_join(one, one.limit(0), [("a", "a")]).count() == 0
