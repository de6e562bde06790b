import numpy as np
import pytest
from pyspark.sql import functions as F

from wayflow.llm import quantiles

SCHEMA = "grp bigint, value bigint, n string"


def test_universe_is_ordered_and_tight():
    r = np.random.default_rng(0)
    some = [r.integers(-(2**63), 2**63 - 1, 5000), r.integers(-(2**53), 2**53, 3000), [2**63 - 1, -(2**63), 2**42, 2**42 - 1, -1, -(2**42)]]
    some += [[s * 2**k + d for k in range(62) for d in (-2, -1, 0, 1) for s in (1, -1)]]
    v = np.unique(np.concatenate([np.arange(-6000, 20000), *(np.array(x, np.int64) for x in some)]))
    leaf = quantiles.quantised(v)
    lo, hi = quantiles.leaf_range(leaf, leaf, True)
    assert (np.diff(leaf) >= 0).all() and leaf.max() < 1 << quantiles.DEPTH and leaf.min() >= 0
    assert (lo <= v).all() and (v <= hi).all()
    assert ((hi - lo).astype(float) * 2048 <= np.maximum(np.abs(v.astype(float)), 1)).all()
    assert (lo == hi)[(v > -4096) & (v < 4096)].all()
    x = np.sort(np.concatenate([r.normal(0, 1, 3000), r.normal(0, 1, 3000) * 10.0 ** r.integers(-300, 300, 3000), [0.0, 0.2, 0.4, 0.6, 0.8, np.inf, -np.inf]]))
    leaf = quantiles.quantised(x)
    lo, hi = quantiles.leaf_range(leaf, leaf, False)
    assert (np.diff(leaf) >= 0).all() and (lo <= x).all() and (x <= hi).all()


def data(seed=1):
    r = np.random.default_rng(seed)
    rows = [(1, int(x), "a") for x in r.pareto(1.1, 60000) * 50]
    rows += [(2, 7, "a")] * 9000 + [(3, int(x), "a") for x in r.integers(0, 100, 11)] + [(4, 2**31 - 1, "a")]
    rows += [(6, int(x), "a") for x in r.normal(0, 5e12, 20000)] + [(7, -(2**63), "a"), (7, 2**63 - 1, "a")]
    return rows + [(None, 3, "a"), (5, None, "a"), (8, -4, "a")]


@pytest.mark.parametrize("k", [64, 4096])
def test_rank_error_is_bounded_and_parts_combine(spark, monkeypatch, k):
    monkeypatch.setattr(quantiles, "K", k)
    monkeypatch.setattr(quantiles.compress, "__defaults__", (k,))
    rows = data()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    whole = quantiles.digest(df, "grp", "value")
    parts = [quantiles.digest(df.where(F.pmod(F.xxhash64("value"), F.lit(3)) == i), "grp", "value") for i in range(3)]
    for nodes in (whole, quantiles.merge(parts[0].unionAll(parts[1]).unionAll(parts[2]))):
        got = {r.grp: r for r in quantiles.percentiles(nodes, [0, 50, 90, 99, 100]).collect()}
        assert set(got) == {1, 2, 3, 4, 6, 7, 8}
        for g, r in got.items():
            v = sorted(x for a, x, _ in rows if a == g)
            assert r.n == len(v)
            for p in (0, 50, 90, 99, 100):
                at = p * (len(v) - 1) // 100
                lo, hi = r[f"lo{p}"], r[f"hi{p}"]
                assert lo <= v[at] <= hi
                # ranks of the bounds are off by no more than depth * n / k, twice for digests of parts
                slack = 2 * quantiles.DEPTH * len(v) // k
                assert np.searchsorted(v, lo + abs(lo) / 2047, "right") + slack >= at
                assert np.searchsorted(v, hi - abs(hi) / 2047, "left") - slack <= at


def test_exceeding_is_exact(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "K", 32)
    monkeypatch.setattr(quantiles.compress, "__defaults__", (32,))
    rows = data(2)
    v = sorted(x for a, x, _ in rows if a == 1)
    limits = [(1, v[90 * (len(v) - 1) // 100] - 1), (2, 7), (3, 0), (9, 1)]
    got = quantiles.exceeding(spark.createDataFrame(rows, SCHEMA).repartition(4), "grp", "value", spark.createDataFrame(limits, "grp bigint, `limit` bigint"), [50, 90])
    want = set()
    for g, limit in limits:
        x = sorted(b for a, b, _ in rows if a == g and b is not None)
        want |= {(g, p) for p in (50, 90) if x and x[p * (len(x) - 1) // 100] > limit}
    assert {tuple(r) for r in got.collect()} == want


def test_empty(spark):
    assert quantiles.percentiles(quantiles.digest(spark.createDataFrame([], SCHEMA), "grp", "value"), [50]).count() == 0


def test_doubles(spark):
    v = [0.2, 0.4, 0.6, 0.8, -3.5, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(1, x) for x in v], "grp bigint, value double")
    got = quantiles.percentiles(quantiles.digest(df, "grp", "value"), [0, 50, 100], False).first()
    assert got.n == 6 and got.lo0 <= -3.5 <= got.hi0 and got.hi0 - got.lo0 < 0.01
    assert got.lo50 <= 0.4 <= got.hi50 and got.hi50 - got.lo50 < 0.001 and got.hi100 == float("inf")
