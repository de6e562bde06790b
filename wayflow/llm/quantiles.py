"""Percentiles of very large numeric columns by q-digests.

Values are quantised to a bounded ordered universe of 2^23 leaves: sign, exponent and 11 further bits of the value as a double, so that every number of 64 bits,
whole or not, negative or not, has a leaf, and whole numbers below 4096 have one of their own. A digest holds counts of nodes of the dyadic tree over the
universe (leaf v is node 2^23 + v, the parent of node i is i div 2). A node whose count, with its sibling's and parent's, is at most n div K is folded
into the parent. Digests merge by adding the counts of equal nodes. Every node on a path but the last holds at most n / K, so that no rank is off by more
than 23 n / K, whatever the order or the number of parts.

Each task digests its own rows; the nodes are added up with map-side combination under (group, node), which no hot group can skew; what
is then brought together for one group is at most the 2^24 nodes of the tree, and by the folding some thousands for each task that met the group.

Defined results: a null group takes no part, nor does a value that is null or not a number; infinities are the outermost values; a group without values
gives no row; one value is every percentile. Bounds of whole columns are whole; decimals are taken as doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayflow.session import cut

DEPTH, MANTISSA = 23, 11
DROP, ZERO = 52 - MANTISSA, 1 << (DEPTH - 1)
K = 4096
#: (group, node) counts a task holds before it hands its digests on.
HELD = 500_000


def quantised(v: np.ndarray) -> np.ndarray:
    """Leaf of each number. Whole ones are cut to their leading bits before they become doubles, so that none is rounded up."""
    if v.dtype.kind in "iu":
        whole = v.astype(np.int64)
        size = np.where(whole < 0, -(whole + 1), whole)  # -1 - v mirrors the order and has room for the least of all
        bits = np.frexp(size.astype(np.float64))[1].astype(np.int64)
        bits -= (bits > 0) & (size >> np.maximum(bits - 1, 0) == 0)  # rounded up to the next power
        shift = np.maximum(bits - MANTISSA - 1, 0)
        top = ((size >> shift) << shift).astype(np.float64).view(np.int64) >> DROP
        return np.where(whole < 0, ZERO - 1 - top, ZERO + top)
    top = (np.abs(v.astype(np.float64)).view(np.int64)) >> DROP
    return np.where(v < 0, ZERO - 1 - top, ZERO + top)


def leaf_range(first: np.ndarray, last: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of the leaves first..last."""
    infinite = 0x7FF << MANTISSA
    at = lambda i: (np.minimum(i, infinite) << DROP).view(np.float64)
    below = lambda i: np.where(i < infinite, ((np.minimum(i, infinite - 1) + 1 << DROP) - 1).view(np.float64), np.inf)
    if not whole:
        return np.where(first < ZERO, -below(np.maximum(ZERO - 1 - first, 0)), at(np.maximum(first - ZERO, 0))), np.where(last < ZERO, -at(np.maximum(ZERO - 1 - last, 0)), below(np.maximum(last - ZERO, 0)))

    def least(i: np.ndarray) -> np.ndarray:
        """The least whole number at or above the leaf's start, for sizes; 2^63 - 1 where it would be larger."""
        x = np.ceil(at(i))
        return np.where(x < 2.0**63, np.minimum(x, 2.0**62 * 1.9999), 0.0).astype(np.int64) + np.where(x < 2.0**63, 0, np.int64(2**63 - 1))

    def most(i: np.ndarray) -> np.ndarray:
        x = np.ceil(at(i + 1))
        return np.where(x < 2.0**63, np.minimum(x, 2.0**62 * 1.9999), 0.0).astype(np.int64) + np.where(x < 2.0**63, 0, np.int64(2**63 - 1)) - (x < 2.0**63)

    low = np.where(first < ZERO, -1 - most(np.maximum(ZERO - 1 - first, 0)), least(np.maximum(first - ZERO, 0)))
    high = np.where(last < ZERO, -1 - least(np.maximum(ZERO - 1 - last, 0)), most(np.maximum(last - ZERO, 0)))
    return low, high


def _added(group: np.ndarray, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((node, group))
    group, node, count = group[order], node[order], count[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
    at = np.flatnonzero(new)
    return group[at], node[at], np.add.reduceat(count, at) if len(at) else count


def compress(group: np.ndarray, node: np.ndarray, count: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fold light nodes into their parents, for all groups at once, from the leaves up. group: small whole numbers."""
    group, node, count = _added(group, node, count)
    limit = np.bincount(group, count).astype(np.int64) // k if len(group) else np.zeros(0, np.int64)
    fold = limit[group] > 0
    done = [(group[~fold], node[~fold], count[~fold])]
    group, node, count = group[fold], node[fold], count[fold]
    for level in range(DEPTH, 0, -1):
        here, above = node >> level == 1, node >> (level - 1) == 1
        if not here.any():
            continue
        g, i, c = group[here], node[here], count[here]
        both = np.concatenate([g, group[above]]), np.concatenate([i >> 1, node[above]]), np.concatenate([c, count[above]])
        sg, si, sc = _added(*both)
        light = sc <= limit[sg]
        key = sg << (DEPTH + 1) | si
        up = light[np.searchsorted(key, g << (DEPTH + 1) | i >> 1)]
        done.append((g[~up], i[~up], c[~up]))
        rest = ~here
        group, node, count = _added(np.concatenate([group[rest], g[up]]), np.concatenate([node[rest], i[up] >> 1]), np.concatenate([count[rest], c[up]]))
    done.append((group, node, count))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def _digests(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out() -> pd.DataFrame:
            rows = pd.concat(held)
            code, names = pd.factorize(rows.grp)
            g, i, c = compress(code.astype(np.int64), rows.node.to_numpy(), rows.n.to_numpy(), k)
            return pd.DataFrame({"grp": names.to_numpy()[g], "node": i, "n": c})

        for batch in batches:
            if not len(batch):
                continue
            held.append(pd.DataFrame({"grp": batch.grp, "node": quantised(batch.value.to_numpy()) + (1 << DEPTH), "n": batch.n}))
            if sum(map(len, held)) > HELD:
                held = [out()]
                if len(held[0]) > HELD // 2:
                    yield held.pop()
        if held:
            yield out()

    return run


def whole(rows: DataFrame, value: str) -> bool:
    return rows.schema[value].dataType.typeName() in ("byte", "short", "integer", "long")


def digest(rows: DataFrame, group: str, value: str) -> DataFrame:
    """grp, node, n: the digest of every group. Digests of parts merge by ``merge(a.unionAll(b))``."""
    kind = "bigint" if whole(rows, value) else "double"
    v = F.col(value).cast(kind)
    rows = rows.select(F.col(group).cast("bigint").alias("grp"), v.alias("value"), F.lit(1).cast("bigint").alias("n")).dropna(subset=["grp", "value"])
    if kind == "double":
        rows = rows.where(~F.isnan("value"))
    return merge(rows.mapInPandas(_digests(K), "grp bigint, node bigint, n bigint"))


def merge(nodes: DataFrame) -> DataFrame:
    """Node addition."""
    return nodes.groupBy("grp", "node").agg(F.sum("n").alias("n"))


def _bounds(percents: list[int], whole_: bool):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        g = pd.factorize(rows.grp)
        code, node, count = compress(g[0].astype(np.int64), rows.node.to_numpy(), rows.n.to_numpy())
        level = np.frexp(node.astype(np.float64))[1] - 1
        low, high = leaf_range((node << (DEPTH - level)) - (1 << DEPTH), ((node + 1) << (DEPTH - level)) - 1 - (1 << DEPTH), whole_)
        total = np.bincount(code, count).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(total)])
        out = {"grp": g[1].to_numpy(), "n": total}
        for name, key in (("lo", low), ("hi", high)):
            order = np.lexsort((key, code))
            cum = np.cumsum(count[order])
            for p in percents:
                rank = before[:-1] + p * (total - 1) // 100 + 1
                out[f"{name}{p}"] = key[order][np.searchsorted(cum, rank)]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:  # sorted by group; the last group of a batch may go on
            rows = batch if held is None else pd.concat([held, batch])
            if len(rows):
                last = rows.grp.iloc[-1]
                held, whole = rows[rows.grp == last], rows[rows.grp != last]
                if len(whole):
                    yield ask(whole)
        if held is not None and len(held):
            yield ask(held)

    return run


def percentiles(nodes: DataFrame, percents: list[int], whole_: bool = True) -> DataFrame:
    """grp, n and for each percent p the bounds lo<p> <= percentile <= hi<p>, the percentile being the value at index p*(n-1) div 100.

    whole_: the values were whole numbers, and so are the bounds; doubles otherwise.
    """
    schema = "grp bigint, n bigint, " + ", ".join(f"{b}{p} {'bigint' if whole_ else 'double'}" for b in ("lo", "hi") for p in percents)
    return nodes.repartition("grp").sortWithinPartitions("grp").mapInPandas(_bounds(percents, whole_), schema)


def exceeding(rows: DataFrame, group: str, value: str, limits: DataFrame, percents: list[int]) -> DataFrame:
    """(group, pct) of the groups whose percentile exceeds ``limit``; limits: (group, limit), a group once.

    The digest settles all groups whose bounds lie on one side of the limit. For the others the rows at or below the limit are counted. Rows are read twice;
    if they are dear to get, cut their lineage first.
    """
    kind = whole(rows, value)
    asked = percentiles(digest(rows, group, value), percents, kind).join(limits.select(F.col(group).cast("bigint").alias("grp"), "limit"), "grp")
    each: Column = F.explode(F.array(*(F.struct(F.lit(p).alias("pct"), F.col(f"lo{p}").alias("lo"), F.col(f"hi{p}").alias("hi")) for p in percents)))
    asked = cut(asked.select("grp", "n", "limit", each.alias("q")).select("grp", "n", "limit", "q.*"))
    sure = asked.where(F.col("lo") > F.col("limit")).select("grp", "pct")
    open_ = asked.where((F.col("lo") <= F.col("limit")) & (F.col("hi") > F.col("limit")))
    some = open_.select(F.col("grp").alias("g"), "limit").distinct()
    kept = rows.select(F.col(group).cast("bigint").alias("g"), F.col(value).alias("v"))
    below = kept.join(some, "g").where(F.col("v") <= F.col("limit")).groupBy("g").agg(F.count("*").alias("below"))
    exact = open_.join(below, F.col("grp") == F.col("g"), "left").where(F.coalesce("below", F.lit(0)) <= F.expr("pct * (n - 1) div 100")).select("grp", "pct")
    return sure.unionAll(exact)
