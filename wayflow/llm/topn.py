"""Top N items within every group by mergeable bounded heaps.

Every task keeps a heap of at most N items for each group it meets, the worst of them on top; an item that does not beat the top of a full heap is
discarded at once. Batches are compared with the tops of their groups as arrays, so that only the few items that enter a heap are touched one by one.
The heaps, not the rows, are shuffled, and merged by the same code: one heap per group takes what the tasks hand on. Order is by score, then identifier.
Items may be declared copies of one another by a digest of their other columns: a heap then holds a content once, under its smallest identifier. That
stays mergeable: what precedes a content inside a part also precedes it in the whole.

Defined results: rows with a null key, score or identifier take no part; fewer than N items give what there is; equal rows count once
if a digest is used and as often as they occur otherwise; empty input gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups a task holds heaps for before it hands them on and starts anew; bounds memory, changes no result.
HELD = 100_000


class Last:
    """An item whose order is turned round, so that the worst of a heap is on top."""

    __slots__ = ("at",)

    def __init__(self, at: tuple):
        self.at = at

    def __lt__(self, other: Last) -> bool:
        return self.at > other.at


class Heaps:
    def __init__(self, n: int, copies: bool):
        self.n, self.copies = n, copies
        self.number: dict[tuple, int] = {}
        self.heaps: list[list[Last]] = []
        self.held: list[dict] = []  # content -> its place in the heap's order
        self.full = np.zeros(0, bool)
        self.worst_score = self.worst_item = None

    def numbers(self, keys: pd.DataFrame) -> np.ndarray:
        """Number of the heap of each row; new groups get one."""
        code = keys.groupby(list(keys.columns), sort=False).ngroup().to_numpy()
        first = np.flatnonzero(~pd.Series(code).duplicated().to_numpy())
        own = []
        for key in keys.iloc[first].itertuples(index=False, name=None):
            if (k := self.number.get(key)) is None:
                k = self.number[key] = len(self.heaps)
                self.heaps.append([])
                self.held.append({})
            own.append(k)
        grow = len(self.heaps) - len(self.full)
        self.full = np.concatenate([self.full, np.zeros(grow, bool)])
        return np.array(own, np.int64)[code]

    def push(self, batch: pd.DataFrame, names: list[str], digest: list[str]) -> None:
        if not len(batch):
            return
        at = self.numbers(batch[names])
        score, item = batch.score.to_numpy(), batch.item.to_numpy()
        if self.worst_score is None:
            self.worst_score, self.worst_item = np.empty(0, score.dtype), np.empty(0, item.dtype)
        grow = len(self.heaps) - len(self.worst_score)
        if grow:
            self.worst_score = np.concatenate([self.worst_score, np.zeros(grow, score.dtype) if score.dtype != object else np.full(grow, None)])
            self.worst_item = np.concatenate([self.worst_item, np.zeros(grow, item.dtype) if item.dtype != object else np.full(grow, None)])
        may = ~self.full[at]
        rest = np.flatnonzero(~may)
        ws, wi = self.worst_score[at[rest]], self.worst_item[at[rest]]
        may[rest] = (score[rest] < ws) | ((score[rest] == ws) & (item[rest] < wi))
        # best first, so that a heap soon has a top that refuses what follows
        left = batch[may].assign(_at=at[may]).sort_values(["score", "item"], kind="stable")
        left = left[left.groupby("_at", sort=False).cumcount() < self.n] if not digest else left.drop_duplicates(["_at", *digest])
        touched = set()
        content = list(zip(*(left[c] for c in digest), strict=True)) if digest else [None] * len(left)
        for k, s, i, c in zip(left["_at"].tolist(), left.score.tolist(), left.item.tolist(), content, strict=True):
            heap, held = self.heaps[k], self.held[k]
            x = (s, i, c)
            if c is not None and c in held:
                if x >= held[c]:
                    continue
                heap.remove(next(h for h in heap if h.at == held[c]))  # at most n
                heapq.heapify(heap)
                heapq.heappush(heap, Last(x))
            elif len(heap) < self.n:
                heapq.heappush(heap, Last(x))
            elif x < heap[0].at:
                out = heapq.heapreplace(heap, Last(x)).at
                held.pop(out[2], None)
            else:
                continue
            if c is not None:
                held[c] = x
            touched.add(k)
        for k in touched:
            if len(self.heaps[k]) == self.n:
                self.full[k] = True
                self.worst_score[k], self.worst_item[k] = self.heaps[k][0].at[:2]

    def rows(self, names: list[str], digest: list[str], ranked: bool) -> pd.DataFrame:
        out = []
        for key, k in self.number.items():
            for place, (s, i, c) in enumerate(sorted(h.at for h in self.heaps[k])):
                out.append((*key, s, i, *((place + 1,) if ranked else c or ())))
        return pd.DataFrame(out, columns=[*names, "score", "item", *(["rank"] if ranked else digest)])


def _heaps(names: list[str], digest: list[str], n: int, ranked: bool = False):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Heaps(n, bool(digest))
        for batch in batches:
            if ranked and len(own.heaps) > HELD and len(batch):
                # sorted by group: only the last group can go on
                last = tuple(batch[names].iloc[0])
                k = own.number.get(last)
                done, kept = Heaps(n, bool(digest)), Heaps(n, bool(digest))
                done.number, done.heaps = {key: i for key, i in own.number.items() if i != k}, own.heaps
                yield done.rows(names, digest, True)
                if k is not None:
                    kept.push(pd.DataFrame([(*last, *x.at[:2], *(x.at[2] or ())) for x in own.heaps[k]], columns=[*names, "score", "item", *digest]), names, digest)
                own = kept
            own.push(batch, names, digest)
            if not ranked and len(own.heaps) > HELD:
                yield own.rows(names, digest, False)
                own = Heaps(n, bool(digest))
        if own.heaps:
            yield own.rows(names, digest, ranked)

    return run


def top_n(rows: DataFrame, keys: list[str], score: str, item: str, n: int, copies: list[str] | None = None) -> DataFrame:
    """The n rows of each group with the lowest (score, item): keys, score, item and rank from 1. copies: columns that make two rows copies."""
    names = [f"k{i}" for i in range(len(keys))]
    digest = ["d0", "d1"] if copies else []
    rows = rows.dropna(subset=[*keys, score, item])
    # a null leaves the hash as it was, so each column goes with a flag
    flagged = lambda names: [x for c in names for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    extra = [F.xxhash64(*flagged(copies)).alias("d0"), F.xxhash64(F.lit("copy"), *flagged(reversed(copies))).alias("d1")] if copies else []
    slim = rows.select(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True)), F.col(score).alias("score"), F.col(item).alias("item"), *extra)
    schema = slim.schema
    heaps = slim.mapInPandas(_heaps(names, digest, n), schema).repartition(*names).sortWithinPartitions(*names)
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields[: len(names) + 2])
    ranked = heaps.mapInPandas(_heaps(names, digest, n, True), f"{kind}, rank int")
    return ranked.select(*(F.col(a).alias(k) for k, a in zip(keys, names, strict=True)), F.col("score").alias(score), F.col("item").alias(item), "rank")
