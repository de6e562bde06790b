"""A dependency graph that changes while trips leave and join it, inside the task of a run.

Nodes are positions; per edge the living ones stand in order of time. Whether a node is felt by the next on its edge follows from its flow at any moment,
so the links need no upkeep: they are read off the timelines when impacts are asked for.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict

from wayflow.model import TrafficOptions
from wayflow.operators.dependency import propagated


class Live:
    def __init__(self, edge: list, time: list[int], flow: list[int], fft: list[int], cap: list[int], arcs: list[tuple[int, int]], roads: TrafficOptions = TrafficOptions()):
        """Nodes come in order of (edge, time); arcs lead along trips, one for each time a trip takes it."""
        self.edge, self.time, self.flow, self.original, self.fft, self.cap, self.roads = edge, time, list(flow), list(flow), fft, cap, roads
        self.out = [Counter() for _ in flow]
        self.into: list[set[int]] = [set() for _ in flow]
        for a, b in arcs:
            self.out[a][b] += 1
            self.into[b].add(a)
        self.line: dict = defaultdict(list)
        for i, e in enumerate(edge):
            self.line[e].append(i)
        self.alive = [True] * len(flow)

    def delay(self, i: int) -> int:
        return self.roads.delay(self.fft[i], self.cap[i], self.flow[i])

    def remove(self, nodes: list[int]) -> None:
        """A trip leaves: a vehicle less on each node it visits; a node without any loses its arcs and its place, so that its neighbours meet."""
        for i in nodes:
            if self.flow[i] <= 0 or not self.alive[i]:
                continue
            self.flow[i] -= 1
            if self.flow[i] == 0:
                for b in self.out[i]:
                    self.into[b].discard(i)
                for a in self.into[i]:
                    del self.out[a][i]
                self.out[i], self.into[i], self.alive[i] = Counter(), set(), False
                own = self.line[self.edge[i]]
                own.pop(bisect_left(own, i))

    def insert(self, nodes: list[int]) -> None:
        """A trip joins: a vehicle more on each living node it visits, and an arc from each to the next where there is none. No node is born."""
        for i in dict.fromkeys(nodes):
            if self.alive[i]:
                self.flow[i] += 1
        for a, b in zip(nodes, nodes[1:], strict=False):
            if a != b and b not in self.out[a]:
                self.out[a][b] = 1
                self.into[b].add(a)

    def impacts(self, percent: int) -> list[int]:
        base = [self.delay(i) if alive else 0 for i, alive in enumerate(self.alive)]
        children = [list(c.elements()) for c in self.out]
        for own in self.line.values():
            for a, b in zip(own, own[1:], strict=False):
                if b not in self.out[a] and self.time[a] + base[a] > self.time[b]:
                    children[a].append(b)
        return propagated(base, children, percent)
