"""Min-cost flow with integer capacities, by successive shortest paths over reduced costs; for networks of a few hundred arcs."""

from __future__ import annotations

import heapq


class Network:
    def __init__(self) -> None:
        self.out: dict[object, list[int]] = {}
        self.head: list[object] = []
        self.free: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: object, b: object, capacity: int, cost: int) -> int:
        """An arc; its number gives its flow afterwards."""
        at = len(self.head)
        for tail, head, free, price in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(tail, []).append(len(self.head))
            self.out.setdefault(head, [])
            self.head.append(head), self.free.append(free), self.cost.append(price)
        return at

    def flow(self, arc: int) -> int:
        return self.free[arc ^ 1]

    def send(self, source: object, sink: object, amount: int) -> int:
        """Send up to amount from source to sink at the least cost; all costs must be non-negative. The amount sent."""
        potential = dict.fromkeys(self.out, 0)
        sent = 0
        while sent < amount:
            dist, via = {source: 0}, {}
            queue, order = [(0, 0, source)], 1
            final: set[object] = set()
            while queue:
                d, _, node = heapq.heappop(queue)
                if node in final:
                    continue
                final.add(node)
                for a in self.out[node]:
                    to = self.head[a]
                    if self.free[a] and to not in final:
                        far = d + self.cost[a] + potential[node] - potential[to]
                        if far < dist.get(to, far + 1):
                            dist[to], via[to] = far, a
                            heapq.heappush(queue, (far, order, to))
                            order += 1
            if sink not in dist:
                break
            for node in potential:
                potential[node] += min(dist.get(node, dist[sink]), dist[sink])
            step, node = amount - sent, sink
            while node != source:
                step = min(step, self.free[via[node]])
                node = self.head[via[node] ^ 1]
            node = sink
            while node != source:
                self.free[via[node]] -= step
                self.free[via[node] ^ 1] += step
                node = self.head[via[node] ^ 1]
            sent += step
        return sent
