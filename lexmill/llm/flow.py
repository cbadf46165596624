"""Min-cost flow on small graphs (cells of a summary, never rows)."""

from __future__ import annotations

from collections import deque


class Network:
    """Successive shortest paths; whole-number capacities, costs of any sign as long as no
    cycle of arcs is negative."""

    def __init__(self):
        self.names: dict = {}
        self.head: list[list[int]] = []
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.arcs: dict = {}

    def node(self, name) -> int:
        if name not in self.names:
            self.names[name] = len(self.head)
            self.head.append([])
        return self.names[name]

    def arc(self, a, b, room: int, cost: float = 0.0, key=None) -> None:
        if room <= 0:
            return
        i, j = self.node(a), self.node(b)
        if key is not None:
            self.arcs.setdefault(key, []).append(len(self.to))
        for u, v, r, c in ((i, j, room, cost), (j, i, 0, -cost)):
            self.head[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)

    def solve(self, source, sink, amount: int) -> int:
        """Send up to `amount`; returns what was sent."""
        s, t, sent = self.node(source), self.node(sink), 0
        while sent < amount:
            far = [float("inf")] * len(self.head)
            came = [-1] * len(self.head)
            far[s], queue, waiting = 0.0, deque([s]), {s}
            while queue:
                u = queue.popleft()
                waiting.discard(u)
                for e in self.head[u]:
                    v = self.to[e]
                    if self.room[e] > 0 and far[u] + self.cost[e] < far[v] - 1e-12:
                        far[v], came[v] = far[u] + self.cost[e], e
                        if v not in waiting:
                            waiting.add(v)
                            queue.append(v)
            if came[t] < 0:
                break
            push, v = amount - sent, t
            while v != s:
                push = min(push, self.room[came[v]])
                v = self.to[came[v] ^ 1]
            v = t
            while v != s:
                self.room[came[v]] -= push
                self.room[came[v] ^ 1] += push
                v = self.to[came[v] ^ 1]
            sent += push
        return sent

    def flow(self, key) -> int:
        return sum(self.room[e ^ 1] for e in self.arcs.get(key, []))


def apportion(shares: dict, total: int) -> dict:
    """Whole numbers in proportion to `shares` that sum to `total` (largest remainder, ties
    by name)."""
    whole = sum(shares.values()) or 1.0
    exact = {k: v / whole * total for k, v in shares.items()}
    out = {k: int(x + 1e-9) for k, x in exact.items()}
    for k in sorted(shares, key=lambda k: (out[k] - exact[k], str(k)))[: total - sum(out.values())]:
        out[k] += 1
    return out
