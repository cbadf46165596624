"""Filling fixed-capacity containers: first placement, then swap-based local search.

Items are dealt to shards by hash; each shard places its items largest first into the
fullest container they fit, then improves its underfull containers by moving an item,
exchanging one for one or two for one, whenever that raises the sum of squared fills, until
containers empty.  The search ends when no such exchange is left, or when there are as few
containers as the sum of sizes allows.  What is left underfull in all shards is packed again
together, so the number of shards costs next to nothing.  An item is cut only when it exceeds
the capacity.

Exchanges are found, not searched for: containers lie in groups of one fill, and a table
tells for each group the next size that one of its containers holds, so a step is a few array
operations over the groups, whatever the number of containers and items.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.pieces import cut_documents
from lexmill.session import cut, partitions
from lexmill.tables import read

CAPACITY = 2048
PER_SHARD = 60_000  # items; with capacities over WIDE a tenth, as the tables grow with both
WIDE = 4096
FULL = 0.98  # containers filled less than this are packed again, with those of all shards


def place(sizes: list[int], capacity: int) -> list[list[int]]:
    """Largest first, into the fullest container with room. Items of size 0 fit anywhere."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set when some container has room r
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        by_room[room - s].append(b)
        rooms |= 1 << (room - s)
    return bins


class Search:
    """Containers of one shard in groups of one fill, with the sizes that each group holds.

    `next[row]` gives for each rank of a size the rank of the next size, from there on, that
    some container of the group holds (`last` if none); it is made anew for groups that changed."""

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.capacity = capacity
        self.known = np.unique(np.array([sizes[i] for b in bins for i in b], dtype=np.int64))
        self.last = len(self.known)
        self.size_of = np.append(self.known, 1 << 40)
        self.rank_of = np.searchsorted(self.known, np.arange(capacity + 2))
        self.items: list[dict[int, list[int]]] = []  # container -> size -> items
        self.fill: list[int] = []
        rows = min(len(bins), capacity + 1) + 2
        self.next = np.full((rows, self.last + 1), self.last, dtype=np.int32)
        self.row_fill = np.full(rows, -1, dtype=np.int64)
        self.free = list(range(rows))[::-1]
        self.row: dict[int, int] = {}  # fill -> row
        self.members: dict[int, dict[int, None]] = {}  # fill -> containers
        self.counts: dict[int, dict[int, int]] = {}  # fill -> size -> containers that hold it
        self.stale: set[int] = set()
        self.used = 0
        for b in bins:
            by: dict[int, list[int]] = {}
            for i in b:
                by.setdefault(sizes[i], []).append(i)
            self.items.append(by)
            self.fill.append(sum(sizes[i] for i in b))
            self.used += bool(self.fill[-1])
            self.enter(len(self.items) - 1)

    def enter(self, k: int) -> None:
        f = self.fill[k]
        if not f:
            return
        if f not in self.row:
            self.row[f] = self.free.pop()
            self.row_fill[self.row[f]] = f
            self.members[f], self.counts[f] = {}, {}
        self.members[f][k] = None
        counts = self.counts[f]
        for s in self.items[k]:
            counts[s] = counts.get(s, 0) + 1
            if counts[s] == 1:
                self.stale.add(f)

    def leave(self, k: int) -> None:
        f = self.fill[k]
        if not f:
            return
        del self.members[f][k]
        if not self.members[f]:
            row = self.row.pop(f)
            self.next[row] = self.last
            self.row_fill[row] = -1
            self.free.append(row)
            del self.members[f], self.counts[f]
            self.stale.discard(f)
            return
        counts = self.counts[f]
        for s in self.items[k]:
            counts[s] -= 1
            if not counts[s]:
                del counts[s]
                self.stale.add(f)

    def _renew(self) -> None:
        for f in self.stale:
            there = np.full(self.last + 1, self.last, dtype=np.int32)
            ranks = np.searchsorted(self.known, list(self.counts[f]))
            there[ranks] = ranks
            self.next[self.row[f]] = np.minimum.accumulate(there[::-1])[::-1]
        self.stale.clear()

    def best(self, x: int) -> tuple[int, list[int], list[int]] | None:
        """(container, sizes out, sizes back) of the exchange between x, which stands outside
        the groups, and another container that raises the sum of squared fills most; None when
        none raises it.  Giving d from fill f to fill g raises it when g + d > f."""
        own, f = sorted(s for s in self.items[x] if s), self.fill[x]
        self._renew()
        rows = np.flatnonzero(self.row_fill >= 0)
        if not own or not len(rows):
            return None
        g = self.row_fill[rows]
        room = self.capacity - g
        out: dict[int, tuple[int, ...]] = {}
        for i, s in enumerate(own):
            for t in own[i:]:
                if s != t or len(self.items[x][s]) > 1:
                    out[s + t] = (s, t)
        out |= {s: (s,) for s in own}
        given = np.array(list(out), dtype=np.int64)
        own = np.array(own, dtype=np.int64)
        largest = np.searchsorted(own, room, side="right") - 1
        move = np.where(largest >= 0, own[largest], 0)
        low = np.maximum(given[:, None] - room, 1)
        low[low > self.capacity] = self.capacity + 1
        back = self.size_of[self.next[rows, self.rank_of[low]]]
        d = np.concatenate((move[None, :], given[:, None] - back))
        rise = np.where((d > 0) & (g + d > f), d * (g + d - f), 0)
        at = int(rise.argmax())
        if not rise.flat[at]:
            return None
        a, b = divmod(at, len(rows))
        near = self.members[int(g[b])]
        if a == 0:
            return next(iter(near)), [int(move[b])], []
        size = int(back[a - 1, b])
        return next(k for k in near if size in self.items[k]), list(out[int(given[a - 1])]), [size]

    def exchange(self, x: int, y: int, out: list[int], back: list[int]) -> None:
        """Items of the sizes `out` go from x to y, of the sizes `back` from y to x."""
        self.leave(y)
        self.used -= bool(self.fill[x]) + bool(self.fill[y])
        for a, b, moved in ((x, y, out), (y, x, back)):
            for s in moved:
                i = self.items[a][s].pop()
                if not self.items[a][s]:
                    del self.items[a][s]
                self.items[b].setdefault(s, []).append(i)
        d = sum(out) - sum(back)
        self.fill[x] -= d
        self.fill[y] += d
        self.used += bool(self.fill[x]) + bool(self.fill[y])
        self.enter(y)

    def run(self, fewest: int) -> None:
        """Exchanges, the emptiest container first, until none is left or no more than
        `fewest` containers hold anything.  Every step raises the sum of squared fills, a
        bounded whole number, so this ends."""
        moved = True
        while moved:
            moved = False
            queue = [(f, k) for k, f in enumerate(self.fill) if 0 < f < self.capacity]
            heapq.heapify(queue)
            while queue and self.used > fewest:
                f, x = heapq.heappop(queue)
                if self.fill[x] != f:
                    continue
                self.leave(x)
                step = self.best(x)
                if step is not None:
                    moved = True
                    self.exchange(x, *step)
                    for k in (x, step[0]):
                        if 0 < self.fill[k] < self.capacity:
                            heapq.heappush(queue, (self.fill[k], k))
                self.enter(x)
            if self.used <= fewest:
                return


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Local search until no exchange raises the sum of squared fills or the containers are
    as few as the sizes allow; never more containers than before."""
    fills = [sum(sizes[i] for i in b) for b in bins]
    under = [b for b, f in zip(bins, fills) if f < capacity]
    full = [b for b, f in zip(bins, fills) if f >= capacity]
    search = Search(under, sizes, capacity)
    search.run(-(-sum(f for f in fills if f < capacity) // capacity))
    left = [[i for s in sorted(by) for i in by[s]] for by in search.items if by]
    # Containers with items of size 0 alone: those go into any other.
    idle = [i for b in left if not any(sizes[i] for i in b) for i in b]
    kept = [b for b in left if any(sizes[i] for i in b)] + full
    if idle:
        kept = [*kept[:-1], kept[-1] + idle] if kept else [idle]
    return kept


def packer(capacity: int, label: str):
    """Function for applying to a shard: items -> items with container, position, fill."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        got = [b for b in batches if len(b)]
        if not got:
            return
        pdf = pd.concat(got, ignore_index=True).sort_values(["doc_id", "piece"], ignore_index=True)
        sizes = pdf["tokens"].tolist()
        bins = improve(place(sizes, capacity), sizes, capacity)
        part = TaskContext.get().partitionId()
        box, spot, fill = [None] * len(sizes), [0] * len(sizes), [0] * len(sizes)
        for k, b in enumerate(bins):
            total = sum(sizes[i] for i in b)
            for p, i in enumerate(sorted(b)):
                box[i], spot[i], fill[i] = f"{label}-{part}-{k}", p, total
        pdf["container"], pdf["position"], pdf["fill"] = box, spot, fill
        yield pdf[["container", "position", "doc_id", "piece", "char_start", "char_end", "tokens", "fill"]]

    return pack


PACKED = "container string, position int, doc_id long, piece int, char_start int, char_end int, tokens int, fill int"


def fill_containers(items: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """Containers for `items(doc_id, piece, char_start, char_end, tokens)`, none larger than
    the capacity. An empty table gives no rows; further columns are left out."""
    spark = items.sparkSession
    columns = ["doc_id", "piece", "char_start", "char_end", "tokens"]
    items = cut(items.select(columns), "p7-items")
    if capacity > WIDE:
        per_shard = -(-per_shard // 10)
    shards = partitions(spark, items.count(), per_shard)
    first = cut(items.repartition(shards, F.xxhash64("doc_id", "piece")).mapInPandas(packer(capacity, "a"), PACKED), "p7-first")
    loose = first.where(F.col("fill") < capacity * FULL).select(columns)
    again = loose.repartition(-(-max(1, loose.count()) // per_shard), F.xxhash64("doc_id", "piece"))
    again = cut(again.mapInPandas(packer(capacity, "b"), PACKED), "p7-again")
    return first.where(F.col("fill") >= capacity * FULL).unionByName(again)


def p7_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, position, document, piece and the container's fill for every document."""
    return fill_containers(cut_documents(read(spark, sf_dir, "documents"), CAPACITY, 0, whole=True, with_text=False))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a container: items, tokens, share of the capacity used."""
    by = p7_bins(spark, sf_dir).groupBy("container")
    return by.agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.lit(CAPACITY), 6).alias("used"))
