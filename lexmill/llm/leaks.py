"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman.

Runs of up to SEED words of a test item are its seeds.  In every five words of a long item the
rarer of two seeds opens candidates (counted over all documents), in a short one every seed
does; so however the allowed edits lie, an opener stays whole.  Seed hits on neighbouring
diagonals mark a window of the document, and a Smith-Waterman alignment of item and window,
word by word, refuses those whose best score is lower than that of any case.  What is left is
judged exactly: the longest stretch of the item, wherever it lies, that the window holds with
no more than so many words changed, added or dropped.

Items are handled in blocks of BLOCK_ITEMS, which bounds what is broadcast; every block is
held against all documents.  Positives of more than PIECE words are looked for in pieces
that overlap by more than a stretch, which bounds the windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import words
from lexmill.session import cut
from lexmill.tables import read

SEED = 4  # words
STRETCH = 25  # consecutive words of a positive that make a case
EDITS = 10  # one word in so many may be changed, added or dropped
SHORTEST = 5  # items of fewer words must be there unedited
PIECE = 512
STEP = 5  # words of a long item of which one seed opens candidates
BAND = 6  # diagonals a copy may drift between two seeds
BLOCK_ITEMS = 5_000
CELLS = 2_000_000  # of a row of alignments that are filled together
COUNTERS = 1 << 18
MATCH, MISS, GAP = 2, 3, 3
QUERY, POSITIVE = 0, 1


def edits(n: int) -> int:
    """Words of n that may be edited: about one in EDITS."""
    return -(-n // EDITS) if n >= SHORTEST else 0


def seed_size(n: int) -> int:
    """Words of a seed of an item of n words, so that the edits cannot break all of them."""
    e = edits(n)
    return max(1, min(SEED, (n - e) // (e + 1)))


def windows(a: np.ndarray, size: int = SEED) -> np.ndarray:
    """Hash of every run of `size` words."""
    n = max(0, len(a) - size + 1)
    h = np.full(n, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = words.mix(h + a[j : j + n].astype(np.uint32).astype(np.uint64) + np.uint64(j + 1))
    return h


class Items:
    """Seeds of a block of items, as arrays: small enough to broadcast.

    `counts`: occurrences of SEED-word runs in all documents, by counter."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]], counts: np.ndarray):
        ids = words.new_ids()
        self.item, self.part, self.at, self.length, self.parts = [], [], [], [], []
        for item, query, positive in rows:
            for part, text in ((QUERY, query), (POSITIVE, positive)):
                a = words.encode(text, ids) if text else np.zeros(0, np.int32)
                a = a[a != 0]
                step = PIECE - 2 * STRETCH
                for at in range(0, max(1, len(a) - 2 * STRETCH), step) if part == POSITIVE and len(a) > PIECE else range(min(1, len(a))):
                    self.item.append(item)
                    self.part.append(part)
                    self.at.append(at)
                    self.length.append(len(a))
                    self.parts.append(a[at : at + PIECE] if part == POSITIVE and len(a) > PIECE else a)
        n = np.array([len(a) for a in self.parts], dtype=np.int64)
        # What makes a case: so many words of the item with at most so many edits.
        self.span = np.where((np.array(self.part, dtype=np.int64) == POSITIVE) & (n >= STRETCH), STRETCH, n) if len(n) else n
        self.errors = np.array([edits(x) for x in self.span.tolist()], dtype=np.int64)
        self.least_score = MATCH * (self.span - self.errors) - MISS * self.errors
        size = [seed_size(x) for x in self.span.tolist()]
        # Seeds that are whole whatever the edits; seeds may lie on as many bands as there are edits.
        self.least_hits = np.array([max(1, s - z + 1 - z * e) for s, z, e in zip(self.span.tolist(), size, self.errors.tolist())], dtype=np.int64)
        self.by_size = {}
        for z in sorted(set(size)):
            own = [k for k, x in enumerate(size) if x == z]
            h = [windows(self.parts[k], z) for k in own]
            owner = np.repeat(own, [len(x) for x in h]).astype(np.int32)
            at = np.concatenate([np.arange(len(x)) for x in h]).astype(np.int32)
            h = np.concatenate(h)
            opens = np.ones(len(h), dtype=bool)
            long = n[owner] >= STRETCH
            if long.any():
                place, second = at // STEP, at % STEP
                seen = counts[(h % np.uint64(COUNTERS)).astype(np.int64)]
                rank = np.lexsort((second, np.where(second <= STEP - z, seen, np.iinfo(np.int64).max), place, owner))
                first = np.concatenate(([True], (owner[rank][1:] != owner[rank][:-1]) | (place[rank][1:] != place[rank][:-1])))
                opens = ~long
                opens[rank[first]] = True
            order = np.argsort(h, kind="stable")
            seed, first = np.unique(h[order], return_index=True)
            self.by_size[z] = (seed, np.append(first, len(h)), owner[order], at[order], opens[order])


def _documents(batch: pa.RecordBatch, ids) -> tuple[np.ndarray, np.ndarray]:
    """Flat word ids without sentence marks, and text offsets."""
    flat, offsets = words.encode_batch(batch.column(batch.num_columns - 1).to_pylist(), ids)
    keep = flat != 0
    return flat[keep], np.concatenate(([0], np.cumsum(keep)))[offsets]


def _hits(items: Items, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(position, text, part, place in the part, opens) of every seed that lies within a text."""
    out = []
    for size, (seed, first, owner, at, opens) in items.by_size.items():
        if len(flat) < size or not len(seed):
            continue
        h = windows(flat, size)
        k = np.searchsorted(seed, h)
        k[k == len(seed)] = 0
        pos = np.flatnonzero(seed[k] == h)
        text = np.searchsorted(offsets, pos, side="right") - 1
        inside = pos + size <= offsets[text + 1]
        pos, text = pos[inside], text[inside]
        many = first[k[pos] + 1] - first[k[pos]]
        i = np.repeat(first[k[pos]], many) + (np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many))
        out.append((np.repeat(pos, many), np.repeat(text, many), owner[i].astype(np.int64), at[i].astype(np.int64), opens[i]))
    if not out:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)
    return tuple(np.concatenate(x) for x in zip(*out))


def seed_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of SEED-word runs in `docs(text)` by counter: a table of fixed size. They
    only choose between neighbouring seeds; any numbers find the same cases."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ids = np.zeros(COUNTERS, dtype=np.int64), words.new_ids()
        for batch in batches:
            flat, _ = _documents(batch, ids)
            total += np.bincount((windows(flat) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])

    rows = docs.select("text").mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTERS rows
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[rows.column("c").to_numpy()] = rows.column("n").to_numpy()
    return out


def _padded(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of equal length; int64 with filling that is no word id."""
    n, m = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    A = np.full((len(a), int(n.max())), 1 << 40, dtype=np.int64)
    B = np.full((len(b), int(m.max())), 1 << 41, dtype=np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        A[i, : len(x)], B[i, : len(y)] = x, y
    return A, B, n, m


def align(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Best Smith-Waterman score of each a[i] with b[i]."""
    A, B, n, _ = _padded(a, b)
    row = np.zeros((len(a), B.shape[1] + 1), dtype=np.int32)
    best = np.zeros(len(a), dtype=np.int32)
    slope = np.arange(B.shape[1] + 1, dtype=np.int32) * GAP
    for i in range(A.shape[1]):
        new = row - GAP
        np.maximum(new[:, 1:], row[:, :-1] + np.where(B == A[:, i : i + 1], MATCH, -MISS).astype(np.int32), out=new[:, 1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        best = np.maximum(best, np.where(i < n, row.max(axis=1), 0))
    return best


def stretches(a: list[np.ndarray], b: list[np.ndarray], errors: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, end) of the longest stretch of each a[i] that b[i] holds with at most `errors`
    words changed, added or dropped (ties: the first)."""
    A, B, n, _ = _padded(a, b)
    level = np.zeros((errors + 1, len(a), B.shape[1] + 1), dtype=np.int32)
    best, end = np.zeros(len(a), dtype=np.int32), np.zeros(len(a), dtype=np.int32)
    for i in range(A.shape[1]):
        same = B == A[:, i : i + 1]
        new = np.zeros_like(level)
        new[0, :, 1:] = np.where(same, level[0, :, :-1] + 1, 0)
        for e in range(1, errors + 1):
            edited = np.maximum(np.maximum(level[e - 1, :, :-1], level[e - 1, :, 1:]) + 1, new[e - 1, :, :-1])
            new[e, :, 1:] = np.where(same, level[e, :, :-1] + 1, edited)
            new[e, :, 0] = level[e - 1, :, 0] + 1
        level = new
        top = np.where(i < n, level[errors].max(axis=1), 0)
        more = top > best
        best[more], end[more] = top[more], i + 1
    return best, end


def _batches(a: list[np.ndarray], b: list[np.ndarray], kind: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of one kind and like length together, as many as CELLS allows (one at least)."""
    m = np.array([len(x) for x in b])
    order = np.lexsort((m, kind))
    start = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or kind[order[i]] != kind[order[start]] or (i + 1 - start) * m[order[i]] > CELLS:
            yield order[start:i]
            start = i


def searcher(items):
    """Function for mapInArrow: (doc_id, loaded_at, text) -> FOUND."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = items.value, words.new_ids()
        for batch in batches:
            flat, offsets = _documents(batch, ids)
            pos, text, part, where, opens = _hits(own, flat, offsets)
            found = []
            if len(pos):
                diagonal = pos - where
                order = np.lexsort((diagonal, part, text))
                text, part, opens, diagonal = (x[order] for x in (text, part, opens, diagonal))
                new = np.concatenate(([True], (text[1:] != text[:-1]) | (part[1:] != part[:-1]) | (diagonal[1:] - diagonal[:-1] > BAND)))
                starts = np.flatnonzero(new)
                hits = np.diff(np.append(starts, len(text)))
                opened = np.add.reduceat(opens.astype(np.int64), starts)
                good = np.flatnonzero((hits >= own.least_hits[part[starts]]) & (opened > 0))
                last = np.append(starts[1:], len(text)) - 1
                a, b, who = [], [], []
                for j in good.tolist():
                    p, t = int(part[starts[j]]), int(text[starts[j]])
                    x = own.parts[p]
                    lo = max(int(offsets[t]), int(diagonal[starts[j]]) - BAND)
                    hi = min(int(offsets[t + 1]), int(diagonal[last[j]]) + len(x) + 2 * BAND)
                    wide = 2 * len(x) + 4 * BAND  # longer windows are cut, with half of it shared
                    for at in range(lo, max(lo + 1, hi - wide // 2), wide // 2):
                        a.append(x)
                        b.append(flat[at : min(hi, at + wide)])
                        who.append((t, p))
                if a:
                    of = np.array([p for _, p in who])
                    score = np.zeros(len(a), dtype=np.int64)
                    for rows in _batches(a, b, np.zeros(len(a), np.int64)):
                        score[rows] = align([a[i] for i in rows], [b[i] for i in rows])
                    left = np.flatnonzero(score >= own.least_score[of])
                    a, b, of = [a[i] for i in left], [b[i] for i in left], of[left]
                    allowed = own.errors[of]
                    for rows in _batches(a, b, allowed) if len(left) else ():
                        e = int(allowed[rows[0]])
                        span, end = stretches([a[i] for i in rows], [b[i] for i in rows], e)
                        for i, n, z in zip(rows.tolist(), span.tolist(), end.tolist()):
                            p = int(of[i])
                            if n >= own.span[p]:
                                found.append((who[left[i]][0], own.item[p], own.part[p], own.length[p], own.at[p] + z - n, own.at[p] + z, e))
            cols = np.array(found, dtype=np.int64).reshape(-1, 7)
            take = pa.array(cols[:, 0])
            arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(cols[:, 1]), *[pa.array(cols[:, j].astype(np.int32)) for j in range(2, 7)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "loaded_at", "item_id", "part", "length", "first", "last", "edits"])

    return search


FOUND = "doc_id long, loaded_at timestamp_ntz, item_id long, part int, length int, first int, last int, edits int"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, part, length, first, last, edits): test items that documents hold.

    `part` is 0 for the query and 1 for the positive; the document holds its words
    first..last (the longest such stretch) with at most `edits` of them edited.
    Null texts hold nothing; items without words are held by nothing; a document delivered
    again counts by its last text; item_ids delivered again count once; empty tables give no
    rows; further columns are ignored."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), "text")
    once = items.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("query", "positive")).alias("p")).select("item_id", "p.query", "p.positive")
    n = once.count()
    blocks = max(1, -(-n // BLOCK_ITEMS))
    parted = cut(once.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), "p2-items")
    counts = seed_counts(rows)
    out = None
    for block in range(blocks):  # a stated query set against all rows, in blocks
        own = Items([(r.item_id, r.query, r.positive) for r in parted.where(F.col("block") == block).orderBy("item_id").toLocalIterator()], counts)
        part = rows.mapInArrow(searcher(spark.sparkContext.broadcast(own)), FOUND)
        out = part if out is None else out.unionByName(part)
    last = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("loaded_at").cast("timestamp_ntz")).alias("at"))
    out = cut(out, "p2-found")
    out = out.join(last.join(out.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id").where(F.col("loaded_at").eqNullSafe(F.col("at")))
    return out.drop("at", "loaded_at").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items they hold, whole or in part."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id").distinct()


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents that hold it and the longest stretch found."""
    found = leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max(F.col("last") - F.col("first")).alias("longest"))
