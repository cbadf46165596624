"""Best documents by BM25 where queries grow with the documents: tiles of a block of documents
and a block of queries, each scored by array programs in one task.

A task lays the words that many of its queries ask for out as a matrix and multiplies blocks of
queries with it in single precision; postings of all other words are added on top.  What lies
within the error of single precision of the k-th best is scored again in double precision, so
the ranking is the exact one.  Nothing is skipped: every document that shares a word competes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

# A row of a tile. A document: `terms` its words' hashes, `norm` K1 (1 - B + B dl / avgdl), `owners`
# the ids that have its text and `open` the kinds of query each may answer, as bits.
# A query: `kind` its kind, `terms` different words' hashes, `weights` their count times idf.
ROW = "tile int, id long, kind int, norm double, terms array<long>, weights array<double>, owners array<long>, open array<long>"
FOUND = "query_id long, doc_id long, score double"
BATCH = 256  # queries multiplied at once
DENSE = 512  # words in the matrix at most
CELLS = 1 << 23  # of the matrix, and of a batch's scores, at most: 32 MB each
STEP = 1 << 13  # documents whose words are counted at once
COMMON = 0.008  # share of documents times share of queries from which on a word is in the matrix
EPS = 2.0**-24


def _lists(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column and the bounds of its rows; null is an empty row."""
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False) for c in column.chunks]
    sizes = [c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for c in column.chunks]
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]).astype(np.int64))])
    return np.concatenate([*flat, np.zeros(0, dtype)]), bounds


def rounded(score: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL rounds."""
    unit = 10.0**digits
    return np.copysign(np.floor(np.abs(score) * unit + 0.5) / unit, score)


class Tile:
    """One block of documents against one block of queries."""

    def __init__(self, rows: pa.Table, k: int, k1: float, digits: int):
        self.k, self.digits = k, digits
        asks = rows.column("kind").is_valid()
        docs, queries = rows.filter(pa.compute.invert(asks)), rows.filter(asks)
        hashes, self.q_at = _lists(queries.column("terms"), np.int64)
        self.q_weight, _ = _lists(queries.column("weights"), np.float64)
        self.q_id = queries.column("id").to_numpy().astype(np.int64, copy=False)
        self.q_kind = queries.column("kind").to_numpy().astype(np.int64, copy=False)
        words, self.q_term = np.unique(hashes, return_inverse=True)
        self.words, self.docs = len(words), docs.num_rows
        self.owner, self.o_at = _lists(docs.column("owners"), np.int64)
        self.open, _ = _lists(docs.column("open"), np.int64)
        hashes, at = _lists(docs.column("terms"), np.int64)
        norm = docs.column("norm").to_numpy().astype(np.float64, copy=False)
        # Postings by document: f_term and f_part of document i from f_at[i] on.
        counts, term, part = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for a in range(0, self.docs if self.words else 0, STEP):
            b = min(a + STEP, self.docs)
            some = hashes[at[a] : at[b]]
            place = np.minimum(np.searchsorted(words, some), self.words - 1)
            asked = words[place] == some
            pair, tf = np.unique(np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))[asked] * self.words + place[asked], return_counts=True)
            doc, t = np.divmod(pair, self.words)
            counts.append(np.bincount(doc, minlength=b - a))
            term.append(t.astype(np.int32))
            part.append(tf * (k1 + 1) / (tf + norm[a:b][doc]))
        counts, self.f_term, self.f_part = (np.concatenate(x) for x in (counts, term, part))
        self.f_at = np.concatenate([[0], np.cumsum(counts)])
        # And by word: t_doc and t_part of word t from t_at[t] on.
        order = np.argsort(self.f_term, kind="stable")
        self.t_doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)[order]
        self.t_part = self.f_part[order]
        self.t_at = np.concatenate([[0], np.cumsum(np.bincount(self.f_term, minlength=self.words))])

    def found(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query ids, doc ids, scores): the k best of each query in this tile."""
        for kind in np.unique(self.q_kind).tolist():
            yield self._of_kind(kind)

    def _of_kind(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        may = (self.open >> kind) & 1 == 1
        own_doc = np.repeat(np.arange(self.docs), np.diff(self.o_at))[may]
        own, docs = self.owner[may], np.unique(own_doc)
        o_at = np.searchsorted(own_doc, np.append(docs, self.docs))
        local = np.full(self.docs, -1, np.int64)
        local[docs] = np.arange(len(docs))
        p_doc = local[self.t_doc]
        there = p_doc >= 0
        p_at = np.concatenate([[0], np.cumsum(there)])[self.t_at].tolist()
        p_doc, p_part = p_doc[there], self.t_part[there]
        p_thin = p_part.astype(np.float32)
        mine = np.flatnonzero(self.q_kind == kind)
        if not len(p_doc):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

        # The words that many queries ask for and many documents have, as columns.
        spans = [slice(a, b) for a, b in zip(self.q_at[mine].tolist(), self.q_at[mine + 1].tolist())]
        asked = np.bincount(np.concatenate([self.q_term[s] for s in spans]), minlength=self.words) / len(mine)
        worth = asked * np.diff(p_at) / len(docs)
        top = np.argsort(-worth)[: min(DENSE, max(1, CELLS // len(docs)))]
        top = top[worth[top] > COMMON]
        column = np.full(self.words, -1, np.int64)
        column[top] = np.arange(len(top))
        matrix = np.zeros((len(top), len(docs)), np.float32)
        for c, t in enumerate(top.tolist()):
            matrix[c, p_doc[p_at[t] : p_at[t + 1]]] = p_thin[p_at[t] : p_at[t + 1]]

        asking = np.zeros(self.words)  # the weights of one query

        def again(terms: np.ndarray, weights: np.ndarray, some: np.ndarray) -> np.ndarray:
            asking[terms] = weights
            out = [asking[self.f_term[a:b]] @ self.f_part[a:b] for a, b in zip(self.f_at[docs[some]].tolist(), self.f_at[docs[some] + 1].tolist())]
            asking[terms] = 0
            return np.array(out)

        def whole(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            score, shares = np.zeros(len(docs)), np.zeros(len(docs), bool)
            for t, w in zip(terms.tolist(), weights.tolist()):
                a, b = p_at[t], p_at[t + 1]
                score[p_doc[a:b]] += w * p_part[a:b]
                shares[p_doc[a:b]] = True
            some = np.flatnonzero(shares)
            return some, score[some]

        def best(some: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            score = rounded(score, self.digits)
            if len(some) > self.k:
                keep = score >= np.partition(score, -self.k)[-self.k]
                some, score = some[keep], score[keep]
            sizes = o_at[some + 1] - o_at[some]
            ids = np.concatenate([own[a:b] for a, b in zip(o_at[some].tolist(), o_at[some + 1].tolist())])
            score = np.repeat(score, sizes)
            first = np.lexsort((ids, -score))[: self.k]
            return ids[first], score[first]

        out = []
        batch = min(BATCH, max(1, CELLS // len(docs)))
        for start in range(0, len(mine), batch):
            part = spans[start : start + batch]
            dense = np.zeros((len(part), len(top)), np.float32)
            for i, s in enumerate(part):
                c = column[self.q_term[s]]
                dense[i, c[c >= 0]] = self.q_weight[s][c >= 0]
            scores = dense @ matrix if len(top) else np.zeros((len(part), len(docs)), np.float32)
            for i, s in enumerate(part):
                terms, weights, score = self.q_term[s], self.q_weight[s], scores[i]
                rest = column[terms] < 0
                for t, w in zip(terms[rest].tolist(), weights[rest].astype(np.float32)):
                    a, b = p_at[t], p_at[t + 1]
                    if a < b:
                        score[p_doc[a:b]] += w * p_thin[a:b]
                # Each of the sums is off by at most this: every part is below K1 + 1 = 2.5.
                error = (len(terms) + 4) * EPS * 2.5 * float(np.abs(weights).sum())
                seen = []
                for _ in range(min(self.k, len(docs))):
                    at = int(score.argmax())
                    seen.append((at, score[at]))
                    score[at] = -np.inf
                for at, x in seen:
                    score[at] = x
                least = float(seen[-1][1]) - 2 * error - 2 * 10.0**-self.digits
                some = np.flatnonzero(score >= np.float32(least)) if len(seen) == self.k and least > 0 else None
                if some is None or len(some) > 256:  # few or no sharers, weights below zero, or many alike
                    some, exact = whole(terms, weights)
                else:
                    exact = again(terms, weights, some)
                if len(some):
                    ids, exact = best(some, exact)
                    out.append((np.full(len(ids), self.q_id[mine[start + i]]), ids, exact))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out))


def searcher(k: int, k1: float, digits: int):
    """Function for mapInArrow over ROW: the tiles of a partition, one after the other."""

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        tables = [pa.Table.from_batches(rows)]
        if len(of := pa.compute.unique(tables[0].column("tile")).to_pylist()) > 1:
            tables = [tables[0].filter(pa.compute.equal(tables[0].column("tile"), x)) for x in of]
        rows.clear()
        while tables:
            for q, d, s in Tile(tables.pop(), k, k1, digits).found():
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(s)], ["query_id", "doc_id", "score"])

    return search
