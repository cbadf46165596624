"""Stores of encoded texts shared by the near-duplicate operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lexmill.llm import words


POSITIVES = "rec_id long, loaded_at timestamp_ntz, tid long, n int, h0 long, h1 long, ids array<int>"
POSITIVE, NEGATIVE = 0, 1



def as_lists(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def unnest(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def store_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, loaded_at, text) -> POSITIVES; ids is null for a text
    that this task has stored already."""
    ids, seen = words.new_ids(), set()
    for batch in batches:
        flat, offsets = words.encode_batch(batch.column(2).to_pylist(), ids)
        keys, counts = words.text_keys(flat, offsets)
        h = words.histograms(flat, offsets)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(keys), pa.array(counts.astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1]), once(flat, offsets, keys, seen)],
            names=["rec_id", "loaded_at", "tid", "n", "h0", "h1", "ids"],
        )


def once(flat: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seen: set) -> pa.Array:
    if len(seen) > 1_000_000:
        seen.clear()
    fresh = np.zeros(len(keys), dtype=bool)
    for i, k in enumerate(keys.tolist()):
        if k not in seen:
            seen.add(k)
            fresh[i] = True
    lengths = np.diff(offsets)
    kept = flat[np.repeat(fresh, lengths)]
    starts = np.concatenate(([0], np.cumsum(np.where(fresh, lengths, 0)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(kept), mask=pa.array(~fresh))
