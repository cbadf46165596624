"""Same or near-same records across splits: an edit-distance segment join.

Two texts are near when at most one word in eight is edited, sentence order apart.  An edit
breaks only the segments (runs of SEGMENT words) that hold the edited word.  Each text posts
its rarest segments, as many as it takes for k + 1 edits to break them all, k being the most
edits that a near text can lie away; so one of them stays whole in every near text.  There
it is among the posted ones too, or one of the other text's posted ones is here: both sides
take their segments in the same order (`_places`).  As sentences may stand in any order,
every position is an allowed one, and the join is on the segment's hash alone.

Both sides post alike instead of one side all its substrings: those are three to four times
as many rows (see the README).

Segments run across sentence marks, so that a mark lost or gained hides none; but only those
inside a sentence count towards the k + 1, as sentences move.  Texts of up to SHORT words,
whose sentences may hold too few segments, post single words, and so do texts that can be near
one of them.  A longer text with too few segments inside its sentences (most of them of one or
two words) counts those across marks.

A posting is kept once a text, whatever number of tasks stored it.  Segments that many texts
hold are salted: one side is spread over the salts, the other copied to each.

A parity sketch and the number of words travel with both sides: an edited word turns at
most two bits, so the bound refuses pairs in the join itself without losing any.  What is
left is verified with banded dynamic programming (`words.near_pairs`).  Equal texts meet by
their key and need no verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import neardup, texts, words
from lexmill.session import cut, partitions
from lexmill.tables import read

SEGMENT = 3
SHORT = 24  # words; longer texts hold enough segments unless their sentences are of one or two words
ONE_IN = 8
TRAIN, EVAL = 0, 1

STORE = "rec_id long, loaded_at timestamp_ntz, role byte, kind byte, tid long, n int, h0 long, h1 long, ids array<int>"
POSTING = "key long, tid long, p0 long, p1 long"  # p1: 32 bits of the sketch, then the number of words
PER_TASK = 2_500_000  # words of texts whose postings one task joins: about a million rows, 20 MB
PER_SALT = 20_000  # occurrences of a segment that one task holds against the other side


def encode_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rec_id, loaded_at, role, positive, negatives) -> one row a text (STORE)."""
    ids, seen = words.new_ids(), set()
    for batch in batches:
        rows, kinds, all_texts = [], [], []
        for i, (p, ns) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            if p:
                rows.append(i)
                kinds.append(texts.POSITIVE)
                all_texts.append(p)
            for x in {x for x in ns or [] if x}:
                rows.append(i)
                kinds.append(texts.NEGATIVE)
                all_texts.append(x)
        if not rows:
            continue
        flat, offsets = words.encode_batch(all_texts, ids)
        keys, counts = words.text_keys(flat, offsets)
        h = words.histograms(flat, offsets)
        at = pa.array(rows)
        # A text is stored once a task for each side it is on.
        marks = words.mix((batch.column(2).to_numpy()[rows] * 2 + np.array(kinds) + 1).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at),
                batch.column(1).take(at),
                batch.column(2).take(at),
                pa.array(np.array(kinds, dtype=np.int8)),
                pa.array(keys),
                pa.array(counts.astype(np.int32)),
                pa.array(h[:, 0]),
                pa.array(h[:, 1]),
                texts.once(flat, offsets, keys ^ marks, seen),
            ],
            names=["rec_id", "loaded_at", "role", "kind", "tid", "n", "h0", "h1", "ids"],
        )


def reach(n: np.ndarray) -> np.ndarray:
    """The most words that a text near one of `n` words can have."""
    m = n.copy()
    for more in range(1, int(n.max(initial=0)) // (ONE_IN - 1) + 3):
        m = np.where(more <= edits(n + more), n + more, m)
    return m


def edits(n: np.ndarray) -> np.ndarray:
    """The bound of `words.near` for a longer text of `n` words."""
    return np.where(n >= ONE_IN, -(-n // ONE_IN), 0)


def _run(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch without the sentence marks: ids, offsets of the texts, sentence of each."""
    word = flat != 0
    mark = np.cumsum(~word)
    before = np.concatenate(([0], np.cumsum(word)))
    return flat[word], before[offsets], mark[word]


def _segments(ids: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, text) of every run of `size` words of each text."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(np.arange(len(ids)) + size <= offsets[1:][text])
    h = np.full(len(at), size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = words.mix(h + ids[at + j].astype(np.uint32).astype(np.uint64) + np.uint64(j + 1))
    return h, at, text[at]


def _kinds(n: np.ndarray) -> tuple[tuple[int, np.ndarray], ...]:
    """(segment size, which texts of n words post such segments)."""
    return (SEGMENT, n > SHORT), (1, n <= int(reach(np.array([SHORT]))[0]))


def _of_texts(some: np.ndarray, offsets: np.ndarray, *flat: np.ndarray) -> tuple[np.ndarray, ...]:
    """Offsets and flat arrays of the texts that are meant."""
    n = np.diff(offsets)
    kept = np.repeat(some, n)
    return np.concatenate(([0], np.cumsum(n[some]))), *(x[kept] for x in flat)


def count_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of segments by counter (a table of fixed size)."""
    total = np.zeros(neardup.COUNTERS, dtype=np.int64)
    for batch in batches:
        ids, offsets, _ = _run(*texts.unnest(batch.column(0)))
        for size, some in _kinds(np.diff(offsets)):
            own, flat = _of_texts(some, offsets, ids)
            h, _, _ = _segments(flat, own, size)
            total += np.bincount((h % np.uint64(neardup.COUNTERS)).astype(np.int64), minlength=neardup.COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["c", "n"])


def occurrences(store: DataFrame) -> np.ndarray:
    """Occurrences of each counter. They only order the segments, rare ones first, and set
    the salts; any numbers give the same pairs."""
    counts = store.where("ids is not null").select("ids").mapInArrow(count_segments, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()  # at most COUNTERS rows
    n = np.zeros(neardup.COUNTERS, dtype=np.int64)
    n[rows.column("c").to_numpy()] = rows.column("n").to_numpy()
    return np.minimum(n, np.iinfo(np.int32).max).astype(np.int32)


SKETCH = 96  # bits: whether the number of words in each class is odd


def parity(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 2) int64: SKETCH bits, then the number of words in 32 bits."""
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    of = (words.mix(ids.astype(np.uint32).astype(np.uint64) + np.uint64(0x5A5A5A5A)) % np.uint64(SKETCH)).astype(np.int64)
    odd = (np.bincount(text * SKETCH + of, minlength=len(n) * SKETCH) & 1).astype(np.uint8).reshape(len(n), SKETCH)
    first = np.packbits(odd[:, :64], axis=1).view(np.int64).ravel()
    second = np.packbits(odd[:, 64:], axis=1).view(np.uint32).astype(np.uint64).ravel()
    return np.stack((first, ((second << np.uint64(32)) | n.astype(np.uint64)).view(np.int64)), axis=1)


def _broken_by(chosen: np.ndarray, offsets: np.ndarray, size: int, most: np.ndarray) -> np.ndarray:
    """How many edits it takes to break the chosen segments of each text, up to `most`."""
    end = len(chosen)
    at = np.where(chosen, np.arange(end), end)
    following = np.concatenate((np.minimum.accumulate(at[::-1])[::-1], np.full(size + 1, end)))
    count, here = np.zeros(len(offsets) - 1, dtype=np.int64), offsets[:-1].copy()
    open_ = np.arange(len(count))
    while len(open_):
        p = following[here[open_]]
        held = p < offsets[1:][open_]
        open_, p = open_[held], p[held]
        count[open_] += 1
        here[open_] = p + size
        open_ = open_[count[open_] < most[open_]]
    return count


def _places(ids: np.ndarray, offsets: np.ndarray, sentence: np.ndarray, size: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the segments of `size` words that each text posts.

    By occurrences, then hash, from the rarest on: the fewest that it takes k + 1 edits to
    break. A segment that stays whole in a near text comes, in the text whose last posted one
    is the later, before that one; so it is posted there as well."""
    h, at, text = _segments(ids, offsets, size)
    if not len(h):
        return h, text
    n = np.diff(offsets)
    need = edits(reach(n)) + 1
    rare = number[(h % np.uint64(neardup.COUNTERS)).astype(np.int64)]
    order = np.lexsort((h, rare, text))
    first = np.searchsorted(text, np.arange(len(n)))
    total = np.bincount(text, minlength=len(n))
    rank = np.empty(len(ids), dtype=np.int64)
    rank[at[order]] = np.arange(len(h)) - first[text]
    whole = np.zeros(len(ids), dtype=bool)
    whole[at] = sentence[at] == sentence[at + size - 1]
    of = np.repeat(np.arange(len(n)), n)
    has = np.zeros(len(ids), dtype=bool)
    has[at] = True
    few = _broken_by(whole, offsets, size, need) < need
    whole |= has & few[of]
    low, high = np.minimum(need, total), total.copy()  # the number to post lies between
    while (low < high).any():
        middle = (low + high) // 2
        enough = _broken_by(whole & (rank < middle[of]), offsets, size, need) >= need
        high = np.where(enough & (low < high), middle, high)
        low = np.where(~enough & (low < high), middle + 1, low)
    posted = rank[at] < high[text]
    # One posting a hash: a segment that occurs again in its text is the same to the join.
    h, text = h[posted], text[posted]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])))
    return h[fresh], text[fresh]


def postings(number, spread: bool):
    """Function for mapInArrow: (leg, tid, ids) -> POSTING. The leg is part of the key.

    `spread`: a row of a segment with several salts goes to one of them; else to each."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = number.value
        held = count[count > 0]
        per_salt = max(PER_SALT, 4 * int(held.mean())) if len(held) else PER_SALT
        for batch in batches:
            leg = batch.column(0).to_numpy()
            tid = batch.column(1).to_numpy()
            ids, offsets, sentence = _run(*texts.unnest(batch.column(2)))
            if not len(ids):
                continue
            odd = parity(ids, offsets)
            key, of = [], []
            for size, some in _kinds(np.diff(offsets)):
                own, flat, marks = _of_texts(some, offsets, ids, sentence)
                h, text = _places(flat, own, marks, size, count)
                key.append(h)
                of.append(np.flatnonzero(some)[text])
            key, of = np.concatenate(key), np.concatenate(of)
            salts = -(-count[(key % np.uint64(neardup.COUNTERS)).astype(np.int64)].astype(np.int64) // per_salt)
            salts = np.maximum(salts, 1)
            key = words.mix(key ^ (leg[of].astype(np.uint64) + np.uint64(0x1234567)))
            if spread:
                salt = (words.mix(tid[of].view(np.uint64)) % salts.astype(np.uint64)).astype(np.int64)
            else:
                salt = np.arange(int(salts.sum())) - np.repeat(np.cumsum(salts) - salts, salts)
                key, of = np.repeat(key, salts), np.repeat(of, salts)
            with np.errstate(over="ignore"):
                key = key + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            arrays = [key.view(np.int64), tid[of], odd[of, 0], odd[of, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "tid", "p0", "p1"])

    return post


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded positives and negatives of the records that have a split."""
    role = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("valid", "test"), EVAL).cast("byte")
    source = read(spark, sf_dir, "training_record").select(
        "rec_id", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), role.alias("role"), "positive", "negatives"
    )
    return cut(source.where("rec_id is not null and role is not null").mapInArrow(encode_records, STORE).where("n > 0"), "p3-store")


def pair_texts(store: DataFrame) -> DataFrame:
    """Distinct candidate pairs of text keys from the segment join."""
    # leg 0: evaluation texts and training positives; leg 1: training negatives and evaluation positives
    leg = lambda cond: F.when(cond, F.lit(0)).otherwise(F.lit(1)).cast("byte").alias("leg")
    with_ids = store.where("ids is not null")
    one = with_ids.where(f"role = {EVAL} or kind = {texts.NEGATIVE}").select(leg(F.col("role") == EVAL), "tid", "ids")
    other = with_ids.where(f"kind = {texts.POSITIVE}").select(leg(F.col("role") == TRAIN), "tid", "ids")
    number = store.sparkSession.sparkContext.broadcast(occurrences(store))
    columns = ("key", "tid", "p0", "p1")
    # Placed by key first: one row a text is then a matter within the partition.
    tasks = partitions(store.sparkSession, store.where("ids is not null").agg(F.sum("n")).first()[0] or 0, PER_TASK)
    side = lambda df, x, spread: df.mapInArrow(postings(number, spread), POSTING).repartition(tasks, "key").distinct().select(*[F.col(c).alias(c if c == "key" else c + x) for c in columns])
    met = side(one, "a", False).join(side(other, "b", True), "key").where("tida <> tidb").select(F.col("tida").alias("a"), F.col("tidb").alias("b"), "p0a", "p1a", "p0b", "p1b")
    count = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    k = F.ceil(F.greatest(count("p1a"), count("p1b")) / ONE_IN)
    apart = F.abs(count("p1a") - count("p1b"))
    bits = F.bit_count(F.col("p0a").bitwiseXOR(F.col("p0b"))) + F.bit_count(F.shiftrightunsigned(F.col("p1a").bitwiseXOR(F.col("p1b")), 32))
    met = met.where((bits + apart <= 2 * k) & (apart <= k))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def record_pairs(store: DataFrame) -> DataFrame:
    """(rec_a, rec_b) for the records of `store`, see `p3_found`."""
    pairs = cut(pair_texts(store), "p3-pairs")
    near = cut(neardup.links(store, pairs), "p3-near")
    # Texts that can make a case: near another one, or on both sides themselves.
    has = lambda role, kind: F.max((F.col("role") == role) & (F.col("kind") == kind))
    sides = store.groupBy("tid").agg(
        has(EVAL, texts.POSITIVE).alias("ep"), has(EVAL, texts.NEGATIVE).alias("en"), has(TRAIN, texts.POSITIVE).alias("tp"), has(TRAIN, texts.NEGATIVE).alias("tn")
    )
    both_sides = sides.where("(ep and (tp or tn)) or (en and tp)").select("tid")
    asked = both_sides.union(near.select("a")).union(near.select("b")).distinct()
    # Of a record delivered again only the last delivery counts.
    again = store.groupBy("rec_id").agg(F.min("loaded_at").alias("first"), F.max("loaded_at").alias("at")).where("first < at").select("rec_id", "at")
    member = store.select("rec_id", "loaded_at", "role", "kind", "tid").join(asked, "tid", "left_semi").join(again, "rec_id", "left")
    member = member.where(F.col("at").isNull() | F.col("loaded_at").eqNullSafe(F.col("at"))).select("rec_id", "role", "kind", "tid")
    member = cut(member.distinct(), "p3-members")
    both = near.union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda role, kind, rec, tid: member.where(F.col("role") == role).where(
        F.lit(True) if kind is None else F.col("kind") == kind
    ).select(F.col("rec_id").alias(rec), F.col("tid").alias(tid)).distinct()
    out = None
    for eval_kind, train_kind in ((texts.POSITIVE, None), (texts.NEGATIVE, texts.POSITIVE)):
        e, t = side(EVAL, eval_kind, "x", "a"), side(TRAIN, train_kind, "y", "b")
        same = e.join(t, e["a"] == t["b"]).select("x", "y")
        close = e.join(both, "a").select("x", "b").join(t, "b").select("x", "y")
        out = same.union(close) if out is None else out.union(same).union(close)
    return out.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train record and a valid or test record, where the positive of one is the
    same or nearly the same as the positive or a negative of the other; smaller id first.

    Null and empty texts match nothing; null splits and null ids are left out; repeated rows
    and repeated negatives count once; an empty table gives no rows."""
    return record_pairs(_store(spark, sf_dir))


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split and source: pairs, and evaluation records concerned."""
    pairs = p3_found(spark, sf_dir)
    ends = pairs.select(F.explode(F.array("rec_a", "rec_b")).alias("rec_id"), "rec_a", "rec_b")
    told = read(spark, sf_dir, "training_record").where("split in ('valid', 'test')").groupBy("rec_id").agg(F.max(F.struct("loaded_at", "split", "source")).alias("p"))
    told = told.select("rec_id", "p.split", "p.source")
    by = ends.join(told, "rec_id").groupBy("split", "source")
    return by.agg(F.count("*").alias("pairs"), F.countDistinct("rec_id").alias("eval_records"))
