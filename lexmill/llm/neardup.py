"""Near-duplicate records with small edits: Hamming codes in BK-trees.

Every distinct text gets a code of PIECES x 16 bits (SimHash of its words, order apart) and
BANDS keys of weighted min-hashes (rare words weigh more).  A band key names a shard.  Each
shard has one BK-tree for every piece of the code: children are keyed by the integer Hamming
distance to their parent, and a text follows only edges within RADIUS.  Near texts differ in
few of all bits, so in some piece they differ in at most RADIUS; whatever any tree finds is a
candidate.  Candidates are compared word by word (`words.near_pairs`), and the links that
hold are joined into groups by union-find.

Why shards by band key: one tree over all texts, broadcast to all tasks, makes the work
quadratic and the broadcast grow with the data.  Word weights come from document counts
over all texts, kept in a table of fixed size (2^18 counters), the only thing broadcast.

A shard of more than SHARD_LIMIT texts is parted by the halves of the pieces: texts within 1
of each other in a piece agree in one of its halves, so no pair of the shard's trees is lost.
What is still too large then is cut into blocks, each pair of blocks a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import texts, words
from lexmill.llm.groups import components
from lexmill.session import cut, partitions
from lexmill.tables import read

COUNTERS = 1 << 18
BANDS, ROWS = 12, 4
PIECES = 8  # of 16 bits each
RADIUS = 1  # bits within which a piece must agree; `halves` relies on it being 1
FAR = 44  # of all 128 bits: near texts differ in about 9, the most seen is 26
SHARD_LIMIT = 2_000  # texts in one BK-tree; larger shards are parted
ONE_IN = 8
PAIRS_AT_ONCE = 4_000_000
PER_SALT = 2_000  # records of a group that one task pairs with the rest

_POP = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ b).view(np.uint64)
    return sum(_POP[((x >> np.uint64(s)) & np.uint64(0xFFFF)).astype(np.int64)].astype(np.int32) for s in (0, 16, 32, 48))


def pieces_of(codes: np.ndarray) -> np.ndarray:
    """(texts, PIECES) 16-bit pieces of (texts, 2) int64 codes."""
    return np.ascontiguousarray(codes).view(np.uint16).reshape(len(codes), PIECES)


class BKTrees:
    """Many BK-trees over 16-bit values at once, built and asked level by level.

    A node is a different value of its tree.  `visited` counts the nodes that questions
    were compared with."""

    EDGES = 17  # distances 0 to 16

    def __init__(self, tree: np.ndarray, value: np.ndarray):
        """tree, value: the different (tree, value) pairs to index, ordered by tree."""
        self.value = value
        self.visited = 0
        n = len(tree)
        at_root = np.concatenate(([True], tree[1:] != tree[:-1])) if n else np.zeros(0, bool)
        self.root_tree, self.root = tree[at_root], np.flatnonzero(at_root)
        node = self.root[np.cumsum(at_root) - 1] if n else np.zeros(0, np.int64)  # where each value stands now
        left = np.flatnonzero(~at_root)
        edges, children = [], []
        while len(left):
            key = node[left] * self.EDGES + _POP[value[left] ^ value[node[left]]]
            own, first, back = np.unique(key, return_index=True, return_inverse=True)
            child = left[first]  # the first value with this edge becomes the child
            edges.append(own)
            children.append(child)
            node[left] = child[back]
            stays = np.ones(len(left), dtype=bool)
            stays[first] = False
            left = left[stays]
        edge = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edge)
        self.edge, self.child = edge[order], child[order]

    def near(self, tree: np.ndarray, value: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(question, node) wherever the value lies within the radius in the question's tree."""
        if not len(self.root) or not len(tree):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.searchsorted(self.root_tree, tree)
        k[k == len(self.root)] = 0
        asked = np.flatnonzero(self.root_tree[k] == tree)
        node = self.root[k[asked]]
        questions, nodes = [], []
        while len(asked):
            self.visited += len(asked)
            d = _POP[value[asked] ^ self.value[node]].astype(np.int64)
            hit = d <= radius
            questions.append(asked[hit])
            nodes.append(node[hit])
            go_q, go_n = [], []
            for r in range(-radius, radius + 1):
                e = d + r
                key = node * self.EDGES + e
                at = np.searchsorted(self.edge, key)
                at[at == len(self.edge)] = 0
                there = (e >= 0) & (e < self.EDGES) & (self.edge[at] == key) if len(self.edge) else np.zeros(len(key), bool)
                go_q.append(asked[there])
                go_n.append(self.child[at[there]])
            asked, node = np.concatenate(go_q), np.concatenate(go_n)
        return np.concatenate(questions), np.concatenate(nodes)


def _distinct_words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of each different word of each text, ordered by text."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    both = (text << np.uint64(32)) | flat.astype(np.uint32).astype(np.uint64)
    both = np.unique(both[flat != 0])
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _counter(word: np.ndarray) -> np.ndarray:
    return (words.mix(word.astype(np.uint64)) % np.uint64(COUNTERS)).astype(np.int64)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold a word, by counter; counter -1 counts the texts."""
    total, texts_seen = np.zeros(COUNTERS, dtype=np.int64), 0
    for batch in batches:
        flat, offsets = texts.unnest(batch.column(0))
        _, word = _distinct_words(flat, offsets)
        total += np.bincount(_counter(word), minlength=COUNTERS)
        texts_seen += batch.num_rows
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(([-1], at)).astype(np.int32)), pa.array(np.concatenate(([texts_seen], total[at])))], names=["c", "n"]
    )


def weights(store: DataFrame) -> np.ndarray:
    """float32 weight of each counter: log(1 + texts / texts with it)."""
    counts = store.where("ids is not null").select("ids").mapInArrow(count_words, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()  # at most COUNTERS + 1 rows
    c, n = rows.column("c").to_numpy(), rows.column("n").to_numpy()
    total = int(n[c == -1].sum())
    by = np.ones(COUNTERS)
    by[c[c >= 0]] = n[c >= 0]
    return np.log1p(total / by).astype(np.float32)


def signer(weight):
    """Function for mapInArrow: (tid, ids) -> (tid, c0, c1, n, keys). No ids are empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = BANDS * ROWS
        salt = words.mix(np.arange(1, hashes + 3, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            flat, offsets = texts.unnest(batch.column(1))
            text, word = _distinct_words(flat, offsets)
            if not len(text):
                continue
            vocabulary, at = np.unique(word, return_inverse=True)
            w = weight.value[_counter(vocabulary)]
            base = words.mix(vocabulary.astype(np.uint64) + np.uint64(0x51ED2700))
            starts = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            bands = np.zeros((BANDS, len(starts)), dtype=np.uint64)
            codes = np.zeros((len(starts), 2), dtype=np.uint64)
            with np.errstate(over="ignore", divide="ignore"):
                for h in range(hashes):
                    u = ((words.mix(base ^ salt[h]) >> np.uint64(40)).astype(np.float32) + 0.5) / np.float32(1 << 24)
                    least = np.minimum.reduceat((-np.log(u) / w)[at], starts)
                    bands[h // ROWS] = words.mix(bands[h // ROWS] ^ least.view(np.uint32).astype(np.uint64) ^ salt[h])
                bands = words.mix(bands ^ np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])
                half = np.diff(np.concatenate((starts, [len(text)])))
                for c in range(2):
                    sign_bits = words.mix(base ^ salt[hashes + c])
                    for b in range(64):
                        ones = np.add.reduceat(((sign_bits >> np.uint64(b)) & np.uint64(1)).astype(np.int32)[at], starts)
                        codes[:, c] |= (2 * ones > half).astype(np.uint64) << np.uint64(b)
            keys = np.ascontiguousarray(bands.T).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text[starts])),
                    pa.array(codes[:, 0].view(np.int64)),
                    pa.array(codes[:, 1].view(np.int64)),
                    pa.array(np.add.reduceat((flat != 0).astype(np.int32), offsets[:-1])[text[starts]].astype(np.int32)),
                    texts.as_lists(keys.ravel(), np.arange(len(starts) + 1) * BANDS),
                ],
                names=["tid", "c0", "c1", "n", "keys"],
            )

    return sign


def alike(n, m):
    """Whether texts of n and m words can be near: their lengths differ by no more than the edits."""
    return np.abs(n - m) <= -(-np.maximum(n, m) // ONE_IN) if isinstance(n, np.ndarray) else abs(n - m) <= -(-max(n, m) // ONE_IN)


def tree_pairs(shard: np.ndarray, side: np.ndarray, only: np.ndarray, tid: np.ndarray, codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, int]:
    """((pairs, 2) text keys a < b, nodes visited) that some tree of their shard brings
    together. `only`: the one piece to look at, -1 for all."""
    piece = pieces_of(codes)
    found, visited = [], 0
    for j in range(PIECES):
        use = (only < 0) | (only == j)
        indexed, asking = np.flatnonzero(use & (side != 2)), np.flatnonzero(use & (side != 1))
        value = piece[:, j].astype(np.int64)
        key = (shard << np.int64(16)) | value  # shard is a number within the call
        known, members_of = np.unique(key[indexed], return_inverse=True)
        trees = BKTrees(known >> 16, known & 0xFFFF)
        wanted, askers_of = np.unique(key[asking], return_inverse=True)
        q, node = trees.near(wanted >> 16, wanted & 0xFFFF, RADIUS)
        visited += trees.visited
        # From values to the texts that have them.
        by_node, by_q = np.argsort(members_of, kind="stable"), np.argsort(askers_of, kind="stable")
        n_node, n_q = np.bincount(members_of, minlength=len(known)), np.bincount(askers_of, minlength=len(wanted))
        s_node, s_q = np.cumsum(n_node) - n_node, np.cumsum(n_q) - n_q
        total = n_node[node] * n_q[q]
        for part in np.split(np.arange(len(q)), np.flatnonzero(np.diff(np.cumsum(total) // PAIRS_AT_ONCE)) + 1):
            many = total[part]
            hit = np.repeat(part, many)
            k = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            a = asking[by_q[s_q[q[hit]] + k // n_node[node[hit]]]]
            b = indexed[by_node[s_node[node[hit]] + k % n_node[node[hit]]]]
            # Within a shard each pair is asked from both ends.
            keep = (tid[a] != tid[b]) & ((side[a] != 0) | (tid[a] < tid[b]))
            a, b = a[keep], b[keep]
            close = alike(n[a], n[b]) & (distance(codes[a, 0], codes[b, 0]) + distance(codes[a, 1], codes[b, 1]) <= FAR)
            a, b = tid[a[close]], tid[b[close]]
            found.append(np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0))
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return np.unique(pairs, axis=0), visited


def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, side, only, tid, c0, c1, n) -> candidate pairs a < b. side: 0 both indexed and
    asked, 1 indexed only, 2 asked only (blocks of a shard)."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    shards, sides, only, tids, c0, c1, n = (table.column(c).to_numpy() for c in ("shard", "side", "only", "tid", "c0", "c1", "n"))
    order = np.lexsort((tids, sides, shards))
    shard, side, tid = shards[order], sides[order], tids[order]
    fresh = np.concatenate(([True], (shard[1:] != shard[:-1]) | (tid[1:] != tid[:-1]) | (side[1:] != side[:-1])))
    order, shard = order[fresh], shard[fresh]
    new = np.concatenate(([True], shard[1:] != shard[:-1]))
    number = np.cumsum(new) - 1
    sizes = np.bincount(number)
    more = sizes[number] > 1  # a text alone in its shard has no partner
    order, number, sizes = order[more], number[more], sizes[number[more]]
    if not len(order):
        return
    # Whole shards at a time, as many as make a bounded number of pairs.
    cost = np.cumsum(sizes)  # summed over a shard's rows: its size squared
    last = np.concatenate((number[1:] != number[:-1], [True]))
    bounds = np.flatnonzero(last)[np.concatenate((np.diff(cost[last] // PAIRS_AT_ONCE) > 0, [True]))] + 1
    at = 0
    for end in bounds.tolist():
        rows = order[at:end]
        codes = np.stack((c0[rows], c1[rows]), axis=1)
        pairs, _ = tree_pairs(number[at:end] - number[at], sides[rows], only[rows], tids[rows], codes, n[rows])
        at = end
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, ids_a, ids_b) that are near each other word by word."""
    for batch in batches:
        keep = pa.array(words.near_pairs(*texts.unnest(batch.column(2)), *texts.unnest(batch.column(3)), ONE_IN))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


TEXT = ["tid", "c0", "c1", "n"]


def halves(rows: DataFrame) -> DataFrame:
    """`rows` of shards, each parted by the halves of every piece: (shard, only, ...). Texts
    within 1 bit of each other in a piece share one of its halves."""
    parts = []
    for j in range(PIECES):
        value = F.shiftrightunsigned(F.col("c0" if j < 4 else "c1"), 16 * (j % 4))
        for h in range(2):
            half = F.shiftrightunsigned(value, 8 * h).bitwiseAND(F.lit(0xFF))
            parts.append(F.struct(F.lit(j).alias("only"), F.xxhash64("shard", F.lit(2 * j + h), half).alias("shard")))
    return rows.select(*TEXT, F.explode(F.array(*parts)).alias("p")).select("p.shard", "p.only", *TEXT)


def blocks(rows: DataFrame, sizes: DataFrame, limit: int) -> DataFrame:
    """Shards over the limit cut into blocks; each pair of blocks becomes a shard of its own
    (one block's trees, the other's questions)."""
    placed = rows.join(sizes.withColumn("blocks", F.ceil(F.col("size") / limit).cast("int")), "shard")
    own = F.pmod(F.xxhash64("tid"), F.col("blocks")).cast("int")
    placed = placed.select("shard", "only", *TEXT, own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return placed.select(F.xxhash64("shard", low, high).alias("shard"), side.alias("side"), "only", *TEXT)


def candidates(signs: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """Distinct pairs of text keys that some tree of a shard brings together.

    No shard of more than `limit` texts is held whole, and none is capped."""
    spark = signs.sparkSession
    over = lambda df: df.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > limit)
    shards = signs.select(F.explode("keys").alias("shard"), F.lit(-1).alias("only"), *TEXT)
    large = cut(over(shards), "p4-large")
    kinds = lambda df, side: df.select("shard", F.lit(side).alias("side") if side is not None else "side", "only", *TEXT)
    rows = signs.count() * BANDS
    placed = kinds(shards, 0)
    if not large.isEmpty():
        placed = kinds(shards.join(large, "shard", "left_anti"), 0)
        parted = cut(halves(shards.join(large, "shard", "left_semi")), "p4-parted")
        larger = cut(over(parted), "p4-larger")
        placed = placed.unionByName(kinds(parted.join(larger, "shard", "left_anti"), 0)).unionByName(kinds(blocks(parted, larger, limit), None))
        rows += parted.count()
    tasks = partitions(spark, rows, 1_000_000)
    placed = placed.select("shard", F.col("side").cast("byte").alias("side"), F.col("only").cast("byte").alias("only"), *TEXT).repartition(tasks, "shard")
    return placed.mapInArrow(search_shards, "a long, b long").distinct()


def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, lengths, histograms) -> the pairs that their histograms do not rule out."""
    for batch in batches:
        na, nb, *h = (batch.column(i).to_numpy() for i in range(2, 8))
        far = words.histogram_distance(np.stack(h[:2], axis=1), np.stack(h[2:], axis=1))
        keep = pa.array(far <= 2 * -(-np.maximum(na, nb) // ONE_IN))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def links(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of different texts that are near each other, from candidate pairs.

    Histograms (16 bytes a text) rule out most pairs before any words are moved."""
    one = store.where("ids is not null")
    flat = one.select("tid", "n", "h0", "h1").join(pairs.select(F.explode(F.array("a", "b")).alias("tid")).distinct(), "tid", "left_semi").dropDuplicates(["tid"])
    side = lambda x: flat.select(*[F.col(c).alias(x if c == "tid" else c + x) for c in flat.columns])
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "h0a", "h1a", "h0b", "h1b")
    met = cut(met.mapInArrow(plausible, "a long, b long"), "near-pairs")
    asked = met.select(F.explode(F.array("a", "b")).alias("tid")).distinct()
    known = cut(one.select("tid", "ids").join(asked, "tid", "left_semi").dropDuplicates(["tid"]), "near-texts")
    full = met.join(known.select(F.col("tid").alias("a"), F.col("ids").alias("ids_a")), "a")
    full = full.join(known.select(F.col("tid").alias("b"), F.col("ids").alias("ids_b")), "b")
    return full.select("a", "b", "ids_a", "ids_b").mapInArrow(verify, "a long, b long")


def text_groups(store: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """(tid, root) for every text that is near another one."""
    weight = store.sparkSession.sparkContext.broadcast(weights(store))
    texts_once = store.where("ids is not null").select("tid", "ids")
    signs = cut(texts_once.mapInArrow(signer(weight), "tid long, c0 long, c1 long, n int, keys array<long>"), "p4-signs")
    pairs = cut(candidates(signs, limit), "p4-pairs")
    return components(links(store, pairs), name="p4").select(F.col("node").alias("tid"), "root")


def group_records(records: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """(rec_id, grp, members, links) for `records(rec_id, text, loaded_at)`.

    Groups hold the records whose texts are the same, or near each other, directly or
    through others; `links` counts the record's other texts it was linked with through its
    group.  A record delivered again counts once, by its last text.  Null and wordless texts
    are in no group and give no row; a text like no other makes a group of one.  An empty
    table gives no rows; further columns are ignored."""
    source = records.where("rec_id is not null and text is not null").select("rec_id", "loaded_at", "text")
    store = cut(source.mapInArrow(texts.store_positives, texts.POSITIVES), "p4-store")
    roots = text_groups(store.where("n > 0"), limit)
    member = store.groupBy("rec_id").agg(F.max(F.struct("loaded_at", "tid", "n")).alias("p")).where("p.n > 0").select("rec_id", "p.tid")
    named = member.join(roots, "tid", "left").select("rec_id", "tid", F.coalesce("root", "tid").alias("grp"))
    return cut(named, "p4-members")


def _positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "training_record").select("rec_id", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), F.col("positive").alias("text"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its group and the group's numbers of records and of different texts."""
    named = group_records(_positives(spark, sf_dir))
    sizes = named.groupBy("grp", "tid").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("members"), F.count("*").alias("texts"))
    return named.join(sizes, "grp").select("rec_id", "grp", "members", "texts")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of records in one group, the smaller rec_id first.

    Large groups are spread: one side by a salt, the other copied to each."""
    named = group_records(_positives(spark, sf_dir)).select("rec_id", "grp")
    many = named.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp", F.ceil(F.col("n") / PER_SALT).cast("int").alias("salts"))
    named = named.join(many, "grp")
    a = named.select("grp", F.pmod(F.xxhash64("rec_id"), F.col("salts")).cast("int").alias("salt"), F.col("rec_id").alias("rec_a"))
    b = named.select("grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("rec_id").alias("rec_b"))
    return a.join(b, ["grp", "salt"]).where("rec_a < rec_b").select("rec_a", "rec_b")
