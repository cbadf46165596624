import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import leaks, neardup, overlap, texts, words

RNG = random.Random(5)
VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne") for b in ("ra", "su", "to", "vi", "wex") for c in ("n", "rt", "l", "ms", "d", "x")]


def sentence(n=14):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n)).capitalize() + "."


def passage(k=4):
    return " ".join(sentence() for _ in range(k))


def edited(text, n):
    w = text.split()
    for i in RNG.sample(range(len(w)), n):
        w[i] = RNG.choice(["changed", "words", "here"])
    return " ".join(w)


def moved(text):
    s = [x.rstrip(".") + "." for x in text.split(". ")]
    return " ".join(reversed(s))


def test_normal_forms():
    ids = words.new_ids()
    same = ["The Co-\nDeveloper pays $703,880 now.", "THE *Co­Developer* pays ＄703880 now", "the co-developer  pays, $703,880 now!"]
    keys = {int(words.text_keys(*words.encode_batch([t], ids))[0][0]) for t in same}
    assert len(keys) == 1


def test_batches_agree_with_single_texts():
    ids = words.new_ids()
    batch = ["A b. C d", None, "", "été x. y", "q-\nr s", " . ", "A & B", "東京 x"]
    flat, offsets = words.encode_batch(batch, ids)
    for i, t in enumerate(batch):
        own = words.encode(t, ids) if t else np.zeros(0, np.int32)
        assert [x for x in flat[offsets[i] : offsets[i + 1]] if x] == [x for x in own if x]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_is_the_edit_distance():
    for _ in range(400):
        a = np.array([RNG.randint(1, 4) for _ in range(RNG.randint(0, 12))], dtype=np.int32)
        b = np.array([RNG.randint(1, 4) for _ in range(RNG.randint(0, 12))], dtype=np.int32)
        k = RNG.randint(0, 6)
        assert words.banded(a, b, k) == min(levenshtein(a, b), k + 1)


def test_near_bounds_and_order():
    ids = words.new_ids()
    e = lambda t: words.encode(t, ids)
    t = passage()
    assert words.near(e(t), e(edited(t, 5))) and words.near(e(t), e(moved(t)))
    assert not words.near(e(t), e(edited(t, 16))) and not words.near(e(t), e(passage()))
    assert not words.near(e(""), e(""))


def test_shuffled_words_are_not_moved_sentences():
    """Words shuffled inside eight of ten sentences: far over the edits allowed."""
    ids, rng = words.new_ids(), random.Random(2)
    said = [[f"w{i}x{j}" for j in range(10)] for i in range(10)]
    mixed = [rng.sample(s, 10) if i < 8 else s for i, s in enumerate(said)]
    e = lambda t: words.encode(" ".join(" ".join(s) + "." for s in t), ids)
    assert not words.near(e(said), e(mixed)) and words.near(e(said), e(said[5:] + said[:5]))


def test_moved_sentences_with_lost_and_gained_marks():
    ids = words.new_ids()
    for _ in range(60):
        s = [sentence(RNG.randint(6, 16)) for _ in range(6)]
        a, b = " ".join(s), " ".join(s[k] for k in (3, 0, 4, 1, 2, 5))
        lost = RNG.choice([". ", "! "]).join(b.split(". ")[:3]) + " " + " ".join(b.split(". ")[3:])
        for x, y in ((a, b), (a, edited(b, 3)), (a, lost), (lost, a)):
            assert words.near(words.encode(x, ids), words.encode(y, ids))


def test_a_repeated_sentence_finds_its_own_place():
    ids = words.new_ids()
    s = [sentence(12) for _ in range(3)]
    e = lambda *k: words.encode(" ".join(s[i] for i in k), ids)
    assert words.near(e(0, 1, 0, 2), e(0, 0, 1, 2)) and not words.near(e(0, 1, 0, 2), e(0, 1, 1, 2))


def test_pairs_agree_with_single_calls():
    ids = words.new_ids()
    t = [passage() for _ in range(6)] + ["", "one", "one two"]
    t += [edited(t[0], 3), moved(t[1]), edited(t[2], 20)]
    pairs = [(x, y) for x in t for y in t]
    a, b = (words.encode_batch([p[i] for p in pairs], ids) for i in (0, 1))
    got = words.near_pairs(*a, *b)
    assert got.tolist() == [words.near(words.encode(x, ids), words.encode(y, ids)) for x, y in pairs]


def test_histograms_never_refuse_near_texts():
    ids = words.new_ids()
    for _ in range(50):
        a = passage()
        b = edited(a, RNG.randint(0, 7))
        h = words.histograms(*words.encode_batch([a, b], ids))
        assert words.histogram_distance(h[:1], h[1:])[0] <= 2 * 7


def test_bk_trees_find_what_a_scan_finds():
    rng = np.random.default_rng(1)
    tree = np.repeat(np.arange(6), [1, 5, 40, 300, 0, 900])
    value = rng.integers(0, 1 << 16, len(tree))
    value[50:60] = value[40:50] ^ 4
    known = np.unique(tree << 16 | value)
    for radius in (0, 1, 3):
        trees = neardup.BKTrees(known >> 16, known & 0xFFFF)
        asked_tree, asked = np.append(tree, [4, 9]), np.append(value, [1, 2])
        q, node = trees.near(asked_tree, asked, radius)
        got = set(zip(q.tolist(), known[node].tolist()))
        want = {(i, int(k)) for i, (t, v) in enumerate(zip(asked_tree, asked)) for k in known if k >> 16 == t and int(k & 0xFFFF ^ v).bit_count() <= radius}
        assert got == want
    empty = neardup.BKTrees(known[:0], known[:0])
    assert len(empty.near(tree, value, 3)[0]) == 0


def test_bk_trees_visit_a_small_share():
    value = np.unique(np.random.default_rng(2).integers(0, 1 << 16, 2000))
    trees = neardup.BKTrees(np.zeros(len(value), np.int64), value)
    trees.near(np.zeros(len(value), np.int64), value, neardup.RADIUS)
    assert trees.visited < 0.2 * len(value) ** 2


def test_tree_pairs_are_those_of_all_pieces():
    rng = np.random.default_rng(3)
    n = 400
    codes = rng.integers(-(1 << 62), 1 << 62, (n, 2))
    for i in range(0, n, 2):  # partners with 12 of 128 bits turned
        turned = rng.choice(128, 12, replace=False)
        codes[i + 1] = codes[i] ^ np.array([sum(1 << int(b) for b in turned if b < 62), sum(1 << int(b - 64) for b in turned if 64 <= b < 126)])
    shard, tid, size = np.arange(n) // 100, rng.permutation(n), np.full(n, 40)
    piece = neardup.pieces_of(codes)
    want = set()
    for i in range(n):
        for j in range(n):
            far = neardup.distance(codes[i : i + 1, 0], codes[j : j + 1, 0])[0] + neardup.distance(codes[i : i + 1, 1], codes[j : j + 1, 1])[0]
            if shard[i] == shard[j] and tid[i] < tid[j] and far <= neardup.FAR and any(int(x ^ y).bit_count() <= 1 for x, y in zip(piece[i].tolist(), piece[j].tolist())):
                want.add((tid[i], tid[j]))
    none = np.full(n, -1)
    got, _ = neardup.tree_pairs(shard, np.zeros(n, int), none, tid, codes, size)
    assert set(map(tuple, got.tolist())) == want and len(want) > 190


def group_texts():
    base = [passage() for _ in range(40)]
    rows, truth = [], []
    for i, t in enumerate(base):
        for k in range(RNG.choice([1, 1, 2, 3])):
            rows.append((len(rows), [t, edited(t, 4), moved(t)][k]))
            truth.append(i)
    return rows, truth


@pytest.mark.parametrize("limit", [2000, 3])
def test_groups_match_brute_force(spark, limit):
    rows, truth = group_texts()
    extra = [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "*** ...")]
    df = spark.createDataFrame([(*r, "x") for r in rows + extra], "rec_id long, text string, grp string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp"))
    df = df.union(df.limit(5))
    got = {r["rec_id"]: r["grp"] for r in neardup.group_records(df, limit).collect()}
    assert set(got) == {r[0] for r in rows}
    by = {}
    for r, g in got.items():
        by.setdefault(g, set()).add(r)
    want = {}
    for (r, _), g in zip(rows, truth):
        want.setdefault(g, set()).add(r)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, want.values()))


def test_groups_last_delivery_counts_and_empty(spark):
    a, b = passage(), passage()
    df = spark.createDataFrame([(1, a, "2024-01-01"), (1, b, "2024-01-02"), (2, a, "2024-01-01"), (3, b, None)], "rec_id long, text string, d string").withColumn("loaded_at", F.col("d").cast("timestamp"))
    got = {r["rec_id"]: r["grp"] for r in neardup.group_records(df).collect()}
    assert got[1] == got[3] != got[2]
    assert neardup.group_records(df.where("false")).count() == 0


def store(spark, rows):
    df = spark.createDataFrame(rows, "rec_id long, role byte, positive string, negatives array<string>").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    df = df.select("rec_id", "loaded_at", "role", "positive", "negatives")
    return df.mapInArrow(overlap.encode_records, overlap.STORE).where("n > 0").cache()


def test_overlaps_match_brute_force(spark):
    base = [passage() for _ in range(12)]
    T, E = overlap.TRAIN, overlap.EVAL
    rows = [(i, T, t, []) for i, t in enumerate(base)]
    rows += [(100, E, edited(base[0], 4), None), (101, E, moved(base[1]), []), (102, E, passage(), [base[2], None, "", base[2]]), (103, E, passage(), [edited(base[3], 3)])]
    rows += [(104, T, passage(), [passage(), "stock text of a few words only here"]), (105, E, None, ["stock text of a few words only here"])]
    rows += [(106, T, None, [base[5] + " "]), (107, E, edited(base[5], 2), []), (108, E, "short", []), (109, T, "short", []), (110, T, None, None)]
    ids = words.new_ids()
    enc = lambda t: words.encode(t, ids)
    want = set()
    for ra, sa, pa_, na in rows:
        for rb, sb, pb, nb in rows:
            if sa != E or sb != T:
                continue
            pairs = [(x, y) for x in ([pa_] if pa_ else []) for y in [pb, *(nb or [])] if y] + [(x, pb) for x in na or [] if x and pb]
            if any(enc(x)[enc(x) != 0].tolist() == enc(y)[enc(y) != 0].tolist() or words.near(enc(x), enc(y)) for x, y in pairs):
                want.add((min(ra, rb), max(ra, rb)))
    got = {(r[0], r[1]) for r in overlap.record_pairs(store(spark, rows)).collect()}
    assert got == want and len(want) >= 7


def test_overlaps_of_nothing(spark):
    assert overlap.record_pairs(store(spark, [(1, overlap.TRAIN, "a b c", [])])).count() == 0


def test_posted_segments_meet_at_the_edit_bound():
    """Every pair that is near shares a posting, up to the last allowed edit, and passes the sketches."""
    ids, rng = words.new_ids(), random.Random(11)
    size = lambda a: int((a != 0).sum())
    number = type("Shared", (), {"value": np.zeros(neardup.COUNTERS, np.int32)})

    def post(a):
        batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([1]), pa.array([a.tolist()], pa.list_(pa.int32()))], names=["leg", "tid", "ids"])
        return list(overlap.postings(number, True)(iter([batch])))[0].to_pydict()

    checked = 0
    for length in [*range(1, 60), 90, 160]:
        for _ in range(16):
            w = [rng.choice(VOCABULARY) for _ in range(length)]
            marks = [i for i in range(1, length) if rng.random() < rng.choice([0.05, 0.15, 0.5])]
            v = list(w)
            for i in rng.sample(range(length), -(-length // 8) if length >= 8 else 0):
                v[i] = rng.choice([f"new{i}", f"new{i}", f"new{i} more{i}", ""])
            said = lambda x, dots: " ".join(t + ("." if i + 1 in dots else "") for i, t in enumerate(x) if t)
            b = said(v, set(marks) ^ {rng.randrange(1, length + 1)})
            if rng.random() < 0.5:
                b = moved(said(v, set(marks)))
            a, b = words.encode(said(w, set(marks)), ids), words.encode(b, ids)
            if not words.near(a, b):
                continue
            pa_, pb = post(a), post(b)
            k = -(-max(size(a), size(b)) // 8)
            x, y = ([p[c][0] & (1 << 64) - 1 for c in ("p0", "p1")] for p in (pa_, pb))
            assert x[1] & 0xFFFFFFFF == size(a) and y[1] & 0xFFFFFFFF == size(b)
            bits = (x[0] ^ y[0]).bit_count() + (x[1] >> 32 ^ y[1] >> 32).bit_count()
            assert set(pa_["key"]) & set(pb["key"]) and bits + abs(size(a) - size(b)) <= 2 * k
            checked += 1
    assert checked > 200


@pytest.mark.parametrize("length,k", [(16, 2), (24, 3), (40, 5)])
def test_every_edit_allowed_keeps_a_shared_segment(length, k):
    """One edit every eight words, wherever they start: the pair still meets."""
    ids = words.new_ids()
    number = type("Shared", (), {"value": np.zeros(neardup.COUNTERS, np.int32)})
    a = [f"t{i}" for i in range(length)]
    batch = lambda t: pa.RecordBatch.from_arrays([pa.array([0], pa.int8()), pa.array([1]), pa.array([words.encode(" ".join(t), ids).tolist()], pa.list_(pa.int32()))], names=["leg", "tid", "ids"])
    post = lambda t: set(list(overlap.postings(number, True)(iter([batch(t)])))[0].column(0).to_pylist())
    for shift in range(length):
        b = list(a)
        for e in range(k):
            b[(shift + e * length // k) % length] = f"new{e}"
        assert words.near(words.encode(" ".join(a), ids), words.encode(" ".join(b), ids))
        assert post(a) & post(b)


def test_hot_segments_are_salted_without_losing_a_pair(spark, monkeypatch):
    """Every text shares its beginning; the few rows a salt may hold spread it."""
    stock = sentence(14)
    rows = [(i, overlap.TRAIN if i % 4 else overlap.EVAL, f"{stock} {passage(1)}", [stock]) for i in range(40)]
    rows += [(100, overlap.EVAL, rows[1][2], None), (101, overlap.EVAL, edited(rows[2][2], 2), [stock])]
    plain = {tuple(r) for r in overlap.record_pairs(store(spark, rows)).collect()}
    make, before = overlap.postings, []

    def salted(number, spread):
        class Low:
            value = number.value

        def post(batches):
            overlap.PER_SALT = 0
            Low.value = np.where(number.value > 10, number.value, 1)
            before.append(1)
            return make(Low, spread)(batches)

        return post

    monkeypatch.setattr(overlap, "postings", salted)
    got = {tuple(r) for r in overlap.record_pairs(store(spark, rows)).collect()}
    assert got == plain and {(1, 100), (2, 101)} <= got


def leak_tables(spark):
    q = "Does the " + " ".join(RNG.choice(VOCABULARY) for _ in range(22)) + "?"
    p = " ".join(sentence(15) for _ in range(6))
    w = p.split()
    docs = [
        (1, f"{passage()} {p} {passage()}"), (2, f"{passage()} {' '.join(w[20:52])} {passage()}"), (3, f"x {q.upper()} y"), (4, f"{passage()} {' '.join(w[10:24])} {passage()}"), (5, " ".join(q.split()[:11])),
        (6, " ".join(RNG.sample(w, len(w)))), (7, None), (8, ""), (9, edited(" ".join(w[30:70]), 3) + " tail"), (10, f"{passage()} " * 300 + p.replace(" ", "  \n")),
    ]
    d = spark.createDataFrame(docs + docs[:1], "doc_id long, text string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).withColumn("query", F.lit(1))
    i = spark.createDataFrame([(7, q, p), (7, q, p), (8, None, None), (9, "", "...")], "item_id long, query string, positive string")
    return d, i


def test_leaks(spark):
    d, i = leak_tables(spark)
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()}
    assert got == {(1, 7), (2, 7), (3, 7), (9, 7), (10, 7)}
    assert leaks.leaks(d.where("false"), i).count() == 0 and leaks.leaks(d, i.where("false")).count() == 0


def test_alignment_against_plain_smith_waterman():
    for _ in range(60):
        a = np.array([RNG.randint(1, 3) for _ in range(RNG.randint(1, 9))])
        b = np.array([RNG.randint(1, 3) for _ in range(RNG.randint(1, 9))])
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for x in range(1, len(a) + 1):
            for y in range(1, len(b) + 1):
                h[x, y] = max(0, h[x - 1, y - 1] + (leaks.MATCH if a[x - 1] == b[y - 1] else -leaks.MISS), h[x - 1, y] - leaks.GAP, h[x, y - 1] - leaks.GAP)
        assert leaks.align([a, a[:1]], [b, b[:1]])[0] == h.max()


def test_stretches_against_all_pairs_of_stretches():
    for _ in range(40):
        a = np.array([RNG.randint(1, 3) for _ in range(RNG.randint(1, 8))])
        b = np.array([RNG.randint(1, 3) for _ in range(RNG.randint(1, 8))])
        for e in (0, 1, 2):
            want = max((y - x for x in range(len(a)) for y in range(x + 1, len(a) + 1) for u in range(len(b) + 1) for v in range(u, len(b) + 1) if levenshtein(a[x:y].tolist(), b[u:v].tolist()) <= e), default=0)
            length, end = leaks.stretches([a], [b], e)
            assert length[0] == want and (not want or 0 <= end[0] - length[0] < end[0] <= len(a))


def leaked(spark, docs, items):
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp"))
    i = spark.createDataFrame([(k, *x) for k, x in enumerate(items)], "item_id long, query string, positive string")
    return {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, i).collect()}


def test_short_items_are_found_and_edits_in_the_middle_do_not_hide_them(spark):
    items, docs, want = [], [], set()
    for n in range(1, 15):
        w = [f"u{n}x{j}" for j in range(n)]
        items.append((" ".join(w), None))
        docs.append(f"{passage(1)} {' '.join(w)} {passage(1)}")
        want.add((len(docs) - 1, n - 1))
        for k in range(n if n >= leaks.SHORTEST else 0):  # one edit, at every place
            docs.append(f"{passage(1)} {' '.join(['other' if j == k else x for j, x in enumerate(w)])} {passage(1)}")
            want.add((len(docs) - 1, n - 1))
    assert leaked(spark, docs, items) == want


def test_a_stretch_inside_a_looser_passage_counts(spark):
    p = [f"v{j}" for j in range(85)]
    loose = [x if j < 25 or j % 3 else f"z{j}" for j, x in enumerate(p)]
    spread = [x if j % 25 not in (3, 9, 15) else "" for j, x in enumerate(p)]
    assert leaked(spark, [" ".join(loose), " ".join(loose[30:]), " ".join(spread)], [(None, " ".join(p))]) == {(0, 0), (2, 0)}


def test_every_place_of_three_edits_in_a_stretch(spark):
    p, docs = [f"s{j}" for j in range(60)], []
    for _ in range(120):
        at = RNG.randint(0, 35)
        w = p[at : at + 25]
        for k in RNG.sample(range(25), 3):
            w[k] = RNG.choice(["", f"new{k}", f"{w[k]} more{k}"])
        docs.append(f"{passage(1)} {' '.join(w)} {passage(1)}")
    assert leaked(spark, docs, [(None, " ".join(p))]) == {(k, 0) for k in range(120)}


def test_very_long_items_and_windows(spark):
    p = [f"t{j}" for j in range(70_000)]
    docs = [" ".join(p[69_000:69_025]), " ".join(p[500:530]), " ".join(p[40_000:40_020])]
    assert leaked(spark, docs, [(None, " ".join(p))]) == {(0, 0), (1, 0)}
    q = "again and again " * 40
    assert leaked(spark, [q * 50, "again and"], [(q, None)]) == {(0, 0)}


def test_stored_once_per_side():
    flat, offsets = words.encode_batch(["a b", "a b", "c"], words.new_ids())
    keys, _ = words.text_keys(flat, offsets)
    col = texts.once(flat, offsets, keys, set())
    assert col.is_null().to_pylist() == [False, True, False]
