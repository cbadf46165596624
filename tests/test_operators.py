import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking as C
from lexmill.operators import metrics as M
from lexmill.operators import mining as N
from lexmill.operators import ranking as R


def ranking(spark, rels):
    r = spark.createDataFrame([("q", f"d{i}", i + 1) for i in range(len(rels))], "query_id string, doc_id string, rk int")
    j = spark.createDataFrame([("q", f"d{i}", g) for i, g in enumerate(rels)], "query_id string, doc_id string, grade int")
    return r, j


def test_ndcg_and_ap(spark):
    row = M.per_query(*ranking(spark, [1, 0, 2]), 1, 2).first()
    assert row["ndcg10"] == pytest.approx(2.0 / (2 + 1 / math.log2(3)))
    assert row["ap"] == pytest.approx((1 + 2 / 3) / 2)
    assert row["recall1"] == 0.5 and row["strong_precision5"] == pytest.approx(0.2)


def test_judged_outside_the_ranking_counts_in_ap_only(spark):
    r, j = ranking(spark, [1, 0, 1])
    j = j.union(spark.createDataFrame([("q", "other", 1)], j.schema))
    row = M.per_query(r, j, 1, 4).first()
    assert row["ap"] == pytest.approx((1 + 2 / 3) / 3) and row["strong_precision5"] is None


def test_perfect_ranking_scores_one(spark):
    row = M.per_query(*ranking(spark, [4, 3, 1, 0]), 3, 4).first()
    assert row["ndcg5"] == 1.0 and row["ap"] == 1.0


def test_bm25_empty_tables(spark):
    q = spark.createDataFrame([], "query_id string, text string")
    d = spark.createDataFrame([], "doc_id long, text string")
    assert R.bm25(q, d).count() == 0


def test_bm25_prefers_rare_words(spark):
    q = spark.createDataFrame([("q", "crane lien")], "query_id string, text string")
    d = spark.createDataFrame([(1, "crane the"), (2, "lien the"), (3, "lien of"), (4, "x y"), (5, None)], "doc_id long, text string")
    got = [r["doc_id"] for r in R.ranked(R.bm25(q, d.where("text is not null")), "query_id", "doc_id").orderBy("rk").collect()]
    assert got == [1, 2, 3]


def test_group_split_is_disjoint(spark):
    rows = spark.createDataFrame([(f"c{i % 30}", i) for i in range(300)], "k string, i int")
    parts = N.group_split(rows, "k")
    assert parts.count() == 30 and parts.where("part = 'dev'").count() == 3
    assert parts.groupBy("k").count().where("count > 1").count() == 0


def test_balance(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)], "g string, i int")
    assert N.balanced(rows, "g", "i", 3, 8).count() == 3
    assert N.balanced(rows, "g", "i", 0, 8).count() == 8


def test_contains_join_both_ways(spark):
    d = spark.createDataFrame([(1, "one two three four five six seven eight nine"), (2, "three four five six seven"), (3, "zz"), (4, "")], "doc_id long, text string")
    p = spark.createDataFrame([(7, "two three FOUR five  six seven eight"), (8, "zz"), (9, None)], "item_id long, text string")
    assert {(r[0], r[1]) for r in N.contains_join(d, p).collect()} == {(1, 7), (2, 7), (3, 8)}


def test_repeated(spark):
    rows = spark.range(2)
    assert N.repeated(rows, 0).count() == 0 and N.repeated(rows, 3).count() == 6
    with pytest.raises(ValueError):
        N.repeated(rows, -1)


def test_triplets_drop_bad_negatives(spark):
    rows = spark.createDataFrame([("q", "p", ["p", "", None, "n"]), ("q", "p", None)], "query string, positive string, negatives array<string>")
    assert [r["negative"] for r in N.triplets(rows).collect()] == ["n"]


def packs(sizes, limit, fresh, overlap):
    """Bounds of runs, plainly."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (total + n > limit or fresh[i]):
            out.append((lo, i))
            k, total = i, 0
            while k > lo and i - k < overlap and total + sizes[k - 1] <= limit // 4:
                k -= 1
                total += sizes[k]
            lo = k
        total += n
    return [*out, (lo, len(sizes))] if sizes else []


def test_runs_match_a_plain_loop(spark):
    rng = random.Random(6)
    rows = [([rng.randint(0, 40) for _ in range(rng.randint(0, 25))], rng.randint(0, 2)) for _ in range(150)]
    rows = [(s, [rng.random() < 0.1 for _ in s]) for s, _ in rows]
    df = spark.createDataFrame(rows, "s array<int>, f array<boolean>")
    got = df.select("s", "f", *[C.runs(F.col("s"), 60, F.col("f"), k).alias(f"r{k}") for k in (0, 1, 3)]).collect()
    for r in got:
        for k in (0, 1, 3):
            assert [tuple(x) for x in r[f"r{k}"]] == packs(r["s"], 60, r["f"], k)


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_semantic_chunks_keep_all_words_within_the_limit(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("fee rent lease notice term crane lien tax audit".split())
    docs = [". ".join(" ".join(word() for _ in range(rng.choice([3, 9, 90]))) for _ in range(30)) + "." for _ in range(4)]
    got = C.semantic_chunks(texts(spark, *docs, "One two three four five. Six.", "", None), 60, least_words=0).collect()
    for k, d in enumerate(docs):
        own = [r["text"] for r in sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["chunk"])]
        assert set(" ".join(own).split()) == set(d.split()) and all(int(len(t.split()) * 1.4) <= 60 + 60 // 4 + 1 for t in own)  # carried clauses come on top
    assert [(r["chunk_type"], r["text"]) for r in got if r["doc_id"] == 4] == [("clause", "One two three four five. Six.")]
    assert {r["doc_id"] for r in got} == {0, 1, 2, 3, 4}


def test_semantic_chunks_with_an_encoder(spark):
    """Vectors that turn at the seventh sentence: the break is there."""
    import numpy as np

    def encode(sentences):
        return np.array([[1.0, 0.0] if "rent" in s else [0.0, 1.0] for s in sentences])

    doc = " ".join(f"The rent {i} is paid late here." for i in range(6)) + " " + " ".join(f"A crane {i} is kept well there." for i in range(6))
    got = C.semantic_chunks(texts(spark, doc), 60, C.encoded(encode)).orderBy("chunk").collect()
    assert ["rent" in r["text"] and "crane" in r["text"] for r in got].count(True) <= 1 and len(got) >= 2


def test_sections(spark):
    body = " ".join(["word"] * 30)
    got = C.sections(texts(spark, f"intro\n1. Termination\n{body}\n2. Notices\n{body}", "no headings here", f"1. Long\n{'abc ' * 900}")).orderBy("doc_id", "start").collect()
    assert [r["title"] for r in got] == ["Termination", "Notices", "Long"]
    assert got[0]["start"] == 6 and len(got[2]["text"]) <= 2500 and got[2]["text"].endswith("abc")


def test_front_and_body(spark):
    rows = texts(spark, "Contents ARTICLE\nthe parties agree as follows:\nARTICLE 1\nScope\nText", "plain", "ARTICLE 1\nScope\n1.1 Fees .......... 3\nARTICLE 1\nScope\nText", "x WITNESSETH that", "ARTICLE 2\nA\n" + "." * 9)
    got = {r["doc_id"]: (r["front"], r["body"]) for r in C.strip_contents(rows).collect()}
    assert got[0][1].startswith("ARTICLE 1\nScope") and got[1] == ("", "plain") and got[3] == ("x WITNESSETH", "that")
    assert got[2] == ("ARTICLE 1\nScope\n1.1 Fees .......... 3", "ARTICLE 1\nScope\nText") and got[4][0] == ""


def test_definitions(spark):
    got = C.definitions(texts(spark, '“Fee” means money.\nMore.\n"Term": a time.\nend', "none")).orderBy("at").collect()
    assert [(r["term"], r["text"]) for r in got] == [("Fee", "“Fee” means money.\nMore."), ("Term", '"Term": a time.\nend')]


def test_maxsim(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "query_id int, pos int, vec array<double>")
    d = spark.createDataFrame([(1, [0.9, 0.1]), (1, [0.2, 0.9])], "doc_id int, vec array<double>")
    assert R.maxsim(q, d).first()["score"] == pytest.approx(1.8)


def test_first_match_order(spark):
    rows = spark.createDataFrame([("Termination for Cause",), ("other",)], "label string")
    got = N.first_match(rows, "label", [("t", "for cause", "cause"), ("t", "any", "terminat")]).collect()
    assert [(r["family"], r["subtype"]) for r in got] == [("t", "for cause")]


def test_hard_negatives_fill(spark):
    q = spark.createDataFrame([("q", "crane")], "query_id string, text string")
    d = spark.createDataFrame([(i, "crane" if i < 2 else f"w{i}") for i in range(6)], "doc_id long, text string")
    pos = spark.createDataFrame([("q", 0)], "query_id string, doc_id long")
    got = N.hard_negatives(R.bm25(q, d), q, d, pos, 3).collect()
    assert len(got) == 3 and all(r["filled"] for r in got) and 0 not in {r["doc_id"] for r in got}
