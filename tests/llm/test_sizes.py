import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import bins, lattice, mixing, pieces, sampling, sentences
from lexmill.llm import tokens as T
from lexmill.llm.flow import Network, apportion


@pytest.fixture(scope="module")
def enc():
    try:
        return T.encoding(T.DEFAULT)
    except OSError:
        pytest.skip("no vocabulary file here")


RNG = random.Random(3)
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima".split()


def prose(n):
    return " ".join((" ".join(RNG.choice(WORDS) for _ in range(9)) + ".").capitalize() + ("\n\n" if RNG.random() < 0.1 else "") for _ in range(n))


@pytest.mark.parametrize(
    "text",
    [prose(400), "x" * 9000, "東京は大きい。" * 900, "\U00020bb7" * 1500, "word " * 4000, "\r\n".join(["a, b; c"] * 2000), "\ud800" * 3000, "a" + " " * 6000 + "b"],
)
def test_pieces_cover_and_fit(enc, text):
    got = pieces.cut_text(enc, text, 256, 32)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, n, _), (c, d, _, s) in zip(got, got[1:]):
        assert c <= b and d > b and (s >= 32 or c == b)
    for a, b, n, _ in got:
        assert len(T.encode(enc, text[a:b])) == n or n <= 256
        assert len(T.encode(enc, text[a:b])) <= 256


def test_pieces_end_at_sentences(enc):
    text = prose(300)
    got = pieces.cut_text(enc, text, 256, 32)
    assert all(text[b - 1] in ".\n" for _, b, _, _ in got[:-1])


def test_small_and_empty_texts(enc):
    assert pieces.cut_text(enc, "") == [] and len(pieces.cut_text(enc, "one two")) == 1


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, piece string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp"))


def test_cut_documents_edge_rows(spark, enc):
    long = prose(400)
    d = docs(spark, [(1, long, ""), (1, long, ""), (2, "short", ""), (3, None, ""), (4, "", ""), (None, long, "")])
    got = pieces.cut_documents(d, 256, 32)
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {1}
    assert got.count() == len(pieces.cut_text(enc, long, 256, 32))
    assert pieces.cut_documents(d, 256, 0, whole=True, with_text=False).select("doc_id").distinct().count() == 2
    assert pieces.cut_documents(d.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_containers_hold_everything_once(sizes):
    first = bins.place(sizes, 100)
    after = bins.improve([list(b) for b in first], sizes, 100)
    for got in (first, after):
        assert sorted(i for b in got for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in got)
    assert len(after) <= len(first)


def test_swaps_empty_a_container():
    sizes = [60, 50, 50, 40]
    assert len(bins.improve([[0], [1], [2, 3]], sizes, 100)) == 2


def test_fill_containers_over_shards(spark):
    rows = [(i, 0, 0, 1, 1 + i % 97, "x") for i in range(3000)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, char_start int, char_end int, tokens int, fill string")
    out = bins.fill_containers(items, 200, per_shard=500).cache()
    assert out.count() == 3000
    by = out.groupBy("container").agg(F.sum("tokens").alias("t"), F.max("fill").alias("f"), F.count("*").alias("n"), F.max("position").alias("p"))
    assert by.where("t > 200 or t <> f or p <> n - 1").count() == 0
    assert by.count() <= 1.03 * sum(r[4] for r in rows) / 200
    assert bins.fill_containers(items.where("false"), 200).count() == 0


@pytest.mark.parametrize(
    "one,two",
    [
        ("हर {} को किराया दो।", "वह {} भी गोपन बात छिपा।"),
        ("第{}期租金由乙方支付。", "保密资料{}不得泄露给他人。"),
        ("第{}回の賃料を払う。", "秘密情報{}は開示しない。"),
        ("ผู้เช่าจ่ายค่าเช่างวดที่{}\n", "ห้ามเปิดเผยข้อมูลลับ{}\n"),
    ],
)
def test_valleys_in_scripts_without_plain_words(one, two):
    """No clause repeats as a whole; the topics part after the sixth sentence."""
    name = "कमलरथनदगहसप" if "ह" in one else "甲乙丙丁戊己庚辛壬癸" if "ผ" not in one else "กขคงจฉชซฌญ"
    parts = [one.format(c) for c in name[:6]] + [two.format(c) for c in name[4:10]]
    gaps, at = [], 0
    for p in parts[:-1]:
        at += len(p)
        gaps.append(at)
    depth = pieces.valleys("".join(parts), gaps)
    assert depth.argmax() == 5 and depth[5] > 0.2


def test_flow_is_cheapest():
    net = Network()
    net.arc("S", "a", 5)
    net.arc("a", "T", 3, 1.0, key="near")
    net.arc("a", "T", 5, 2.0, key="far")
    assert net.solve("S", "T", 10) == 5 and net.flow("near") == 3 and net.flow("far") == 2


def test_apportion():
    assert apportion({"a": 0.5, "b": 0.25, "c": 0.25}, 7) == {"a": 4, "b": 2, "c": 1} or sum(apportion({"a": 0.5, "b": 0.25, "c": 0.25}, 7).values()) == 7


def test_plan_floors_shares_and_shortfalls():
    cells = {("a", "train"): 80, ("a", "test"): 20, ("b", "train"): 10, ("c", "train"): 3}
    targets = {"a": (0.5, 1), "b": (0.2, 12), "c": (0.01, 2), "d": (0.0, 4)}
    quota, short = sampling.plan(cells, targets, 50)
    assert short == {"a": 0, "b": 2, "c": 0, "d": 4}
    assert sum(quota.values()) == 50 and quota[("b", "train")] == 10 and sum(n for (c, _), n in quota.items() if c == "c") >= 2
    assert all(n <= cells[k] for k, n in quota.items())
    assert sampling.plan({}, targets, 0)[0] == {}


def test_categories(spark):
    ev = spark.createDataFrame(
        [(1, "TERMINATION", "q"), (2, "audit-rights (3)", "q"), (3, "asignment", "q"), (4, None, "q"), (5, "n/a", "q"), (6, "-", None), (7, "notices.", "q"), (7, "notices.", "q"), (None, "notices", "q")],
        "evidence_id long, clause_type string, query_id string",
    ).select("*", F.lit("2024-01-01").alias("loaded_at"), F.lit(None).cast("string").alias("split"), F.lit(1).alias("category"))
    q = spark.createDataFrame([("q", "survival"), ("q", "survival")], "query_id string, category string")
    t = spark.createDataFrame([(c,) for c in ("termination", "audit_rights", "assignment", "notices", "survival")], "clause_type string")
    got = {r["evidence_id"]: r["category"] for r in sampling.categories(ev, q, t).collect()}
    assert got == {1: "termination", 2: "audit_rights", 3: "assignment", 4: "survival", 5: "survival", 6: None, 7: "notices"}


def test_route_repeats_and_slack():
    sources = [("a", 0.5, 1), ("b", 0.5, 3)]
    flows, missing = mixing.route({1: 100, 2: 20}, sources, 120)
    assert flows[(1, 0)] == 60 and flows[(2, 1)] == 60 and missing == {"a": 0, "b": 0}
    flows, missing = mixing.route({1: 10, 2: 20}, sources, 120)
    assert missing["a"] == 50 and flows[(1, 0)] == 10
    shared, _ = mixing.route({3: 100}, sources, 100)
    assert shared == {(3, 0): 50, (3, 1): 50}


def test_short_sources_are_those_with_slack():
    for _ in range(300):
        sources = [(f"s{k}", RNG.choice([0.0, 0.1, 0.25, RNG.random()]), RNG.randint(0, 4)) for k in range(5)]
        own = {name: RNG.choice([0, RNG.randint(0, 60)]) for name, _, _ in sources}
        total = sum(own.values()) + RNG.randint(0, 20)
        assert mixing.lacking(own, sources, total) == {n for n, share, r in sources if own[n] * r < share * total}


def test_mix_never_repeats_too_often(spark, small):
    most = {r["source"]: r["max_repeat"] for r in spark.read.parquet(f"{small}/mix_targets.parquet").collect()}
    rows = mixing.p8_mix(spark, small).collect()
    assert rows and all(r["repeats"] <= most[r["source"]] for r in rows)


def test_report_is_what_was_drawn(spark, small):
    drawn = {}
    for r in mixing.p8_mix(spark, small).collect():
        drawn[r["source"]] = drawn.get(r["source"], 0) + r["repeats"] * r["tokens"]
    told = {r["source"]: r for r in mixing.p8_shares(spark, small).collect()}
    assert {s: r["tokens"] for s, r in told.items() if r["tokens"]} == drawn
    assert abs(sum(r["share"] for r in told.values()) - 1) < 1e-9
    largest = max(r["tokens"] for r in mixing.p8_mix(spark, small).collect())
    for s, r in told.items():  # the quota, to half a document at either end of a stretch
        assert abs(r["tokens"] - (r["quota"] - r["missing"])) <= 2 * largest


def test_sample_and_report_agree(spark, small):
    drawn = {}
    for r in sampling.p5_sample(spark, small).collect():
        drawn[r["category"]] = drawn.get(r["category"], 0) + 1
    told = {r["clause_type"]: r for r in sampling.p5_report(spark, small).collect()}
    assert {c: r["drawn"] for c, r in told.items() if r["drawn"]} == drawn
    floors = {c: min(r["min_rows"], r["there"]) for c, r in told.items()}
    fit = sum(floors.values()) <= sum(drawn.values())  # else the floors alone exceed the sample
    for c, r in told.items():
        assert (r["drawn"] >= floors[c] or not fit) and r["drawn"] <= r["there"]
    assert {c for c, r in told.items() if r["shortfall"]} == {r[0] for r in sampling.p5_found(spark, small).collect()}


@pytest.mark.parametrize("n,lo,hi,capacity,most", [(1000, 300, 900, 2048, 1.01), (1000, 340, 1200, 2048, 1.01), (600, 1, 97, 200, 1.01)])
def test_swaps_win_on_awkward_sizes(n, lo, hi, capacity, most):
    """From one item a container, and from the first placement; until nothing is left to do."""
    rng = random.Random(1)
    sizes = [rng.randint(lo, hi) for _ in range(n)]
    bound = -(-sum(sizes) // capacity)
    first = bins.place(sizes, capacity)
    for start in (first, [[i] for i in range(n)]):
        after = bins.improve([list(b) for b in start], sizes, capacity)
        assert sorted(i for b in after for i in b) == list(range(n)) and all(sum(sizes[i] for i in b) <= capacity for b in after)
        assert len(after) <= len(first) and len(after) <= most * bound


def test_no_exchange_is_left():
    rng = random.Random(4)
    sizes = [rng.randint(20, 90) for _ in range(60)]
    after = bins.improve([[i] for i in range(60)], sizes, 100)
    if len(after) > -(-sum(sizes) // 100):
        fill = [sum(sizes[i] for i in b) for b in after]
        for x, a in enumerate(after):
            gifts = [[i] for i in a] + [[i, j] for i in a for j in a if i < j]
            for y, b in enumerate(after):
                for out in gifts if x != y else ():
                    for back in [[]] * (len(out) == 1) + [[j] for j in b]:
                        d = sum(sizes[i] for i in out) - sum(sizes[j] for j in back)
                        assert not (0 < d <= 100 - fill[y] and fill[y] + d > fill[x])


@pytest.mark.parametrize("one,two", [("第{}期の賃料を借主が銀行へ払う。", "秘密情報{}を第三者に漏らさない。"), ("第{}期租金由乙方支付给银行。", "保密资料{}不得泄露给第三人。"), ("ผู้เช่าจ่ายค่าเช่างวดที่{} ", "ห้ามเปิดเผยข้อมูลลับ{} "), ("The tenant pays rent {} to the bank. ", "No secret {} is told outsiders. ")])
def test_a_topic_change_at_sentence_forty_is_the_deepest_valley(one, two):
    parts = [one.format(i) for i in range(40)] + [two.format(i) for i in range(40)]
    gaps, at = [], 0
    for p in parts[:-1]:
        at += len(p)
        gaps.append(at)
    depth = pieces.valleys("".join(parts), gaps)
    assert depth.argmax() == 39 and depth[39] > 0.5


def test_overlap_gives_way_before_the_limit(enc):
    for text in ("\U00020bb7" * 400, "龘" * 600, "x\U0001f468\u200d\U0001f469" * 200):
        got = pieces.cut_text(enc, text, 40, 16)
        assert got[0][0] == 0 and got[-1][1] == len(text)
        for (a, b, n, _), (c, d, m, s) in zip(got, got[1:]):
            assert c <= b < d and len(T.encode(enc, text[c:d])) == m <= 40


def test_words_of_a_lattice_and_a_dictionary_of_ones_own(tmp_path):
    own = tmp_path / "words.txt"
    own.write_text("契約書\n契約\n書類\nnot spaceless\n\nສະບາຍດີ\n", encoding="utf-8")
    known = lattice.dictionary(None, str(own))
    cut = lambda t: [t[a:b] for a, b, _ in lattice.words(t, known)]
    assert cut("契約書類") == ["契約", "書類"] and cut("契約書") == ["契約書"] and cut("ສະບາຍດີສະບາຍດີ") == ["ສະບາຍດີ"] * 2
    assert cut("龘契約") == ["龘", "契約"] and lattice.words("", known) == []


CASES = [
    ("买方称：“我方支付。”的确如此。他走。", ["买方称：“我方支付。”", "的确如此。", "他走。"]),
    ("Առաջին է։ Երկրորդ է։", ["Առաջին է։", "Երկրորդ է։"]),
    ("መጀመሪያ ነው። ሁለተኛ ነው።", ["መጀመሪያ ነው።", "ሁለተኛ ነው።"]),
    ("នេះជាការងារ។ នោះជាផ្ទះ។", ["នេះជាការងារ។", "នោះជាផ្ទះ។"]),
    ("ဒါကစာအုပ်။ အဲဒါအိမ်။", ["ဒါကစာအုပ်။", "အဲဒါအိမ်။"]),
    ("یہ پہلا ہے۔ وہ دوسرا ہے۔", ["یہ پہلا ہے۔", "وہ دوسرا ہے۔"]),
    ("Mr. Smith pays $3.50 to Acme Inc. The rest is due. See No. 5 of it.", ["Mr. Smith pays $3.50 to Acme Inc.", "The rest is due.", "See No. 5 of it."]),
    ("He said “Stop. Go.” and left. “We stay.” They did.", ["He said “Stop. Go.” and left.", "“We stay.”", "They did."]),
    ("Fees\n\nOne line\nbreaks here. Two.", ["Fees", "One line\nbreaks here.", "Two."]),
    ("(a) audit; (b) keep. 14.2 The end (see p. 3) is near.", ["(a) audit; (b) keep.", "14.2 The end (see p. 3) is near."]),
    ("Der Zins gilt ab 12. Januar 2020, z. B. nach § 16 Abs. 2. Wer darf prüfen?", ["Der Zins gilt ab 12. Januar 2020, z. B. nach § 16 Abs. 2.", "Wer darf prüfen?"]),
    ("M. Roy écrit : « Nous payons. » La suite vient.", ["M. Roy écrit : « Nous payons. »", "La suite vient."]),
    ("売主は「返還する。」と通知した。誰が払うか？金額（税別。別紙）である。", ["売主は「返還する。」と通知した。", "誰が払うか？", "金額（税別。別紙）である。"]),
    ("买方称：“我方支付。”封面应注明“已核对。”字样。", ["买方称：“我方支付。”", "封面应注明“已核对。”字样。"]),
    ("ผู้ซื้อต้องส่งคืนสินค้าภายใน 100 วัน จำนวนเงิน 5 บาท ถึงกำหนดชำระทันที", ["ผู้ซื้อต้องส่งคืนสินค้าภายใน 100 วัน", "จำนวนเงิน 5 บาท ถึงกำหนดชำระทันที"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentences.sentences(text)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?\n\"'()“”。「」กอ«»;:-", max_size=60))
def test_sentences_cover_all_but_blanks(text):
    got = sentences.sentences(text)
    kept = "".join(text[a:b] for a, b in got)
    assert "".join(kept.split()) == "".join(text.split())
    assert all(a < b and text[a:b] == text[a:b].strip() for a, b in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_split_sentences_edge_rows(spark):
    d = spark.createDataFrame([(1, "Pay now. Go on."), (1, "Pay now. Go on."), (2, None), (3, "  "), (None, "x"), (4, "😀 Yes. No " + "w" * 50000)], "chunk_id long, text string").withColumn("char_start", F.lit(0))
    got = sorted((r[0], r[1], r[2]) for r in sentences.split_sentences(d).collect())
    assert [g for g in got if g[0] == 1] == [(1, 0, 8), (1, 9, 15)] and {g[0] for g in got} == {1, 4}
    assert sentences.split_sentences(d.where("false")).count() == 0
