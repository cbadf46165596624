import pytest
from pyspark.sql import functions as F

from lexmill.functions import segments as S
from lexmill.functions import words as W


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_tokens_keep_accents(spark):
    assert one(spark, W.tokenize(F.col("t")), t="Über die große café_1 x") == ["über", "die", "große", "café_1", "x"]


def test_topical_drops_stop_and_short_words(spark):
    assert one(spark, W.topical(F.col("t")), t="The fee of an ox shall be paid, fee") == ["fee", "paid", "fee"]


def test_overlap_without_keywords_is_zero(spark):
    assert one(spark, W.overlap(W.keyword_set(F.col("q")), F.col("t")), q="the of", t="anything") == 0.0
    assert one(spark, W.overlap(W.keyword_set(F.col("q")), F.col("t")), q="late fees", t="fees due") == 0.5


def test_word_counts(spark):
    assert one(spark, W.word_count(F.col("t")), t="  a  b\nc ") == 3
    assert one(spark, W.word_count(F.col("t")), t="  ") == 0
    assert one(spark, W.estimated_tokens(F.lit(7))) == 9


def test_stable_id(spark):
    assert one(spark, W.stable_id("prefix", F.col("t")), t="abc") == "prefix-a9993e364706816a"


def test_label_names(spark):
    assert one(spark, W.label_name(F.col("t")), t=" Choice-of_Law ") == "governing law"
    assert one(spark, W.label_name(F.col("t")), t="Audit_Rights") == "audit rights"


def test_sentences_protect_abbreviations(spark):
    got = one(spark, S.sentences(F.col("t")), t="Acme Inc. pays. See Section 1.01. of it; then No. 5 ends! Done")
    assert got == ["Acme Inc. pays.", "See Section 1.01. of it;", "then No. 5 ends!", "Done"]


def test_word_windows(spark):
    text = " ".join(f"w{i}" for i in range(100))
    got = one(spark, S.word_windows(F.col("t"), 50), t=text)
    assert [p.split()[0] for p in got] == ["w0", "w17", "w34", "w51", "w68"]


def test_aligned_window(spark):
    t = "alpha beta gamma delta"
    assert one(spark, S.aligned_window(F.col("t"), F.lit(11), F.lit(5), 2), t=t) == "beta gamma d"
    assert one(spark, S.aligned_window(F.col("t"), F.lit(6), F.lit(4), 2), t=t) == "a beta gamma"  # no blank before
    assert one(spark, S.aligned_window(F.col("t"), F.lit(3), F.lit(2), 1), t="abcdefgh") == "cdef"


def test_html(spark):
    page = "<html><style>p{}</style><p>A &amp; B</p><!-- x --><div>C<br>D</div></html>"
    assert one(spark, S.html_to_text(F.col("t")), t=page).split() == ["A", "&", "B", "C", "D"]


def test_breakpoints_gap(spark):
    sims = [0.9, 0.9, 0.1, 0.1, 0.9]
    assert one(spark, S.breakpoints(F.col("s"), F.lit(0.5)), s=sims) == [4]


def test_questions(spark):
    assert one(spark, S.questions(F.col("t")), t="1. How much is due?\n2. short?\n3. Who must pay the fee?") == ["How much is due?", "Who must pay the fee?"]


def test_first_json(spark):
    assert one(spark, S.first_json(F.col("t")), t='Sure: {"k": [1, 2]} ok') == '{"k": [1, 2]}'
    assert one(spark, S.first_json(F.col("t")), t="nothing") is None


def test_glob(spark):
    assert one(spark, W.glob_match(F.col("t"), ["a*", "b?d"]), t="bad") is True
    assert one(spark, W.glob_match(F.col("t"), ["a.b"]), t="axb") is False


@pytest.mark.parametrize("parts,want", [(["a" * 6, "b" * 6], ["a" * 6, "b" * 6]), (["a", "b"], ["a\n\nb"]), ([], [])])
def test_pack(spark, parts, want):
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(S.pack(F.col("p"), 10).alias("x")).first()["x"] == want
