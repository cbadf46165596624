"""Queries that run over every row, where their SQL stops at a part."""

import re

import duckdb
from pyspark.sql import functions as F

from lexmill import catalog


def documents(spark, path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, heading string")
    df.withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp")).write.parquet(f"{path}/documents.parquet")


def test_relevance_of_every_document(spark, small):
    con = duckdb.connect()
    docs = f"(select distinct doc_id from '{small}/documents.parquet' where doc_id is not null and text is not null)"
    marks = f"(select query_id, doc_id, max(grade) as grade from '{small}/qrels.parquet' where grade is not null group by 1, 2)"
    want = con.execute(
        f"select q.query_id, d.doc_id, coalesce(j.grade, 0) from '{small}/queries.parquet' q cross join {docs} d "
        f"left join {marks} j on j.query_id = q.query_id and j.doc_id = cast(d.doc_id as varchar)"
    ).fetchall()
    got = [tuple(r) for r in catalog.QUERIES["relevance_default"](spark, small).select("query_id", "doc_id", "rel").collect()]
    assert sorted(got) == sorted(want) and any(d % 10 and g for _, d, g in got)


def test_html_of_every_language(spark, tmp_path):
    rows = [(1, "Fee & <b> due", "EN", "A"), (2, "契約は　終了。", "ja", None), (3, "अनुबंध  यहाँ", "hi", "h"), (4, "no label", None, "x"), (5, "a\tb", "en", "y"), (6, None, "en", "z")]
    documents(spark, tmp_path, rows)
    got = {r["doc_id"]: r["plain"] for r in catalog.QUERIES["html_text"](spark, str(tmp_path)).collect()}
    text = {1: "A\nFee & <b> due\nend", 2: "x\n契約は　終了。\nend", 3: "h\nअनुबंध यहाँ\nend", 4: "x\nno label\nend", 5: "y\na b\nend"}
    assert {k: re.sub("\n+", "\n", v) for k, v in got.items()} == text


def test_html_keeps_every_document(spark, small):
    n = duckdb.connect().execute(f"select count(distinct doc_id) from '{small}/documents.parquet' where text is not null").fetchall()[0][0]
    assert catalog.QUERIES["html_text"](spark, small).count() == n


def test_noise_lines_of_crlf_texts(spark, tmp_path):
    """Line by line in Python, on texts with both line ends."""
    lf = ["Fee.\n12\nTerm 12\n13 \nEnd", "1\nA\n\n\n\nB\n2", "(NY) 0712/x/a.doc\nLeft\n(NY) note\n", "Pay 5\n\n\n\n7 days", "7\n8\n9"]
    rows = [(2 * i + k, t.replace("\n", "\r\n") if k else t, "en", None) for i, t in enumerate(lf) for k in (0, 1)]
    documents(spark, tmp_path, rows)
    got = {r["doc_id"]: r["cleaned"] for r in catalog.QUERIES["noise_lines"](spark, str(tmp_path)).collect()}
    page = re.compile(r"\d+\s*|\(NY\)\s+\d+/.*\.doc\s*")
    kept = lambda t: [x.strip() for x in t.splitlines() if x.strip() and not page.fullmatch(x)]
    assert sorted(got) == [r[0] for r in rows]
    for i, t in enumerate(lf):
        assert got[2 * i] == got[2 * i + 1] and "\n\n\n" not in got[2 * i]
        assert [x.strip() for x in got[2 * i].splitlines() if x.strip()] == kept(t)
