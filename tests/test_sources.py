import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.sources import archives, files, pages
from lexmill.streaming.dedup import append_log, read_log


def test_json_maps_and_splits(spark, tmp_path):
    (tmp_path / "a_queries.json").write_text(json.dumps({"q1": "x", "q2": "y"}))
    (tmp_path / "a_corpus.json").write_text(json.dumps({"d1": "t"}))
    (tmp_path / "a_qrels.json").write_text(json.dumps({"q1": {"d1": 3}}))
    (tmp_path / "b_queries.json").write_text("{}")
    assert [r["split"] for r in files.splits(spark, str(tmp_path)).collect()] == ["a"]
    g = files.gate(spark, str(tmp_path), "a")
    assert g["queries"].count() == 2 and g["categories"].count() == 0
    assert g["qrels"].first().asDict() == {"query_id": "q1", "doc_id": "d1", "grade": 3}


def test_benchmark_folder(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": "T", "text": "x"}\n\n{"_id": "2", "title": "", "text": "y"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q", "text": "ask"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq\t1\t4\n")
    b = files.benchmark_folder(spark, str(tmp_path), "test")
    assert {r["text"] for r in b["corpus"].collect()} == {"T\nx", "y"} and b["qrels"].first()["grade"] == 4
    assert files.benchmark_folder(spark, str(tmp_path), "train")["qrels"].count() == 0


def test_labelled_clauses(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps([{"clause": "w " * 12, "type": "Choice of Law"}, {"text": "short", "category": "x"}]))
    assert [r["label"] for r in files.labelled_clauses(spark, str(p)).collect()] == ["governing law"]


def test_generated_pairs_skip_missing(spark, tmp_path):
    p = tmp_path / "g.json"
    p.write_text(json.dumps([{"question": "who pays the fee?", "passage": "p"}, {"query": "short", "positive": "p"}]))
    assert files.generated_pairs(spark, [str(p), str(tmp_path / "none.json")]).count() == 1


def numbered(k, n=2000):
    return "\n".join([json.dumps({"label": ["a", "b"], "n": k * n + i}) for i in range(n)] + ["not json"])


def zipped(path, entries, how=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", how) as z:
        for name, text in entries:
            z.writestr(name, text)
    return path


def test_zip_scan_survives_truncation(spark, tmp_path):
    p = zipped(tmp_path / "a.zip", [("x.jsonl", numbered(0))])
    df = archives.zipped_json_lines(spark, str(p), "label string, n int")
    assert df.count() == 2000 and df.first()["label"] == '["a", "b"]'
    cut = tmp_path / "cut.zip"
    cut.write_bytes(p.read_bytes()[:2000])
    assert 0 < archives.zipped_json_lines(spark, str(cut), "label string, n int").count() < 2000


def test_zip_scan_of_every_entry_and_of_archives_inside(spark, tmp_path):
    inner = zipped(tmp_path / "inner.zip", [("x.jsonl", numbered(0)), ("y.jsonl", numbered(1))])
    outer = tmp_path / "outer.zip"
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_STORED) as z:
        z.writestr("folder/", "")
        z.writestr("folder/inner.zip", inner.read_bytes())
        z.writestr("plain.jsonl", '{"n": 4000}\n{"n": 4001}')
        with z.open("streamed.jsonl", "w") as f:
            f.write(b'{"n": 4002}')
    rows = lambda path: sorted(r["n"] for r in archives.zipped_json_lines(spark, str(path), "n int").collect())
    assert rows(outer) == list(range(4003)) and rows(inner) == list(range(4000))
    cut = tmp_path / "outer-cut.zip"
    cut.write_bytes(outer.read_bytes()[: inner.stat().st_size - 3000])
    assert 2000 < len(rows(cut)) < 4000
    unseekable = io.BytesIO()
    with zipfile.ZipFile(Unseekable(unseekable), "w", zipfile.ZIP_DEFLATED) as z:  # sizes stand behind the entries
        z.writestr("a", '{"n": 1}')
        z.writestr("b", '{"n": 2}')
    (tmp_path / "later.zip").write_bytes(unseekable.getvalue())
    assert rows(tmp_path / "later.zip") == [1, 2]
    zipped(tmp_path / "empty.zip", [])
    assert rows(tmp_path / "empty.zip") == []
    with pytest.raises(FileNotFoundError):
        rows(tmp_path / "none*.zip")


class Unseekable(io.RawIOBase):
    def __init__(self, to):
        self.to = to

    def writable(self):
        return True

    def seekable(self):
        return False

    def write(self, data):
        return self.to.write(data)


def test_a_small_deflated_bomb_is_read_in_blocks():
    import zlib

    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    data = packer.compress(b" " * (64 << 20)) + packer.flush()
    assert max(map(len, archives._inflated(archives.Bytes(io.BytesIO(data).read)))) <= archives.BLOCK


def test_pages_and_feed(spark):
    page = "<p>A &amp; B<script>x < y</script></p><!-- no --><p class='a>b'>C &#167;&#xA7; &copy;2 &amp;lt; &unknown; 1 < 2<br>D"
    got = spark.createDataFrame([(page,), (None,), ("",)], "p string").select(pages.page_to_text(F.col("p")).alias("t")).collect()
    assert [r["t"] for r in got] == ["A & B \n\nb'>C §§ ©2 &lt; &unknown; 1 < 2\nD", None, ""]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>10-K</title><link href="u{0}"/><updated>2020-01-02T00:00</updated></entry></feed>'

    def fetch(url):
        if url == "page-20":
            raise OSError("down")
        return atom.format(url)

    got = pages.feed(spark, fetch, lambda start: f"page-{start}", 3, 10)
    assert {r["link"] for r in got.select("link").collect()} == {"upage-0"} or got.count() in (1, 2)


def test_retry_gives_up():
    waits = []

    def broken(url):
        raise OSError

    assert pages.retried(broken, "u", wait=waits.append) is None and waits == [2.0, 4.0]


def test_logs_append(spark, tmp_path):
    path = str(tmp_path / "log")
    for k in range(2):
        append_log(spark.createDataFrame([(k, 0.5)], "run int, metric double"), path)
    assert read_log(spark, path, "run int, metric double").count() == 2


def test_contract_texts_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"contract": "c1", "text": "x"}]')
    (tmp_path / "b.json").write_text('{"c2": "y"}')
    assert {r["contract"] for r in files.contract_texts(spark, str(tmp_path / "*.json")).collect()} == {"c1", "c2"}


def test_map_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("q1", "x"), ("q2", "y")], "query_id string, text string")
    files.write_map(rows, "query_id", "text", str(tmp_path / "m"))
    assert files.json_map(spark, str(tmp_path / "m")).count() == 2


def test_parallel_arrays(spark):
    rows = spark.createDataFrame([(["10-K", "8-K"], ["a", "b"])], "form array<string>, doc array<string>")
    assert [r["doc"] for r in files.parallel_arrays(rows, "form", "doc", forms=["8-K"]).collect()] == ["b"]
