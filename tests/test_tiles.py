"""Best documents in tiles: the rows of `bm25`, and no row a pair."""

import random
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill import catalog
from lexmill.operators import ranking as R
from lexmill.operators import tiles

WORDS = [f"w{i}" for i in range(60)]


def written(spark) -> int:
    """Records that the stages so far have written for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_depth_fill_makes_no_row_a_pair(spark, tmp_path):
    rng, n = random.Random(5), 800
    labels = ["Termination", "notice", "assignment", "Payment terms", "late payment", "audit", None]
    held = ["notice ", "assign ", "audit ", "", "", ""]
    at = datetime(2024, 1, 1)
    docs = [(i, rng.choice(held) + " ".join(rng.choices(WORDS, k=rng.randint(9, 40))), at) for i in range(n // 2)]
    docs += [(n + i, docs[i][1], at) for i in range(n // 8)]  # texts that stand under several ids
    ids = [d[0] for d in docs]
    spark.createDataFrame(docs, "doc_id long, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [(i, rng.choice(labels), str(rng.choice(ids)), at) for i in range(n)]
    table = spark.createDataFrame(rows, "evidence_id long, clause_type string, doc_id string, loaded_at timestamp")
    table.selectExpr("*", *[f"cast(null as string) as {c}" for c in ("query_id", "heading", "contract_id", "split")]).write.parquet(f"{tmp_path}/heading_evidence.parquet")
    before = written(spark)
    got = sorted((r["evidence_id"], r["negative"], r["rk"]) for r in catalog.QUERIES["depth_fill"](spark, str(tmp_path)).collect())
    assert written(spark) - before < 300 * n
    con = duckdb.connect()
    con.execute(f"create view docs_ as select * from '{tmp_path}/documents.parquet/*.parquet'")
    con.execute("create view documents as select *, null::varchar as source, null::varchar as lang, null::varchar as contract_id, null::varchar as heading from docs_")
    con.execute(f"create view heading_evidence as select * from '{tmp_path}/heading_evidence.parquet/*.parquet'")
    assert got and got == sorted(con.execute(f"select evidence_id, negative, rk from ({catalog.ORACLE['depth_fill']})").fetchall())


@pytest.mark.parametrize("n, vocabulary, block", [(300, 40, 1 << 16), (300, 40, 70), (120, 3, 50), (3, 5, 1 << 16)])
def test_best_are_those_of_bm25(spark, monkeypatch, n, vocabulary, block):
    """Rare words, words in more than half of the documents (weights below zero), like texts,
    queries that few or no documents share a word with, several blocks."""
    rng = random.Random(n * vocabulary)
    some = lambda k: " ".join(WORDS[min(int(rng.expovariate(6 / vocabulary)), vocabulary - 1)] for _ in range(rng.randint(0, k)))
    docs = [(i, some(12), rng.randint(0, 3)) for i in range(n)] + [(n, "rare only", 3), (n + 1, "rare only", 1), (n + 2, "", 3)]
    asks = [(i, some(6), i % 2) for i in range(n)] + [(n, "rare", 0), (n + 1, "rare", 1), (n + 2, "nowhere", 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, open long").cache()
    q = spark.createDataFrame(asks, "query_id long, text string, kind int").cache()
    full = R.bm25(q.select("query_id", "text"), d.select("doc_id", "text")).join(q.select("query_id", "kind"), "query_id").join(d.select("doc_id", "open"), "doc_id")
    want = R.ranked(full.where(F.expr("(shiftright(open, kind) & 1) = 1")), "query_id", "doc_id", 2).select("query_id", "doc_id", "score", "rk").collect()
    monkeypatch.setattr(R, "BLOCK", block)
    got = R.bm25_best(q, d, 2).select("query_id", "doc_id", "score", "rk").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert (n + 1, n, 1) in {(r["query_id"], r["doc_id"], r["rk"]) for r in got}


def test_empty_tables(spark):
    q = spark.createDataFrame([], "query_id long, text string, kind int")
    d = spark.createDataFrame([], "doc_id long, text string, open long")
    one = spark.createDataFrame([(1, "a b", 0)], q.schema)
    assert R.bm25_best(q, d, 2).count() == 0 and R.bm25_best(one, d, 2).count() == 0
    assert R.bm25_best(q, spark.createDataFrame([(1, "a b", 1)], d.schema), 2).count() == 0


def test_rounding_as_sql():
    assert tiles.rounded(np.array([0.25, -0.25, 1.04]), 1).tolist() == [0.3, -0.3, 1.0]
