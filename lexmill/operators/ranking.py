"""Ranking: BM25, cosine, multi-vector scores, top-k and rank-all.

Scores are rounded before they are ranked, ties go by id, so every engine and every
partitioning gives the same order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.words import tokenize
from lexmill.operators import tiles
from lexmill.session import cut, slots

K1, B, FLOOR = 1.5, 0.75, 0.25
DIGITS = 6
BLOCK = 1 << 16  # texts, and queries, of a tile


def ranked(scored: DataFrame, by: str, item: str, k: int | None = None, score: str = "score") -> DataFrame:
    """`rk` per `by`, best score first, ties by item; the first k rows when k is given.

    With k, Spark limits each group before the shuffle (WindowGroupLimit)."""
    out = scored.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item)))
    return out.where(F.col("rk") <= k) if k else out


def _weights(split: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (n, avgdl), and (tok, idf) of the words in `wanted`, from `split(toks, copies)`: a
    document's words and how many documents are like it."""
    # A null beside each document's words stands for the document itself.
    every = split.select("copies", (F.size("toks") * F.col("copies")).alias("dl"), F.explode(F.concat(F.array_distinct("toks"), F.array(F.lit(None).cast("string")))).alias("tok"))
    counts = cut(every.groupBy("tok").agg(F.sum("copies").alias("df"), F.sum("dl").alias("total")), "vocabulary")
    size = counts.where("tok is null").select(F.col("df").cast("double").alias("n"), (F.col("total") / F.col("df")).alias("avgdl"))  # one row
    idf = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    raw = counts.where("tok is not null").crossJoin(F.broadcast(size)).select("tok", idf.alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean"))  # one row
    weights = raw.join(wanted, "tok", "left_semi").crossJoin(F.broadcast(mean))
    return size, weights.select("tok", F.when(F.col("idf") < 0, FLOOR * F.col("mean")).otherwise(F.col("idf")).alias("idf"))


def bm25(queries: DataFrame, docs: DataFrame, words=tokenize) -> DataFrame:
    """(query_id, doc_id, score) for `queries(query_id, text)` and `docs(doc_id, text)`, for
    pairs that share a word.

    Okapi weights; an idf below zero counts as a quarter of the mean idf of all words.
    Documents without words count towards their number and mean length; repeated query words
    count repeatedly.  The vocabulary (a row a word, counted map-side) is all that is written;
    only words that some query has become postings."""
    asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("tok")).groupBy("query_id", "tok").agg(F.count("*").alias("qtf"))
    split = docs.select("doc_id", F.coalesce(words(F.col("text")), F.array().cast("array<string>")).alias("toks"))
    wanted = asked.select("tok").distinct()
    size, weights = _weights(split.select("toks", F.lit(1).alias("copies")), wanted)
    flat = split.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("tok")).join(wanted, "tok", "left_semi")
    postings = flat.groupBy("doc_id", "dl", "tok").agg(F.count("*").alias("tf"))
    joined = postings.join(asked.join(weights, "tok"), "tok").crossJoin(F.broadcast(size))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"))


def bm25_best(queries: DataFrame, docs: DataFrame, k: int, words=tokenize) -> DataFrame:
    """(query_id, doc_id, score, rk): the k best documents by `bm25` of each query, for as many
    queries as there are documents, where the pairs that share a word are nearly all pairs.

    `queries(query_id, text, kind)` and `docs(doc_id, text, open)` with long ids; bit `kind` of
    `open` says whether a document may answer queries of that kind (all documents count in the
    weights).  Documents of one text, few, are scored once.

    Pairs are scored in tiles (lexmill.operators.tiles) and never become rows: a block of
    documents meets each block of queries, so the work grows as their product, but what is
    written grows with the blocks on the other side.  Words are compared by 64-bit hashes."""
    spark = queries.sparkSession
    owner = F.struct(F.col("doc_id").alias("id"), F.col("open").alias("open"))
    texts = cut(docs.where("text is not null").groupBy("text").agg(F.collect_list(owner).alias("owners")), "texts")
    queries = cut(queries.select("query_id", "text", "kind"), "queries")
    asked = queries.select("query_id", "kind", F.explode(words(F.col("text"))).alias("tok")).groupBy("query_id", "kind", "tok").agg(F.count("*").alias("qtf"))
    split = texts.select("owners", words(F.col("text")).alias("toks"))
    size, weights = _weights(split.select("toks", F.size("owners").alias("copies")), asked.select("tok").distinct())
    term = F.struct(F.xxhash64("tok").alias("t"), (F.col("qtf") * F.col("idf")).alias("w"))
    q = asked.join(weights, "tok").groupBy("query_id", "kind").agg(F.collect_list(term).alias("l"))
    across = -(-texts.count() // BLOCK) or 1  # blocks of documents
    down = max(-(-queries.count() // BLOCK), -(-slots(spark) // across))
    norm = K1 * (1 - B + B * F.size("toks") / F.col("avgdl"))
    d = split.crossJoin(F.broadcast(size)).select(norm.alias("norm"), F.transform("toks", lambda x: F.xxhash64(x)).alias("terms"), "owners", F.pmod(F.xxhash64(F.col("owners")[0]["id"]), F.lit(across)).alias("block"))
    at = lambda n, i: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(i)
    d = d.select("*", at(down, "other")).select((F.col("block") * down + F.col("other")).alias("tile"), F.col("norm"), "terms", F.col("owners.id").alias("owners"), F.col("owners.open").alias("open"))
    q = q.select("*", at(across, "other")).select((F.col("other") * down + F.pmod(F.xxhash64("query_id"), F.lit(down))).alias("tile"), F.col("query_id").alias("id"), "kind", F.col("l.t").alias("terms"), F.col("l.w").alias("weights"))
    fields = [f.split() for f in tiles.ROW.split(", ")]
    shaped = lambda df: df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])
    rows = shaped(d).unionByName(shaped(q)).repartitionById(across * down, "tile")
    return ranked(rows.mapInArrow(tiles.searcher(k, K1, DIGITS), tiles.FOUND), "query_id", "doc_id", k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """v over its length (at least 1e-12)."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.transform(v, lambda x: x.cast("double") / norm)


def cosine(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) of every query vector with every document vector.

    The queries are a stated set; Spark broadcasts them when they are small and otherwise
    joins block by block."""
    q = queries.select("query_id", normalized(F.col("vec")).alias("qv"))
    d = docs.select("doc_id", normalized(F.col("vec")).alias("dv"))
    return q.join(d, F.lit(True)).select("query_id", "doc_id", F.round(dot(F.col("qv"), F.col("dv")), DIGITS).alias("score"))


def maxsim(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Multi-vector score: for each query vector its best document vector, summed.

    `queries(query_id, pos, vec)` and `docs(doc_id, vec)` hold one vector a row; the best per
    query vector is a grouped maximum (combined map-side), never a collected matrix."""
    pairs = queries.select("query_id", "pos", F.col("vec").alias("qv")).join(docs.select("doc_id", F.col("vec").alias("dv")), F.lit(True))
    best = pairs.groupBy("query_id", "pos", "doc_id").agg(F.max(F.round(dot(F.col("qv"), F.col("dv")), DIGITS)).alias("m"))
    return best.groupBy("query_id", "doc_id").agg(F.round(F.sum("m"), DIGITS).alias("score"))


def rank_all(queries: DataFrame, docs: DataFrame, scored: DataFrame) -> DataFrame:
    """Every document ranked for every query of a stated set; pairs without a score get 0."""
    grid = queries.select("query_id").join(docs.select("doc_id"), F.lit(True))
    return ranked(grid.join(scored, ["query_id", "doc_id"], "left").fillna({"score": 0.0}), "query_id", "doc_id")
