"""Ranking and metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import segments as S
from lexmill.functions import words as W
from lexmill.operators import metrics as M
from lexmill.operators import ranking as R
from lexmill.plans.base import chunks, documents, judged, records
from lexmill.plans.registry import DOCS, JUDGED, RECORDS, named, sql_list, tokens
from lexmill.tables import read

_STOP = sql_list(W.STOPWORDS)


def bm25_sql(words: str = tokens("text"), queries: str = "select query_id, text from queries", docs: str = "select doc_id, text from docs") -> str:
    """Common table expressions that end in sc(query_id, doc_id, score)."""
    return f"""dt as (select doc_id, tok, count(*) as tf from (select doc_id, unnest({words}) as tok from ({docs})) group by doc_id, tok),
    dl as (select doc_id, len({words}) as dl from ({docs})), st as (select count(*) as n, avg(dl) as avgdl from dl),
    dfs as (select tok, count(*) as df from dt group by tok), idf0 as (select tok, ln(n - df + 0.5) - ln(df + 0.5) as idf from dfs cross join st),
    av as (select avg(idf) as a from idf0), idfs as (select tok, case when idf < 0 then 0.25 * a else idf end as idf from idf0 cross join av),
    qt as (select query_id, tok, count(*) as qtf from (select query_id, unnest({words}) as tok from ({queries})) group by query_id, tok),
    sc as (select query_id, dt.doc_id, round(sum(qtf * idfs.idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score
    from qt join idfs on qt.tok = idfs.tok join dt on dt.tok = qt.tok join dl on dl.doc_id = dt.doc_id cross join st group by query_id, dt.doc_id)"""


_RK = "row_number() over (partition by query_id order by score desc, doc_id) as rk"
_TOPICAL = f"list_filter({tokens('text')}, lambda w: not list_contains({_STOP}, w) and length(w) > 2)"


@named(f"with {DOCS}, {bm25_sql()}, r as (select *, {_RK} from sc) select query_id, doc_id, score, cast(rk as int) as rk from r where rk <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents for each query."""
    return R.ranked(R.bm25(read(spark, sf_dir, "queries"), documents(spark, sf_dir)), "query_id", "doc_id", 10)


@named(f"with {DOCS}, {bm25_sql(_TOPICAL)}, r as (select *, {_RK} from sc) select query_id, doc_id, score, cast(rk as int) as rk from r where rk <= 10")
def bm25_stop_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(R.bm25(read(spark, sf_dir, "queries"), documents(spark, sf_dir), W.topical), "query_id", "doc_id", 10)


# Vectors: ids divisible by 100 ask, all are searched.
@named(
    """with v as (select vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * cast(x as double)))) as n from embeddings),
    u as (select vec_id, list_transform(embedding, lambda x: cast(x as double) / greatest(n, 1e-12)) as e from v),
    s as (select q.vec_id as query_id, d.vec_id as doc_id, round(list_dot_product(q.e, d.e), 6) as score from u q cross join u d where q.vec_id % 100 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from s) select query_id, doc_id, score, cast(rk as int) as rk from r where rk <= 10"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return R.ranked(R.cosine(q, e.select(F.col("vec_id").alias("doc_id"), "vec")), "query_id", "doc_id", 10)


_MAXSIM = """q as (select label as query_id, vec_id as pos, embedding as qv from embeddings where vec_id % 100 = 0), d as (select vec_id // 10 as doc_id, embedding as dv from embeddings),
    b as (select query_id, pos, doc_id, max(round(list_dot_product(list_transform(qv, lambda x: cast(x as double)), list_transform(dv, lambda x: cast(x as double))), 6)) as m from q cross join d group by all),
    sc as (select query_id, doc_id, round(sum(m), 6) as score from b group by all)"""


def _maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vec")
    q = e.where("vec_id % 100 = 0").select(F.col("label").alias("query_id"), F.col("vec_id").alias("pos"), "vec")
    return R.maxsim(q, e.select(F.expr("vec_id div 10").alias("doc_id"), "vec"))


@named(f"with {_MAXSIM}, r as (select *, {_RK} from sc) select query_id, doc_id, score, cast(rk as int) as rk from r where rk <= 5")
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five best multi-vector documents (ten vectors each) for each multi-vector query."""
    return R.ranked(_maxsim(spark, sf_dir), "query_id", "doc_id", 5)


_RANKED = f"rq as (select *, {_RK} from sc)"


@named(
    f"""with {DOCS}, {bm25_sql()}, {JUDGED}, neg as (select sc.* from sc where not exists (select 1 from judged j where j.query_id = sc.query_id and j.doc_id = cast(sc.doc_id as varchar) and j.grade >= 3)),
    r as (select *, {_RK} from neg) select query_id, doc_id, score from r where rk = 1"""
)
def best_nonpositive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored document of each query that is not judged relevant."""
    scored = R.bm25(read(spark, sf_dir, "queries"), documents(spark, sf_dir))
    good = judged(spark, sf_dir).where("grade >= 3").select("query_id", F.col("doc_id").cast("long").alias("doc_id"))
    return R.ranked(scored.join(good, ["query_id", "doc_id"], "left_anti"), "query_id", "doc_id", 1).drop("rk")


@named(
    f"""with {DOCS}, {bm25_sql()}, m as (select category as query_id, doc_id, max(score) as score from sc join queries using (query_id) group by category, doc_id),
    r as (select *, {_RK} from m) select query_id as category, doc_id, score, cast(rk as int) as rk from r where rk <= 5"""
)
def multi_query_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score over a category's query variants, five best documents."""
    q = read(spark, sf_dir, "queries")
    scored = R.bm25(q, documents(spark, sf_dir)).join(q.select("query_id", "category"), "query_id")
    best = scored.groupBy("category", "doc_id").agg(F.max("score").alias("score"))
    return R.ranked(best, "category", "doc_id", 5)


@named(
    f"""with {DOCS}, {bm25_sql()}, {_RANKED}, h as (select distinct query_id, cast(doc_id as bigint) as doc_id, 'heading_label' as source from heading_evidence where doc_id is not null),
    u as (select query_id, doc_id, 'bm25@' || rk as source from rq where rk <= 10 union all select * from h)
    select query_id, doc_id, array_to_string(list_sort(list(source)), ',') as sources, case when list_contains(list(source), 'heading_label') then 1 else 0 end as heading_label from u group by query_id, doc_id"""
)
def pool_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for judging with where they came from: heading labels and BM25 ranks."""
    top = bm25_topk(spark, sf_dir).select("query_id", "doc_id", F.concat(F.lit("bm25@"), F.col("rk").cast("string")).alias("source"))
    heads = read(spark, sf_dir, "heading_evidence").where("doc_id is not null").select("query_id", F.col("doc_id").cast("long").alias("doc_id"), F.lit("heading_label").alias("source")).distinct()
    by = top.unionByName(heads).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list("source")).alias("s"))  # at most two sources
    return by.select("query_id", "doc_id", F.array_join("s", ",").alias("sources"), F.array_contains("s", "heading_label").cast("int").alias("heading_label"))


# Metrics over the BM25 ranking of all judged documents.
_JDOCS = "select doc_id, text from docs where cast(doc_id as varchar) in (select doc_id from qrels)"
_FULL = f"""full_ as (select q.query_id, d.doc_id, coalesce(sc.score, 0.0) as score from queries q cross join ({_JDOCS}) d left join sc on sc.query_id = q.query_id and sc.doc_id = d.doc_id),
    ranking as (select query_id, doc_id, {_RK} from full_)"""


def per_query_sql(ranking: str = "ranking", threshold: int = 3, strong: int = 4, judged_: str = "judged") -> str:
    return f"""g as (select r.query_id, r.doc_id, r.rk, coalesce(j.grade, 0) as rel from {ranking} r left join {judged_} j on j.query_id = r.query_id and j.doc_id = cast(r.doc_id as varchar)),
    g2 as (select *, row_number() over (partition by query_id order by rel desc, rk) as irk, case when rel >= {threshold} then 1 else 0 end as hit from g),
    g3 as (select *, sum(hit) over (partition by query_id order by rk rows unbounded preceding) as hits from g2),
    b as (select query_id, sum(case when hit = 1 then hits / rk else 0.0 end) as ap_sum,
    sum(case when rk <= 5 then rel / log2(rk + 1) else 0.0 end) as dcg5, sum(case when irk <= 5 then rel / log2(irk + 1) else 0.0 end) as idcg5,
    sum(case when rk <= 10 then rel / log2(rk + 1) else 0.0 end) as dcg10, sum(case when irk <= 10 then rel / log2(irk + 1) else 0.0 end) as idcg10,
    sum(case when rk <= 1 then hit else 0 end) as hit1, sum(case when rk <= 5 then hit else 0 end) as hit5, sum(case when rk <= 10 then hit else 0 end) as hit10,
    sum(case when rk <= 5 and rel >= {strong} then 1 else 0 end) as strong5 from g3 group by query_id),
    jt as (select query_id, sum(case when grade >= {threshold} then 1 else 0 end) as n_rel, sum(case when grade >= {strong} then 1 else 0 end) as n_strong from {judged_} group by query_id),
    pq as (select b.query_id, coalesce(n_rel, 0) as n_rel, case when idcg5 > 0 then dcg5 / idcg5 else 0.0 end as ndcg5, case when idcg10 > 0 then dcg10 / idcg10 else 0.0 end as ndcg10,
    case when n_rel > 0 then ap_sum / n_rel end as ap, case when n_rel > 0 then hit1 / n_rel end as recall1, case when n_rel > 0 then hit5 / n_rel end as recall5,
    case when n_rel > 0 then hit10 / n_rel end as recall10, case when n_strong > 0 then strong5 / 5.0 end as strong_precision5 from b left join jt using (query_id))"""


def _judged_ranking(spark: SparkSession, sf_dir: str, words=W.tokenize) -> tuple[DataFrame, DataFrame]:
    marks = judged(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("long"))
    every = read(spark, sf_dir, "qrels").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    docs = documents(spark, sf_dir).join(every, "doc_id", "left_semi")
    q = read(spark, sf_dir, "queries")
    return R.rank_all(q, docs, R.bm25(q, docs, words)).select("query_id", "doc_id", "rk"), marks


_BASE = f"with {DOCS}, {JUDGED}, {bm25_sql(docs=_JDOCS)}, {_FULL}"
_COLS = "round({0}(ndcg5), {1}) as ndcg5, round({0}(ndcg10), {1}) as ndcg10, round({0}(ap), {1}) as ap, round({0}(recall1), {1}) as recall1, round({0}(recall5), {1}) as recall5, round({0}(recall10), {1}) as recall10, round({0}(strong_precision5), {1}) as strong_precision5"


@named(f"{_BASE}, {per_query_sql()} select query_id, cast(n_rel as bigint) as n_rel, {_COLS.format('', 6)} from pq")
def query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NDCG, average precision, recall and strong precision of every query."""
    rows = M.per_query(*_judged_ranking(spark, sf_dir), 3, 4)
    return rows.select("query_id", "n_rel", *[F.round(c, 6).alias(c) for c in rows.columns[2:]])


@named(f"{_BASE}, {per_query_sql()} select count(*) as queries, {_COLS.format('avg', 4)} from pq")
def graded_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.graded_mean(M.per_query(*_judged_ranking(spark, sf_dir), 3, 4))


_MACRO = """c as (select category, round(avg(ndcg10), 4) as ndcg10, round(avg(ap), 4) as ap, sum(n_rel) as n_rel from pq join queries using (query_id) group by category)
    select count(*) as categories, round(avg(ndcg10), 4) as macro_ndcg10, round(avg(ap), 4) as macro_map, cast(sum(case when n_rel >= 5 then 1 else 0 end) as bigint) as big_categories,
    round(avg(case when n_rel >= 5 then ndcg10 end), 4) as macro_ndcg10_big, round(avg(case when n_rel >= 5 then ap end), 4) as macro_map_big from c"""


@named(f"{_BASE}, bin as (select query_id, doc_id, case when grade >= 3 then 1 else 0 end as grade from judged), {per_query_sql(threshold=1, strong=1, judged_='bin')}, {_MACRO}")
def macro_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary relevance, macro-averaged over categories."""
    ranking, marks = _judged_ranking(spark, sf_dir)
    binary = marks.withColumn("grade", (F.col("grade") >= 3).cast("int"))
    return M.macro_mean(M.per_query(ranking, binary, 1, 1), read(spark, sf_dir, "queries"))


@named("select case when max(grade) <= 1 then 1 else 3 end as relevant, case when max(grade) <= 1 then 1 else 4 end as strong from qrels")
def grade_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.max("grade")
    return read(spark, sf_dir, "qrels").agg(F.when(top <= 1, 1).otherwise(3).alias("relevant"), F.when(top <= 1, 1).otherwise(4).alias("strong"))


def _arm(words: str) -> str:
    return f"with {DOCS}, {JUDGED}, {bm25_sql(words, docs=_JDOCS)}, {_FULL}, {per_query_sql()} select query_id, ndcg10 from pq"


_DELTAS = f"deltas as (select a.query_id, a.ndcg10 as a, b.ndcg10 as b, b.ndcg10 - a.ndcg10 as diff from ({_arm(tokens('text'))}) a join ({_arm(_TOPICAL)}) b using (query_id))"


@named(
    f"""with {_DELTAS}, r as (select *, row_number() over (order by diff desc, query_id) as up, row_number() over (order by diff, query_id) as down from deltas)
    select case when diff > 0 then 'win' else 'loss' end as side, query_id, round(a, 6) as ndcg_a, round(b, 6) as ndcg_b, round(diff, 6) as delta from r where (diff > 0 and up <= 8) or (diff < 0 and down <= 8)"""
)
def winloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries where topical words rank better or worse than all words, extremes first."""
    d = _deltas(spark, sf_dir)
    best = d.where("diff > 0").orderBy(F.desc("diff"), "query_id").limit(8).withColumn("side", F.lit("win"))
    worst = d.where("diff < 0").orderBy("diff", "query_id").limit(8).withColumn("side", F.lit("loss"))
    return best.unionByName(worst).select("side", "query_id", F.round("a", 6).alias("ndcg_a"), F.round("b", 6).alias("ndcg_b"), F.round("diff", 6).alias("delta"))


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = M.per_query(*_judged_ranking(spark, sf_dir), 3, 4).select("query_id", F.col("ndcg10").alias("a"))
    b = M.per_query(*_judged_ranking(spark, sf_dir, W.topical), 3, 4).select("query_id", F.col("ndcg10").alias("b"))
    return a.join(b, "query_id").withColumn("diff", F.col("b") - F.col("a"))


@named(
    f"""with {_DELTAS}, numbered as (select row_number() over (order by query_id) as i, round(diff, 6) as diff from deltas),
    n as (select count(*) as n, avg(diff) as mean, sum(case when diff > 0 then 1 else 0 end) as wins, sum(case when diff < 0 then 1 else 0 end) as losses from numbered),
    draws as (select b, n, unnest(range(1, n + 1)) as j from range(1000) t(b) cross join n),
    picked as (select b, 1 + cast('0x' || substr(md5('42:' || b || ':' || j), 1, 8) as bigint) % n as i from draws),
    means as (select b, avg(diff) as m from picked join numbered using (i) group by b)
    select any_value(n) as n, cast(any_value(wins) as bigint) as wins, cast(any_value(losses) as bigint) as losses, round(any_value(mean), 6) as mean_delta, round(quantile_cont(m, 0.025), 6) as lo,
    round(quantile_cont(m, 0.975), 6) as hi, round(avg(case when m > 0 then 1 else 0 end), 6) as p_positive from means cross join n"""
)
def bootstrap_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired bootstrap of two rankings' NDCG@10."""
    return M.bootstrap(_deltas(spark, sf_dir).select("query_id", F.round("diff", 6).alias("diff")))
