"""Ranking metrics as grouped expressions over (query_id, doc_id, rk, rel)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gains(ranking: DataFrame, judged: DataFrame) -> DataFrame:
    """`ranking(query_id, doc_id, rk)` with `rel` (0 where not judged) and `ideal_rk`."""
    out = ranking.join(judged.select("query_id", "doc_id", F.col("grade").alias("rel")), ["query_id", "doc_id"], "left").fillna({"rel": 0})
    return out.withColumn("ideal_rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "rk")))


def dcg(rel: Column, rank: Column, k: int) -> Column:
    """Linear gain over the binary logarithm of rank + 1, up to rank k."""
    return F.sum(F.when(rank <= k, rel / F.log2(rank + 1)).otherwise(0.0))


def per_query(ranking: DataFrame, judged: DataFrame, threshold: int, strong: int, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """One row a query: ndcg@k, average precision, recall@1/5/10, precision of strong at 5.

    The ideal order comes from the ranked documents; recall and average precision divide by
    all judged relevant documents, ranked or not, and are null without any.  The strong
    precision always divides by 5 and is null without strong documents."""
    g = gains(ranking, judged)
    hit = (F.col("rel") >= threshold).cast("int")
    g = g.withColumn("hit", hit).withColumn("hits", F.sum("hit").over(Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)))
    sums = [F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rk")).otherwise(0.0)).alias("ap_sum")]
    for k in ks:
        sums += [dcg(F.col("rel"), F.col("rk"), k).alias(f"dcg{k}"), dcg(F.col("rel"), F.col("ideal_rk"), k).alias(f"idcg{k}")]
    for k in (1, 5, 10):
        sums.append(F.sum(F.when(F.col("rk") <= k, F.col("hit")).otherwise(0)).alias(f"hit{k}"))
    sums.append(F.sum(F.when((F.col("rk") <= 5) & (F.col("rel") >= strong), 1).otherwise(0)).alias("strong5"))
    base = g.groupBy("query_id").agg(*sums)
    totals = judged.groupBy("query_id").agg(F.sum((F.col("grade") >= threshold).cast("int")).alias("n_rel"), F.sum((F.col("grade") >= strong).cast("int")).alias("n_strong"))
    out = base.join(totals, "query_id", "left").fillna({"n_rel": 0, "n_strong": 0})
    some = F.col("n_rel") > 0
    return out.select(
        "query_id",
        "n_rel",
        *[F.when(F.col(f"idcg{k}") > 0, F.col(f"dcg{k}") / F.col(f"idcg{k}")).otherwise(0.0).alias(f"ndcg{k}") for k in ks],
        F.when(some, F.col("ap_sum") / F.col("n_rel")).alias("ap"),
        *[F.when(some, F.col(f"hit{k}") / F.col("n_rel")).alias(f"recall{k}") for k in (1, 5, 10)],
        F.when(F.col("n_strong") > 0, F.col("strong5") / 5.0).alias("strong_precision5"),
    )


def graded_mean(rows: DataFrame) -> DataFrame:
    """Means over queries; measures that need relevant documents leave out queries without."""
    names = [c for c in rows.columns if c not in ("query_id", "n_rel")]
    return rows.agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 4).alias(c) for c in names])


def macro_mean(rows: DataFrame, categories: DataFrame, big: int = 5) -> DataFrame:
    """Categories first (rounded to 4 digits), then their mean; and that of categories with
    at least `big` relevant documents."""
    by = rows.join(categories.select("query_id", "category"), "query_id").groupBy("category")
    per = by.agg(F.round(F.avg("ndcg10"), 4).alias("ndcg10"), F.round(F.avg("ap"), 4).alias("ap"), F.sum("n_rel").alias("n_rel"))
    wide = F.col("n_rel") >= big
    return per.agg(
        F.count("*").alias("categories"),
        F.round(F.avg("ndcg10"), 4).alias("macro_ndcg10"),
        F.round(F.avg("ap"), 4).alias("macro_map"),
        F.sum(wide.cast("int")).alias("big_categories"),
        F.round(F.avg(F.when(wide, F.col("ndcg10"))), 4).alias("macro_ndcg10_big"),
        F.round(F.avg(F.when(wide, F.col("ap"))), 4).alias("macro_map_big"),
    )


def bootstrap(diffs: DataFrame, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Paired bootstrap of `diffs(query_id, diff)`: mean, percentile interval, P(mean > 0).

    Draws are hashes of (seed, round, draw), so they need no generator state and any engine
    repeats them.  Per-query differences of one comparison are few (a row a query), rounds
    are spread over the cluster."""
    numbered = diffs.select(F.row_number().over(Window.orderBy("query_id")).alias("i"), "diff")  # one row a query
    n = numbered.agg(F.count("*").alias("n"), F.avg("diff").alias("mean"), F.sum((F.col("diff") > 0).cast("int")).alias("wins"), F.sum((F.col("diff") < 0).cast("int")).alias("losses"))
    draws = diffs.sparkSession.range(rounds).select(F.col("id").alias("b")).crossJoin(F.broadcast(n.select("n")))
    draws = draws.select("b", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("j"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("b").cast("string"), F.col("j").cast("string"))), 1, 8), 16, 10).cast("long")
    picked = draws.select("b", (F.pmod(h, F.col("n")) + 1).cast("int").alias("i")).join(numbered, "i")
    means = picked.groupBy("b").agg(F.avg("diff").alias("m"))
    out = means.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi"), F.avg((F.col("m") > 0).cast("int")).alias("p"))
    return out.crossJoin(n).select("n", "wins", "losses", F.round("mean", 6).alias("mean_delta"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("p", 6).alias("p_positive"))
