"""Building training sets: splits, negatives, routing, decontamination, balance, expansion.

Samples are ordered by a hash of (seed, key), so they repeat on any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.words import keyword_set, overlap
from lexmill.session import cut

SEED = 42


def draw(*key: str | Column, seed: int = SEED) -> Column:
    return F.sha1(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]))


BUCKETS = 4096  # of a group's draws; rows of one bucket are sorted together


def drawn_rank(rows: DataFrame, group: list[str], by: Column, *ties: str) -> DataFrame:
    """`rows` with `_r`, their place in the order of `by` (a draw) and `ties` within each group
    (null is a group), and `_n`, the rows of the group.

    The draw is hexadecimal text, so its first digits part a group evenly into BUCKETS: bucket
    counts are summed in order and only rows of one bucket meet in a task, so a group that
    holds a third of all rows is spread."""
    digits = len(f"{BUCKETS - 1:x}")
    d = rows.withColumn("_d", by).withColumn("_b", F.substring("_d", 1, digits))
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0")).alias(f"_g{i}") for i, g in enumerate(group)]
    names = [f"_g{i}" for i in range(len(group))]
    d = d.select("*", *keys)
    sizes = d.groupBy(*names, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*names)  # at most BUCKETS rows a group
    before = F.coalesce(F.sum("_c").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*names, "_b", before.alias("_before"), F.sum("_c").over(w).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*names, "_b").orderBy("_d", *ties))
    ranked = d.withColumn("_i", inside).join(sizes, [*names, "_b"])
    return ranked.withColumn("_r", F.col("_before") + F.col("_i")).drop(*names, "_b", "_d", "_before", "_i")


def group_split(keys: DataFrame, key: str, dev: float = 0.1, test: float = 0.1) -> DataFrame:
    """(key, part): distinct keys in drawn order, the first share dev, the next test, the rest
    train; each held-out part gets at least one key."""
    k = keys.where(F.col(key).isNotNull()).select(key).distinct()
    ranked = drawn_rank(k, [], draw(key), key)
    n_dev = F.greatest(F.lit(1), F.floor(F.col("_n") * dev))
    n_test = F.greatest(F.lit(1), F.floor(F.col("_n") * test))
    part = F.when(F.col("_r") <= n_dev, "dev").when(F.col("_r") <= n_dev + n_test, "test").otherwise("train")
    return ranked.select(key, part.alias("part"))


def first_match(rows: DataFrame, label: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """`rows` with family and subtype of the first rule (family, subtype, pattern) whose
    pattern is found in `label`; rows without one drop out.

    Rules are configuration: a literal chain of tests, so nothing is joined."""
    chain = F.lit(None).cast("struct<family:string,subtype:string>")
    for family, subtype, pattern in reversed(rules):
        hit = F.struct(F.lit(family).alias("family"), F.lit(subtype).alias("subtype"))
        chain = F.when(F.rlike(F.lower(label), F.lit(pattern)), hit).otherwise(chain)
    return rows.withColumn("_m", chain).where("_m is not null").select(*rows.columns, "_m.family", "_m.subtype")


def folded(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def contains_join(docs: DataFrame, protected: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, item_id) where the document's folded text holds the protected text or is held
    by it.

    A text that holds another holds the words inside it, so pairs are first joined on the
    holder's word n-grams and one n-gram of the held text (inner words only, as outer ones
    may be cut); the substring test runs on what meets.  Texts too short for that (at most
    n + 1 words) are compared one by one with all, as their own small stated set."""

    def prepared(df: DataFrame, key: str) -> DataFrame:
        t = df.select(key, folded(F.col("text")).alias("t")).where("t <> ''")
        return t.withColumn("w", F.split("t", " "))

    def seed(w: Column) -> Column:  # one inner n-gram of a text that is to be found whole
        middle = F.slice(w, 2, F.size(w) - 2)
        at = F.greatest(F.lit(1), F.floor((F.size(middle) - n) / 2).cast("int") + 1)
        return F.xxhash64(F.array_join(F.slice(middle, at, n), " "))

    def grams(w: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " "))))

    d, p = prepared(docs, "doc_id"), prepared(protected, "item_id")
    enough = F.size("w") >= n + 2
    inside = F.size("w") >= n

    def found(held: DataFrame, hk: str, holder: DataFrame, ok: str) -> DataFrame:
        h = held.where(enough).select(hk, F.col("t").alias("ht"), seed(F.col("w")).alias("g"))
        o = holder.where(inside).select(ok, F.col("t").alias("ot"), F.explode(grams(F.col("w"))).alias("g"))
        met = o.join(h, "g").where(F.contains("ot", F.col("ht"))).select("doc_id", "item_id")
        short = held.where(~enough).select(hk, F.col("t").alias("ht"))
        few = holder.select(ok, F.col("t").alias("ot")).join(short, F.contains("ot", F.col("ht"))).select("doc_id", "item_id")
        return met.union(few)

    return found(p, "item_id", d, "doc_id").union(found(d, "doc_id", p, "item_id")).distinct()


def hard_negatives(scored: DataFrame, queries: DataFrame, docs: DataFrame, positives: DataFrame, n: int, max_overlap: float = 0.75, top_k: int = 500, keywords=keyword_set) -> DataFrame:
    """(query_id, doc_id, rk, filled): n negatives a query.

    From the `top_k` best by score, those that are no positives and share at most
    `max_overlap` of the query's keywords, in rank order; what is missing is filled with
    documents drawn by seed from the rest (no overlap test there, `filled` true).

    The fill orders documents by one draw, turned by a draw of the query: each query takes the
    first documents from its own place on. Positives and documents taken already can stand
    there, so it looks at as many more as it has of those."""
    top = scored.withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rk") <= top_k)
    free = top.join(positives.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    kept = free.join(queries.select("query_id", keywords(F.col("text")).alias("_k")), "query_id").join(docs.select("doc_id", F.col("text").alias("_t")), "doc_id")
    kept = kept.where(overlap(F.col("_k"), F.col("_t")) <= max_overlap).select("query_id", "doc_id", "rk")
    first = kept.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("rk"))).where(F.col("_n") <= n).select("query_id", "doc_id", "rk")
    first = cut(first, "negatives")  # n rows a query; used three times below
    taken = first.select("query_id", "doc_id").unionByName(positives.select("query_id", "doc_id").join(queries.select("query_id"), "query_id", "left_semi")).distinct()
    counts = first.groupBy("query_id").agg(F.count("*").alias("_c"))
    short = queries.select("query_id").distinct().join(counts, "query_id", "left").select("query_id", (F.lit(n) - F.coalesce("_c", F.lit(0))).alias("_need")).where("_need > 0")
    short = short.join(taken.groupBy("query_id").agg(F.count("*").alias("_gone")), "query_id", "left").fillna({"_gone": 0})
    line = drawn_rank(docs.select("doc_id").distinct(), [], draw("doc_id"), "doc_id")
    size = line.agg(F.max("_n").alias("_size"))  # one row
    turn = F.conv(F.substring(draw("query_id"), 1, 8), 16, 10).cast("long")
    span = F.least(F.col("_need") + F.col("_gone"), F.col("_size"))
    asked = short.join(size, F.lit(True)).where("_size > 0").select("query_id", "_need", F.posexplode(F.transform(F.sequence(F.lit(0).cast("long"), span - 1), lambda i: F.pmod(turn + i, F.col("_size")) + 1)).alias("_place", "_r"))
    pool = asked.join(line.select("doc_id", "_r"), "_r").join(taken, ["query_id", "doc_id"], "left_anti")
    drawn = pool.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("_place"))).where("_n <= _need")
    return first.withColumn("filled", F.lit(False)).unionByName(drawn.select("query_id", "doc_id", F.lit(None).cast("int").alias("rk"), F.lit(True).alias("filled")))


def capped(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The first n rows of each group in drawn order (Spark keeps n a group and task before
    the shuffle)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(draw(key), key))).where(F.col("_r") <= n).drop("_r")


def balanced(rows: DataFrame, group: str, key: str, ceiling: int, floor: int) -> DataFrame:
    """`rows` with `copy`: groups above the ceiling cut to it, groups below the floor repeated
    up to it; the ceiling has precedence."""
    r = drawn_rank(rows, [group], draw(key), key)
    cut = (F.lit(ceiling) > 0) & (F.col("_n") > ceiling)
    grow = ~cut & (F.lit(floor) > 0) & (F.col("_n") < floor)
    copies = F.when(grow, F.ceil(F.lit(floor) / F.col("_n")).cast("int")).otherwise(F.lit(1))
    out = r.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    place = F.col("copy") * F.col("_n") + F.col("_r")
    keep = F.when(cut, F.col("_r") <= ceiling).when(grow, place <= floor).otherwise(F.lit(True))
    return out.where(keep).drop("_r", "_n")


def holdout_then_cap(rows: DataFrame, group: str, key: str, hold: int = 30, share: int = 5, cap: int = 1000, least: int = 30) -> DataFrame:
    """`rows` with `part`: in drawn order the first min(hold, n // share) of a group are eval,
    the next `cap` train; groups under `least` rows drop out."""
    r = drawn_rank(rows, [group], draw(key), key)
    held = F.least(F.lit(hold), F.floor(F.col("_n") / share))
    part = F.when(F.col("_r") <= held, "eval").when(F.col("_r") <= held + cap, "train")
    return r.where(F.col("_n") >= least).withColumn("part", part).where("part is not null").drop("_r", "_n")


def round_robin(rows: DataFrame, group: str, key: str, total: int) -> DataFrame:
    """`total` rows, one of each group a round, groups and rows in drawn order."""
    r = drawn_rank(rows, [group], draw(key), key).withColumnRenamed("_r", "round").drop("_n")
    return r.orderBy("round", draw(group), group).limit(total)


def triplets(rows: DataFrame) -> DataFrame:
    """One row a negative of `rows(query, positive, negatives, ...)`; null and empty negatives
    and those equal to the positive drop out."""
    out = rows.withColumn("negative", F.explode("negatives")).drop("negatives")
    return out.where((F.col("negative") != "") & (F.col("negative") != F.col("positive")))


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """`rows` so many times over; 0 gives none, less is an error."""
    if times < 0:
        raise ValueError("times must not be negative")
    if times == 0:
        return rows.where(F.lit(False)).withColumn("repeat", F.lit(1))
    return rows.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))


