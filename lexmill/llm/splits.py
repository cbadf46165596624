"""Splits that keep related records together.

Related entities are joined by distributed union-find (`groups.components`); groups then
go, largest first, to the split furthest below its target.  Groups of one size are alike
to that rule, so the greedy choice runs over the histogram of sizes (at most about
sqrt(2 x rows) different ones) in closed form, and which group of a size gets which split
is drawn by seed, without ever listing groups on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.draw import lot, running
from lexmill.llm.groups import components
from lexmill.session import cut
from lexmill.tables import read

SHARES = {"train": 0.8, "valid": 0.1, "test": 0.1}
SEED = 42


def contract_key(c: Column) -> Column:
    """One key for every way a contract_id is written.

    Case, blanks, %-escapes, separators, leading zeros, a feed or ticker prefix, a URL and
    the file ending do not matter: the filing number (10 + 2 + 6 digits) and the document
    name behind it make the key.  Text without such a number is folded to its letters and
    digits; null stays null."""
    s = F.lower(F.regexp_replace(F.coalesce(F.try_url_decode(c), c), r"[\s\p{Z}]+", ""))
    shape = r"(\d{10})[-_]?(\d{2})[-_]?(\d{6})[-_/]([^/]+?)(?:\.html?|\.txt|\.pdf)?/?$"
    part = [F.regexp_extract(s, shape, i) for i in range(1, 5)]
    folded = lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")
    return F.when(part[0] != "", F.concat(*part[:3], F.lit(":"), folded(part[3]))).otherwise(folded(s))


def text_key(c: Column) -> Column:
    """Key of a text but for spacing; null for null or blank text."""
    return F.md5(F.nullif(F.regexp_replace(c, "[\\s\\p{Z}​﻿]+", ""), F.lit("")))


def contract_groups(pool: DataFrame) -> DataFrame:
    """(contract_id, key, root): each contract of `pool` with the first contract_id of its
    refilings. A contract with null or blank text, or a text of its own, is its own root.
    Repeated rows count once; null contract_id is left out."""
    base = pool.where("contract_id is not null").select("contract_id", text_key(F.col("text")).alias("t")).distinct()
    base = cut(base, "p1-contracts")
    links = base.where("t is not null").select(F.col("contract_id").alias("a"), F.concat(F.lit("~"), "t").alias("b"))
    roots = components(links, by="b", name="p1")
    named = base.select("contract_id").distinct().join(roots.withColumnRenamed("node", "contract_id"), "contract_id", "left")
    return named.select("contract_id", contract_key(F.col("contract_id")).alias("key"), F.coalesce("root", "contract_id").alias("root"))


def deal(counts: dict[int, int], shares: dict[str, float]) -> dict[int, dict[str, int]]:
    """Largest-first greedy over {group size: number of groups}.

    Returns {size: {split: groups}} exactly as if each group in turn went to the split
    furthest below its target in rows (ties: the split named first)."""
    total = sum(s * c for s, c in counts.items())
    names = list(shares)
    gap = {n: shares[n] * total for n in names}
    out: dict[int, dict[str, int]] = {}
    for size in sorted((s for s in counts if s > 0), reverse=True):
        left = counts[size]
        # The greedy picks are the `left` largest terms of the falling series gap, gap - size, ...
        low, high = min(gap.values()) - size * (left + 1), max(gap.values())
        for _ in range(200):
            mid = (low + high) / 2
            taken = sum(max(0, int((gap[n] - mid) // size) + 1) if gap[n] >= mid else 0 for n in names)
            low, high = (mid, high) if taken > left else (low, mid)
        got = {n: (max(0, int((gap[n] - high) // size) + 1) if gap[n] >= high else 0) for n in names}
        while sum(got.values()) > left:
            n = min(names, key=lambda x: (gap[x] - size * (got[x] - 1), -names.index(x)) if got[x] else (float("inf"), 0))
            got[n] -= 1
        while sum(got.values()) < left:
            n = max(names, key=lambda x: (gap[x] - size * got[x], -names.index(x)))
            got[n] += 1
        for n in names:
            gap[n] -= size * got[n]
        out[size] = got
    return out


def assign(groups: DataFrame, shares: dict[str, float] = SHARES, seed: int = SEED) -> DataFrame:
    """(grp, rows, split) for `groups(grp, rows)`, one row a group with its row count.

    An empty table gives no rows; null grp is an ordinary group."""
    spark = groups.sparkSession
    groups = cut(groups.select("grp", "rows"), "p1-groups")
    histogram = {r["rows"]: r["n"] for r in groups.groupBy("rows").agg(F.count("*").alias("n")).collect()}
    bands = []
    for size, got in deal(histogram, shares).items():
        upto = 0
        for split, n in got.items():
            if n:
                bands.append((int(size), upto, upto + n, split))
                upto += n
    bands = spark.createDataFrame(bands, "rows long, lo long, hi long, split string")
    ranked = running(groups.withColumn("_d", lot(seed, "grp")), ["rows"], "_d", ["grp"])
    return ranked.join(bands, "rows").where("_upto > lo and _upto <= hi").select("grp", "rows", "split")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, row_id, contract_id, split): every delivered row once."""
    one = lambda t, k: read(spark, sf_dir, t).where(f"{k} is not null").select(
        F.lit(t).alias("tab"), F.col(k).alias("row_id"), "contract_id", "split", "loaded_at"
    )
    both = one("training_record", "rec_id").unionByName(one("heading_evidence", "evidence_id"))
    last = both.groupBy("tab", "row_id").agg(F.max(F.struct("loaded_at", "contract_id", "split")).alias("p"))
    return last.select("tab", "row_id", "p.contract_id", "p.split")


def _attached(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    contracts = cut(contract_groups(read(spark, sf_dir, "contract_pool")), "p1-roots")
    rows = _rows(spark, sf_dir).withColumn("key", contract_key(F.col("contract_id")))
    named = contracts.groupBy("key").agg(F.min("root").alias("root"))
    return rows.join(named, "key", "left"), contracts


def p1_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every training_record and heading_evidence row with its group and new split."""
    rows, _ = _attached(spark, sf_dir)
    grp = F.coalesce("root", F.concat(F.lit("key:"), "key"), F.concat("tab", F.lit(":"), "row_id"))
    rows = cut(rows.select("tab", "row_id", grp.alias("grp"), "split"), "p1-rows")
    given = assign(rows.groupBy("grp").agg(F.count("*").alias("rows")))
    return rows.join(given.select("grp", F.col("split").alias("new_split")), "grp").select("tab", "row_id", "grp", "new_split")


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and share that each split got."""
    out = p1_assign(spark, sf_dir).groupBy("new_split", "grp").agg(F.count("*").alias("n"))
    out = out.groupBy("new_split").agg(F.sum("n").alias("rows"), F.count("*").alias("groups"))
    total = out.agg(F.sum("rows").alias("t"))
    return out.crossJoin(F.broadcast(total)).select("new_split", "rows", "groups", F.round(F.col("rows") / F.col("t"), 6).alias("share"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contract_id of every contract (with its refilings) whose shipped splits disagree."""
    contracts = cut(contract_groups(read(spark, sf_dir, "contract_pool")), "p1-roots")
    seen = None
    for t in ("training_record", "heading_evidence"):
        part = read(spark, sf_dir, t).where("split is not null and contract_id is not null").select("contract_id", "split").distinct()
        seen = part if seen is None else seen.union(part)
    seen = seen.select(contract_key(F.col("contract_id")).alias("key"), "split").distinct()
    named = contracts.select("key", "root").distinct()
    torn = seen.join(named, "key").groupBy("root").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi")
    return contracts.join(torn, "root", "left_semi").select("contract_id")
