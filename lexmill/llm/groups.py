"""Distributed union-find: forests built inside partitions, merged level by level.

A level gives each partition its share of the links and replaces them by a forest
(node -> smallest node it is joined to there).  Nodes whose forests disagree leave links
between roots; only those links go to the next level, so what moves shrinks with every
level.  Links that do not shrink (long chains spread over partitions) are settled by
large-star / small-star passes, which keep every task bounded whatever the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lexmill.session import cut, partitions

PER_TASK = 400_000


def forest(pairs: Iterator[tuple]) -> dict:
    """node -> smallest node of its tree, for the links of one partition."""
    parent: dict = {}

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        a, b = find(a), find(b)
        if a != b:
            if b < a:
                a, b = b, a
            parent[b] = a
    return {x: find(x) for x in parent}


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    found = forest(p for pdf in batches for p in zip(pdf["a"].tolist(), pdf["b"].tolist()))
    if found:
        yield pd.DataFrame({"node": list(found.keys()), "root": list(found.values())})


def _shorten(links: DataFrame) -> DataFrame:
    """One large-star then one small-star pass; the same components, shorter chains."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.union(low.select("a", F.col("m").alias("b"))).distinct()


def _stars(links: DataFrame, name: str) -> DataFrame:
    """(node, root) by star passes until nothing changes: O(log^2) rounds for any graph, no
    task ever holding more than its share of links."""

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    links = cut(links, f"{name}-star")
    before = state(links)
    while True:
        links = cut(_shorten(links), f"{name}-star")
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())


def components(links: DataFrame, by: str | None = None, per_task: int = PER_TASK, name: str = "groups") -> DataFrame:
    """(node, root) for every node of `links(a, b)`; root is the component's smallest node.

    `by`: a column to place links by on the first level, when those sharing a value are
    known to belong together.  Null ends, links to oneself and repeated links are ignored;
    no links give no rows.  `per_task` bounds the links one task holds."""
    kind = links.schema["a"].dataType
    schema = StructType([StructField("node", kind), StructField("root", kind)])
    spark = links.sparkSession
    extra = [by] if by and by not in ("a", "b") else []
    links = links.where("a is not null and b is not null and a <> b").select("a", "b", *extra)
    links = cut(links, f"{name}-links")
    total = links.count()
    if not total:
        return spark.createDataFrame([], schema)
    tasks = partitions(spark, total, per_task) if total > per_task else 1
    placed = links.repartition(tasks, by or "a") if tasks > 1 else links.coalesce(1)
    trees = placed.select("a", "b").mapInPandas(_local, schema)
    if tasks == 1:
        return cut(trees, f"{name}-roots")
    trees = cut(trees, f"{name}-trees")
    lead = trees.groupBy("node").agg(F.min("root").alias("p"))
    lead = cut(lead, f"{name}-lead")
    rest = trees.join(lead, "node").where("root <> p").select(F.col("root").alias("a"), F.col("p").alias("b")).distinct()
    rest = cut(rest, f"{name}-rest")
    left = rest.count()
    if not left:
        return lead.select("node", F.col("p").alias("root"))
    stuck = left > 0.8 * total and left > per_task  # forests of single links: a long chain
    upper = _stars(rest, name) if stuck else components(rest, per_task=per_task, name=f"{name}+")
    up = upper.select(F.col("node").alias("p"), F.col("root").alias("r"))
    return cut(lead.join(up, "p", "left").select("node", F.coalesce("r", "p").alias("root")), f"{name}-roots")
