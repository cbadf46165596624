"""Exact seeded draws from very large groups without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def lot(seed: int, *columns: str) -> Column:
    """A 64-bit draw per row, the same on every run and every partitioning."""
    return F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in columns])


def running(df: DataFrame, groups: list[str], draw: str, ties: list[str], weight: str | Column | None = None) -> DataFrame:
    """`df` plus `_upto`: the weight of all rows up to and with this one, in the order of
    `draw` then `ties`, within each group.

    The rows are cut into buckets of the draw; bucket totals (at most BUCKETS a group) are
    summed in order and only rows of one bucket are ever sorted together, so a group that
    holds a third of all rows is spread over BUCKETS tasks."""
    weight = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    df = df.withColumn("_w", weight).withColumn("_b", F.shiftrightunsigned(F.col(draw), 52))
    totals = df.groupBy(*groups, "_b").agg(F.sum("_w").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*groups, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_w").over(Window.partitionBy(*groups, "_b").orderBy(draw, *ties).rowsBetween(Window.unboundedPreceding, 0))
    joined = df.withColumn("_in", inside).alias("d")
    t = totals.alias("t")
    cond = F.col("d._b") == F.col("t._b")
    for g in groups:
        cond = cond & F.col(f"d.{g}").eqNullSafe(F.col(f"t.{g}"))
    out = joined.join(t, cond)
    keep = [F.col(f"d.{c}") for c in df.columns if c not in ("_w", "_b")]
    return out.select(*keep, F.col("d._w").alias("_weight"), (F.col("t._before") + F.col("d._in")).alias("_upto"))
