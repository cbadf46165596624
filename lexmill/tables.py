"""Loaders for the driver tables; `latest` keeps one delivery of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, keys: Sequence[str], columns: Sequence[str], by: str = "loaded_at") -> DataFrame:
    """One row per key: the values of the last delivery (null `by` counts as earliest).

    An aggregate with map-side combine, so a key delivered any number of times
    never gathers in one task."""
    picked = F.max(F.struct(F.col(by).alias("_by"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(columns)]))
    out = df.groupBy(*keys).agg(picked.alias("_p"))
    return out.select(*keys, *[F.col(f"_p._{i}").alias(c) for i, c in enumerate(columns)])
