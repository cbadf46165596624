"""Deduplicated views of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.tables import latest, read


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row a document with text; `columns` beside doc_id."""
    rows = read(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    return latest(rows, ["doc_id"], columns or ["text"])


def records(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = read(spark, sf_dir, "training_record").where("rec_id is not null")
    return latest(rows, ["rec_id"], columns)


def evidence(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    rows = read(spark, sf_dir, "heading_evidence").where("evidence_id is not null")
    return latest(rows, ["evidence_id"], columns)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "qrels").where("grade is not null")
    return rows.groupBy("query_id", "doc_id").agg(F.max("grade").alias("grade"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a chunk; rows that differ under one id are ordered by their values."""
    rows = read(spark, sf_dir, "chunk").where("chunk_id is not null")
    rest = [c for c in rows.columns if c != "chunk_id"]
    first = F.min_by(F.struct(*rest), F.struct("text", "doc_id", "page")).alias("c")
    return rows.groupBy("chunk_id").agg(first).select("chunk_id", *[f"c.{c}" for c in rest])
