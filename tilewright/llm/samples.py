"""Bounded, documented samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(modulus: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled_ids(labels: DataFrame, column: str, modulus: int, held_out: int, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, y) of at most per_class documents of each class, lowest hash first, and the counts of all labelled training documents by class.

    Rows whose remainder is held_out are never looked at; rows with a null id or label are no labels; for repeated ids the higher label counts.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).where(remainder(modulus) != held_out)
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picks = [rows.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    return picks[0].unionByName(picks[1]), counts


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, text, y of the sample; its ids are few (a documented bound), so they are broadcast. Of rows with the same id the one of the least text is taken."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
