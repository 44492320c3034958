"""Labelled samples, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out() -> Column:
    """Is crc32 of the id's text 1 modulo 3? Rows without an id are not held out (nor ever labelled)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> DataFrame:
    """``doc_id, text, y``: at most ``per_class`` documents of each label, first by hash of the id, without those
    of over ``most_bytes``; empty where nothing is labelled.

    Only labels 0 and 1 of rows that are not held out count; a document labelled twice takes the larger, and of
    rows that repeat an id the smallest text counts. The bounds on the sample are the bound on what is
    broadcast and later collected.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = None
    for y in (0, 1):
        some = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionAll(some)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
