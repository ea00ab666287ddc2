"""Bounded samples of labelled rows, for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, text, quality, toxic of up to `most` labelled documents, those of least hash of doc_id.

    Rows with a null doc_id or without any label drop out; of several labels of a
    document the worst counts; of several texts of a doc_id the least is taken.
    """
    one = (
        labels.where("doc_id IS NOT NULL").groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
        .where("quality IS NOT NULL OR toxic IS NOT NULL").na.fill({"quality": 1, "toxic": 0})
    )
    known = docs.select("doc_id").join(one, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows by construction, before and, by the grouping, after the join
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
