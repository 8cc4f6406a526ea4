"""Telling rows of a table apart by what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_order(row: str) -> Column:
    """An order of rows (a struct column) of equal texts by what else they hold, the same in
    every run."""
    return F.xxhash64(F.col(row)["text"].isNull(), F.to_json(F.col(row).dropFields("text")))


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, xxhash64 of text) is in ``kept`` (doc_id, th),
    one of each such pair, the same in every run; columns as they are.  The pair is the key of one shuffle, so
    no row number has to stay the same from one scan to the next."""
    cols = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_doc"),
                        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    k = kept.select(F.col("doc_id").alias("_kid"), F.col("th").alias("_kth")).distinct()
    met = whole.join(k, whole["_id"].eqNullSafe(k["_kid"]) & (whole["_th"] == k["_kth"]),
                     "left_semi")
    first = Window.partitionBy("_id", "_th").orderBy(stable_order("_doc"))
    return met.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("_doc.*")
