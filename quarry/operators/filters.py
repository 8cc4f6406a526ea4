"""Corpus filters (B1-B7) and skip accounting.

All checks are one projection (no shuffle).  Cheap metadata checks run
before the content check, and ``skip_reason`` records the first that fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.registry import DEFAULT_MAX_FILE_SIZE


def label_corpus(corpus: DataFrame, max_file_size: int = DEFAULT_MAX_FILE_SIZE) -> DataFrame:
    """Add ``skip_reason`` (NULL when the file is kept)."""
    return corpus.withColumn(
        "skip_reason", P.skip_reason("path", "ext", "size", "text", max_file_size))


def kept_files(corpus: DataFrame, max_file_size: int = DEFAULT_MAX_FILE_SIZE) -> DataFrame:
    return label_corpus(corpus, max_file_size).where(F.col("skip_reason").isNull()) \
        .drop("skip_reason")


def observed_files(corpus: DataFrame, max_file_size: int = DEFAULT_MAX_FILE_SIZE
                   ) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The kept files, and what tells how many files each check left out (and how many are
    kept): counted by the first action that reads the kept files, without a pass of its own.
    Call it only after such an action."""
    seen = Observation()
    reason = F.col("skip_reason")
    counts = [F.count_if(reason.isNull()).alias("kept"),
              *[F.count_if(reason == r).alias(r) for r in P.SKIP_REASONS]]
    labelled = label_corpus(corpus, max_file_size).observe(seen, *counts)

    def counted() -> dict[str, int]:
        return {k: n for k, n in seen.get.items() if n}
    return labelled.where(reason.isNull()).drop("skip_reason"), counted


def skip_counts(corpus: DataFrame, max_file_size: int = DEFAULT_MAX_FILE_SIZE) -> DataFrame:
    """Files per skip reason ('kept' for files that pass); map-side partial counts."""
    labelled = label_corpus(corpus, max_file_size)
    return (labelled.select(F.coalesce("skip_reason", F.lit("kept")).alias("skip_reason"))
            .groupBy("skip_reason").agg(F.count(F.lit(1)).alias("files")))
