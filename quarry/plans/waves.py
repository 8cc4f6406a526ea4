"""Model phases in waves (I1, I2, A7): what is to be asked is staged once, cut into waves by
the hash of the file, and each wave's attempts are appended and committed by themselves.

A run that dies keeps the attempts of its finished waves, and the next run finds only the
rest pending.  The staged table holds each text once, with all that is asked about it, so
waves read their own part and not the corpus again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.progress import phase_progress
from quarry.session import phase_path, remove_table


def wave_of(file: Column, waves: int) -> Column:
    """The wave (from 0) of all that is asked about a file: the same in every run that has
    as many waves."""
    head = F.conv(F.substring(F.md5(file.cast("binary")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(waves)).cast("int")


class Staged:
    """Rows of a phase that are to be asked, on shared storage, by wave."""

    def __init__(self, rows: DataFrame, file: str, waves: int, name: str):
        self.spark, self.waves = rows.sparkSession, waves
        self.path = phase_path(self.spark, name)
        rows = rows.withColumn("wave", wave_of(F.col(file), waves))
        self.schema = rows.schema
        rows.write.partitionBy("wave").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def wave(self, number: int) -> DataFrame:
        return self.rows().where(F.col("wave") == number).drop("wave")

    def used(self) -> list[int]:
        """The waves that have rows (at most ``waves`` numbers)."""
        return sorted(r["wave"] for r in self.rows().select("wave").distinct().collect())

    def remove(self) -> None:
        remove_table(self.spark, self.path)


def run_waves(staged: Staged, ask: Callable[[DataFrame], DataFrame],
              append: Callable[[DataFrame, int], None],
              after: Callable[[int], None] | None = None) -> None:
    """Ask each wave and append its attempts; ``after`` is called when they are stored.  The
    staged rows go at the end, also when a wave fails."""
    try:
        for number in staged.used():
            append(ask(staged.wave(number)), number)
            if after:
                after(number)
    finally:
        staged.remove()


def new_run() -> str:
    return uuid.uuid4().hex


def wave_attempts(store: DataFrame) -> DataFrame:
    """Attempts per run and wave: how many, with which outcome, of how many files, and the
    first and last time at which an answer was there."""
    status = F.col("status")
    return store.groupBy("run", "wave").agg(
        F.count("*").alias("attempts"), F.count_if(status == "ok").alias("ok"),
        F.count_if(status == "error").alias("errors"),
        F.count_if(status == "timeout").alias("timeouts"),
        F.count_distinct("file").alias("files"),
        F.min("attempted_at").alias("first_at"), F.max("attempted_at").alias("last_at"))


def run_progress(store: DataFrame, plan: DataFrame, run: str, as_of_us: int | DataFrame,
                 group: str = "scanner") -> DataFrame:
    """D22 over the stored attempts of a run: per ``group`` of ``plan`` (grp, total) what is
    done, the rate since the first answer and the time that is left."""
    done = store.where(F.col("run") == run).select(F.col(group).alias("grp"),
                                                   F.col("attempted_at").alias("ts"))
    return phase_progress(done, plan, as_of_us)
