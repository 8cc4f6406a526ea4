"""Run progress (D19, D22, H14, J5) as aggregates over attempts and the work plan.

``attempts`` holds one row per finished item ``(grp, ts)``; ``plan`` holds
the planned totals per group.  Progress at ``as_of`` is a single grouped
aggregation: completed count, first completion, cumulative rate per hour
and the remaining-time estimate; the overall ETA sums the groups' ETAs and
is a lower bound when some group has remaining work but no rate yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import format_eta


def _us(ts: Column) -> Column:
    """Microseconds since the epoch without any session time-zone involvement:
    local (NTZ) timestamps are measured as wall-clock differences."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def _progress(attempts_us: DataFrame, plan: DataFrame) -> DataFrame:
    """Core of D22: ``attempts_us (grp, us, as_of_us)`` and ``plan (grp, total, as_of_us)``."""
    a = attempts_us.where(F.col("us") <= F.col("as_of_us"))
    done = a.groupBy("grp").agg(F.count(F.lit(1)).alias("completed"),
                                F.min("us").alias("started_us"))
    j = plan.join(done, "grp", "left").withColumn(
        "completed", F.coalesce("completed", F.lit(0).cast("bigint")))
    secs = F.greatest((F.col("as_of_us") - F.col("started_us")) / F.lit(1e6), F.lit(1e-6))
    rate = F.when(F.col("completed") > 0, F.col("completed") / secs).otherwise(F.lit(0.0))
    remaining = F.greatest(F.col("total") - F.col("completed"), F.lit(0))
    eta = F.when(rate > 0, remaining / rate)
    return j.select("grp", "total", "completed",
                    F.round(rate * 3600, 4).alias("per_h"),
                    F.floor(eta).cast("bigint").alias("eta_s"),
                    F.when(remaining == 0, F.lit("done")).otherwise(format_eta(eta)).alias("eta"))


def phase_progress(attempts: DataFrame, plan: DataFrame, as_of_us: int | DataFrame) -> DataFrame:
    """Per group at a snapshot: total, completed (ts <= as_of), per_h, eta_s, eta.

    ``attempts`` is ``(grp, ts)``; ``plan`` is ``(grp, total)``; the time is a number of
    microseconds or one row ``as_of_us``.  An attempt without a time is not yet complete.
    """
    def at(rows: DataFrame) -> DataFrame:
        if isinstance(as_of_us, int):
            return rows.withColumn("as_of_us", F.lit(as_of_us).cast("bigint"))
        one = F.broadcast(as_of_us.select("as_of_us", F.lit(1).alias("_k")))
        return rows.withColumn("_k", F.lit(1)).join(one, "_k").drop("_k")
    return _progress(at(attempts.select("grp", _us(F.col("ts")).alias("us"))),
                     at(plan.select("grp", "total")))


def midpoint(times: DataFrame, ts: str = "ts") -> DataFrame:
    """One row ``as_of_us``, half-way between the first and the last time."""
    us = _us(F.col(ts))
    return times.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).select(
        (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("bigint").alias("as_of_us"))


def overall_eta(progress: DataFrame) -> DataFrame:
    """Sum of group ETAs; '>=' marks a lower bound, '?' nothing bounded."""
    remaining = F.col("total") - F.col("completed")
    agg = progress.agg(
        F.sum(F.when(remaining > 0, F.col("eta_s"))).alias("eta_s"),
        F.bool_or((remaining > 0) & F.col("eta_s").isNull()).alias("lower_bound"),
        F.bool_or(remaining > 0).alias("any_work"))
    text = (F.when(~F.col("any_work"), F.lit("done"))
            .when(F.col("eta_s").isNull(), F.lit("?"))
            .otherwise(F.concat(F.when(F.col("lower_bound"), F.lit("≥")).otherwise(F.lit("")),
                                format_eta(F.col("eta_s")))))
    return agg.select(F.col("eta_s").cast("bigint").alias("eta_s"), "lower_bound",
                      text.alias("eta"))


def events_progress(events: DataFrame) -> DataFrame:
    """The ``events`` table as a phase log: event_type = group, ts = completion time.

    The snapshot is taken half-way between the first and the last event; the
    one-row snapshot time is joined on a constant key (no cross product).
    """
    us = _us(F.col("ts"))
    as_of = events.agg(F.min(us).alias("lo"), F.max(us).alias("hi")).select(
        (F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2)).cast("bigint")
        .alias("as_of_us")).withColumn("_k", F.lit(1))
    snap = F.broadcast(as_of)
    attempts = (events.select(F.col("event_type").alias("grp"), us.alias("us"))
                .withColumn("_k", F.lit(1)).join(snap, "_k").drop("_k"))
    plan = (events.groupBy(F.col("event_type").alias("grp"))
            .agg(F.count(F.lit(1)).alias("total"))
            .withColumn("_k", F.lit(1)).join(snap, "_k").drop("_k"))
    return _progress(attempts, plan)
