"""The bucketed triage table: one row per finding with verdict, suppression,
bucket and row status, plus the file-grain table.  Every report section is
a projection or roll-up of these two DataFrames (cache them once).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import registry as R
from quarry.functions import verdicts as V
from quarry.operators.findings import explode_findings, with_findings
from quarry.operators.overlay import overlay, with_verify_keys
from quarry.operators.suppress import first_match


def normalised_results(results: DataFrame, verify_prompt_hash: str,
                       thinking: str = "off") -> DataFrame:
    """Store rows with ordered normalised findings, signature and verify key."""
    return with_verify_keys(with_findings(results), verify_prompt_hash, thinking)


def bucketed(results_n: DataFrame, verdict_lines: DataFrame | None, allowlist: DataFrame | None,
             confidence_threshold: str | None = None,
             scanners: list[str] | None = None) -> DataFrame:
    """Finding grain.  ``status`` is suppressed > refuted > not_actionable >
    needs_review (below the confidence gate) > active."""
    f = explode_findings(results_n.withColumn("result_status", F.col("status")))
    if verdict_lines is not None:
        f = overlay(f, verdict_lines)
    else:
        f = f.select("*", *[F.lit(None).cast("string").alias(c) for c in
                            ("confidence", "exploitable", "verification_reason", "verdict")],
                     F.lit(False).alias("has_verdict"))
    if allowlist is not None:
        f = first_match(f, allowlist, scanners=scanners)
    else:
        f = (f.withColumn("suppression_pos", F.lit(None).cast("int"))
             .withColumn("suppression_reason", F.lit(None).cast("string")))
    cutoff = V.threshold_rank(confidence_threshold, R.CONFIDENCE_ORDER)
    conf = V.effective_confidence("has_verdict", "confidence")
    bucket = V.verdict_bucket("has_verdict", "verdict", "confidence", "exploitable")
    below = F.lit(False) if cutoff is None else (V.confidence_rank(conf) < F.lit(cutoff))
    suppressed = F.col("suppression_pos").isNotNull()
    status = (F.when(suppressed, "suppressed").when(bucket == "refuted", "refuted")
              .when(bucket == "not_actionable", "not_actionable")
              .when(below, "needs_review").otherwise("active"))
    return (f.withColumn("bucket", bucket)
            .withColumn("conf", conf)
            .withColumn("conf_level", V.confidence_level(conf))
            .withColumn("sev_rank", V.severity_rank("severity"))
            .withColumn("status", status)
            .withColumn("above_line", F.col("status").isin("active", "needs_review"))
            .withColumn("unsubstantiated",
                        ~suppressed & (bucket != "refuted")
                        & F.array_contains("tags", R.UNSUBSTANTIATED_TAG)))


def file_grain(results_n: DataFrame, bucketed_df: DataFrame) -> DataFrame:
    """One row per stored (category, file): status, finding totals, above-line totals.

    A stored row either has findings -- then its counts come from one
    aggregation of the (small) finding table -- or it has none and its counts
    are zeros computed map-side.  The two parts are unioned, so the full
    store is never shuffled or joined.
    """
    zero = F.lit(0).cast("bigint")
    with_f = (bucketed_df.groupBy("cache_key", "scanner", "file", "result_status")
              .agg(F.count(F.lit(1)).alias("n_findings"),
                   F.count_if("above_line").alias("n_above"),
                   F.count_if(F.col("status") == "suppressed").alias("n_suppressed"),
                   F.count_if(F.col("status").isin("refuted", "not_actionable"))
                    .alias("n_below"))
              .select("cache_key", "scanner", "file", F.col("result_status").alias("status"),
                      F.lit(True).alias("is_list"), F.col("n_findings").alias("n_items"),
                      "n_findings", "n_above", "n_suppressed", "n_below"))
    failed = F.col("status").isin("error", "timeout")
    without = (results_n.where(failed | (F.size("findings") == 0))
               .select("cache_key", "scanner", "file", "status", "is_list",
                       F.when(failed, F.size("findings")).otherwise(zero).cast("bigint")
                       .alias("n_items"),
                       zero.alias("n_findings"), zero.alias("n_above"),
                       zero.alias("n_suppressed"), zero.alias("n_below")))
    return with_f.unionByName(without)
