"""Report sections (D4-D16, D21, D23, D25, E1, A12, A13, G3, H13) as DataFrames.

Inputs are the finding-grain ``bucketed`` table and the file-grain table
from ``quarry.plans.triage``; every section is a projection or one
aggregation of them (each aggregation is map-side partial + final).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry import registry as R
from quarry.functions import verdicts as V

def _above():
    return F.col("above_line")


def _known_sev():
    return F.col("severity").isin(*R.SEVERITIES)


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Combine two single-row aggregates side by side (equi-join on a constant key)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _sev_counts(pred=None) -> list:
    base = _above() & _known_sev() if pred is None else _above() & _known_sev() & pred
    return [F.count_if(base & (F.col("severity") == s)).alias(s) for s in R.SEVERITIES]


def severity_by_scanner(b: DataFrame) -> DataFrame:
    """Raw severity counts per category (above-line findings, known severities)."""
    return b.groupBy("scanner").agg(*_sev_counts())


def severity_rollup(b: DataFrame) -> DataFrame:
    """One pass gives per-category, per-severity, per-category totals and the grand total."""
    return (b.where(_above() & _known_sev()).rollup("scanner", "severity")
            .agg(F.count(F.lit(1)).alias("n")))


def confidence_counts(b: DataFrame) -> DataFrame:
    """Confidence levels of above-line findings per category."""
    return b.groupBy("scanner").agg(*[
        F.count_if(_above() & (F.col("conf_level") == c)).alias(c) for c in R.CONFIDENCE_LEVELS])


def bucket_counts(b: DataFrame) -> DataFrame:
    """Refutation buckets of the non-suppressed findings."""
    return (b.where(F.col("status") != "suppressed").groupBy("scanner", "bucket")
            .agg(F.count(F.lit(1)).alias("n")))


def file_status_counts(files: DataFrame) -> DataFrame:
    """Files scanned / clean / with findings / errors / unparseable per category."""
    err = F.col("status").isin("error", "timeout")
    return files.groupBy("scanner").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(~err & (F.col("n_items") == 0)).alias("clean"),
        F.count_if(~err & (F.col("n_items") > 0)).alias("with_findings"),
        F.count_if(err).alias("errors"),
        F.count_if(~err & ~F.col("is_list")).alias("parse_errors"))


def unsubstantiated_counts(b: DataFrame) -> DataFrame:
    """Live findings with no named source."""
    return b.groupBy("scanner").agg(F.count_if("unsubstantiated").alias("unsubstantiated"))


def gated_severity(b: DataFrame) -> DataFrame:
    """Severity counts at/above the confidence gate, and the needs-review count."""
    active = F.col("status") == "active"
    return b.groupBy("scanner").agg(
        *[F.count_if(active & _known_sev() & (F.col("severity") == s)).alias(s)
          for s in R.SEVERITIES],
        F.count_if(F.col("status") == "needs_review").alias("needs_review"))


def fail_on_gate(b: DataFrame, threshold: str) -> DataFrame:
    """Findings at or above a severity threshold ('never' -> 0)."""
    cap = threshold.capitalize()
    rank = 99 if cap == "Never" else R.SEVERITY_ORDER.get(cap, 0)
    return b.agg(F.lit(threshold).alias("threshold"),
                 F.count_if(_above() & _known_sev() & (F.col("sev_rank") >= rank)).alias("triggered"))


def verification_coverage(b: DataFrame) -> DataFrame:
    """Verified / active (above-line) findings per category."""
    return b.groupBy("scanner").agg(
        F.count_if(_above() & (F.col("conf_level") != "Unverified")).alias("verified"),
        F.count_if(_above()).alias("active"))


def vulnerable_files(b: DataFrame) -> DataFrame:
    """Above-line findings per file, cross-tabbed by confidence level."""
    return (b.where(_above()).groupBy("scanner", "file")
            .agg(F.count(F.lit(1)).alias("n"),
                 *[F.count_if(F.col("conf_level") == c).alias(c) for c in R.CONFIDENCE_LEVELS]))


def top_vulnerable_files(b: DataFrame, k: int = 20) -> DataFrame:
    """Top-k vulnerable files per category by count (ties by path)."""
    w = Window.partitionBy("scanner").orderBy(F.desc("n"), F.asc("file"))
    return (vulnerable_files(b).withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k))


def _heat_counts(b: DataFrame, gated: bool) -> DataFrame:
    pred = (F.col("status") == "active") if gated else F.lit(True)
    return b.agg(*_sev_counts(pred))


def risk_heatmap(b: DataFrame, gated: bool = True) -> DataFrame:
    """One row per severity with count and risk level (gated = above the confidence gate)."""
    c = _heat_counts(b, gated)
    stacked = c.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("severity"), F.lit(R.SEVERITY_ORDER[s]).alias("sev_rank"),
                 F.col(s).alias("n")) for s in R.SEVERITIES])).alias("r")).select("r.*")
    level = (F.when(F.col("severity") == "Low",
                    F.when(F.col("n") == 0, "LOW").otherwise("Review"))
             .when(F.col("n") > 0, F.upper("severity")).otherwise("Clear"))
    return stacked.withColumn("risk_level", level)


def overall_risk(b: DataFrame, files: DataFrame, gated: bool = True) -> DataFrame:
    """CRITICAL / HIGH / MEDIUM / INCONCLUSIVE (errors or nothing scanned) / LOW."""
    c = _heat_counts(b, gated)
    f = files.agg(F.count_if(F.col("status").isin("error", "timeout")).alias("errors"),
                  F.count(F.lit(1)).alias("scanned"))
    j = one_row_join(c, f)
    overall = (F.when(F.col("Critical") > 0, "CRITICAL").when(F.col("High") > 0, "HIGH")
               .when(F.col("Medium") > 0, "MEDIUM")
               .when((F.col("errors") > 0) | (F.col("scanned") == 0), "INCONCLUSIVE")
               .otherwise("LOW"))
    return j.select(overall.alias("overall"), "errors", "scanned")


def status_counts(rows: DataFrame) -> DataFrame:
    """Report rows per status."""
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def finding_rows(b: DataFrame, labels: DataFrame) -> DataFrame:
    """The 17 report columns for finding rows (CSV field rules)."""
    has = F.col("has_verdict")
    blank = F.lit("")
    return b.join(F.broadcast(labels), "scanner").select(
        "scanner", "scanner_label", "file",
        F.coalesce("line_raw", blank).alias("line"),
        F.coalesce("severity", blank).alias("severity"),
        F.coalesce("code", blank).alias("code"),
        F.coalesce("explanation", blank).alias("explanation"),
        F.coalesce("fix", blank).alias("fix"),
        F.coalesce("source", blank).alias("source"),
        F.coalesce("sink", blank).alias("sink"),
        F.array_join("tags", ",").alias("tags"),
        F.when(F.col("conf") == "Unverified", blank).otherwise(F.col("conf")).alias("confidence"),
        F.when(has, F.coalesce("exploitable", blank)).otherwise(blank).alias("exploitable"),
        F.when(has, F.coalesce("verification_reason", blank)).otherwise(blank)
         .alias("verification_reason"),
        F.when(has, F.coalesce("verdict", blank)).otherwise(blank).alias("verdict"),
        "status",
        F.when(F.col("status") == "suppressed", F.coalesce("suppression_reason", blank))
         .otherwise(blank).alias("suppression_reason"))


def error_rows(files: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per failed (category, file) with blank finding columns."""
    blank = F.lit("")
    cols = {c: blank for c in R.REPORT_COLUMNS}
    cols.update({"scanner": F.col("scanner"), "scanner_label": F.col("scanner_label"),
                 "file": F.col("file"), "status": F.col("status")})
    return (files.where(F.col("status").isin("error", "timeout"))
            .join(F.broadcast(labels), "scanner")
            .select(*[cols[c].alias(c) for c in R.REPORT_COLUMNS]))


def report_rows(b: DataFrame, files: DataFrame, spark: SparkSession,
                labels: DataFrame | None = None) -> DataFrame:
    """One row per finding or failed file, fixed column order.  ``labels`` are those of
    a registry, by default the built-in one's."""
    labels = labels if labels is not None else spark.createDataFrame([(s.id, s.label) for s in R.scanners()],
                                   "scanner string, scanner_label string")
    return finding_rows(b, labels).unionByName(error_rows(files, labels))


def write_report(rows: DataFrame, path: str, fmt: str = "csv") -> None:
    """CSV/TSV sink with RFC-4180 quoting (quotes doubled, newlines kept in quotes)."""
    sep = "\t" if fmt == "tsv" else ","
    (rows.select(*R.REPORT_COLUMNS).write.mode("overwrite")
     .option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
     .option("quoteAll", False).csv(path))


def run_stats(b: DataFrame, files: DataFrame) -> DataFrame:
    """``(metric, value)`` counts used by the gate."""
    fb = b.agg(
        *[F.count_if(_above() & (F.col("severity") == s)).alias(f"severity_{s}")
          for s in R.SEVERITIES],
        *[F.count_if((F.col("status") == "active") & (F.col("severity") == s))
          .alias(f"gated_{s}") for s in R.SEVERITIES],
        F.count_if(F.col("status") == "suppressed").alias("suppressed"),
        F.count_if(F.col("status") == "refuted").alias("refuted"),
        F.count_if(F.col("status") == "not_actionable").alias("not_actionable"),
        F.count_if(F.col("status") == "needs_review").alias("needs_review"),
        F.count_if(_above() & (F.col("bucket") == "confirmed")).alias("confirmed"),
        F.count_if("unsubstantiated").alias("unsubstantiated"),
        F.count_if(_above() & (F.col("conf_level") != "Unverified")).alias("verified"),
        F.count_if(_above() & (F.col("conf_level") == "Unverified")).alias("unverified"),
        F.count_if(_above() & ~_known_sev()).alias("unknown_severity"))
    ff = files.agg(F.count(F.lit(1)).alias("scanned"),
                   F.count_if(F.col("status").isin("error", "timeout")).alias("errors"))
    both = one_row_join(fb, ff)
    names = [c for c in both.columns]
    return both.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("bigint").alias("value"))
        for n in names])).alias("m")).select("m.*")


def ci_gate(b: DataFrame, files: DataFrame, fail_on: str = "high",
            fail_on_confidence: str = "never") -> DataFrame:
    """Exit code -- raw severity gate (1), confidence gate (3), errors (1), else 0.

    The confidence gate counts the active findings of a known severity whose confidence
    reaches the level ``fail_on_confidence``; ``never`` switches it off."""
    cap = fail_on.capitalize()
    rank = None if cap == "Never" else R.SEVERITY_ORDER.get(cap, 0)
    raw = (F.count_if(_above() & _known_sev() & (F.col("sev_rank") >= rank)) if rank is not None
           else F.lit(0).cast("bigint"))
    level = fail_on_confidence.capitalize()
    ranks = F.create_map(*[x for k, v in R.CONFIDENCE_ORDER.items() for x in (F.lit(k), F.lit(v))])
    sure = F.coalesce(F.try_element_at(ranks, F.col("conf")), F.lit(0)) >= R.CONFIDENCE_ORDER.get(level, 0)
    gated = F.lit(0).cast("bigint") if level == "Never" else F.count_if(
        F.col("status").isin("active", "needs_review") & sure & _known_sev())
    fb = b.agg(raw.alias("raw_triggered"), gated.alias("confidence_triggered"))
    ff = files.agg(F.count_if(F.col("status").isin("error", "timeout")).alias("errors"))
    j = one_row_join(fb, ff)
    code = (F.when(F.col("raw_triggered") > 0, 1).when(F.col("confidence_triggered") > 0, 3)
            .when(F.col("errors") > 0, 1).otherwise(0))
    reason = (F.when(F.col("raw_triggered") > 0, F.lit("severity"))
              .when(F.col("confidence_triggered") > 0, F.lit("confidence"))
              .when(F.col("errors") > 0, F.lit("errors")).otherwise(F.lit("pass")))
    return j.select(code.alias("exit_code"), reason.alias("reason"), "raw_triggered",
                    "confidence_triggered", "errors")


def file_labels(files: DataFrame) -> DataFrame:
    """ERROR / VULN (above-line left) / REFUTED (all below the line) /
    SUPPRESSED (all allowlisted) / CLEAN per stored file."""
    err = F.col("status").isin("error", "timeout")
    label = (F.when(err, "ERROR").when(F.col("n_above") > 0, "VULN")
             .when(F.col("n_below") > 0, "REFUTED").when(F.col("n_suppressed") > 0, "SUPPRESSED")
             .otherwise("CLEAN"))
    return files.select("scanner", "file", label.alias("label"), "n_findings", "n_above")


def extensions_scanned(spark: SparkSession, scanned: DataFrame,
                       discovery: DataFrame | None = None) -> DataFrame:
    """The extension list per category (discovery order, else registry order),
    with the number of files that category scanned."""
    if discovery is None:
        rows = [(s.id, p, e) for s in R.scanners() for p, e in enumerate(s.base_ext)]
        discovery = spark.createDataFrame(rows, "scanner string, pos int, ext string")
    lists = (discovery.groupBy("scanner")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ext"))),
                                           lambda s: s["ext"]), ", ").alias("extensions")))
    counts = scanned.groupBy("scanner").agg(F.count(F.lit(1)).alias("files"))
    return lists.join(counts, "scanner", "left").select(
        "scanner", "extensions", F.coalesce("files", F.lit(0).cast("bigint")).alias("files"))


def listing(b: DataFrame, status: str) -> DataFrame:
    """The findings of one status with their evidence columns."""
    return b.where(F.col("status") == status).select(
        "scanner", "file", "ord", "line", "severity", "conf", "verdict", "exploitable",
        "verification_reason", "suppression_reason")


def refuted_for_export(b: DataFrame) -> DataFrame:
    """Refuted findings in report order, ready for candidate export."""
    order_key = F.concat_ws("\u0001", F.lpad(V.rank_of("scanner", {
        s.id: s.ord for s in R.scanners()}).cast("string"), 3, "0"), F.col("file"),
        F.lpad(F.col("ord").cast("string"), 9, "0"))
    return b.where(F.col("status") == "refuted").select(
        "scanner", "file", "line", "verification_reason", order_key.alias("order_key"))


def finding_details(b: DataFrame) -> DataFrame:
    """Per above-line finding its 1-based index within the file, taint path
    ('source → sink' when either is named) and verification mark."""
    w = Window.partitionBy("scanner", "file").orderBy("ord")
    src = F.coalesce(F.col("source"), F.lit(""))
    snk = F.coalesce(F.col("sink"), F.lit(""))
    path = F.when((src != "") | (snk != ""), F.concat(src, F.lit(R.TAINT_ARROW), snk))
    mark = F.lit(R.UNKNOWN_MARK)
    for level, glyph in reversed(list(R.CONFIDENCE_MARKS.items())):
        mark = F.when(F.col("conf_level") == level, F.lit(glyph)).otherwise(mark)
    return b.where(_above()).select(
        "scanner", "file", F.row_number().over(w).cast("bigint").alias("idx"), "line",
        F.coalesce("severity", F.lit("Unknown")).alias("severity"),
        path.alias("taint_path"), F.col("unsubstantiated").alias("unsubstantiated"),
        F.col("conf_level").alias("confidence"),
        F.when(F.col("has_verdict"), F.coalesce("exploitable", F.lit("unknown")))
         .otherwise(F.lit("unknown")).alias("exploitable"),
        mark.alias("mark"))
