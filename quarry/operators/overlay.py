"""Verdict overlay.

Verdicts are keyed per file by ``verify_key`` -- category, path, content
hash, findings signature, verify-prompt hash and thinking -- so a changed
finding (or file, or prompt) invalidates the whole file's verdicts, and
then by integer line.  The overlay is an equi-join on (verify_key, line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import keys as K
from quarry.functions import paths as P
from quarry.operators.findings import result_items


def with_verify_keys(results_with_findings: DataFrame, verify_prompt_hash: str | Column,
                     thinking: str = "off") -> DataFrame:
    """Add ``findings_sig`` and ``verify_key`` to normalised store rows (map-side)."""
    vph = F.lit(verify_prompt_hash) if isinstance(verify_prompt_hash, str) else verify_prompt_hash
    return (results_with_findings
            .withColumn("findings_sig", K.findings_signature("findings"))
            .withColumn("verify_key", K.verify_key("scanner_name", "file", "content_hash",
                                                    "findings_sig", vph, F.lit(thinking))))


def verify_eligible(keyed_results: DataFrame, corpus: DataFrame | None = None,
                    max_file_size: int | None = None) -> DataFrame:
    """Ok results with >=1 object finding, path not excluded, source still
    present (and not oversized)."""
    el = keyed_results.where(~F.col("status").isin("error", "timeout")
                             & F.col("file").isNotNull()
                             & ~P.excluded_path(F.col("file"))
                             & (F.size("findings") > 0))
    if corpus is not None:
        present = corpus.select(F.col("path").alias("file"), "size")
        if max_file_size:
            present = present.where(F.col("size") <= max_file_size)
        el = el.join(present.select("file"), "file", "left_semi")
    return el


def pending_verifications(eligible: DataFrame, verdict_store: DataFrame | None,
                          reverify: bool = False) -> DataFrame:
    """Eligible files without a successful verdict for their current verify key."""
    if reverify or verdict_store is None:
        return eligible
    ok = verdict_store.where(F.col("status") == "ok").select("verify_key")
    return eligible.join(ok, "verify_key", "left_anti")


def verify_plan(eligible: DataFrame, verdict_store: DataFrame | None) -> DataFrame:
    """D19/D24 for phase 3: eligible / already verified / pending files per category."""
    if verdict_store is None:
        flagged = eligible.withColumn("hit", F.lit(False))
    else:
        ok = verdict_store.where(F.col("status") == "ok").select("verify_key").distinct() \
            .withColumn("hit", F.lit(True))
        flagged = eligible.join(ok, "verify_key", "left")
    hit = F.coalesce(F.col("hit"), F.lit(False))
    return flagged.groupBy("scanner").agg(F.count(F.lit(1)).alias("eligible"),
                                          F.count_if(hit).alias("verified"),
                                          F.count_if(~hit).alias("pending"))


VERDICT_FIELDS = ["confidence", "exploitable", "verification_reason", "verdict"]


def verdict_lines_from_replies(verdict_store: DataFrame) -> DataFrame:
    """E5: verifier replies -> one verdict per (verify_key, line), last entry wins.

    A reply row holds all verdicts of one file, so "last entry per line wins"
    is resolved inside the row (no shuffle); the store keeps one reply per
    verify key (its latest attempt).  Entries without an integer line are
    skipped; missing fields take the reply defaults (confidence 'Unknown',
    exploitable 'unknown', blanks).
    """
    items = result_items(F.col("result"))

    def field(e, name, default):
        # a missing field takes the reply default; an explicit JSON null stays NULL
        present = F.try_variant_get(e, f"$.{name}", "variant").isNotNull()
        return F.when(present, F.try_variant_get(e, f"$.{name}", "string")) \
            .otherwise(F.lit(default)).alias(name)

    def rec(e):
        return F.struct(
            F.try_variant_get(e, "$.line", "bigint").alias("line"),
            field(e, "confidence", "Unknown"), field(e, "exploitable", "unknown"),
            field(e, "verification_reason", ""), field(e, "verdict", ""))
    recs = F.filter(F.transform(items, lambda e, i: rec(e).withField("pos", i)),
                    lambda r: r["line"].isNotNull())
    # sort by (line, position) and keep the last entry of each line: O(n log n)
    srt = F.array_sort(F.transform(recs, lambda r: F.struct(
        r["line"].alias("line"), r["pos"].alias("pos"), r.alias("r"))))
    last = F.transform(F.filter(srt, lambda x, i: F.coalesce(
        F.get(srt, i + 1)["line"] != x["line"], F.lit(True))), lambda x: x["r"])
    ok = verdict_store.where(F.col("status") == "ok")
    return (ok.select("verify_key", F.explode(last).alias("v"))
            .select("verify_key", "v.line", *[F.col(f"v.{c}").alias(c) for c in VERDICT_FIELDS]))


def overlay(findings: DataFrame, verdict_lines: DataFrame) -> DataFrame:
    """C4: left join findings to verdicts on (verify_key, line); ``has_verdict`` flags a match."""
    v = verdict_lines.select("verify_key", "line", *VERDICT_FIELDS,
                             F.lit(True).alias("has_verdict"))
    return (findings.join(v, ["verify_key", "line"], "left")
            .withColumn("has_verdict", F.coalesce("has_verdict", F.lit(False))))
