"""

Every query builds the triage world from the driver tables (documents,
labels, events, ...) with the library's operators and returns one section
of it.  ``oracle_sql`` holds the DuckDB twin of each query.
"""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry import registry as R  # noqa: E402
from quarry.operators import analysts as A  # noqa: E402
from quarry.operators import filters as FL  # noqa: E402
from quarry.operators import overlay as O  # noqa: E402
from quarry.operators import targets as TG  # noqa: E402
from quarry.operators.findings import explode_findings  # noqa: E402
from quarry.operators.suppress import allowlist_candidates  # noqa: E402
from quarry.plans import report as RP  # noqa: E402
from quarry.plans.world import World, world_for  # noqa: E402
from quarry.sources import corpus as C  # noqa: E402

SMOKE_DIR = "/root/testdata/sf0.001"


def _w(spark: SparkSession, sf: str) -> World:
    return world_for(spark, sf)


def prior_store(w: World) -> DataFrame:
    """Earlier runs: labelled files were attempted before; toxic ones failed, of the
    others every fifth had a second attempt that failed, and low-quality ones have since
    changed (their old key no longer matches)."""
    labels = w.table("labels").select("doc_id", "quality", "toxic")
    k = w.keyed.join(labels, "doc_id")
    key = F.when(F.col("quality") == 0, F.md5(F.concat("cache_key", F.lit(":old")))) \
        .otherwise(F.col("cache_key"))
    first = k.select(key.alias("cache_key"), F.lit(1).alias("attempted_at"),
                     F.when(F.col("toxic") == 1, "error").otherwise("ok").alias("status"))
    again = k.where(F.col("doc_id") % 5 == 0).select(
        key.alias("cache_key"), F.lit(2).alias("attempted_at"), F.lit("timeout").alias("status"))
    return first.unionByName(again)


def q_corpus_scan(spark, sf):
    w = _w(spark, sf)
    return w.kept.select("doc_id", "path", "name", "ext", "size",
                         F.substring(F.md5("text"), 1, 16).alias("content_hash"))


def q_corpus_decode(spark, sf):
    w = _w(spark, sf)
    from quarry.functions.text import repair_text
    return w.kept.select("doc_id", F.length(repair_text("text")).cast("bigint").alias("n_chars"),
                         "size")


def q_exclude_paths(spark, sf):
    w = _w(spark, sf)
    return w.labelled.where(F.col("skip_reason").isin("excluded_dir", "excluded_file")) \
        .select("doc_id", "path", "skip_reason")


def q_binary_filter(spark, sf):
    w = _w(spark, sf)
    return w.labelled.where(F.col("skip_reason") == "binary_ext").select("doc_id", "path", "ext")


def q_skip_counts(spark, sf):
    return FL.skip_counts(_w(spark, sf).corpus)


def q_size_cap(spark, sf):
    return FL.skip_counts(_w(spark, sf).corpus, max_file_size=16384)


def q_extension_counts(spark, sf):
    return _w(spark, sf).kept.groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def q_notable_files(spark, sf):
    return _w(spark, sf).kept.where(F.col("name").isin(R.NOTABLE_FILES)).select("name", "path")


def q_directory_profile(spark, sf):
    from quarry.operators.discovery import directory_profile
    return directory_profile(_w(spark, sf).kept)


def q_scanner_registry(spark, sf):
    w = _w(spark, sf)
    counts = TG.scan_targets(w.fanned).groupBy("scanner").agg(
        F.count(F.lit(1)).alias("target_files"))
    return (w.catalog.join(counts, "scanner", "left")
            .select("scanner", F.col("ord").cast("bigint").alias("ord"), "scanner_name",
                    "scanner_label", "prompt_hash",
                    F.coalesce("target_files", F.lit(0).cast("bigint")).alias("target_files")))


def q_scan_targets(spark, sf):
    return TG.scan_targets(_w(spark, sf).fanned).select("scanner", "doc_id", "path")


def q_scan_targets_override(spark, sf):
    w = _w(spark, sf)
    ei, ni = TG.registry_maps(format_override=["py", ".SQL ", "yml"])
    return TG.scan_targets(TG.fan_out(w.kept, ei, ni)).select("scanner", "doc_id", "path")


def q_scanner_select(spark, sf):
    w = _w(spark, sf)
    ids = TG.parse_scanner_selection("b3, B9,b10")
    ei, ni = TG.registry_maps(scanner_ids=ids)
    return (TG.scan_targets(TG.fan_out(w.kept, ei, ni)).groupBy("scanner")
            .agg(F.count(F.lit(1)).alias("targets")))


def q_content_keys(spark, sf):
    return _w(spark, sf).keyed.select("scanner", "doc_id", "content_hash", "prompt_hash")


def q_scan_keys(spark, sf):
    return _w(spark, sf).keyed.select("scanner", "doc_id", "path", "cache_key")


def q_pending_scans(spark, sf):
    w = _w(spark, sf)
    return TG.pending_scans(w.keyed, prior_store(w)).select("scanner", "doc_id", "path",
                                                            "cache_key")


def q_work_plan(spark, sf):
    w = _w(spark, sf)
    return TG.work_plan(w.keyed, prior_store(w))


def q_retry_set(spark, sf):
    w = _w(spark, sf)
    return TG.retry_set(w.keyed, prior_store(w)).select("scanner", "doc_id", "cache_key")


def q_scan_sample(spark, sf):
    w = _w(spark, sf)
    p = TG.pending_scans(w.keyed, prior_store(w))
    return TG.scan_sample(p, 5).select("scanner", "doc_id", "path",
                                       F.col("rank").cast("bigint").alias("rank"))


def _findings(w: World) -> DataFrame:
    return explode_findings(w.results_n)


def q_rule_findings(spark, sf):
    f = _findings(_w(spark, sf))
    return f.select("scanner", "doc_id", "file", "line", "severity", "code", "explanation")


def q_tagged_findings(spark, sf):
    f = _findings(_w(spark, sf))
    return f.select("scanner", "file", F.col("ord").cast("bigint").alias("ord"), "line",
                    F.coalesce("source", F.lit("<missing>")).alias("source"),
                    F.array_join("tags", ",").alias("tags"))


def q_findings_normalised(spark, sf):
    f = _findings(_w(spark, sf))
    return f.select("scanner", "file", F.col("ord").cast("bigint").alias("ord"), "line_raw",
                    "line", "severity", "code", "explanation", "fix", "source", "sink",
                    F.array_join("tags", ",").alias("tags"))


def _with_findings(w: World) -> DataFrame:
    return w.results_n.where(~F.col("status").isin("error", "timeout")
                             & (F.size("findings") > 0))


def q_findings_signature(spark, sf):
    return _with_findings(_w(spark, sf)).select("scanner", "file", "findings_sig")


def q_verify_keys(spark, sf):
    return _with_findings(_w(spark, sf)).select("scanner", "file", "findings_sig", "verify_key")


def q_verify_eligible(spark, sf):
    w = _w(spark, sf)
    return O.verify_eligible(w.results_n, w.kept.select("path", "size"), w.max_file_size).select("scanner", "file")


def q_pending_verifications(spark, sf):
    w = _w(spark, sf)
    el = O.verify_eligible(w.results_n, w.kept.select("path", "size"), w.max_file_size)
    return O.pending_verifications(el, w.verdict_store).select("scanner", "file", "verify_key")


def q_verdict_lines(spark, sf):
    return _w(spark, sf).verdict_lines


def q_verdict_overlay(spark, sf):
    b = _w(spark, sf).bucketed
    return b.select("scanner", "file", F.col("ord").cast("bigint").alias("ord"), "line",
                    "has_verdict", "confidence", "exploitable", "verdict")


def q_bucketed_findings(spark, sf):
    b = _w(spark, sf).bucketed
    return b.select("scanner", "file", F.col("ord").cast("bigint").alias("ord"), "bucket",
                    "conf", "status")


def q_suppressed_findings(spark, sf):
    b = _w(spark, sf).bucketed
    return b.where(F.col("status") == "suppressed").select(
        "scanner", "file", F.col("ord").cast("bigint").alias("ord"), "line",
        F.col("suppression_pos").cast("bigint").alias("suppression_pos"), "suppression_reason")


def _b(spark, sf):
    return _w(spark, sf).bucketed


def q_severity_by_scanner(spark, sf):
    return RP.severity_by_scanner(_b(spark, sf))


def q_severity_rollup(spark, sf):
    return RP.severity_rollup(_b(spark, sf))


def q_confidence_counts(spark, sf):
    return RP.confidence_counts(_b(spark, sf))


def q_bucket_counts(spark, sf):
    return RP.bucket_counts(_b(spark, sf))


def q_file_status_counts(spark, sf):
    return RP.file_status_counts(_w(spark, sf).files)


def q_unsubstantiated_counts(spark, sf):
    return RP.unsubstantiated_counts(_b(spark, sf))


def q_gated_severity(spark, sf):
    return RP.gated_severity(_b(spark, sf))


def q_fail_on_gate(spark, sf):
    return RP.fail_on_gate(_b(spark, sf), "high")


def q_verification_coverage(spark, sf):
    return RP.verification_coverage(_b(spark, sf))


def q_vulnerable_files(spark, sf):
    return RP.vulnerable_files(_b(spark, sf))


def q_top_vulnerable_files(spark, sf):
    return RP.top_vulnerable_files(_b(spark, sf), 20).withColumn(
        "rank", F.col("rank").cast("bigint"))


def q_risk_heatmap(spark, sf):
    return RP.risk_heatmap(_b(spark, sf)).withColumn("sev_rank", F.col("sev_rank").cast("bigint"))


def q_overall_risk(spark, sf):
    w = _w(spark, sf)
    return RP.overall_risk(w.bucketed, w.files)


def _rows(w: World) -> DataFrame:
    return RP.report_rows(w.bucketed, w.files, w.spark)


def q_report_rows(spark, sf):
    return _rows(_w(spark, sf))


def q_status_counts(spark, sf):
    return RP.status_counts(_rows(_w(spark, sf)))


def q_ci_gate(spark, sf):
    w = _w(spark, sf)
    return RP.ci_gate(w.bucketed, w.files, fail_on="critical", fail_on_confidence="medium") \
        .withColumn("exit_code", F.col("exit_code").cast("int"))


def q_ci_gate_levels(spark, sf):
    """The gate at each confidence level, without the severity gate."""
    w = _w(spark, sf)
    gates = [RP.ci_gate(w.bucketed, w.files, "never", x).withColumn("level", F.lit(x))
             for x in ("high", "medium", "low", "never")]
    return reduce(DataFrame.unionByName, gates).withColumn("exit_code", F.col("exit_code").cast("int"))


def _listing(status):
    def q(spark, sf):
        return RP.listing(_b(spark, sf), status).withColumn("ord", F.col("ord").cast("bigint"))
    return q


def q_file_labels(spark, sf):
    return RP.file_labels(_w(spark, sf).files)


def q_extensions_scanned(spark, sf):
    w = _w(spark, sf)
    return RP.extensions_scanned(spark, w.files)


def q_allowlist_candidates(spark, sf):
    w = _w(spark, sf)
    cands = allowlist_candidates(RP.refuted_for_export(w.bucketed), w.allowlist,
                                 exported_at="1970-01-01T00:00:00Z")
    return cands.select("scanner", "file", "line", "reason", "status")


def q_run_stats(spark, sf):
    w = _w(spark, sf)
    return RP.run_stats(w.bucketed, w.files)


def q_scan_from_responses(spark, sf):
    """I4 + P-tiers: replies looked up by cache key, recovered, counted."""
    from quarry.operators.analysts import response_results
    from quarry.operators.findings import result_items
    from quarry.operators.responses import parse_responses
    w = _w(spark, sf)
    got = response_results(w.keyed, w.responses.select("cache_key", "status", "raw"))
    p = parse_responses(got)
    return p.select("scanner", F.col("path").alias("file"), "kind",
                    F.coalesce(F.size(result_items(F.col("result"))), F.lit(0))
                    .cast("bigint").alias("n_findings"))


def q_response_tiers(spark, sf):
    return _w(spark, sf).parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def q_discovery_plan(spark, sf):
    from quarry.operators.discovery import discovery_plan, rule_discovery_reply
    w = _w(spark, sf)
    plan = discovery_plan(spark, rule_discovery_reply(spark, w.kept))
    return plan.select("scanner", F.col("pos").cast("bigint").alias("pos"), "ext")


def q_discovered_targets(spark, sf):
    from quarry.operators.discovery import discovery_plan, rule_discovery_reply
    w = _w(spark, sf)
    plan = discovery_plan(spark, rule_discovery_reply(spark, w.kept))
    _, ni = w.indexes
    fanned = TG.fan_out(w.kept, TG.discovery_ext_index(plan), ni)
    return TG.scan_targets(fanned).groupBy("scanner").agg(F.count(F.lit(1)).alias("targets"))


def q_rendered_prompts(spark, sf):
    """Scan prompts rendered per target (hash + length of the rendered text)."""
    from quarry.operators.inference import scan_requests_all
    w = _w(spark, sf)
    t = scan_requests_all(w.fanned, w.catalog, w.thinking)
    return t.select("scanner", "doc_id", F.md5("prompt").alias("prompt_md5"),
                    F.length("prompt").cast("bigint").alias("prompt_chars"))


def q_phase_progress(spark, sf):
    from quarry.plans.progress import events_progress
    return events_progress(C.read_table(spark, sf, "events"))


def q_overall_eta(spark, sf):
    from quarry.plans.progress import events_progress, overall_eta
    return overall_eta(events_progress(C.read_table(spark, sf, "events")))


def _pages_results(spark, sf):
    from quarry.operators import analysts as A
    kept = FL.kept_files(C.pages_corpus(spark, sf))
    ei, ni = TG.registry_maps(format_override=[".html"])
    return A.rule_results(TG.fan_out(kept, ei, ni), TG.prompt_catalog(spark))


def q_pages_skip_counts(spark, sf):
    return FL.skip_counts(C.pages_corpus(spark, sf))


def q_pages_findings(spark, sf):
    """Rule analyst over the web-page corpus (every category scans .html)."""
    from quarry.operators.findings import with_findings
    f = explode_findings(with_findings(_pages_results(spark, sf)))
    return f.groupBy("scanner", "severity").agg(F.count(F.lit(1)).alias("n"),
                                                F.countDistinct("file").alias("files"))


def q_finding_details(spark, sf):
    return RP.finding_details(_b(spark, sf))


def q_pending_candidates(spark, sf):
    """Allowlist entries awaiting human confirmation after this run's export."""
    from quarry.sources.stores import append_candidates
    w = _w(spark, sf)
    al = w.allowlist.withColumn("exported_at", F.lit(None).cast("string"))
    cands = allowlist_candidates(RP.refuted_for_export(w.bucketed), w.allowlist,
                                 exported_at="1970-01-01T00:00:00Z")
    merged = append_candidates(al, cands)
    return merged.where(F.col("status") == "candidate").select(
        "scanner", "file", "line", "reason")


def q_results_load(spark, sf):
    """The written result store read back (one row per (category, file))."""
    return _w(spark, sf).results.select("scanner", "file", "status", "content_hash")


def q_scan_attempts(spark, sf):
    """Attempts per category and status (failures are kept, not dropped)."""
    return _w(spark, sf).results.groupBy("scanner", "status").agg(
        F.count(F.lit(1)).alias("attempts"))


def q_wave_attempts(spark, sf):
    """Attempts per wave of the run, with outcome and first and last answer time."""
    from quarry.plans.progress import _us
    from quarry.plans.waves import wave_attempts
    w = wave_attempts(_w(spark, sf).attempts)
    return w.select("run", "wave", "attempts", "ok", "errors", "timeouts", "files",
                    _us(F.col("first_at")).alias("first_us"), _us(F.col("last_at")).alias("last_us"))


def q_run_progress(spark, sf):
    """Done, rate and time left per category from the run's stored attempts, as of
    half-way between its first and last answer."""
    from quarry.plans.progress import midpoint
    from quarry.plans.waves import run_progress
    w = _w(spark, sf)
    plan = w.keyed.groupBy(F.col("scanner").alias("grp")).agg(F.count(F.lit(1)).alias("total"))
    return run_progress(w.attempts, plan, "this", midpoint(w.attempts, "attempted_at"))


def q_custom_category(spark, sf):
    """A category X1 made of rows alone, scanned and reported next to a built-in one."""
    from quarry.operators.categories import Registry
    from quarry.plans import triage as TR
    w = _w(spark, sf)
    mine = Registry.builtin(spark).extended(
        [("X1", 11, "attribution", "Attribution", None)], [("X1", 0, ".py"), ("X1", 1, "SQL")],
        [("X1", "pom.xml")],
        [(100, "apache", "X1", "Low", "Apache License", "Names a licence", "Keep it", "text", None),
         (101, "version", "X1", "Medium", "Version [0-9]+[.][0-9]+", "Pins a version", "Check it",
          "text", None)]).only(["B6", "X1"])
    fanned = TG.fan_out(w.kept, mine.ext_index(), mine.name_index())
    found = A.rule_results(fanned, mine.catalog(), mine.rule_list())
    b = TR.bucketed(TR.normalised_results(found, "x" * 16), None, None, scanners=mine.ids())
    return b.join(mine.labels(), "scanner").groupBy("scanner", "scanner_label", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.count_distinct("file").alias("files"))


def q_verdict_store(spark, sf):
    """Verifier replies per verify key with their entry counts."""
    from quarry.operators.findings import result_items
    v = _w(spark, sf).verdict_store
    return v.select("verify_key", "scanner", "file", "status",
                    F.size(result_items(F.col("result"))).cast("bigint").alias("entries"))


def q_report_exclusions(spark, sf):
    """Targets of a stale store covering every corpus file that the
    report-time exclusion drops."""
    from quarry.functions import paths as P
    w = _w(spark, sf)
    ei, ni = w.indexes
    stale = TG.fan_out(w.corpus, ei, ni).select(
        "doc_id", "path", F.explode("scanners").alias("scanner"))
    return stale.where(P.excluded_path(F.col("path"))).select("scanner", "doc_id", "path")


def q_response_status(spark, sf):
    """Failed / unparseable replies with their capped previews."""
    p = _w(spark, sf).parsed
    return p.where(F.col("kind").isin("error", "failed")).select(
        "scanner", "file", "kind",
        F.get_json_object("result", "$.error").alias("error"),
        F.length(F.get_json_object("result", "$.raw_preview")).cast("bigint").alias("preview_len"))


def q_scan_findings(spark, sf):
    """The model phase (mapInPandas) with an offline analyst, end to end:
    requests -> replies -> recovery -> tagging -> store -> findings."""
    from quarry.operators.analysts import python_rule_analyst
    from quarry.operators.findings import with_findings
    from quarry.operators.inference import run_scanner, scan_requests_all
    w = _w(spark, sf)
    # a first run: every target is pending, requests are built map-side (no text shuffle)
    reqs = scan_requests_all(w.fanned, w.catalog, w.thinking, keep_content=True)
    store = run_scanner(reqs, python_rule_analyst(w.rules),
                        columns=("cache_key", "scanner", "text"))
    f = explode_findings(with_findings(store))
    return f.select("scanner", "file", "line", "severity", "code",
                    F.array_join("tags", ",").alias("tags"))


def q_verify_findings(spark, sf):
    """The verify phase (mapInPandas) with an offline verifier, bucketed."""
    from quarry.operators.analysts import python_verifier
    from quarry.operators.inference import run_verifier, verify_requests
    from quarry.plans import triage as TR
    w = _w(spark, sf)
    el = O.verify_eligible(w.results_n, w.kept.select("path", "size"), w.max_file_size)
    verdicts = run_verifier(verify_requests(el, w.kept), python_verifier())
    b = TR.bucketed(w.results_n, O.verdict_lines_from_replies(verdicts), None, "medium")
    return b.select("scanner", "file", F.col("ord").cast("bigint").alias("ord"), "bucket",
                    "conf", "status")


def q_binary_sniff(spark, sf):
    """The NUL sniff over the first 8192 characters of every file that reaches it."""
    from quarry.functions import paths as P
    lab = _w(spark, sf).labelled
    return lab.where(F.col("skip_reason").isNull() | (F.col("skip_reason") == "nul_bytes")) \
        .select("doc_id", "path", P.has_nul("text").alias("nul"))


def q_line_coercion(spark, sf):
    """H8: raw line text and its integer coercion for every stored finding."""
    f = _findings(_w(spark, sf))
    return f.select("scanner", "file", F.col("ord").cast("bigint").alias("ord"), "line_raw",
                    "line")


def q_parsed_responses(spark, sf):
    """Every reply recovered, with its tier and the number of findings."""
    from quarry.operators.findings import result_items
    p = _w(spark, sf).parsed
    return p.select("scanner", "file", "kind",
                    F.coalesce(F.size(result_items(F.col("result"))), F.lit(0))
                    .cast("bigint").alias("n_findings"))


def q_sanitized_responses(spark, sf):
    """Replies after lone-surrogate repair; the replies get lone, paired and escaped
    forms by their document's number."""
    from quarry.functions.text import sanitize_json_escapes
    r = _w(spark, sf).responses
    forms = F.array(*[F.lit(x) for x in (
        "", "\\ud83d", "\\ud83d\\ude00", "\\\\ud83d x", "\\ude00\\ud83d", "\\\\\\udfff",
        "\u0001b\\ud800")])
    r = r.withColumn("raw", F.concat("raw", F.get(forms, (F.col("doc_id") % 7).cast("int"))))
    fixed = sanitize_json_escapes(F.col("raw"))
    return r.select("scanner", "file", F.md5(fixed).alias("text_md5"),
                    F.length(fixed).cast("bigint").alias("chars"),
                    (fixed != F.col("raw")).alias("repaired"))


def q_prompt_catalog(spark, sf):
    """A4: the prompt catalog with the volume of prompts it renders over the corpus."""
    rp = q_rendered_prompts(spark, sf)
    vol = rp.groupBy("scanner").agg(F.count(F.lit(1)).alias("prompts"),
                                    F.sum("prompt_chars").cast("bigint").alias("prompt_chars"))
    cat = _w(spark, sf).catalog.select("scanner", "scanner_name", "prompt_hash",
                                       F.length("template").cast("bigint").alias("template_chars"))
    return cat.join(vol, "scanner", "left").select(
        "scanner", "scanner_name", "prompt_hash", "template_chars",
        F.coalesce("prompts", F.lit(0).cast("bigint")).alias("prompts"),
        F.coalesce("prompt_chars", F.lit(0).cast("bigint")).alias("prompt_chars"))


def q_allowlist_load(spark, sf):
    """The allowlist document after this run's candidate export, written to
    the shared folder and loaded back (non-object entries dropped, order kept)."""
    import uuid
    from quarry.session import ensure_checkpoint_dir
    from quarry.sources.stores import append_candidates, load_allowlist, write_allowlist
    w = _w(spark, sf)
    al = w.allowlist.withColumn("exported_at", F.lit(None).cast("string"))
    cands = allowlist_candidates(RP.refuted_for_export(w.bucketed), w.allowlist,
                                 exported_at="1970-01-01T00:00:00Z")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/quarry-tables/allowlist-{uuid.uuid4().hex}"
    write_allowlist(append_candidates(al, cands), path, as_document=True)
    back = load_allowlist(spark, path)
    return back.select(F.col("pos").cast("bigint").alias("pos"), "scanner", "file", "line",
                       "reason", "status")


def q_verify_plan(spark, sf):
    w = _w(spark, sf)
    el = O.verify_eligible(w.results_n, w.kept.select("path", "size"), w.max_file_size)
    return O.verify_plan(el, w.verdict_store)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "corpus_scan": q_corpus_scan,
    "corpus_decode": q_corpus_decode,
    "exclude_paths": q_exclude_paths,
    "binary_filter": q_binary_filter,
    "skip_counts": q_skip_counts,
    "size_cap": q_size_cap,
    "extension_counts": q_extension_counts,
    "notable_files": q_notable_files,
    "directory_profile": q_directory_profile,
    "scanner_registry": q_scanner_registry,
    "scan_targets": q_scan_targets,
    "scan_targets_override": q_scan_targets_override,
    "scanner_select": q_scanner_select,
    "content_keys": q_content_keys,
    "scan_keys": q_scan_keys,
    "pending_scans": q_pending_scans,
    "work_plan": q_work_plan,
    "retry_set": q_retry_set,
    "scan_sample": q_scan_sample,
    "rule_findings": q_rule_findings,
    "tagged_findings": q_tagged_findings,
    "findings_normalised": q_findings_normalised,
    "findings_signature": q_findings_signature,
    "verify_keys": q_verify_keys,
    "verify_eligible": q_verify_eligible,
    "pending_verifications": q_pending_verifications,
    "verdict_lines": q_verdict_lines,
    "verdict_overlay": q_verdict_overlay,
    "bucketed_findings": q_bucketed_findings,
    "suppressed_findings": q_suppressed_findings,
    "severity_by_scanner": q_severity_by_scanner,
    "severity_rollup": q_severity_rollup,
    "confidence_counts": q_confidence_counts,
    "bucket_counts": q_bucket_counts,
    "file_status_counts": q_file_status_counts,
    "unsubstantiated_counts": q_unsubstantiated_counts,
    "gated_severity": q_gated_severity,
    "fail_on_gate": q_fail_on_gate,
    "verification_coverage": q_verification_coverage,
    "vulnerable_files": q_vulnerable_files,
    "top_vulnerable_files": q_top_vulnerable_files,
    "risk_heatmap": q_risk_heatmap,
    "overall_risk": q_overall_risk,
    "report_rows": q_report_rows,
    "status_counts": q_status_counts,
    "ci_gate": q_ci_gate,
    "ci_gate_levels": q_ci_gate_levels,
    "refuted_findings": _listing("refuted"),
    "not_actionable": _listing("not_actionable"),
    "needs_review": _listing("needs_review"),
    "file_labels": q_file_labels,
    "extensions_scanned": q_extensions_scanned,
    "allowlist_candidates": q_allowlist_candidates,
    "run_stats": q_run_stats,
    "scan_from_responses": q_scan_from_responses,
    "response_tiers": q_response_tiers,
    "discovery_plan": q_discovery_plan,
    "discovered_targets": q_discovered_targets,
    "rendered_prompts": q_rendered_prompts,
    "phase_progress": q_phase_progress,
    "overall_eta": q_overall_eta,
    "pages_skip_counts": q_pages_skip_counts,
    "pages_findings": q_pages_findings,
    "finding_details": q_finding_details,
    "pending_candidates": q_pending_candidates,
    "results_load": q_results_load,
    "scan_attempts": q_scan_attempts,
    "wave_attempts": q_wave_attempts,
    "run_progress": q_run_progress,
    "custom_category": q_custom_category,
    "verdict_store": q_verdict_store,
    "report_exclusions": q_report_exclusions,
    "response_status": q_response_status,
    "scan_findings": q_scan_findings,
    "verify_findings": q_verify_findings,
    "binary_sniff": q_binary_sniff,
    "line_coercion": q_line_coercion,
    "parsed_responses": q_parsed_responses,
    "sanitized_responses": q_sanitized_responses,
    "prompt_catalog": q_prompt_catalog,
    "allowlist_load": q_allowlist_load,
    "verify_plan": q_verify_plan,
}


def _with_package(fn: Callable[[SparkSession, str], DataFrame]
                  ) -> Callable[[SparkSession, str], DataFrame]:
    """Ship the package to the Python workers before building the query."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from quarry.session import ship_package
        ship_package(spark)
        return fn(spark, sf_dir)
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the per-category / per-severity roll-up of the triaged findings."""
    return _with_package(q_severity_rollup)(spark, SMOKE_DIR)


def _training_data() -> tuple[dict, dict]:
    """Queries and SQL of the training-data operators; none where they are not installed."""
    found, twins = {}, {}
    if importlib.util.find_spec("quarry.llm") and importlib.util.find_spec("quarry.llm.queries"):
        from quarry.llm.queries import ORACLES, QUERIES as OPERATORS
        found, twins = dict(OPERATORS), dict(ORACLES)
        if importlib.util.find_spec("corpus_pipeline"):
            import corpus_pipeline
            found["pipeline"] = corpus_pipeline.run
            if corpus_pipeline.ORACLE_SQL:
                twins["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found, twins


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _with_package(fn) for name, fn in (QUERIES | _training_data()[0]).items()}


def oracle_sql() -> dict[str, str]:
    from oracle_sql import oracle_queries
    return {k: v for k, v in oracle_queries().items() if k in QUERIES} | _training_data()[1]
