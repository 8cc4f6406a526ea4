"""End-to-end triage run: discovery -> scan -> verify -> report -> gate.

Every phase reads and appends tables under ``state_dir`` (result store,
verdict store, discovery plan, allowlist, report); nothing is held on the
driver.  Re-running with unchanged inputs finds nothing pending: keys are
content, prompt and thinking addressed.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry as R
from quarry.functions.text import render_prompt
from quarry.operators import analysts as A
from quarry.operators import discovery as D
from quarry.operators import overlay as O
from quarry.operators import targets as TG
from quarry.operators.bloom import matching_rows
from quarry.operators.calls import CallPolicy
from quarry.operators.categories import Registry
from quarry.operators.filters import observed_files
from quarry.operators.inference import (run_scanner, run_verifier, scan_requests_all,
                                        verify_requests)
from quarry.operators.suppress import allowlist_candidates
from quarry.plans import report as RP
from quarry.plans import triage as TR
from quarry.plans import waves as WV
from quarry.sources import stores as S

PHASES = (1, 2, 3)


@dataclass
class TriageConfig:
    scanners: str | None = "all"          # "all" or "B1,B3"
    phase: int | None = None              # 1 discovery, 2 scan, 3 verify only; None = all
    verify: bool = False
    rescan: bool = False
    reverify: bool = False
    redetect: bool = False
    dry_run: bool = False
    limit: int | None = None              # first N pending files per category
    max_file_size: int = R.DEFAULT_MAX_FILE_SIZE
    format_override: list[str] | None = None
    scan_thinking: str = "off"
    verify_thinking: str = "off"
    tools_mode: str = "off"
    partitions: int | None = None         # of the analyst stage; None keeps the input's
    waves: int = 8                        # a model phase is stored in so many parts
    scan_calls: CallPolicy = CallPolicy()     # calls at a time in a task, deadline of each
    verify_calls: CallPolicy = CallPolicy()
    # called with (phase, wave, progress) when a wave is stored
    on_wave: Callable[[str, int, DataFrame], None] | None = None
    prompt_dir: str | None = None         # templates: <category name>, verify, discovery .txt
    fail_on: str = "high"
    fail_on_confidence: str = "never"     # threshold of review and of the gate
    report_format: str = "csv"
    export_candidates: bool = False
    include_stale: bool = False           # report every stored result, not only current keys
    rules: list[A.Rule] = field(default_factory=lambda: list(A.DEFAULT_RULES))
    # categories as tables (I6), with their extensions, names, templates and rules: in place
    # of the built-in ones, discovery, ``prompt_dir`` and ``rules``
    registry: Registry | None = None


@dataclass
class TriageOutcome:
    pending: DataFrame
    report: DataFrame | None = None
    stats: DataFrame | None = None
    gate: DataFrame | None = None
    exit_code: int | None = None
    run: str | None = None                # names the run's attempts in the stores
    progress: DataFrame | None = None     # of the scan phase, from the stored attempts
    skipped: dict[str, int] | None = None     # files by skip reason, and those kept


def validate(cfg: TriageConfig) -> tuple[list[str], bool]:
    """Check options up front; returns (category ids, run verification?)."""
    if cfg.partitions is not None and cfg.partitions < 1:
        raise ValueError(f"partitions: {cfg.partitions} is below one")
    if cfg.waves < 1:
        raise ValueError(f"waves: {cfg.waves} is below one")
    if cfg.phase not in (None, *PHASES):
        raise ValueError(f"phase: {cfg.phase} is not one of {PHASES}")
    if not str(cfg.scanners or "").strip():
        raise ValueError("scanners: neither 'all' nor a list of category ids")
    if cfg.verify and cfg.phase == 1:
        raise ValueError("verify: phase 1 alone finds nothing that could be verified")
    if cfg.report_format not in ("csv", "tsv"):
        raise ValueError(f"report_format: {cfg.report_format} is not csv or tsv")
    if cfg.fail_on_confidence.lower() not in ("high", "medium", "low", "never"):
        raise ValueError(f"fail_on_confidence: {cfg.fail_on_confidence} is no level")
    ids = TG.parse_scanner_selection(cfg.scanners,
                                     cfg.registry.ids() if cfg.registry else None)
    return ids, bool(cfg.verify) or cfg.phase == 3


def _template(spark: SparkSession, prompt_dir: str | None, name: str, default: str) -> str:
    """``<prompt_dir>/<name>.txt`` where it is there, else the built-in text."""
    path = f"{prompt_dir.rstrip('/')}/{name}.txt" if prompt_dir else None
    if path is None or not S.path_exists(spark, path):
        return default
    return spark.read.text(path, wholetext=True).first()["value"]


def _discover(spark: SparkSession, kept: DataFrame, cfg: TriageConfig,
              analyst: A.AnalystFn | None) -> DataFrame:
    """The reply (``raw``) of the discovery analyst to the corpus profile; without an
    analyst, of the rules."""
    if analyst is None:
        return D.rule_discovery_reply(spark, kept)
    template = _template(spark, cfg.prompt_dir, "discovery", R.DEFAULT_DISCOVERY_TEMPLATE)
    asked = D.repo_structure(kept).select(F.lit("discovery").alias("cache_key"), render_prompt(
        F.lit(template), repo_structure=F.col("profile")).alias("prompt"))
    return A.model_results(asked, analyst, analyst_columns=["cache_key", "prompt"]).select("raw")


def run_triage(spark: SparkSession, corpus: DataFrame, state_dir: str,
               cfg: TriageConfig | None = None, scan_analyst: A.AnalystFn | None = None,
               verify_analyst: A.AnalystFn | None = None,
               discovery_reply: DataFrame | None = None,
               discovery_analyst: A.AnalystFn | None = None) -> TriageOutcome:
    """Run the selected phases over ``corpus`` (``doc_id, path, name, ext, size, text``).

    Each phase writes its table once and later phases read that.  A first run reads the
    texts once for keys and findings together and moves none of them; verification reads
    those of the files with findings."""
    from quarry.session import ship_package, write_phase_table
    cfg = cfg or TriageConfig()
    ids, run_verify = validate(cfg)
    if run_verify and verify_analyst is None:
        raise ValueError("verify: no verify_analyst given")
    ship_package(spark)
    paths = {k: os.path.join(state_dir, k) for k in
             ("discovery", "results", "verdicts", "report", "candidates")}
    paths["allowlist"] = os.path.join(state_dir, "allowlist.json")
    kept, skipped = observed_files(corpus, cfg.max_file_size)
    run = WV.new_run()

    # phase 1: discovery (reused unless redetect / missing)
    registry = cfg.registry.only(ids) if cfg.registry else None
    if registry and cfg.format_override:
        ext_index, name_index = registry.override_index(cfg.format_override), {}
    elif registry:
        ext_index, name_index = registry.ext_index(), registry.name_index()
    elif cfg.format_override:
        ext_index, name_index = TG.registry_maps(ids, cfg.format_override)
    else:
        plan = S.load_discovery(spark, paths["discovery"], cfg.tools_mode, cfg.redetect)
        if plan is None:
            reply = discovery_reply if discovery_reply is not None else \
                _discover(spark, kept, cfg, discovery_analyst)
            plan = D.discovery_plan(spark, reply)
            S.save_discovery(plan, paths["discovery"], cfg.tools_mode)
            plan = S.load_discovery(spark, paths["discovery"], cfg.tools_mode)
        plan = plan.where(F.col("scanner").isin(ids))
        ext_index = TG.discovery_ext_index(plan)
        name_index = TG.registry_maps(ids)[1]
    catalog = registry.catalog() if registry else TG.prompt_catalog(spark, prompt_dir=cfg.prompt_dir)
    rules = registry.rule_list() if registry else cfg.rules
    fanned = TG.fan_out(kept, ext_index, name_index)
    store = S.read_results(spark, paths["results"], cfg.tools_mode) \
        if S.path_exists(spark, paths["results"]) else None
    scans = cfg.phase in (None, 2) and not cfg.dry_run

    # phase 2: scan the pending pairs and append the attempts
    if scans and (store is None or cfg.rescan) and not cfg.limit:
        # everything is pending: keys and findings come from one pass over the texts
        if scan_analyst is None:
            attempts = write_phase_table(A.rule_results(
                fanned, catalog, rules, cfg.scan_thinking, cfg.tools_mode), "attempts")
            keyed = attempts.select("cache_key", "scanner", "scanner_name", "doc_id",
                                    F.col("file").alias("path"), "size", "content_hash",
                                    "prompt_hash", "thinking", "tools_mode")
            pending = keyed
            S.append_results(attempts, paths["results"], run, 0)
        else:
            staged = WV.Staged(_staged_columns(fanned), "path", cfg.waves, "scan-requests")
            keyed = pending = write_phase_table(TG.with_scan_keys(
                TG.scan_targets(staged.rows()), catalog, cfg.scan_thinking, cfg.tools_mode),
                "work-list")
            _scan_waves(staged, pending, catalog, scan_analyst, cfg, run, paths["results"])
    else:
        keyed = write_phase_table(TG.with_scan_keys(
            TG.scan_targets(fanned), catalog, cfg.scan_thinking, cfg.tools_mode), "work-list")
        pending = TG.pending_scans(keyed, store, cfg.rescan)
        if cfg.limit:
            pending = TG.scan_sample(pending, cfg.limit).drop("rank")
        pending = write_phase_table(pending, "pending")
        only = _pending_files(fanned, pending) if scans else None
        if only is not None and scan_analyst is None:
            S.append_results(A.rule_results(only, catalog, rules, cfg.scan_thinking,
                                            cfg.tools_mode), paths["results"], run, 0)
        elif only is not None:
            staged = WV.Staged(_staged_columns(only), "path", cfg.waves, "scan-requests")
            _scan_waves(staged, pending, catalog, scan_analyst, cfg, run, paths["results"])
    if cfg.dry_run or cfg.phase == 1:
        return TriageOutcome(pending=pending, run=run, skipped=skipped())

    if not S.path_exists(spark, paths["results"]):
        if cfg.phase == 3:
            raise ValueError("phase 3: the result store is empty, scan first")
        return TriageOutcome(pending=pending, run=run, skipped=skipped())
    stored = S.latest_attempts(S.read_results(spark, paths["results"], cfg.tools_mode))
    if not cfg.include_stale:                       # Q2: only the current version of each file
        stored = stored.join(keyed.select("cache_key"), "cache_key", "left_semi")
    stored = stored.where(F.col("scanner").isin(ids))
    present = keyed.groupBy(F.col("path").alias("file")).agg(F.min("doc_id").alias("doc_id"))
    stored = stored.join(present, "file", "left")
    verify_template = _template(spark, cfg.prompt_dir, "verify", R.DEFAULT_VERIFY_TEMPLATE)
    results_n = write_phase_table(TR.normalised_results(
        stored, R.short_hash(verify_template), cfg.verify_thinking), "results")

    # phase 3: verification of eligible files without a current verdict
    verdict_exists = S.path_exists(spark, paths["verdicts"])
    if run_verify:
        eligible = O.verify_eligible(results_n, keyed.select("path", "size"), cfg.max_file_size)
        vstore = S.read_verdicts(spark, paths["verdicts"], cfg.tools_mode) \
            if verdict_exists else None
        todo = O.pending_verifications(eligible, vstore, cfg.reverify)
        todo = write_phase_table(todo, "to-verify")
        staged = WV.Staged(verify_requests(todo, kept, verify_template), "file", cfg.waves,
                           "verify-requests")
        plan = todo.groupBy(F.col("scanner").alias("grp")).agg(F.count("*").alias("total"))
        WV.run_waves(
            staged,
            lambda rows: run_verifier(rows, verify_analyst, cfg.partitions, cfg.verify_calls),
            lambda rows, wave: S.append_verdicts(rows, paths["verdicts"], cfg.tools_mode, run,
                                                 wave),
            _report("verify", plan, cfg, run, lambda: spark.read.schema(S.VERDICT_DDL).parquet(
                paths["verdicts"])))
        verdict_exists = S.path_exists(spark, paths["verdicts"])
    vlines = O.verdict_lines_from_replies(
        S.read_verdicts(spark, paths["verdicts"], cfg.tools_mode)) if verdict_exists else None

    # report + gate
    level = None if cfg.fail_on_confidence.lower() == "never" else cfg.fail_on_confidence.lower()
    allowlist = S.load_run_allowlist(spark, paths["allowlist"], paths["candidates"])
    b = write_phase_table(TR.bucketed(results_n, vlines, allowlist, level, ids), "bucketed")
    if cfg.export_candidates:
        # a folder a run: the human document is never touched
        cands = allowlist_candidates(RP.refuted_for_export(b), allowlist)
        new = S.append_candidates(allowlist, cands).join(
            allowlist.select("pos"), "pos", "left_anti")
        S.write_allowlist(new, os.path.join(paths["candidates"], f"run-{uuid.uuid4().hex}"))
    files = TR.file_grain(results_n, b)
    rows = RP.report_rows(b, files, spark, registry.labels() if registry else None)
    RP.write_report(rows, paths["report"], cfg.report_format)
    gate = RP.ci_gate(b, files, cfg.fail_on, cfg.fail_on_confidence)
    code = gate.first()["exit_code"]
    plan = pending.groupBy(F.col("scanner").alias("grp")).agg(F.count("*").alias("total"))
    progress = WV.run_progress(S.read_results(spark, paths["results"], cfg.tools_mode), plan, run,
                               _now_us())
    return TriageOutcome(pending=pending, report=rows, stats=RP.run_stats(b, files), gate=gate,
                         exit_code=int(code), run=run, progress=progress, skipped=skipped())


def _now_us() -> int:
    return time.time_ns() // 1000


def _staged_columns(fanned: DataFrame) -> DataFrame:
    return fanned.where(F.size("scanners") > 0).select("doc_id", "path", "size", "text", "scanners")


def _pending_files(fanned: DataFrame, pending: DataFrame) -> DataFrame | None:
    """The files with something pending, and only their pending categories; None where
    nothing is.  Of the corpus no more than about these files' texts is shuffled."""
    todo = pending.groupBy("doc_id").agg(F.collect_set("scanner").alias("_p"))
    n = todo.count()
    if not n:
        return None
    return (matching_rows(fanned, todo, "doc_id", n)
            .withColumn("scanners", F.array_intersect("scanners", "_p")).drop("_p"))


def _report(phase: str, plan: DataFrame, cfg: TriageConfig, run: str,
            store: Callable[[], DataFrame]) -> Callable[[int], None] | None:
    """What is to be done after a wave: tell ``cfg.on_wave`` how far the phase is."""
    if cfg.on_wave is None:
        return None
    return lambda wave: cfg.on_wave(phase, wave, WV.run_progress(store(), plan, run, _now_us()))


def _scan_waves(staged: WV.Staged, pending: DataFrame, catalog: DataFrame,
                analyst: A.AnalystFn, cfg: TriageConfig, run: str, store: str) -> None:
    """Ask a model analyst about the staged files, wave by wave."""
    def ask(rows: DataFrame) -> DataFrame:
        reqs = scan_requests_all(rows, catalog, cfg.scan_thinking, cfg.tools_mode,
                                 keep_content=True)
        got = run_scanner(reqs, analyst, cfg.partitions,
                          columns=("cache_key", "prompt", "scanner", "text"),
                          policy=cfg.scan_calls)
        return got.withColumn("thinking", F.lit(cfg.scan_thinking)) \
            .withColumn("tools_mode", F.lit(cfg.tools_mode))

    plan = pending.groupBy(F.col("scanner").alias("grp")).agg(F.count("*").alias("total"))
    spark = pending.sparkSession
    WV.run_waves(staged, ask, lambda rows, wave: S.append_results(rows, store, run, wave),
                 _report("scan", plan, cfg, run,
                         lambda: S.read_results(spark, store, cfg.tools_mode)))
