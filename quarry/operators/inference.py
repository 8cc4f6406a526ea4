"""Model-backed scan and verify phases (I1, I2, H12) around any analyst callable.

Requests are built with native columns (prompt rendering is a projection);
only the analyst call itself runs in Python, over Arrow batches via
``mapInPandas``.  Replies go through the recovery tiers, are tagged and
become result-store / verdict-store rows.  An analyst that raises turns its
batch into ``error`` attempts, which are stored and retried next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry import registry as R
from quarry.functions.text import render_prompt
from quarry.operators.analysts import AnalystFn, attach_content, model_results
from quarry.operators.calls import CallPolicy
from quarry.operators.responses import parse_responses

STORE_COLUMNS = ["cache_key", "scanner", "scanner_name", "file", "doc_id", "size", "status",
                 "content_hash", "prompt_hash", "thinking", "tools_mode", "result", "attempted_at"]


def scan_requests(pending: DataFrame, corpus: DataFrame, catalog: DataFrame,
                  keep_content: bool = False) -> DataFrame:
    """Pending (category, file) keys -> rendered scan prompts (content attached once).

    ``keep_content`` also hands the raw text to the analyst (offline analysts)."""
    with_text = attach_content(pending, corpus)
    cat = F.broadcast(catalog.select("scanner", "template"))
    return (with_text.join(cat, "scanner")
            .withColumn("prompt", render_prompt(
                F.col("template"), filename=F.regexp_extract("path", r"([^/]*)$", 1),
                file_content=F.col("text")))
            .drop(*(["template"] if keep_content else ["template", "text"])))


def scan_requests_all(fanned: DataFrame, catalog: DataFrame, thinking: str = "off",
                      tools_mode: str = "off", keep_content: bool = False) -> DataFrame:
    """Requests for *every* (category, file) target, built map-side from the file rows.

    Used when nothing can be reused (first run, rescan): no key set has to be
    joined back to the corpus, so the text is never shuffled.
    """
    from quarry.functions import keys as K
    cat = F.broadcast(catalog.select("scanner", "scanner_name", "prompt_hash", "template"))
    per_file = fanned.select("doc_id", "path", "size", "text", "scanners",
                             K.content_hash("text").alias("content_hash"))
    t = (per_file.select("doc_id", "path", "size", "text", "content_hash",
                         F.explode("scanners").alias("scanner")).join(cat, "scanner")
         .withColumn("thinking", F.lit(thinking)).withColumn("tools_mode", F.lit(tools_mode))
         .withColumn("cache_key", K.scan_key("scanner_name", "path", "content_hash",
                                             "prompt_hash", "thinking"))
         .withColumn("prompt", render_prompt(
             F.col("template"), filename=F.regexp_extract("path", r"([^/]*)$", 1),
             file_content=F.col("text"))))
    return t.drop(*(["template"] if keep_content else ["template", "text"]))


def _tagged(value):
    """Recovered VARIANT array -> tagged findings JSON (no re-parse of the text)."""
    from quarry.operators.findings import finding_struct, object_items
    items = object_items(value)
    return F.to_json(F.transform(items, lambda e, i: finding_struct(e, i)
                                 .dropFields("ord", "line_raw")))


def run_scanner(requests: DataFrame, analyst: AnalystFn, partitions: int | None = None,
                columns: tuple[str, ...] = ("cache_key", "prompt", "scanner"),
                policy: CallPolicy | None = None) -> DataFrame:
    """Call the analyst on each request; recover, tag, shape as store rows.

    ``columns`` are the request columns handed to the analyst (a model needs
    the prompt; an offline analyst may want ``scanner`` and ``text`` instead --
    unused columns such as the rendered prompt are then never computed).
    """
    meta = [c for c in STORE_COLUMNS if c in requests.columns and c not in
            ("cache_key", "status", "result", "attempted_at")] + (["path"] if "path" in requests.columns else [])
    send = list(dict.fromkeys([*columns, *meta]))
    replies = model_results(requests.select(*send), analyst, partitions,
                            analyst_columns=list(columns), passthrough=meta, policy=policy)
    parsed = parse_responses(replies, with_value=True)
    parsed = parsed.withColumn("result", F.when(F.col("value").isNotNull(),
                                                _tagged(F.col("value")))
                               .otherwise(F.col("result")))
    if "path" in parsed.columns:
        parsed = parsed.withColumnRenamed("path", "file")
    return parsed.select(*[c for c in STORE_COLUMNS if c in parsed.columns])


def verify_requests(pending: DataFrame, corpus: DataFrame,
                    template: str = R.DEFAULT_VERIFY_TEMPLATE) -> DataFrame:
    """Eligible files without a verdict -> rendered refutation prompts.

    ``pending`` carries normalised ``findings`` (from ``with_findings``); the
    findings JSON is rendered next to the file content.
    """
    with_text = attach_content(pending, corpus)
    fj = F.to_json(F.transform("findings", lambda f: f.dropFields("ord", "line_raw")))
    return (with_text
            .withColumn("findings_json", fj)
            .withColumn("prompt", render_prompt(
                F.lit(template), filename=F.regexp_extract("file", r"([^/]*)$", 1),
                file_content=F.col("text"), findings_json=F.col("findings_json")))
            .select("verify_key", "scanner", "file", "prompt", "findings_json"))


def run_verifier(requests: DataFrame, analyst: AnalystFn, partitions: int | None = None,
                 policy: CallPolicy | None = None) -> DataFrame:
    """Verdict-store rows ``(verify_key, scanner, file, status, result, attempted_at)``."""
    reqs = requests.withColumnRenamed("verify_key", "cache_key")
    replies = model_results(reqs, analyst, partitions,
                            analyst_columns=["cache_key", "prompt", "findings_json"],
                            passthrough=["scanner", "file"], policy=policy)
    parsed = parse_responses(replies)
    return parsed.select(F.col("cache_key").alias("verify_key"), "scanner", "file", "status",
                         "result", "attempted_at")
