"""Scan and verification as one stream over a directory tree.

State is tables under ``state_dir``, shared with batch runs: the result and verdict stores,
and ``files``, the state by path: of each version that the stream has seen its content hash
(null when the file is gone or is skipped), by namespace, stream and batch.  A batch

1. writes its part of the path state, in a folder of its own (a replay overwrites it),
2. scans the files whose keys the result store has not, and
3. verifies those with findings whose verify key -- which holds content hash and findings
   signature -- the verdict store has not.

So an edited file is scanned once and its verdicts open again, an unchanged or replayed one
adds nothing, and a removed one is retired: ``current_findings`` reads results of the latest
version of the files that are there.  Namespaces (``tools_mode``) see their own rows only.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry import registry as R
from quarry.functions import keys as K
from quarry.operators import analysts as A
from quarry.operators import overlay as O
from quarry.operators import targets as TG
from quarry.operators.filters import label_corpus
from quarry.operators.inference import run_verifier, verify_requests
from quarry.plans import triage as TR
from quarry.session import ship_package, write_phase_table
from quarry.sources import stores as S
from quarry.sources.source_tree import tree_stream
from quarry.streaming.incremental import scan_batch

FILES_DDL = ("path string, content_hash string, seen_at timestamp, tools_mode string, "
             "stream string, batch bigint")


def _paths(state_dir: str) -> dict[str, str]:
    return {k: os.path.join(state_dir, k) for k in ("files", "results", "verdicts")}


def triage_batch(spark: SparkSession, batch: DataFrame, state_dir: str, number: int,
                 analyst: A.AnalystFn | None = None, verify_analyst: A.AnalystFn | None = None,
                 rules: list[A.Rule] | None = None, thinking: str = "off",
                 verify_thinking: str = "off", tools_mode: str = "off",
                 template: str = R.DEFAULT_VERIFY_TEMPLATE, stream: str = "0") -> None:
    """One micro-batch of corpus rows with ``skip_reason``; ``stream`` names the stream whose
    batch ``number`` it is."""
    at = _paths(state_dir)
    rows = write_phase_table(batch, "stream-batch")  # a batch is read several times
    kept = rows.where("skip_reason is null").drop("skip_reason")
    kept = label_corpus(kept).where("skip_reason is null").drop("skip_reason")
    seen = kept.select("path", K.content_hash("text").alias("content_hash"))
    state = rows.select("path").join(seen, "path", "left")
    state.select("path", "content_hash", F.current_timestamp().alias("seen_at")) \
        .write.mode("overwrite").parquet(os.path.join(
            at["files"], f"tools_mode={tools_mode}", f"stream={stream}", f"batch={number}"))
    if kept.isEmpty():
        return
    scan_batch(spark, kept.select("doc_id", "path", "text"), at["results"], number, rules,
               thinking, analyst=analyst, tools_mode=tools_mode)
    if verify_analyst is None:
        return
    ei, ni = TG.registry_maps()
    keyed = TG.with_scan_keys(TG.scan_targets(TG.fan_out(kept, ei, ni)), TG.prompt_catalog(spark),
                              thinking, tools_mode)
    store = S.read_results(spark, at["results"], tools_mode)
    mine = S.latest_attempts(store.join(keyed.select("cache_key"), "cache_key", "left_semi"))
    mine = mine.join(keyed.select("cache_key", "doc_id"), "cache_key")
    results = TR.normalised_results(mine, R.short_hash(template), verify_thinking)
    verdicts = S.read_verdicts(spark, at["verdicts"], tools_mode) \
        if S.path_exists(spark, at["verdicts"]) else None
    todo = O.pending_verifications(O.verify_eligible(results), verdicts)
    asked = write_phase_table(verify_requests(todo, kept, template), "stream-verify")
    if not asked.isEmpty():
        S.append_verdicts(run_verifier(asked, verify_analyst), at["verdicts"], tools_mode)


def start_tree_triage(spark: SparkSession, root: str, state_dir: str, checkpoint_dir: str,
                      available_now: bool = True, **options) -> StreamingQuery:
    """Stream a directory tree through scan and verification; ``options`` are those of
    ``triage_batch``.  Listings are kept in ``checkpoint_dir``."""
    ship_package(spark)
    stream = tree_stream(spark, root, os.path.join(checkpoint_dir, "listings"), keep_skipped=True)
    # a stream that starts over has a new checkpoint folder and counts from 0 again
    name = hashlib.md5(os.path.abspath(checkpoint_dir).encode()).hexdigest()
    writer = (stream.writeStream
              .foreachBatch(lambda df, n: triage_batch(spark, df, state_dir, n, stream=name,
                                                       **options))
              .option("checkpointLocation", os.path.join(checkpoint_dir, "stream")))
    writer = writer.trigger(availableNow=True) if available_now \
        else writer.trigger(processingTime="30 seconds")
    return writer.start()


def current_files(spark: SparkSession, state_dir: str, tools_mode: str = "off") -> DataFrame:
    """path and content_hash of the files that are there, as the stream last saw them."""
    seen = spark.read.schema(FILES_DDL).parquet(_paths(state_dir)["files"])
    last = seen.where(F.col("tools_mode") == tools_mode).groupBy("path").agg(
        F.max_by("content_hash", F.struct("seen_at", "batch")).alias("content_hash"))
    return last.where("content_hash is not null")


def current_findings(spark: SparkSession, state_dir: str, tools_mode: str = "off",
                     verify_thinking: str = "off", template: str = R.DEFAULT_VERIFY_TEMPLATE,
                     allowlist: DataFrame | None = None,
                     confidence_threshold: str | None = None) -> DataFrame:
    """The bucketed table (finding grain) of the files that are there, with the verdicts of
    just these findings."""
    at = _paths(state_dir)
    files = current_files(spark, state_dir, tools_mode).withColumnRenamed("path", "file")
    stored = S.latest_attempts(S.read_results(spark, at["results"], tools_mode))
    stored = stored.join(files, ["file", "content_hash"], "left_semi") \
        .withColumn("doc_id", F.xxhash64("file"))
    results = TR.normalised_results(stored, R.short_hash(template), verify_thinking)
    lines = O.verdict_lines_from_replies(S.read_verdicts(spark, at["verdicts"], tools_mode)) \
        if S.path_exists(spark, at["verdicts"]) else None
    return TR.bucketed(results, lines, allowlist, confidence_threshold)
