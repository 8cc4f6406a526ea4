"""The incremental scan as a Structured Streaming job.

New or edited files arrive as rows ``(doc_id, path, text)`` in a corpus
table folder.  Each micro-batch is keyed (content, prompt and thinking
addressed), anti-joined against the successful results already in the
store, analysed, and appended to the store.  Because the append is keyed,
a replayed micro-batch (after a driver or executor failure) writes
nothing twice: effectively-once without a transactional sink.  Failed
attempts are appended too and retried next time (only ``ok`` rows count).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators import analysts as A
from quarry.operators import targets as TG
from quarry.operators.filters import kept_files
from quarry.registry import DEFAULT_MAX_FILE_SIZE
from quarry.sources.corpus import corpus_from_table
from quarry.sources.source_tree import tree_stream
from quarry.sources.stores import RESULT_DDL, append_results, path_exists, read_results

CORPUS_DDL = "doc_id bigint, path string, text string"


def scan_batch(spark: SparkSession, batch: DataFrame, store_dir: str, epoch_id: int,
               rules: list[A.Rule] | None = None, thinking: str = "off",
               max_file_size: int = DEFAULT_MAX_FILE_SIZE,
               analyst: A.AnalystFn | None = None, tools_mode: str = "off") -> None:
    """One micro-batch: key, skip what the store already has in the ``tools_mode`` namespace
    (attempts of other namespaces neither count nor re-open anything), analyse, append to the
    result store that batch runs read.

    ``analyst`` (pandas callable) replaces the native rule analyst; it sees
    ``cache_key, prompt, scanner, text`` per pending pair.
    """
    corpus = corpus_from_table(batch, "path", "text", doc_id="doc_id")
    kept = kept_files(corpus, max_file_size)
    ei, ni = TG.registry_maps()
    catalog = TG.prompt_catalog(spark)
    fanned = TG.fan_out(kept, ei, ni)
    store = read_results(spark, store_dir, tools_mode) if path_exists(spark, store_dir) else None
    if analyst is not None:
        from quarry.operators.inference import run_scanner, scan_requests, scan_requests_all
        keyed = TG.with_scan_keys(TG.scan_targets(fanned), catalog, thinking, tools_mode)
        if store is not None:
            keys = keyed.select("cache_key")
            done = TG.usable(store.join(keys, "cache_key", "left_semi"))
            reqs = scan_requests(keyed.join(done, "cache_key", "left_anti"), kept, catalog,
                                 keep_content=True)
        else:
            reqs = scan_requests_all(fanned, catalog, thinking, tools_mode, keep_content=True)
        results = run_scanner(reqs, analyst, columns=("cache_key", "prompt", "scanner", "text"))
        append_results(results.withColumn("tools_mode", F.lit(tools_mode))
                       .withColumn("thinking", F.lit(thinking)), store_dir)
        return
    if store is not None:
        keyed = TG.with_scan_keys(TG.scan_targets(fanned), catalog, thinking, tools_mode)
        # the store is restricted to this batch's keys first; Spark broadcasts them if they
        # are small, so the store's key column is scanned in place
        keys = keyed.select("cache_key")
        done = TG.usable(store.join(keys, "cache_key", "left_semi"))
        pending = keyed.join(done, "cache_key", "left_anti")
        # analyse only the pending (category, file) pairs of each file
        todo = pending.groupBy("doc_id").agg(F.collect_set("scanner").alias("_pending"))
        fanned = (fanned.join(todo, "doc_id")
                  .withColumn("scanners", F.array_intersect("scanners", "_pending"))
                  .drop("_pending"))
    append_results(A.rule_results(fanned, catalog, rules, thinking, tools_mode), store_dir)


def start_incremental_scan(spark: SparkSession, corpus_dir: str, store_dir: str,
                           checkpoint_dir: str, rules: list[A.Rule] | None = None,
                           thinking: str = "off", available_now: bool = True,
                           max_files_per_trigger: int | None = None,
                           analyst: A.AnalystFn | None = None,
                           tools_mode: str = "off") -> StreamingQuery:
    """Stream the corpus folder into the result store (``foreachBatch`` sink)."""
    from quarry.session import ship_package
    ship_package(spark)
    reader = spark.readStream.schema(CORPUS_DDL)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _scan_stream(spark, reader.parquet(corpus_dir), store_dir, checkpoint_dir, rules,
                        thinking, available_now, analyst, tools_mode)


def start_tree_scan(spark: SparkSession, root: str, store_dir: str, checkpoint_dir: str,
                    rules: list[A.Rule] | None = None, thinking: str = "off",
                    available_now: bool = True, analyst: A.AnalystFn | None = None,
                    tools_mode: str = "off") -> StreamingQuery:
    """Stream a directory tree into the result store: each micro-batch has the files that
    were added or changed since the last.  Listings are kept in ``checkpoint_dir``."""
    stream = tree_stream(spark, root, os.path.join(checkpoint_dir, "listings"))
    return _scan_stream(spark, stream.select("doc_id", "path", "text"), store_dir,
                        os.path.join(checkpoint_dir, "stream"), rules, thinking, available_now,
                        analyst, tools_mode)


def _scan_stream(spark: SparkSession, stream: DataFrame, store_dir: str, checkpoint_dir: str,
                 rules: list[A.Rule] | None, thinking: str, available_now: bool,
                 analyst: A.AnalystFn | None, tools_mode: str) -> StreamingQuery:
    writer = (stream.writeStream
              .foreachBatch(lambda df, eid: scan_batch(spark, df, store_dir, eid, rules,
                                                       thinking, analyst=analyst,
                                                       tools_mode=tools_mode))
              .option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if available_now \
        else writer.trigger(processingTime="30 seconds")
    return writer.start()


def start_progress(spark: SparkSession, store_dir: str, out_dir: str,
                   checkpoint_dir: str) -> StreamingQuery:
    """Running completed-attempt counts per (run, category, status) with the first and
    last time at which an answer was there, in update mode over the committed waves: each
    micro-batch appends the counts that changed, with its number, to ``out_dir``."""
    s = spark.readStream.schema(RESULT_DDL).parquet(store_dir)
    counts = s.groupBy("run", "scanner", "status").agg(
        F.count(F.lit(1)).alias("completed"), F.min("attempted_at").alias("first_at"),
        F.max("attempted_at").alias("last_at"))

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("bigint")) \
            .write.mode("append").parquet(out_dir)
    return (counts.writeStream.outputMode("update").foreachBatch(append)
            .option("checkpointLocation", os.path.join(checkpoint_dir, "progress"))
            .trigger(availableNow=True).start())
