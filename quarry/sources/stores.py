"""Result, verdict and allowlist stores (A5-A10).

The stores are tables, not folders of JSON documents:

* result store  -- Parquet partitioned by ``tools_mode, scanner``; one row per
  attempt ``(cache_key, scanner, scanner_name, file, status, content_hash,
  prompt_hash, thinking, tools_mode, result, attempted_at)``.  Failures are
  kept (the report counts the latest attempt per key); only ``ok`` rows make
  a key reusable.
* verdict store -- same shape keyed by ``verify_key``.
* allowlist     -- ``(pos, scanner, file, line, reason, status, exported_at)``;
  ``pos`` keeps the first-match order.

Appends go through Spark's file commit protocol, which supplies the
atomicity the per-file tmp+move protocol gave the single-machine tool.
Existing per-file JSON caches can be imported with schema-on-read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_COLUMNS = ["cache_key", "scanner", "scanner_name", "file", "status", "content_hash",
                  "prompt_hash", "thinking", "tools_mode", "result"]
#: When an answer was there, and the run and wave that asked for it.
ATTEMPT_DDL = "attempted_at timestamp, run string, wave int"
RESULT_DDL = ", ".join(f"{c} string" for c in RESULT_COLUMNS) + ", " + ATTEMPT_DDL


def _with_attempt(rows: DataFrame, run: str | None, wave: int | None) -> DataFrame:
    at = F.current_timestamp()
    if "attempted_at" in rows.columns:  # taken by the worker when the answer came
        at = F.coalesce("attempted_at", at)
    return rows.withColumn("attempted_at", at).withColumn("run", F.lit(run).cast("string")) \
        .withColumn("wave", F.lit(wave).cast("int"))


def append_results(results: DataFrame, path: str, run: str | None = None,
                   wave: int | None = None) -> None:
    """Append attempts (ok and failed) to the result store."""
    out = _with_attempt(results, run, wave).select(*RESULT_COLUMNS, "attempted_at", "run", "wave")
    out.write.mode("append").partitionBy("tools_mode", "scanner").parquet(path)


def read_results(spark: SparkSession, path: str, tools_mode: str | None = None) -> DataFrame:
    """The store; ``tools_mode`` prunes to one namespace (partition pruning).  Stores
    written before runs and waves were kept have nulls there."""
    df = spark.read.schema(RESULT_DDL).parquet(path)
    return df.where(F.col("tools_mode") == tools_mode) if tools_mode else df


def latest_attempts(store: DataFrame, key: str = "cache_key") -> DataFrame:
    """Q1: one row per key -- its most recent attempt (a fresh failure is visible)."""
    rest = [c for c in store.columns if c != key]
    # of attempts of one time the failed one counts, then the greatest by content
    order = F.struct("attempted_at", F.col("status") != "ok", F.xxhash64(*rest))
    last = store.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last"))
    return last.select(key, "_last.*").select(*store.columns)


def _compacted(store: DataFrame, key: str) -> DataFrame:
    """The latest attempt of each key and namespace, in the order of ``latest_attempts``.
    Files are balanced by bytes, so a hot category has several and a small one few; rows
    are in order of their key, so that a look-up of keys skips row groups."""
    rest = [c for c in store.columns if c != key]
    order = F.struct("attempted_at", F.col("status") != "ok", F.xxhash64(*rest))
    last = store.groupBy(F.col(key).alias("_key"), F.col("tools_mode").alias("_mode")) \
        .agg(F.max_by(F.struct(*store.columns), order).alias("_last")).select("_last.*")
    return last.hint("rebalance", "tools_mode", "scanner") \
        .sortWithinPartitions("tools_mode", "scanner", key)


def compact_results(spark: SparkSession, path: str, target: str) -> None:
    """Write the result store ``path`` anew to ``target`` with the latest attempt of each key
    alone.  What phases and reports read of it is as before; earlier attempts, and with them
    the progress of past waves, are gone.

    ``target`` must not exist, and is whole once its commit is there; the old store stays
    until the caller lets go of it.  Attempts appended meanwhile are not in ``target``, so
    compaction belongs between runs.  An empty store gives an empty one."""
    rows = spark.read.schema(RESULT_DDL).parquet(path)
    _compacted(rows, "cache_key").write.partitionBy("tools_mode", "scanner").parquet(target)


def compact_verdicts(spark: SparkSession, path: str, target: str) -> None:
    """``compact_results`` for the verdict store, by verify key."""
    rows = spark.read.schema(VERDICT_DDL).parquet(path)
    _compacted(rows, "verify_key").write.partitionBy("tools_mode", "scanner").parquet(target)


CACHE_DOC_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("scanner", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("content_hash", T.StringType()),
    T.StructField("prompt_hash", T.StringType()),
    T.StructField("scanned_at", T.StringType()),
    T.StructField("result", T.StringType()),       # raw JSON text of the result value
    T.StructField("_corrupt_record", T.StringType()),
])


def import_json_cache(spark: SparkSession, glob: str, thinking: str = "",
                      tools_mode: str = "off") -> DataFrame:
    """Import per-(category, file) JSON cache documents into the store schema.

    One document per file (``multiLine``); corrupt documents are skipped.
    ``scanner`` in the documents is the category *name*; the id is joined
    from the registry.
    """
    from quarry.functions import keys as K
    from quarry.registry import scanners_df
    docs = (spark.read.schema(CACHE_DOC_SCHEMA).option("multiLine", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
            .json(glob))
    docs = docs.where(F.col("_corrupt_record").isNull() & F.col("file").isNotNull())
    reg = F.broadcast(scanners_df(spark).select("scanner", "scanner_name"))
    j = docs.withColumnRenamed("scanner", "scanner_name").join(reg, "scanner_name")
    return j.select(
        K.scan_key("scanner_name", "file", "content_hash", "prompt_hash", F.lit(thinking))
         .alias("cache_key"),
        "scanner", "scanner_name", "file", F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("content_hash", F.lit("")).alias("content_hash"), "prompt_hash",
        F.lit(thinking).alias("thinking"), F.lit(tools_mode).alias("tools_mode"),
        F.coalesce("result", F.lit("{}")).alias("result"))


ENTRY_SCHEMA = T.StructType([
    T.StructField("scanner", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("line", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("exported_at", T.StringType()),
])
# entries are read as raw JSON text first so a non-object entry cannot
# invalidate the whole document
ALLOWLIST_SCHEMA = T.StructType([
    T.StructField("version", T.LongType()),
    T.StructField("suppressions", T.ArrayType(T.StringType())),
])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reaches."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_allowlist(spark: SparkSession, path: str) -> DataFrame:
    """``{"suppressions": [...]}`` documents -> ordered entries.

    Non-object entries are dropped; a missing file, or one that is no JSON, is an empty
    allowlist.  Any other failure to read is an error: an allowlist is not to be lost
    because a store is out of reach.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], "pos int, scanner string, file string, line string, "
                                         "reason string, status string, exported_at string")
    doc = spark.read.schema(ALLOWLIST_SCHEMA).option("multiLine", True).json(path)
    ex = (doc.select(F.posexplode("suppressions").alias("pos", "s"))
          .where(F.ltrim("s").startswith("{"))
          .select("pos", F.from_json("s", ENTRY_SCHEMA).alias("e")))
    return ex.select(F.col("pos").cast("int"), "e.scanner", "e.file", "e.line", "e.reason",
                     "e.status", "e.exported_at")


def append_candidates(allowlist: DataFrame, candidates: DataFrame) -> DataFrame:
    """A10: the allowlist with new candidate entries after the existing ones.

    New positions follow report order and are strictly increasing (not
    necessarily consecutive): a distributed sort on ``order_key`` followed by
    ``monotonically_increasing_id``, so no single task sees all candidates.
    First-match only needs the order.
    """
    base = allowlist.agg(F.coalesce(F.max("pos"), F.lit(-1)).cast("bigint").alias("base"))
    ordered = candidates.orderBy("order_key").withColumn("_seq", F.monotonically_increasing_id())
    new = (ordered.withColumn("_k", F.lit(1))
           .join(F.broadcast(base.withColumn("_k", F.lit(1))), "_k")
           .select((F.col("base") + 1 + F.col("_seq")).alias("pos"),
                   "scanner", "file", F.col("line").cast("string").alias("line"), "reason",
                   "status", "exported_at"))
    return allowlist.select(F.col("pos").cast("bigint").alias("pos"), "scanner", "file", "line",
                            "reason", "status", "exported_at").unionByName(new)


def write_allowlist(allowlist: DataFrame, path: str, as_document: bool = False) -> None:
    """Write the allowlist.

    Default: a JSON-lines table, one entry per line with its ``pos`` (written
    in parallel, any size).  ``as_document`` writes the human-edited form
    ``{"version": 1, "suppressions": [...]}``: one document, for people, so one task.
    """
    cols = ["pos", "scanner", "file", "line", "reason", "status", "exported_at"]
    if not as_document:
        allowlist.select(*cols).write.mode("overwrite").json(path)
        return
    doc = allowlist.agg(F.lit(1).cast("bigint").alias("version"), F.transform(
        F.array_sort(F.collect_list(F.struct(*cols))),
        lambda s: s.dropFields("pos")).alias("suppressions"))
    doc.coalesce(1).write.mode("overwrite").json(path)


def confirm_candidates(spark: SparkSession, document: str, candidates: str, picks: DataFrame
                       ) -> int:
    """A10: a person's decision on exported candidates: those of ``picks`` (scanner, file,
    line) become confirmed entries from the next run on, in a folder of their own next to the
    candidates; the human document is not touched.  Returns how many were confirmed; picks
    that are no open candidate, or are confirmed already, change nothing."""
    entries = load_run_allowlist(spark, document, candidates)
    line = F.coalesce("line", F.lit("0"))
    chosen = picks.select(F.col("scanner").alias("_s"), F.col("file").alias("_f"),
                          F.coalesce(F.col("line").cast("string"), F.lit("0")).alias("_l")).distinct()
    mine = entries.where("status = 'candidate'").join(
        chosen, (F.col("scanner") == F.col("_s")) & (F.col("file") == F.col("_f"))
        & (line == F.col("_l")), "left_semi")
    found = mine.count()
    if found:
        write_allowlist(mine.withColumn("status", F.lit("confirmed")),
                        f"{candidates}/confirmed-{uuid.uuid4().hex}")
    return found


def merged_allowlist(spark: SparkSession, document: str, candidates: str) -> DataFrame:
    """What ``write_allowlist(..., as_document=True)`` puts next to the human document for
    people to read: its entries and all candidates, confirmed ones as such."""
    return load_run_allowlist(spark, document, candidates)


def load_run_allowlist(spark: SparkSession, document: str, candidates: str) -> DataFrame:
    """The human document's entries, then the candidates that earlier runs exported (one
    folder a run, never overwritten), in first-match order."""
    human = load_allowlist(spark, document).withColumn("pos", F.col("pos").cast("bigint"))
    if not path_exists(spark, candidates):
        return human
    found = load_allowlist_table(spark, f"{candidates}/*")
    # a confirmed candidate is there twice: the confirmed entry counts
    cols = ["pos", "scanner", "file", "line", "reason"]
    last = found.groupBy(*cols).agg(F.max_by(
        F.struct("status", "exported_at"), F.col("status") == "confirmed").alias("_e"))
    return human.unionByName(last.select(*cols, "_e.status", "_e.exported_at"))


def load_allowlist_table(spark: SparkSession, path: str) -> DataFrame:
    """Read the JSON-lines form written by ``write_allowlist``."""
    return spark.read.schema("pos bigint, scanner string, file string, line string, "
                             "reason string, status string, exported_at string").json(path)


# -- verdict store (A8) -------------------------------------------------------

VERDICT_COLUMNS = ["verify_key", "scanner", "file", "status", "result"]
VERDICT_DDL = ", ".join(f"{c} string" for c in (*VERDICT_COLUMNS, "tools_mode")) \
    + ", " + ATTEMPT_DDL


def append_verdicts(verdicts: DataFrame, path: str, tools_mode: str = "off",
                    run: str | None = None, wave: int | None = None) -> None:
    """Append verifier attempts; only ``ok`` rows make a verify key reusable."""
    (_with_attempt(verdicts, run, wave)
     .select(*VERDICT_COLUMNS, F.lit(tools_mode).alias("tools_mode"), "attempted_at", "run", "wave")
     .write.mode("append").partitionBy("tools_mode", "scanner").parquet(path))


def read_verdicts(spark: SparkSession, path: str, tools_mode: str = "off") -> DataFrame:
    """Latest attempt per verify key within one tools-mode namespace."""
    df = spark.read.schema(VERDICT_DDL).parquet(path).where(F.col("tools_mode") == tools_mode)
    return latest_attempts(df, "verify_key")


VERDICT_DOC_DDL = ("file string, scanner string, status string, content_hash string, "
                   "findings_signature string, verify_prompt_hash string, "
                   "verifications map<string,string>, _corrupt_record string")


@F.pandas_udf(T.StringType())
def document_signature(result: pd.Series) -> pd.Series:
    """The signature that verdict documents have of a stored result: a digest of its object
    findings as JSON with sorted keys, escaped non-ASCII and no white space; null for a
    result that is no list."""
    def one(text):
        try:
            found = json.loads(text)
            found = json.loads(found) if isinstance(found, str) else found
        except (TypeError, ValueError, RecursionError):
            return None
        if not isinstance(found, list):
            return None
        items = []
        for f in found:
            try:
                f = json.loads(f) if isinstance(f, str) else f
            except (ValueError, RecursionError):
                continue
            if isinstance(f, dict):
                items.append(f)
        canonical = json.dumps(items, sort_keys=True, separators=(",", ":"))
        return hashlib.md5(canonical.encode()).hexdigest()[:16]
    return result.map(one)


def import_verdict_documents(spark: SparkSession, glob: str, results: DataFrame,
                             thinking: str = "off") -> DataFrame:
    """Verdict documents (one JSON object a file, verdicts by line) as verdict-store rows.

    ``results`` are latest attempts (imported or own).  A document counts for the result of
    its category, file and content hash whose findings have the document's signature; so
    verdicts of files that changed since, and corrupt or failed documents, are left out.
    Keys are those that ``verify_key`` gives for the document's prompt hash."""
    from quarry.functions import keys as K
    from quarry.operators.findings import with_findings
    docs = (spark.read.schema(VERDICT_DOC_DDL).option("multiLine", True)
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(glob))
    docs = docs.where(F.col("_corrupt_record").isNull() & (F.col("status") == "ok")
                      & F.col("verifications").isNotNull())
    docs = docs.select(F.col("file").alias("_f"), F.col("scanner").alias("_s"),
                       F.col("content_hash").alias("_c"), "findings_signature",
                       "verify_prompt_hash", "verifications")
    ok = with_findings(results.where("status = 'ok'")).withColumn(
        "_sig", document_signature("result"))
    met = ok.join(docs, (F.col("file") == F.col("_f")) & (F.col("scanner_name") == F.col("_s"))
                  & (F.col("content_hash") == F.col("_c"))
                  & (F.col("_sig") == F.col("findings_signature")))
    key = K.verify_key("scanner_name", "file", "content_hash", K.findings_signature("findings"),
                       F.col("verify_prompt_hash"), F.lit(thinking))
    # {"7": {...}} -> [{"line": 7, ...}]; the line of the key counts
    items = F.transform(F.map_entries("verifications"), lambda e: F.concat(
        F.lit('{"line":'), e["key"].cast("bigint").cast("string"),
        F.when(F.trim(e["value"]).rlike(r"^\{\s*\}$"), F.lit("")).otherwise(F.lit(",")),
        F.trim(e["value"]).substr(F.lit(2), F.length(F.trim(e["value"])))))
    sure = F.filter(F.map_entries("verifications"), lambda e: F.coalesce(
        e["key"].try_cast("bigint").isNotNull() & F.trim(e["value"]).startswith("{"), F.lit(False)))
    met = met.withColumn("verifications", F.map_from_entries(sure))
    return met.select(key.alias("verify_key"), "scanner", "file", F.lit("ok").alias("status"),
                      F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")).alias("result"))


# -- discovery store (A5) -----------------------------------------------------

def save_discovery(plan: DataFrame, path: str, tools_mode: str = "off") -> None:
    """Overwrite the discovery plan ``(scanner, pos, ext)`` of one tools-mode namespace."""
    (plan.select("scanner", "pos", "ext").withColumn("tools_mode", F.lit(tools_mode))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("tools_mode").parquet(path))


def load_discovery(spark: SparkSession, path: str, tools_mode: str = "off",
                   redetect: bool = False) -> DataFrame | None:
    """The stored plan, or None when it must be (re)detected: ``redetect``,
    missing, unreadable or empty."""
    if redetect or not path_exists(spark, path):
        return None
    try:
        df = spark.read.parquet(path).where(F.col("tools_mode") == tools_mode) \
            .select("scanner", "pos", "ext")
    except AnalysisException as e:  # a folder without a table in it
        if e.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
            raise
        return None
    return None if df.isEmpty() else df
