"""The triage world derived from the driver tables.

``documents`` becomes a repository corpus, the rule analyst scans it,
``labels`` play the verifier (toxic -> refuted, quality 0 -> legacy record
without a verdict, else confirmed) and a small human allowlist is applied.
Every DataFrame here is lazy and grows with the input tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry as R
from quarry.operators import analysts as A
from quarry.operators import filters as FL
from quarry.operators import overlay as O
from quarry.operators import targets as TG
from quarry.operators.suppress import ALLOWLIST_DDL
from quarry.plans import triage as TR
from quarry.plans.waves import wave_of
from quarry.session import ship_package, write_phase_table
from quarry.sources import corpus as C

VERIFY_PROMPT_HASH = R.short_hash(R.DEFAULT_VERIFY_TEMPLATE)

# Human allowlist of the world: overlapping entries exercise first-match
# order, wildcards, whole-file lines and a candidate that must not match.
WORLD_ALLOWLIST = [
    (0, "B9", "*", "0", "mail ok", "confirmed"),
    (1, "*", "src/en/src0/d460/.env", "1", "exact", "confirmed"),
    (2, "B6", "*", "1", "first line", "candidate"),
    (3, "B3", "*", "2", "line 2", "confirmed"),
    (4, "*", "*", "2", "any line 2", "confirmed"),
]

FAILING = ("B4",)
WAVES = 8
CONFIDENCES = ["High", "Medium", "Low", "Unknown"]
EXPLOITABLE = ["yes", "no", "conditional"]


class World:
    def __init__(self, spark: SparkSession, sf_dir: str,
                 max_file_size: int = R.DEFAULT_MAX_FILE_SIZE, thinking: str = "off",
                 confidence_threshold: str | None = "medium",
                 rules: list[A.Rule] | None = None, materialized: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.max_file_size = max_file_size
        self.thinking = thinking
        self.confidence_threshold = confidence_threshold
        self.rules = rules or A.DEFAULT_RULES
        self.materialized = materialized

    def table(self, name: str) -> DataFrame:
        return C.read_table(self.spark, self.sf_dir, name)

    @cached_property
    def corpus(self) -> DataFrame:
        return C.documents_corpus(self.spark, self.sf_dir)

    @cached_property
    def labelled(self) -> DataFrame:
        return FL.label_corpus(self.corpus, self.max_file_size)

    @cached_property
    def kept(self) -> DataFrame:
        return self.labelled.where(F.col("skip_reason").isNull()).drop("skip_reason")

    @cached_property
    def indexes(self) -> tuple[dict, dict]:
        return TG.registry_maps()

    @cached_property
    def fanned(self) -> DataFrame:
        ei, ni = self.indexes
        return TG.fan_out(self.kept, ei, ni)

    @cached_property
    def catalog(self) -> DataFrame:
        return TG.prompt_catalog(self.spark)

    @cached_property
    def keyed(self) -> DataFrame:
        """The work list: one keyed row per (category, file), no content."""
        return self.materialize(
            TG.with_scan_keys(TG.scan_targets(self.fanned), self.catalog, self.thinking),
            "work_list")

    def materialize(self, df: DataFrame, name: str) -> DataFrame:
        """Phase boundary: write ``df`` as a Parquet table in the shared checkpoint
        folder and read it back.

        Later phases (and every report section) read the written table --
        with column pruning and filter pushdown -- instead of recomputing its
        lineage; a lost executor re-reads files, it does not re-run the scan.
        """
        if not self.materialized:
            return df
        return write_phase_table(df, name)

    @cached_property
    def results(self) -> DataFrame:
        """The result store of this run: the rule analyst over every target.  Attempts of
        ``FAILING`` categories fail for files that ``labels`` calls toxic, so that error
        rows exist; these categories have no rules, so no finding is lost."""
        found = A.rule_results(self.fanned, self.catalog, self.rules, self.thinking)
        toxic = self.table("labels").where("toxic = 1").select("doc_id").distinct()
        return self.materialize(A.fail_attempts(found, toxic, FAILING, "analyst not available"),
                                "result_store")

    @cached_property
    def attempts(self) -> DataFrame:
        """The result store with its run, waves and completion times: the time of a file's
        answers is that of the event of the same number (none: not answered yet)."""
        times = self.table("events").select(F.col("event_id").alias("_event"),
                                            F.col("ts").alias("attempted_at"))
        return self.results.join(times, F.col("doc_id") == F.col("_event"), "left") \
            .withColumn("run", F.lit("this")).withColumn("wave", wave_of(F.col("file"), WAVES))

    @cached_property
    def results_n(self) -> DataFrame:
        return TR.normalised_results(self.results, VERIFY_PROMPT_HASH, self.thinking)

    @cached_property
    def verdict_store(self) -> DataFrame:
        """Verifier replies for labelled files: one JSON array per (category, file)."""
        labels = self.table("labels").select("doc_id", "quality", "toxic")
        r = (self.results_n.where(~F.col("status").isin("error", "timeout")
                                  & (F.size("findings") > 0))
             .join(labels, "doc_id"))
        conf_arr = F.array(*[F.lit(c) for c in CONFIDENCES])
        expl_arr = F.array(*[F.lit(e) for e in EXPLOITABLE])

        def entry(f):
            k = F.col("doc_id") + f["line"]
            reason = F.concat(F.lit("line "), f["line"].cast("string"),
                              F.when(F.col("toxic") == 1, F.lit(": input is constant"))
                              .otherwise(F.lit(": reachable from input")))
            fields = [f["line"].alias("line"),
                      F.get(conf_arr, (k % 4).cast("int")).alias("confidence"),
                      F.get(expl_arr, (k % 3).cast("int")).alias("exploitable"),
                      reason.alias("verification_reason")]
            verdict = F.when(F.col("toxic") == 1, F.lit("refuted")) \
                .when(F.col("quality") == 0, F.lit(None).cast("string")) \
                .otherwise(F.lit("confirmed"))
            return F.struct(*fields, verdict.alias("verdict"))
        entries = F.transform(F.filter("findings", lambda f: f["line"].isNotNull()), entry)
        return r.select("verify_key", "scanner", "file", F.lit("ok").alias("status"),
                        F.to_json(entries).alias("result"))

    @cached_property
    def verdict_lines(self) -> DataFrame:
        return O.verdict_lines_from_replies(self.verdict_store)

    @cached_property
    def allowlist(self) -> DataFrame:
        return self.spark.createDataFrame(WORLD_ALLOWLIST, ALLOWLIST_DDL)

    @cached_property
    def bucketed(self) -> DataFrame:
        return self.materialize(TR.bucketed(self.results_n, self.verdict_lines, self.allowlist,
                                            self.confidence_threshold), "bucketed")

    @cached_property
    def files(self) -> DataFrame:
        return TR.file_grain(self.results_n, self.bucketed)

    # -- analyst replies ---------------------------------------------------

    @cached_property
    def responses(self) -> DataFrame:
        """Model-style replies per (category, file): the findings JSON wrapped six
        ways (bare, fenced, leading prose, trailing prose, truncated, prose-only)."""
        js = F.col("reply")
        d = F.col("doc_id") % 6
        raw = (F.when(d == 0, js)
               .when(d == 1, F.concat(F.lit("```json\n"), js, F.lit("\n```")))
               .when(d == 2, F.concat(F.lit("Here: "), js))
               .when(d == 3, F.concat(js, F.lit(" done")))
               .when(d == 4, F.expr("substring(reply, 1, length(reply) - 1)"))
               .otherwise(F.lit("No vulnerabilities found.")))
        ok = F.col("status") == "ok"
        return self.results.select("cache_key", "scanner", "file", "doc_id", "status",
                                   F.when(ok, raw).otherwise(F.lit("")).alias("raw"))

    @cached_property
    def parsed(self) -> DataFrame:
        from quarry.operators.responses import parse_responses
        return parse_responses(self.responses)


_WORLDS: dict[tuple, World] = {}


def _state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, times and sizes of the tables in a folder: a changed table is a new world."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen())
                        for f in fs.listStatus(path)))


def world_for(spark: SparkSession, sf_dir: str) -> World:
    """One world per (live session, input folder as it is): its phase tables are written
    once and every query of the session reads them."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"),
           _state_of(spark, sf_dir))
    w = _WORLDS.get(key)
    if w is None:
        ship_package(spark)
        w = _WORLDS[key] = World(spark, sf_dir)
    return w
