"""Category fan-out, scan keys and the incremental work plan.

The fan-out never joins file content against categories: a file's
categories are looked up through two tiny, broadcast indexes (extension ->
categories, basename -> categories) and kept as an array next to the
content, so the scan phase needs no shuffle.  Only when keys are compared
with the result store do 32-char keys cross a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import registry as R
from quarry.functions import keys as K
from quarry.sources.stores import path_exists

INDEX_SCHEMA = T.StructType([
    T.StructField("key", T.StringType(), False),
    T.StructField("scanners", T.ArrayType(T.StringType()), False),
])


def normalize_ext(ext: str) -> str:
    """Extensions from discovery / overrides: trimmed, lower-cased, leading dot."""
    e = ext.strip().lower()
    return e if e.startswith(".") else f".{e}"


def parse_scanner_selection(spec: str | None, known: list[str] | None = None) -> list[str]:
    """B10: 'all'/None -> every category; else split, trim, upper, validate.  ``known`` are
    the categories in their order, by default the built-in ones."""
    known = list(R.SCANNER_IDS) if known is None else known
    if spec is None or spec.strip().lower() in ("", "all"):
        return known
    ids = {p.strip().upper() for p in spec.split(",") if p.strip()}
    of = {k.upper(): k for k in known}
    unknown = sorted(i for i in ids if i not in of)
    if unknown:
        raise ValueError(f"unknown scanner id(s): {', '.join(unknown)}")
    return [k for k in known if k.upper() in ids]


def registry_maps(scanner_ids: list[str] | None = None,
                  format_override: list[str] | None = None
                  ) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """(extension -> categories, basename -> categories) from the registry (fixed size).

    ``format_override`` replaces every selected category's extensions and
    disables the basename matches (B9).
    """
    ids = scanner_ids or list(R.SCANNER_IDS)
    ext_map: dict[str, list[str]] = {}
    name_map: dict[str, list[str]] = {}
    for s in R.scanners():
        if s.id not in ids:
            continue
        exts = [normalize_ext(e) for e in format_override] if format_override else \
            list(s.base_ext)
        for e in exts:
            ext_map.setdefault(e, [])
            if s.id not in ext_map[e]:
                ext_map[e].append(s.id)
        if not format_override:
            for n in s.base_names:
                name_map.setdefault(n, [])
                if s.id not in name_map[n]:
                    name_map[n].append(s.id)
    return ext_map, name_map


def discovery_ext_index(discovery: DataFrame) -> DataFrame:
    """Ext index from a discovery plan ``(scanner, pos, ext)`` (C8 output): a row an
    extension, which Spark broadcasts or shuffles by its measured size."""
    return (discovery.groupBy(F.col("ext").alias("key"))
            .agg(F.array_sort(F.collect_set("scanner")).alias("scanners")))


def _map_literal(m: dict[str, list[str]]):
    if not m:
        return F.create_map().cast("map<string,array<string>>")
    return F.create_map(*[x for k, v in sorted(m.items())
                          for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])


def fan_out(files: DataFrame, ext_index, name_index) -> DataFrame:
    """Attach ``scanners``: the categories that select each file (ext ∪ basename).

    With the fixed registry (dicts) the lookup is a literal map inside the
    scan's projection -- no join, no extra job.  A discovery-derived index
    (DataFrame) is joined.
    """
    empty = F.array().cast("array<string>")
    if isinstance(ext_index, dict) and isinstance(name_index, dict):
        es = F.coalesce(F.try_element_at(_map_literal(ext_index), F.col("ext")), empty)
        ns = F.coalesce(F.try_element_at(_map_literal(name_index), F.col("name")), empty)
        return files.withColumn("scanners", F.array_distinct(F.concat(es, ns)))
    if isinstance(name_index, dict):
        rows = sorted(name_index.items())
        name_index = F.broadcast(files.sparkSession.createDataFrame(rows or [], INDEX_SCHEMA))
    ei = ext_index.select(F.col("key").alias("ext"), F.col("scanners").alias("_es"))
    # an index of proven size comes with a hint; of another, Spark knows the size of its files
    ni = name_index.select(F.col("key").alias("name"), F.col("scanners").alias("_ns"))
    empty = F.array().cast("array<string>")
    return (files.join(ei, "ext", "left").join(ni, "name", "left")
            .withColumn("scanners", F.array_distinct(F.concat(F.coalesce("_es", empty),
                                                               F.coalesce("_ns", empty))))
            .drop("_es", "_ns"))


def prompt_catalog(spark: SparkSession, templates: dict[str, str] | None = None,
                   prompt_dir: str | None = None) -> DataFrame:
    """A4: ``(scanner, scanner_name, scanner_label, ord, template, prompt_hash)``.

    Templates come from ``<prompt_dir>/<scanner_name>.txt`` when present
    (read as whole-text files), else from ``templates``, else the built-in
    default.
    """
    rows = []
    for s in R.scanners():
        t = (templates or {}).get(s.id) or R.default_prompt_template(s.id)
        rows.append((s.id, s.name, s.label, s.ord, t))
    base = spark.createDataFrame(
        rows, "scanner string, scanner_name string, scanner_label string, ord int, "
              "default_template string")
    found = [f"{prompt_dir.rstrip('/')}/{s.name}.txt" for s in R.scanners()] if prompt_dir else []
    found = [path for path in found if path_exists(spark, path)]
    if found:
        # a category that has no template keeps the built-in text
        name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.txt$", 1)
        files = spark.read.text(found, wholetext=True).select(
            F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("scanner_name"),
            F.col("value").alias("file_template"))
        base = base.join(files, "scanner_name", "left")
        tmpl = F.coalesce("file_template", "default_template")
    else:
        tmpl = F.col("default_template")
    return base.select("scanner", "scanner_name", "scanner_label", "ord",
                       tmpl.alias("template"), K.prompt_hash(tmpl).alias("prompt_hash"))


def scan_targets(fanned: DataFrame) -> DataFrame:
    """One row per (category, file) without content.

    The content hash is computed once per file, before the category explode,
    and the text is dropped before any row is multiplied.
    """
    per_file = fanned.select("doc_id", "path", "size", "scanners",
                             K.content_hash("text").alias("content_hash"))
    return per_file.select("doc_id", "path", "size", F.explode("scanners").alias("scanner"),
                           "content_hash")


def with_scan_keys(targets: DataFrame, catalog: DataFrame, thinking: str = "off",
                   tools_mode: str = "off") -> DataFrame:
    """Add ``cache_key`` (content, prompt and thinking addressed)."""
    cat = F.broadcast(catalog.select("scanner", "scanner_name", "prompt_hash"))
    return (targets.join(cat, "scanner")
            .withColumn("thinking", F.lit(thinking))
            .withColumn("tools_mode", F.lit(tools_mode))
            .withColumn("cache_key", K.scan_key("scanner_name", "path", "content_hash",
                                                "prompt_hash", "thinking")))


def usable(store: DataFrame) -> DataFrame:
    """Keys whose latest attempt succeeded; a later failure takes a key back."""
    return latest_status(store).where(F.col("status") == "ok").select("cache_key")


def latest_status(store: DataFrame) -> DataFrame:
    """cache_key and the status of its latest attempt (of attempts of one time, the
    failed one), combined map-side; a store without times counts as one attempt a key."""
    at = F.col("attempted_at") if "attempted_at" in store.columns else F.lit(0)
    return store.groupBy("cache_key").agg(
        F.max_by("status", F.struct(at, F.col("status") != "ok")).alias("status"))


def pending_scans(keyed: DataFrame, store: DataFrame | None, rescan: bool = False) -> DataFrame:
    """Targets with no reusable result (``rescan`` ignores the store)."""
    if rescan or store is None:
        return keyed
    return keyed.join(usable(store), "cache_key", "left_anti")


def work_plan(keyed: DataFrame, store: DataFrame | None,
              scanner_ids: list[str] | None = None) -> DataFrame:
    """Total / cached / pending per category with its batch index i of N
    (numeric category order over the selected categories)."""
    if store is None:
        flagged = keyed.withColumn("hit", F.lit(False))
    else:
        hits = usable(store).withColumn("hit", F.lit(True))
        flagged = keyed.join(hits, "cache_key", "left")
    ids = sorted(scanner_ids or R.SCANNER_IDS, key=R.scanner_ord)
    batch = F.create_map(*[x for i, sid in enumerate(ids, 1) for x in (F.lit(sid), F.lit(i))])
    return (flagged.groupBy("scanner")
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.coalesce("hit", F.lit(False))).alias("cached"),
                 F.count_if(~F.coalesce("hit", F.lit(False))).alias("pending"))
            .withColumn("batch", F.element_at(batch, F.col("scanner")).cast("bigint"))
            .withColumn("batches", F.lit(len(ids)).cast("bigint")))


def scan_sample(pending: DataFrame, n: int) -> DataFrame:
    """First ``n`` pending files per category in path order (top-k per group)."""
    order = ("path", "doc_id")
    # a first round in 64 parts a category, so that no task sorts a whole category
    part = F.pmod(F.xxhash64("cache_key"), F.lit(64))
    first = pending.withColumn("_part", part)
    w = Window.partitionBy("scanner", "_part").orderBy(*order)
    first = first.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    w = Window.partitionBy("scanner").orderBy(*order)
    return first.drop("_part", "_r").withColumn("rank", F.row_number().over(w)) \
        .where(F.col("rank") <= n)


def retry_set(keyed: DataFrame, store: DataFrame) -> DataFrame:
    """Targets whose latest stored attempt failed (they are pending again)."""
    failed = latest_status(store).where(F.col("status").isin("error", "timeout"))
    return keyed.join(failed.select("cache_key"), "cache_key", "left_semi")
