"""Discovery (I3, C8, H11, D1-D3): profile the corpus, ask an analyst once which
extensions each category should scan, and normalise the answer.

The profile is three aggregates of the kept corpus (extension counts,
notable build files, directory prefixes up to depth 3).  The reply is a
JSON object ``{category: [extensions]}`` parsed with the object recovery
tiers; the plan is ``(scanner, pos, ext)`` = discovered extensions (strings
only, leading dot added) followed by the category's base extensions,
de-duplicated in first-seen order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry as R


def extension_counts(kept: DataFrame) -> DataFrame:
    """Files per extension (map-side partial counts)."""
    return kept.groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def notable_files(kept: DataFrame) -> DataFrame:
    """Well-known build / manifest files with their paths."""
    return kept.where(F.col("name").isin(R.NOTABLE_FILES)).select("name", "path")


def directory_profile(kept: DataFrame, depth: int = R.PROFILE_DEPTH) -> DataFrame:
    """D3: directory prefixes up to ``depth`` levels with the number of files under them."""
    d = F.explode(F.sequence(F.lit(1), F.least(F.lit(depth), F.size("parts") - 1)))
    pref = kept.select(F.split("path", "/").alias("parts")).where(F.size("parts") > 1) \
        .select("parts", d.alias("depth"))
    return (pref.select(F.col("depth").cast("bigint").alias("depth"),
                        F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("dir"))
            .groupBy("depth", "dir").agg(F.count(F.lit(1)).alias("files")))


def repo_structure(kept: DataFrame) -> DataFrame:
    """The discovery prompt's corpus profile as a one-row DataFrame.

    It lists, one item a line and sorted: ``ext<TAB>suffix<TAB>files``, the most frequent
    first, ``build<TAB>basename<TAB>files`` and ``dir<TAB>path<TAB>files`` for directories of
    the profile's depth.  Counts come from map-side aggregates; the text has a line for each
    suffix, known build file and directory, not for each file.
    """
    line = lambda kind, name: F.concat_ws("\t", F.lit(kind), F.col(name),
                                          F.col("files").cast("string"))
    builds = notable_files(kept).groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    items = extension_counts(kept).select(F.lit(0).alias("k"), (-F.col("files")).alias("n"),
                                          line("ext", "ext").alias("line"))
    items = items.unionByName(builds.select(F.lit(1).alias("k"), F.lit(0).cast("bigint").alias("n"),
                                            line("build", "name").alias("line")))
    items = items.unionByName(directory_profile(kept).select(
        F.lit(2).alias("k"), F.lit(0).cast("bigint").alias("n"), line("dir", "dir").alias("line")))
    return items.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("k", "n", "line"))), lambda s: s["line"]), "\n")
        .alias("profile"))


def rule_discovery_reply(spark: SparkSession, kept: DataFrame) -> DataFrame:
    """Deterministic discovery analyst: for each category, the registry extensions
    that actually occur in the corpus, most frequent first, as a JSON object reply."""
    pairs = [(s.id, e) for s in R.scanners() for e in dict.fromkeys(s.base_ext)]
    reg = spark.createDataFrame(pairs, "scanner string, ext string")
    counts = extension_counts(kept)
    hits = reg.join(counts, "ext")
    per = (hits.groupBy("scanner")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("files")).alias("neg"),
                                                                  F.col("ext")))),
                            lambda s: s["ext"]).alias("exts")))
    obj = per.agg(F.map_from_entries(F.collect_list(F.struct("scanner", "exts"))).alias("m"))
    return obj.select(F.to_json("m").alias("raw"))


def discovery_plan(spark: SparkSession, reply: DataFrame) -> DataFrame:
    """Normalise a discovery reply ``raw`` (JSON object text) to
    ``(scanner, pos, ext)``; an unusable reply falls back to the base lists."""
    from quarry.operators.responses import recover_object
    v = reply.select(recover_object(F.col("raw")).alias("v"))
    cols = []
    for s in R.scanners():
        raw = F.try_variant_get("v", f"$.{s.id}", "array<variant>")
        strs = F.filter(F.coalesce(raw, F.array().cast("array<variant>")),
                        lambda e: F.coalesce(F.schema_of_variant(e) == "STRING", F.lit(False)))
        exts = F.transform(strs, lambda e: F.try_variant_get(e, "$", "string"))
        exts = F.transform(exts, lambda e: F.when(e.startswith("."), e)
                           .otherwise(F.concat(F.lit("."), e)))
        base = F.array(*[F.lit(e) for e in s.base_ext])
        cols.append(F.struct(F.lit(s.id).alias("scanner"),
                             F.array_distinct(F.concat(exts, base)).alias("exts")))
    per = v.select(F.explode(F.array(*cols)).alias("c")).select("c.scanner", "c.exts")
    return per.select("scanner", F.posexplode("exts").alias("pos", "ext")) \
        .select("scanner", F.col("pos").cast("int").alias("pos"), "ext")

