"""Finding normalisation (B16, H5, H8, E3) from stored results.

Stored ``result`` is JSON text: an array of findings, a JSON string holding
such an array, or an error object.  It is parsed once to VARIANT; items
that are strings are re-parsed, non-objects are dropped, ``line`` keeps
its raw text for output and a coerced BIGINT for joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.registry import BLANK_PATTERN, UNSUBSTANTIATED_TAG


def _field(e: Column, name: str, typ: str = "string") -> Column:
    return F.try_variant_get(e, f"$.{name}", typ)


def _type_of(e: Column, name: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant"))


def result_items(result_json: Column) -> Column:
    """``array<variant>`` of object items; NULL when the result is not a list."""
    v = F.try_parse_json(result_json)
    # a result stored as a JSON string holding the array
    v = F.when(F.schema_of_variant(v) == "STRING",
               F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    return object_items(v)


def object_items(v: Column) -> Column:
    """The object items of a VARIANT array (string items re-parsed, others dropped)."""
    items = F.try_variant_get(v, "$", "array<variant>")
    # string items are re-parsed; anything that is not an object is dropped
    items = F.transform(items, lambda e: F.when(F.schema_of_variant(e) == "STRING",
                                                F.try_parse_json(F.try_variant_get(e, "$", "string")))
                        .otherwise(e))
    return F.filter(items, lambda e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT"),
                                                F.lit(False)))


def is_list_result(result_json: Column) -> Column:
    v = F.try_parse_json(result_json)
    v = F.when(F.schema_of_variant(v) == "STRING",
               F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v)
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def finding_struct(e: Column, ord_: Column) -> Column:
    """One variant object -> normalised finding struct."""
    line_type = _type_of(e, "line")
    line_raw = F.when(line_type.isNull() | line_type.isin("BOOLEAN", "NULL", "VOID"), F.lit("")) \
        .otherwise(_field(e, "line"))
    src_is_str = F.coalesce(_type_of(e, "source") == "STRING", F.lit(False))
    sink_is_str = F.coalesce(_type_of(e, "sink") == "STRING", F.lit(False))
    source = _field(e, "source")
    tags = F.coalesce(F.try_variant_get(e, "$.tags", "array<string>"),
                      F.array().cast("array<string>"))
    kept_tags = F.filter(tags, lambda t: t != UNSUBSTANTIATED_TAG)
    named = src_is_str & ~source.rlike(BLANK_PATTERN)
    return F.struct(
        ord_.cast("int").alias("ord"),
        line_raw.alias("line_raw"),
        _field(e, "line", "bigint").alias("line"),
        _field(e, "severity").alias("severity"),
        _field(e, "code").alias("code"),
        _field(e, "explanation").alias("explanation"),
        _field(e, "fix").alias("fix"),
        F.when(src_is_str, source).alias("source"),
        F.when(sink_is_str, _field(e, "sink")).alias("sink"),
        F.when(named, kept_tags).otherwise(F.array_append(kept_tags, F.lit(UNSUBSTANTIATED_TAG)))
         .alias("tags"),
    )


def with_findings(results: DataFrame) -> DataFrame:
    """Store rows + ``findings`` (ordered normalised array) + ``is_list`` flag.

    Stale rows for paths excluded now are dropped (B14).
    """
    items = result_items(F.col("result"))
    findings = F.transform(items, lambda e, i: finding_struct(e, i))
    return (results.where(~P.excluded_path(F.col("file")))
            .withColumn("is_list", is_list_result(F.col("result")))
            .withColumn("findings", F.coalesce(findings, F.array().cast(
                "array<struct<ord:int,line_raw:string,line:bigint,severity:string,code:string,"
                "explanation:string,fix:string,source:string,sink:string,tags:array<string>>>"))))


def explode_findings(results_with_findings: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per finding with its ordinal within the file."""
    cols = keep or ["cache_key", "scanner", "scanner_name", "file", "doc_id", "content_hash",
                    "verify_key", "result_status"]
    cols = [c for c in cols if c in results_with_findings.columns]
    return (results_with_findings.where(~F.col("status").isin("error", "timeout"))
            .select(*cols, F.explode("findings").alias("f"))
            .select(*cols, "f.*"))
