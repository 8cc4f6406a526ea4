"""Allowlist suppression (C5, H7, E4) and candidate export.

An allowlist entry ``(pos, scanner, file, line, reason, status)`` matches a
finding when scanner and file are equal or ``*``, and line is 0/NULL
(whole file) or equal to the finding's integer line.  Candidate entries
never match; the first matching entry in allowlist order wins.

Strategy: split the active entries by wildcard mask (which of scanner /
file / line are wildcards -- at most 8 masks).  Within a mask the match is
an equi-join on the non-wildcard columns, so each mask is one hash join
against a per-key ``min(pos)`` table; the first match is ``least`` over the
masks.  Findings are never shuffled when the allowlist fits the broadcast
bound, and the plan stays a set of equi-joins when it does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.registry import SCANNER_IDS

ALLOWLIST_DDL = "pos int, scanner string, file string, line string, reason string, status string"


def normalize_allowlist(allowlist: DataFrame) -> DataFrame:
    """Active entries with wildcard flags and an integer line (0 = whole file).

    A missing scanner/file means ``*``; a line that is not an integer (and
    not blank) can match nothing and is dropped.
    """
    line_s = F.trim(F.col("line").cast("string"))
    line_i = F.when(line_s.isNull() | (line_s == ""), F.lit(0).cast("bigint")) \
        .otherwise(F.coalesce(line_s.try_cast("bigint"),
                              line_s.try_cast("double").try_cast("bigint")))
    return (allowlist
            .where(F.col("status").isNull() | (F.col("status") != "candidate"))
            .select("pos",
                    F.coalesce("scanner", F.lit("*")).alias("a_scanner"),
                    F.coalesce("file", F.lit("*")).alias("a_file"),
                    line_i.alias("a_line"),
                    F.col("reason").alias("a_reason"))
            .where(F.col("a_line").isNotNull())
            .withColumn("ms", F.col("a_scanner") == "*")
            .withColumn("mf", F.col("a_file") == "*")
            .withColumn("ml", F.col("a_line") == 0))


def first_match(findings: DataFrame, allowlist: DataFrame,
                scanner_col: str = "scanner", file_col: str = "file", line_col: str = "line",
                scanners: list[str] | None = None) -> DataFrame:
    """Add ``suppression_pos`` and ``suppression_reason`` (NULL when nothing matches).

    One equi-join for each wildcard mask that occurs (at most 8), each with the first
    entry, position and reason together, of its key.  Entries that name only one of the
    ``scanners`` (default: the built-in categories) are at most one each, so that side is broadcast; Spark decides on the others by
    their measured sizes."""
    entries = normalize_allowlist(allowlist)
    masks = [tuple(r) for r in entries.select("ms", "mf", "ml").distinct().collect()]  # <= 8
    out = findings
    firsts: list[Column] = []
    entry = F.min(F.struct("pos", F.col("a_reason").alias("reason")))
    for k, (ms, mf, ml) in enumerate(sorted(masks)):
        keys: list[tuple[str, str]] = []
        if not ms:
            keys.append(("a_scanner", scanner_col))
        if not mf:
            keys.append(("a_file", file_col))
        if not ml:
            keys.append(("a_line", line_col))
        part = entries.where((F.col("ms") == ms) & (F.col("mf") == mf) & (F.col("ml") == ml))
        name = f"_sp{k}"
        if not keys:
            # wildcard on all three: one global first entry (a single row)
            glob = part.agg(entry.alias(name)).withColumn("_one", F.lit(1))
            out = (out.withColumn("_one", F.lit(1))
                   .join(F.broadcast(glob), "_one", "left").drop("_one"))
        else:
            tbl = part.groupBy(*[F.col(a).alias(f"_k{k}_{a}") for a, _ in keys]) \
                .agg(entry.alias(name))
            if [a for a, _ in keys] == ["a_scanner"]:
                tbl = F.broadcast(tbl.where(F.col(f"_k{k}_a_scanner").isin(
                    *(SCANNER_IDS if scanners is None else scanners))))
            cond = [F.col(f) == F.col(f"_k{k}_{a}") for a, f in keys]
            out = out.join(tbl, cond, "left").drop(*[f"_k{k}_{a}" for a, _ in keys])
        firsts.append(F.col(name))
    if not firsts:
        return (findings.withColumn("suppression_pos", F.lit(None).cast("int"))
                .withColumn("suppression_reason", F.lit(None).cast("string")))
    first = F.least(*firsts) if len(firsts) > 1 else firsts[0]
    return out.withColumn("_first", first) \
        .withColumn("suppression_pos", F.col("_first.pos")) \
        .withColumn("suppression_reason", F.col("_first.reason")) \
        .drop("_first", *[f"_sp{k}" for k in range(len(firsts))])


def first_match_array(findings: DataFrame, entries_rows: list[dict],
                      scanner_col: str = "scanner", file_col: str = "file",
                      line_col: str = "line") -> DataFrame:
    """Alternative for small allowlists: the ordered entries become a literal array
    and the first match is ``get(filter(entries, matches), 0)`` -- a pure
    projection.  ``entries_rows`` must already be normalised and bounded."""
    arr = F.array(*[F.struct(F.lit(e["pos"]).alias("pos"), F.lit(e["a_scanner"]).alias("s"),
                             F.lit(e["a_file"]).alias("f"),
                             F.lit(e["a_line"]).cast("bigint").alias("l"),
                             F.lit(e["a_reason"]).alias("r"))
                    for e in sorted(entries_rows, key=lambda e: e["pos"])])
    if not entries_rows:
        return (findings.withColumn("suppression_pos", F.lit(None).cast("int"))
                .withColumn("suppression_reason", F.lit(None).cast("string")))

    def hit(e):
        return (((e["s"] == "*") | (e["s"] == F.col(scanner_col)))
                & ((e["f"] == "*") | (e["f"] == F.col(file_col)))
                & ((e["l"] == 0) | F.coalesce(e["l"] == F.col(line_col), F.lit(False))))
    first = F.get(F.filter(arr, hit), 0)
    return (findings.withColumn("_m", first)
            .withColumn("suppression_pos", F.col("_m.pos").cast("int"))
            .withColumn("suppression_reason", F.col("_m.r")).drop("_m"))


REFUTED_DEFAULT_REASON = "(no evidence given)"


def allowlist_candidates(refuted: DataFrame, allowlist: DataFrame,
                         exported_at: str | Column | None = None) -> DataFrame:
    """Candidate entries for refuted findings not already in the allowlist.

    ``refuted`` has (scanner, file, line, verification_reason, order_key);
    an existing entry in any status blocks a candidate; within the batch the
    first finding (by ``order_key``) of each (scanner, file, line) wins.
    Lines that are not integers export as 0 (whole file); NULL/blank lines
    on existing entries compare as 0 too.
    """
    line0 = F.coalesce(F.col("line"), F.lit(0).cast("bigint"))
    cand = refuted.select(
        "scanner", "file", line0.alias("line"),
        F.when(F.coalesce(F.col("verification_reason"), F.lit("")) != "",
               F.col("verification_reason")).otherwise(F.lit(REFUTED_DEFAULT_REASON))
         .alias("reason"),
        "order_key")
    first = (cand.groupBy("scanner", "file", "line")
             .agg(F.min_by("reason", "order_key").alias("reason"),
                  F.min("order_key").alias("order_key")))
    ex_line_s = F.trim(F.col("line").cast("string"))
    existing = allowlist.select(
        F.col("scanner").alias("e_scanner"), F.col("file").alias("e_file"),
        F.when(ex_line_s.isNull() | (ex_line_s == ""), F.lit(0).cast("bigint"))
         .otherwise(ex_line_s.try_cast("bigint")).alias("e_line"))
    cond = ((first["scanner"].eqNullSafe(existing["e_scanner"]))
            & (first["file"].eqNullSafe(existing["e_file"]))
            & (first["line"].eqNullSafe(existing["e_line"])))
    new = first.join(existing, cond, "left_anti")
    utc_now = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.localtimestamp())
    ts = exported_at if exported_at is not None else F.date_format(
        utc_now, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ts = F.lit(ts) if isinstance(ts, str) else ts
    return new.select("scanner", "file", "line", "reason",
                      F.lit("candidate").alias("status"), ts.alias("exported_at"), "order_key")
