"""Line dedup: the suffix array of line sequences and its intervals of repeated runs.

A document is the sequence of the ids (128-bit hashes) of its lines that hold a word.
``suffixes`` puts all suffixes of all sequences in order by prefix doubling; the suffixes
that share their first lines are an interval of the array, and its common prefix is a run
of lines that the corpus holds repeatedly.  The first of an interval's suffixes in corpus
order stays and every other one is a later copy.  The deepest interval that holds a smaller
position gives the longest later copy that starts at a line; all shorter ones that start
there lie inside it, so these runs cover every line of a later copy.  Overlapping and
touching ones joined together are the ranges that are deleted.

Every repeated run counts, from a single line on.  ``min_chars`` leaves alone runs with
fewer characters, which is of use where short lines belong to the form of a text.

Corpus order is (doc_id, text digest), null ids last.  Equal texts (by a 128-bit digest) are
one sequence: all but their first row are later copies throughout, so a group of copies of
any size costs one row.  Rows with equal id and text are told apart by their other columns,
so the same one stays in every run.

Defined results: a null text has no lines and stays as it is; a document that loses
its last line with a word is gone; texts without such a line never count and stay;
repeated rows are copies like any other; other columns are ignored or carried along,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import suffixes
from quarry.llm.rows import stable_order
from quarry.llm.text import table
from quarry.session import write_phase_table

#: Characters from which a repeated run counts: all do.
MIN_CHARS = 1


def digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def sequences(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, th (text hash), n_lines and, of each line with a word, its number ``at``,
    its id (``a``, ``b``) and its ``chars``."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"),
                    lambda x, i: F.struct(i.alias("i"), x.alias("x"))),
        lambda s: s["x"].rlike(r"[^\x20\x09-\x0D]"))
    d = docs.select("doc_id", digest(text).alias("th"),
                    F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("n_lines"),
                    lines.alias("_l"))
    return d.select("doc_id", "th", "n_lines",
                    F.transform("_l", lambda s: s["i"]).alias("at"),
                    F.transform("_l", lambda s: F.xxhash64(s["x"])).alias("a"),
                    F.transform("_l", lambda s: F.xxhash64(F.lit(1), s["x"])).alias("b"),
                    F.transform("_l", lambda s: F.length(s["x"])).alias("chars"))


@F.pandas_udf(T.ArrayType(T.StructType().add("first", T.IntegerType())
                          .add("last", T.IntegerType())))
def _runs(found: pd.Series, base: pd.Series, at: pd.Series, chars: pd.Series,
          least: pd.Series) -> pd.Series:
    """The longest later copies of a sequence as line numbers, those with enough characters."""
    out = []
    for f, b, lines, c, m in zip(found, base, at, chars, least, strict=True):
        p = np.array([x["p"] for x in f], dtype=np.int64) - b
        end = p + np.array([x["n"] for x in f], dtype=np.int64)
        cum = np.concatenate([[0], np.cumsum(c, dtype=np.int64)])
        ok = cum[end] - cum[p] >= m
        out.append([{"first": int(lines[i]), "last": int(lines[j - 1])}
                    for i, j in zip(p[ok], end[ok], strict=True)] or None)
    return pd.Series(out)


def later_copies(docs: DataFrame, min_chars: int = MIN_CHARS, text: str = "text",
                 block_bits: int = suffixes.BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows, firsts).  rows: doc_id, th, n_lines, n_chars of each row of ``docs``.  firsts:
    doc_id, th and runs (array of [first, last] line numbers, ends inclusive) of the first
    row of each text of ``min_chars`` or more; every other row of it is a later copy."""
    seqs = write_phase_table(sequences(docs, text), "line-sequences")
    n_chars = F.aggregate("chars", F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = seqs.select("doc_id", "th", "n_lines", n_chars.alias("n_chars"))
    tables = suffixes.Tables(docs.sparkSession)
    # the least id of a text, combined map-side, then one of its rows: equal keys, equal rows
    own = seqs.where(n_chars >= max(min_chars, 1))
    keys = own.groupBy("th").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"),
                                                F.col("doc_id").alias("id"))).alias("_k"))
    keys = keys.select(F.col("th").alias("_th"), F.col("_k.none").alias("none"),
                       F.col("_k.id").alias("_id"))
    one = own.join(keys, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    one = one.select("none", "doc_id", "th", F.size("a").cast("bigint").alias("n"),
                     "at", "a", "b", "chars").dropDuplicates(["doc_id", "th"])
    firsts = suffixes.numbered(tables, one, ["none", "doc_id", "th"], "n", "base", "line-firsts")
    lines = firsts.select("base", F.posexplode(F.arrays_zip("a", "b"))).select(
        (F.col("base") + F.col("pos")).alias("p"), F.col("base").alias("d"), "col.a", "col.b")
    keys, ranked = suffixes.doubled(tables, suffixes.first_ranks(tables, lines))
    array = suffixes.common_prefixes(tables, keys, ranked)
    found = suffixes.earlier(tables, array, block_bits)
    found = found.groupBy(F.col("d").alias("base")).agg(
        F.collect_list(F.struct("p", "n")).alias("_found"))
    runs = firsts.join(found, "base", "left").select("doc_id", "th", F.when(
        F.col("_found").isNotNull(),
        _runs(F.coalesce("_found", F.array().cast("array<struct<p:bigint,n:bigint>>")), "base",
              "at", "chars", F.lit(min_chars))).alias("runs"))
    runs = write_phase_table(runs, "line-runs")
    tables.remove()
    return rows, runs


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _gone(runs: pd.Series, n_lines: pd.Series) -> pd.Series:
    """For each line of a text whether a run covers it."""
    out = []
    for r, n in zip(runs, n_lines, strict=True):
        steps = np.zeros(int(n) + 1, dtype=np.int64)
        for x in r if r is not None else []:
            steps[x["first"]] += 1
            steps[x["last"] + 1] -= 1
        out.append(np.cumsum(steps[:-1]) > 0)
    return pd.Series(out)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines of later copies and without documents that lose their
    last line with a word.  Columns stay; an ``n_chars`` that there is follows the text."""
    cols = docs.columns
    _, firsts = later_copies(docs, min_chars)
    firsts = firsts.select(F.col("doc_id").alias("_fid"), F.col("th").alias("_fth"), "runs")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_doc"),
                        F.col("doc_id").alias("_id"), digest("text").alias("_th"))
    text = F.coalesce(F.col("_doc.text"), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.aggregate(worded, F.lit(0), lambda s, x: s + F.length(x))
    short = whole.withColumn("_c", n_chars).where(
        F.col("_c") < max(min_chars, 1)).select("_doc")
    met = whole.join(firsts, whole["_id"].eqNullSafe(firsts["_fid"])
                     & (whole["_th"] == firsts["_fth"]))
    one = Window.partitionBy("_id", "_th").orderBy(stable_order("_doc"))
    met = met.withColumn("_n", F.row_number().over(one)).where("_n = 1")
    changed = met.where("runs is not null")
    flags = changed.select("_doc", _gone("runs", F.size(F.split(text, "\n"))).alias("_gone"))
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.get("_gone", i)), "\n")
    edited = flags.select("_doc", left.alias("_left")).where(
        F.col("_left").rlike(r"[^\x20\x09-\x0D]"))
    new = F.col("_doc").withField("text", F.col("_left"))
    if "n_chars" in cols:
        new = new.withField("n_chars", F.length("_left").cast(docs.schema["n_chars"].dataType))
    edited = edited.select(new.alias("_doc"))
    same = met.where("runs is null").select("_doc")
    return same.unionByName(edited).unionByName(short).select("_doc.*")


@F.pandas_udf(T.StructType().add("removed", T.StringType()).add("n_removed", T.LongType()))
def _merged(runs: pd.Series) -> pd.DataFrame:
    """Overlapping and touching runs joined: as text, and how many lines they hold."""
    text, total = [], []
    for r in runs:
        spans: list[list[int]] = []
        for lo, hi in sorted((x["first"], x["last"]) for x in (r if r is not None else [])):
            if spans and lo <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        text.append(",".join(f"{lo}-{hi}" for lo, hi in spans))
        total.append(sum(hi - lo + 1 for lo, hi in spans))
    return pd.DataFrame({"removed": text, "n_removed": total})


def query(spark, sf_dir):
    """doc_id, n_lines, copy (a later row of an equal text), removed (the numbers of the
    deleted lines, as ranges) and n_removed of every document."""
    rows, firsts = later_copies(table(spark, sf_dir, "documents"))
    firsts = firsts.select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "runs")
    one = Window.partitionBy("doc_id", "th").orderBy("n_lines")
    r = rows.withColumn("_n", F.row_number().over(one))
    r = r.join(firsts, r["doc_id"].eqNullSafe(firsts["_id"]) & (r["th"] == firsts["_th"]), "left")
    copy = (F.col("n_chars") >= MIN_CHARS) & (F.col("_id").isNull() & F.col("_th").isNull()
                                              | (F.col("_n") > 1))
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("n_lines") - 1).alias("last")))
    got = _merged(F.when(copy, whole).otherwise(F.col("runs")))
    return r.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), copy.alias("copy"),
                    got.alias("_m")).select("doc_id", "n_lines", "copy", "_m.removed",
                                            "_m.n_removed")
