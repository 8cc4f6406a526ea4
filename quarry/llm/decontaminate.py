"""Benchmark decontamination: a broadcast hash set of the benchmark's token windows.

Every benchmark item gives its windows of ``width`` consecutive normalised words
(a shorter item is one window).  Each document is tokenised once; the hashes of
all its windows are built inside the row, exploded and looked up in the
broadcast set within one pipelined stage, and each hash hit is verified against
the window's words before it counts.  Only verified hits and one marker row a
document are shuffled.

The set is broadcast only after its size is measured.  Beyond ``block_bytes`` it
is dealt into as many blocks by hash, each within the bound, and the documents
pass each block in turn, so a benchmark of any size gives the same rows.

Defined results: null or wordless texts have no window (documents: not
contaminated; items: never listed); items with equal ids count as one; windows
of items without an id mark words but are not listed; rows of documents with
equal ids are judged one by one; an empty benchmark marks nothing.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import ascii_lower, table
from quarry.session import write_phase_table

#: Words of a window in production.
WIDTH = 13
#: The share of hit words (1 / 20) from which a document counts as contaminated.
SHARE = 20
#: Most bytes of window text in one broadcast set.
BLOCK_BYTES = 32 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    lower = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _hashes(words: Column, width: Column | int) -> Column:
    """The hash of every window of ``width`` words, in order."""
    return F.transform(
        F.sequence(F.lit(1), F.size(words) - width + 1),
        lambda i: F.xxhash64(F.slice(words, i, width)))


def _tagged(n: int) -> Column:
    """(n, position, hash) of every window of n words; none in shorter texts."""
    each = F.transform(_hashes(F.col("_h"), n), lambda h, i: F.struct(
        F.lit(n).alias("n"), i.alias("i"), h.alias("h")))
    return F.when(F.size("_h") >= n, each).otherwise(
        F.array().cast("array<struct<n:int,i:int,h:bigint>>"))


def benchmark_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """n (words), h (hash), window (its text) and items (the ids it comes from)."""
    w = items.select("item_id", tokens(F.col("text")).alias("w"))
    w = w.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(width)))
    w = w.select("item_id", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("n") + 1),
        lambda i: F.slice("w", i, F.col("n")))).alias("win"))
    w = w.select("item_id", "n", F.xxhash64(F.transform("win", lambda x: F.xxhash64(x))).alias("h"),
                 F.array_join("win", " ").alias("window"))
    return w.groupBy("n", "h", "window").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, text: str = "text",
         carry: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: ``carry``, n_words, spans (merged ranges of hit words,
    as [start, end) word positions) and items (the ids that occur, unordered)."""
    windows = write_phase_table(benchmark_windows(items, width), "benchmark-windows")
    size = windows.agg(F.coalesce(F.sum(F.octet_length("window") + 64), F.lit(0))).first()[0]
    blocks = -(-size // block_bytes) or 1
    lengths = [r["n"] for r in windows.select("n").distinct().collect()]  # at most `width`

    d = docs.select(*carry, tokens(F.col(text)).alias("_words"))
    d = d.select(*carry, "_words", F.monotonically_increasing_id().alias("_row"),
                 F.transform("_words", lambda x: F.xxhash64(x)).alias("_h"))
    # position -1 marks the document itself: it meets a set entry of length 0
    marker = F.array(F.struct(F.lit(0).alias("n"), F.lit(-1).alias("i"),
                              F.lit(0).cast("bigint").alias("h")))
    found = [_tagged(n) for n in sorted(lengths)]
    d = d.select(*carry, "_row", "_words", F.concat(marker, *found).alias("_found"))
    d = d.select(*carry, "_row", "_words", F.explode_outer("_found").alias("_at"))
    itself = windows.sparkSession.range(1).select(
        F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("h"), F.lit("").alias("window"),
        F.array().cast(windows.schema["items"].dataType).alias("items"))

    def looked_up(block: int) -> DataFrame:
        part = windows if blocks == 1 else windows.where(
            F.pmod(F.col("h"), F.lit(blocks)) == block)
        part = F.broadcast((part.unionByName(itself) if block == 0 else part).select(
            F.col("n").alias("_n"), F.col("h").alias("_key"), "window", "items"))
        return d.join(part, (F.col("_at.h") == F.col("_key")) & (F.col("_at.n") == F.col("_n")))

    # Equal texts, said without an equality, which would become a join key and so be
    # computed for every window of the corpus and not for the hash hits alone.
    passage = F.array_join(F.slice("_words", F.greatest(F.col("_at.i") + 1, F.lit(1)),
                                   F.col("_at.n")), " ")
    verified = F.startswith(F.col("window"), passage) & F.startswith(passage, F.col("window"))
    met = reduce(DataFrame.unionByName, [looked_up(b) for b in range(blocks)]).where(verified)
    at = F.when(F.col("_at.n") > 0, F.struct(
        F.col("_at.i").alias("i"), (F.col("_at.i") + F.col("_at.n")).alias("e")))
    g = met.select(*carry, "_row", F.size("_words").cast("bigint").alias("n_words"),
                   at.alias("_hit"), "items") \
        .groupBy(*carry, "_row", "n_words") \
        .agg(F.sort_array(F.collect_set("_hit")).alias("_hits"),
             F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return g.select(*carry, "n_words", _covered(F.col("_hits")).alias("n_hit"),
                    F.col("_hits").alias("hits"), "items")


def _covered(found: Column) -> Column:
    """How many positions the [i, e) ranges cover; they are in order of their start."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(found, start, lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["i"]))).alias("n"),
        F.greatest(a["end"], x["e"]).alias("end")), lambda a: a["n"])


def contaminated(share: int = SHARE) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def judge(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = SHARE,
          text: str = "text", carry: tuple[str, ...] = ("doc_id",),
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``hits`` with the verdict ``contaminated`` of each document."""
    return hits(docs, items, width, text, carry, block_bytes).withColumn(
        "contaminated", contaminated(share))


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: int = SHARE,
                    block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the contaminated documents, columns as they were.

    Rows are told apart by id and text hash: the verdict depends on the text alone."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    bad = judge(d, items, width, share, carry=("doc_id", "_th"), block_bytes=block_bytes) \
        .where("contaminated").select(F.col("doc_id").alias("_id"), "_th").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"])
                     & (F.xxhash64(docs["text"]) == bad["_th"]), "left_anti")


def query(spark, sf_dir):
    got = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS n,
         array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS g
  FROM b, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS u(i) WHERE len(ws) > 0
), dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, len(ws) - n + 2)) AS u(i)
), hit AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN marked ON d.doc_id = marked.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
