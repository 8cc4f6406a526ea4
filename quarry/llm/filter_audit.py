"""Filter interaction audit: what each filter removes in each order of the filters, from
Lehmer-rank difference arrays.

1. Each text gets a mask of the filters that it fails, in one projection.  Whether an equal
   text has a smaller id takes the least id of each text's 128-bit digest (combined
   map-side, so a group of copies of any size stays cheap).
2. Rows are added up to one row a part and mask, at most 32 a part.  Orders are numbered by
   their Lehmer rank, that is in lexicographic order, so the orders with a common beginning
   are an interval of ranks.  A mask is removed at step s by the first of its filters in the
   order: for each beginning of s - 1 filters outside the mask and one inside it, that is an
   interval of (n - s)! ranks.
3. Counts are added at the interval ends (+ at the first rank, - behind the last), summed by
   part, step and rank, and a running sum over the ranks gives every order's removals.

Defined results: null texts are empty; null and empty parts are one part; rows of equal ids
count one by one, and neither is a copy of the other; a null id is no smaller id and has
none, and no label; of several labels of an id any that says 1 counts; an empty table gives
no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import table, words
from quarry.session import write_phase_table

STATS = ("n", "good", "toxic")
#: The letter of the filter that removes copies of a text of a smaller id.
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter, of a text that is not null."""
    w = words(text)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": F.size(w) < 100,
            "B": 100 * F.size(F.array_distinct(w)) < 80 * F.size(w),
            "C": 100 * capitals > 10 * F.length(text),
            "D": text.rlike(r"[#$%&*|]")}


def intervals(n: int, mask: int) -> Iterator[tuple[int, int, int]]:
    """(step, first rank, rank behind the last) of the orders of ``n`` filters that remove
    ``mask`` at that step."""
    def walk(left: tuple[int, ...], at: int) -> Iterator[tuple[int, int, int]]:
        width = factorial(len(left) - 1)
        for i, f in enumerate(left):
            lo = at + i * width
            if mask >> f & 1:
                yield n - len(left) + 1, lo, lo + width
            else:
                yield from walk(left[:i] + left[i + 1:], lo)
    if mask:
        yield from walk(tuple(range(n)), 0)


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text",
          filters: Callable[[Column], dict[str, Column]] = text_filters,
          copies: str | None = COPY) -> tuple[list[str], DataFrame]:
    """The letters in order, and (part, mask, n, good, toxic): rows of a part that fail just
    the filters whose bits ``mask`` has, and those of them that ``labels`` calls so."""
    t = F.coalesce(F.col(text), F.lit(""))
    failing = filters(t)
    letters = sorted([*failing, *([copies] if copies else [])])
    bits = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << letters.index(x))
                for x, c in failing.items()), F.lit(0))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"),
                       F.unhex(F.md5(t.cast("binary"))).alias("th"), bits.alias("mask")) \
        .groupBy("doc_id", "part", "th", "mask").agg(F.count("*").alias("n"))
    flags = labels.where("(quality = 1 or toxic = 1) and doc_id is not null").groupBy(
        F.col("doc_id").alias("_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("g"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("x"))
    # Rows without an id meet no label; the second key keeps them from one partition.
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("th")).otherwise(F.lit(0))
    met = rows.join(flags.withColumn("_s", F.lit(0).cast("bigint")),
                    (F.col("doc_id") == F.col("_id")) & (spread == F.col("_s")), "left")
    met = met.select("doc_id", "part", "th", "mask", "n",
                     (F.col("n") * F.coalesce("g", F.lit(0))).alias("good"),
                     (F.col("n") * F.coalesce("x", F.lit(0))).alias("toxic"))
    if copies:
        met = write_phase_table(met, "audit-rows")
        first = met.where("doc_id is not null").groupBy(F.col("th").alias("_th")).agg(
            F.min("doc_id").alias("_first"))
        met = met.join(first, (F.col("th") == F.col("_th"))
                       & (F.col("doc_id") == F.col("_first")), "left")
        copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
        met = met.withColumn("mask", F.col("mask")
                             + copy.cast("int") * (1 << letters.index(copies)))
    return letters, met.groupBy("part", "mask").agg(
        *[F.sum(s).cast("bigint").alias(s) for s in STATS])


def audit(counts: DataFrame, letters: list[str]) -> DataFrame:
    """One row a part of ``counts`` (see ``masks``), order of ``letters`` and step."""
    spark, n = counts.sparkSession, len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    ends = [(m, s, rank, sign) for m in range(1, 1 << n) for s, lo, hi in intervals(n, m)
            for rank, sign in ((lo, 1), (hi, -1))]
    ends = spark.createDataFrame(ends, "mask int, step int, rank int, sign int")
    counts = write_phase_table(counts, "audit-counts")
    # What changes at a rank; zeros, so that every rank and step of a part is there.
    zeros = counts.select("part").distinct().select(
        "part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"),
        *[F.lit(0).cast("bigint").alias(s) for s in STATS])
    changes = counts.join(F.broadcast(ends), "mask").select(
        "part", "step", "rank", *[(F.col(s) * F.col("sign")).alias(s) for s in STATS])
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(
        Window.unboundedPreceding, 0)
    gone = zeros.unionByName(changes.where(F.col("rank") < len(orders))) \
        .groupBy("part", "step", "rank").agg(*[F.sum(s).alias(s) for s in STATS]) \
        .select("part", "step", "rank", *[F.sum(s).over(running).alias(s) for s in STATS])
    names = spark.createDataFrame(list(enumerate(orders)), "rank int, filter_order string")
    gone = gone.join(F.broadcast(names), "rank").withColumn(
        "letter", F.col("filter_order").substr(F.col("step"), F.lit(1)))
    each = F.explode(F.array(*[
        F.struct(F.lit(x).alias("letter"),
                 (F.col("mask").bitwiseAND(1 << i) > 0).cast("int").alias("fails"),
                 (F.col("mask") == 1 << i).cast("int").alias("only"))
        for i, x in enumerate(letters)])).alias("e")
    totals = counts.select("part", "n", each).groupBy("part", "e.letter").agg(
        F.sum("n").alias("n_part"), F.sum(F.col("n") * F.col("e.fails")).alias("fails"),
        F.sum(F.col("n") * F.col("e.only")).alias("only"))
    so_far = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(
        Window.unboundedPreceding, 0)
    return gone.join(totals, ["part", "letter"]).select(
        "part", "filter_order", "step",
        (F.col("n_part") - F.sum("n").over(so_far)).alias("kept"),
        F.col("n").alias("removed"), (F.col("fails") - F.col("n")).alias("redundant"),
        F.col("only").alias("unique_fails"), F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("n").over(Window.partitionBy("part", "letter")).alias("shapley"))


def query(spark, sf_dir):
    letters, counts = masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(counts, letters)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM d GROUP BY t
), good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1
), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1
), f AS (
  SELECT d.part, d.doc_id IN (SELECT doc_id FROM good) AS is_good,
         d.doc_id IN (SELECT doc_id FROM toxic) AS is_toxic,
         (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * len(regexp_extract_all(d.t, '[A-Z]')) > 10 * length(d.t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN firsts.first_id < d.doc_id THEN 'E' ELSE '' END) AS fails
  FROM d JOIN firsts ON d.t = firsts.t
), c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE is_good) AS good,
         count(*) FILTER (WHERE is_toxic) AS toxic
  FROM f GROUP BY part, fails
), l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM l a, l b, l c, l d, l e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x)
    AND d.x <> e.x
), s AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter,
         substr(filter_order, 1, step) AS upto, substr(filter_order, 1, step - 1) AS earlier
  FROM o, (VALUES (1), (2), (3), (4), (5)) AS v(step)
), g AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (WHERE len(regexp_extract_all(fails, '[' || upto || ']')) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE contains(fails, letter)
           AND (step = 1 OR len(regexp_extract_all(fails, '[' || earlier || '0]')) = 0)), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE contains(fails, letter)), 0) AS failing,
         coalesce(sum(n) FILTER (WHERE fails = letter), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE contains(fails, letter)
           AND (step = 1 OR len(regexp_extract_all(fails, '[' || earlier || '0]')) = 0)), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE contains(fails, letter)
           AND (step = 1 OR len(regexp_extract_all(fails, '[' || earlier || '0]')) = 0)), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, letter, upto, earlier
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       (failing - removed)::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM g
"""
