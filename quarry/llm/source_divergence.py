"""Source divergence audit: how far each source's use of terms is from every other source of
its language, by a sparse merge of term counts in one task a pair of sources.

1. One pass over the texts counts each term's occurrences by (lang, source) and its documents;
   tasks send sums per slice of texts, Spark adds them up.
2. A language keeps the terms of at least ``min_docs`` of its documents.  They are dealt by
   hash into blocks of about ``block_terms`` terms and numbered within a block, so the sorted
   (term id, price) array of a source in one block has a bounded size, whatever the corpus.
   A price is the smoothed share 1 + floor(SCALE * (count + 2) / (N + 2V)), in decimals.
3. Sources of a language are dealt into tiles of ``tile``; tasks are the unordered pairs of
   tiles, a block each.  A task co-groups the arrays of both tiles and merges each unordered
   pair of sources once: a galloping search of the shorter array's ids in the longer one
   gives the overlaps; the terms of one side, and those of neither, are priced with the
   price of no occurrence.  Sums over the blocks are a pair's value, for both directions.
4. The term part compares each source with its whole language and keeps the first ranks.

All sums and prices are integers.  Defined results: null text, lang and source are empty
texts; sources without terms take part with no occurrences; a language without kept terms
has value 0 for every pair and no term rows; rows of equal ids count one by one; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.terms import as_strings, find_terms, pieces, text_bytes
from quarry.llm.text import table
from quarry.session import write_phase_table

SCALE, PRIOR, MIN_DOCS, TOP = 1_000_000_000, 2, 10, 10
BLOCK_TERMS, TILE = 1 << 16, 8
_COUNTS = "lang string, source string, term string, n bigint, d bigint"


def _slice_counts(row: np.ndarray, term: pa.Array, group: np.ndarray
                  ) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of the terms of a slice of texts; ``row`` is
    the text of each term and ``group`` the group of each text."""
    coded = term.dictionary_encode()
    width = max(len(coded.dictionary), 1)
    keys, n = _runs(np.sort(row * width + coded.indices.to_numpy()))
    of_group = group[keys // width] * width + keys % width
    order = np.argsort(of_group, kind="stable")
    starts = np.flatnonzero(np.diff(of_group[order], prepend=-1))
    both, d = _runs(of_group[order])
    n = np.add.reduceat(n[order], starts) if len(starts) else n
    return both // width, coded.dictionary.take(pa.array(both % width)), n, d


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a sorted array (from 0 on), and how often each is there."""
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    return ordered[starts], np.diff(starts, append=len(ordered))


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> sums of _COUNTS; a row without a term for each group met."""
    number: dict[tuple[str, str], int] = {}
    for b in batches:
        known = len(number)
        pairs = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        group = np.array([number.setdefault(p, len(number)) for p in pairs], dtype=np.int64)
        names = list(number)
        lang, source = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        new = len(names) - known
        if new:
            zero = pa.array([0] * new, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [lang[known:], source[known:], pa.nulls(new, pa.string()), zero, zero],
                names=["lang", "source", "term", "n", "d"])
        long_row, parts = -1, []  # a text in several pieces is one document
        for first, raw, offsets in [*pieces(*text_bytes(b.column(2))), (-1, None, None)]:
            if parts and first != long_row:
                yield from _out(_slice_counts(np.concatenate([p[0] for p in parts]),
                                              pa.concat_arrays([p[1] for p in parts]), group),
                                lang, source)
                parts = []
            if raw is None or not len(raw):
                continue
            low, starts, ends, row = find_terms(raw, offsets)
            parts.append((row + first, as_strings(low, starts, ends)))
            long_row = first


def _out(counted, lang: pa.Array, source: pa.Array) -> Iterator[pa.RecordBatch]:
    group, term, n, d = counted
    for lo in range(0, len(n), 65_536):
        at = slice(lo, lo + 65_536)
        g = pa.array(group[at])
        yield pa.RecordBatch.from_arrays(
            [lang.take(g), source.take(g), term[at].cast(pa.string()), pa.array(n[at]),
             pa.array(d[at])], names=["lang", "source", "term", "n", "d"])


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences ``n`` and documents ``d`` of each (lang, source, term); a null term for
    each (lang, source)."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = docs.select(filled("lang"), filled("source"), filled(text))
    return rows.mapInArrow(count_batches, _COUNTS).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("d").alias("d"))


def price(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 v)), exact at any size of a bigint."""
    over = F.lit(SCALE).cast("decimal(10,0)") * (n + PRIOR).cast("decimal(20,0)")
    under = total.cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)") * v.cast("decimal(16,0)")
    return 1 + F.call_function("div", over, under)


def gallop(short: np.ndarray, long: np.ndarray, run: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` of the values that both sorted arrays hold.  For
    each run of ``short`` the window in ``long`` doubles from the last place until it covers
    the run, and is then searched."""
    found, base = [], 0
    for lo in range(0, len(short), run):
        part, width = short[lo:lo + run], run
        while base + width < len(long) and long[base + width - 1] < part[-1]:
            width *= 2
        at = base + np.searchsorted(long[base:base + width], part)
        hit = np.flatnonzero((at < len(long)) & (long[np.minimum(at, len(long) - 1)] == part)) \
            if len(long) else np.zeros(0, dtype=np.int64)
        found.append((lo + hit, at[hit]))
        base = int(at[-1])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _f(p: np.ndarray, q) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def merge(a, b, terms: int) -> int:
    """The value of a pair in a block of ``terms`` terms; a and b are (ids, prices of these,
    price of no occurrence)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (ids_a, p, p0), (ids_b, q, q0) = a, b
    i, j = gallop(ids_a, ids_b)
    only_a, only_b = np.ones(len(p), dtype=bool), np.ones(len(q), dtype=bool)
    only_a[i], only_b[j] = False, False
    neither = terms - len(p) - len(q) + len(i)
    return int(_f(p[i], q[j]).sum() + _f(p[only_a], q0).sum() + _f(p0, q[only_b]).sum()) \
        + neither * int(_f(np.int64(p0), np.int64(q0)))


def _vectors(t: pa.Table) -> list[tuple]:
    """(source, ids, prices, price of none) of each row, by source."""
    out = []
    for s, ids, p, p0 in zip(t.column("source"), t.column("ids"), t.column("prices"),
                             t.column("p0")):
        out.append((s.as_py(), ids.values.to_numpy(), p.values.to_numpy(), p0.as_py()))
    return sorted(out, key=lambda x: x[0])


def merge_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    """Values of every unordered pair of sources of two tiles in one block."""
    a, b = _vectors(left), _vectors(right)
    same = left.column("ta")[0] == left.column("tb")[0]
    terms = left.column("terms")[0].as_py()
    pairs = [(x, y) for x in a for y in b if not same or x[0] < y[0]]
    return pa.table({"lang": pa.array([left.column("lang")[0].as_py()] * len(pairs), pa.string()),
                     "a": pa.array([x[0] for x, _ in pairs], pa.string()),
                     "b": pa.array([y[0] for _, y in pairs], pa.string()),
                     "value": pa.array([merge(x[1:], y[1:], terms) for x, y in pairs],
                                       pa.int64())})


def divergence(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP,
               block_terms: int = BLOCK_TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value and rank: see the module's text."""
    counts = write_phase_table(term_counts(docs, text), "divergence-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("n").alias("n_lang"), F.sum("d").alias("d")).where(F.col("d") >= min_docs)
    terms = write_phase_table(terms.select("lang", "term", "n_lang"), "divergence-terms")
    # Written, so that Spark knows its size and need not deal the terms out by language.
    langs = write_phase_table(terms.groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("n_lang").alias("total")), "divergence-langs")
    n_blocks = F.ceil(F.col("v") / block_terms)
    kept = terms.join(langs, "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), n_blocks).cast("int"))
    kept = kept.withColumn("id", F.row_number().over(
        Window.partitionBy("lang", "block").orderBy("term")))
    cells = write_phase_table(
        counts.where("term is not null").join(kept, ["lang", "term"]).select(
            "lang", "source", "term", "block", "id", "n", "n_lang"), "divergence-cells")
    sizes = kept.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = counts.where("term is null").select("lang", "source") \
        .join(totals, ["lang", "source"], "left").join(langs, "lang", "left") \
        .select("lang", "source", F.coalesce("n_source", F.lit(0)).alias("n_source"),
                F.coalesce("v", F.lit(0)).alias("v"), "total",
                F.floor(number / tile).cast("int").alias("tile"),
                F.floor((F.count("*").over(Window.partitionBy("lang")) - 1) / tile)
                .cast("int").alias("last"))
    groups = write_phase_table(groups, "divergence-groups")
    pairs = _pairs(cells, groups, sizes)
    both = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value") \
        .select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    p, q = price(F.col("n"), F.col("n_source"), F.col("v")), \
        price(F.col("n_lang"), F.col("total"), F.col("v"))
    high = cells.join(groups, ["lang", "source"]).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        p.alias("p"), q.alias("q")).where("p > q")
    value = F.expr("(p - q) * (p - q) div (p + q)")
    first = high.select("lang", "source", "part", "item", value.alias("value")) \
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(first)


def _pairs(cells: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """The value of each unordered pair (a, b) of sources of a language."""
    arrays = cells.groupBy("lang", "source", "block").agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("cells"))
    some = F.col("v") > 0
    none = F.when(some, price(F.lit(0).cast("bigint"), F.col("n_source"), F.col("v"))).otherwise(1)
    here = groups.join(sizes, "lang", "left").select(
        "lang", "source", "n_source", "v", "tile", "last", none.alias("p0"),
        F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("terms", F.lit(0)).alias("terms"))
    vectors = here.join(arrays, ["lang", "source", "block"], "left").select(
        "lang", "source", "block", "terms", "tile", "last", "p0",
        F.coalesce(F.expr("transform(cells, c -> c.id)"), F.array().cast("array<int>"))
        .alias("ids"),
        F.coalesce(F.transform("cells", lambda c: price(c["n"], F.col("n_source"), F.col("v"))),
                   F.array().cast("array<bigint>")).alias("prices"))
    # Renamed on both sides, for the two sides of the co-group are one table.
    cols = [F.col(c).alias(c) for c in ("lang", "block", "source", "terms", "p0", "ids", "prices")]
    left = vectors.select(*cols, F.col("tile").alias("ta"),
                          F.explode(F.sequence("tile", "last")).alias("tb"))
    right = vectors.select(*cols, F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ta"),
                           F.col("tile").alias("tb"))
    key = ["lang", "ta", "tb", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        merge_tiles, "lang string, a string, b string, value bigint") \
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def query(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), v AS (
  SELECT lang, count(*) AS v, sum(n_lang) AS total FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n
  FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term
), s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n_lang + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang
  LEFT JOIN s ON g.lang = s.lang AND g.source = s.source
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), pv AS (
  SELECT a.lang, a.source, b.source AS item,
         sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pv.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM r WHERE part = 'pair' OR rank <= 10
"""
