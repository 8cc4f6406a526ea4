"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in expression over the text's own words and lines, so a
row never leaves the JVM, nothing is shuffled and the work of a row is
``n log n`` in its words (repeated windows are found by sorting their hashes
inside the row).

Defined results: a null text has no words (all counts 0, it fails the base
rule); rows with equal ids are judged one by one; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import SPACE, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a and are as at be by for from have in is it of on or that the this to was with "
    "au aux ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "auf das dem den der die ein eine ist mit nicht sich sie und von zu "
    "al con del el las lo los no por se su y"
).split()


@dataclass(frozen=True)
class Rule:
    """``scale * measure`` has to be within [low, high] x ``per`` (a count of the row)."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: The thresholds used in production; ratios are measured against ``per``.
RULES = (
    Rule("enough_words", "n_words", low=50),
    Rule("mean_word_length", "word_chars", per="n_words", low=2, high=12),
    Rule("symbols_per_word", "n_symbols", per="n_words", high=0.1),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", per="n_lines", high=0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", per="n_lines", high=0.3),
    Rule("bullet_lines", "n_bullet_lines", per="n_lines", high=0.9),
    Rule("repeated_windows", "n_repeat_words", per="n_words", high=0.5),
)


def compile_rules(rules=RULES) -> Column:
    """One boolean expression: true where every rule of the table holds."""
    kept = F.lit(True)
    for r in rules:
        per = F.col(r.per) if r.per else F.lit(1)
        if r.low is not None:
            kept = kept & (F.col(r.measure) >= F.lit(r.low) * per)
        if r.high is not None:
            kept = kept & (F.col(r.measure) <= F.lit(r.high) * per)
    return kept


def _sorted_windows(h: Column) -> Column:
    """(hash, position) of every window, sorted; null for rows without a repeated
    hash, which a hash set tells apart, so most rows are never sorted."""
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), pairs)


def _repeated_starts(s: Column) -> Column:
    """The ascending positions whose hash equals a neighbour's in the sorted pairs."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    marked = F.transform(s, lambda x, k: F.when(
        same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"]))
    return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))


def _covered_words(starts: Column) -> Column:
    """How many words lie in the 3-word windows at these ascending positions."""
    width = F.transform(starts, lambda p, k: F.least(
        F.lit(3), F.coalesce(F.get(starts, k + 1) - p, F.lit(3))))
    total = F.aggregate(width, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.coalesce(total, F.lit(0).cast("bigint"))


def measures(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)
             ) -> DataFrame:
    """The columns ``carry`` and every count that the rules refer to."""
    t = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    t = t.select(*carry, "_text", words(F.col("_text")).alias("_words"),
                 F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
                 .alias("_lines"))
    w = F.col("_words")
    window = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    t = t.select(
        *carry, "_lines",
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("bigint")
        .alias("n_stop_words"),
        F.slice(window, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))).alias("_windows"))
    t = t.select(*carry, "_lines", "n_words", "word_chars", "n_symbols", "n_stop_words",
                 _sorted_windows(F.col("_windows")).alias("_sorted"))
    t = t.select(*carry, "_lines", "n_words", "word_chars", "n_symbols", "n_stop_words",
                 _repeated_starts(F.col("_sorted")).alias("_starts"))
    lines = F.col("_lines")
    count = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))).cast("bigint")
    return t.select(
        *carry, "n_words", "word_chars", "n_symbols", "n_stop_words",
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        count(r"(\.\.\.|…)" + SPACE + r"*$").alias("n_ellipsis_lines"),
        count("^" + SPACE + r"*[-*•‣●]").alias("n_bullet_lines"),
        _covered_words(F.col("_starts")).alias("n_repeat_words"))


def base_failed() -> Column:
    """The contract's base rule."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, rules=RULES, text: str = "text",
                  carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry``, every measure, ``base_failed`` and ``kept`` of each row of ``docs``."""
    m = measures(docs, text, carry).withColumn("base_failed", base_failed())
    return m.withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def kept_documents(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    cols = docs.columns
    key = "_" + "_".join(cols)  # no column of the input has this name
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias(key), text)
    judged = quality_rules(whole, rules, text, carry=(key,))
    # The row number keeps the optimizer from pushing the filter below the
    # projections, where every measure would be computed anew for each mention.
    once = judged.select(key, "kept", F.monotonically_increasing_id().alias("_row"))
    return once.where(F.col("kept") & (F.col("_row") >= 0)).select(f"{key}.*")


def query(spark, sf_dir):
    from quarry.llm.text import table
    q = quality_rules(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", "base_failed", "kept")


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM d, unnest(range(1, len(ws) - 1)) AS u(i)
), repeated AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM repeated, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop,
         len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ell,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣●]'))) AS n_bul,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_words >= 50 AND word_chars BETWEEN 2 * n_words AND 12 * n_words
        AND n_symbols <= 0.1 * n_words AND n_stop >= 2 AND n_dup_lines <= 0.5 * n_lines
        AND n_ell <= 0.3 * n_lines AND n_bul <= 0.9 * n_lines
        AND n_repeat_words <= 0.5 * n_words) AS kept
FROM f
"""
