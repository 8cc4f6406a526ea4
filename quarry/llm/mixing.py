"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Every document's size (words) is counted once; sources get targets: their
   weight's share of ``share`` times all words, stopped at ``epochs`` times their
   own size, the excess dealt again by weight until none is above.
2. A source is cut into shards by a seeded hash of its documents (the hash of a hot
   source's documents spreads it over many shards), a shard's documents stand in
   seeded order, and a shard's words into equal blocks of about ``block_words``.
3. The blocks that a mix holds go to the sources by highest quotients
   target / (2 k + 1), and a source's blocks to its shards by the same rule, so every
   quota is an integer.
4. A shard takes each block as often as its quota covers all of them, and the rest of
   the quota in the seeded order of its blocks.  A document takes what its blocks take.

Apportionment needs no list of all quotients: the seats that a divisor a little above
the final one gives are certain, and only the at most two seats a party between that
divisor and one a little below are ranked.

Only (doc_id, source, size) leave the scan.  Reruns agree: all seeds are hashes of ids.

Defined results: null texts have size 0 and take 0; null sources are a source of
their own, last in order; rows of equal ids and sizes are interchangeable; an empty
table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.text import table, words
from quarry.session import write_phase_table

WEIGHTS = (3, 1, 2)
SHARE, EPOCHS = 1.5, 2
#: Words of a block and of a shard.
BLOCK_WORDS, SHARD_WORDS = 16, 1 << 20
#: Most tasks that order the blocks of shards.
SHARD_TASKS = 10_000
SEED = 20240501


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", F.size(words(F.col(text))).cast("bigint").alias("size"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS
            ) -> DataFrame:
    """source, source_size and target; one row a source.

    Sources reach their limit in the order of limit / weight.  With the sources in that
    order, a source is at its limit if what is left for it and all later ones, shared
    by weight, gives it at least the limit."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)) + 1)
    s = per.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(epochs))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    s = s.select(
        "source", "source_size", "weight", "limit",
        (F.sum("source_size").over(whole) * share).alias("total"),
        (F.sum("limit").over(by) - F.col("limit")).alias("before"),
        (F.sum("weight").over(whole) - F.sum("weight").over(by) + F.col("weight")).alias("rest"))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    full = F.col("level") * F.col("weight") >= F.col("limit")
    # the first source below its limit sets the level of all later ones
    level = F.min(F.when(~full, F.struct(
        (F.col("limit") / F.col("weight")).alias("ratio"), F.col("source").isNull().alias("none"),
        "source", "level"))).over(whole)["level"]
    s = s.withColumn("_level", level)
    return s.select("source", "source_size", F.when(full, F.col("limit")).otherwise(
        F.least("limit", F.col("_level") * F.col("weight"))).alias("target"))


def apportion(parties: DataFrame, group: list[str], party: list[str], votes: str, seats: str,
              out: str) -> DataFrame:
    """``parties`` with ``out``: the seats that highest quotients votes / (2 k + 1) give a
    party out of its group's ``seats`` (the same number in all rows of a group)."""
    g = Window.partitionBy(*group)
    total, n = F.sum(votes).over(g), F.count(F.lit(1)).over(g)
    p = parties.withColumn("_total", total).withColumn("_n", n)
    won = lambda divisor: F.floor(F.col(votes) / divisor + 0.5).cast("bigint")
    # a divisor that gives no more seats than there are, and one that gives no fewer
    sparse = F.when(F.col(seats) > F.col("_n") / 2,
                    F.col("_total") / (F.col(seats) - F.col("_n") / 2))
    dense = F.col("_total") / (F.col(seats) + F.col("_n") / 2)
    zero = F.lit(0).cast("bigint")
    p = p.withColumn("_sure", F.when(F.col("_total") > 0, F.coalesce(won(sparse), zero))
                     .otherwise(zero))
    p = p.withColumn("_most", F.when(F.col("_total") > 0, F.greatest(won(dense), "_sure"))
                     .otherwise(zero))
    p = p.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    open_ = p.where("_most > _sure").select(
        *group, *party, votes, "_left",
        F.explode(F.sequence(F.col("_sure"), F.col("_most") - 1)).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(
        F.desc(F.col(votes) / (2 * F.col("_k") + 1)), *[F.col(c).asc_nulls_last() for c in party]))
    more = open_.withColumn("_r", rank).where("_r <= _left").groupBy(*group, *party).agg(
        F.count(F.lit(1)).alias("_more"))
    keys = [*group, *party]
    more = more.select(*[F.col(c).alias(f"_m_{c}") for c in keys], "_more")
    same = F.lit(True)
    for c in keys:
        same = same & p[c].eqNullSafe(more[f"_m_{c}"])
    got = p.join(more, same, "left")
    return got.select(*parties.columns, (F.col("_sure") + F.coalesce("_more", zero)).alias(out))


def draw(*parts: Column) -> Column:
    """A seeded draw as text; a digest, so that other engines can repeat it."""
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), *[
        F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def shards_of(sized: DataFrame, quotas: DataFrame, shard_words: int) -> DataFrame:
    """``sized`` with the shard of each document and the figures of its source."""
    q = quotas.select(F.col("source").alias("_s"), "source_size", "target", "source_quota")
    d = sized.join(q, sized["source"].eqNullSafe(q["_s"])).drop("_s")
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    pick = F.conv(F.substring(draw(F.lit("shard"), F.col("doc_id")), 1, 8), 16, 10).cast("bigint")
    return d.withColumn("shard", F.pmod(pick, n).cast("bigint"))


def chosen_blocks(shards: DataFrame, epochs: int, block_words: int) -> DataFrame:
    """source, shard, words, n_blocks, passes (how often all blocks are taken) and extra
    (for each block whether it is taken once more), from the shards' quotas."""
    n = F.greatest(F.lit(1), F.round(F.col("words") / block_words)).cast("bigint")
    s = shards.withColumn("n_blocks", n)
    s = s.withColumn("quota", F.least(F.col("quota"), epochs * F.col("n_blocks")))
    s = s.withColumn("passes", F.floor(F.col("quota") / F.col("n_blocks")).cast("bigint"))
    s = s.withColumn("_more", F.col("quota") - F.col("passes") * F.col("n_blocks"))
    drawn = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(
        draw(F.lit("block"), F.col("source"), F.col("shard"), k).alias("d"), k.alias("k"))))
    s = s.withColumn("_drawn", F.when(F.col("_more") > 0, drawn))
    flags = F.sort_array(F.transform("_drawn", lambda x, i: F.struct(
        x["k"].alias("k"), (i < F.col("_more")).alias("f"))))
    return s.select(F.col("source").alias("_s"), F.col("shard").alias("_shard"), "words",
                    "n_blocks", "passes", F.transform(flags, lambda x: x["f"]).alias("extra"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, text: str = "text"
        ) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes)."""
    sized = write_phase_table(sizes(docs, text), "mix-sizes")
    per = write_phase_table(targets(sized, weights, share, epochs), "mix-targets")
    blocks = per.withColumn("_blocks", F.round(
        F.sum("target").over(Window.partitionBy()) / block_words).cast("bigint"))
    quotas = write_phase_table(apportion(
        blocks, [], ["source"], "target", "_blocks", "source_quota"), "mix-quotas")

    d = shards_of(sized, quotas, shard_words)
    shards = d.where("size > 0").groupBy("source", "shard", "source_quota").agg(
        F.sum("size").alias("words"))
    shards = apportion(shards, ["source"], ["shard"], "words", "source_quota", "quota")
    # a shard is a small row here but much work, so tasks go by their number, not by bytes
    n = per.agg(F.sum(F.ceil(F.col("source_size") / shard_words))).first()[0] or 1
    shards = shards.repartition(max(1, min(int(n), SHARD_TASKS)), "source", "shard")
    shards = write_phase_table(chosen_blocks(shards, epochs, block_words), "mix-shards")

    order = Window.partitionBy("source", "shard").orderBy(
        draw(F.lit("order"), F.col("doc_id")), "doc_id", "size")
    d = d.withColumn("_at", F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    d = d.join(shards, d["source"].eqNullSafe(shards["_s"]) & (d["shard"] == shards["_shard"]),
               "left")
    block = lambda x: F.floor((x * F.col("n_blocks") - 1) / F.col("words")).cast("bigint")
    edge = lambda k: F.floor(k * F.col("words") / F.col("n_blocks")).cast("bigint")
    end = F.col("_at") + F.col("size")
    zero = F.lit(0).cast("bigint")
    once_more = F.aggregate(
        F.sequence(block(F.col("_at") + 1), block(end)), zero,
        lambda a, k: a + F.when(F.get(F.col("extra"), k.cast("int")),
                                F.least(end, edge(k + 1)) - F.greatest(F.col("_at"), edge(k)))
        .otherwise(zero))
    taken = F.when(F.col("size") == 0, zero).otherwise(
        F.col("passes") * F.col("size")
        + F.when(F.col("extra").isNull(), zero).otherwise(once_more))
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def query(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("source")


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''),
         '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents
), s0 AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source
), s1 AS (
  SELECT source, source_size, w, 2.0::DOUBLE * source_size AS lim,
         (sum(source_size) OVER ()) * 1.5::DOUBLE AS total,
         sum(2.0::DOUBLE * source_size) OVER o - 2.0::DOUBLE * source_size AS before,
         sum(w) OVER () - sum(w) OVER o + w AS rest
  FROM s0 WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST)
), s2 AS (
  SELECT *, (total - before) / rest AS lev, (total - before) / rest * w >= lim AS is_full FROM s1
), s3 AS (
  SELECT *, first_value(lev) OVER (ORDER BY is_full, lim / w, source NULLS LAST) AS open_lev FROM s2
), per AS (
  SELECT source, source_size, CASE WHEN is_full THEN lim ELSE least(lim, open_lev * w) END AS target
  FROM s3
), seats AS (SELECT round(sum(target) / {BLOCK_WORDS})::BIGINT AS n FROM per),
q AS (  -- the seats of highest quotients
  SELECT source, count(*) AS quota FROM (
    SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS r
    FROM per, unnest(range(0, (target / {BLOCK_WORDS})::BIGINT + 3)) AS u(k))
  WHERE r <= (SELECT n FROM seats) GROUP BY source
), d AS (
  SELECT doc_id, sized.source, size, source_size, target, coalesce(quota, 0) AS source_quota,
         ('0x' || substr(md5('{SEED}|shard|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
           % greatest(1, ceil(source_size / {SHARD_WORDS}))::BIGINT AS shard
  FROM sized JOIN per ON sized.source IS NOT DISTINCT FROM per.source
  LEFT JOIN q ON sized.source IS NOT DISTINCT FROM q.source
), sh0 AS (
  SELECT source, shard, source_quota, sum(size) AS words FROM d WHERE size > 0 GROUP BY ALL
), sh1 AS (
  SELECT source, shard, count(*) AS quota FROM (
    SELECT source, shard, source_quota, row_number() OVER (
             PARTITION BY source ORDER BY words / (2 * k + 1) DESC, shard) AS r
    FROM sh0, unnest(range(0, source_quota)) AS u(k)) WHERE r <= source_quota GROUP BY ALL
), sh AS (
  SELECT *, least(coalesce(quota, 0), 2 * n) AS take FROM (
    SELECT sh0.source, sh0.shard, words, quota,
           greatest(1, round(words / {BLOCK_WORDS}))::BIGINT AS n
    FROM sh0 LEFT JOIN sh1 ON sh0.source IS NOT DISTINCT FROM sh1.source AND sh0.shard = sh1.shard)
), b AS (
  SELECT source, shard, words, n, take, k, take // n + CASE WHEN row_number() OVER (
           PARTITION BY source, shard
           ORDER BY md5('{SEED}|block|' || coalesce(source, '') || '|' || shard || '|' || k), k)
         <= take % n THEN 1 ELSE 0 END AS times,
         floor(k * words / n)::BIGINT AS lo, floor((k + 1) * words / n)::BIGINT AS hi
  FROM sh, unnest(range(0, n)) AS u(k)
), p AS (
  SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY
           md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, '')), doc_id, size) - size AS a FROM d
)
SELECT p.doc_id, any_value(p.size)::BIGINT AS size,
       any_value(p.source_size)::BIGINT AS source_size, any_value(p.target) AS target,
       coalesce(sum(times * (least(a + size, hi) - greatest(a, lo))), 0)::BIGINT AS taken
FROM p LEFT JOIN b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard
  AND b.lo < p.a + p.size AND b.hi > p.a
GROUP BY p.doc_id
"""
