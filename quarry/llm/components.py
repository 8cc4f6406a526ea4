"""Connected components of a graph of long node ids, by large-star / small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import write_phase_table


def _star(edges: DataFrame, large: bool, name: str) -> DataFrame:
    """One star round: every node's neighbours are tied to the least of them.

    Large stars move the greater neighbours, small stars the lesser ones and the
    node itself.  The least is taken with map-side combining and joined back, so a
    node of many neighbours is never gathered in one place."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a table of its own, so that both sides of the join are plain shuffles and Spark
    # can split the hot ones
    least = write_phase_table(both.groupBy("a").agg(F.min("b").alias("m"))
                              .select("a", F.least("a", "m").alias("m")), name)
    tied = both.join(least, "a")
    if large:
        moved = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"),
                                                          F.col("m").alias("b"))
        return moved.where(F.col("a") != F.col("b")).distinct()
    moved = tied.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has the long columns a and b.

    Each round is written to the checkpoint folder, so lineage stays short and a lost
    executor costs a reread.  Rounds end when the edges, by count and sum of hashes,
    stay as they are; the trees are then stars around their least node."""
    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    e = write_phase_table(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), name)
    before = state(e)
    while before[0]:
        e = write_phase_table(_star(write_phase_table(_star(e, True, name), name), False, name), name)
        after = state(e)
        if tuple(after) == tuple(before):
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
