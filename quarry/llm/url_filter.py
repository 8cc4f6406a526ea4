"""URL filter: allow and block rules, then exact membership in a host list by a cascade
of Bloom filters.

The corpus's own hosts are the complete key universe, so a filter's false positives can
be listed: level 1 encodes the listed hosts, level 2 the unlisted hosts that level 1
lets through, level 3 the listed hosts that level 2 lets through, and so on until none
is left.  A host's first level that denies it tells its side, exactly, and pages are
judged in one projection: the bits are binary literals, no join and no shuffle.

Level 1 lets sqrt(1/2) * listed / unlisted of the unlisted hosts through and the others
half, which keeps the whole cascade at a few bits a listed host.  Hosts are dealt by
hash into as many cascades as keep each below ``block_hosts`` listed ones, and pages
pass the cascades in turn, so no literal grows with the list.

Defined results: a null url or one without ``://`` has an empty host and path, fits no
rule and is allowed; rows of equal ids are judged one by one; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import ascii_lower, table
from quarry.session import write_phase_table


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# Fixed values of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Hosts with one of these in a label are listed: link farms and pill or betting sites.
LISTED_TERMS = ("spam", "pills", "casino", "viagra", "betting", "replica", "payday", "xxx")
#: Most listed hosts of one cascade.
BLOCK_HOSTS = 1 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, rule verdict) of the longest rule that fits; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text).otherwise(text)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    """A Bloom filter: ``bits`` of size ``m``, ``k`` draws a key; seeded by its number."""

    number: int
    m: int
    k: int
    bits: bytes

    def has(self, key: Column) -> Column:
        return reduce(lambda a, b: a & b, [self._bit(p) for p in positions(
            key, self.number, self.m, self.k)])

    def _bit(self, pos: Column) -> Column:
        within = (pos % 64).cast("int")
        byte = F.substring(F.lit(self.bits), ((pos / 64).cast("bigint") * 8 + 8
                                              - (within / 8).cast("int")).cast("int"), F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.getbit(value, within % 8) == 1


def positions(key: Column, number: int, m: int, k: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(number * 64 + j), key), F.lit(m)) for j in range(k)]


def _level(keys: DataFrame, number: int, rate: float) -> Level | None:
    """The filter of all keys at a rate of false positives; None without keys."""
    n = keys.count()
    if not n:
        return None
    k = max(1, round(math.log2(1 / rate)))
    m = 64 * max(1, math.ceil(n * math.log2(1 / rate) / math.log(2) / 64))
    pos = keys.select(F.explode(F.array(*positions(F.col("key"), number, m, k))).alias("p"))
    # shift by parts: the sign bit is a bit like any other
    word = pos.groupBy((F.col("p") / 64).cast("bigint").alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("v"))
    every = keys.sparkSession.range(m // 64).select(F.col("id").alias("w"))
    dense = every.join(word, "w", "left").select("w", F.lpad(F.hex(
        F.coalesce("v", F.lit(0).cast("bigint"))), 16, "0").alias("x"))
    hexed = dense.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("w", "x"))), lambda s: s["x"]), "").alias("h"))
    return Level(number, m, k, bytes(hexed.select(F.unhex("h")).first()[0]))


def build_cascade(keys: DataFrame) -> list[Level]:
    """Levels over ``keys`` (key, listed), the complete universe without repeats."""
    keys = write_phase_table(keys, "cascade-keys")
    other, own = keys.where("not listed"), keys.where("listed")
    n_own, n_other = own.count(), other.count()
    levels: list[Level] = []
    rate = min(0.5, math.sqrt(0.5) * n_own / n_other) if n_other else 0.5
    while level := _level(own, len(levels) + 1, rate):
        levels.append(level)
        through = write_phase_table(other.where(level.has(F.col("key"))), "cascade-level")
        other, own, rate = own, through, 0.5
    return levels


def listed_by(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed, by the first level that denies it."""
    answer = F.lit(len(levels) % 2 == 1)
    for level in reversed(levels):
        answer = F.when(~level.has(key), F.lit(level.number % 2 == 0)).otherwise(answer)
    return answer


def judge(pages: DataFrame, listed: Column | None = None, rules=RULES, url: str = "url",
          carry: tuple[str, ...] = ("page_id",), block_hosts: int = BLOCK_HOSTS) -> DataFrame:
    """``carry``, host, path, rule, listed (null where a rule decides) and verdict.

    ``listed`` says of the column ``key`` (a host) whether the list has it; it is read
    when the cascade is built, once a host."""
    if listed is None:
        listed = F.col("key").rlike("|".join(LISTED_TERMS))
    host, path = host_and_path(F.col(url))
    p = pages.select(*carry, host.alias("host"), path.alias("path"))
    hosts = write_phase_table(p.where("host <> ''").select(F.col("host").alias("key")).distinct()
                              .withColumn("listed", F.coalesce(listed, F.lit(False))), "hosts")
    n = hosts.where("listed").count()
    blocks = -(-n // block_hosts) or 1
    text, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", text).withColumn("_v", verdict)
    deal = lambda c, b: F.pmod(F.xxhash64(F.lit(0), c), F.lit(blocks)) == b
    parts = []
    for b in range(blocks):
        levels = build_cascade(hosts if blocks == 1 else hosts.where(deal(F.col("key"), b)))
        mine = p if blocks == 1 else p.where(deal(F.col("host"), b))
        parts.append(mine.withColumn("listed", F.when(F.col("rule").isNull(), (
            F.col("host") != "") & listed_by(levels, F.col("host")))))
    got = reduce(DataFrame.unionByName, parts)
    return got.select(*carry, "host", "path", "rule", "listed", F.coalesce(
        "_v", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages")).drop("listed")


def _rules_sql(value) -> str:
    cases = "".join(
        f" WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
        f" THEN '{value(r)}'" for r in sorted(RULES, key=lambda r: -len(r.text)))
    return f"CASE{cases} END"


ORACLE = rf"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                  ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
)
SELECT page_id, host, path, {_rules_sql(lambda r: r.text)} AS rule,
       coalesce({_rules_sql(lambda r: r.verdict)},
                CASE WHEN regexp_matches(host, '{"|".join(LISTED_TERMS)}') THEN 'block'
                ELSE 'allow' END) AS verdict
FROM h
"""
