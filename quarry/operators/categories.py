"""The registry as tables -- categories, their extensions and file names, prompt
templates and rules are rows, and a new category needs rows only.

``Registry.builtin`` has the fixed registry; ``extended`` adds rows.  Tables are checked
against bounds when a registry is made (``MAX_*``: more is an error, nothing is dropped), so
that looking them up next to the files may broadcast them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import registry as R
from quarry.functions import keys as K
from quarry.operators.analysts import DEFAULT_RULES, Rule, rules_from_df
from quarry.operators.targets import normalize_ext

CATEGORY_DDL = ("scanner string, ord int, scanner_name string, scanner_label string, "
                "template string")
EXTENSION_DDL = "scanner string, pos int, ext string"
NAME_DDL = "scanner string, name string"
RULE_DDL = ("rule_ord int, rule_id string, scanner string, severity string, pattern string, "
            "explanation string, fix string, source string, sink string")
MAX_CATEGORIES, MAX_LOOKUPS, MAX_RULES = 1_000, 100_000, 2_000


@dataclass(frozen=True)
class Registry:
    """``categories`` (a null template: the built-in wording), ``extensions`` in their order,
    ``names`` and ``rules`` (the order of ``rule_ord`` is that of findings on a line)."""

    categories: DataFrame
    extensions: DataFrame
    names: DataFrame
    rules: DataFrame

    @staticmethod
    def builtin(spark: SparkSession) -> Registry:
        every = R.scanners()
        rules = [(i, r.rule_id, r.scanner, r.severity, r.pattern, r.explanation, r.fix, r.source,
                  r.sink) for i, r in enumerate(DEFAULT_RULES)]
        return Registry(
            spark.createDataFrame([(s.id, s.ord, s.name, s.label, None) for s in every],
                                  CATEGORY_DDL),
            spark.createDataFrame([(s.id, p, e) for s in every
                                   for p, e in enumerate(s.base_ext)], EXTENSION_DDL),
            spark.createDataFrame([(s.id, n) for s in every for n in s.base_names], NAME_DDL),
            spark.createDataFrame(rules, RULE_DDL)).checked()

    def extended(self, categories: list[tuple] | DataFrame = (),
                 extensions: list[tuple] | DataFrame = (), names: list[tuple] | DataFrame = (),
                 rules: list[tuple] | DataFrame = ()) -> Registry:
        """This registry and further rows of each table."""
        def more(table: DataFrame, rows, ddl: str) -> DataFrame:
            if not isinstance(rows, DataFrame):
                rows = table.sparkSession.createDataFrame(list(rows), ddl)
            return table.unionByName(rows.select(*table.columns))
        return Registry(more(self.categories, categories, CATEGORY_DDL),
                        more(self.extensions, extensions, EXTENSION_DDL),
                        more(self.names, names, NAME_DDL),
                        more(self.rules, rules, RULE_DDL)).checked()

    def only(self, ids: list[str]) -> Registry:
        """The registry of some categories."""
        def mine(table: DataFrame) -> DataFrame:
            return table.where(F.col("scanner").isin(*ids))
        return replace(self, categories=mine(self.categories), extensions=mine(self.extensions),
                       names=mine(self.names), rules=mine(self.rules))

    def checked(self) -> Registry:
        """An error where a table is larger than its bound, an id or name is not one
        category's, or a row belongs to none."""
        for table, most in ((self.categories, MAX_CATEGORIES), (self.extensions, MAX_LOOKUPS),
                            (self.names, MAX_LOOKUPS), (self.rules, MAX_RULES)):
            if table.limit(most + 1).count() > most:
                raise ValueError(f"registry: over {most} rows of {table.columns}")
        known = self.categories.select("scanner", "scanner_name").collect()
        for of in ("scanner", "scanner_name"):
            seen = [r[of] for r in known]
            if None in seen or len(set(seen)) < len(seen):
                raise ValueError(f"registry: {of} is not one category's: {sorted(map(str, seen))}")
        ids = {r["scanner"] for r in known}
        for table in (self.extensions, self.names, self.rules):
            stray = {r["scanner"] for r in table.select("scanner").distinct().collect()} - ids
            if stray:
                raise ValueError(f"registry: rows of no category: {sorted(map(str, stray))}")
        return self

    def ids(self) -> list[str]:
        """Category ids in their order (``checked`` bounds them)."""
        return [r["scanner"] for r in self.categories.orderBy("ord", "scanner").collect()]

    def ext_index(self) -> DataFrame:
        ext = F.lower(F.trim("ext"))
        key = F.when(ext.startswith("."), ext).otherwise(F.concat(F.lit("."), ext))
        return _index(self.extensions.select(key.alias("key"), "scanner"))

    def override_index(self, extensions: list[str]) -> DataFrame:
        """The same extensions for every category, in place of their own."""
        every = F.array(*[F.lit(e) for e in dict.fromkeys(map(normalize_ext, extensions))])
        return _index(self.categories.select(F.explode(every).alias("key"), "scanner"))

    def name_index(self) -> DataFrame:
        return _index(self.names.select(F.col("name").alias("key"), "scanner"))

    def catalog(self) -> DataFrame:
        """A4: scanner, scanner_name, scanner_label, ord, template, prompt_hash."""
        wording = F.lit(R.prompt_wording("{id}", "{name}", "{label}"))
        for mark, col in (("{id}", "scanner"), ("{name}", "scanner_name"),
                          ("{label}", "scanner_label")):
            wording = F.replace(wording, F.lit(mark), F.col(col))
        text = F.coalesce("template", wording)
        return self.categories.select("scanner", "scanner_name", "scanner_label", "ord",
                                      text.alias("template"), K.prompt_hash(text).alias("prompt_hash"))

    def labels(self) -> DataFrame:
        return self.categories.select("scanner", "scanner_label")

    def rule_list(self) -> list[Rule]:
        """The rules in order; they become one projection, and ``checked`` bounds them."""
        return rules_from_df(self.rules.orderBy("rule_ord", "rule_id"))


def _index(rows: DataFrame) -> DataFrame:
    """Lookups by key, broadcast: ``checked`` bounds them, and without the hint the texts
    would be dealt out by extension, a third of them to one task."""
    return F.broadcast(rows.groupBy("key").agg(F.array_sort(F.collect_set("scanner")).alias("scanners")))
