"""Corpus sources (A1/A2): any (path, content) table becomes the corpus.

Schema of a corpus DataFrame:
``doc_id BIGINT, path STRING, name STRING, ext STRING, size BIGINT, text STRING``
(``doc_id`` is an opaque file id; ``size`` is the byte length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths as P
from quarry.functions.text import repair_text

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
                 "events", "documents", "embeddings", "pages", "benchmark", "labels",
                 "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_from_table(df: DataFrame, path: str | Column, content: str | Column,
                      doc_id: str | Column | None = None, binary: bool = False) -> DataFrame:
    """Project any table with a path and a content column onto the corpus schema.

    Binary content is decoded with invalid bytes replaced by U+FFFD (A2);
    ``size`` is always the byte length, computed before decoding.
    """
    pc = F.col(path) if isinstance(path, str) else path
    cc = F.col(content) if isinstance(content, str) else content
    idc = (F.col(doc_id) if isinstance(doc_id, str) else doc_id) if doc_id is not None \
        else F.xxhash64(pc)
    norm = P.normalize_path(pc)
    size = F.octet_length(cc).cast("bigint")
    text = repair_text(cc) if binary else cc
    return df.select(idc.cast("bigint").alias("doc_id"), norm.alias("path"),
                     P.basename(norm).alias("name"), P.extension(norm).alias("ext"),
                     size.alias("size"), text.alias("text"))


def synthetic_repo_path(doc_id: str = "doc_id", lang: str = "lang",
                        source: str = "source") -> Column:
    """Repository-like path for a documents row.

    Spreads rows over top-level dirs (some excluded, some state-dir
    backups), language/source folders and file kinds (incl. an upper-case
    suffix, a binary suffix, a build manifest and a dot-file) so every corpus
    rule is exercised.  Pure function of the row.
    """
    d = F.col(doc_id)
    top = (F.when(d % 41 == 0, "vendor/").when(d % 37 == 0, ".quarry_state_old/")
           .when(d % 31 == 0, "sub/.quarry_state.bak/").otherwise("src/"))
    ext = (F.when(d % 6 == 0, ".py").when(d % 6 == 1, ".js").when(d % 6 == 2, ".Java")
           .when(d % 6 == 3, ".yml").when(d % 6 == 4, ".PNG").otherwise(".sql"))
    fname = (F.when(d % 29 == 0, "pom.xml").when(d % 23 == 0, ".env")
             .otherwise(F.concat(F.lit("f"), ext)))
    return F.concat(top, F.col(lang), F.lit("/"), F.col(source), F.lit("/d"),
                    d.cast("string"), F.lit("/"), fname)


def documents_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table as a source-file corpus."""
    return corpus_from_table(read_table(spark, sf_dir, "documents"), synthetic_repo_path(), "text", doc_id="doc_id")


def page_path(url: str | Column = "url") -> Column:
    """Repository-style path for a web page: host + path, query/fragment dropped,
    ``index.html`` for directory URLs, ``.html`` appended otherwise."""
    u = F.col(url) if isinstance(url, str) else url
    p = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z]+://", ""), r"[?#].*$", "")
    return F.when(p.endswith("/"), F.concat(p, F.lit("index.html"))) \
        .otherwise(F.concat(p, F.lit(".html")))


def pages_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``pages`` table as a second corpus shape: path from the URL, content = html."""
    return corpus_from_table(read_table(spark, sf_dir, "pages"), page_path("url"), "html", doc_id="page_id")
