"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every whole text.  The hashes of their values are then counted
over the corpus by distinct owners and repositories: a value that ``copied_owners`` or
more owners hold is a widely copied example, one that stays with its owner and looks
random is a live-looking credential.

Base candidates (assignments, access keys, hex runs) are always reported; the method
adds the spans of further kinds (key blocks, provider tokens, passwords in urls) that
are not widely copied and that no single base span contains whole.  Texts are scanned once and their
candidates written as a table; only (hash, owner, repository) are shuffled, and combined
on the way, so an example that a third of the corpus holds costs a row a task.

Defined results: null and empty texts have no spans; a null owner or repository counts
as one of its own; rows of equal ids are judged one by one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import table
from quarry.session import write_phase_table

BASE_KINDS = ("assign", "access", "hex")
#: Owners from which a value counts as a widely copied example.
COPIED_OWNERS = 3
#: Bits of entropy a character and length from which a value looks random.
MIN_ENTROPY, MIN_LENGTH = 3.0, 12

# Matches that are too short are dropped, and the search goes on behind them.
_ASSIGN = re.compile(
    r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}+")
_HEX = re.compile(r"[0-9a-f](?<![0-9a-f][0-9a-f])[0-9a-f]{31,}+")
# Public formats of further secrets; group 1 is the value.
EXTRA = (
    ("key_block", "PRIVATE KEY-----", re.compile(
        r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----([A-Za-z0-9+/=\s]{40,}+)")),
    ("github", "gh", re.compile(r"\b(gh[pousr]_[A-Za-z0-9]{36,255})\b")),
    ("slack", "xox", re.compile(r"\b(xox[abprs]-[A-Za-z0-9-]{10,250})\b")),
    ("google", "AIza", re.compile(r"\b(AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9_-])")),
    ("jwt", "eyJ", re.compile(r"\b(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)")),
    ("url_password", "://", re.compile(r"://[^\s/:@]{1,64}:([^\s/:@]{8,128})@")),
)
KINDS = (*BASE_KINDS, *(k for k, _, _ in EXTRA))
_PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your|dummy|sample|xxxx|1234567|abcdef")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed."""
    found = [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def extra_spans(text: str, base: list) -> list[tuple[str, int, int, str]]:
    found = []
    for kind, part, pattern in EXTRA:
        if part in text:
            found += [(kind, m.start(), m.end(), m[1]) for m in pattern.finditer(text)
                      if not any(s <= m.start() and m.end() <= e for _, s, e, _ in base)]
    return found


def looks_random(value: str) -> bool:
    n = len(value)
    if n < MIN_LENGTH or _PLACEHOLDER.search(value):
        return False
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= MIN_ENTROPY


_FOUND = pa.list_(pa.struct([("ord", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                             ("value", pa.int64()), ("random", pa.bool_())]))


def _hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests, found = [], []
        for text in b.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            digests.append(hashlib.sha256(
                ",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest())
            found.append([{"ord": KINDS.index(k), "start": s, "end": e, "value": _hash(v),
                           "random": looks_random(v)}
                          for k, s, e, v in [*base, *extra_spans(text, base)]])
        kept = [i for i, name in enumerate(b.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in kept), pa.array(digests, pa.string()), pa.array(found, _FOUND)],
            names=[*(b.schema.names[i] for i in kept), "base_sha256", "found"])


def find_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"),
                 copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Of each row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_copied and
    n_live (its widely copied and its owner-specific, random-looking candidates)."""
    repo = F.to_json(F.array(*[F.col(c).cast("string") for c in repository]))
    d = docs.select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
                    repo.alias("repo"), "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    scanned = d.mapInArrow(_scan, f"doc_id {kind}, owner string, repo string, base_sha256 string, "
                           "found array<struct<ord:int,start:bigint,end:bigint,value:bigint,"
                           "random:boolean>>")
    # the row number is written once and read from there on
    scanned = write_phase_table(scanned.withColumn("row", F.monotonically_increasing_id()),
                                "secret-candidates")
    each = scanned.select("row", "owner", "repo", F.explode("found").alias("f"))
    held = each.select(F.col("f.value").alias("value"), "owner", "repo").distinct()
    owners = write_phase_table(held.groupBy("value").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct("owner", "repo").alias("repos")),
        "secret-owners")
    known = each.select("row", "f", F.col("f.value").alias("value")).join(owners, "value")
    copied = F.col("owners") >= copied_owners
    shown = F.when((F.col("f.ord") < len(BASE_KINDS)) | ~copied, F.struct(
        F.col("f.start").alias("start"), F.col("f.ord").alias("ord"), F.col("f.end").alias("end")))
    count = lambda c: F.count_if(c)
    per_row = known.groupBy(F.col("row").alias("_row")).agg(
        *[count(F.col("f.ord") == i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)],
        F.sort_array(F.collect_list(shown)).alias("_spans"), count(copied).alias("n_copied"),
        count(~copied & F.col("f.random")).alias("n_live"))
    got = scanned.select("row", "doc_id", "base_sha256").join(
        per_row, F.col("row") == F.col("_row"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return got.select("doc_id", *[zero(f"n_{k}") for k in BASE_KINDS], "base_sha256",
                      F.coalesce(_joined(F.col("_spans")), F.lit("")).alias("spans"),
                      zero("n_copied"), zero("n_live"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
