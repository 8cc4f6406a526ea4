"""``source_tree`` -- a Python DataSource that reads a directory tree as a corpus.

``spark.read.format("source_tree").option("max_file_size", N).load(root)``
returns ``path STRING, size BIGINT, content BINARY, skip_reason STRING``.

Planning lists names, sizes and times, and deals the files out largest first, each to the
partition that has the least so far, so partitions have about ``partition_bytes`` each
whatever the folders look like; a file costs ``OPEN_BYTES`` besides its own.  Excluded
directories are pruned during the walk (never descended), excluded basenames are dropped,
and the cheap checks run before any byte is read: binary suffix, then size, then the NUL
sniff.  Skipped files are still emitted (without content) so skip counts are exact.  Unlike
``binaryFile`` it keeps hidden / underscore files and empty files.

``readStream`` needs the option ``snapshots``, a folder that outlives the driver: each
listing that differs from the last is kept there under a number, which is the stream's
offset.  A micro-batch has the files that were added or changed (size or time) between two
listings, so a file is read once a version and a replayed batch has the same files; a file
that is gone is a row with the skip reason ``removed``.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceStreamReader,
                                    InputPartition)

from quarry import registry as R
from quarry.functions.paths import EXCLUDED_DIR_PATTERN, STATE_DIR_PATTERN

SCHEMA = "path string, size bigint, content binary, skip_reason string"


# the same patterns the column predicate uses (quarry.functions.paths), applied to
# a directory path with a trailing slash
_EXCLUDED_DIR = re.compile(EXCLUDED_DIR_PATTERN)
_STATE_DIR = re.compile(STATE_DIR_PATTERN)


def _dir_excluded(rel_dir: str) -> bool:
    probe = rel_dir + "/"
    return bool(_EXCLUDED_DIR.search(probe) or _STATE_DIR.search(probe))


def _suffix(name: str) -> str:
    stem = name.lstrip(".")
    if "." not in stem:
        return ""
    last = name.rsplit(".", 1)[1]
    return "." + last.lower() if last else ""


#: What a file costs besides its bytes, in bytes.
OPEN_BYTES, PARTITION_BYTES = 64 << 10, 32 << 20


class TreeFiles(InputPartition):
    def __init__(self, files: list[str], gone: bool = False):
        super().__init__(len(files))
        self.files, self.gone = files, gone


def list_tree(root: str) -> Iterator[tuple[str, int, int]]:
    """Path below the root, size and time (ns) of the files that are not excluded, by name;
    links to files count, links to folders are not followed."""
    folders = [""]
    while folders:
        rel = folders.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, rel)), key=lambda e: e.name)
        except OSError:
            continue
        below = []
        for e in entries:
            child = f"{rel}/{e.name}" if rel else e.name
            try:
                if e.is_dir(follow_symlinks=False):
                    if not _dir_excluded(child):
                        below.append(child)
                elif e.is_file() and e.name not in R.EXCLUDE_FILES:
                    st = e.stat()
                    yield child, st.st_size, st.st_mtime_ns
            except OSError:  # gone meanwhile
                continue
        folders.extend(reversed(below))


def deal(files: list[tuple[str, int]], partition_bytes: int) -> list[list[str]]:
    """Files (path, bytes to read) in groups of about equal cost: largest first, each to the
    group that has the least."""
    cost = [(size + OPEN_BYTES, path) for path, size in files]
    n = min(len(cost), -(-sum(c for c, _ in cost) // partition_bytes))
    groups: list[list[str]] = [[] for _ in range(n)]
    loads = [(0, i) for i in range(n)]
    for c, path in sorted(cost, key=lambda x: (-x[0], x[1])):
        load, i = heapq.heappop(loads)
        groups[i].append(path)
        heapq.heappush(loads, (load + c, i))
    return [sorted(g) for g in groups]


class TreeOptions:
    def __init__(self, options: dict):
        self.root = os.path.abspath(options["path"])
        self.max_file_size = int(options.get("max_file_size", R.DEFAULT_MAX_FILE_SIZE))
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        if self.partition_bytes < 1:
            raise ValueError("partition_bytes is 1 or more")

    def _dealt(self, files: list[tuple[str, int]]) -> list[TreeFiles]:
        """Partitions; a file that will not be read costs its open only."""
        def cost(path: str, size: int) -> int:
            unread = _suffix(os.path.basename(path)) in R.BINARY_EXTS or \
                0 < self.max_file_size < size
            return 0 if unread else size
        return [TreeFiles(g) for g in
                deal([(p, cost(p, n)) for p, n in files], self.partition_bytes)]

    def _file_row(self, rel: str, full: str):
        name = os.path.basename(rel)
        if name in R.EXCLUDE_FILES:
            return None
        try:
            size = os.stat(full).st_size
        except OSError:
            return None
        if _suffix(name) in R.BINARY_EXTS:
            return (rel, size, None, "binary_ext")
        if self.max_file_size > 0 and size > self.max_file_size:
            return (rel, size, None, "oversized")
        try:
            with open(full, "rb") as fh:
                data = fh.read()
        except OSError:
            return (rel, size, None, "unreadable")
        if b"\x00" in data[:R.NUL_SNIFF_BYTES]:
            return (rel, size, None, "nul_bytes")
        return (rel, size, bytearray(data), None)

    def read(self, partition: TreeFiles) -> Iterator[tuple]:
        for rel in partition.files:
            if partition.gone:
                yield (rel, 0, None, "removed")
                continue
            row = self._file_row(rel, os.path.join(self.root, rel))
            if row is not None:
                yield row


class SourceTreeReader(TreeOptions, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        # Spark wants one partition at least
        return self._dealt([(p, n) for p, n, _ in list_tree(self.root)]) or [TreeFiles([])]


class SourceTreeStream(TreeOptions, DataSourceStreamReader):
    """Offsets are numbers of listings; 0 is the empty one."""

    def __init__(self, options: dict):
        super().__init__(options)
        if "snapshots" not in options:
            raise ValueError("a stream of a tree needs the option snapshots, a folder that stays")
        self.folder = os.path.abspath(options["snapshots"])
        os.makedirs(self.folder, exist_ok=True)

    def _file(self, number: int) -> str:
        return os.path.join(self.folder, f"listing-{number:012d}.json")

    def _listing(self, number: int) -> dict[str, list[int]]:
        if number == 0:
            return {}
        with open(self._file(number), encoding="utf-8", errors="surrogateescape") as fh:
            return json.load(fh)

    def _last(self) -> int:
        names = [n for n in os.listdir(self.folder) if re.fullmatch(r"listing-\d{12}\.json", n)]
        return max((int(n[8:20]) for n in names), default=0)

    def initialOffset(self) -> dict:
        return {"listing": 0}

    def latestOffset(self) -> dict:
        number = self._last()
        now = {p: [size, at] for p, size, at in list_tree(self.root)}
        if now != self._listing(number):
            number += 1
            made = self._file(number) + f".{os.getpid()}"
            with open(made, "w", encoding="utf-8", errors="surrogateescape") as fh:
                json.dump(now, fh)
                fh.flush()
                os.fsync(fh.fileno())
            os.replace(made, self._file(number))
        return {"listing": number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        old, new = self._listing(start["listing"]), self._listing(end["listing"])
        gone = [p for p in old if p not in new]
        told = [TreeFiles(gone[i:i + 100_000], True) for i in range(0, len(gone), 100_000)]
        return self._dealt([(p, v[0]) for p, v in new.items() if old.get(p) != v]) + told

    def commit(self, end: dict) -> None:
        """Listings before the last processed one are not needed any more."""
        for name in os.listdir(self.folder):
            if re.fullmatch(r"listing-\d{12}\.json", name) and int(name[8:20]) < end["listing"]:
                os.remove(os.path.join(self.folder, name))


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SourceTreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SourceTreeStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)


def tree_corpus(spark: SparkSession, root: str, max_file_size: int = R.DEFAULT_MAX_FILE_SIZE,
                keep_skipped: bool = False) -> DataFrame:
    """The tree as a corpus (``doc_id, path, name, ext, size, text`` [+ ``skip_reason``])."""
    from quarry.session import ship_package
    ship_package(spark)
    register(spark)
    raw = (spark.read.format("source_tree").option("max_file_size", str(max_file_size))
           .load(root))
    out = _corpus_columns(raw)
    return out if keep_skipped else out.where(F.col("skip_reason").isNull()).drop("skip_reason")


def tree_stream(spark: SparkSession, root: str, snapshots: str,
                max_file_size: int = R.DEFAULT_MAX_FILE_SIZE,
                keep_skipped: bool = False) -> DataFrame:
    """Added and changed files of the tree as a stream of corpus rows; with ``keep_skipped``
    also those that checks leave out or that are gone, with their ``skip_reason``."""
    from quarry.session import ship_package
    ship_package(spark)
    register(spark)
    raw = (spark.readStream.format("source_tree").option("max_file_size", str(max_file_size))
           .option("snapshots", snapshots).load(root))
    out = _corpus_columns(raw)
    return out if keep_skipped else out.where(F.col("skip_reason").isNull()).drop("skip_reason")


def _corpus_columns(raw: DataFrame) -> DataFrame:
    from quarry.functions import paths as P
    from quarry.functions.text import repair_text
    return raw.select(F.xxhash64("path").alias("doc_id"), "path",
                      P.basename("path").alias("name"), P.extension("path").alias("ext"),
                      "size", repair_text("content").alias("text"), "skip_reason")
