"""Path predicates and derived attributes (B1-B7) as JVM-side column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.registry import (BINARY_EXTS, EXCLUDE_DIRS, EXCLUDE_FILES, NUL_SNIFF_BYTES,
                             STATE_DIR_PREFIX)

# A leading-dot-only name (".env") has no suffix; otherwise the suffix is the
# last ".x" of the final path component.
SUFFIX_PATTERN = r"[^/.][^/]*([.][^./]+)$"
EXCLUDED_DIR_PATTERN = "^(" + "|".join(re.escape(d) for d in EXCLUDE_DIRS) + ")/"
STATE_DIR_PATTERN = "(^|/)" + re.escape(STATE_DIR_PREFIX) + "[^/]*/"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_path(path) -> Column:
    """Drop ``./`` segments and duplicate slashes so relative paths compare equal."""
    p = F.regexp_replace(_c(path), r"(^|/)(\./)+", "$1")
    p = F.regexp_replace(p, "/{2,}", "/")
    return F.regexp_replace(p, "^/+", "")


def basename(path) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def extension(path) -> Column:
    """Lower-cased suffix of the final component; ``.env`` -> ''."""
    return F.lower(F.regexp_extract(_c(path), SUFFIX_PATTERN, 1))


def excluded_dir(path) -> Column:
    """An ancestor directory is excluded (top-level name / full prefix, or state dir)."""
    p = _c(path)
    return p.rlike(EXCLUDED_DIR_PATTERN) | p.rlike(STATE_DIR_PATTERN)


def excluded_file(path) -> Column:
    return basename(path).isin(EXCLUDE_FILES)


def excluded_path(path) -> Column:
    """B2: the predicate re-applied to stored results at report time."""
    return excluded_dir(path) | excluded_file(path)


def binary_ext(ext) -> Column:
    return _c(ext).isin(BINARY_EXTS)


def has_nul(content, sniff_bytes: int = NUL_SNIFF_BYTES) -> Column:
    """NUL in the first ``sniff_bytes`` bytes (binary content) or characters (text)."""
    return F.instr(F.substring(_c(content), 1, sniff_bytes), "\u0000") > 0


def has_nul_bytes(content, sniff_bytes: int = NUL_SNIFF_BYTES) -> Column:
    head = F.substring(_c(content), 1, sniff_bytes)
    return F.contains(head, F.lit(bytearray(b"\x00")))


SKIP_REASONS = ("excluded_dir", "excluded_file", "binary_ext", "oversized", "nul_bytes")


def skip_reason(path, ext, size, content, max_file_size: int, content_is_binary=False) -> Column:
    """First failing corpus check, evaluated cheapest first; NULL = kept."""
    nul = has_nul_bytes(content) if content_is_binary else has_nul(content)
    reason = (F.when(excluded_dir(path), "excluded_dir")
              .when(excluded_file(path), "excluded_file")
              .when(binary_ext(ext), "binary_ext"))
    if max_file_size and max_file_size > 0:
        reason = reason.when(_c(size) > F.lit(max_file_size), "oversized")
    return reason.when(nul, "nul_bytes")
