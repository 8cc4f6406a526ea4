"""Content-addressed keys.

All hashes are computed per row on the executors; only 16/32-char keys ever
cross a shuffle, never file content.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_md5(value) -> Column:
    """First 16 hex chars of md5 over the UTF-8 bytes (content / prompt hash)."""
    return F.substring(F.md5(_c(value)), 1, 16)


content_hash = short_md5
prompt_hash = short_md5


def _part(c) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def scan_key(scanner_name, path, c_hash, p_hash, thinking) -> Column:
    """md5 of ``scanner_name:path:content_hash:prompt_hash:thinking``."""
    return F.md5(F.concat_ws(":", _part(scanner_name), _part(path), _part(c_hash),
                             _part(p_hash), _part(thinking)))


def verify_key(scanner_name, path, c_hash, findings_sig, verify_p_hash, thinking) -> Column:
    """md5 of ``verify:scanner_name:path:content_hash:signature:verify_prompt_hash:thinking``."""
    return F.md5(F.concat_ws(":", F.lit("verify"), _part(scanner_name), _part(path),
                             _part(c_hash), _part(findings_sig), _part(verify_p_hash),
                             _part(thinking)))


# Field / record separators of the canonical finding encoding.  The signature
# is an internal key, so it only has to be stable and injective in practice.
FIELD_SEP = "\u001f"
RECORD_SEP = "\u001e"
NULL_MARK = "\u0001"

SIGNATURE_FIELDS = ["line_raw", "severity", "code", "explanation", "fix", "source", "sink"]


def finding_canonical(f: Column) -> Column:
    """One finding struct -> canonical text (tags joined, nulls marked)."""
    parts = [F.coalesce(f[name].cast("string"), F.lit(NULL_MARK)) for name in SIGNATURE_FIELDS]
    parts.append(F.coalesce(F.array_join(f["tags"], ","), F.lit(NULL_MARK)))
    return F.concat_ws(FIELD_SEP, *parts)


def findings_signature(findings) -> Column:
    """Signature of an ordered findings array (array<struct>, already in order)."""
    arr = _c(findings)
    return short_md5(F.array_join(F.transform(arr, finding_canonical), RECORD_SEP))
