"""Category registry and the fixed policy values the triage rules depend on.

Everything in the FIXED VALUES block below must stay equal to the
behaviour being matched (category ids, names, labels, extension lists,
exclusion lists, orderings).  Everything else in the engine derives from
these tables.  Further categories are rows of ``quarry.operators.categories``, no code.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match for identical results)
# ---------------------------------------------------------------------------

# (id, name, label, base_ext, base_names) in numeric category order.
SCANNERS: list[tuple[str, str, str, list[str], list[str]]] = [
    ("B1", "access_control", "Broken Access Control",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".rb", ".go", ".kt"], []),
    ("B2", "crypto", "Cryptographic Failures",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".go", ".kt", ".c", ".xml", ".properties"], []),
    ("B3", "injection", "Injection",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".sql", ".rb", ".go", ".kt", ".sh", ".xml",
      ".properties"], []),
    ("B4", "insecure_design", "Insecure Design",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".go", ".kt", ".rb"], []),
    ("B5", "misconfiguration", "Security Misconfiguration",
     [".yml", ".yaml", ".json", ".xml", ".env", ".properties", ".ini", ".conf", ".plist",
      ".gradle"], []),
    ("B6", "vuln_components", "Vulnerable and Outdated Components",
     [".gradle", ".xml", ".json"],
     ["pom.xml", "build.gradle", "settings.gradle", "package.json", "go.mod", "go.sum",
      "Gemfile", "Gemfile.lock", "requirements.txt", "Podfile", "Podfile.lock", "Cargo.toml",
      "Cargo.lock", "composer.json"]),
    ("B7", "auth", "Identification and Authentication Failures",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".rb", ".go", ".kt", ".properties"], []),
    ("B8", "data_integrity", "Software and Data Integrity Failures",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".go", ".kt", ".c", ".xml"], []),
    ("B9", "logging", "Security Logging and Monitoring Failures",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".go", ".kt", ".c", ".properties", ".xml",
      ".conf"], []),
    ("B10", "ssrf", "Server-Side Request Forgery",
     [".java", ".py", ".m", ".h", ".js", ".ts", ".go", ".kt", ".rb", ".properties"], []),
]

# Directories excluded when they are the top-level entry or a full path prefix.
EXCLUDE_DIRS: list[str] = [
    ".quarry_state", ".git", ".svn", "node_modules", "vendor", "build", "dist",
    ".venv", "__pycache__", ".idea", ".vscode", "ThirdParty/wheelhouse",
    "Source/Regression",
]
# Basenames excluded at any depth.
EXCLUDE_FILES: list[str] = [
    "quarry_report.md", "quarry_report.csv", "quarry_report.tsv",
]
# State directories are excluded by name prefix at any depth.
STATE_DIR_PREFIX = ".quarry_state"

# Lower-cased suffixes treated as binary and never read.
BINARY_EXTS: list[str] = [
    ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2",
    ".ttf", ".eot", ".pdf", ".bin", ".gz", ".wav", ".class", ".jar", ".whl",
    ".dylib", ".so", ".a", ".o", ".framework", ".dmg", ".app",
    ".cvsignore", ".super",
]

# Default per-file size cap in bytes: 0, no cap.
DEFAULT_MAX_FILE_SIZE = 0
# Bytes sniffed for a NUL to decide a file is binary.
NUL_SNIFF_BYTES = 8192

SEVERITY_ORDER: dict[str, int] = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
CONFIDENCE_ORDER: dict[str, int] = {
    "High": 3, "Medium": 2, "Low": 1, "Unverified": 0, "Unknown": 0}
SEVERITIES: list[str] = ["Critical", "High", "Medium", "Low"]
CONFIDENCE_LEVELS: list[str] = ["High", "Medium", "Low", "Unverified"]
BUCKETS: list[str] = ["refuted", "not_actionable", "confirmed", "unverified"]
ROW_STATUSES: list[str] = [
    "active", "needs_review", "suppressed", "refuted", "not_actionable", "error", "timeout"]

UNSUBSTANTIATED_TAG = "unsubstantiated"
# A source is "named" unless it is blank; blank = only characters Python's
# str.strip() removes (Unicode whitespace plus the \x1c-\x1f separators).
BLANK_PATTERN = r"(?U)^[\s\x{1c}-\x{1f}]*$"

# Column order of the flat one-row-per-finding report.
REPORT_COLUMNS: list[str] = [
    "scanner", "scanner_label", "file", "line", "severity",
    "code", "explanation", "fix", "source", "sink", "tags",
    "confidence", "exploitable", "verification_reason", "verdict",
    "status", "suppression_reason",
]

# Reply-recovery fallbacks: prose markers meaning "no findings".
NO_FINDINGS_MARKERS: list[str] = [
    "NO_VULNERABILITIES", "NO VULNERABILITIES", "NO_FINDINGS", "NO FINDINGS",
    "EMPTY_ARRAY", "EMPTY ARRAY",
]
ERROR_PREVIEW_CHARS = 2000

# Notable file names listed in the corpus profile sent to discovery.
NOTABLE_FILES: list[str] = [
    "pom.xml", "build.gradle", "settings.gradle", "package.json", "go.mod",
    "requirements.txt", "Gemfile", "Podfile", "Cargo.toml", "composer.json",
    "web.xml", "AndroidManifest.xml", "Info.plist", "Makefile", "GNUmakefile",
]
# Directory levels shown in the corpus profile.
PROFILE_DEPTH = 3

# Verification marks per confidence level in finding details (others: UNKNOWN_MARK).
CONFIDENCE_MARKS: dict[str, str] = {"High": "✅", "Medium": "🟡", "Low": "⚠️"}
UNKNOWN_MARK = "❔"
TAINT_ARROW = " → "

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

SCANNER_IDS: list[str] = [s[0] for s in SCANNERS]
SCANNER_BY_ID = {s[0]: s for s in SCANNERS}


def scanner_ord(scanner_id: str) -> int:
    """Numeric category order: B2 < B10."""
    return int(scanner_id[1:])


@dataclass(frozen=True)
class Scanner:
    id: str
    name: str
    label: str
    base_ext: tuple[str, ...]
    base_names: tuple[str, ...]

    @property
    def ord(self) -> int:
        return scanner_ord(self.id)


def scanners() -> list[Scanner]:
    return [Scanner(i, n, lab, tuple(e), tuple(b)) for i, n, lab, e, b in SCANNERS]


SCANNERS_SCHEMA = T.StructType([
    T.StructField("scanner", T.StringType(), False),
    T.StructField("ord", T.IntegerType(), False),
    T.StructField("scanner_name", T.StringType(), False),
    T.StructField("scanner_label", T.StringType(), False),
    T.StructField("base_ext", T.ArrayType(T.StringType()), False),
    T.StructField("base_names", T.ArrayType(T.StringType()), False),
])


def scanners_df(spark: SparkSession) -> DataFrame:
    """The category dimension (10 rows; always safe to broadcast)."""
    rows = [(s.id, s.ord, s.name, s.label, list(s.base_ext), list(s.base_names))
            for s in scanners()]
    return spark.createDataFrame(rows, SCANNERS_SCHEMA)


def default_prompt_template(scanner_id: str) -> str:
    """Built-in scan prompt used when no template file is supplied."""
    _, name, label, _, _ = SCANNER_BY_ID[scanner_id]
    return prompt_wording(scanner_id, name, label)


def prompt_wording(scanner_id: str, name: str, label: str) -> str:
    return (
        f"You review source code for {label} ({scanner_id}, {name}).\n"
        "File: {filename}\n\n{file_content}\n\n"
        "Reply with a JSON array of findings; each finding is an object with "
        "line, severity, code, explanation, fix, source, sink. "
        "Use {{}} for an object literal in prose. Reply [] when clean.\n"
    )


DEFAULT_VERIFY_TEMPLATE = (
    "Try to refute each finding for {filename}.\n\n{file_content}\n\n"
    "Findings:\n{findings_json}\n\n"
    "Reply with a JSON array; each entry has line, verdict (confirmed|refuted), "
    "confidence (High|Medium|Low), exploitable (yes|no|conditional), "
    "verification_reason.\n"
)

DEFAULT_DISCOVERY_TEMPLATE = (
    "Given this repository profile, list the file extensions to scan per "
    "category as a JSON object mapping category id to extensions.\n\n{repo_structure}\n"
)


def short_hash(text: str) -> str:
    """Driver-side twin of ``content_hash`` for constants (prompt text)."""
    return hashlib.md5(text.encode()).hexdigest()[:16]
