"""DuckDB twins of the registered queries (the correctness oracle).

A single CTE chain re-derives the triage world from the driver tables with
plain SQL: corpus paths, corpus checks, category targets, keys, rule
findings, verdicts from ``labels``, first-match suppression (correlated
subquery), buckets and statuses.  Each query appends one final SELECT.
"""

from __future__ import annotations

import hashlib

import oracle_values as R
from oracle_values import CONFIDENCES, EXPLOITABLE


def short_hash(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:16]


VERIFY_PROMPT_HASH = short_hash(R.VERIFY_TEMPLATE)

# attempts that fail in the world: B4 has no lexical analysis of files labelled toxic
FAILED = "({k}scanner = 'B4' AND {k}doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))"
CUTOFF = R.CONFIDENCE_ORDER["Medium"]


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) t({', '.join(cols)}))"


def in_list(vals) -> str:
    return "(" + ", ".join(lit(v) for v in vals) + ")"


def rank_case(col: str, order: dict[str, int]) -> str:
    whens = " ".join(f"WHEN {col} = {lit(k)} THEN {v}" for k, v in order.items())
    return f"(CASE {whens} ELSE 0 END)"


def _ext_rows():
    return [(e, s[0]) for s in R.SCANNERS for e in dict.fromkeys(s[3])]


def _name_rows():
    return [(n, s[0]) for s in R.SCANNERS for n in s[4]]


def _reg_rows():
    return [(s[0], int(s[0][1:]), s[1], s[2], short_hash(R.template(s))) for s in R.SCANNERS]


def _rule_rows():
    return [(k, *r) for k, r in enumerate(R.RULES)]


def _allow_rows():
    return [(pos, s, f, int(line), reason, st) for pos, s, f, line, reason, st in R.ALLOWLIST]


def _list(vals) -> str:
    return "[" + ", ".join(lit(v) for v in vals) + "]"


SKIP_CASE = f"""CASE WHEN regexp_matches(path, {lit(R.EXCLUDED_DIR_PATTERN)})
          OR regexp_matches(path, {lit(R.STATE_DIR_PATTERN)}) THEN 'excluded_dir'
     WHEN name IN {in_list(R.EXCLUDE_FILES)} THEN 'excluded_file'
     WHEN ext IN {in_list(R.BINARY_EXTS)} THEN 'binary_ext'
     WHEN {{cap}} > 0 AND size > {{cap}} THEN 'oversized'
     WHEN contains(substr(text, 1, {R.NUL_SNIFF_BYTES}), chr(0)) THEN 'nul_bytes' END"""

BASE = f"""
corpus0 AS (
  SELECT doc_id, text,
    CASE WHEN doc_id % 41 = 0 THEN 'vendor/' WHEN doc_id % 37 = 0 THEN '.quarry_state_old/'
         WHEN doc_id % 31 = 0 THEN 'sub/.quarry_state.bak/' ELSE 'src/' END
    || lang || '/' || source || '/d' || CAST(doc_id AS VARCHAR) || '/'
    || CASE WHEN doc_id % 29 = 0 THEN 'pom.xml' WHEN doc_id % 23 = 0 THEN '.env'
            ELSE 'f' || CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.Java'
                                      WHEN 3 THEN '.yml' WHEN 4 THEN '.PNG' ELSE '.sql' END END AS path
  FROM documents),
corpus AS (
  SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) AS name,
         lower(regexp_extract(path, {lit(R.SUFFIX_PATTERN)}, 1)) AS ext,
         CAST(strlen(text) AS BIGINT) AS size, text
  FROM corpus0),
labelled AS (SELECT *, {SKIP_CASE.format(cap=R.DEFAULT_MAX_FILE_SIZE)} AS skip_reason FROM corpus),
kept AS (SELECT doc_id, path, name, ext, size, text, substr(md5(text), 1, 16) AS content_hash
         FROM labelled WHERE skip_reason IS NULL),
ext_idx AS {values(_ext_rows(), ['key', 'scanner'])},
name_idx AS {values(_name_rows(), ['key', 'scanner'])},
reg AS {values(_reg_rows(), ['scanner', 'ord', 'scanner_name', 'scanner_label', 'prompt_hash'])},
targets AS (
  SELECT k.doc_id, k.path, k.size, x.scanner FROM kept k JOIN ext_idx x ON k.ext = x.key
  UNION
  SELECT k.doc_id, k.path, k.size, x.scanner FROM kept k JOIN name_idx x ON k.name = x.key),
keyed AS (
  SELECT t.scanner, r.ord, r.scanner_name, t.doc_id, t.path, t.size, k.content_hash, r.prompt_hash,
         md5(concat_ws(':', r.scanner_name, t.path, k.content_hash, r.prompt_hash, 'off')) AS cache_key
  FROM targets t JOIN kept k USING (doc_id) JOIN reg r USING (scanner)),
lines AS (
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line,
         unnest(string_split(text, chr(10))) AS code
  FROM kept),
rules AS {values(_rule_rows(), ['rule_ord', 'rule_id', 'scanner', 'severity', 'pattern',
                                'explanation', 'fix', 'source', 'sink'])},
rf AS (
  SELECT kd.scanner, kd.scanner_name, kd.doc_id, kd.path AS file, kd.content_hash, kd.cache_key,
         CAST(l.line AS BIGINT) AS line, r.rule_ord, r.severity, l.code, r.explanation, r.fix,
         r.source, r.sink
  FROM keyed kd JOIN lines l ON kd.doc_id = l.doc_id
  JOIN rules r ON r.scanner = kd.scanner AND regexp_matches(l.code, r.pattern)
  WHERE NOT {FAILED.format(k='kd.')}),
lines_all AS (
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line,
         unnest(string_split(text, chr(10))) AS code
  FROM kept),
rf_all AS (
  SELECT kd.scanner, kd.path AS file, CAST(l.line AS BIGINT) AS line, r.severity, l.code, r.source
  FROM keyed kd JOIN lines_all l ON kd.doc_id = l.doc_id
  JOIN rules r ON r.scanner = kd.scanner AND regexp_matches(l.code, r.pattern)),
nf AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY scanner, doc_id ORDER BY line, rule_ord) - 1
                 AS BIGINT) AS ord,
         CAST(line AS VARCHAR) AS line_raw,
         CASE WHEN source IS NULL OR trim(source) = '' THEN 'unsubstantiated' ELSE '' END AS tags
  FROM rf),
sig AS (
  SELECT scanner, scanner_name, doc_id, file, content_hash,
         substr(md5(string_agg(concat_ws(chr(31), coalesce(line_raw, chr(1)), coalesce(severity, chr(1)),
              coalesce(code, chr(1)), coalesce(explanation, chr(1)), coalesce(fix, chr(1)),
              coalesce(source, chr(1)), coalesce(sink, chr(1)), tags), chr(30) ORDER BY ord)), 1, 16)
           AS findings_sig
  FROM nf GROUP BY scanner, scanner_name, doc_id, file, content_hash),
vkeys AS (
  SELECT *, md5(concat_ws(':', 'verify', scanner_name, file, content_hash, findings_sig,
                          {lit(VERIFY_PROMPT_HASH)}, 'off')) AS verify_key
  FROM sig),
allowlist AS {values(_allow_rows(), ['pos', 'scanner', 'file', 'line', 'reason', 'status'])},
ov AS (
  SELECT nf.*, v.verify_key,
         (lb.doc_id IS NOT NULL AND nf.line IS NOT NULL) AS has_verdict,
         CASE WHEN lb.doc_id IS NOT NULL AND nf.line IS NOT NULL THEN
           CASE WHEN lb.toxic = 1 THEN 'refuted' WHEN lb.quality = 0 THEN '' ELSE 'confirmed' END END
           AS verdict,
         CASE WHEN lb.doc_id IS NOT NULL AND nf.line IS NOT NULL THEN
           list_extract({_list(CONFIDENCES)}, CAST((nf.doc_id + nf.line) % 4 AS INTEGER) + 1) END
           AS confidence,
         CASE WHEN lb.doc_id IS NOT NULL AND nf.line IS NOT NULL THEN
           list_extract({_list(EXPLOITABLE)}, CAST((nf.doc_id + nf.line) % 3 AS INTEGER) + 1) END
           AS exploitable,
         CASE WHEN lb.doc_id IS NOT NULL AND nf.line IS NOT NULL THEN
           'line ' || CAST(nf.line AS VARCHAR) ||
           CASE WHEN lb.toxic = 1 THEN ': input is constant' ELSE ': reachable from input' END END
           AS verification_reason,
         (SELECT a.pos FROM allowlist a
           WHERE coalesce(a.status, 'confirmed') <> 'candidate'
             AND (a.scanner = '*' OR a.scanner = nf.scanner)
             AND (a.file = '*' OR a.file = nf.file)
             AND (coalesce(a.line, 0) = 0 OR a.line = nf.line)
           ORDER BY a.pos LIMIT 1) AS suppression_pos
  FROM nf LEFT JOIN labels lb ON nf.doc_id = lb.doc_id
  JOIN vkeys v ON v.scanner = nf.scanner AND v.doc_id = nf.doc_id),
bk0 AS (
  SELECT ov.*, a.reason AS suppression_reason,
    CASE WHEN NOT has_verdict THEN 'unverified' WHEN verdict = 'refuted' THEN 'refuted'
         WHEN verdict = 'confirmed' THEN CASE WHEN exploitable = 'yes' THEN 'confirmed'
                                              ELSE 'not_actionable' END
         WHEN confidence = 'Low' THEN 'refuted'
         WHEN exploitable IN ('no', 'conditional') THEN 'not_actionable'
         ELSE 'confirmed' END AS bucket,
    CASE WHEN has_verdict AND confidence IN {in_list(R.CONFIDENCE_ORDER)} THEN confidence
         ELSE 'Unverified' END AS conf
  FROM ov LEFT JOIN allowlist a ON a.pos = ov.suppression_pos),
bk AS (
  SELECT *,
    CASE WHEN conf IN ('High', 'Medium', 'Low') THEN conf ELSE 'Unverified' END AS conf_level,
    {rank_case('severity', R.SEVERITY_ORDER)} AS sev_rank,
    CASE WHEN suppression_pos IS NOT NULL THEN 'suppressed' WHEN bucket = 'refuted' THEN 'refuted'
         WHEN bucket = 'not_actionable' THEN 'not_actionable'
         WHEN {rank_case('conf', R.CONFIDENCE_ORDER)} < {CUTOFF} THEN 'needs_review'
         ELSE 'active' END AS status,
    (suppression_pos IS NULL AND bucket <> 'refuted' AND tags = 'unsubstantiated') AS unsubstantiated
  FROM bk0),
bka AS (SELECT *, status IN ('active', 'needs_review') AS above_line FROM bk),
fg AS (
  SELECT kd.cache_key, kd.scanner, kd.path AS file,
         CASE WHEN kd.failed THEN 'timeout' ELSE 'ok' END AS status,
         NOT kd.failed AS is_list,
         CAST(count(b.ord) AS BIGINT) AS n_items,
         CAST(count(b.ord) AS BIGINT) AS n_findings,
         CAST(count(*) FILTER (WHERE b.above_line) AS BIGINT) AS n_above,
         CAST(count(*) FILTER (WHERE b.status = 'suppressed') AS BIGINT) AS n_suppressed,
         CAST(count(*) FILTER (WHERE b.status IN ('refuted', 'not_actionable')) AS BIGINT) AS n_below
  FROM (SELECT *, {FAILED.format(k='')} AS failed FROM keyed) kd
  LEFT JOIN bka b ON b.cache_key = kd.cache_key
  GROUP BY kd.cache_key, kd.scanner, kd.path, kd.failed),
prior AS (
  SELECT CASE WHEN lb.quality = 0 THEN md5(kd.cache_key || ':old') ELSE kd.cache_key END AS cache_key,
         CASE WHEN kd.doc_id % 5 = 0 THEN 'timeout' WHEN lb.toxic = 1 THEN 'error' ELSE 'ok' END
           AS status
  FROM keyed kd JOIN labels lb ON kd.doc_id = lb.doc_id)
"""


def sql(final: str) -> str:
    return "WITH " + BASE.strip() + "\n" + final


SEV_COUNTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE above_line AND severity = {lit(s)}) AS BIGINT) AS \"{s}\""
    for s in R.SEVERITIES)
KNOWN = f"severity IN {in_list(R.SEVERITIES)}"


# replies as the analyst words them, with surrogate forms behind, and their repair: escaped
# backslashes and pairs are set aside, other surrogate escapes replaced
SANITIZED = r"""
SELECT scanner, file, md5(fixed) AS text_md5, CAST(length(fixed) AS BIGINT) AS chars,
       fixed <> raw AS repaired
FROM (SELECT scanner, file, raw, CASE WHEN contains(raw, '\u') THEN
        replace(replace(replace(
          regexp_replace(regexp_replace(
            replace(replace(raw, chr(1), chr(1) || 'm'), '\\', chr(1) || 'b'),
            '\\u([dD][89abAB][0-9a-fA-F]{2})\\u([dD][c-fC-F][0-9a-fA-F]{2})',
            chr(1) || 'p\1' || chr(1) || 'p\2', 'g'),
            '\\u[dD][89a-fA-F][0-9a-fA-F]{2}', chr(65533), 'g'),
          chr(1) || 'p', '\u'), chr(1) || 'b', '\\'), chr(1) || 'm', chr(1)) ELSE raw END AS fixed
      FROM (SELECT scanner, path AS file, CASE WHEN {failed} THEN '' ELSE CASE doc_id % 6
                WHEN 0 THEN js WHEN 1 THEN '```json' || chr(10) || js || chr(10) || '```'
                WHEN 2 THEN 'Here: ' || js WHEN 3 THEN js || ' done'
                WHEN 4 THEN substr(js, 1, length(js) - 1)
                ELSE 'No vulnerabilities found.' END END
              || ['', '\ud83d', '\ud83d\ude00', '\\ud83d x', '\ude00\ud83d', '\\\udfff',
                  chr(1) || 'b\ud800'][doc_id % 7 + 1] AS raw
            FROM (SELECT k.scanner, k.doc_id, k.path, coalesce(r.js, '[]') AS js
                  FROM keyed k LEFT JOIN (
                    SELECT scanner, doc_id, '[' || string_agg('{' || concat_ws(',',
                             '"line":' || line, '"severity":' || to_json(severity),
                             '"code":' || to_json(code), '"explanation":' || to_json(explanation),
                             '"fix":' || to_json(fix), '"source":' || to_json(source),
                             '"sink":' || to_json(sink)) || '}', ',' ORDER BY ord) || ']' AS js
                    FROM nf GROUP BY scanner, doc_id) r
                  ON r.scanner = k.scanner AND r.doc_id = k.doc_id)))""".replace(
    "{failed}", FAILED.format(k=""))


def _level_rows() -> list[str]:
    """(level, findings that reach it) of each level of the confidence gate."""
    rows = [f"({lit(x)}, CAST(count(*) FILTER (WHERE above_line AND {KNOWN} AND "
            f"{rank_case('conf', R.CONFIDENCE_ORDER)} >= {R.CONFIDENCE_ORDER[x.capitalize()]}) AS BIGINT))"
            for x in ("high", "medium", "low")]
    return [*rows, "('never', CAST(0 AS BIGINT))"]


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["corpus_scan"] = sql(
        "SELECT doc_id, path, name, ext, size, content_hash FROM kept")
    q["corpus_decode"] = sql(
        "SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, size FROM kept")
    q["exclude_paths"] = sql(
        "SELECT doc_id, path, skip_reason FROM labelled "
        "WHERE skip_reason IN ('excluded_dir', 'excluded_file')")
    q["binary_filter"] = sql(
        "SELECT doc_id, path, ext FROM labelled WHERE skip_reason = 'binary_ext'")
    q["skip_counts"] = sql(
        "SELECT coalesce(skip_reason, 'kept') AS skip_reason, CAST(count(*) AS BIGINT) AS files "
        "FROM labelled GROUP BY 1")
    cap = 16384
    q["size_cap"] = sql(
        f"SELECT coalesce(r, 'kept') AS skip_reason, CAST(count(*) AS BIGINT) AS files FROM "
        f"(SELECT {SKIP_CASE.format(cap=cap)} AS r FROM corpus) GROUP BY 1")
    q["extension_counts"] = sql(
        "SELECT ext, CAST(count(*) AS BIGINT) AS files FROM kept GROUP BY ext")
    q["notable_files"] = sql(
        f"SELECT name, path FROM kept WHERE name IN {in_list(R.NOTABLE_FILES)}")
    q["directory_profile"] = sql(
        f"""SELECT CAST(depth AS BIGINT) AS depth, dir, CAST(count(*) AS BIGINT) AS files FROM (
              SELECT d AS depth, array_to_string(parts[1:d], '/') AS dir FROM (
                SELECT parts, unnest(generate_series(1, least({R.PROFILE_DEPTH}, len(parts) - 1))) AS d
                FROM (SELECT string_split(path, '/') AS parts FROM kept)))
            GROUP BY depth, dir""")
    q["scanner_registry"] = sql(
        "SELECT r.scanner, CAST(r.ord AS BIGINT) AS ord, r.scanner_name, r.scanner_label, "
        "r.prompt_hash, CAST(count(t.doc_id) AS BIGINT) AS target_files "
        "FROM reg r LEFT JOIN targets t USING (scanner) "
        "GROUP BY r.scanner, r.ord, r.scanner_name, r.scanner_label, r.prompt_hash")
    q["scan_targets"] = sql("SELECT scanner, doc_id, path FROM targets")
    override = ["py", ".SQL ", "yml"]
    ov_rows = [(("." + e.strip().lower()) if not e.strip().startswith(".") else e.strip().lower(), s[0])
               for s in R.SCANNERS for e in override]
    q["scan_targets_override"] = sql(
        f"SELECT DISTINCT x.scanner, k.doc_id, k.path FROM kept k "
        f"JOIN {values(ov_rows, ['key', 'scanner'])} x ON k.ext = x.key")
    q["scanner_select"] = sql(
        "SELECT scanner, CAST(count(*) AS BIGINT) AS targets FROM targets "
        "WHERE scanner IN ('B3', 'B9', 'B10') GROUP BY scanner")
    q["content_keys"] = sql(
        "SELECT scanner, doc_id, content_hash, prompt_hash FROM keyed")
    q["scan_keys"] = sql("SELECT scanner, doc_id, path, cache_key FROM keyed")
    q["pending_scans"] = sql(
        "SELECT scanner, doc_id, path, cache_key FROM keyed k WHERE NOT EXISTS "
        "(SELECT 1 FROM prior p WHERE p.status = 'ok' AND p.cache_key = k.cache_key)")
    q["work_plan"] = sql(
        f"""SELECT scanner, CAST(count(*) AS BIGINT) AS total,
                  CAST(count(*) FILTER (WHERE hit) AS BIGINT) AS cached,
                  CAST(count(*) FILTER (WHERE NOT hit) AS BIGINT) AS pending,
                  CAST(any_value(ord) AS BIGINT) AS batch, CAST({len(R.SCANNERS)} AS BIGINT) AS batches
           FROM (SELECT k.scanner, k.ord, EXISTS (SELECT 1 FROM prior p WHERE p.status = 'ok'
                                           AND p.cache_key = k.cache_key) AS hit FROM keyed k)
           GROUP BY scanner""")
    q["retry_set"] = sql(
        "SELECT scanner, doc_id, cache_key FROM keyed k WHERE "
        "EXISTS (SELECT 1 FROM prior p WHERE p.status IN ('error', 'timeout') AND p.cache_key = k.cache_key) "
        "AND NOT EXISTS (SELECT 1 FROM prior p WHERE p.status = 'ok' AND p.cache_key = k.cache_key)")
    q["scan_sample"] = sql(
        """SELECT scanner, doc_id, path, CAST(rank AS BIGINT) AS rank FROM (
             SELECT scanner, doc_id, path, row_number() OVER (PARTITION BY scanner ORDER BY path, doc_id) AS rank
             FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM prior p WHERE p.status = 'ok'
                                            AND p.cache_key = k.cache_key))
           WHERE rank <= 5""")
    q["rule_findings"] = sql(
        "SELECT scanner, doc_id, file, line, severity, code, explanation FROM rf")
    q["tagged_findings"] = sql(
        "SELECT scanner, file, ord, line, coalesce(source, '<missing>') AS source, tags FROM nf")
    q["findings_normalised"] = sql(
        "SELECT scanner, file, ord, line_raw, line, severity, code, explanation, fix, "
        "source, sink, tags FROM nf")
    q["findings_signature"] = sql("SELECT scanner, file, findings_sig FROM sig")
    q["verify_keys"] = sql("SELECT scanner, file, findings_sig, verify_key FROM vkeys")
    q["verify_eligible"] = sql(
        "SELECT v.scanner, v.file FROM vkeys v JOIN keyed k ON k.scanner = v.scanner "
        "AND k.doc_id = v.doc_id")
    q["pending_verifications"] = sql(
        "SELECT v.scanner, v.file, v.verify_key FROM vkeys v "
        "WHERE v.doc_id NOT IN (SELECT doc_id FROM labels)")
    q["verdict_lines"] = sql(
        "SELECT DISTINCT verify_key, line, confidence, exploitable, verification_reason, "
        "coalesce(verdict, '') AS verdict FROM ov WHERE has_verdict")
    q["verdict_overlay"] = sql(
        "SELECT scanner, file, ord, line, has_verdict, confidence, exploitable, verdict FROM ov")
    q["bucketed_findings"] = sql(
        "SELECT scanner, file, ord, bucket, conf, status FROM bka")
    q["suppressed_findings"] = sql(
        "SELECT scanner, file, ord, line, CAST(suppression_pos AS BIGINT) AS suppression_pos, "
        "suppression_reason FROM bka WHERE status = 'suppressed'")
    q["severity_by_scanner"] = sql(
        f"SELECT scanner, {SEV_COUNTS} FROM bka GROUP BY scanner")
    q["severity_rollup"] = sql(
        f"SELECT scanner, severity, CAST(count(*) AS BIGINT) AS n FROM bka "
        f"WHERE above_line AND {KNOWN} GROUP BY ROLLUP (scanner, severity)")
    q["confidence_counts"] = sql(
        "SELECT scanner, " + ", ".join(
            f"CAST(count(*) FILTER (WHERE above_line AND conf_level = {lit(c)}) AS BIGINT) AS \"{c}\""
            for c in R.CONFIDENCE_LEVELS) + " FROM bka GROUP BY scanner")
    q["bucket_counts"] = sql(
        "SELECT scanner, bucket, CAST(count(*) AS BIGINT) AS n FROM bka "
        "WHERE status <> 'suppressed' GROUP BY scanner, bucket")
    q["file_status_counts"] = sql(
        """SELECT scanner, CAST(count(*) AS BIGINT) AS files_scanned,
             CAST(count(*) FILTER (WHERE status NOT IN ('error','timeout') AND n_items = 0) AS BIGINT) AS clean,
             CAST(count(*) FILTER (WHERE status NOT IN ('error','timeout') AND n_items > 0) AS BIGINT) AS with_findings,
             CAST(count(*) FILTER (WHERE status IN ('error','timeout')) AS BIGINT) AS errors,
             CAST(count(*) FILTER (WHERE status NOT IN ('error','timeout') AND NOT is_list) AS BIGINT) AS parse_errors
           FROM fg GROUP BY scanner""")
    q["unsubstantiated_counts"] = sql(
        "SELECT scanner, CAST(count(*) FILTER (WHERE unsubstantiated) AS BIGINT) AS unsubstantiated "
        "FROM bka GROUP BY scanner")
    q["gated_severity"] = sql(
        "SELECT scanner, " + ", ".join(
            f"CAST(count(*) FILTER (WHERE status = 'active' AND severity = {lit(s)}) AS BIGINT) AS \"{s}\""
            for s in R.SEVERITIES)
        + ", CAST(count(*) FILTER (WHERE status = 'needs_review') AS BIGINT) AS needs_review "
          "FROM bka GROUP BY scanner")
    q["fail_on_gate"] = sql(
        "SELECT 'high' AS threshold, CAST(count(*) FILTER (WHERE above_line AND "
        f"{KNOWN} AND sev_rank >= 3) AS BIGINT) AS triggered FROM bka")
    q["verification_coverage"] = sql(
        "SELECT scanner, CAST(count(*) FILTER (WHERE above_line AND conf_level <> 'Unverified') AS BIGINT) AS verified, "
        "CAST(count(*) FILTER (WHERE above_line) AS BIGINT) AS active FROM bka GROUP BY scanner")
    vf = ("SELECT scanner, file, CAST(count(*) AS BIGINT) AS n, " + ", ".join(
        f"CAST(count(*) FILTER (WHERE conf_level = {lit(c)}) AS BIGINT) AS \"{c}\""
        for c in R.CONFIDENCE_LEVELS) + " FROM bka WHERE above_line GROUP BY scanner, file")
    q["vulnerable_files"] = sql(vf)
    q["top_vulnerable_files"] = sql(
        f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY scanner ORDER BY n DESC, file) "
        f"AS BIGINT) AS rank FROM ({vf})) WHERE rank <= 20")
    heat = ", ".join(
        f"CAST(count(*) FILTER (WHERE status = 'active' AND severity = {lit(s)}) AS BIGINT) AS \"{s}\""
        for s in R.SEVERITIES)
    q["risk_heatmap"] = sql(
        f"""SELECT severity, CAST(sev_rank AS BIGINT) AS sev_rank, n,
              CASE WHEN severity = 'Low' THEN CASE WHEN n = 0 THEN 'LOW' ELSE 'Review' END
                   WHEN n > 0 THEN upper(severity) ELSE 'Clear' END AS risk_level
            FROM (SELECT {heat} FROM bka) h,
            LATERAL (VALUES ('Critical', 4, h."Critical"), ('High', 3, h."High"),
                            ('Medium', 2, h."Medium"), ('Low', 1, h."Low")) v(severity, sev_rank, n)""")
    q["overall_risk"] = sql(
        f"""SELECT CASE WHEN "Critical" > 0 THEN 'CRITICAL' WHEN "High" > 0 THEN 'HIGH'
                        WHEN "Medium" > 0 THEN 'MEDIUM' WHEN errors > 0 OR scanned = 0 THEN 'INCONCLUSIVE'
                        ELSE 'LOW' END AS overall, errors, scanned
            FROM (SELECT {heat} FROM bka) h,
                 (SELECT CAST(count(*) FILTER (WHERE status IN ('error','timeout')) AS BIGINT) AS errors,
                         CAST(count(*) AS BIGINT) AS scanned FROM fg) f""")
    rows = f"""
      SELECT b.scanner, r.scanner_label, b.file, coalesce(b.line_raw, '') AS line,
             coalesce(b.severity, '') AS severity, coalesce(b.code, '') AS code,
             coalesce(b.explanation, '') AS explanation, coalesce(b.fix, '') AS fix,
             coalesce(b.source, '') AS source, coalesce(b.sink, '') AS sink, b.tags,
             CASE WHEN b.conf = 'Unverified' THEN '' ELSE b.conf END AS confidence,
             CASE WHEN b.has_verdict THEN coalesce(b.exploitable, '') ELSE '' END AS exploitable,
             CASE WHEN b.has_verdict THEN coalesce(b.verification_reason, '') ELSE '' END AS verification_reason,
             CASE WHEN b.has_verdict THEN coalesce(b.verdict, '') ELSE '' END AS verdict,
             b.status,
             CASE WHEN b.status = 'suppressed' THEN coalesce(b.suppression_reason, '') ELSE '' END AS suppression_reason
      FROM bka b JOIN reg r USING (scanner)
      UNION ALL
      SELECT f.scanner, r.scanner_label, f.file, '', '', '', '', '', '', '', '', '', '', '', '',
             f.status, ''
      FROM fg f JOIN reg r USING (scanner) WHERE f.status IN ('error', 'timeout')"""
    q["report_rows"] = sql(rows)
    q["status_counts"] = sql(
        f"SELECT status, CAST(count(*) AS BIGINT) AS n FROM ({rows}) GROUP BY status")
    q["ci_gate"] = sql(
        f"""SELECT CASE WHEN raw_triggered > 0 THEN 1 WHEN confidence_triggered > 0 THEN 3
                        WHEN errors > 0 THEN 1 ELSE 0 END AS exit_code,
                   CASE WHEN raw_triggered > 0 THEN 'severity' WHEN confidence_triggered > 0 THEN 'confidence'
                        WHEN errors > 0 THEN 'errors' ELSE 'pass' END AS reason,
                   raw_triggered, confidence_triggered, errors
            FROM (SELECT CAST(count(*) FILTER (WHERE above_line AND {KNOWN} AND sev_rank >= 4) AS BIGINT) AS raw_triggered,
                         CAST(count(*) FILTER (WHERE status = 'active' AND {KNOWN}) AS BIGINT) AS confidence_triggered
                  FROM bka) a,
                 (SELECT CAST(count(*) FILTER (WHERE status IN ('error','timeout')) AS BIGINT) AS errors FROM fg) f""")
    errors = ("(SELECT CAST(count(*) FILTER (WHERE status IN ('error','timeout')) AS BIGINT) "
              "AS errors FROM fg)")
    q["ci_gate_levels"] = sql(
        f"""SELECT CASE WHEN confidence_triggered > 0 THEN 3 WHEN errors > 0 THEN 1 ELSE 0 END AS exit_code,
                   CASE WHEN confidence_triggered > 0 THEN 'confidence' WHEN errors > 0 THEN 'errors'
                        ELSE 'pass' END AS reason,
                   CAST(0 AS BIGINT) AS raw_triggered, confidence_triggered, errors, level
            FROM (SELECT unnest(l).level AS level, unnest(l).n AS confidence_triggered FROM (
                    SELECT [{", ".join(f"{{'level': {t.split(', ', 1)[0][1:]}, 'n': {t.split(', ', 1)[1][:-1]}}}" for t in _level_rows())}] AS l
                    FROM bka)) a, {errors} e""")
    listing = ("SELECT scanner, file, ord, line, severity, conf, verdict, exploitable, "
               "verification_reason, suppression_reason FROM bka WHERE status = ")
    q["refuted_findings"] = sql(listing + "'refuted'")
    q["not_actionable"] = sql(listing + "'not_actionable'")
    q["needs_review"] = sql(listing + "'needs_review'")
    q["file_labels"] = sql(
        """SELECT scanner, file, CASE WHEN status IN ('error','timeout') THEN 'ERROR'
                  WHEN n_above > 0 THEN 'VULN' WHEN n_below > 0 THEN 'REFUTED'
                  WHEN n_suppressed > 0 THEN 'SUPPRESSED' ELSE 'CLEAN' END AS label,
                  n_findings, n_above FROM fg""")
    ext_rows = [(s[0], p, e) for s in R.SCANNERS for p, e in enumerate(s[3])]
    q["extensions_scanned"] = sql(
        f"""SELECT d.scanner, d.extensions, CAST(coalesce(c.files, 0) AS BIGINT) AS files
            FROM (SELECT scanner, string_agg(ext, ', ' ORDER BY pos) AS extensions
                  FROM {values(ext_rows, ['scanner', 'pos', 'ext'])} GROUP BY scanner) d
            LEFT JOIN (SELECT scanner, count(*) AS files FROM fg GROUP BY scanner) c USING (scanner)""")
    q["allowlist_candidates"] = sql(
        """SELECT scanner, file, line, reason, 'candidate' AS status FROM (
             SELECT scanner, file, coalesce(line, 0) AS line,
                    arg_min(CASE WHEN coalesce(verification_reason, '') <> '' THEN verification_reason
                                 ELSE '(no evidence given)' END, okey) AS reason
             FROM (SELECT b.*, lpad(CAST(r.ord AS VARCHAR), 3, '0') || chr(1) || b.file || chr(1)
                          || lpad(CAST(b.ord AS VARCHAR), 9, '0') AS okey
                   FROM bka b JOIN reg r USING (scanner) WHERE b.status = 'refuted')
             GROUP BY scanner, file, coalesce(line, 0)) c
           WHERE NOT EXISTS (SELECT 1 FROM allowlist a WHERE a.scanner = c.scanner
                             AND a.file = c.file AND coalesce(a.line, 0) = c.line)""")
    stats = f"""
              SELECT {', '.join(f"CAST(count(*) FILTER (WHERE above_line AND severity = {lit(s)}) AS BIGINT) AS severity_{s}" for s in R.SEVERITIES)},
                     {', '.join(f"CAST(count(*) FILTER (WHERE status = 'active' AND severity = {lit(s)}) AS BIGINT) AS gated_{s}" for s in R.SEVERITIES)},
                     CAST(count(*) FILTER (WHERE status = 'suppressed') AS BIGINT) AS suppressed,
                     CAST(count(*) FILTER (WHERE status = 'refuted') AS BIGINT) AS refuted,
                     CAST(count(*) FILTER (WHERE status = 'not_actionable') AS BIGINT) AS not_actionable,
                     CAST(count(*) FILTER (WHERE status = 'needs_review') AS BIGINT) AS needs_review,
                     CAST(count(*) FILTER (WHERE above_line AND bucket = 'confirmed') AS BIGINT) AS confirmed,
                     CAST(count(*) FILTER (WHERE unsubstantiated) AS BIGINT) AS unsubstantiated,
                     CAST(count(*) FILTER (WHERE above_line AND conf_level <> 'Unverified') AS BIGINT) AS verified,
                     CAST(count(*) FILTER (WHERE above_line AND conf_level = 'Unverified') AS BIGINT) AS unverified,
                     CAST(count(*) FILTER (WHERE above_line AND NOT ({KNOWN})) AS BIGINT) AS unknown_severity
              FROM bka"""
    files = ("SELECT CAST(count(*) AS BIGINT) AS scanned, CAST(count(*) FILTER (WHERE status IN "
             "('error','timeout')) AS BIGINT) AS errors FROM fg")
    q["run_stats"] = sql(
        f"SELECT metric, value FROM (UNPIVOT (SELECT * FROM ({stats}) a, ({files}) f) "
        f"ON COLUMNS(*) INTO NAME metric VALUE value)")
    kind = (f"CASE WHEN {FAILED.format(k='k.')} THEN 'failed' WHEN k.doc_id % 6 = 5 THEN 'marker' "
            f"WHEN k.doc_id % 6 = 4 THEN CASE WHEN coalesce(c.n, 0) > 0 THEN 'truncated' "
            f"ELSE 'error' END ELSE 'array' END")
    replies = (f"SELECT k.scanner, k.path AS file, {kind} AS kind, CAST(CASE WHEN {FAILED.format(k='k.')} "
               f"OR k.doc_id % 6 = 5 THEN 0 ELSE coalesce(c.n, 0) END AS BIGINT) AS n_findings "
               f"FROM keyed k LEFT JOIN (SELECT scanner, doc_id, count(*) AS n FROM nf "
               f"GROUP BY scanner, doc_id) c USING (scanner, doc_id)")
    q["scan_from_responses"] = sql(replies)
    q["response_tiers"] = sql(
        f"SELECT kind, CAST(count(*) AS BIGINT) AS n FROM ({replies}) GROUP BY kind")
    base_rows = [(s[0], p, e) for s in R.SCANNERS for p, e in enumerate(dict.fromkeys(s[3]))]
    plan = f"""
      SELECT scanner, CAST(row_number() OVER (PARTITION BY scanner ORDER BY k) - 1 AS BIGINT) AS pos, ext
      FROM (SELECT scanner, ext, dpos AS k FROM disc
            UNION ALL
            SELECT b.scanner, b.ext, 1000 + b.bpos FROM base b
            WHERE NOT EXISTS (SELECT 1 FROM disc d WHERE d.scanner = b.scanner AND d.ext = b.ext))"""
    disc = f"""base AS {values(base_rows, ['scanner', 'bpos', 'ext'])},
      ec AS (SELECT ext, count(*) AS files FROM kept GROUP BY ext),
      disc AS (SELECT b.scanner, b.ext, row_number() OVER (PARTITION BY b.scanner
                                                          ORDER BY ec.files DESC, b.ext) - 1 AS dpos
               FROM base b JOIN ec USING (ext))"""
    q["discovery_plan"] = "WITH " + BASE.strip() + ",\n" + disc + "\n" + plan
    q["discovered_targets"] = (
        "WITH " + BASE.strip() + ",\n" + disc + f", plan AS ({plan}),\n"
        "dt AS (SELECT k.doc_id, p.scanner FROM kept k JOIN plan p ON k.ext = p.ext "
        "UNION SELECT k.doc_id, x.scanner FROM kept k JOIN name_idx x ON k.name = x.key)\n"
        "SELECT scanner, CAST(count(*) AS BIGINT) AS targets FROM dt GROUP BY scanner")
    tmpl_rows = [(s[0], R.template(s)) for s in R.SCANNERS]
    q["rendered_prompts"] = sql(
        f"""SELECT scanner, doc_id, md5(r) AS prompt_md5, CAST(length(r) AS BIGINT) AS prompt_chars
            FROM (SELECT t.scanner, t.doc_id,
                    replace(replace(replace(replace(tm.template, '{{filename}}', k.name),
                            '{{file_content}}', k.text), '{{{{', '{{'), '}}}}', '}}') AS r
                  FROM targets t JOIN kept k USING (doc_id)
                  JOIN {values(tmpl_rows, ['scanner', 'template'])} tm USING (scanner))""")
    def eta_text(x: str) -> str:
        xi = f"CAST(floor({x}) AS BIGINT)"
        two = lambda e: f"lpad(CAST({e} AS VARCHAR), 2, '0')"
        return (f"CASE WHEN {x} IS NULL OR {x} < 0 THEN '?' WHEN {x} < 1 THEN '<1s' "
                f"WHEN {xi} < 60 THEN CAST({xi} AS VARCHAR) || 's' "
                f"WHEN {xi} < 3600 THEN CAST({xi} // 60 AS VARCHAR) || 'm' || {two(f'{xi} % 60')} || 's' "
                f"WHEN {xi} < 86400 THEN CAST({xi} // 3600 AS VARCHAR) || 'h' || {two(f'({xi} % 3600) // 60')} || 'm' "
                f"ELSE CAST({xi} // 86400 AS VARCHAR) || 'd' || {two(f'({xi} % 86400) // 3600')} || 'h' END")
    prog = f"""
      WITH ev AS (SELECT event_type AS grp, epoch_us(ts) AS us FROM events),
      snap AS (SELECT min(us) + CAST(floor((max(us) - min(us)) / 2) AS BIGINT) AS t FROM ev),
      g AS (SELECT grp, CAST(count(*) AS BIGINT) AS total,
                   CAST(count(*) FILTER (WHERE us <= t) AS BIGINT) AS completed,
                   min(us) FILTER (WHERE us <= t) AS started_us, any_value(t) AS t
            FROM ev, snap GROUP BY grp),
      r AS (SELECT *, CASE WHEN completed > 0 THEN completed / greatest((t - started_us) / 1e6, 1e-6)
                           ELSE 0.0 END AS rate,
                   greatest(total - completed, 0) AS remaining FROM g),
      e AS (SELECT *, CASE WHEN rate > 0 THEN remaining / rate END AS eta FROM r)
      SELECT grp, total, completed, round(rate * 3600, 4) AS per_h,
             CAST(floor(eta) AS BIGINT) AS eta_s,
             CASE WHEN remaining = 0 THEN 'done' ELSE {eta_text('eta')} END AS eta
      FROM e"""
    q["phase_progress"] = prog
    q["overall_eta"] = f"""
      SELECT CAST(eta_s AS BIGINT) AS eta_s, lower_bound,
             CASE WHEN NOT any_work THEN 'done' WHEN eta_s IS NULL THEN '?'
                  ELSE CASE WHEN lower_bound THEN '≥' ELSE '' END || {eta_text('eta_s')} END AS eta
      FROM (SELECT sum(CASE WHEN total - completed > 0 THEN eta_s END) AS eta_s,
                   bool_or(total - completed > 0 AND eta_s IS NULL) AS lower_bound,
                   bool_or(total - completed > 0) AS any_work
            FROM ({prog}))"""
    pages = f"""
      pc0 AS (SELECT page_id AS doc_id, html AS text,
                regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', '') AS p
              FROM pages),
      pc1 AS (SELECT doc_id, text, CASE WHEN suffix(p, '/') THEN p || 'index.html' ELSE p || '.html' END AS p0
              FROM pc0),
      pc2 AS (SELECT doc_id, text,
                regexp_replace(regexp_replace(regexp_replace(p0, '(^|/)(\\./)+', '\\1', 'g'), '/{{2,}}', '/', 'g'),
                               '^/+', '') AS path FROM pc1),
      pcorpus AS (SELECT doc_id, path, regexp_extract(path, '([^/]*)$', 1) AS name,
                         lower(regexp_extract(path, {lit(R.SUFFIX_PATTERN)}, 1)) AS ext,
                         CAST(strlen(text) AS BIGINT) AS size, text FROM pc2),
      plab AS (SELECT *, {SKIP_CASE.format(cap=R.DEFAULT_MAX_FILE_SIZE)} AS skip_reason FROM pcorpus)"""
    q["pages_skip_counts"] = (
        "WITH " + pages.strip() + "\nSELECT coalesce(skip_reason, 'kept') AS skip_reason, "
        "CAST(count(*) AS BIGINT) AS files FROM plab GROUP BY 1")
    q["pages_findings"] = (
        "WITH " + pages.strip() + f""",
      rules AS {values(_rule_rows(), ['rule_ord', 'rule_id', 'scanner', 'severity', 'pattern',
                                      'explanation', 'fix', 'source', 'sink'])},
      plines AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS code
                 FROM plab WHERE skip_reason IS NULL AND ext = '.html')
      SELECT r.scanner, r.severity, CAST(count(*) AS BIGINT) AS n,
             CAST(count(DISTINCT l.path) AS BIGINT) AS files
      FROM plines l JOIN rules r ON regexp_matches(l.code, r.pattern)
      GROUP BY r.scanner, r.severity""")
    marks = " ".join(f"WHEN conf_level = {lit(k)} THEN {lit(v)}" for k, v in R.CONFIDENCE_MARKS.items())
    q["finding_details"] = sql(
        f"""SELECT scanner, file,
                   CAST(row_number() OVER (PARTITION BY scanner, file ORDER BY ord) AS BIGINT) AS idx,
                   line, coalesce(severity, 'Unknown') AS severity,
                   CASE WHEN coalesce(source, '') <> '' OR coalesce(sink, '') <> ''
                        THEN coalesce(source, '') || {lit(R.TAINT_ARROW)} || coalesce(sink, '') END AS taint_path,
                   unsubstantiated, conf_level AS confidence,
                   CASE WHEN has_verdict THEN coalesce(exploitable, 'unknown') ELSE 'unknown' END AS exploitable,
                   CASE {marks} ELSE {lit(R.UNKNOWN_MARK)} END AS mark
            FROM bka WHERE above_line""")
    cands = q["allowlist_candidates"][len("WITH " + BASE.strip() + "\n"):]
    q["pending_candidates"] = sql(
        f"""SELECT scanner, file, CAST(line AS VARCHAR) AS line, reason
            FROM allowlist WHERE status = 'candidate'
            UNION ALL
            SELECT scanner, file, CAST(line AS VARCHAR), reason
            FROM ({cands.replace("'candidate' AS status FROM (", "okey FROM (").replace(
                "arg_min(CASE", "min(okey) AS okey, arg_min(CASE")})""")
    q["results_load"] = sql(
        f"SELECT scanner, path AS file, CASE WHEN {FAILED.format(k='')} THEN 'timeout' ELSE 'ok' END "
        "AS status, content_hash FROM keyed")
    q["scan_attempts"] = sql(
        f"SELECT scanner, CASE WHEN {FAILED.format(k='')} THEN 'timeout' ELSE 'ok' END AS status, "
        "CAST(count(*) AS BIGINT) AS attempts FROM keyed GROUP BY 1, 2")
    q["custom_category"] = sql(
        """SELECT scanner, scanner_label, severity, CAST(count(*) AS BIGINT) AS findings,
                  CAST(count(DISTINCT path) AS BIGINT) AS files
           FROM (SELECT 'X1' AS scanner, 'Attribution' AS scanner_label, v.severity, k.path
                 FROM kept k JOIN lines l ON k.doc_id = l.doc_id,
                      (VALUES ('Low', 'Apache License'), ('Medium', 'Version [0-9]+[.][0-9]+'))
                      AS v(severity, pattern)
                 WHERE (k.ext IN ('.py', '.sql') OR k.name = 'pom.xml')
                   AND regexp_matches(l.code, v.pattern)
                 UNION ALL
                 SELECT 'B6', 'Vulnerable and Outdated Components', 'Low', t.path
                 FROM targets t JOIN lines l ON t.doc_id = l.doc_id
                 WHERE t.scanner = 'B6' AND regexp_matches(l.code, '(Licensed|Released) under'))
           GROUP BY 1, 2, 3""")
    failed = FAILED.format(k="k.")
    q["wave_attempts"] = sql(
        f"""SELECT 'this' AS run, CAST(('0x' || substr(md5(k.path), 1, 8))::BIGINT % 8 AS INTEGER) AS wave,
                   CAST(count(*) AS BIGINT) AS attempts,
                   CAST(count(*) FILTER (WHERE NOT {failed}) AS BIGINT) AS ok,
                   CAST(0 AS BIGINT) AS errors,
                   CAST(count(*) FILTER (WHERE {failed}) AS BIGINT) AS timeouts,
                   CAST(count(DISTINCT k.path) AS BIGINT) AS files,
                   min(epoch_us(e.ts)) AS first_us, max(epoch_us(e.ts)) AS last_us
            FROM keyed k LEFT JOIN events e ON e.event_id = k.doc_id GROUP BY 2""")
    q["run_progress"] = sql(
        f"""SELECT grp, total, completed, round(rate * 3600, 4) AS per_h,
                   CAST(floor(eta) AS BIGINT) AS eta_s,
                   CASE WHEN remaining = 0 THEN 'done' ELSE {eta_text('eta')} END AS eta
            FROM (SELECT *, CASE WHEN rate > 0 THEN remaining / rate END AS eta
              FROM (SELECT *, CASE WHEN completed > 0
                                   THEN completed / greatest((t - started_us) / 1e6, 1e-6)
                                   ELSE 0.0 END AS rate,
                           greatest(total - completed, 0) AS remaining
                FROM (SELECT a.scanner AS grp, CAST(count(*) AS BIGINT) AS total,
                             CAST(count(*) FILTER (WHERE us <= t) AS BIGINT) AS completed,
                             min(us) FILTER (WHERE us <= t) AS started_us, any_value(t) AS t
                      FROM (SELECT k.scanner, epoch_us(e.ts) AS us
                            FROM keyed k LEFT JOIN events e ON e.event_id = k.doc_id) a,
                           (SELECT min(epoch_us(e.ts))
                                   + CAST(floor((max(epoch_us(e.ts)) - min(epoch_us(e.ts))) / 2) AS BIGINT) AS t
                            FROM keyed k JOIN events e ON e.event_id = k.doc_id) s
                      GROUP BY a.scanner)))""")
    q["verdict_store"] = sql(
        """SELECT v.verify_key, v.scanner, v.file, 'ok' AS status,
                  CAST((SELECT count(*) FROM nf WHERE nf.scanner = v.scanner AND nf.doc_id = v.doc_id
                        AND nf.line IS NOT NULL) AS BIGINT) AS entries
           FROM vkeys v WHERE v.doc_id IN (SELECT doc_id FROM labels)""")
    q["report_exclusions"] = sql(
        f"""SELECT DISTINCT x.scanner, c.doc_id, c.path FROM corpus c
            JOIN (SELECT key, scanner, 'ext' AS kind FROM ext_idx
                  UNION ALL SELECT key, scanner, 'name' FROM name_idx) x
              ON (x.kind = 'ext' AND c.ext = x.key) OR (x.kind = 'name' AND c.name = x.key)
            WHERE regexp_matches(c.path, {lit(R.EXCLUDED_DIR_PATTERN)})
               OR regexp_matches(c.path, {lit(R.STATE_DIR_PATTERN)})
               OR c.name IN {in_list(R.EXCLUDE_FILES)}""")
    q["response_status"] = sql(
        f"""SELECT scanner, file, kind,
                   CASE kind WHEN 'failed' THEN 'analyst call failed'
                             ELSE 'could not parse JSON from response' END AS error,
                   CAST(CASE kind WHEN 'failed' THEN 0 ELSE 1 END AS BIGINT) AS preview_len
            FROM ({replies}) WHERE kind IN ('error', 'failed')""")
    q["scan_findings"] = sql(
        "SELECT scanner, file, line, severity, code, CASE WHEN source IS NULL OR trim(source) = '' "
        "THEN 'unsubstantiated' ELSE '' END AS tags FROM rf_all")
    q["verify_findings"] = sql(
        f"""SELECT scanner, file, ord, bucket, conf,
                   CASE WHEN bucket = 'not_actionable' THEN 'not_actionable'
                        WHEN {rank_case('conf', R.CONFIDENCE_ORDER)} < {CUTOFF} THEN 'needs_review'
                        ELSE 'active' END AS status
            FROM (SELECT scanner, file, ord,
                    CASE WHEN line IS NULL THEN 'unverified'
                         WHEN last_sev IN ('Critical', 'High') THEN 'confirmed'
                         ELSE 'not_actionable' END AS bucket,
                    CASE WHEN line IS NULL THEN 'Unverified'
                         WHEN last_named THEN 'High' ELSE 'Low' END AS conf
                  FROM (SELECT *,
                          last_value(severity) OVER w AS last_sev,
                          last_value(source IS NOT NULL AND trim(source) <> '') OVER w AS last_named
                        FROM nf
                        WINDOW w AS (PARTITION BY scanner, doc_id, line ORDER BY ord
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)))""")
    q["binary_sniff"] = sql(
        f"SELECT doc_id, path, contains(substr(text, 1, {R.NUL_SNIFF_BYTES}), chr(0)) AS nul "
        "FROM labelled WHERE skip_reason IS NULL OR skip_reason = 'nul_bytes'")
    q["line_coercion"] = sql("SELECT scanner, file, ord, line_raw, line FROM nf")
    q["parsed_responses"] = sql(f"SELECT scanner, file, kind, n_findings FROM ({replies})")
    q["prompt_catalog"] = sql(
        f"""SELECT r.scanner, r.scanner_name, r.prompt_hash,
                   CAST(length(tm.template) AS BIGINT) AS template_chars,
                   CAST(count(p.doc_id) AS BIGINT) AS prompts,
                   CAST(coalesce(sum(p.prompt_chars), 0) AS BIGINT) AS prompt_chars
            FROM reg r JOIN {values(tmpl_rows, ['scanner', 'template'])} tm USING (scanner)
            LEFT JOIN (SELECT t.scanner, t.doc_id,
                         length(replace(replace(replace(replace(tm2.template, '{{filename}}', k.name),
                                '{{file_content}}', k.text), '{{{{', '{{'), '}}}}', '}}')) AS prompt_chars
                       FROM targets t JOIN kept k USING (doc_id)
                       JOIN {values(tmpl_rows, ['scanner', 'template'])} tm2 USING (scanner)) p
              USING (scanner)
            GROUP BY r.scanner, r.scanner_name, r.prompt_hash, tm.template""")
    q["allowlist_load"] = sql(
        f"""SELECT CAST(pos AS BIGINT) AS pos, scanner, file, CAST(line AS VARCHAR) AS line, reason, status
            FROM allowlist
            UNION ALL
            SELECT CAST(4 + row_number() OVER (ORDER BY okey) AS BIGINT), scanner, file,
                   CAST(line AS VARCHAR), reason, 'candidate'
            FROM ({cands.replace("'candidate' AS status FROM (", "okey FROM (").replace(
                "arg_min(CASE", "min(okey) AS okey, arg_min(CASE")})""")
    q["sanitized_responses"] = sql(SANITIZED)
    q["verify_plan"] = sql(
        """SELECT scanner, CAST(count(*) AS BIGINT) AS eligible,
                  CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS BIGINT) AS verified,
                  CAST(count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS BIGINT) AS pending
           FROM vkeys GROUP BY scanner""")
    return q
