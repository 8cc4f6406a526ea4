"""Verdict buckets, suppression and report semantics on small fixtures."""

import json

from pyspark.sql import functions as F

from quarry.operators.overlay import verdict_lines_from_replies
from quarry.operators.suppress import (ALLOWLIST_DDL, allowlist_candidates, first_match,
                                       first_match_array, normalize_allowlist)
from quarry.plans import report as RP
from quarry.plans import triage as TR
from tests.conftest import store_rows

VPH = "v" * 16

SEED = [
    {"line": 10, "severity": "High", "code": "a", "source": "req"},
    {"line": 20, "severity": "Critical", "code": "b", "source": "req"},
    {"line": 30, "severity": "Medium", "code": "c", "source": "req"},
    {"line": 40, "severity": "Low", "code": "d", "source": "req"},
    {"line": 50, "severity": "High", "code": "e"},
]


def _world(spark, verdicts, allow=None, threshold=None):
    res = store_rows(spark, [("B3", "app/a.py", "ok", json.dumps(SEED)),
                             ("B3", "app/clean.py", "ok", "[]"),
                             ("B3", "app/bad.py", "timeout", '{"error": "t"}')])
    rn = TR.normalised_results(res, VPH)
    key = rn.where(F.col("file") == "app/a.py").first()["verify_key"]
    vs = spark.createDataFrame([(key, "ok", json.dumps(verdicts))],
                               "verify_key string, status string, result string")
    al = spark.createDataFrame(allow or [], ALLOWLIST_DDL)
    b = TR.bucketed(rn, verdict_lines_from_replies(vs), al, threshold)
    return b, TR.file_grain(rn, b)


def test_five_bucket_seed(spark):
    verdicts = [
        {"line": 10, "verdict": "confirmed", "exploitable": "yes", "confidence": "High"},
        {"line": 20, "verdict": "refuted", "confidence": "High"},
        {"line": 30, "verdict": "confirmed", "exploitable": "no", "confidence": "Medium"},
        {"line": 40, "verdict": "confirmed", "exploitable": "conditional", "confidence": "Low"},
        {"line": 50, "verdict": "confirmed", "exploitable": "yes", "confidence": "High"},
    ]
    b, files = _world(spark, verdicts)
    sev = RP.severity_by_scanner(b).first()
    assert (sev["High"], sev["Critical"], sev["Medium"], sev["Low"]) == (2, 0, 0, 0)
    buckets = {r["bucket"]: r["n"] for r in RP.bucket_counts(b).collect()}
    assert buckets == {"confirmed": 2, "refuted": 1, "not_actionable": 2}
    assert RP.unsubstantiated_counts(b).first()["unsubstantiated"] == 1
    stats = {r["metric"]: r["value"] for r in RP.run_stats(b, files).collect()}
    assert stats["errors"] == 1 and stats["scanned"] == 3 and stats["refuted"] == 1


def test_legacy_verdicts(spark):
    verdicts = [
        {"line": 10, "confidence": "High", "exploitable": "yes"},
        {"line": 20, "confidence": "Low", "exploitable": "no"},
        {"line": 30, "confidence": "Medium", "exploitable": "conditional"},
        {"line": 40, "confidence": "High", "exploitable": "no"},
    ]
    b, _ = _world(spark, verdicts)
    got = {r["line"]: r["bucket"] for r in b.collect()}
    assert got == {10: "confirmed", 20: "refuted", 30: "not_actionable", 40: "not_actionable",
                   50: "unverified"}


def test_last_verdict_per_line_wins_and_gate(spark):
    verdicts = [{"line": 10, "verdict": "refuted"},
                {"line": 10, "verdict": "confirmed", "exploitable": "yes", "confidence": "Low"}]
    b, files = _world(spark, verdicts, threshold="medium")
    row = b.where("line = 10").first()
    assert row["bucket"] == "confirmed" and row["status"] == "needs_review"
    gate = RP.ci_gate(b, files, fail_on="never", fail_on_confidence="medium").first()
    # everything above the line is unverified or Low -> nothing passes the gate; errors -> 1
    assert gate["confidence_triggered"] == 0 and gate["exit_code"] == 1


def test_report_rows_columns_and_csv(spark, tmp_path):
    b, files = _world(spark, [{"line": 10, "verdict": "confirmed", "exploitable": "yes",
                               "confidence": "Unknown", "verification_reason": 'q "x", y\nz'}])
    rows = RP.report_rows(b, files, spark)
    from quarry import registry as R
    assert rows.columns == R.REPORT_COLUMNS
    got = {(r["file"], r["line"]): r for r in rows.collect()}
    assert got[("app/bad.py", "")]["status"] == "timeout"
    r10 = got[("app/a.py", "10")]
    assert r10["confidence"] == "Unknown" and r10["tags"] == ""
    assert got[("app/a.py", "50")]["tags"] == "unsubstantiated"
    assert got[("app/a.py", "50")]["confidence"] == ""
    out = str(tmp_path / "report")
    RP.write_report(rows, out)
    back = spark.read.option("header", True).option("multiLine", True) \
        .option("escape", '"').csv(out)
    assert back.count() == rows.count()
    assert back.where("line = '10'").first()["verification_reason"] == 'q "x", y\nz'


ALLOW = [
    (0, "B9", "*", "0", "mail ok", "confirmed"),
    (1, "*", "app/a.py", "20", "exact", None),
    (2, "B3", "*", "30", "cand", "candidate"),
    (3, "B3", "app/a.py", None, "whole file", "confirmed"),
    (4, "*", "*", "10", "any 10", "confirmed"),
    (5, "B3", "*", "oops", "bad line", "confirmed"),
]


def test_first_match_strategies_agree(spark):
    b, _ = _world(spark, [], allow=ALLOW)
    got = {r["line"]: (r["suppression_pos"], r["status"]) for r in b.collect()}
    # line 20 -> entry 1 (exact, status absent); line 10 -> entry 3 precedes entry 4;
    # candidate entry 2 never matches, whole-file entry 3 catches the rest
    assert got == {10: (3, "suppressed"), 20: (1, "suppressed"), 30: (3, "suppressed"),
                   40: (3, "suppressed"), 50: (3, "suppressed")}
    al = spark.createDataFrame(ALLOW, ALLOWLIST_DDL)
    f = spark.createDataFrame([("B3", "app/a.py", 10), ("B9", "x.py", 7), ("B1", "y.py", 10),
                               ("B1", "y.py", None), ("B2", "z.py", 3)],
                              "scanner string, file string, line bigint")
    key = lambda r: (r["scanner"], r["file"], r["line"])
    a = {key(r): r["suppression_pos"] for r in first_match(f, al).collect()}
    entries = [r.asDict() for r in normalize_allowlist(al).collect()]
    b2 = {key(r): r["suppression_pos"] for r in first_match_array(f, entries).collect()}
    assert a == b2 == {("B3", "app/a.py", 10): 3, ("B9", "x.py", 7): 0, ("B1", "y.py", 10): 4,
                       ("B1", "y.py", None): None, ("B2", "z.py", 3): None}


def test_candidate_export_is_idempotent(spark):
    refuted = spark.createDataFrame(
        [("B3", "a.py", 42, "constant input", "1"), ("B3", "a.py", 42, "other", "2"),
         ("B3", "b.py", None, "", "3")],
        "scanner string, file string, line bigint, verification_reason string, order_key string")
    empty = spark.createDataFrame([], ALLOWLIST_DDL)
    c1 = allowlist_candidates(refuted, empty, exported_at="T")
    got = sorted((r["file"], r["line"], r["reason"]) for r in c1.collect())
    assert got == [("a.py", 42, "constant input"), ("b.py", 0, "(no evidence given)")]
    again = c1.select(F.lit(0).alias("pos"), "scanner", "file",
                      F.col("line").cast("string").alias("line"), "reason", "status")
    # an existing whole-file entry written as NULL blocks an exported 0
    nulls = spark.createDataFrame([(9, "B3", "b.py", None, "x", "confirmed")], ALLOWLIST_DDL)
    assert allowlist_candidates(refuted, again, exported_at="T").count() == 0
    assert allowlist_candidates(refuted, nulls, exported_at="T").count() == 1


def test_null_versus_missing_verdict_fields(spark):
    verdicts = [{"line": 10, "verdict": "confirmed", "exploitable": "yes", "confidence": None},
                {"line": 20, "verdict": "confirmed", "exploitable": None},
                {"line": 30, "verdict": "confirmed"}]
    b, files = _world(spark, verdicts)
    rows = {r["line"]: r for r in RP.report_rows(b, files, spark).collect()}
    assert (rows["10"]["confidence"], rows["10"]["status"]) == ("", "active")
    assert (rows["20"]["confidence"], rows["20"]["exploitable"]) == ("Unknown", "")
    assert (rows["30"]["exploitable"], rows["30"]["status"]) == ("unknown", "not_actionable")


def test_unicode_blank_source_is_unsubstantiated(spark):
    from tests.conftest import store_rows
    res = store_rows(spark, [("B3", "a.py", "ok", json.dumps(
        [{"line": 1, "source": "　"}, {"line": 2, "source": "\x1c "},
         {"line": 3, "source": "req"}, {"line": 4, "source": 7}]))])
    b = TR.bucketed(TR.normalised_results(res, VPH), None, None)
    got = {r["line"]: list(r["tags"]) for r in b.collect()}
    assert got == {1: ["unsubstantiated"], 2: ["unsubstantiated"], 3: [],
                   4: ["unsubstantiated"]}
