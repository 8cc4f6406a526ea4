"""Import of verdict documents, and confirmation of candidates."""

import hashlib
import json

import pytest


def _signature(findings):
    text = json.dumps(findings, sort_keys=True, separators=(",", ":"))
    return hashlib.md5(text.encode()).hexdigest()[:16]


def test_imported_verdicts_meet_the_findings_of_unchanged_files(spark, tmp_path):
    from quarry.operators.overlay import verdict_lines_from_replies
    from quarry.plans import triage as TR
    from quarry.sources import stores as S
    prompt = "v" * 16
    found = {"a.py": [{"line": 3, "severity": "High", "code": "é \U0001f600   \"q\"",
                       "source": "x", "tags": [], "more": {"b": 1.0, "a": [True, None, 1e5]}}],
             "b.py": [{"severity": "Low", "line": "7", "tags": ["unsubstantiated"]}, "no object",
                      {"line": 9}],
             "c.py": [{"line": 1}], "d.py": [{"line": 1}], "e.py": []}
    results, verdicts = tmp_path / "r", tmp_path / "v"
    results.mkdir(), verdicts.mkdir()

    def verdict(name, **changes):
        objects = [f for f in found[name] if isinstance(f, dict)]
        doc = {"file": name, "scanner": "injection", "status": "ok", "content_hash": "c" * 16,
               "findings_signature": _signature(objects), "verify_prompt_hash": prompt,
               "verifications": {str(f["line"]): {"verdict": "refuted", "confidence": "High",
                                                  "verification_reason": "a \"reason\", é"}
                                 for f in objects}}
        (verdicts / f"{name}.json").write_text(json.dumps(doc | changes))
    for name, f in found.items():
        (results / f"{name}.json").write_text(json.dumps(
            {"file": name, "scanner": "injection", "status": "ok", "content_hash": "c" * 16,
             "prompt_hash": "p" * 16, "result": json.dumps(f) if name == "b.py" else f}))
    verdict("a.py", verifications={"3": {"verdict": "refuted", "confidence": "High"},
                                   "x": {"verdict": "lost"}, "4": {}, "5": [1]})
    verdict("b.py")
    verdict("c.py", content_hash="d" * 16)              # the file has changed
    verdict("d.py", findings_signature="0" * 16)        # its findings have
    verdict("e.py", status="error")
    (verdicts / "broken.json").write_text("{broken")
    store = S.import_json_cache(spark, str(results / "*.json"), thinking="off")
    rows = S.import_verdict_documents(spark, str(verdicts / "*.json"), store)
    assert {r.file for r in rows.collect()} == {"a.py", "b.py"}
    path = str(tmp_path / "verdicts")
    S.append_verdicts(rows, path)
    from pyspark.sql import functions as F
    n = TR.normalised_results(store.withColumn("doc_id", F.xxhash64("file")), prompt)
    b = TR.bucketed(n, verdict_lines_from_replies(S.read_verdicts(spark, path)), None)
    got = {(r.file, r.line): (r.verdict, r.verification_reason) for r in b.collect()}
    assert got == {("a.py", 3): ("refuted", ""), ("b.py", 7): ("refuted", 'a "reason", é'),
                   ("b.py", 9): ("refuted", 'a "reason", é'), ("c.py", 1): (None, None),
                   ("d.py", 1): (None, None)}
    from quarry.operators.overlay import pending_verifications, verify_eligible
    left = pending_verifications(verify_eligible(n), S.read_verdicts(spark, path))
    assert {r.file for r in left.collect()} == {"c.py", "d.py"}


@pytest.mark.parametrize("result,same", [
    ("[]", []), ('"[{\\"a\\": 1}]"', [{"a": 1}]), ('[1, "x", "{\\"b\\": 2}"]', [{"b": 2}]),
    ("{}", None), ("broken", None), (None, None)])
def test_document_signatures(spark, result, same):
    from quarry.sources.stores import document_signature
    got = spark.createDataFrame([(result,)], "r string").select(document_signature("r")).first()[0]
    assert got == (None if same is None else _signature(same))


def test_a_confirmed_candidate_suppresses_from_the_next_run_on(spark, tmp_path):
    from quarry.sources import stores as S
    document, folder = str(tmp_path / "allowlist.json"), str(tmp_path / "candidates")
    (tmp_path / "allowlist.json").write_text(json.dumps({"version": 1, "suppressions": [
        {"scanner": "B1", "file": "h.py", "line": 1, "reason": "r", "status": "confirmed"}]}))
    ddl = ("pos bigint, scanner string, file string, line string, reason string, status string, "
           "exported_at string")
    S.write_allowlist(spark.createDataFrame(
        [(5, "B2", "a.py", "3", "x", "candidate", "t"), (6, "B2", "b.py", "0", "y", "candidate", "t")],
        ddl), folder + "/run-1")
    picks = spark.createDataFrame([("B2", "a.py", 3), ("B2", "a.py", 3), ("B9", "z", 1)],
                                  "scanner string, file string, line int")
    assert S.confirm_candidates(spark, document, folder, picks) == 1
    assert S.confirm_candidates(spark, document, folder, picks) == 0
    got = {(r.pos, r.file, r.status) for r in S.load_run_allowlist(spark, document, folder).collect()}
    assert got == {(0, "h.py", "confirmed"), (5, "a.py", "confirmed"), (6, "b.py", "candidate")}
    from quarry.operators.suppress import first_match
    findings = spark.createDataFrame([("B2", "a.py", 3), ("B2", "b.py", 1)],
                                     "scanner string, file string, line bigint")
    hit = {r.file: r.suppression_reason for r in first_match(
        findings, S.load_run_allowlist(spark, document, folder)).collect()}
    assert hit == {"a.py": "x", "b.py": None}
    S.write_allowlist(S.merged_allowlist(spark, document, folder), str(tmp_path / "merged"), True)
    text = "".join(p.read_text() for p in (tmp_path / "merged").glob("part-*"))
    assert [e["file"] for e in json.loads(text)["suppressions"]] == ["h.py", "a.py", "b.py"]
