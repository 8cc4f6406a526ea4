"""Cases that once went wrong: each test names the behaviour it keeps."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F


def _one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text,fixed", [
    (r'[{"code":"\\ud83d x"}]', r'[{"code":"\\ud83d x"}]'),        # an escaped backslash
    (r'"\ud83d"', '"�"'), (r'"\ud83d\ude00"', r'"\ud83d\ude00"'),
    (r'"\ude00\ud83d"', '"��"'), (r'"\\\ud83d"', '"\\\\�"'),
    (r'"\ud83d\\\ude00"', '"�\\\\�"'), ("\u0001b \\ud800", "\u0001b �"),
    (None, None), ("", ""), ("no escape", "no escape"),
])
def test_surrogate_repair(spark, text, fixed):
    from quarry.functions.text import sanitize_json_escapes
    from quarry.operators.responses import _sanitize_py
    assert _one(spark, text, sanitize_json_escapes("v")) == fixed
    if text is not None:
        assert _sanitize_py(text) == fixed


REPLIES = [
    ("   \u001c", "empty", None),
    ("[]", "array", 0), ('x [{"line": 1}] y', "array", 1),
    ("```json\n[{\"line\": 1}, {\"line\": 2}]\n```", "array", 2),
    ('see [1] and [{"line": 2}]', "array", 0),
    ('[{"line": 1}, {"line": 2', "truncated", 1), ('[{"line": 1}, {"line": 2}', "truncated", 2),
    ('[{"line": 1}, {"line": 2},', "truncated", 2), ('[{"a": "]"}, {"b": "', "truncated", 1),
    ('[{"a": [1, {"b": 2}]}, {"c"', "array", 1), ('[{"line": 1} {"line": 2}', "truncated", 1),
    ('[{"line": 1}, {bad}, {"line": 3}', "truncated", 1),
    ('[{"line": 1}, {bad}]', "error", None), ("[", "error", None), ("[[[[", "error", None),
    ("No findings here [", "marker", 0), ("no vulnerabilities.", "marker", 0),
    ('[{"line": 1, "line": 2}]', "array", 1), ('[{"line": NaN}]', "array", 1),
    ("prose only", "error", None), ('["\\ud83d"]', "array", 0),
]


def test_reply_recovery(spark):
    from quarry.operators.findings import result_items
    from quarry.operators.responses import parse_responses
    rows = [(i, "ok", t) for i, (t, _, _) in enumerate(REPLIES)]
    got = parse_responses(spark.createDataFrame(rows, "i int, status string, raw string"))
    got = {r.i: (r.kind, r.n) for r in got.select(
        "i", "kind", F.size(result_items(F.col("result"))).alias("n")).collect()}
    for i, (text, kind, n) in enumerate(REPLIES):
        assert got[i][0] == kind, text
        if n is not None and kind == "truncated":
            assert got[i][1] == n, text


def test_long_broken_replies_take_linear_time():
    import time

    from quarry.operators.responses import recover_array_py, recover_object_py
    t = time.time()
    kind, text = recover_array_py("[" + '{"line": 1},' * 50_000 + '{"li')
    assert kind == "truncated" and len(json.loads(text)) == 50_000
    assert time.time() - t < 5
    assert recover_object_py('{"B1": [".py"], "B2": [".j') == ("truncated", '{"B1": [".py"]}')


def test_prompt_values_stay_as_they_are(spark):
    from quarry.functions.text import render_prompt
    value = "\u0001\u0002 {file} {{x}} }}"
    got = _one(spark, value, render_prompt(F.lit("a {{b}} {file}."), file=F.col("v")))
    assert got == "a {b} " + value + "."


def test_rules_with_line_anchors(spark):
    from quarry.operators import analysts as A
    rule = A.Rule("r", "B1", "Low", "^secret$", "e", "f")
    df = spark.createDataFrame([("a\nsecret\nb",), ("secrets",)], "text string")
    got = df.select(A.file_hits(F.col("text"), [rule]).alias("h")).collect()
    assert [[h.line for h in r.h] for r in got] == [[2], []]
    with pytest.raises(ValueError):
        A.check_rules([A.Rule("r", "B1", "Low", r"\Asecret", "e", "f")])


def test_each_request_gets_one_answer(spark):
    from quarry.operators.analysts import model_results

    def analyst(pdf):
        rows = []
        for k in reversed(list(pdf["cache_key"])):
            if k != "missing":
                rows += [(k, "ok", f"re {k}")] * (2 if k == "twice" else 1)
        return pd.DataFrame([*rows, ("unasked", "ok", "x")], columns=["cache_key", "status", "raw"])
    asked = spark.createDataFrame([("a", 1), ("b", 2), ("missing", 3), ("twice", 4), ("a", 5)],
                                  "cache_key string, n int").coalesce(1)
    got = {r.n: (r.cache_key, r.status, r.raw) for r in model_results(
        asked, analyst, analyst_columns=["cache_key"], passthrough=["n"]).collect()}
    assert len(got) == 5
    assert got[1] == got[5] == ("a", "ok", "re a") and got[2] == ("b", "ok", "re b")
    assert got[3][1] == got[4][1] == "error"


def _corpus(spark, rows):
    from quarry.sources.corpus import corpus_from_table
    return corpus_from_table(spark.createDataFrame(rows, "id bigint, p string, t string"),
                             "p", "t", doc_id="id")


def test_a_failed_rescan_is_pending_again(spark, tmp_path):
    from quarry.operators.analysts import python_rule_analyst
    from quarry.plans.run import TriageConfig, run_triage

    def failing(pdf):
        raise RuntimeError("down")
    docs = _corpus(spark, [(1, "src/a.py", 'token = "abc"\n')])
    state = str(tmp_path / "state")
    run = lambda **k: run_triage(spark, docs, state, TriageConfig(
        scanners="B2", fail_on="never", **{x: v for x, v in k.items() if x == "rescan"}),
        scan_analyst=k["analyst"])
    good = python_rule_analyst()
    assert run(analyst=good).exit_code == 0
    assert run(analyst=failing, rescan=True).exit_code == 1
    last = run(analyst=good)
    assert last.pending.count() == 1 and last.exit_code == 0
    assert run(analyst=good).pending.count() == 0


def test_one_option_drives_review_and_gate(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    docs = _corpus(spark, [(1, "src/a.py", 'token = "abc"\n')])
    for level, code in (("high", 0), ("low", 0), ("never", 0)):
        got = run_triage(spark, docs, str(tmp_path / level), TriageConfig(
            scanners="B2", fail_on="never", fail_on_confidence=level))
        assert got.exit_code == code  # an unverified finding reaches no level


def test_verification_needs_a_verifier(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    with pytest.raises(ValueError):
        run_triage(spark, _corpus(spark, [(1, "a.py", "x")]), str(tmp_path), TriageConfig(verify=True))


def test_templates_discovery_and_allowlist_of_a_run(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    prompts = tmp_path / "prompts"
    prompts.mkdir()
    (prompts / "crypto.txt").write_text("OWN {filename}: {file_content}")
    (prompts / "discovery.txt").write_text("PROFILE {repo_structure}")
    state = tmp_path / "state"
    state.mkdir()
    (state / "allowlist.json").write_text(json.dumps({"version": 1, "suppressions": [
        {"scanner": "B2", "file": "*", "line": 0, "reason": "known", "status": "confirmed"}]}))

    def discover(pdf):
        assert pdf["prompt"].iloc[0].startswith("PROFILE ext\t")
        return pdf[["cache_key"]].assign(status="ok", raw='{"B2": [".zz"]}')

    def scan(pdf):
        raw = ['[{"line": 1, "severity": "High"}]' if p.startswith("OWN f.zz") else "[]"
               for p in pdf["prompt"]]
        return pdf[["cache_key"]].assign(status="ok", raw=raw)
    got = run_triage(spark, _corpus(spark, [(1, "src/f.zz", "x")]), str(state), TriageConfig(
        scanners="B2", prompt_dir=str(prompts)), scan_analyst=scan, discovery_analyst=discover)
    assert [(r.file, r.status, r.suppression_reason) for r in got.report.collect()] == [
        ("src/f.zz", "suppressed", "known")]


def test_first_run_reads_texts_once_and_moves_none(spark, tmp_path):
    from quarry.operators import analysts as A
    from quarry.operators import targets as TG
    docs = _corpus(spark, [(1, "src/a.py", 'token = "abc"\n')])
    ei, ni = TG.registry_maps()
    plan = A.rule_results(TG.fan_out(docs, ei, ni), TG.prompt_catalog(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in text


def test_linked_files_count_at_every_depth(spark, tmp_path):
    from quarry.sources.source_tree import tree_corpus
    root = tmp_path / "tree"
    (root / "a" / "b" / "c").mkdir(parents=True)
    (root / "real.py").write_text("x = 1\n")
    for d in ("", "a", "a/b/c"):
        os.symlink(root / "real.py", root / d / "link.py")
    got = {r.path for r in tree_corpus(spark, str(root)).collect()}
    assert got == {"real.py", "link.py", "a/link.py", "a/b/c/link.py"}


def test_texts_of_any_size_are_scanned(spark):
    from quarry.operators import analysts as A
    from quarry.operators import targets as TG
    from quarry.operators.filters import kept_files
    big = "filler line\n" * 300_000 + 'token = "abc"\n'
    ei, ni = TG.registry_maps(["B2"])
    got = A.rule_results(TG.fan_out(kept_files(_corpus(spark, [(1, "a.py", big)])), ei, ni),
                         TG.prompt_catalog(spark)).first()
    assert got.status == "ok" and json.loads(got.result)[0]["line"] == 300_001
