import pytest
from pyspark.sql import functions as F

from quarry.functions.text import format_eta, render_prompt


@pytest.mark.parametrize("secs,text", [
    (None, "?"), (-1.0, "?"), (0.5, "<1s"), (59.9, "59s"), (61.0, "1m01s"),
    (3600.0, "1h00m"), (3661.0, "1h01m"), (86400.0, "1d00h"), (93600.0, "1d02h"),
])
def test_format_eta(spark, secs, text):
    df = spark.createDataFrame([(secs,)], "s double")
    assert df.select(format_eta("s")).first()[0] == text


def test_render_prompt(spark):
    df = spark.createDataFrame(
        [("Check {filename}:\n{file_content}\nUse {{}} literally.", "a.py", "x = '{findings_json}'"),
         ("Bad {unknown} template", "a.py", "x")],
        "t string, n string, c string")
    out = [r[0] for r in df.select(render_prompt(F.col("t"), filename=F.col("n"),
                                                 file_content=F.col("c"))).collect()]
    assert out[0] == "Check a.py:\nx = '{findings_json}'\nUse {} literally."
    assert out[1] is None


def test_sanitize_surrogate_escapes(spark):
    from quarry.functions.text import sanitize_json_escapes
    cases = ["a\\ud800b", "a\\udc00b", "\\ud83d\\ude00", "\\udc00\\ud800"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = [r[0] for r in df.select(sanitize_json_escapes("s")).collect()]
    assert got == ["a�b", "a�b", "\\ud83d\\ude00", "��"]


def test_discovery_plan_normalisation(spark):
    from quarry import registry as R
    from quarry.operators.discovery import discovery_plan
    reply = spark.createDataFrame(
        [('Here you go: {"B3": ["rb", ".py", 7, ".PY"], "B5": "oops"}',)], "raw string")
    plan = discovery_plan(spark, reply)
    b3 = [r["ext"] for r in plan.where("scanner = 'B3'").orderBy("pos").collect()]
    base = list(R.SCANNER_BY_ID["B3"][3])
    assert b3[:3] == [".rb", ".py", ".PY"] and b3[3:] == [e for e in base if e not in b3[:3]]
    b5 = [r["ext"] for r in plan.where("scanner = 'B5'").orderBy("pos").collect()]
    assert b5 == list(R.SCANNER_BY_ID["B5"][3])


def test_line_coercion_and_raw_text(spark):
    """H8: int(line) semantics -- int, numeric string, float truncation, bool; else NULL."""
    import json
    from quarry.operators.findings import with_findings
    from tests.conftest import store_rows
    lines = [12, "7", 12.7, True, "abc", "12.7", None]
    res = store_rows(spark, [("B3", "a.py", "ok", json.dumps([{"line": v} for v in lines]))])
    f = with_findings(res).select(F.explode("findings").alias("f")).select("f.*").collect()
    assert [r["line"] for r in f] == [12, 7, 12, 1, None, None, None]
    assert [r["line_raw"] for r in f] == ["12", "7", "12.7", "", "abc", "12.7", ""]


def test_non_object_items_and_string_results(spark):
    """String items are re-parsed, non-objects dropped, a JSON-string result decoded."""
    import json
    from quarry.operators.findings import with_findings
    from tests.conftest import store_rows
    inner = json.dumps([{"line": 1}, 5, "x", json.dumps({"line": 2})])
    res = store_rows(spark, [("B3", "a.py", "ok", json.dumps(inner)),
                             ("B3", "b.py", "ok", '{"error": "could not parse"}')])
    got = {r["file"]: (r["is_list"], [x["line"] for x in r["findings"]])
           for r in with_findings(res).collect()}
    assert got == {"a.py": (True, [1, 2]), "b.py": (False, [])}


def test_prompt_catalog_from_directory(spark, tmp_path):
    from quarry import registry as R
    from quarry.operators.targets import prompt_catalog
    (tmp_path / "injection.txt").write_text("Custom {filename}\n{file_content}")
    cat = {r["scanner"]: r for r in prompt_catalog(spark, prompt_dir=str(tmp_path)).collect()}
    assert cat["B3"]["template"] == "Custom {filename}\n{file_content}"
    assert cat["B3"]["prompt_hash"] == R.short_hash("Custom {filename}\n{file_content}")
    assert cat["B2"]["template"] == R.default_prompt_template("B2")


def test_phase_progress_and_overall_eta(spark):
    import datetime as dt
    from quarry.plans.progress import overall_eta, phase_progress
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    att = spark.createDataFrame([("a", t0), ("a", t0 + dt.timedelta(seconds=10)),
                                 ("a", t0 + dt.timedelta(seconds=99))],
                                "grp string, ts timestamp_ntz")
    plan = spark.createDataFrame([("a", 4), ("b", 3), ("c", 0)], "grp string, total bigint")
    as_of = int(t0.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6) + 10_000_000
    p = {r["grp"]: r for r in phase_progress(att, plan, as_of).collect()}
    assert (p["a"]["completed"], p["a"]["per_h"], p["a"]["eta_s"], p["a"]["eta"]) == \
        (2, 720.0, 10, "10s")
    assert p["b"]["eta"] == "?" and p["c"]["eta"] == "done"
    o = overall_eta(phase_progress(att, plan, as_of)).first()
    assert (o["eta_s"], o["lower_bound"], o["eta"]) == (10, True, "≥10s")


def test_repo_structure_profile(spark):
    from quarry.operators.discovery import repo_structure
    from quarry.sources.corpus import corpus_from_table
    rows = [("src/app/a.py", "x"), ("src/app/b.py", "y"), ("pom.xml", "<p/>"), ("docs/r.md", "z")]
    c = corpus_from_table(spark.createDataFrame(rows, "p string, t string"), "p", "t")
    text = repo_structure(c).first()["profile"]
    lines = text.split("\n")
    assert lines[0] == "ext\t.py\t2" and "build\tpom.xml\t1" in lines
    assert any(x.startswith("dir\t") for x in lines)
