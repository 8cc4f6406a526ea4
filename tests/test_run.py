import pytest


def _corpus(spark, rows):
    from quarry.sources.corpus import corpus_from_table
    return corpus_from_table(spark.createDataFrame(rows, "id bigint, p string, t string"),
                             "p", "t", doc_id="id")


FILES = [(1, "src/a.py", 'x = 1\ntoken = "abc123"\nmail = "me@example.com"\n'),
         (2, "src/b.js", "console.log(1)\n"),
         (3, "conf/app.yml", "debug: true\n"),
         (4, "vendor/lib.js", 'token = "ffff"\n')]


def test_validation():
    from quarry.plans.run import TriageConfig, validate
    assert validate(TriageConfig(scanners="b3, B1"))[0] == ["B1", "B3"]
    assert validate(TriageConfig(phase=3))[1] is True
    for bad in (TriageConfig(partitions=0), TriageConfig(fail_on_confidence="x"), TriageConfig(scanners="B99"),
                TriageConfig(verify=True, phase=1), TriageConfig(scanners="")):
        with pytest.raises(ValueError):
            validate(bad)


def test_run_is_incremental_and_gated(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    state = str(tmp_path / "state")
    cfg = TriageConfig(verify=True, fail_on="high", export_candidates=True)
    from quarry.operators.analysts import python_verifier
    check = {"verify_analyst": python_verifier()}
    first = run_triage(spark, _corpus(spark, FILES), state, cfg, **check)
    # a.py: 8 categories, b.js: 8, app.yml: B5 -> 17 pending pairs; vendor/ is excluded
    assert first.pending.count() == 17
    rows = {(r["scanner"], r["line"]): r for r in first.report.collect()}
    assert rows[("B2", "2")]["status"] in ("active", "needs_review")
    assert rows[("B5", "1")]["severity"] == "Medium"
    assert first.exit_code == 1                       # a High finding stays above the line
    second = run_triage(spark, _corpus(spark, FILES), state, cfg, **check)
    assert second.pending.count() == 0
    assert second.report.count() == first.report.count()
    edited = [FILES[0], FILES[1], (3, "conf/app.yml", "debug: false\n"), FILES[3]]
    third = run_triage(spark, _corpus(spark, edited), state, cfg, **check)
    assert [(r["scanner"], r["path"]) for r in third.pending.collect()] == [("B5", "conf/app.yml")]
    assert ("B5", "1") not in {(r["scanner"], r["line"]) for r in third.report.collect()}
    with pytest.raises(ValueError):
        run_triage(spark, _corpus(spark, FILES), str(tmp_path / "empty"),
                   TriageConfig(phase=3), **check)


def test_run_with_model_analyst_matches_native(spark, tmp_path):
    from quarry.operators.analysts import python_rule_analyst
    from quarry.plans.run import TriageConfig, run_triage
    native = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "native"), TriageConfig())
    model = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "model"), TriageConfig(),
                       scan_analyst=python_rule_analyst())
    cols = ["scanner", "file", "line", "severity", "code", "tags", "status"]
    key = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
    assert key(native.report) == key(model.report)
    again = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "model"), TriageConfig(),
                       scan_analyst=python_rule_analyst())
    assert again.pending.count() == 0 and key(again.report) == key(model.report)


def test_stale_results_only_with_include_stale(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    state = str(tmp_path / "state")
    files = [(1, "src/a.py", 'token = "abc"\n')]
    run_triage(spark, _corpus(spark, files), state, TriageConfig(scanners="B2"))
    edited = [(1, "src/a.py", 'x = 0\ntoken = "abd"\n')]
    cur = run_triage(spark, _corpus(spark, edited), state, TriageConfig(scanners="B2"))
    assert sorted(r["line"] for r in cur.report.collect()) == ["2"]
    both = run_triage(spark, _corpus(spark, edited), state,
                      TriageConfig(scanners="B2", include_stale=True))
    assert sorted(r["line"] for r in both.report.collect()) == ["1", "2"]
    dry = run_triage(spark, _corpus(spark, edited + [(2, "src/b.py", "y\n")]), state,
                     TriageConfig(scanners="B2", dry_run=True))
    assert [r["path"] for r in dry.pending.collect()] == ["src/b.py"] and dry.report is None


def test_limit_and_tsv_report(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    state = str(tmp_path / "state")
    files = [(1, "src/a.py", 'token = "abc"\n'), (2, "src/b.py", 'token = "abd"\n')]
    out = run_triage(spark, _corpus(spark, files), state,
                     TriageConfig(scanners="B2", limit=1, report_format="tsv"))
    assert [r["path"] for r in out.pending.collect()] == ["src/a.py"]
    back = spark.read.option("header", True).option("sep", "\t").csv(state + "/report")
    assert [r["file"] for r in back.collect()] == ["src/a.py"]
    rest = run_triage(spark, _corpus(spark, files), state, TriageConfig(scanners="B2", limit=1))
    assert [r["path"] for r in rest.pending.collect()] == ["src/b.py"]
