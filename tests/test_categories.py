"""Categories as rows: a registry extended by tables, run end to end."""

import pytest


def _corpus(spark, rows):
    from quarry.sources.corpus import corpus_from_table
    return corpus_from_table(spark.createDataFrame(rows, "id bigint, p string, t string"),
                             "p", "t", doc_id="id")


FILES = [(1, "src/a.py", 'token = "abc123"\nTODO later\n'), (2, "src/b.foo", "TODO now\nx\n"),
         (3, "Taskfile", "fine\n"), (4, "src/c.yml", "debug: true\n")]
X1 = {"categories": [("X1", 11, "todo", "Open work", None)],
      "extensions": [("X1", 0, "FOO"), ("X1", 1, ".py")], "names": [("X1", "Taskfile")],
      "rules": [(50, "todo", "X1", "Low", "TODO", "Open work", "Do it", "text", None)]}


def test_builtin_tables_equal_the_registry(spark):
    from quarry import registry as R
    from quarry.operators import targets as TG
    from quarry.operators.analysts import DEFAULT_RULES
    from quarry.operators.categories import Registry
    reg = Registry.builtin(spark)
    assert reg.ids() == R.SCANNER_IDS and reg.rule_list() == DEFAULT_RULES
    assert sorted(reg.catalog().collect()) == sorted(
        TG.prompt_catalog(spark).select(reg.catalog().columns).collect())
    ext, names = TG.registry_maps()
    assert {r.key: r.scanners for r in reg.ext_index().collect()} == {
        k: sorted(v) for k, v in ext.items()}
    assert {r.key: r.scanners for r in reg.name_index().collect()} == {
        k: sorted(v) for k, v in names.items()}


def test_a_run_with_a_category_of_rows_alone(spark, tmp_path):
    from quarry.operators.categories import Registry
    from quarry.plans.run import TriageConfig, run_triage
    mine = Registry.builtin(spark).extended(**X1)
    cfg = TriageConfig(registry=mine, fail_on="never")
    out = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "a"), cfg)
    got = {(r.scanner, r.scanner_label, r.file, r.line) for r in out.report.collect()
           if r.scanner == "X1"}
    assert got == {("X1", "Open work", "src/a.py", "2"), ("X1", "Open work", "src/b.foo", "1")}
    plain = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "b"), TriageConfig())
    rest = sorted(tuple(r) for r in out.report.collect() if r.scanner != "X1")
    assert rest == sorted(tuple(r) for r in plain.report.collect())
    # a second run has nothing to do; one of X1 alone neither
    assert run_triage(spark, _corpus(spark, FILES), str(tmp_path / "a"), cfg).pending.count() == 0
    one = TriageConfig(registry=mine, scanners="x1", dry_run=True)
    assert run_triage(spark, _corpus(spark, FILES), str(tmp_path / "a"), one).pending.count() == 0
    fresh = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "c"), one).pending.collect()
    assert {(r.scanner, r.path) for r in fresh} == {
        ("X1", "src/a.py"), ("X1", "src/b.foo"), ("X1", "Taskfile")}
    over = TriageConfig(registry=mine, scanners="X1", dry_run=True, format_override=["yml"])
    fresh = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "d"), over).pending.collect()
    assert [r.path for r in fresh] == ["src/c.yml"]
    with pytest.raises(ValueError):
        run_triage(spark, _corpus(spark, FILES), str(tmp_path / "e"), TriageConfig(scanners="X1"))


def test_an_allowlist_may_name_the_new_category(spark, tmp_path):
    from quarry.operators.categories import Registry
    from quarry.plans.run import TriageConfig, run_triage
    state = tmp_path / "s"
    state.mkdir()
    (state / "allowlist.json").write_text(
        '{"version": 1, "suppressions": [{"scanner": "X1", "file": "*", "line": 0, '
        '"reason": "known", "status": "confirmed"}]}')
    cfg = TriageConfig(registry=Registry.builtin(spark).extended(**X1))
    out = run_triage(spark, _corpus(spark, FILES), str(state), cfg)
    assert {r.status for r in out.report.collect() if r.scanner == "X1"} == {"suppressed"}


@pytest.mark.parametrize("bad", [
    {"categories": [("B1", 12, "other", "Other", None)]},
    {"categories": [("X2", 12, "crypto", "Other", None)]},
    {"extensions": [("nobody", 0, ".x")]}, {"rules": [(1, "r", "none", "Low", "a", "e", "f", None, None)]},
    {"names": [("B1", f"n{i}") for i in range(100_001)]}])
def test_bad_tables_are_errors(spark, bad):
    from quarry.operators.categories import Registry
    with pytest.raises(ValueError):
        Registry.builtin(spark).extended(**bad)
