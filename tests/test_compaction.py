"""Compacted stores read like the stores they come from."""

import datetime as dt

import pytest

from quarry.sources import stores as S

AT = dt.datetime(2024, 1, 1)


def _results(spark, rows):
    """rows: (key, mode, status, result, hours)"""
    return spark.createDataFrame(
        [(k, "B1", "n", f"{k}.py", st, "c", "p", "off", mode, res, AT + dt.timedelta(hours=h))
         for k, mode, st, res, h in rows],
        ", ".join(f"{c} string" for c in S.RESULT_COLUMNS) + ", attempted_at timestamp")


ROWS = [("a", "off", "ok", "[1]", 0), ("a", "off", "error", "{}", 1), ("a", "on", "ok", "[2]", 0),
        ("b", "off", "error", "{}", 0), ("b", "off", "ok", "[3]", 1), ("c", "off", "timeout", None, 0),
        ("d", "off", "ok", "[4]", 2), ("d", "off", "ok", "[5]", 2), ("d", "off", "error", "{}", 2)]


def test_results_keep_the_latest_attempt_of_each_key_and_namespace(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    S.append_results(_results(spark, ROWS[:4]), old, run="r1", wave=0)
    S.append_results(_results(spark, ROWS[4:]), old, run="r2", wave=0)
    S.compact_results(spark, old, new)
    assert S.read_results(spark, new).count() == 5
    for mode in ("off", "on", None):
        want = S.read_results(spark, old, mode)
        if mode:
            want = S.latest_attempts(want)
            again = S.latest_attempts(S.read_results(spark, new, mode))
            assert sorted(map(str, want.collect())) == sorted(map(str, again.collect()))
    assert S.read_results(spark, old).count() == len(ROWS)  # the old store is left alone
    with pytest.raises(Exception, match="(?i)already exists"):
        S.compact_results(spark, old, new)
    # compacting once more changes nothing, and the store takes appends as before
    third = str(tmp_path / "third")
    S.compact_results(spark, new, third)
    assert sorted(map(str, S.read_results(spark, third).collect())) == sorted(
        map(str, S.read_results(spark, new).collect()))
    S.append_results(_results(spark, [("c", "off", "ok", "[6]", 9)]), third)
    last = {r.cache_key: r.result for r in S.latest_attempts(
        S.read_results(spark, third, "off")).collect()}
    assert last["c"] == "[6]" and last["b"] == "[3]" and last["d"] == "{}"


def test_a_run_over_a_compacted_store_reports_the_same(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    from quarry.sources.corpus import corpus_from_table
    files = [(1, "src/a.py", 'token = "abc123"\nx@y.org\n'), (2, "src/b.py", "debug: true\n")]
    corpus = lambda rows: corpus_from_table(
        spark.createDataFrame(rows, "id bigint, p string, t string"), "p", "t", doc_id="id")
    cfg = TriageConfig(fail_on="never")
    first, second = str(tmp_path / "s1"), str(tmp_path / "s2")
    run_triage(spark, corpus(files), first, cfg)
    out = run_triage(spark, corpus([files[0], (2, "src/b.py", "debug: true\nMD5(\n")]), first, cfg)
    want = sorted(map(str, out.report.collect()))
    S.compact_results(spark, f"{first}/results", f"{second}/results")
    again = run_triage(spark, corpus([files[0], (2, "src/b.py", "debug: true\nMD5(\n")]), second, cfg)
    assert sorted(map(str, again.report.collect())) == want and want
    # nothing was asked again
    assert {r.run for r in S.read_results(spark, f"{second}/results").collect()} == {
        r.run for r in S.read_results(spark, f"{first}/results").collect()}


def test_verdicts_keep_the_latest_attempt(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    for h, status in enumerate(["ok", "error", "ok"]):
        row = {c: f"{c}" for c in S.VERDICT_COLUMNS} | {"status": status, "verify_key": "k"}
        df = spark.createDataFrame([tuple(row[c] for c in S.VERDICT_COLUMNS)],
                                   ", ".join(f"{c} string" for c in S.VERDICT_COLUMNS))
        S.append_verdicts(df, old, tools_mode="on" if h == 2 else "off")
    S.compact_verdicts(spark, old, new)
    for mode in ("off", "on"):
        assert S.read_verdicts(spark, new, mode).collect() == S.read_verdicts(spark, old, mode).collect()
    assert spark.read.parquet(new).count() == 2


def test_an_empty_store_compacts_to_an_empty_one(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    S.append_results(_results(spark, ROWS).where("false"), old)
    S.compact_results(spark, old, new)
    assert S.read_results(spark, new).count() == 0
