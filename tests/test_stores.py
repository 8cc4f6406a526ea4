import json
import os

from pyspark.sql import functions as F


def test_allowlist_roundtrip_and_candidates(spark, tmp_path):
    from quarry.operators.suppress import allowlist_candidates
    from quarry.sources.stores import (append_candidates, load_allowlist, load_allowlist_table,
                                       write_allowlist)
    src = tmp_path / "allowlist.json"
    src.write_text(json.dumps({"version": 1, "suppressions": [
        {"scanner": "B3", "file": "a.py", "line": 4, "reason": "test", "status": "confirmed"},
        "not-a-dict",
        {"scanner": "*", "file": "b.py", "line": None, "reason": "whole"},
    ]}))
    al = load_allowlist(spark, str(src))
    rows = al.orderBy("pos").collect()
    assert [(r["pos"], r["scanner"], r["line"]) for r in rows] == [(0, "B3", "4"), (2, "*", None)]
    refuted = spark.createDataFrame([("B3", "a.py", 4, "dup", "1"), ("B3", "c.py", 7, "new", "2")],
                                    "scanner string, file string, line bigint, "
                                    "verification_reason string, order_key string")
    cands = allowlist_candidates(refuted, al, exported_at="2024-01-01T00:00:00Z")
    merged = append_candidates(al, cands)
    assert merged.count() == 3
    out = str(tmp_path / "out")
    write_allowlist(merged, out, as_document=True)
    back = load_allowlist(spark, out)
    got = sorted((r["pos"], r["file"], r["status"]) for r in back.collect())
    assert got == [(0, "a.py", "confirmed"), (1, "b.py", None), (2, "c.py", "candidate")]
    lines = str(tmp_path / "lines")
    write_allowlist(merged, lines)
    table = load_allowlist_table(spark, lines)
    assert sorted(r["file"] for r in table.orderBy("pos").collect()) == ["a.py", "b.py", "c.py"]
    assert [r["file"] for r in table.orderBy("pos").collect()] == ["a.py", "b.py", "c.py"]
    # re-export is idempotent
    assert allowlist_candidates(refuted, back, exported_at="x").count() == 0
    assert load_allowlist(spark, str(tmp_path / "missing.json")).count() == 0


def test_json_cache_import_and_latest_attempt(spark, tmp_path):
    from quarry.sources.stores import append_results, import_json_cache, latest_attempts, \
        read_results
    d = tmp_path / "cache"
    d.mkdir()
    (d / "1.json").write_text(json.dumps({"file": "a.py", "scanner": "injection", "status": "ok",
                                          "content_hash": "c" * 16, "prompt_hash": "p" * 16,
                                          "result": [{"line": 1, "severity": "High"}]}))
    (d / "2.json").write_text("{corrupt")
    (d / "3.json").write_text(json.dumps({"file": "b.py", "scanner": "crypto", "status": "error",
                                          "content_hash": "d" * 16, "prompt_hash": "p" * 16,
                                          "result": {"error": "boom"}}))
    imp = import_json_cache(spark, str(d / "*.json"))
    got = {r["file"]: (r["scanner"], r["status"], json.loads(r["result"])) for r in imp.collect()}
    assert got == {"a.py": ("B3", "ok", [{"line": 1, "severity": "High"}]),
                   "b.py": ("B2", "error", {"error": "boom"})}
    store = str(tmp_path / "store")
    append_results(imp, store)
    append_results(imp.withColumn("status", F.lit("ok")), store)
    latest = latest_attempts(read_results(spark, store, tools_mode="off"))
    assert latest.count() == 2 and latest.where("status = 'ok'").count() == 2
    assert os.path.isdir(os.path.join(store, "tools_mode=off"))


def test_discovery_and_verdict_stores(spark, tmp_path):
    from quarry.operators.discovery import discovery_plan
    from quarry.sources.stores import (append_verdicts, load_discovery, read_verdicts,
                                       save_discovery)
    path = str(tmp_path / "discovery")
    assert load_discovery(spark, path) is None
    plan = discovery_plan(spark, spark.createDataFrame([('{"B3": ["rb"]}',)], "raw string"))
    save_discovery(plan, path, "off")
    save_discovery(plan.where("scanner = 'B3'"), path, "on")
    assert load_discovery(spark, path, "off").count() == plan.count()
    assert load_discovery(spark, path, "on").count() == plan.where("scanner = 'B3'").count()
    assert load_discovery(spark, path, "off", redetect=True) is None
    vpath = str(tmp_path / "verdicts")
    v = spark.createDataFrame([("k1", "B3", "a.py", "error", "{}")],
                              "verify_key string, scanner string, file string, status string, "
                              "result string")
    append_verdicts(v, vpath)
    append_verdicts(v.withColumn("status", F.lit("ok")), vpath)
    got = read_verdicts(spark, vpath).collect()
    assert len(got) == 1 and got[0]["status"] == "ok"


def test_first_match_without_broadcasts(spark):
    from quarry.operators.suppress import ALLOWLIST_DDL, first_match
    f = spark.createDataFrame([("B3", "a.py", 1)], "scanner string, file string, line bigint")
    al = spark.createDataFrame([(0, "B3", "a.py", "1", "r", None)], ALLOWLIST_DDL)
    small = first_match(f, al)
    assert small.first()["suppression_pos"] == 0
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = first_match(f, al)
        plan_big = big._jdf.queryExecution().executedPlan().toString()
        assert big.first()["suppression_pos"] == 0 and "SortMergeJoin" in plan_big
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastNestedLoopJoin" not in plan_big and "CartesianProduct" not in plan_big
