"""Model phases: waves that survive a lost job, deadlines, attempt times, skip counts."""

import json
import os
import time

import pandas as pd
import pytest


def _corpus(spark, rows):
    from quarry.sources.corpus import corpus_from_table
    return corpus_from_table(spark.createDataFrame(rows, "id bigint, p string, t string"),
                             "p", "t", doc_id="id")


FILES = [(i, f"src/f{i}.yml", f"debug: true\nn: {i}\n") for i in range(30)]


def _fast():
    def analyst(pdf):
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": "[]"})
    return analyst


def test_a_run_killed_in_a_wave_asks_only_the_rest(spark, tmp_path):
    from pyspark.sql import functions as F
    from quarry.plans.run import TriageConfig, run_triage
    from quarry.plans.waves import wave_attempts, wave_of
    from quarry.sources.stores import read_results
    state, asked = str(tmp_path / "state"), str(tmp_path / "asked")
    os.makedirs(asked)

    def logged(kill_at):
        def analyst(pdf):
            for key, text in zip(pdf["cache_key"], pdf["text"]):
                if kill_at and text in kill_at:
                    os._exit(9)                      # the worker is gone, and so is the job
                open(os.path.join(asked, f"{kill_at is None}-{key}"), "w").close()
            return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok",
                                 "raw": '[{"line": 1, "severity": "Low"}]'})
        return analyst

    waves = {r.id: r.w for r in spark.createDataFrame(FILES, "id bigint, p string, t string")
             .select("id", wave_of(F.col("p"), 5).alias("w")).collect()}
    used = sorted(set(waves.values()))
    assert used == [0, 1, 2, 3, 4]
    third = [t for i, _, t in FILES if waves[i] == 2]
    cfg = TriageConfig(scanners="B5", waves=5)
    with pytest.raises(Exception) as died:
        run_triage(spark, _corpus(spark, FILES), state, cfg, scan_analyst=logged(third))
    assert "crashed" in str(died.value) or "exited unexpectedly" in str(died.value)
    stored = read_results(spark, state + "/results")
    assert {(r.run is not None, r.wave) for r in stored.collect()} == {(True, 0), (True, 1)}
    done = {i for i in waves if waves[i] < 2}
    assert stored.count() == len(done)
    out = run_triage(spark, _corpus(spark, FILES), state, cfg, scan_analyst=logged(None))
    assert out.pending.count() == len(FILES) - len(done)
    again = [f for f in os.listdir(asked) if f.startswith("True-")]
    assert len(again) == len(FILES) - len(done)      # none of the stored ones is asked again
    stored = read_results(spark, state + "/results")
    assert stored.count() == len(FILES)
    per_wave = {(r.run == out.run, r.wave): (r.attempts, r.ok, r.files)
                for r in wave_attempts(stored).collect()}
    size = {w: sum(x == w for x in waves.values()) for w in used}
    assert per_wave == {(w >= 2, w): (size[w],) * 3 for w in used}
    progress = out.progress.collect()
    assert [(r.grp, r.total, r.completed, r.eta) for r in progress] == [
        ("B5", len(FILES) - len(done), len(FILES) - len(done), "done")]
    tables = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    tables = os.path.join(os.path.dirname(tables), "quarry-tables")
    if os.path.isdir(tables):
        assert not [d for d in os.listdir(tables) if d.startswith("scan-requests")]


def test_progress_is_told_after_each_wave(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    told = []

    def on_wave(phase, wave, progress):
        told.append((phase, wave, [(r.grp, r.total, r.completed) for r in progress.collect()]))
    reply = json.dumps([{"line": 1, "verdict": "confirmed"}])

    def scanner(pdf):
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok",
                             "raw": '[{"line": 1, "severity": "Low", "source": "x"}]'})

    def verifier(pdf):
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": reply})
    cfg = TriageConfig(scanners="B5", waves=2, verify=True, on_wave=on_wave)
    out = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "s"), cfg,
                     scan_analyst=scanner, verify_analyst=verifier)
    assert [(p, w) for p, w, _ in told] == [("scan", 0), ("scan", 1), ("verify", 0), ("verify", 1)]
    done = [c[0][2] for _, _, c in told]
    assert 0 < done[0] < done[1] == 30 and 0 < done[2] < done[3] == 30
    assert all(c[0][:2] == ("B5", 30) for _, _, c in told)
    assert out.report.where("verdict = 'confirmed'").count() == 30


def test_skipped_files_are_counted_in_passing(spark, tmp_path):
    from quarry.operators.filters import skip_counts
    from quarry.plans.run import TriageConfig, run_triage
    rows = [*FILES[:3], (90, "vendor/a.yml", "x"), (91, "src/b.png", "x"), (92, "a.yml", "a\0b"),
            (93, ".git/config", "x")]
    corpus = _corpus(spark, rows)
    want = {r.skip_reason: r.files for r in skip_counts(corpus).collect()}
    for i, analyst in enumerate((None, _fast())):
        out = run_triage(spark, corpus, str(tmp_path / f"s{i}"), TriageConfig(), analyst)
        assert out.skipped == want and want["kept"] == 3
    again = run_triage(spark, corpus, str(tmp_path / "s0"), TriageConfig(dry_run=True))
    assert again.skipped == want


# -- calls ------------------------------------------------------------------------------

def _asked(n):
    return pd.DataFrame({"cache_key": [f"k{i}" for i in range(n)]})


def test_a_hanging_call_is_one_timeout():
    from quarry.operators.calls import Caller, CallPolicy

    def analyst(pdf):
        if "k3" in set(pdf["cache_key"]):
            time.sleep(30)
        time.sleep(0.05)
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": "[]"})
    for rows in (1, 4):
        began = time.monotonic()
        got = Caller(analyst, CallPolicy(workers=4, deadline_s=0.5, call_rows=rows)).ask(_asked(12))
        assert time.monotonic() - began < 5
        assert {k: v[0] for k, v in got.items()} == {
            f"k{i}": "timeout" if i == 3 else "ok" for i in range(12)}
        assert all(abs(v[2] - time.time()) < 10 for v in got.values())


def test_workers_run_at_the_same_time_and_no_more_than_that():
    import threading
    from quarry.operators.calls import Caller, CallPolicy
    running, most, lock = [0], [0], threading.Lock()

    def analyst(pdf):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.02)
        with lock:
            running[0] -= 1
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": "[]"})
    got = Caller(analyst, CallPolicy(workers=3)).ask(_asked(20))
    assert len(got) == 20 and most[0] == 3


def test_hanging_calls_are_bounded():
    import threading
    from quarry.operators.calls import Caller, CallPolicy
    free = threading.Event()

    def analyst(pdf):
        free.wait(60)
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": "late"})
    caller = Caller(analyst, CallPolicy(workers=2, deadline_s=0.1, max_hung=4))
    before = threading.active_count()
    got = caller.ask(_asked(500))
    assert {v[0] for v in got.values()} == {"timeout"} and len(got) == 500
    assert threading.active_count() - before <= 5
    free.set()
    time.sleep(0.3)
    again = caller.ask(pd.DataFrame({"cache_key": ["x"]}))  # late answers go to nobody
    assert set(again) == {"x"} and again["x"][:2] == ("ok", "late") and caller.hung <= 1


@pytest.mark.parametrize("workers", [1, 3])
def test_failures_and_odd_answers_are_rows(spark, workers):
    from quarry.operators.analysts import model_results
    from quarry.operators.calls import CallPolicy

    def analyst(pdf):
        out = []
        for k in pdf["cache_key"]:
            if k == "raise":
                raise ValueError("no")
            if k == "exit":
                raise SystemExit(3)
            if k != "silent":
                out.append((k, {"none": None, "odd": "done", "late": "timeout"}.get(k, "ok"), "[]"))
            if k == "twice":
                out.append((k, "ok", "[]"))
        return pd.DataFrame(out, columns=["cache_key", "status", "raw"])
    keys = ["a", "raise", "exit", "silent", "none", "odd", "late", "twice", "b", "a"]
    asked = spark.createDataFrame([(k,) for k in keys], "cache_key string").coalesce(1)
    got = model_results(asked, analyst, policy=CallPolicy(workers=workers)).collect()
    assert [r.cache_key for r in got] == keys
    status = {r.cache_key: r.status for r in got}
    assert status == {"a": "ok", "b": "ok", "raise": "error", "exit": "error", "silent": "error",
                      "none": "error", "odd": "error", "late": "timeout", "twice": "error"}
    assert all(abs(r.attempted_at.timestamp() - time.time()) < 120 for r in got)


def test_timeouts_reach_the_store_and_are_asked_again(spark, tmp_path):
    from quarry.operators.calls import CallPolicy
    from quarry.plans.run import TriageConfig, run_triage
    from quarry.sources.stores import read_results

    def slow(pdf):
        if "n: 7\n" in pdf["text"].iloc[0]:
            import time as t
            t.sleep(60)
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": "[]"})
    cfg = TriageConfig(scanners="B5", waves=1, scan_calls=CallPolicy(workers=4, deadline_s=1.5))
    run_triage(spark, _corpus(spark, FILES), str(tmp_path / "s"), cfg, scan_analyst=slow)
    stored = read_results(spark, str(tmp_path / "s" / "results")).where("status != 'ok'").collect()
    assert [(r.file, r.status) for r in stored] == [("src/f7.yml", "timeout")]
    again = run_triage(spark, _corpus(spark, FILES), str(tmp_path / "s"), cfg,
                       scan_analyst=_fast())
    assert [r.path for r in again.pending.collect()] == ["src/f7.yml"]
    assert run_triage(spark, _corpus(spark, FILES), str(tmp_path / "s"),
                      TriageConfig(scanners="B5", dry_run=True)).pending.count() == 0


def test_policies_are_checked():
    from quarry.operators.calls import CallPolicy
    from quarry.plans.run import TriageConfig, validate
    for bad in ({"workers": 0}, {"call_rows": 0}, {"deadline_s": 0}, {"max_hung": 0}):
        with pytest.raises(ValueError):
            CallPolicy(**bad)
    with pytest.raises(ValueError):
        validate(TriageConfig(waves=0))


# -- pending text only ------------------------------------------------------------------

def test_bloom_filter_keeps_all_keys_and_few_others(spark):
    from pyspark.sql import functions as F
    from quarry.operators.bloom import filter_bits, key_filter, may_have
    rows = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    keys = spark.range(0, 100_000, 100).select(F.col("id").alias("doc_id"))
    got = {r.doc_id for r in may_have(rows, "doc_id", key_filter(keys, "doc_id", 1000), 1000)
           .select("doc_id").collect()}
    assert set(range(0, 100_000, 100)) <= got and len(got) < 1000 + 1000
    none = key_filter(keys.limit(0), "doc_id", 0)
    assert may_have(rows, "doc_id", none, 0).count() == 0
    assert filter_bits(0) == 64 and filter_bits(10 ** 12) == 1 << 26


def test_an_incremental_run_shuffles_about_the_pending_text(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    from quarry.plans import run as RUN
    fanned = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"),
        F.array(F.lit("B1"), F.lit("B2")).alias("scanners"))
    pending = spark.range(0, 20_000, 100).select(F.col("id").alias("doc_id"),
                                                 F.lit("B2").alias("scanner"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        met = RUN._pending_files(fanned, pending)
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("bit_get") > plan.index("Join Inner, (doc_id")  # below the exact join
        assert {tuple(r.scanners) for r in met.collect()} == {("B2",)}
        assert met.count() == 200
        from quarry.operators.bloom import key_filter, may_have
        seen = Observation()
        passed = may_have(fanned, "doc_id", key_filter(pending, "doc_id", 200), 200)
        passed.observe(seen, F.count("*").alias("n")).count()
        assert 200 <= seen.get["n"] < 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert RUN._pending_files(fanned, pending.limit(0)) is None


# -- stream, prompts, replies -----------------------------------------------------------

def test_stream_and_batch_agree_on_namespaces(spark, tmp_path):
    from quarry.plans.run import TriageConfig, run_triage
    from quarry.sources.stores import append_results, read_results
    from quarry.streaming.incremental import start_incremental_scan
    state, corpus_dir = str(tmp_path / "s"), str(tmp_path / "c")
    files = [(1, "src/a.py", 'token = "abc123"\n'), (2, "src/b.js", "x\n")]
    run_triage(spark, _corpus(spark, files), state, TriageConfig(tools_mode="on"))
    assert run_triage(spark, _corpus(spark, files), state,
                      TriageConfig(dry_run=True)).pending.count() == 16
    spark.createDataFrame(files, "doc_id bigint, path string, text string") \
        .write.parquet(corpus_dir)
    start_incremental_scan(spark, corpus_dir, state + "/results", str(tmp_path / "k1")) \
        .awaitTermination(120)
    assert read_results(spark, state + "/results", "off").count() == 16
    # a failure in one namespace opens nothing in the other
    on = read_results(spark, state + "/results", "on").drop("attempted_at", "run", "wave")
    from pyspark.sql import functions as F
    failed = spark.createDataFrame(on.withColumn("status", F.lit("error")).collect(), on.schema)
    append_results(failed, state + "/results")
    for mode, n in (("off", 16), ("on", 48)):
        start_incremental_scan(spark, corpus_dir, state + "/results", str(tmp_path / f"k-{mode}"),
                               tools_mode=mode).awaitTermination(120)
        assert read_results(spark, state + "/results", mode).count() == n


def test_prompt_folders_may_lack_templates(spark, tmp_path):
    from quarry import registry as R
    from quarry.operators import targets as TG
    folder = tmp_path / "p q%+"
    folder.mkdir()
    built_in = {r.scanner: r.template for r in TG.prompt_catalog(spark).collect()}
    got = {r.scanner: r.template for r in TG.prompt_catalog(spark, prompt_dir=str(folder)).collect()}
    assert got == built_in
    (folder / "verify.txt").write_text("v")
    name = R.SCANNER_BY_ID["B2"][1]
    (folder / f"{name}.txt").write_text("own {filename}")
    got = {r.scanner: r.template for r in TG.prompt_catalog(spark, prompt_dir=str(folder)).collect()}
    assert got == built_in | {"B2": "own {filename}"}


@pytest.mark.parametrize("raw,kind", [
    ("[" * 100_000, "error"), ('{"a":' * 20_000, "error"), ("[1," * 20_000, "truncated"),
    ("[" * 40_000 + '[{"line": 2}]', "array"), ("[" * 60 + "1" + "]" * 60, "array")])
def test_deep_replies_are_rows(spark, raw, kind):
    from quarry.operators.responses import parse_responses, recover_array_py, recover_object_py
    began = time.monotonic()
    assert recover_array_py(raw)[0] == kind
    recover_object_py(raw)
    assert time.monotonic() - began < 60
    got = parse_responses(spark.createDataFrame([(raw,)], "raw string")).first()
    assert got.kind == kind
