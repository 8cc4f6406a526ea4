"""Scan and verification as one stream: state by path, replays, removals, namespaces."""

import json
import os

import pandas as pd


def _write(root, rel, text):
    full = os.path.join(root, rel)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as fh:
        fh.write(text)


def _verifier(folder):
    def verify(pdf):
        out = []
        for key, found in zip(pdf["cache_key"], pdf["findings_json"]):
            open(os.path.join(folder, key), "a").write("x")
            out.append(json.dumps([{"line": f["line"], "verdict": "confirmed",
                                    "confidence": "High"} for f in json.loads(found)]))
        return pd.DataFrame({"cache_key": pdf["cache_key"], "status": "ok", "raw": out})
    return verify


def test_an_edited_file_is_scanned_and_verified_once_more(spark, tmp_path):
    from quarry.sources.stores import read_results, read_verdicts
    from quarry.streaming.triage import current_files, current_findings, start_tree_triage
    root, state, asked = (str(tmp_path / x) for x in ("tree", "state", "asked"))
    os.makedirs(asked)
    _write(root, "a.yml", "debug: true\n")
    _write(root, "b.yml", "debug = True\nx: 1\n")
    _write(root, "c.yml", "x: 1\n")

    def run(mode="off", ckpt="k"):
        start_tree_triage(spark, root, state, str(tmp_path / ckpt), tools_mode=mode,
                          verify_analyst=_verifier(asked)).awaitTermination(300)
        return (read_results(spark, state + "/results", mode).count(),
                read_verdicts(spark, state + "/verdicts", mode).count(),
                sum(os.path.getsize(os.path.join(asked, f)) for f in os.listdir(asked)))

    def found(mode="off"):
        return sorted((r.file, r.line, r.verdict)
                      for r in current_findings(spark, state, mode).collect())
    assert run() == (3, 2, 2)
    assert found() == [("a.yml", 1, "confirmed"), ("b.yml", 1, "confirmed")]
    assert run() == (3, 2, 2)
    _write(root, "a.yml", "x: 0\ndebug: true\n")
    assert run() == (4, 3, 3)                        # one scan, one verification
    assert found() == [("a.yml", 2, "confirmed"), ("b.yml", 1, "confirmed")]
    os.remove(os.path.join(root, "b.yml"))
    assert run() == (4, 3, 3)
    assert found() == [("a.yml", 2, "confirmed")]
    assert {r.path for r in current_files(spark, state).collect()} == {"a.yml", "c.yml"}
    # the stream started over reads every file again and asks nothing
    assert run(ckpt="again") == (4, 3, 3)
    _write(root, "a.yml", "x: 0\nx: 1\ndebug: true\n")
    assert run(ckpt="third") == (5, 4, 4)
    assert found() == [("a.yml", 3, "confirmed")]
    # the other namespace has nothing yet, and opens nothing in the first
    assert run("on", "k-on") == (2, 1, 5)
    assert found("on") == found() == [("a.yml", 3, "confirmed")]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    from quarry.sources.stores import read_results, read_verdicts
    from quarry.streaming.triage import current_files, triage_batch
    state, asked = str(tmp_path / "s"), str(tmp_path / "asked")
    os.makedirs(asked)
    ddl = ("doc_id bigint, path string, name string, ext string, size bigint, text string, "
           "skip_reason string")
    batch = spark.createDataFrame(
        [(1, "a.yml", "a.yml", ".yml", 12, "debug: true\n", None),
         (2, "b.bin", "b.bin", ".bin", 1, None, "binary_ext"),
         (3, "gone.yml", "gone.yml", ".yml", 0, None, "removed")], ddl)
    for _ in range(2):
        triage_batch(spark, batch, state, 0, verify_analyst=_verifier(asked))
    assert read_results(spark, state + "/results").count() == 1
    assert read_verdicts(spark, state + "/verdicts").count() == 1
    assert len(os.listdir(asked)) == 1
    assert [r.path for r in current_files(spark, state).collect()] == ["a.yml"]
    triage_batch(spark, batch.where("doc_id = 3").withColumn("path", batch.name), state, 1)
    empty = batch.where("doc_id = 9")
    triage_batch(spark, empty, state, 2)
    assert [r.path for r in current_files(spark, state).collect()] == ["a.yml"]
