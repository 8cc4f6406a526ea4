import os



def _write(root, rel, data: bytes):
    p = os.path.join(root, rel)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "wb") as fh:
        fh.write(data)


def test_source_tree_reader(spark, tmp_path):
    from quarry.sources.source_tree import tree_corpus
    root = str(tmp_path / "repo")
    files = {
        "a.py": b"print(1)\n", "dir1/pom.xml": b"<project/>", "node_modules/foo.js": b"x",
        "Source/Regression/Sub/b.py": b"x", ".quarry_state_old/B3/x.json": b"{}",
        "sub/.quarry_state_old/y.json": b"{}", "src/.quarry_statening.py": b"ok = 1\n",
        "image.png": b"\x89PNG", "trick.txt": b"abc\x00def", "edge100.py": b"a" * 100,
        "edge101.py": b"a" * 101, "empty.py": b"", "_hidden.py": b"h", ".dot/x.py": b"d",
        "deep/er/still/more/z.py": b"z", "tools/quarry_report.md": b"self",
        "bad.py": b"a\xffb",
    }
    for rel, data in files.items():
        _write(root, rel, data)
    c = tree_corpus(spark, root, max_file_size=100, keep_skipped=True)
    got = {r["path"]: r["skip_reason"] for r in c.collect()}
    assert got == {
        "a.py": None, "dir1/pom.xml": None, "src/.quarry_statening.py": None,
        "image.png": "binary_ext", "trick.txt": "nul_bytes", "edge100.py": None,
        "edge101.py": "oversized", "empty.py": None, "_hidden.py": None, ".dot/x.py": None,
        "deep/er/still/more/z.py": None, "bad.py": None,
    }
    texts = {r["path"]: r["text"] for r in c.collect()}
    assert texts["bad.py"] == "a�b" and texts["empty.py"] == ""


def test_incremental_stream_reanalyses_only_changes(spark, tmp_path):
    from quarry.streaming.incremental import start_incremental_scan, start_progress
    corpus_dir, store, ckpt = (str(tmp_path / d) for d in ("corpus", "store", "ckpt"))
    v1 = [(1, "src/a.py", 'token = "abc123"\n'), (2, "src/b.js", "hello\n"),
          (3, "src/c.yml", "debug: true\n")]
    spark.createDataFrame(v1, "doc_id bigint, path string, text string") \
        .write.mode("append").parquet(corpus_dir)
    q = start_incremental_scan(spark, corpus_dir, store, ckpt)
    q.awaitTermination(120)
    first = spark.read.parquet(store)
    n1 = first.count()
    seen = first.agg({"attempted_at": "max"}).first()[0]
    # a.py: B1,B2,B3,B4,B7,B8,B9,B10; b.js: the same 8; c.yml: B5 -> 17 pairs
    assert n1 == 17
    assert first.where("scanner = 'B2' and file = 'src/a.py'").first()["result"].startswith(
        '[{"line":1')
    # second drop: one edited file, one unchanged copy
    v2 = [(1, "src/a.py", 'token = "abc124"\n'), (2, "src/b.js", "hello\n")]
    spark.createDataFrame(v2, "doc_id bigint, path string, text string") \
        .write.mode("append").parquet(corpus_dir)
    q = start_incremental_scan(spark, corpus_dir, store, ckpt)
    q.awaitTermination(120)
    after = spark.read.parquet(store)
    new = after.where(after["attempted_at"] > seen)
    assert new.count() == 8
    assert {r["file"] for r in new.collect()} == {"src/a.py"}
    out = str(tmp_path / "progress")
    p = start_progress(spark, store, out, str(tmp_path / "pckpt"))
    p.awaitTermination(120)
    counts = spark.read.parquet(out).groupBy("scanner", "status").agg({"completed": "max"})
    assert counts.agg({"max(completed)": "sum"}).first()[0] == 25
    # batch runs read what the stream has stored
    from quarry.sources.stores import latest_attempts, read_results
    assert latest_attempts(read_results(spark, store, "off")).count() == 25


def test_incremental_stream_with_model_analyst(spark, tmp_path):
    from quarry.operators.analysts import python_rule_analyst
    from quarry.streaming.incremental import start_incremental_scan
    corpus_dir, store, ckpt = (str(tmp_path / d) for d in ("corpus", "store", "ckpt"))
    v1 = [(1, "src/a.py", 'token = "abc123"\n'), (2, "src/c.yml", "debug: true\n")]
    spark.createDataFrame(v1, "doc_id bigint, path string, text string") \
        .write.mode("append").parquet(corpus_dir)
    start_incremental_scan(spark, corpus_dir, store, ckpt,
                           analyst=python_rule_analyst()).awaitTermination(180)
    got = spark.read.parquet(store)
    assert got.count() == 9 and got.where("status = 'ok'").count() == 9
    b2 = got.where("scanner = 'B2'").first()["result"]
    assert '"line":1' in b2 and "unsubstantiated" in b2
    spark.createDataFrame([(1, "src/a.py", 'token = "abc123"\n')],
                          "doc_id bigint, path string, text string") \
        .write.mode("append").parquet(corpus_dir)
    start_incremental_scan(spark, corpus_dir, store, ckpt,
                           analyst=python_rule_analyst()).awaitTermination(180)
    assert spark.read.parquet(store).count() == 9      # unchanged file: nothing re-analysed
