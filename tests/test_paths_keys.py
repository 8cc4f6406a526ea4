import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import keys as K
from quarry.functions import paths as P
from quarry.operators.filters import label_corpus
from quarry.sources.corpus import corpus_from_table


@pytest.mark.parametrize("path,ext", [
    ("a.py", ".py"), ("dir/.env", ""), ("x/F.Java", ".java"), ("a.tar.gz", ".gz"),
    ("c/.eslintrc.json", ".json"), ("Makefile", ""), ("d.v1/readme", ""), ("up/IMG.PNG", ".png"),
])
def test_extension(spark, path, ext):
    got = spark.createDataFrame([(path,)], "p string").select(P.extension("p")).first()[0]
    assert got == ext


@pytest.mark.parametrize("path,excluded", [
    ("vendor/a.py", True), ("src/vendor/a.py", False), ("node_modules/foo.js", True),
    ("Source/Regression/Sub/b.py", True), ("Source/Other/b.py", False),
    (".quarry_state_old/B3/x.json", True), ("sub/.quarry_state_old/y.json", True),
    ("src/.quarry_statening.py", False), ("deep/dir/quarry_report.md", True),
    ("ThirdParty/wheelhouse/w.py", True), ("ThirdParty/other/w.py", False),
    ("vendorx/a.py", False), ("a.py", False),
])
def test_excluded_path(spark, path, excluded):
    got = spark.createDataFrame([(path,)], "p string").select(P.excluded_path("p")).first()[0]
    assert got is excluded


def _corpus(spark, rows, binary=False):
    ddl = "path string, content binary" if binary else "path string, content string"
    return corpus_from_table(spark.createDataFrame(rows, ddl), "path", "content", binary=binary)


def test_corpus_checks_and_size_boundary(spark):
    rows = [("a.py", "x" * 100), ("b.py", "x" * 101), ("img/logo.png", "x"),
            ("node_modules/m.js", "x"), ("t.txt", "a\u0000b"), ("empty.py", "")]
    lab = label_corpus(_corpus(spark, rows), max_file_size=100)
    got = {r["path"]: r["skip_reason"] for r in lab.collect()}
    assert got == {"a.py": None, "b.py": "oversized", "img/logo.png": "binary_ext",
                   "node_modules/m.js": "excluded_dir", "t.txt": "nul_bytes", "empty.py": None}
    # a cap of 0 disables the size check
    lab0 = label_corpus(_corpus(spark, rows), max_file_size=0)
    assert {r["path"] for r in lab0.where("skip_reason is null").collect()} == {
        "a.py", "b.py", "empty.py"}


def test_binary_content_decode_and_nul_window(spark):
    late_nul = b"a" * 8192 + b"\x00"
    rows = [("ok.py", bytearray(b"a\xffb")), ("late.py", bytearray(late_nul)),
            ("early.py", bytearray(b"\x00abc"))]
    c = _corpus(spark, rows, binary=True)
    texts = {r["path"]: r["text"] for r in c.collect()}
    assert texts["ok.py"] == "a�b"
    lab = c.withColumn("nul", P.has_nul("text"))
    got = {r["path"]: r["nul"] for r in lab.collect()}
    assert got == {"ok.py": False, "late.py": False, "early.py": True}


def test_keys_match_python_hashes(spark):
    text = "print('héllo')\n"
    df = spark.createDataFrame([(text,)], "t string")
    ch = df.select(K.content_hash("t")).first()[0]
    assert ch == hashlib.md5(text.encode()).hexdigest()[:16]
    row = df.select(
        K.scan_key(F.lit("injection"), F.lit("src/a.py"), F.lit(ch), F.lit("p" * 16),
                   F.lit("off")).alias("k"),
        K.verify_key(F.lit("injection"), F.lit("src/a.py"), F.lit(ch), F.lit("s" * 16),
                     F.lit("v" * 16), F.lit("")).alias("v")).first()
    assert row["k"] == hashlib.md5(f"injection:src/a.py:{ch}:{'p' * 16}:off".encode()).hexdigest()
    assert row["v"] == hashlib.md5(
        f"verify:injection:src/a.py:{ch}:{'s' * 16}:{'v' * 16}:".encode()).hexdigest()


def test_scan_key_sensitivity(spark):
    base = ["crypto", "a.py", "c" * 16, "p" * 16, "off"]
    variants = [base] + [base[:i] + [base[i] + "x"] + base[i + 1:] for i in range(5)]
    df = spark.createDataFrame(variants, "s string, p string, c string, h string, t string")
    keys = [r[0] for r in df.select(K.scan_key("s", "p", "c", "h", "t")).collect()]
    assert len(set(keys)) == 6


def test_signature_changes_with_findings(spark):
    from quarry.operators.findings import with_findings
    from tests.conftest import store_rows
    res = store_rows(spark, [
        ("B3", "a.py", "ok", '[{"line": 1, "severity": "High", "source": "q"}]'),
        ("B3", "b.py", "ok", '[{"line": 1, "severity": "High", "source": "q"}]'),
        ("B3", "c.py", "ok", '[{"line": 2, "severity": "High", "source": "q"}]'),
    ])
    sigs = [r["s"] for r in with_findings(res).select(
        "file", K.findings_signature("findings").alias("s")).orderBy("file").collect()]
    assert sigs[0] == sigs[1] and sigs[0] != sigs[2]
