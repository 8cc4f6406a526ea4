"""The tree source: partitions of equal bytes, and the tree as a stream; rules' literals."""

import os
import random
import re

import pytest


def _write(root, rel, data):
    full = os.path.join(root, rel)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as fh:
        fh.write(data)


def test_one_big_folder_gives_many_even_partitions(spark, tmp_path):
    from quarry.sources.source_tree import OPEN_BYTES, SourceTreeReader, tree_corpus
    rnd = random.Random(1)
    sizes = {}
    for i in range(2000):
        rel = f"a/b/c/f{i}.py" if i % 10 else f"x{i}.py"
        sizes[rel] = rnd.choice([0, 10, 100, 5000])
        _write(tmp_path, rel, b"x" * sizes[rel])
    _write(tmp_path, "node_modules/skip.py", b"x")
    reader = SourceTreeReader({"path": str(tmp_path), "partition_bytes": 4 << 20})
    parts = reader.partitions()
    loads = [sum(sizes[f] + OPEN_BYTES for f in p.files) for p in parts]
    assert len(parts) == -(-sum(loads) // (4 << 20)) > 20
    assert max(loads) - min(loads) <= OPEN_BYTES + 5000
    assert sorted(f for p in parts for f in p.files) == sorted(sizes)
    got = {r.path: r.size for r in tree_corpus(spark, str(tmp_path)).select("path", "size").collect()}
    assert got == sizes


def test_an_empty_tree_and_one_huge_file(spark, tmp_path):
    from quarry.sources.source_tree import deal, tree_corpus
    assert tree_corpus(spark, str(tmp_path)).count() == 0
    assert deal([], 10) == [] and deal([("a", 10 ** 9), ("b", 1), ("c", 2)], 1 << 20) == [
        ["a"], ["c"], ["b"]]


def test_a_tree_streams_each_version_of_a_file_once(spark, tmp_path):
    from quarry.sources.stores import read_results
    from quarry.streaming.incremental import start_tree_scan
    root, store, ckpt = (str(tmp_path / x) for x in ("tree", "store", "ckpt"))
    _write(root, "src/a.yml", b"debug: true\n")
    _write(root, "src/b.yml", b"x: 1\n")
    _write(root, "vendor/c.yml", b"debug: true\n")
    def run():
        start_tree_scan(spark, root, store, ckpt).awaitTermination(180)
        return sorted((r.file, r.scanner, '"line":1' in r.result)
                      for r in read_results(spark, store).collect())
    first = [("src/a.yml", "B5", True), ("src/b.yml", "B5", False)]
    assert run() == first
    assert run() == first                                   # nothing new: nothing read
    _write(root, "src/d.yml", b"y: 2\n")
    _write(root, "src/b.yml", b"debug: true\nx: 1\n")       # edited
    assert run() == sorted([*first, ("src/d.yml", "B5", False), ("src/b.yml", "B5", True)])
    os.remove(os.path.join(root, "src/a.yml"))
    assert len(run()) == 4
    listings = os.listdir(os.path.join(ckpt, "listings"))
    assert len(listings) <= 2 and all(re.fullmatch(r"listing-\d{12}\.json", x) for x in listings)


@pytest.mark.parametrize("pattern,want", [
    ('token = "[0-9a-f]+"', ('token = "',)), ("(Licensed|Released) under", ("Licensed", "Released")),
    ("[0-9]{16}", ()), ("(?i)abc", ()), ("x*abc", ("abc",)), ("(abc)?d", ("d",)), ("a|", ()),
    ("(foo|bar.*baz|q)", ("foo", "bar", "q")), (r"\Qab\E", ()), (r"a\.b", ("a.b",)),
    ("^ab$c", ("ab",)), ("[[a]b]", ()), ("(ab){0,3}", ()), ("(ab){2}", ("ab",)), ("", ())])
def test_required_literals(pattern, want):
    from quarry.operators.analysts import required_literals
    assert required_literals(pattern) == want


def test_literals_change_no_match_with_many_rules(spark):
    from pyspark.sql import functions as F
    from quarry.operators.analysts import DEFAULT_RULES, Rule, any_rule, file_hits
    rnd = random.Random(3)
    rules = [*DEFAULT_RULES, *(Rule(f"r{i}", "B1", "Low", f"(mark{i}|m{i}[0-9]+k) *= *", "e", "f")
                               for i in range(60))]
    bits = ['token = "ab1"', "%%% x %%%", "Licensed under", "me@x.org", "4" * 16, "1.2.3.4",
            "Debug = True", "debug :", "MD5(", "x eval(", "verify = 0", "yaml.load(", "plain",
            "mark7 =", "m12 345k =", "m3 9k", "m59" + "9k=", "169.254.169.254", ""]
    texts = ["\n".join(rnd.choice(bits) + " " + rnd.choice(bits) for _ in range(rnd.randint(0, 6)))
             for _ in range(150)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = rows.select("text", any_rule(F.col("text"), rules).alias("any"),
                      file_hits(F.col("text"), rules).alias("hits")).collect()
    for r in got:
        want = [(n, [k for k, x in enumerate(rules) if re.search(x.pattern, line)])
                for n, line in enumerate(r.text.split("\n"), 1)]
        assert [(h.line, list(h.rules)) for h in r.hits] == [w for w in want if w[1]]
        assert r.any == any(w[1] for w in want)
