"""Many lexical rules: one pass for their required texts, the same hits as one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.operators import analysts as A


def _rules(n):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcxyz_.") for _ in range(rng.randint(2, 6)))
    shapes = [lambda: re.escape(word()), lambda: f"({re.escape(word())}|{re.escape(word())})[(]",
              lambda: f"^{re.escape(word())} *=", lambda: "[0-9]{5,}",
              lambda: f"{re.escape(word())}.*{re.escape(word())}$"]
    return [A.Rule(f"r{k}", f"B{k % 10 + 1}", "Low", shapes[k % 5 if k % 50 else 3](), "e", "f")
            for k in range(n)]


def _texts():
    rng = random.Random(6)
    line = lambda: "".join(rng.choice("abcxyz_.(= 0123") for _ in range(rng.randint(0, 40)))
    return [None, "", "\n\n", "x" * 50_000, *("\n".join(line() for _ in range(rng.randint(1, 9)))
                                             for _ in range(150))]


@pytest.mark.parametrize("n", [A.INDEXED_RULES, 500])
def test_many_rules_hit_like_one_by_one(spark, n):
    rules = _rules(n)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "i int, t string") \
        .repartition(1).cache()
    got = {r.i: r.h for r in df.select("i", A.file_hits(F.col("t"), rules).alias("h")).collect()}
    seen = 0
    for i, text in enumerate(_texts()):
        want = [] if text is None else [
            (no, code, ks) for no, code in enumerate(text.split("\n"), 1)
            if (ks := [k for k, r in enumerate(rules) if re.search(r.pattern, code)])]
        assert [(h.line, h.code, h.rules) for h in got[i] or []] == want
        seen += len(want)
    assert seen > 50


def test_texts_that_begin_alike_overlap_or_hold_odd_characters(spark):
    texts = ["ab", "abc", "bc", "c+(", "é\U0001F600", "tab\there", "a-]^\\", "q" * 3000]
    rules = [A.Rule(f"r{k}", "B1", "Low", re.escape(t), "e", "f") for k, t in enumerate(texts)]
    df = spark.createDataFrame([("xabcx",), ("bc+(",), ("abé\U0001F600",), ("no\ttab\there",),
                                ("za-]^\\z",), ("q" * 3001,), ("",)], "t string")
    got = [r.k for r in df.select(A.candidate_rules(F.col("t"), rules).alias("k")).collect()]
    assert got == [[k for k, t in enumerate(texts) if t in r.t] for r in df.collect()]


def test_the_text_is_searched_once_however_many_rules(spark):
    df = spark.createDataFrame([("a",)], "t string")
    for n in (50, 500):
        plan = df.select(A.candidate_rules(F.col("t"), _rules(n)).alias("k"))._jdf.queryExecution() \
            .optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1
