"""Quality rules, URL filter, decontamination and mixing against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest

from helpers_llm import ODD, ascii_lower, words
from quarry.llm import decontaminate as D
from quarry.llm import mixing as M
from quarry.llm import quality_rules as Q
from quarry.llm import url_filter as U


def _base_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if c[g] > 1 for k in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text),
            len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n)


GOOD = " ".join(f"the word{i} of" for i in range(40))


def test_quality_rules_against_brute_force(make_docs):
    rnd = random.Random(3)
    rows = [*ODD, (20, GOOD), (21, "# " * 100), (22, "a\na\nb\n" * 30),
            *((100 + i, " ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))))
              for i in range(40))]
    got = Q.quality_rules(make_docs(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    want = Counter((d, *_base_counts(t)) for d, t in rows)
    have = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words, r.base_failed) for r in got)
    assert have == want
    kept = {r.doc_id for r in got if r.kept}
    assert 20 in kept and 21 not in kept
    assert not any(r.kept for r in got if r.base_failed)


def test_quality_stage_keeps_columns_and_rows(make_docs, spark):
    docs = make_docs([(1, GOOD), (1, GOOD), (2, "short"), (None, GOOD)], clashing=True)
    kept = Q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1]
    assert Q.kept_documents(make_docs([])).count() == 0


def test_quality_rules_run_without_python_or_shuffle(make_docs):
    plan = Q.quality_rules(make_docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x#y", "http://x.com/fr/",
        "http://x.com/de/3", "http://com/de/", "ftp://notcom/de/", "no scheme", None, "",
        "http://spam-farm.example.net", "http://ok.example.net?q=/x", "http://ok.net#a://b",
        "://", "http://spam.example.org/de/1", "http://É.ORG/a", "http://ok.net/" + "p" * 9000]


def _url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host))
            and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.text), default=None)
    listed = any(t in host for t in U.LISTED_TERMS)
    return host, path, rule and rule.text, rule.verdict if rule else "block" if listed else "allow"


def _pages(spark, urls):
    return spark.createDataFrame([(i // 2, u, "x", "clash") for i, u in enumerate(urls)],
                                 "page_id bigint, url string, html string, host string")


@pytest.mark.parametrize("block_hosts", [U.BLOCK_HOSTS, 5])
def test_url_filter_against_brute_force(spark, block_hosts):
    rnd = random.Random(5)
    urls = [*URLS, *(f"http://{rnd.choice(['spam', 'good', 'casino', 'site'])}{i}.net/{i}"
                     for i in range(400))]
    got = U.judge(_pages(spark, urls), block_hosts=block_hosts).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter(
        (i // 2, *_url(u)) for i, u in enumerate(urls))


def test_url_filter_of_nothing(spark):
    assert U.judge(_pages(spark, [])).count() == 0
    assert U.build_cascade(spark.createDataFrame([], "key string, listed boolean")) == []


def test_cascade_needs_more_than_one_level(spark):
    keys = spark.createDataFrame([(f"h{i}", i % 3 == 0) for i in range(3000)],
                                 "key string, listed boolean")
    levels = U.build_cascade(keys)
    assert len(levels) > 2
    wrong = keys.where(U.listed_by(levels, keys["key"]) != keys["listed"])
    assert wrong.count() == 0
    assert sum(x.m for x in levels) < 12 * 3000


def _tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def _decontaminate(docs, items):
    windows = {}
    for i, t in items:
        w = _tokens(t)
        n = min(len(w), 13)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = _tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    ids |= {str(x) for x in windows[g] if x is not None}
        text = ",".join(sorted(ids))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(text.encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


PASSAGE = " ".join(f"w{i}" for i in range(30))
ITEMS = [(1, PASSAGE), (2, PASSAGE), (3, "only three words"), (4, None), (5, ""), (6, "?!"),
         (10, "É" + PASSAGE), (None, "nobody owns this"), (3, "second text of three")]
CASES = [*ODD, (30, "start " + PASSAGE.upper() + " end"), (31, "w1-w2," + PASSAGE[9:]),
         (32, "it has only, three... WORDS in " + "it " * 200), (33, PASSAGE + " " + PASSAGE),
         (34, "nobody owns this"), (35, " ".join(PASSAGE.split()[:12]))]


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 1500])
def test_decontamination_against_brute_force(make_docs, spark, block_bytes):
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS],
                                  "item_id bigint, text string, items string")
    docs = make_docs(CASES, clashing=True)
    got = D.judge(docs, items, block_bytes=block_bytes).collect()
    have = Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(
        ",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), r.contaminated) for r in got)
    assert have == _decontaminate(CASES, ITEMS)
    clean = D.clean_documents(docs, items)
    assert clean.columns == docs.columns
    bad = {d for d, *_, c in _decontaminate(CASES, ITEMS) if c}
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(
        d or 0 for d, _ in CASES if d not in bad)


def test_decontamination_of_nothing(make_docs, spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert [r.n_hit for r in D.judge(make_docs([(1, "a b")]), none).collect()] == [0]
    some = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert D.judge(make_docs([]), some).count() == 0


def _targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mixing_meets_targets(make_docs):
    rnd = random.Random(11)
    rows = [(d, t, "s9") for d, t in ODD]
    for i in range(300):
        source = rnd.choice(["s0", "s0", "s0", "S1", "é", None, "s10"])
        rows.append((1000 + i, "w " * rnd.randint(0, 300), source))
    docs = make_docs(rows, clashing=True)
    got = M.mix(docs, shard_words=5000).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = _targets(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= 32 + 0.01 * want[s]
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    again = M.mix(docs.repartition(3), shard_words=5000).collect()
    assert Counter(again) == Counter(got)


def test_highest_quotients(spark):
    votes = [53, 24, 23, 1, 0]
    p = spark.createDataFrame([("g", str(i), float(v), 13) for i, v in enumerate(votes)],
                              "g string, p string, votes double, seats bigint")
    got = {r.p: r.won for r in M.apportion(p, ["g"], ["p"], "votes", "seats", "won").collect()}
    seats = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(votes) for k in range(13)))[:13]
    assert got == {str(i): sum(x == i for _, x in seats) for i in range(5)}


def test_mixing_of_nothing(make_docs):
    assert M.mix(make_docs([])).count() == 0
    assert [r.taken for r in M.mix(make_docs([(1, None), (2, "")])).collect()] == [0, 0]


def test_native_operators_run_without_python(make_docs, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    docs = make_docs([(1, "a b c")])
    for df in (D.judge(docs, items), M.mix(docs), U.judge(_pages(spark, URLS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
