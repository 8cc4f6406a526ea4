"""Filter audit and source divergence against brute force; the toxicity classifier."""

import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from helpers_llm import ODD, ascii_lower, words
from quarry.llm import filter_audit as A
from quarry.llm import source_divergence as S
from quarry.llm import terms as TM
from quarry.llm import toxicity as T

LABELS = "doc_id bigint, quality int, toxic int"


# -- filter audit -----------------------------------------------------------------------

def _fails(text):
    t, w = text or "", words(text)
    return {x for x, c in (("A", len(w) < 100), ("B", 100 * len(set(w)) < 80 * len(w)),
                           ("C", 100 * len(re.findall("[A-Z]", t)) > 10 * len(t)),
                           ("D", re.search(r"[#$%&*|]", t))) if c}


def _audit(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    docs = []
    for doc_id, text, lang in rows:
        f = _fails(text)
        if doc_id is not None and any(i is not None and i < doc_id and (t or "") == (text or "")
                                      for i, t, _ in rows):
            f.add("E")
        docs.append((doc_id, lang or "", f))
    out = {}
    for part in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[2]]
                left = [d for d in left if x not in d[2]]
                shapley[x] += len(gone)
                failing = [d for d in mine if x in d[2]]
                out[part, "".join(order), step] = (
                    len(left), len(gone), len(failing) - len(gone),
                    sum(d[2] == {x} for d in mine), sum(d[0] in good for d in gone),
                    sum(d[0] in toxic for d in gone))
        for (p, order, step), v in list(out.items()):
            if p == part:
                out[p, order, step] = (*v[:6], shapley[order[step - 1]])
    return out


def test_filter_audit_against_every_order(make_docs, spark):
    rnd = random.Random(5)
    rows = [(i, t, rnd.choice(["en", "de", "", None])) for i, t in ODD]
    pool = [" ".join(rnd.choice(["alpha", "BETA", "g#", "d e f", f"w{k}"])
                     for k in range(rnd.choice([3, 90, 130]))) for _ in range(12)]
    rows += [(100 + i, rnd.choice(pool), rnd.choice(["en", "de"])) for i in range(60)]
    rows += [(100, pool[0], "en"), (None, pool[0], None)]
    labels = [(100 + i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i in range(60)]
    labels += [(100, 1, None), (100, 0, 1), (None, 1, 1)]
    docs = make_docs([(i, t, "s", lang) for i, t, lang in rows], clashing=True)
    docs = docs.withColumn("mask", docs.kept).withColumn("part", docs.kept)
    letters, counts = A.masks(docs, spark.createDataFrame(labels, LABELS))
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails,
                                              r.good_lost, r.toxic_lost, r.shapley)
           for r in A.audit(counts, letters).collect()}
    assert letters == list("ABCDE")
    assert got == _audit(rows, labels)


def test_intervals_cover_each_order_of_a_mask_once():
    for mask in range(1, 16):
        seen = {}
        for step, lo, hi in A.intervals(4, mask):
            for rank in range(lo, hi):
                assert rank not in seen
                seen[rank] = step
        for rank, order in enumerate(permutations(range(4))):
            assert seen[rank] == 1 + next(i for i, f in enumerate(order) if mask >> f & 1)
    assert not list(A.intervals(4, 0))


def test_filter_audit_of_other_filters_and_empty_tables(make_docs, spark):
    labels = spark.createDataFrame([], LABELS)
    letters, counts = A.masks(make_docs([]), labels)
    assert A.audit(counts, letters).count() == 0
    docs = make_docs([(1, "x", "p"), (2, "xx", "p"), (3, "y", "q")])
    letters, counts = A.masks(docs, labels, part="source", copies=None,
                              filters=lambda t: {"L": t.rlike("xx"), "X": t.rlike("x")})
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.shapley)
           for r in A.audit(counts, letters).collect()}
    assert got == {("p", "LX", 1): (1, 1, 1), ("p", "LX", 2): (0, 1, 3),
                   ("p", "XL", 1): (0, 2, 3), ("p", "XL", 2): (0, 0, 1),
                   ("q", "LX", 1): (1, 0, 0), ("q", "LX", 2): (1, 0, 0),
                   ("q", "XL", 1): (1, 0, 0), ("q", "XL", 2): (1, 0, 0)}


# -- source divergence ------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def _divergence(rows, min_docs, top):
    docs = [(lang or "", source or "", TERM.findall(ascii_lower(text)))
            for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= min_docs)

        def prices(found):
            c = Counter(t for d in found for t in d[2] if t in set(kept))
            total = sum(c.values()) + 2 * len(kept)
            return c, {t: 1 + 10 ** 9 * (c[t] + 2) // total for t in kept}
        q = prices(mine)[1]
        by_source = {s: prices([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (c, p) in by_source.items():
            pairs = [(-sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept), o)
                     for o, (_, r) in by_source.items() if o != s]
            terms = [(-((p[t] - q[t]) ** 2 // (p[t] + q[t])), t) for t in kept
                     if c[t] and p[t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, item, -v, i) for i, (v, item) in enumerate(items, 1)
                        if part == "pair" or i <= top}
    return out


@pytest.mark.parametrize("block_terms,tile", [(1 << 16, 8), (5, 2), (1, 1)])
def test_divergence_against_brute_force(make_docs, block_terms, tile):
    rnd = random.Random(block_terms)
    vocab = ["the", "The", "é", "Éa", "漢字", "ab", "zz", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(t, rnd.choice(["en", None, ""]), rnd.choice(["s0", None])) for _, t in ODD]
    rows += [(" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12))),
              rnd.choice(["en", "de"]), f"s{min(rnd.randint(0, 9), 5)}") for _ in range(120)]
    rows += [("1 2 3", "en", "none"), ("rare", "xx", "a"), (None, "xx", "b")]
    docs = make_docs([(i, t, s, lang) for i, (t, lang, s) in enumerate(rows)], clashing=True)
    docs = docs.withColumn("term", docs.kept).withColumn("n", docs.kept)
    got = S.divergence(docs, min_docs=3, top=4, block_terms=block_terms, tile=tile).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == _divergence(rows, 3, 4)


def test_divergence_of_an_empty_table(make_docs):
    assert S.divergence(make_docs([])).count() == 0


def test_gallop_finds_what_both_hold():
    rnd = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rnd.integers(0, 3000, rnd.integers(0, 900)))
        b = np.unique(rnd.integers(0, 3000, rnd.integers(0, 40)))
        i, j = S.gallop(b, a, run=int(rnd.integers(1, 50)))
        assert b[i].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
        assert a[j].tolist() == b[i].tolist()


def test_prices_stay_exact_beyond_64_bits(spark):
    n, total, v = 9 * 10 ** 17, 7 * 10 ** 18, 10 ** 9
    row = spark.createDataFrame([(n, total, v)], "n bigint, t bigint, v bigint")
    got = row.select(S.price(row.n, row.t, row.v).alias("p")).first().p
    assert got == 1 + 10 ** 9 * (n + 2) // (total + 2 * v)


def test_terms_of_pieces_equal_the_pattern():
    rnd = random.Random(1)
    for _ in range(200):
        texts = ["".join(rnd.choice("aB é漢.1 ") for _ in range(rnd.choice([0, 1, 3, 20, 60])))
                 for _ in range(rnd.randint(0, 8))]
        raw, offsets = TM.text_bytes(pa.array([*texts, "zz"]).slice(0, len(texts)))
        got = []
        for first, r, o in TM.pieces(raw, offsets, step=rnd.choice([1, 5, 16, 1000])):
            low, starts, ends, row = TM.find_terms(r, o)
            got += [(first + int(i), t) for i, t in
                    zip(row, TM.as_strings(low, starts, ends).to_pylist())]
        assert got == [(i, t) for i, x in enumerate(texts) for t in TERM.findall(ascii_lower(x))]


# -- toxicity ---------------------------------------------------------------------------

def _features(text):
    """Features of a text by loops over its terms."""
    out = set()
    for t in TERM.findall(ascii_lower(text)):
        raw = t.encode()
        parts = [(0, raw), *((k, raw[:k]) for k in T.PREFIXES if len(raw) > k)]
        if len(raw) > T.LONG:
            parts += [(100, raw[i:i + T.GRAM]) for i in range(len(raw) - T.GRAM + 1)]
        for salt, part in parts:
            h = sum((b + 1) * pow(0x9E3779B97F4A7C15, i % 1024, 1 << 64)
                    for i, b in enumerate(part))
            h = (h + salt) * 0xBF58476D1CE4E5B9 % (1 << 64)
            h ^= h >> 29
            out.add((h * 0x94D049BB133111EB % (1 << 64)) >> (64 - T.BITS))
    return out


def test_toxicity_features_and_counts_against_loops(spark, monkeypatch):
    texts = [(t or "").lower() for _, t in ODD[:11]] + ["a long" + "漢字" * 9, "ab " * 30]
    want = Counter(f for t in texts for f in _features(t))
    got = T.document_counts(spark.createDataFrame([(t,) for t in texts], "t string"))
    assert {r.feature: r.n for r in got.collect()} == want
    monkeypatch.setattr(TM, "STEP", 7)
    monkeypatch.setattr(T, "pieces", lambda raw, offsets: TM.pieces(raw, offsets, 7))
    found = {int(k >> T.BITS): set() for keys in T.distinct_features(pa.array(texts)) for k in keys}
    for keys in T.distinct_features(pa.array(texts)):
        assert len(set(keys.tolist())) == len(keys)
        for k in keys:
            found[int(k >> T.BITS)].add(int(k & ((1 << T.BITS) - 1)))
    assert found == {i: _features(t) for i, t in enumerate(texts) if _features(t)}


def _corpus(rnd, n):
    rows, labels = [], []
    for i in range(n):
        w = [f"w{chr(97 + rnd.randint(0, 25))}{chr(97 + rnd.randint(0, 25))}"
             for _ in range(rnd.randint(20, 120))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(2):
                w[rnd.randrange(len(w))] = rnd.choice(["scum", "Idiot", "lowei" + rnd.choice("xyz")])
        rows.append((i, " ".join(w)))
        if rnd.random() < 0.5:
            labels.append((i, None, int(toxic)))
    return rows, labels


def test_toxicity_held_out_accuracy_and_odd_rows(make_docs, spark):
    rows, labels = _corpus(random.Random(4), 1500)
    odd = [(None if i is None else 10_000 + i, t) for i, t in ODD]
    flagged = labels + [(None, None, 1), (10_002, None, 7)]
    docs = make_docs(rows + odd, clashing=True)
    known = spark.createDataFrame(flagged, LABELS)
    model = T.fit(docs, known)
    got = T.scored(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    truth = dict((i, x) for i, _, x in labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_text = {}
    for r in got:
        if r.doc_id in (10_001, 10_002, 10_003, 10_008):
            by_text.setdefault(r.doc_id, set()).add(r.score)
    assert by_text[10_001] == by_text[10_002] == by_text[10_003] and len(by_text[10_008]) == 1
    again = T.fit(docs, known)
    assert np.array_equal(again.weights, model.weights) and again.bias == model.bias


def test_toxicity_learns_nothing_from_held_out_labels(make_docs, spark):
    rows, labels = _corpus(random.Random(6), 300)
    import zlib
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    docs = make_docs(rows)
    a = T.fit(docs, spark.createDataFrame(labels, LABELS))
    b = T.fit(docs, spark.createDataFrame(
        [(i, q, 1 - x if i in held else x) for i, q, x in labels], LABELS))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_toxicity_without_confirmed_rows_or_documents(make_docs, spark):
    docs = make_docs([(1, "a"), (2, None)])
    none = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert {r.predicted for r in T.scored(docs, T.fit(docs, none)).collect()} == {0}
    empty = make_docs([])
    assert T.scored(empty, T.fit(empty, spark.createDataFrame([], LABELS))).count() == 0


def test_the_risk_is_corrected_and_bounded():
    g_p, g_u = np.array([2.0, -1.0]), np.array([0.5, -0.5, 3.0])
    toxic, clean = T.risk(g_p, g_u, 0.3)
    def loss(z):
        return 1 / (1 + np.exp(z))
    assert toxic == pytest.approx(0.3 * loss(g_p).mean())
    assert clean == pytest.approx(loss(-g_u).mean() - 0.3 * loss(-g_p).mean())
