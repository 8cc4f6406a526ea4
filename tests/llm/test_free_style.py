"""Classifier, secrets, PII and the three dedup operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from helpers_llm import ODD, ascii_lower, words
from quarry.llm import components as C
from quarry.llm import line_dedup as L
from quarry.llm import pii as P
from quarry.llm import quality_classifier as Q
from quarry.llm import secrets as S
from quarry.llm import sentence_dedup as T
from quarry.llm import simhash as H
from quarry.llm.names import window_names

# ---------------------------------------------------------------- classifier


def _labelled(n, seed):
    rnd = random.Random(seed)
    good = [f"g{i}" for i in range(60)] + ["the", "of", "and"] * 5
    bad = [f"b{i}" for i in range(60)] + ["|", "###"] * 5
    rows, labels = [], []
    for i in range(n):
        q = rnd.random() < 0.6
        rows.append((i, " ".join(rnd.choice(good if q else bad) for _ in range(40))))
        labels.append((i, int(q), 0))
    return rows, labels


def test_classifier_held_out_accuracy(make_docs, spark):
    rows, labels = _labelled(400, 1)
    labels += [(0, None, 0), (None, 1, 0), (1, 7, 0), (5, labels[5][1], 0)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = make_docs([*rows, *((10_000 + (d or 0), t) for d, t in ODD), (None, "x y")], clashing=True)
    got = Q.classify(docs, lab)
    assert [c for c, _ in got.dtypes] == ["doc_id", "held_out", "score", "predicted"]
    out = got.collect()
    assert len(out) == len(rows) + len(ODD) + 1
    truth = {d: q for d, q, _ in labels[:400]}
    held = [r for r in out if r.doc_id in truth and r.held_out]
    assert 80 < len(held) < 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    import zlib
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
               for r in out if r.doc_id is not None)


def test_classifier_never_reads_held_out_labels(make_docs, spark):
    rows, labels = _labelled(300, 2)
    ddl = "doc_id bigint, quality int, toxic int"
    import zlib
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    flipped = [(d, 1 - q if held(d) else q, t) for d, q, t in labels]
    docs = make_docs(rows)
    a = Q.classify(docs, spark.createDataFrame(labels, ddl)).collect()
    b = Q.classify(docs, spark.createDataFrame(flipped, ddl)).collect()
    assert {r.doc_id: r.score for r in a} == {r.doc_id: r.score for r in b}


def test_classifier_without_labels_or_documents(make_docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in Q.classify(make_docs([(1, "a b"), (2, None)]), none).collect()] == [0.5] * 2
    assert Q.classify(make_docs([]), none).count() == 0


def test_contexts_and_pools_against_loops(monkeypatch):
    monkeypatch.setattr(Q, "_STEP", 7)
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 50, n) for n in (0, 1, 2, 20, 0, 33)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    ids = np.concatenate(texts).astype(np.int32)
    index = Q.index_vectors()
    sums = np.zeros((Q.VOCABULARY, Q.DIM), dtype=np.int64)
    counts = np.zeros(Q.VOCABULARY, dtype=np.int64)
    Q.add_contexts(ids, offsets, index, sums, counts)
    want = np.zeros_like(sums)
    for t in texts:
        for i in range(len(t)):
            for j in range(max(0, i - 2), min(len(t), i + 3)):
                if i != j:
                    want[t[i]] += index[t[j]]
    assert (sums == want).all() and counts.sum() == len(ids)
    vec = rng.normal(size=(Q.VOCABULARY, Q.DIM + 1)).astype(np.float32)
    vec[:, -1] = 1
    got = Q.pool(ids, offsets, vec)
    for g, t in zip(got, texts, strict=True):
        assert np.allclose(g, vec[t, :-1].mean(0) if len(t) else 0, atol=1e-5)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, Q.DIM))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    check = np.arange(600) % 5 == 0
    net = Q.Network(x, y, check)
    s = net.logit(x[check]) * net.temperature
    loss = lambda t: np.mean(np.logaddexp(0, s / t) - y[check] * s / t)
    assert loss(net.temperature) <= min(loss(1.0), loss(0.5), loss(2.0)) + 1e-9


# ------------------------------------------------------------------- secrets

_KEYWORD = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)")


def _secret_base(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in _KEYWORD.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], S.BASE_KINDS.index(s[0])))


def _text_of(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_secret_base_spans_on_random_text():
    rnd = random.Random(2)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "=", ":", " ", '"', "'",
             "AKIA", "ABCDEFGH1234", "a1b2c3d4", "0f" * 16, "x", "é", "ſecret", "Key", "abc=", "\n"]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [s[:3] for s in S.base_spans(t)] == _secret_base(t), t


def test_secrets_by_ownership(make_docs):
    example = "ghp_" + "A1b2C3d4E5" * 4
    own = "ghp_" + "Zx9Yw8Vu7Ts6" * 3 + "q1"
    rows = [(i, f"use {example} here", f"owner{i % 4}") for i in range(8)]
    rows += [(50, f"mine {own}", "owner1"), (51, f"again {own}", "owner1"),
             (52, 'password = "hunter2hunter2"', None), (53, "token: short", "o")]
    rows += [(d, t, "odd") for d, t in ODD]
    got = S.find_secrets(make_docs(rows, clashing=True)).collect()
    assert len(got) == len(rows)
    base = {(d, t): _text_of(_secret_base(t)) for d, t, _ in rows}
    assert Counter((r.doc_id, r.base_sha256) for r in got) == Counter(
        (d, hashlib.sha256(base[d, t].encode()).hexdigest()) for d, t, _ in rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].spans == "" and by[0].n_copied == 1  # a widely copied example
    assert by[50].spans == f"github:5:{5 + len(own)}" and by[50].n_live == 1
    assert by[52].n_assign == 1 and by[52].spans == base[52, rows[10][1]]
    assert by[53].n_assign == 0
    assert S.find_secrets(make_docs([])).count() == 0


def test_secret_blocks_that_a_base_span_only_touches(make_docs):
    body = "MIIEpAIBAAKCAQEA7bq9" * 4
    head = "-----BEGIN RSA PRIVATE KEY-----"
    text = f'secret: "{head}\n{body}\n-----END'
    base = S.base_spans(text)
    assert [x[0] for x in base] == ["assign"]
    (kind, start, end, value), = S.extra_spans(text, base)
    assert (kind, start, value) == ("key_block", 9, f"\n{body}\n") and text[start:end] == head + value
    token = "token=ghp_" + "A1b2C3d4E5" * 4
    assert S.extra_spans(token, S.base_spans(token)) == []  # one base span holds it whole
    by = {r.doc_id: r for r in S.find_secrets(make_docs([(1, text, "o")])).collect()}
    assert by[1].spans == f"assign:0:{base[0][2]},key_block:9:{end}" and by[1].n_live == 1


# ----------------------------------------------------------------------- PII

_CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _pii_base(text):
    ok = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(P._digits(m)) <= 19 and P.luhn(P._digits(m)),
        "phone": lambda m: 8 <= len(P._digits(m)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in _CONTRACT.items()
            for m in re.finditer(p, text or "") if ok[k](m[0])]


def test_pii_base_spans_on_random_text():
    rnd = random.Random(1)
    for alphabet in ("a@.-%1234+ (0)9é", "0123456789 -", "a.@1"):
        for _ in range(8_000):
            t = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
            assert P.detect(t) == _pii_base(t), t


@pytest.mark.parametrize("text,shown", [
    ("mail john [at] acme [dot] com now", "john [at] acme [dot] com"),
    ("jane at example dot org", "jane at example dot org"),
    ("to jоhn@асme.com", "jоhn@асme.com"),
    ("user(at)site.com", "user(at)site.com"),
    ("tel +１ (２０２) ５５５-０１７７.", "+１ (２０２) ５５５-０１７７"),
    ("call plus four two zero five five five one two three four now",
     "plus four two zero five five five one two three four"),
])
def test_pii_disguises_map_back_to_source(text, shown):
    assert P.detect(text) == []
    assert [text[s:e] for _, s, e in P.hidden_spans(text, [])] == [shown]


def test_pii_leaves_prose_alone():
    for t in ("we met at noon dot", "one two three four", "look at the dot com boom",
              "at home", "a (at) b", "Кириллица без адресов"):
        assert P.hidden_spans(t, P.detect(t)) == [], t


@pytest.mark.parametrize("text", ["j\u043ehn@example.com", "john@mail.ex\u0430mple.com"])
def test_pii_disguises_with_a_partial_plain_match(text):
    base = P.detect(text)
    assert len(base) == 1 and P.hidden_spans(text, base) == [("email", 0, len(text))]
    assert P.hidden_spans(text + " \u0430", [("email", 0, len(text))]) == []


@pytest.mark.parametrize("text,shown", [
    ("İstanbul: anna [at] firma [dot] de", "anna [at] firma [dot] de"),
    ("İzmir, jane at example dot org", "jane at example dot org"),
    ("call +four nine one two three four five six.", "+four nine one two three four five six"),
    ("call +four nİne one two three four fıve ſix.", "+four nİne one two three four fıve ſix"),
])
def test_pii_disguises_beside_other_characters(text, shown):
    assert [text[s:e] for _, s, e in P.hidden_spans(text, P.detect(text))] == [shown]


@pytest.mark.parametrize("text,kind,shown", [
    ("name at firma dot ch", "email", "name at firma dot ch"),
    ("ask anna at mail dot firma dot it!", "email", "anna at mail dot firma dot it"),
    ("jane at example.org", "email", "jane at example.org"),
    ("please mail jane.doe at example.org.", "email", "jane.doe at example.org"),
    ("see jane at example[.]org now", "email", "jane at example[.]org"),
    ("to user[@]site[.]com today", "email", "user[@]site[.]com"),
    ("anna (at) firma dot de", "email", "anna (at) firma dot de"),
    ("anna@firma dot nl", "email", "anna@firma dot nl"),
    ("host 192[.]168[.]0[.]1 is up", "ip", "192[.]168[.]0[.]1"),
    ("at one nine two dot one six eight dot zero dot one.", "ip",
     "one nine two dot one six eight dot zero dot one"),
    ("tel +49 30 one two three four five six, thanks", "phone", "+49 30 one two three four five six"),
    ("+ four nine, three zero, 123 four five", "phone", "+ four nine, three zero, 123 four five"),
    ("4111 1111 1111 one one one one", "card", "4111 1111 1111 one one one one"),
])
def test_pii_mixed_disguises(text, kind, shown):
    got = P.hidden_spans(text, P.detect(text))
    assert (kind, text.index(shown), text.index(shown) + len(shown)) in got, got


@pytest.mark.parametrize("text", [
    "look at example.org", "docs are available at docs.example.com/start", "He lives at home. So",
    "meet us at example.org", "we hosted it at github.com", "one of two dot three", "f[.]x(at)",
    "un chat, deux chiens, trois oiseaux en 2020", "one 2 three 4 five", "look at the dot com boom",
    "at noon dot we left", "chapters one, two and three of 12345678"])
def test_pii_leaves_more_prose_alone(text):
    assert P.hidden_spans(text, P.detect(text)) == []


def test_pii_offsets_equal_lists_of_ranges():
    rnd = random.Random(2)
    for _ in range(2_000):
        text = "".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 30)))
        cuts = sorted(rnd.sample(range(len(text) + 1), min(len(text), rnd.randint(0, 4) * 2) // 2 * 2))
        edits = [(s, e, rnd.choice(["", "X", "YZ"])) for s, e in zip(cuts[::2], cuts[1::2], strict=True)]
        want, at = [], 0
        for s, e, new in [*edits, (len(text), len(text), "")]:
            want += [(text[i], i, i + 1) for i in range(at, s)] + [(c, s, e) for c in new]
            at = e
        got, offsets = P.transduce(text, edits), P.Offsets(edits)
        assert [(c, *offsets.source(i)) for i, c in enumerate(got)] == want


def test_pii_long_text_needs_little_beside_it():
    import tracemalloc
    text = "plain words here \u2013 and \u2013 there. " * 50_000 + "jane at mail dot org"
    tracemalloc.start()
    got = P.hidden_spans(text, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [("email", len(text) - 20, len(text))] and peak < 30 * len(text)


def test_pii_query_rows(make_docs):
    rows = [*ODD, (40, "a@b.co 1.2.3.4 4111 1111 1111 1111 +1 (202) 555-0177"), (40, "x [at] y.de"),
            (41, "a" * 200_000 + "@"), (42, "1" * 100_000), (43, "+" + "1 " * 50_000)]
    got = P.find_pii(make_docs(rows, clashing=True)).collect()
    want = []
    for d, t in rows:
        base = _pii_base(t) if len(t or "") < 90_000 else []
        n = Counter(k for k, _, _ in base)
        want.append((d, *(n[k] for k in P.KINDS),
                     hashlib.sha256(_text_of(base).encode()).hexdigest()))
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256)
                   for r in got) == Counter(want)
    assert "email:0:11" in {r.spans for r in got if r.doc_id == 40}
    assert P.find_pii(make_docs([])).count() == 0


# ------------------------------------------------------------------- SimHash


def _fingerprint(text):
    w = words(ascii_lower(text))
    runs = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_bit_sliced_pairs():
    rng = np.random.default_rng(0)
    f = []
    for x in map(int, rng.integers(0, 2 ** 63, 30, dtype=np.uint64)):
        for _ in range(20):
            x ^= 1 << int(rng.integers(64))
            f.append(x)
    f = np.unique(np.array([*f, 0, 1, 2 ** 64 - 1], dtype=np.uint64))
    for radius in (0, 1, 2, 5):
        p, q = H.near_pairs(f, radius, tile=100)
        want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f))
                if bin(int(f[i]) ^ int(f[j])).count("1") <= radius}
        assert set(zip(p.tolist(), q.tolist(), strict=True)) == want


@pytest.mark.parametrize("block_rows", [H.BLOCK_ROWS, 2])
def test_fingerprint_links_are_complete(spark, block_rows):
    rng = np.random.default_rng(4)
    f = set()
    for x in map(int, rng.integers(0, 2 ** 63, 12, dtype=np.uint64)):
        for _ in range(25):
            x ^= 1 << int(rng.integers(64)) if rng.random() < 0.5 else 3 << int(rng.integers(62))
            f.add(x if x < 1 << 63 else x - (1 << 64))
    f = sorted(f)
    nodes = spark.createDataFrame([(x,) for x in f], "fp bigint")
    links = [(r.a, r.b) for r in H.links(nodes, 2, block_rows).collect()]
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2
    want = [(a, b) for i, a in enumerate(f) for b in f[i + 1:] if near(a, b)]
    assert _components(f, links) == _components(f, want)
    assert len(links) <= 36 * len(f)


def test_simhash_against_brute_force(make_docs):
    rnd = random.Random(8)
    text = [" ".join(rnd.choice("abcdefgh") * 3 for _ in range(200)) for _ in range(6)]
    rows = [*ODD]
    for i in range(40):
        w = text[i % 6].split()
        if i % 4:
            w[rnd.randrange(len(w))] = "changed"
        rows.append((100 + i, " ".join(w)))
    got = H.near_duplicates(make_docs(rows, clashing=True)).collect()
    prints = {_fingerprint(t) for _, t in rows}
    comp = _components(prints, [(a, b) for a in prints for b in prints
                                if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for d, t in rows:
        if d is not None:
            c = comp[_fingerprint(t)]
            least[c] = min(least.get(c, d), d)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == Counter(
        (d, _fingerprint(t), least.get(comp[_fingerprint(t)])) for d, t in rows)
    docs = make_docs(rows, clashing=True)
    one = H.one_of_each(docs)
    assert one.columns == docs.columns
    assert one.count() == len(set(comp.values()))
    assert H.near_duplicates(make_docs([])).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 50 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.root for r in C.connected_components(
        spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 1 for i in (1, *range(50, 80))}


# --------------------------------------------------------------- line dedup


def _line_runs(rows, least):
    """(copy, covered line numbers) of each row in corpus order; rows are sorted."""
    seen, texts, out = {}, set(), []
    for place, (_, t) in enumerate(rows):
        lines = [(i, x) for i, x in enumerate((t or "").split("\n")) if words(x)]
        n = (t or "").count("\n") + 1
        if sum(len(x) for _, x in lines) >= least:
            if t in texts:
                out.append((True, set(range(n))))
                continue
            texts.add(t)
        gone = set()
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                seen.setdefault(tuple(x for _, x in lines[i:j]), (place, i))
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                k = tuple(x for _, x in lines[i:j])
                if seen[k] < (place, i) and sum(map(len, k)) >= least:
                    gone |= set(range(lines[i][0], lines[j - 1][0] + 1))
        out.append((False, gone))
    return out


def _random_lines(seed):
    rnd = random.Random(seed)
    pool = [f"line {i} " + "x" * rnd.randint(0, 40) for i in range(12)] + ["", "  "]
    run = "\n".join(rnd.sample(pool, 5))
    return [(i, "\n".join([rnd.choice(pool) for _ in range(rnd.randint(0, 6))]
                          + [run] * (i % 3 == 0)
                          + [f"own {i} {rnd.random()}" for _ in range(rnd.randint(0, 2))]))
            for i in range(40)]


def _numbers(text):
    return {k for part in (text or "").split(",") if part
            for k in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}


def test_line_dedup_against_brute_force(make_docs, spark, monkeypatch):
    rows = sorted([*_random_lines(6), (100, "long " * 3000), (101, "long " * 3000), (102, None),
                   (103, ""), (104, "short"), (105, "short")])
    want = _line_runs(rows, L.MIN_CHARS)
    monkeypatch.setattr(L, "table", lambda *a: make_docs(rows, clashing=True))
    got = {r.doc_id: r for r in L.query(spark, "")  .collect()}
    assert len(got) == len(rows)
    for (d, _), (copy, gone) in zip(rows, want, strict=True):
        assert (got[d].copy, _numbers(got[d].removed)) == (copy, gone), d
        assert got[d].n_removed == len(gone)
    docs = make_docs(rows, clashing=True)
    out = L.dedup_lines(docs)
    assert out.columns == docs.columns
    have = {r.doc_id: r.text for r in out.collect()}
    for (d, t), (copy, gone) in zip(rows, want, strict=True):
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
        if gone and not words(left):
            assert d not in have
        else:
            assert have[d] == (left if gone else t)


def test_line_dedup_of_repeated_rows_and_nothing(make_docs):
    t = "a line of text that is long enough to count as a run of its own"
    out = L.dedup_lines(make_docs([(1, t), (1, t), (None, t), (2, t + "!"), (3, None), (3, None)]))
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [
        (1, t), (2, t + "!"), (3, ""), (3, "")]
    assert L.dedup_lines(make_docs([])).count() == 0


def test_line_dedup_keeps_short_runs_below_a_bound(make_docs):
    rows = sorted(_random_lines(8))
    for least in (20, 60):
        want = _line_runs(rows, least)
        _, firsts = L.later_copies(make_docs(rows), least)
        got = {r.doc_id: {k for x in r.runs or [] for k in range(x["first"], x["last"] + 1)}
               for r in firsts.collect()}
        for (d, t), (copy, gone) in zip(rows, want, strict=True):
            if not copy and d in got:
                assert got[d] == gone, (least, d)


def test_line_dedup_keeps_the_same_of_equal_rows(spark):
    docs = spark.createDataFrame(
        [(1, "one line", s) for s in "dacb"] + [(2, "two", None)],
        "doc_id long, text string, source string")
    a = sorted(map(str, L.dedup_lines(docs.repartition(4, "source")).collect()))
    assert a == sorted(map(str, L.dedup_lines(docs.coalesce(1).orderBy("source")).collect()))
    assert len(a) == 2


# ------------------------------------------------------------- suffix array


def _sequences(kind):
    rng = random.Random(kind)
    if kind == 0:   # one item over and over, and long copies
        return [[7] * 40, [7] * 23, [1, 2, 3] * 9, [1, 2, 3] * 8 + [4], [5], [7]]
    if kind == 1:   # a hot item among others
        return [[rng.choice([0, 0, 0, i]) for i in range(rng.randint(1, 30))] for _ in range(40)]
    run = [rng.randint(0, 9) for _ in range(37)]
    return [[rng.randint(0, 4) for _ in range(rng.randint(0, 8))] + run[rng.randint(0, 20):]
            for _ in range(30)]


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_suffix_array_prefixes_and_earlier_copies(spark, kind):
    from quarry.llm import suffixes as X
    seqs, rows, at = _sequences(kind), [], 0
    for s in seqs:
        rows += [(at + i, at, int(x), 0) for i, x in enumerate(s)]
        at += len(s)
    count = {}
    for r in rows:
        count[r[2]] = count.get(r[2], 0) + 1
    suffix, seg = {}, []      # what is left of each segment of items that occur again
    for i, (p, d, a, _) in reversed(list(enumerate(rows))):
        joined = i + 1 < len(rows) and rows[i + 1][1] == d
        seg = [] if count[a] == 1 else [a, *(seg if joined else [])]
        if seg:
            suffix[p] = tuple(seg)
    t = X.Tables(spark)
    first = X.first_ranks(t, spark.createDataFrame(rows, "p long, d long, a long, b long"))
    ranks, splits = X.doubled(t, first)
    array = X.common_prefixes(t, ranks, splits)
    got = sorted((r.idx, r.p, r.l) for r in array.collect())
    want = sorted(suffix, key=lambda p: (suffix[p], p))
    assert [g[0] for g in got] == list(range(len(want)))
    assert [g[1] for g in got] == want

    def common(x, y):
        return next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b),
                    min(len(x), len(y)))
    for (_, q, _), (_, p, n) in zip(got, got[1:], strict=False):
        assert n == common(suffix[q], suffix[p])
    longest = {p: max((common(suffix[p], suffix[q]) for q in suffix if q < p), default=0)
               for p in suffix}
    for bits in (2, 4, 16):     # blocks of 4 and 16 places, and one for all
        have = {r.p: r.n for r in X.earlier(t, array, bits).collect()}
        assert have == {p: n for p, n in longest.items() if n}
    t.remove()


def test_suffix_array_of_long_runs_in_few_jobs(spark):
    """Runs of over 16 * 16 items, ranges whose edges cut groups and keys, and no job more for
    each doubling of the longest run: jobs and plans are what fills the driver's memory."""
    from quarry.llm import suffixes as X
    rng = random.Random(11)
    run = [rng.randint(4, 300) for _ in range(600)]
    seqs = [run, run[5:] + [1000], run[100:590], [3] * 330, [3] * 310 + run[:50], [1001],
            run[:300] + [1001] + run[300:], [3] * 310]
    rows, suffix = [], {}
    for s in seqs:
        rows += [(len(rows) + i, len(rows), x, 0) for i, x in enumerate(s)]
    count = Counter(r[2] for r in rows)
    for i, (p, d, a, _) in reversed(list(enumerate(rows))):
        joined = i + 1 < len(rows) and rows[i + 1][1] == d and count[rows[i + 1][2]] > 1
        if count[a] > 1:
            suffix[p] = (a, *(suffix[p + 1] if joined else ()))
    held = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "9"}
    former = {k: spark.conf.get(k) for k in held}
    t, sc = X.Tables(spark), spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setJobGroup("long-runs", "")
        first = X.first_ranks(t, spark.createDataFrame(rows, "p long, d long, a long, b long"))
        array = X.common_prefixes(t, *X.doubled(t, first))
        got = sorted((r.idx, r.p, r.l) for r in array.collect())
        have = {r.p: r.n for r in X.earlier(t, array, 6).collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("long-runs"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in former.items():
            spark.conf.set(k, v)
        t.remove()
    want = sorted(suffix, key=lambda p: (suffix[p], p))
    assert [g[1] for g in got] == want

    def common(x, y):
        return next((i for i, (a, b) in enumerate(zip(x, y, strict=False)) if a != b),
                    min(len(x), len(y)))
    shared = np.array([0, *(common(suffix[q], suffix[p])
                            for q, p in zip(want, want[1:], strict=False))])
    assert [g[2] for g in got] == shared.tolist()
    place, longest = np.array(want), {}
    for i, p in enumerate(want):
        after = np.minimum.accumulate(shared[i + 1:])[place[i + 1:] < p]
        before = np.minimum.accumulate(shared[i:0:-1])[place[:i][::-1] < p]
        longest[p] = max([0, *after[:1].tolist(), *before[:1].tolist()])
    assert have == {p: n for p, n in longest.items() if n}
    assert jobs < 90


def test_window_names_by_doubling():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 3, 300).astype(np.uint64)
    start = np.repeat(np.arange(250), 8)
    end = start + np.tile(np.array([1, 2, 3, 5, 8, 13, 31, 50]), 250)
    names = window_names(ids, start, end, 7)
    by = {}
    for s, e, n in zip(start, end, names, strict=True):
        by.setdefault(int(n), set()).add(tuple(ids[s:e].tolist()))
    assert all(len(v) == 1 for v in by.values())
    assert len(by) == len({tuple(ids[s:e].tolist()) for s, e in zip(start, end, strict=True)})


# ------------------------------------------------------------ sentence dedup


def _spans(rows):
    seen, out = {}, []
    for place, (_, t) in enumerate(rows):
        s = T.sentences(t or "")
        n = lambda i, j: sum(x[3] for x in s[i:j])  # noqa: E731, B023
        mine = set()
        for i in range(len(s)):
            mine |= {(i, j) for j in [next((j for j in range(i + T.SENTENCES, len(s) + 1)
                                            if n(i, j) >= T.MIN_WORDS), None)] if j}
        for j in range(1, len(s) + 1):
            mine |= {(i, j) for i in [next((i for i in range(j - T.SENTENCES, -1, -1)
                                            if n(i, j) >= T.MIN_WORDS), None)] if i is not None}
        gone = set()
        for i, j in sorted(mine):
            k = tuple(x[2] for x in s[i:j])
            if seen.setdefault(k, (place, i)) != (place, i):
                gone |= set(range(i, j))
        out.append((s, gone))
    return out


def test_sentence_spans_against_brute_force(make_docs):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice(["ka", "lo", "mi", "nu"]) for _ in range(rnd.randint(1, 9))) + "."
            for _ in range(30)]
    shared = " ".join(f"passage{i}" for i in range(60))
    rows = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25)))) for i in range(30)]
    rows += [(50, f"Intro here. {shared}. End"), (51, f"{shared}"), (52, f"Other {shared} tail"),
             (53, None), (54, ""), (55, "One. Two. Three."), (56, "One. Two. Three.")]
    got = {r.doc_id: r for r in T.repeated_spans(make_docs(rows, clashing=True)).collect()}
    want = _spans(rows)
    assert set(got) == {d for (d, _), (_, gone) in zip(rows, want, strict=True) if gone}
    assert {51, 52} <= set(got) and not {50, 55, 56} & set(got)
    for (d, _), (s, gone) in zip(rows, want, strict=True):
        if gone:
            covered = {k for lo, hi in got[d].spans for k in range(lo, hi)}
            assert got[d].n_sentences == len(gone)
            assert {i for i, x in enumerate(s) if x[0] in covered} == gone
    out = {r.doc_id: r.text for r in T.remove_repeated(make_docs(rows, clashing=True)).collect()}
    assert len(out) == len(rows) and out[50] == rows[30][1] and out[53] is None
    assert len(words(out[51])) < 12


def test_sentence_spans_of_repeated_rows_and_nothing(make_docs):
    t = "The first one says this here now. The second says that there then. A third ends it all."
    got = T.repeated_spans(make_docs([(1, t), (1, t), (None, t)])).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1]
    assert all(set(r.others) == {1} for r in got)
    out = T.remove_repeated(make_docs([(1, t), (1, t), (None, t)]))
    assert sorted(r.text for r in out.collect())[-1] == t
    assert T.repeated_spans(make_docs([])).count() == 0


def test_sentence_spans_reach_the_end_of_a_passage(make_docs):
    shared = "One two three four five six seven eight. Nine ten eleven twelve more and more yet. " \
             "Again there are eight words in this one. Three words here."
    rows = [(1, f"{shared} First text goes on with its own words. So."),
            (2, f"{shared} Second one differs from there on in every word. Yes."), (3, shared)]
    got = {r.doc_id: r for r in T.repeated_spans(make_docs(rows)).collect()}
    assert [(r.n_sentences, list(map(tuple, r.spans))) for r in (got[2], got[3])] == [
        (4, [(0, len(shared))])] * 2


def _runs_of(text):
    s = T.sentences(text)
    n = np.array([x[3] for x in s], dtype=np.int64)
    _, start, end = T.runs(n, np.array([0, len(s)]))
    return {tuple(x[2] for x in s[i:j]) for i, j in zip(start, end, strict=True)}


def test_passages_meet_in_any_surroundings():
    rnd = random.Random(6)
    say = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    for _ in range(500):
        shared = say(51)
        a, b = (f"{say(rnd.randint(0, 40))} {shared} {say(rnd.randint(0, 40))}" for _ in "ab")
        assert _runs_of(a) & _runs_of(b), shared


@pytest.mark.parametrize("stop", ["。", "", "，"])
def test_passages_in_scripts_without_spaces(make_docs, stop):
    rnd = random.Random(7)
    say = lambda n: "".join(chr(rnd.randint(0x4E00, 0x9000)) for _ in range(n))
    shared = stop.join(say(8) for _ in range(8)) + stop
    rows = [(1, say(30) + shared + say(30)), (2, say(41) + shared + say(7)), (3, say(80))]
    got = T.repeated_spans(make_docs(rows)).collect()
    assert [r.doc_id for r in got] == [2]
    (lo, hi), = got[0].spans
    assert 41 <= lo and hi <= 41 + len(shared) and hi - lo > len(shared) / 2
