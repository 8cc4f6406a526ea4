"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at sentence ends, line ends and, in sentences of over
``LONG`` words, behind each word whose hash is the least of all words up to ``NEAR`` places
away.  So what stands around a passage moves no cut that is more than ``NEAR`` words inside
it.  In scripts without spaces a character counts as a word, and a sentence ends behind a
full stop without white space too.  Of every sentence, the shortest run of ``SENTENCES`` or more consecutive
sentences with at least ``MIN_WORDS`` words that starts at it, and the one that ends at
it, is hashed (128 bits).  A run that occurs again, later in corpus order, is a repeated
span, and the sentences that any non-first span covers are removed.

One shuffle joins the spans of the whole corpus.  Before it, each slice of a batch
compares its own spans: of equal ones only the first goes on, the others are already known
to be later ones and are only passed through, dealt by their document.  So a passage that
a third of the corpus shares sends one row a slice.  Behind the shuffle rows lie sorted by
span and place and are streamed, so a span's group is never held.  Rows are sent in the
order of their documents and with two ranges in a number each, so that they compress.

Corpus order is (doc_id, row), null ids last.  Defined results: null and empty texts have
no sentences; texts of fewer sentences or words than a run needs have no spans; of repeated
rows the first stays; other columns are ignored or carried along, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.names import window_names
from quarry.llm.text import table
from quarry.session import write_phase_table

SENTENCES, MIN_WORDS = 3, 15
#: A sentence of over LONG words is cut at the least word hashes of NEAR words to each side.
LONG, NEAR = 12, 2
_PLACES = (2, 1, 3, 0, 4)  # a word and its neighbours, NEAR to each side
#: Documents whose sentences are in a task's memory at once.
SLICE = 2000

_END = re.compile(r"(?<=[.!?…。！？])[\x20\x09-\x0D]+|\n+")
_WORD = re.compile(r"\S+")
# Scripts that are written without spaces (Thai, Lao, Burmese, Khmer, Kana,
# Han), full stops that no space follows, and what may close a sentence behind them.
_BARE = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
         "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff")
_STOPS, _CLOSE = "。！？｡", "」』”’）】》…"
_HAS_BARE = re.compile(f"[{_BARE}{_STOPS}]")
_BARE_END = re.compile(rf"{_END.pattern}|(?<=[{_STOPS}])(?=[^\s{_STOPS}{_CLOSE}])"
                       rf"|(?<=[{_STOPS}][{_CLOSE}])(?=[^\s{_STOPS}{_CLOSE}])")
_BARE_WORD = re.compile(rf"[{_BARE}][^\w\s]*|[^\s{_BARE}]+")


def sentences(text: str) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normal form, words) of each sentence of a text, ends exclusive."""
    out = []
    at = 0
    bare = not text.isascii() and bool(_HAS_BARE.search(text))
    for m in [*(_BARE_END if bare else _END).finditer(text), None]:
        end = m.start() if m else len(text)
        part = text[at:end]
        words = _BARE_WORD.findall(part) if bare else part.split()
        if len(words) > LONG:
            out += _cut(part, at, words, bare)
        elif words:
            out.append((at, end, " ".join(words).lower().encode(), len(words)))
        at = m.end() if m else end
    return out


def _cut(part: str, base: int, words: list[str], bare: bool) -> list[tuple[int, int, bytes, int]]:
    if not bare and " ".join(words) == part.strip():
        starts = list(accumulate([len(w) + 1 for w in words],
                                 initial=len(part) - len(part.lstrip())))
        stops = [x - 1 for x in starts[1:]]
    else:
        ms = list((_BARE_WORD if bare else _WORD).finditer(part))
        starts, stops = [m.start() for m in ms], [m.end() for m in ms]
    n = len(words)
    low = " ".join(words).lower().encode().split(b" ")
    edge = [1 << 32] * NEAR
    padded = [*edge, *map(xxhash.xxh32_intdigest, low), *edge]
    near = zip(*(padded[k:] for k in _PLACES), strict=False)
    out, begin = [], 0
    for end in [i for i, (h, p, q, r, s) in enumerate(near, 1)
                if h <= p and h <= q and h <= r and h <= s or i == n]:
        out.append((base + starts[begin], base + stops[end - 1], b" ".join(low[begin:end]),
                    end - begin))
        begin = end
    return out


def runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the shortest qualifying runs from and to each sentence."""
    cum = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    i = np.arange(len(words))
    end = np.maximum(np.searchsorted(cum, cum[:-1] + MIN_WORDS, side="left"), i + SENTENCES)
    ok = end <= offsets[text + 1]
    start = np.minimum(np.searchsorted(cum, cum[1:] - MIN_WORDS, side="right") - 1,
                       i + 1 - SENTENCES)
    ok2 = start >= offsets[text]
    pairs = np.unique(np.concatenate([(i[ok] << 32) | end[ok], (start[ok2] << 32) | (i[ok2] + 1)]))
    start, end = pairs >> 32, pairs & 0xFFFFFFFF
    return text[start], start, end


def _packed(start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Ranges as numbers that sort by start; texts are shorter than 2**31."""
    return pa.array((start << 32) | (end - start))


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = packed.to_numpy(zero_copy_only=False)
    start = x >> 32
    return start, start + (x & 0xFFFFFFFF)


_SPANS = ("doc_id bigint, row bigint, other bigint, known boolean, a bigint, b bigint, "
          "nth bigint, chars bigint")
_NAMES = [f.split()[0] for f in _SPANS.split(", ")]


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, row, text) -> spans, with ``nth`` the range of their sentences
    and ``chars`` of their characters; ``known`` ones repeat an earlier span of the batch,
    whose document is ``other``."""
    for b in (x.slice(lo, SLICE) for x in batches for lo in range(0, x.num_rows, SLICE)):
        none = b.column(0).is_null().to_numpy(zero_copy_only=False)
        doc = b.column(0).fill_null(0).to_numpy().astype(np.int64)
        row = b.column(1).to_numpy()
        # texts in corpus order, and so their runs
        place = np.lexsort((row, doc, none))
        none, doc, row = none[place], doc[place], row[place]
        cut = [sentences(t or "") for t in b.column(2).take(pa.array(place)).to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        flat = [s for c in cut for s in c]
        if not flat:
            continue
        los, his, forms, counts = zip(*flat, strict=True)
        lo, hi, words = (np.array(x, dtype=np.int64) for x in (los, his, counts))
        ids = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, forms)),
                            dtype=np.uint64).reshape(-1, 2).T
        text, start, end = runs(words, offsets)
        a, c = (window_names(x, start, end, salt).view(np.int64)
                for x, salt in zip(ids, (0x1B873593, 0x85EBCA6B), strict=True))
        none, doc, row = none[text], doc[text], row[text]
        o = np.lexsort((c, a))
        again = np.zeros(len(o), dtype=bool)
        again[1:] = (a[o][1:] == a[o][:-1]) & (c[o][1:] == c[o][:-1])
        head = np.maximum.accumulate(np.where(again, 0, np.arange(len(o))))
        same, of = np.empty(len(o), dtype=bool), np.empty(len(o), dtype=np.int64)
        same[o], of[o] = again, o[head]
        yield pa.RecordBatch.from_arrays([
            pa.array(doc, mask=none), pa.array(row), pa.array(doc[of], mask=~same | none[of]),
            pa.array(same), pa.array(np.where(same, row * 31, a)), pa.array(np.where(same, 0, c)),
            _packed(start - offsets[text], end - offsets[text]), _packed(lo[start], hi[end - 1])],
            names=_NAMES)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted spans -> the known ones and all but the first of each name."""
    key, first = None, None
    for b in batches:
        if not b.num_rows:
            continue
        col = dict(zip(_NAMES, b.columns, strict=True))
        known = col["known"].to_numpy(zero_copy_only=False)
        a, c = col["a"].to_numpy(), col["b"].to_numpy()
        open_ = np.flatnonzero(~known)
        other = col["other"].to_pylist()
        later = known.copy()
        if len(open_):
            x, y = a[open_], c[open_]
            new = np.ones(len(open_), dtype=bool)
            new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            new[0] = key != (x[0], y[0])
            docs = col["doc_id"].take(pa.array(open_)).to_pylist()
            for i in np.flatnonzero(~new):
                later[open_[i]] = True
            at = np.maximum.accumulate(np.where(new, np.arange(len(open_)), -1))
            for i in np.flatnonzero(~new):
                other[open_[i]] = docs[at[i]] if at[i] >= 0 else first
            key = (x[-1], y[-1])
            first = docs[at[-1]] if at[-1] >= 0 else first
        kept = pa.array(np.flatnonzero(later))
        (begin, last), (lo, hi) = (_unpacked(col[k].take(kept)) for k in ("nth", "chars"))
        yield pa.RecordBatch.from_arrays(
            [col["doc_id"].take(kept), col["row"].take(kept), pa.array(begin.astype(np.int32)),
             pa.array(last.astype(np.int32)), pa.array(lo), pa.array(hi),
             pa.array([other[i] for i in kept.to_pylist()], pa.int64())],
            names=["doc_id", "row", "first", "last", "lo", "hi", "other"])


def repeated_spans(docs: DataFrame, text: str = "text", row: str | None = None) -> DataFrame:
    """doc_id, row, spans (array of [lo, hi) character ranges that non-first spans cover),
    n_sentences (how many they hold) and others (documents with an earlier copy) of each
    row of ``docs`` with a repeated span.  ``row`` names a column that numbers the rows;
    without one they are numbered as they are read."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), number.alias("row"),
                    F.col(text).alias("text"))
    spans = d.mapInArrow(_span_batches, _SPANS)
    dealt = spans.repartition("a", "b").sortWithinPartitions(
        "a", "b", F.col("doc_id").asc_nulls_last(), "row", "nth")
    later = dealt.mapInArrow(_later, "doc_id bigint, row bigint, first int, last int, lo bigint, "
                                     "hi bigint, other bigint")
    per = later.groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set(F.struct("lo", "hi", "first", "last"))).alias("_s"),
        F.sort_array(F.collect_set("other")).alias("others"))
    fold = F.aggregate(
        "_s", F.struct(F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("done"),
                       F.lit(-1).cast("bigint").alias("lo"), F.lit(-1).cast("bigint").alias("hi"),
                       F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("last")),
        lambda a, s: F.when(s["lo"] <= a["hi"], F.struct(
            a["done"].alias("done"), a["lo"].alias("lo"),
            F.greatest(a["hi"], s["hi"]).alias("hi"),
            (a["n"] + F.greatest(F.lit(0), s["last"] - F.greatest(a["last"], s["first"]))).alias("n"),
            F.greatest(a["last"], s["last"]).alias("last")))
        .otherwise(F.struct(
            F.when(a["hi"] < 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(
                a["lo"].alias("lo"), a["hi"].alias("hi"))))).alias("done"),
            s["lo"].alias("lo"), s["hi"].alias("hi"),
            (a["n"] + s["last"] - F.greatest(a["last"], s["first"])).alias("n"),
            s["last"].alias("last"))),
        lambda a: F.struct(F.concat(a["done"], F.array(F.struct(
            a["lo"].alias("lo"), a["hi"].alias("hi")))).alias("spans"), a["n"].alias("n")))
    return per.select("doc_id", "row", "others", fold.alias("_f")).select(
        "doc_id", "row", "_f.spans", F.col("_f.n").alias("n_sentences"), "others")


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with the sentences of non-first spans cut out of their texts; other columns
    as they are.  The rows are written once with their numbers, which the spans refer to."""
    cols = docs.columns
    whole = write_phase_table(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_doc"),
        F.monotonically_increasing_id().alias("_row")), "sentence-rows")
    found = repeated_spans(whole.select("_doc.doc_id", "_doc.text", "_row"), row="_row")
    met = whole.join(found.select(F.col("row").alias("_found"), "spans"),
                     F.col("_row") == F.col("_found"), "left")
    # what lies between the spans, from the end of one to the start of the next
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["hi"]))
    ends = F.concat(F.transform("spans", lambda s: s["lo"]),
                    F.array(F.length("_doc.text").cast("bigint")))
    left = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(
        F.col("_doc.text"), (a + 1).cast("int"), (b - a).cast("int"))), "")
    new = F.when(F.col("spans").isNull(), F.col("_doc")).otherwise(
        F.col("_doc").withField("text", left))
    return met.select(new.alias("_doc")).select("_doc.*")


def query(spark, sf_dir):
    """doc_id, n_spans, n_sentences, spans (lo:hi, comma-joined; code points, end exclusive)
    and other_ids of every document that loses sentences."""
    got = repeated_spans(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", s["lo"].cast("string"), s["hi"].cast("string"))), ",")
    return got.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"), "n_sentences",
                      text.alias("spans"), F.col("others").alias("other_ids"))
