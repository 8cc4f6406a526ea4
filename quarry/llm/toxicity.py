"""Toxicity: non-negative positive-unlabelled learning of numpy classifiers.

Only confirmed toxic documents (``labels.toxic`` = 1) and unlabelled texts teach; rows that
are labelled clean are not used as negatives.

1. Features of a text are the hashed terms in it and the beginnings of terms (``PREFIXES``
   bytes), present or not, so a long text does not dilute a word; of runs of over ``LONG``
   bytes (scripts without spaces) also every ``GRAM`` bytes.  Tasks count the documents that
   have a feature, over all documents and over the confirmed ones; Spark adds the counts, and
   the ``CHOSEN`` features whose counts differ most take part.
2. At most ``POSITIVE_ROWS`` confirmed and ``UNLABELLED_ROWS`` unlabelled documents (the
   smallest id hashes; equal texts once) are what the classifiers are fitted on.  Ids held
   out (crc32(doc_id) mod 5 = 0) are in neither.
3. With class prior p the risk of a classifier g is p E+[l(g)] + max(0, Eu[l(-g)] -
   p E+[l(-g)]): the share that hidden toxic texts have in the unlabelled loss is taken off,
   and where that would go below zero the step is made against it.  The prior is the share
   of toxic ones among the labelled rows, or ``PRIOR`` where all labels are 1.
   ``MEMBERS`` linear classifiers, sparse by soft thresholds, are fitted with other batch
   orders; the score is that of their mean logit.
4. Every document gets its score in a last pass; whole texts are looked at.

A score is a function of the text alone.  Defined results: null and empty texts have no
features and get the score of that; labels other than 0 and 1 and of null ids are ignored;
without a confirmed row every score is the prior; rows of equal ids are scored one by one;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.terms import find_terms, pieces, text_bytes
from quarry.llm.text import table
from quarry.session import write_phase_table

BITS, PREFIXES, LONG, GRAM = 20, (4, 5, 6), 24, 6
#: Features that take part, and most rows that the classifiers are fitted on.
CHOSEN, POSITIVE_ROWS, UNLABELLED_ROWS = 2048, 10_000, 20_000
PRIOR, MEMBERS, STEPS, BATCH, RATE, SPARSE, SEED = 0.1, 3, 1500, 1024, 0.05, 1e-3, 11
_CYCLE = 1024


def _powers() -> np.ndarray:
    out = np.full(_CYCLE, 0x9E3779B97F4A7C15, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POWER = _powers()


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h + np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _head(low: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        h += (low[at + i].astype(np.uint64) + np.uint64(1)) * _POWER[i]
    return h


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the terms of these texts, repeats included."""
    low, starts, ends, row = find_terms(raw, offsets)
    if not len(starts):
        return row, row
    size = ends - starts
    rows, found = [row], []
    at = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(at, size)
    kept = low[np.repeat(starts, size) + place].astype(np.uint64)
    found.append(_bucket(np.add.reduceat((kept + np.uint64(1)) * _POWER[place % _CYCLE], at), 0))
    for k in PREFIXES:
        longer = np.flatnonzero(size > k)
        rows.append(row[longer])
        found.append(_bucket(_head(low, starts[longer], k), k))
    runs = np.flatnonzero(size > LONG)
    if len(runs):
        n = size[runs] - GRAM + 1
        grams = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[runs], n)
        rows.append(np.repeat(row[runs], n))
        found.append(_bucket(_head(low, grams, GRAM), 100))
    return np.concatenate(rows), np.concatenate(found)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def distinct_features(texts: pa.Array, lookup: np.ndarray | None = None
                      ) -> Iterator[np.ndarray]:
    """Sorted row << BITS | feature of slices of ``texts``, each pair once over all slices;
    with ``lookup`` only features it does not give -1, as the numbers that it gives."""
    row, kept = -1, []
    for first, raw, offsets in [*pieces(*text_bytes(texts)), (-1, None, None)]:
        if kept and first != row:
            yield _distinct(np.concatenate(kept)) if len(kept) > 1 else kept[0]
            kept = []
        if raw is None:
            return
        r, f = features(raw, offsets)
        if lookup is not None:
            f = lookup[f]
            r, f = r[f >= 0], f[f >= 0]
        kept.append(_distinct((r + first) << BITS | f))
        row = first


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = np.zeros(1 << BITS, dtype=np.int64)
    for b in batches:
        for keys in distinct_features(b.column(0)):
            docs += np.bincount(keys & ((1 << BITS) - 1), minlength=1 << BITS)
    seen = np.flatnonzero(docs)
    for lo in range(0, len(seen), 65_536):
        f = seen[lo:lo + 65_536]
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(docs[f])],
                                         names=["feature", "n"])


def document_counts(texts: DataFrame) -> DataFrame:
    """feature, n: how many of ``texts`` (one string column without nulls) have it."""
    return texts.mapInArrow(_count_batches, "feature int, n bigint") \
        .groupBy("feature").agg(F.sum("n").alias("n"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def fit_rows(docs: DataFrame, labels: DataFrame, text: str, positive_rows: int,
             unlabelled_rows: int) -> DataFrame:
    """doc_id, text, th, pos, unl of the rows to fit on (bounded, so a written table)."""
    draw = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"))
    known = "doc_id is not null"
    positive = labels.where("toxic = 1").where(known).where(~held_out()).select("doc_id") \
        .distinct().orderBy(draw, "doc_id").limit(positive_rows)
    unlabelled = docs.select("doc_id").where(known).where(~held_out()).distinct() \
        .orderBy(draw, "doc_id").limit(unlabelled_rows)
    ids = positive.select("doc_id", F.lit(1).alias("pos"), F.lit(0).alias("unl")).unionByName(
        unlabelled.select("doc_id", F.lit(0).alias("pos"), F.lit(1).alias("unl"))) \
        .groupBy("doc_id").agg(F.max("pos").alias("pos"), F.max("unl").alias("unl"))
    # At most positive_rows + unlabelled_rows ids.
    met = docs.select("doc_id", _lowered(text).alias("text")).join(F.broadcast(ids), "doc_id")
    return write_phase_table(met.withColumn("th", F.md5(F.col("text").cast("binary"))),
                             "toxicity-fit")


def choose(counts: DataFrame, positive: DataFrame, n_docs: int, n_positive: int,
           chosen: int = CHOSEN) -> np.ndarray:
    """Feature -> number of those whose share among the confirmed differs most (in standard
    errors) from that of all documents; -1 for the rest."""
    share = F.coalesce("m", F.lit(0)) / F.lit(float(n_positive))
    every = (F.col("n") + 1) / F.lit(n_docs + 2.0)
    z = (share - every) / F.sqrt(every * (1 - every) / F.lit(float(n_positive)))
    best = counts.join(positive.withColumnRenamed("n", "m"), "feature", "left") \
        .select("feature", F.abs(z).alias("z")).orderBy(F.desc("z"), "feature").limit(chosen)
    lookup = np.full(1 << BITS, -1, dtype=np.int64)
    picked = best.toArrow().column("feature").to_numpy()
    lookup[picked] = np.arange(len(picked))
    return lookup


def _marked(batch_texts: pa.Array, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, dtype=np.int64),
                           *distinct_features(batch_texts, lookup)])
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _sample(rows: DataFrame, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows (0 or 1) of the confirmed and of the unlabelled texts, equal ones once."""
    sent = rows.sparkSession.sparkContext.broadcast(lookup)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            row, f = _marked(b.column(0), sent.value)
            at = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            marks = pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], marks],
                                             names=["th", "pos", "unl", "marks"])
    got = rows.select("text", "th", "pos", "unl").mapInArrow(
        batches, "th string, pos int, unl int, marks array<int>")
    got = got.groupBy("th").agg(F.max("pos").alias("pos"), F.max("unl").alias("unl"),
                                F.first("marks").alias("marks")).orderBy("th").toArrow()
    x = np.zeros((got.num_rows, int(lookup.max()) + 1), dtype=np.uint8)
    for i, marks in enumerate(got.column("marks")):
        x[i, marks.values.to_numpy()] = 1
    return x[got.column("pos").to_numpy() == 1], x[got.column("unl").to_numpy() == 1]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def risk(g_pos: np.ndarray, g_unl: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk of the confirmed as toxic, and the corrected risk of the clean; the loss is
    the sigmoid of the negative margin."""
    as_toxic = prior * float(np.mean(_sigmoid(-g_pos)))
    return as_toxic, float(np.mean(_sigmoid(g_unl))) - prior * float(np.mean(_sigmoid(g_pos)))


def _slope(g: np.ndarray) -> np.ndarray:
    """Derivative by g of the mean loss as clean; as toxic it is the negative."""
    s = _sigmoid(g)
    return (s * (1 - s) / len(g)).astype(np.float32)


def fit_member(pos: np.ndarray, unl: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Weights and, last, the bias of one classifier, by Adam on the non-negative risk; the
    mean over the second half of the steps."""
    rng = np.random.default_rng(seed)
    w = np.zeros(pos.shape[1] + 1)
    w[-1] = -1
    m, v, mean = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    tail = STEPS // 2
    for t in range(1, STEPS + 1):
        p = pos[rng.integers(0, len(pos), BATCH)] if len(pos) > BATCH else pos
        u = unl[rng.integers(0, len(unl), BATCH)] if len(unl) > BATCH else unl
        p, u, now = p.astype(np.float32), u.astype(np.float32), w.astype(np.float32)
        g_p, g_u = p @ now[:-1] + now[-1], u @ now[:-1] + now[-1]
        d_p, d_u = prior * _slope(g_p), _slope(g_u)
        if risk(g_p, g_u, prior)[1] >= 0:
            d_p = -2 * d_p        # as toxic, and out of the unlabelled as clean
        else:
            d_u = -d_u            # against the part that fell below zero
        grad = np.append(p.T @ d_p + u.T @ d_u, d_p.sum() + d_u.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        rate = RATE if t <= tail else RATE * (STEPS + 1 - t) / tail
        step = rate / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-6)
        w = w - step * (m / (1 - 0.9 ** t))
        cut = step[:-1] * SPARSE * prior
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - cut, 0)
        if t > tail:
            mean += w / (STEPS - tail)
    return mean


class Model:
    """The features that take part, and the members' mean weights and bias."""

    def __init__(self, lookup: np.ndarray, weights: np.ndarray, bias: float):
        self.lookup, self.weights, self.bias = lookup, weights, bias

    def score(self, texts: pa.Array) -> np.ndarray:
        row, f = _marked(texts, self.lookup)
        return _sigmoid(self.bias + np.bincount(row, self.weights[f], minlength=len(texts)))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text",
        positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS,
        chosen: int = CHOSEN) -> Model:
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    n, toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = min(max(toxic / n, 0.005), 0.5) if n > toxic else PRIOR
    none = Model(np.full(1 << BITS, -1, dtype=np.int64), np.zeros(1), np.log(prior / (1 - prior)))
    rows = fit_rows(docs, labels, text, positive_rows, unlabelled_rows)
    positive = rows.where("pos = 1").dropDuplicates(["th"]).select("text")
    n_positive = positive.count()
    if not n_positive:
        return none
    lookup = choose(document_counts(docs.select(_lowered(text))), document_counts(positive),
                    docs.count(), n_positive, chosen)
    if lookup.max() < 0:
        return none
    pos, unl = _sample(rows, lookup)
    members = np.stack([fit_member(pos, unl, prior, SEED + i) for i in range(MEMBERS)])
    return Model(lookup, members[:, :-1].mean(0), float(members[:, -1].mean()))


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = sent.value.score(b.column(2))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score),
                 pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    d = docs.select("doc_id", held_out().alias("held_out"), _lowered(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
