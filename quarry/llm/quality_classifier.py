"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer
network in numpy with temperature-calibrated probabilities.

1. Words are hashed to ``VOCABULARY`` ids, each with a fixed sparse ternary index vector.
   A word's context vector is the sum of the index vectors of its neighbours (two on
   either side) over the whole corpus.  Tasks add up their rows of an integer matrix and
   emit what is not zero; Spark adds the rows by word.  Sums are integers, so the result
   does not depend on the order of tasks.
2. The matrix has a proven size (VOCABULARY x DIM floats: 8 MB) whatever the corpus, and
   is broadcast.  A document is the weighted mean of its words' unit vectors; frequent
   words weigh less (a / (a + frequency)).
3. The network is fitted on at most ``TRAIN_ROWS`` labelled documents (the smallest id
   hashes), never on held-out ids (crc32(doc_id) mod 3 = 1).  A fifth of these rows is kept
   from the gradient; the temperature that calibrates the logits is fitted on it.
4. Every document gets its score in a last pass over the pooled vectors.

A score is a function of the text alone.  Defined results: null and empty texts pool to
the zero vector and are scored like any other; labels other than 0 and 1 and labels of
null ids are ignored; without any labelled row every score is 0.5; rows of equal ids are
scored one by one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.text import table, words
from quarry.session import write_phase_table

VOCABULARY, DIM, NONZERO, REACH = 1 << 16, 32, 4, 2
SMOOTH = 1e-3
#: Most labelled rows that the network is fitted on.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, RATE, SEED = 32, 300, 0.01, 7
_STEP = 1 << 18  # words whose vectors are in memory at once


def word_ids(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.xxhash64(w), F.lit(VOCABULARY)).cast("int"))


def index_vectors() -> np.ndarray:
    """A sparse ternary vector for each id; the last row, for no word, is zero."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((VOCABULARY + 1, DIM), dtype=np.int8)
    rows = np.repeat(np.arange(VOCABULARY), NONZERO)
    np.add.at(out, (rows, rng.integers(0, DIM, len(rows))),
              rng.choice(np.array([-1, 1], dtype=np.int8), len(rows)))
    return out


def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the offsets of its rows in them."""
    offsets = np.asarray(col.offsets, dtype=np.int64)
    return np.asarray(col.values)[offsets[0]:offsets[-1]], offsets - offsets[0]


def add_contexts(ids: np.ndarray, offsets: np.ndarray, index: np.ndarray, sums: np.ndarray,
                 counts: np.ndarray) -> None:
    """Add to each word's row the index vectors of its neighbours in the same text."""
    n = len(ids)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded = np.full(n + REACH * len(offsets), VOCABULARY, dtype=np.int64)
    at = np.arange(n) + REACH * (text + 1)
    padded[at] = ids
    for lo in range(0, n, _STEP):
        here = at[lo:lo + _STEP]
        near = sum(index[padded[here + d]] for d in range(-REACH, REACH + 1) if d)
        own = ids[lo:lo + _STEP].astype(np.uint16)
        order = np.argsort(own, kind="stable")
        own = own[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        word = own[starts].astype(np.int64)
        sums[word] += np.add.reduceat(near[order], starts, axis=0, dtype=np.int64)
        counts[word] += np.diff(np.concatenate([starts, [len(own)]]))


def _context_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    sums = np.zeros((VOCABULARY, DIM), dtype=np.int64)
    counts = np.zeros(VOCABULARY, dtype=np.int64)
    for b in batches:
        add_contexts(*_lists(b.column(0)), index, sums, counts)
    seen = np.flatnonzero(counts)
    for lo in range(0, len(seen), 8192):
        w = seen[lo:lo + 8192]
        yield pa.RecordBatch.from_arrays(
            [pa.array(w.astype(np.int32)), pa.array(counts[w]),
             *(pa.array(np.ascontiguousarray(sums[w, d])) for d in range(DIM))],
            names=["word", "n", *(f"d{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors times weights, a row for each id: what pooling adds up.  The last
    column is the weight alone."""
    schema = "word int, n bigint, " + ", ".join(f"d{d} bigint" for d in range(DIM))
    rows = docs.select(word_ids(F.col(text)).alias("ids")).mapInArrow(_context_batches, schema)
    total = rows.groupBy("word").agg(F.sum("n").alias("n"),
                                     *[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM)])
    got = total.toArrow()  # at most VOCABULARY rows
    out = np.zeros((VOCABULARY, DIM + 1), dtype=np.float32)
    if not got.num_rows:
        return out
    w = got.column("word").to_numpy()
    n = got.column("n").to_numpy().astype(np.float64)
    v = np.stack([got.column(f"d{d}").to_numpy() for d in range(DIM)], axis=1).astype(np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    weight = SMOOTH / (SMOOTH + n / n.sum())
    out[w, :DIM] = v * weight[:, None]
    out[w, DIM] = weight
    return out


def pool(ids: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The weighted mean of the vectors of each text's words; zero for no words."""
    sums = np.zeros((len(offsets) - 1, vectors.shape[1]))
    for lo in range(0, len(ids), _STEP):
        hi = min(lo + _STEP, len(ids))
        first = np.searchsorted(offsets, lo, side="right") - 1
        last = np.searchsorted(offsets, hi, side="left")
        starts = np.maximum(offsets[first:last], lo) - lo
        filled = np.flatnonzero(np.minimum(offsets[first + 1:last + 1], hi) - lo > starts)
        sums[first + filled] += np.add.reduceat(vectors[ids[lo:hi]], starts[filled], axis=0,
                                                dtype=np.float64)
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1e-9)


def pooled(docs: DataFrame, vectors: np.ndarray, text: str = "text") -> DataFrame:
    """doc_id, held_out and vec of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            vec = pool(*_lists(b.column(2)), sent.value).astype(np.float32)
            flat = pa.array(vec.ravel())
            offsets = pa.array(np.arange(len(vec) + 1, dtype=np.int32) * DIM)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, flat)],
                names=["doc_id", "held_out", "vec"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    d = docs.select("doc_id", held.alias("held_out"), word_ids(F.col(text)).alias("ids"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(batches, f"doc_id {kind}, held_out boolean, vec array<float>")


class Network:
    """Two layers, fitted by Adam on the logistic loss; ``temperature`` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, check: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.temperature = 1.0
        fit = ~check if (~check).any() and check.any() else np.ones(len(y), dtype=bool)
        self.mean, self.scale = x[fit].mean(0), x[fit].std(0) + 1e-6
        rate = np.clip(y[fit].mean(), 1e-3, 1 - 1e-3)
        self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.array(np.log(rate / (1 - rate)))]
        self._fit(x[fit], y[fit])
        if check.any():
            self._calibrate(self.logit(x[check]), y[check])

    def logit(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.p[0] + self.p[1])
        return (hidden @ self.p[2] + self.p[3]) / self.temperature

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        z = (x - self.mean) / self.scale
        m = [np.zeros_like(p) for p in self.p]
        v = [np.zeros_like(p) for p in self.p]
        for t in range(1, EPOCHS + 1):
            h = np.tanh(z @ self.p[0] + self.p[1])
            e = (_sigmoid(h @ self.p[2] + self.p[3]) - y) / len(y)
            dh = np.outer(e, self.p[2]) * (1 - h * h)
            grads = [z.T @ dh + 1e-4 * self.p[0], dh.sum(0), h.T @ e + 1e-4 * self.p[2], e.sum()]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9 ** t)) / (
                    np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)

    def _calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least logistic loss, by golden section on its logarithm."""
        def loss(log_t: float) -> float:
            s = logit / np.exp(log_t)
            return float(np.mean(np.logaddexp(0, s) - y * s))
        lo, hi, g = np.log(0.2), np.log(5.0), (5 ** 0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(vectors: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Network | None:
    """The network of the labelled, not held-out rows of ``vectors``; None without any."""
    known = labels.where("quality in (0, 1)").select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).distinct()
    rows = vectors.where(~F.col("held_out")).join(known, F.col("doc_id") == F.col("_id"))
    draw = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"))
    got = rows.select("doc_id", "vec", "y", draw.alias("draw")) \
        .orderBy("draw", "y", F.xxhash64("vec")).limit(train_rows).toArrow()
    if not got.num_rows:
        return None
    x = np.stack(got.column("vec").to_pylist()).astype(np.float64)
    check = got.column("draw").to_numpy() % 5 == 0
    return Network(x, got.column("y").to_numpy().astype(np.float64), check)


def scored(vectors: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``vectors``."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = _lists(b.column(2))[0].reshape(-1, DIM).astype(np.float64)
            score = np.full(len(x), 0.5) if network is None else _sigmoid(network.logit(x))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])
    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(batches, f"doc_id {kind}, held_out boolean, score double, "
                                       "predicted int")


def classify(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    vectors = write_phase_table(pooled(docs, word_vectors(docs)), "quality-vectors")
    return scored(vectors, fit(vectors, labels, train_rows))


def query(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
