"""SimHash near-duplicates by bit-sliced comparison.

1. The JVM builds each row's shingle hashes (XXH64, seed 42, is Spark's own
   ``xxhash64``); Arrow tasks turn them into a 64-bit fingerprint by counting
   bits in planes.
2. Equal fingerprints become one node, so groups of copies of any size cost one row.
3. Fingerprints within ``max_bits`` (2) of each other agree on at least two of
   four 16-bit bands: every node goes to six blocks, one for each pair of bands.
   A block of over ``block_rows`` nodes is dealt again by pairs of the 8-bit
   quarters of the other 32 bits, which is exact for the same reason and leaves
   at most 2**16 different fingerprints in a block, however the corpus looks.
4. In a block the bit planes lie vertically: bit b of up to 64 fingerprints is one
   machine word.  A probe updates the distances to a whole block at once with
   carry-save counters (two planes of count bits and a sticky "over the radius"
   plane), and leaves the block once every lane is over.
5. A block gives a spanning forest of its links (never all pairs); connected
   components over all blocks follow by large-star / small-star rounds, each
   written to the checkpoint folder.

Defined results: null and wordless texts have fingerprint zero and link like any
other; a text of one or two words is one shingle; rows with equal ids are judged
by their own text; null ids never name a component unless all its ids are null.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.text import ascii_lower, table, words
from quarry.session import write_phase_table

#: Words of a shingle, and the most bits in which linked fingerprints differ.
SHINGLE, MAX_BITS = 3, 2
#: A block of more nodes is dealt again by finer keys.
BLOCK_ROWS = 2048


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """XXH64 of every run of ``width`` words (of the whole sequence if shorter)."""
    return _hashes(words(ascii_lower(F.coalesce(text, F.lit("")))), width)


def _hashes(w: Column, width: int) -> Column:
    joined = lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, width)]))
    runs = F.transform(w, joined)
    n = F.size(w)
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(
        F.slice(runs, 1, F.greatest(n - (width - 1), F.lit(1))))


def majority_bits(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run values[offsets[k]:offsets[k+1]] the bits set in over half of it."""
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    step = 1 << 18  # bits of so many hashes are unpacked at once, runs may span steps
    counts = np.zeros((len(out), 64), dtype=np.int64)
    for lo in range(int(offsets[0]), int(offsets[-1]), step):
        hi = min(lo + step, int(offsets[-1]))
        bits = np.unpackbits(values[lo:hi].view(np.uint8).reshape(-1, 8), axis=1,
                             bitorder="little")
        first = np.searchsorted(offsets, lo, side="right") - 1
        last = np.searchsorted(offsets, hi, side="left")
        starts = np.maximum(offsets[first:last], lo) - lo
        filled = np.flatnonzero(np.minimum(offsets[first + 1:last + 1], hi) - lo > starts)
        if len(filled):
            counts[first + filled] += np.add.reduceat(bits, starts[filled], axis=0,
                                                      dtype=np.int32)
    size = np.diff(offsets)[:, None]
    set_ = (2 * counts > size).astype(np.uint8)
    if len(out):
        out = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hashes = b.column(b.num_columns - 1)
        offsets = np.asarray(hashes.offsets, dtype=np.int64)
        values = np.ascontiguousarray(np.asarray(hashes.values, dtype=np.int64)).view(np.uint64)
        prints = majority_bits(values, offsets).view(np.int64)
        kept = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(prints)],
                                         names=[*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, width: int = SHINGLE, text: str = "text",
                 carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` and ``fp`` (the fingerprint, as a signed long) of each row."""
    lower = docs.select(*carry, words(ascii_lower(F.coalesce(F.col(text), F.lit("")))).alias("_w"))
    hashed = lower.select(*carry, _hashes(F.col("_w"), width).alias("_h"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                       for f in hashed.select(*carry).schema)
    return hashed.mapInArrow(_fingerprint_batches, f"{fields}, fp bigint")


def _pair_masks(free: list[int]) -> list[int]:
    """A mask for each pair of the four quarters of the free bits."""
    q = len(free) // 4
    quarters = [free[i * q:(i + 1) * q] for i in range(4)]
    return [sum(1 << b for q in pair for b in q) for pair in combinations(quarters, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


COARSE = _pair_masks(list(range(64)))
#: For each coarse mask, the masks that add two quarters of the bits it leaves free.
FINE = [[m | f for f in _pair_masks([b for b in range(64) if not m >> b & 1])] for m in COARSE]


def _keyed(nodes: DataFrame, masks: list[tuple[int, int]]) -> DataFrame:
    """A row (mask number, masked bits, fp) for each node and mask."""
    keys = F.array(*[F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m)))
                              .alias("k")) for i, m in masks])
    return nodes.select("fp", F.explode(keys).alias("_b")).select("_b.m", "_b.k", "fp")


def _spread(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The vertical planes: row j holds bit bits[j] of every fingerprint, 64 in a word."""
    planes = np.zeros((len(bits), -(-len(fps) // 64) * 8), dtype=np.uint8)
    for j, b in enumerate(bits):
        line = np.packbits((fps >> np.uint64(b) & np.uint64(1)).astype(np.uint8),
                           bitorder="little")
        planes[j, :len(line)] = line
    return planes.view(np.uint64)


def near_pairs(fps: np.ndarray, radius: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """All positions p < q of a block with fps[p], fps[q] within ``radius`` bits.

    A tile of probes meets the whole block at once.  ``count`` holds the planes of
    the carry-save counters, ``over`` the lanes that have passed the radius for good;
    the tile leaves the block once every lane of every probe is over."""
    n = len(fps)
    differ = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if differ >> b & 1]
    planes = _spread(fps, bits)
    unused = np.ones(planes.shape[1] * 64 if bits else -(-n // 64) * 64, dtype=np.uint8)
    unused[:n] = 0
    unused = np.packbits(unused, bitorder="little").view(np.uint64)
    n_planes = max(1, radius.bit_length())
    left, right = [], []
    for p0 in range(0, n, tile):
        probes = fps[p0:p0 + tile]
        base = p0 // 64
        over = np.repeat(unused[None, base:], len(probes), axis=0)
        count = [np.zeros_like(over) for _ in range(n_planes)]
        for j, b in enumerate(bits):
            flip = np.uint64(0) - (probes >> np.uint64(b) & np.uint64(1))
            carry = planes[j, None, base:] ^ flip[:, None]
            for c in range(n_planes):
                count[c], carry = count[c] ^ carry, count[c] & carry
            over |= carry | _above(count, radius)
            if j >= radius and (over == ~np.uint64(0)).all():
                break
        p, q = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
        p, q = p + p0, q + base * 64
        left.append(p[q > p])
        right.append(q[q > p])
    return np.concatenate(left), np.concatenate(right)


def _above(count: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over ``radius``: compared plane by plane from the top."""
    greater = np.zeros_like(count[0])
    equal = ~greater
    for c in reversed(range(len(count))):
        if radius >> c & 1:
            equal = equal & count[c]
        else:
            greater = greater | (equal & count[c])
            equal = equal & ~count[c]
    return greater


def least_connected(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """For each of n positions the least position that links lead to."""
    root = np.arange(n)
    while len(p):
        low, high = np.minimum(root[p], root[q]), np.maximum(root[p], root[q])
        moving = low != high
        if not moving.any():
            break
        np.minimum.at(root, high[moving], low[moving])
        while True:  # pointer jumping
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _block_links(radius: int):
    """Arrow batches of (m, k, fp), sorted by block -> (a, b): each node that is not its
    component's least in a block, with that least.  A block may span batches."""
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, dtype=np.int64)] * 3
        for b in _then_none(batches):
            if b is not None:
                cols = [np.concatenate([r, np.asarray(b.column(i), dtype=np.int64)])
                        for i, r in enumerate(rest)]
            else:
                cols = rest
            m, k, fp = cols
            cut = np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1
            edges = np.concatenate([[0], cut, [len(m)]])
            if b is not None:  # the last block may go on
                rest = [c[edges[-2]:] for c in cols]
                edges = edges[:-1]
            out = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo < 2:
                    continue
                block = np.sort(fp[lo:hi])
                root = least_connected(len(block), *near_pairs(block.view(np.uint64), radius))
                tied = np.flatnonzero(root != np.arange(len(block)))
                out.append((block[tied], block[root[tied]]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                    names=["a", "b"])
    return links


def _then_none(batches):
    yield from batches
    yield None


def links(nodes: DataFrame, radius: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): links that connect all fingerprints (distinct ``fp``) within ``radius`` (<= 2)."""
    if radius > 2:
        raise ValueError("two of four bands are sure to agree for up to 2 differing bits only")

    def sized(rows: DataFrame, name: str) -> DataFrame:
        n = write_phase_table(rows.groupBy("m", "k").agg(F.count(F.lit(1)).alias("n"))
                              .where("n > 1"), name)
        return rows.join(n, ["m", "k"])

    coarse = sized(_keyed(nodes, list(enumerate(COARSE))), "simhash-coarse")
    hot = coarse.where(F.col("n") > block_rows)
    fine = None
    for i, masks in enumerate(FINE):
        part = _keyed(hot.where(F.col("m") == i), [(6 + 6 * i + j, x) for j, x in enumerate(masks)])
        fine = part if fine is None else fine.unionByName(part)
    fine = sized(write_phase_table(fine, "simhash-fine-rows"), "simhash-fine")
    blocks = coarse.where(F.col("n") <= block_rows).unionByName(fine).select(
        F.col("m").cast("bigint").alias("m"), "k", "fp")
    dealt = blocks.repartition("m", "k").sortWithinPartitions("m", "k")
    return dealt.mapInArrow(_block_links(radius), "a bigint, b bigint")


def components(prints: DataFrame, radius: int = MAX_BITS, block_rows: int = BLOCK_ROWS
               ) -> DataFrame:
    """(fp, component_id, keeper): each fingerprint's component, named by its least
    doc_id; ``keeper`` is the least (doc_id, text hash) where ``prints`` has ``th``."""
    th = F.col("th") if "th" in prints.columns else F.lit(None).cast("bigint")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", th.alias("th"))
    nodes = write_phase_table(prints.groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.min(first).alias("keeper")), "simhash-nodes")
    tied = connected_components(links(nodes.select("fp"), radius, block_rows), "simhash-links")
    grouped = nodes.join(tied, nodes["fp"] == tied["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "doc_id", "keeper")
    grouped = write_phase_table(grouped, "simhash-grouped")
    named = write_phase_table(grouped.groupBy("root").agg(
        F.min("doc_id").alias("component_id"), F.min("keeper").alias("keeper")), "simhash-named")
    return write_phase_table(grouped.select("fp", "root").join(named, "root").drop("root"),
                             "simhash-components")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = MAX_BITS,
                    text: str = "text") -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs``."""
    prints = write_phase_table(fingerprints(docs, width, text), "simhash-prints")
    return prints.join(components(prints, radius).drop("keeper"), "fp")


def one_of_each(docs: DataFrame, width: int = SHINGLE, radius: int = MAX_BITS) -> DataFrame:
    """One row of each component of ``docs``: the one of least (doc_id, text hash), null
    ids last; rows equal in both count as one.  Columns stay as they are."""
    from quarry.llm.rows import keep_rows
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    prints = write_phase_table(fingerprints(keyed, width, carry=("doc_id", "th")),
                               "simhash-prints")
    kept = components(prints, radius).select("keeper.doc_id", "keeper.th")
    return keep_rows(docs, kept)


def query(spark, sf_dir):
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")
