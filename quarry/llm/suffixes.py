"""The suffix array of many sequences by distributed prefix growing, its longest common
prefixes, and for each suffix the longest prefix that an earlier suffix has too.

A position ``p`` is a number over the whole corpus; ``e`` is the end of the position's
segment, so the suffix of ``p`` is the items from ``p`` to ``e``.  Items that the corpus
holds once are in no repeated run: they end segments and have no suffix.

1. ``doubled``: at step k suffixes that agree in their first s = 16**k items have one rank,
   the number of suffixes before their group.  That is prefix doubling, four doublings at
   once: the key of a suffix is the ranks of p, p + s, p + 2s, up to 16 of them.  They are
   read off the segment, and one range shuffle puts the suffixes of groups that may still
   split in order by key; counts from the start of the old group are the new ranks.  It ends
   when no group can split, at the latest when 16**k passes the longest segment.
2. ``common_prefixes``: each place in suffix order is split from the one before at one step,
   by the number of leading ranks that both keys have in common; the rest is found by
   stepping down through the keys of the smaller steps.  Suffixes that never split are equal.
3. ``earlier``: the intervals of the array with a common prefix of d items that hold a
   suffix are nested; the deepest one that also holds a smaller position gives the longest
   earlier copy.  One pass from each side over a block of consecutive places finds it with
   the stairs of (depth, least position) of the intervals that are open.  Blocks have a fixed
   size, and what is open at their edges is passed on as stairs: a row a block, with as many
   steps as there are depths of intervals that cross the edge.

No group is ever in one task: ranges are cut by key and position, so equal suffixes in any
number are spread over tasks and blocks.  What a range needs to know of those before it is
two rows a range, read by the driver: a job of its own in no plan, so plans and the number
of jobs stay small whatever the length of repeated runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.session import phase_path, remove_table

#: Places of the suffix array in one block, as a power of two.
BLOCK_BITS = 16
#: Ranks in a key: a step grows the sorted prefixes by this factor.
GROWTH = 16
_WHOLE = 1 << 62

Stairs = list[tuple[int, int]]


class Tables:
    """Tables of one computation, removed together once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = phase_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        for path in self.paths:
            remove_table(self.spark, path)
        self.paths = []


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A row a range, known to the driver, for a broadcast."""
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
    return F.broadcast(spark.createDataFrame(pa.table(columns, names=names)))


def _added(b: pa.RecordBatch, names: list[str], **more) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more.values())],
                                      names=[*names, *more])


def _running(weight: str, names: list[str]):
    """Rows with the sum of ``weight`` before each in its range and with it; the last row of
    a range is marked."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield _added(held[0], names, _end=[False], **held[1])
            w = np.asarray(b.column(b.schema.get_field_index(weight)), dtype=np.int64)
            ends = total + np.cumsum(w)
            more = {"_part": np.full(len(w), part, dtype=np.int64), "_before": ends - w,
                    "_sum": ends}
            yield _added(b[:-1], names, _end=np.zeros(len(w) - 1, dtype=bool),
                         **{k: v[:-1] for k, v in more.items()})
            held, total = (b[-1:], {k: v[-1:] for k, v in more.items()}), int(ends[-1])
        if held is not None:
            yield _added(held[0], names, _end=[True], **held[1])
    return add


_RUNNING = "_end boolean, _part long, _before long, _sum long"


def numbered(tables: Tables, df: DataFrame, order: list[str], weight: str, out: str,
             name: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``weight`` over all rows before it in ``order``, whose
    values tell rows apart.  One range shuffle; the driver sees one row a range."""
    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL(_RUNNING).fields])
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    t = tables.write(ranged.mapInArrow(_running(weight, df.columns), schema), name)
    starts, total = [], 0
    for r in sorted(t.where("_end").select("_part", "_sum").collect()):
        starts.append((r["_part"], total))
        total += r["_sum"]
    return t.join(_local(tables.spark, starts, ["_part", "_start"]), "_part").select(
        *df.columns, (F.col("_before") + F.col("_start")).alias(out))


def first_ranks(tables: Tables, items: DataFrame) -> DataFrame:
    """p, d, e, r, step, parts, live of the items (p, d, a, b) that the corpus holds more than
    once: the end of the segment and the rank; for the rest see ``doubled``.  ``d`` tells
    sequences apart."""
    ids = items.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    ids = numbered(tables, ids, ["a", "b"], "c", "r", "suffix-items")
    v = items.join(ids, ["a", "b"]).select("p", "d", "r")
    run = F.col("p") - F.row_number().over(Window.partitionBy("d").orderBy("p"))
    end = F.max("p").over(Window.partitionBy("d", "_run")) + 1
    return v.withColumn("_run", run).select(
        "p", "d", end.alias("e"), "r", F.lit(0).cast("bigint").alias("step"),
        F.lit(0).cast("bigint").alias("parts"), F.lit(True).alias("live"))


def _keyed(ranked: DataFrame, step: int) -> DataFrame:
    """p, d, e, step, parts and key of the live positions: the ranks at p, p + step, ... of
    the segment, ``GROWTH`` at most.  A segment is a part of one document."""
    whole = ranked.groupBy("d", "e").agg(F.sort_array(F.collect_list(
        F.struct("p", "r", "step", "parts", "live"))).alias("_s"))
    key = (f"transform(sequence(i, least(i + {(GROWTH - 1) * step}L, size(_s) - 1L), {step}L),"
           f" j -> _s[int(j)].r)")
    live = F.expr("transform(filter(sequence(0L, size(_s) - 1L), i -> _s[int(i)].live), i -> "
                  "struct(_s[int(i)].p as p, _s[int(i)].step as step, _s[int(i)].parts as parts, "
                  f"{key} as key))")
    return whole.select("d", "e", F.explode(live).alias("_l")).select(
        "_l.p", "d", "e", "_l.step", "_l.parts", "_l.key")


def _matrix(keys: pa.ListArray) -> np.ndarray:
    """Keys as rows of ``GROWTH`` ranks; -1 behind the end of a suffix."""
    n = np.asarray(keys.value_lengths(), dtype=np.int64)
    m = np.full((len(n), GROWTH), -1, dtype=np.int64)
    m[np.arange(GROWTH) < n[:, None]] = np.asarray(keys.flatten(), dtype=np.int64)
    return m


def shared_parts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of leading columns in which rows of ``a`` and ``b`` are equal."""
    return np.cumprod(a == b, axis=1).sum(axis=1)


def _compared(names: list[str]):
    """Rows in order of (key, p) with their number in the range, those of the first row of
    their old group (equal first rank) and of their key, the parts that this key shares with
    the one before, how many full keys came again and whether a row beside has this key."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, held = TaskContext.get().partitionId(), 0, None, None
        group = sub = parts = many = 0
        for b in batches:
            if not b.num_rows:
                continue
            n, m = b.num_rows, _matrix(b.column(b.schema.get_field_index("key")))
            # no rank is -2, so the first row of a range differs from a row before it
            before = np.vstack([np.full((1, GROWTH), -2) if last is None else last, m[:-1]])
            shared = shared_parts(before, m)
            number = at + np.arange(n)
            groups = np.maximum.accumulate(np.where(shared > 0, group, number))
            new = shared < GROWTH
            subs = np.maximum.accumulate(np.where(new, number, sub))
            own = np.where(subs >= at, shared[np.maximum(subs - at, 0)], parts)
            twin = ~new
            twin[:-1] |= ~new[1:]
            repeats = many + np.cumsum(~new & (m[:, -1] >= 0))
            if held is not None:
                if not new[0]:
                    held[1]["_twin"] = np.array([True])
                yield _added(held[0], names, _end=[False], **held[1])
            more = {"_part": np.full(n, part, dtype=np.int64), "_at": number, "_group": groups,
                    "_sub": subs, "_parts": own, "_repeats": repeats, "_twin": twin}
            yield _added(b[:-1], names, _end=np.zeros(n - 1, dtype=bool),
                         **{k: v[:-1] for k, v in more.items()})
            held = b[-1:], {k: v[-1:] for k, v in more.items()}
            last, at = m[-1:], at + n
            group, sub, parts, many = (int(x[-1]) for x in (groups, subs, own, repeats))
        if held is not None:
            yield _added(held[0], names, _end=[True], **held[1])
    return add


_COMPARED = ("_end boolean, _part long, _at long, _group long, _sub long, _parts long, "
             "_repeats long, _twin boolean")
_JOINTS = ["_part", "_start", "_group0", "_sub0", "_parts0", "_before", "_behind"]


def joints(edges: list) -> list[list[int]]:
    """What each range has to know of the others, as ``_JOINTS``: the rows before it, where
    the old group and the key of its first row begin and the parts that this key shares with
    the one before it, and whether the keys across its two edges are equal.  edges: the first
    and last rows of the ranges."""
    ends: dict[int, list] = {}
    for r in sorted(edges, key=lambda r: (r["_part"], r["_at"])):
        ends.setdefault(r["_part"], []).append(r)
    out: list[list[int]] = []
    start, key, group, sub, parts = 0, [], 0, 0, 0
    for part, rows in ends.items():
        first, last = list(rows[0]["key"]), rows[-1]
        same = bool(out) and key == first
        if not (out and key[0] == first[0]):
            group = start
        if not same:
            sub = start
            parts = next((i for i, (a, b) in enumerate(zip(key, first, strict=False)) if a != b),
                         min(len(key), len(first)))
        if same:
            out[-1][-1] = 1
        out.append([part, start, group, sub, parts, int(same), 0])
        group = start + last["_group"] if last["_group"] else group
        sub, parts = (start + last["_sub"], last["_parts"]) if last["_sub"] else (sub, parts)
        start, key = start + last["_at"] + 1, list(last["key"])
    return out


def doubled(tables: Tables, first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(keys, ranked).  keys[k]: p and key at step k of the positions whose groups could split
    there.  ranked: p, d, e, r, step and parts of every position; the place that a group begins
    at is split from the one before by ``parts`` ranks of ``step`` items, equal in both."""
    keys, done, ranked, step = [], [], first, 1
    while True:
        order = _keyed(ranked, step)
        schema = T.StructType([*order.schema.fields, *T.StructType.fromDDL(_COMPARED).fields])
        order = order.repartitionByRange("key", "p").sortWithinPartitions("key", "p")
        t = tables.write(order.mapInArrow(_compared(order.columns), schema),
                         f"suffix-order-{len(keys)}")
        keys.append(t.select("p", "key"))
        edges = t.where("_end or _at = 0").select(
            "_part", "_at", "_group", "_sub", "_parts", "_repeats", "key").collect()
        ranges = joints(edges)
        full = {r["_part"] for r in edges if r["_at"] == 0 and len(r["key"]) == GROWTH}
        again = any(r["_repeats"] for r in edges) or any(
            x[0] in full and x[_JOINTS.index("_before")] for x in ranges)
        t = t.join(_local(tables.spark, ranges, _JOINTS), "_part")
        group = F.when(F.col("_group") == 0, F.col("_group0")).otherwise(
            F.col("_group") + F.col("_start"))
        at_edge = F.col("_sub") == 0
        sub = F.when(at_edge, F.col("_sub0")).otherwise(F.col("_sub") + F.col("_start"))
        parts = F.when(at_edge, F.col("_parts0")).otherwise(F.col("_parts"))
        twin = F.col("_twin") | (at_edge & (F.col("_before") == 1)) \
            | (F.col("_end") & (F.col("_behind") == 1))
        t = t.withColumn("_g", group).withColumn("_s", sub)
        new = F.col("_s") > F.col("_g")
        t = t.select("p", "d", "e", (F.col("key")[0] + F.col("_s") - F.col("_g")).alias("r"),
                     F.when(new, F.lit(step).cast("bigint")).otherwise(F.col("step")).alias("step"),
                     F.when(new, parts).otherwise(F.col("parts")).alias("parts"),
                     (twin & (F.size("key") == GROWTH)).alias("live"))
        done.append(t)
        if not again:
            break
        step *= GROWTH
        ranked = t
        for x in done[:-1]:
            ranked = ranked.unionByName(x.where("not live"))
    for x in done[:-1]:
        t = t.unionByName(x.where("not live"))
    return keys, t.drop("live")


def _lagged(names: list[str]):
    """Rows with their number in the range and p and e of the row before; the last row of a
    range is marked."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, held = TaskContext.get().partitionId(), 0, (-1, -1), None
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                yield _added(held[0], names, _end=[False], **held[1])
            p, e = (np.asarray(b.column(b.schema.get_field_index(c)), dtype=np.int64)
                    for c in ("p", "e"))
            more = {"_part": np.full(len(p), part, dtype=np.int64),
                    "_at": at + np.arange(len(p)), "_q": np.concatenate([[last[0]], p[:-1]]),
                    "_f": np.concatenate([[last[1]], e[:-1]])}
            yield _added(b[:-1], names, _end=np.zeros(len(p) - 1, dtype=bool),
                         **{k: v[:-1] for k, v in more.items()})
            held = b[-1:], {k: v[-1:] for k, v in more.items()}
            at, last = at + len(p), (p[-1], e[-1])
        if held is not None:
            yield _added(held[0], names, _end=[True], **held[1])
    return add


_LAGGED = "_end boolean, _part long, _at long, _q long, _f long"


def _in_order(tables: Tables, ranked: DataFrame) -> DataFrame:
    """The suffix array: idx, p, d, e, and q and f, the p and e of the place before.  Equal
    suffixes stand in order of their positions."""
    schema = T.StructType([*ranked.schema.fields, *T.StructType.fromDDL(_LAGGED).fields])
    t = ranked.repartitionByRange("r", "p").sortWithinPartitions("r", "p")
    t = tables.write(t.mapInArrow(_lagged(ranked.columns), schema), "suffix-array")
    rows, start, q, f = [], 0, -1, -1
    for x in sorted(t.where("_end").select("_part", "_at", "p", "e").collect()):
        rows.append((x["_part"], start, q, f))
        start, q, f = start + x["_at"] + 1, x["p"], x["e"]
    t = t.join(_local(tables.spark, rows, ["_part", "_start", "_q0", "_f0"]), "_part")
    head = F.col("_at") == 0
    return t.select((F.col("_at") + F.col("_start")).alias("idx"), "p", "d", "e", "r", "step",
                    "parts", F.when(head, F.col("_q0")).otherwise(F.col("_q")).alias("q"),
                    F.when(head, F.col("_f0")).otherwise(F.col("_f")).alias("f"))


def common_prefixes(tables: Tables, keys: list[DataFrame], ranked: DataFrame) -> DataFrame:
    """The suffix array: idx (place), p, its d, and l, the items that p's suffix has in common
    with the one before it.  Equal suffixes stand in order of their positions."""
    equal = F.col("idx") > F.col("r")
    length = F.when(equal, F.col("e") - F.col("p")).otherwise(F.col("parts") * F.col("step"))
    t = _in_order(tables, ranked).withColumn("l", length)
    t = t.select("idx", "p", "d", "e", "q", "f", "l",
                 F.when(equal, F.lit(1)).otherwise(F.col("step")).alias("step"))
    todo = None
    for m in range(len(keys) - 2, -1, -1):
        here = t.where(F.col("step") == GROWTH ** (m + 1))
        todo = here if todo is None else todo.unionByName(here)
        x = keys[m].select(F.col("p").alias("_x"), F.col("key").alias("_kx"))
        y = keys[m].select(F.col("p").alias("_y"), F.col("key").alias("_ky"))
        inside = (F.col("p") + F.col("l") < F.col("e")) & (F.col("q") + F.col("l") < F.col("f"))
        at = todo.where(inside).select(
            "idx", "p", "d", "e", "q", "f", "l", "step",
            (F.col("p") + F.col("l")).alias("_x"), (F.col("q") + F.col("l")).alias("_y"))
        # sizes of few columns of a packed table are guessed too low for a broadcast
        at = at.join(x.hint("merge"), "_x", "left").join(y.hint("merge"), "_y", "left")
        unlike = F.expr("array_position(zip_with(_kx, _ky, (a, b) -> a <=> b), false)")
        more = F.coalesce(unlike - 1, F.lit(0)) * (GROWTH ** m)
        at = at.select("idx", "p", "d", "e", "q", "f", (F.col("l") + more).alias("l"), "step")
        todo = at.unionByName(todo.where(~inside))
        if m:
            todo = tables.write(todo, f"suffix-prefixes-{m}")
    done = t.where("step <= 1")
    return (done if todo is None else done.unionByName(todo)).select("idx", "p", "d", "l")


def capped(stairs: Stairs, depth: int) -> Stairs:
    """What is open once the next common prefix is ``depth``.  Stairs have rising depths and
    rising least positions."""
    out = [s for s in stairs if s[0] < depth]
    deeper = stairs[len(out):]
    return [*out, (depth, deeper[0][1])] if deeper and depth > 0 else out if depth > 0 else []


def merged(a: Stairs, b: Stairs) -> Stairs:
    out: Stairs = []
    for depth, p in sorted([*a, *b], key=lambda s: (-s[0], s[1])):
        if not out or p < out[-1][1]:
            out.append((depth, p))
    return out[::-1]


def climb(p: list[int], shared: list[int], stairs: Stairs) -> tuple[list[int], Stairs]:
    """For each place the depth of the deepest open interval that holds a smaller position,
    from places before it in this direction; ``shared`` is the common prefix with the place
    before.  Also the stairs behind the last place."""
    stairs, out = list(stairs), []
    for here, depth in zip(p, shared, strict=True):
        low = None
        while stairs and stairs[-1][0] >= depth:
            low = stairs.pop()[1]
        if low is not None and depth > 0:
            stairs.append((depth, low))
        while stairs and stairs[-1][1] > here:
            stairs.pop()
        out.append(stairs[-1][0] if stairs else 0)
        stairs.append((_WHOLE, here))
    return out, stairs


_STAIRS = "array<struct<depth:bigint,p:bigint>>"


def _as_rows(stairs: Stairs) -> list[dict]:
    return [{"depth": d, "p": p} for d, p in stairs]


def _as_stairs(rows) -> Stairs:
    return [(int(r["depth"]), int(r["p"])) for r in rows]


def _edges(block: pd.DataFrame) -> pd.DataFrame:
    """What a block alone leaves open at its two edges, and its least common prefixes."""
    block = block.sort_values("idx")
    p, l = block["p"].tolist(), block["l"].tolist()  # noqa: E741
    _, right = climb(p, l, [])
    _, left = climb(p[::-1], [_WHOLE, *l[:0:-1]], [])
    return pd.DataFrame({"block": [block["block"].iloc[0]], "first": [l[0]],
                         "inner": [min(l[1:], default=_WHOLE)],
                         "at_end": [_as_rows(right)], "at_start": [_as_rows(left)]})


def _longest(block: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("idx")
    p, l = block["p"].tolist(), block["l"].tolist()  # noqa: E741
    before, after = (_as_stairs(edge[c].iloc[0]) for c in ("before", "after"))
    a, _ = climb(p, l, before)
    b, _ = climb(p[::-1], [_WHOLE, *l[:0:-1]], after)
    got = np.maximum(a, b[::-1])
    return pd.DataFrame({"p": p, "d": block["d"], "n": got})[got > 0]


def open_edges(edges: list) -> list[tuple[int, list, list]]:
    """(block, stairs that come in from the left, from the right) of blocks in order."""
    left, before = [], []
    for e in edges:
        before.append(left)
        left = merged(capped(left, min(e["first"], e["inner"])), _as_stairs(e["at_end"]))
    right, after = [], []
    for e in reversed(edges):
        after.append(right)
        right = capped(merged(capped(right, e["inner"]), _as_stairs(e["at_start"])), e["first"])
    return [(e["block"], _as_rows(x), _as_rows(y))
            for e, x, y in zip(edges, before, reversed(after), strict=True)]


def earlier(tables: Tables, array: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """p, its d, and n: the longest prefix, in items, of p's suffix that stands at a smaller
    position too; no row where there is none.  The driver sees one row a block."""
    a = array.select(F.shiftright("idx", block_bits).alias("block"), "idx", "p", "d", "l")
    a = tables.write(a, "suffix-blocks")
    edges = a.groupBy("block").applyInPandas(
        _edges, f"block bigint, first bigint, inner bigint, at_end {_STAIRS}, at_start {_STAIRS}")
    rows = open_edges(edges.orderBy("block").collect())
    stairs = tables.spark.createDataFrame(
        rows, f"block bigint, before {_STAIRS}, after {_STAIRS}")
    return a.groupBy("block").cogroup(stairs.groupBy("block")).applyInPandas(
        _longest, "p bigint, d bigint, n bigint")
