"""Exact top-k by inner product: a KD-tree for each shard, best-first search, a kth score that travels between shards.

Vectors are dealt by space: the median splits of a bounded sample part it into cells, and a cell's rows into shards of a
bounded size by a hash of their id. Each shard becomes a tree: median splits (by count, so equal vectors never stop it)
of the axis with the widest spread, down to leaves of `leaf` rows, with a tight bounding box and the smallest id in each
node. For a query, a box bounds the score of all that lie in it, from its nearer corner on each axis; nodes are taken
from a heap in order of that bound, until the best left can't beat the kth score found, nor equal it with a smaller id.

Between shards it goes the same way, in three waves: a query first searches one shard of the cell with the best bound,
then what can still enter its result of the `near` best cells, then of all others; each wave starts from the kth score of
those before it, and a query is never sent to a cell whose box can't beat that.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelspark.llm.common import cut, drop_cut

EXACT = float(1 << 53)


@dataclass(frozen=True)
class Settings:
    k: int = 5
    shard_rows: int = 8192
    query_rows: int = 16384  # queries that meet a shard in one task
    leaf: int = 64
    near: int = 8  # cells of the second wave
    sample_rows: int = 4096  # rows of a length that place its cells' borders; every row is in a cell
    cells: int = 256
    box_numbers: int = 1 << 16  # cells * length of a vector: what the boxes of one length take
    lengths: int = 16  # the lengths with most rows are parted into cells, other lengths are one cell each


@dataclass
class Tree:
    ids: np.ndarray  # of rows, in the order of leaves
    rows: np.ndarray
    low: np.ndarray  # node boxes
    high: np.ndarray
    span: np.ndarray  # first and last row of each node
    child: np.ndarray  # the two children, or -1
    least: np.ndarray  # smallest id in each node


def build(ids: np.ndarray, rows: np.ndarray, leaf: int) -> Tree:
    order = np.arange(len(ids))
    low, high, span, child, least = [], [], [], [], []

    def node(a: int, b: int) -> int:
        part = rows[order[a:b]]
        at = len(span)
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        span.append((a, b))
        child.append((-1, -1))
        least.append(ids[order[a:b]].min())
        return at

    todo = [(node(0, len(ids)))]
    while todo:
        at = todo.pop()
        a, b = span[at]
        if b - a <= leaf or (low[at] == high[at]).all():
            continue
        axis, middle = int((high[at] - low[at]).argmax()), (a + b) // 2
        order[a:b] = order[a:b][np.argpartition(rows[order[a:b], axis], middle - a)]
        child[at] = node(a, middle), node(middle, b)
        todo += child[at]
    return Tree(ids[order], rows[order], np.array(low), np.array(high), np.array(span), np.array(child), np.array(least))


def search(tree: Tree, query_id: int, query: np.ndarray, k: int, bounds: np.ndarray, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
    """The best k (score, -id) of the tree besides the query's own rows that can enter the result, given a kth one found elsewhere."""
    best: list[tuple[int, int]] = []  # a min-heap
    heap = [(-bounds[0], 0)]
    while heap:
        bound, at = heapq.heappop(heap)
        limit = best[0] if len(best) == k else None
        if floor is not None and (limit is None or floor > limit):
            limit = floor
        if limit is not None and (-bound, -int(tree.least[at])) < limit:
            if -bound < limit[0]:
                break
            continue
        left, right = tree.child[at]
        if left >= 0:
            heapq.heappush(heap, (-bounds[left], int(left)))
            heapq.heappush(heap, (-bounds[right], int(right)))
            continue
        a, b = tree.span[at]
        got, ids = tree.rows[a:b] @ query, tree.ids[a:b]
        near = np.flatnonzero(got >= limit[0]) if limit is not None else range(b - a)
        for i in near:
            if ids[i] == query_id:
                continue
            x = (int(got[i]), -int(ids[i]))
            if floor is not None and x < floor:
                continue
            if len(best) < k:
                heapq.heappush(best, x)
            elif x > best[0]:
                heapq.heapreplace(best, x)
    return best


def node_bounds(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """For each query and node, the largest inner product that a point of the node's box can have."""
    return np.maximum(queries, 0) @ tree.high.T + np.minimum(queries, 0) @ tree.low.T


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, and neither a null nor a non-finite component."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vec.isNotNull() & ~F.exists(vec, bad)


def integers(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, dim) of the rows that take part: v is floor(256 x), x as double."""
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    df = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("x")).where(F.col("id").isNotNull() & usable(F.col("x")))
    return df.select("id", F.transform("x", lambda x: F.floor(x * 256).cast("long")).alias("v"), F.size("x").alias("dim"))


def least_type(*arrays: np.ndarray) -> str:
    """The smallest of three integer types that holds all values."""
    low, high = min((int(x.min()) for x in arrays if x.size), default=0), max((int(x.max()) for x in arrays if x.size), default=0)
    return next(t for t, top in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if -top <= low and high < top)


def pack(t: Tree) -> list[bytes]:
    kind = least_type(t.rows, t.low, t.high)
    return [kind.encode(), t.ids.astype("<i8").tobytes(), *(x.astype(kind).tobytes() for x in (t.rows, t.low, t.high)), t.span.astype("<i4").tobytes(), t.child.astype("<i4").tobytes(), t.least.astype("<i8").tobytes()]


def unpack(dim: int, blob: list[bytes]) -> Tree:
    kind, ids, rows, low, high, span, child, least = map(bytes, blob)
    of = lambda x, t: np.frombuffer(x, t)
    ids, least = of(ids, "<i8"), of(least, "<i8")
    box = lambda x: of(x, kind.decode()).reshape(len(least), dim).astype(np.int64)
    return Tree(ids, of(rows, kind.decode()).reshape(len(ids), dim).astype(np.int64), box(low), box(high), of(span, "<i4").reshape(-1, 2), of(child, "<i4").reshape(-1, 2), least)


def exact_floats(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles give the inner products of rows of a and b exactly: their products are much faster."""
    top = lambda x: float(np.abs(x).max()) if x.size else 0.0
    return top(a) * top(b) * a.shape[1] < EXACT


def borders(sample: np.ndarray, cells: int) -> list | int:
    """Median splits of a sample as nested [axis, value, below, from there on], cells as whole numbers in order."""
    made = 0

    def part(rows: np.ndarray, parts: int) -> list | int:
        nonlocal made
        if parts > 1 and len(rows) > 1 and rows.shape[1]:
            axis = int((rows.max(axis=0) - rows.min(axis=0)).argmax())
            value = int(np.sort(rows[:, axis])[len(rows) // 2])
            below = rows[:, axis] < value
            if below.any():
                return [axis, value, part(rows[below], parts // 2), part(rows[~below], parts - parts // 2)]
        made += 1
        return made - 1

    return part(sample, cells)


def cell_of(tree: list | int, v: Column) -> Column:
    if isinstance(tree, int):
        return F.lit(tree)
    axis, value, below, other = tree
    return F.when(F.get(v, axis) < value, cell_of(below, v)).otherwise(cell_of(other, v))


def sampled_borders(base: DataFrame, s: Settings) -> dict[int, list | int]:
    """Borders of the lengths with most rows, from about sample_rows rows each, chosen by a hash of their ids."""
    sizes = base.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(s.lengths).collect()
    out: dict[int, list | int] = {}
    for r in sizes:
        cells = min(s.cells, max(1, s.box_numbers // max(r["dim"], 1)), -(-r["count"] // s.shard_rows))
        if cells > 1:
            share = min(1.0, s.sample_rows / r["count"])
            draw = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
            got = base.where((F.col("dim") == r["dim"]) & draw).select("v").limit(2 * s.sample_rows).collect()
            out[r["dim"]] = borders(np.array([x["v"] for x in got], np.int64).reshape(len(got), r["dim"]), cells)
    return out


def make_tree(leaf: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(part["id"].to_numpy(), kind="stable")
        ids, dim = part["id"].to_numpy()[order], int(key[0])
        vecs = np.concatenate([np.zeros(0, np.int64), *part["v"].to_numpy()[order]]).astype(np.int64).reshape(len(ids), dim)
        t = build(ids, vecs, leaf)
        return pd.DataFrame({"dim": [dim], "cell": [int(key[1])], "piece": [int(key[2])], "tree": [pack(t)], "low": [t.low[0]], "high": [t.high[0]]})

    return make


def meet(k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The search of one block of queries in one shard's tree."""

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            dim = int(key[0])
            t = unpack(dim, left["tree"].iloc[0])
            asked = np.concatenate([np.zeros(0, np.int64), *right["v"].to_numpy()]).astype(np.int64).reshape(len(right), dim)
            # Every row lies in the root's box, so its corners tell how large a number can be.
            kind = np.float64 if exact_floats(np.stack([t.low[0], t.high[0]]), asked) else np.int64
            t.rows, t.low, t.high, asked = (x.astype(kind) for x in (t.rows, t.low, t.high, asked))
            ids, us, kth, kth_id = (right[c].to_numpy() for c in ("id", "u", "kth", "kth_id"))
            for at in range(0, len(asked), 256):
                bounds = node_bounds(t, asked[at : at + 256])
                for i in range(len(bounds)):
                    j = at + i
                    floor = None if pd.isna(kth[j]) else (int(kth[j]), -int(kth_id[j]))
                    for score, minus in search(t, int(ids[j]), asked[j], k, bounds[i], floor):
                        out.append((int(ids[j]), int(us[j]), -minus, score))
        return pd.DataFrame(out, columns=["query_id", "u", "vec_id", "score"]).astype("int64")

    return run


Boxes = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def route(boxes: Boxes, wave: int, near: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to each query the best cell, and the cells it goes to in a wave: those (the best, the `near` best, the others)
    whose box can still beat its kth score, or reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, chosen, home = b.column("dim").to_numpy(), [None] * b.num_rows, np.zeros(b.num_rows, np.int32)
            kth = b.column("kth").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in boxes:
                    for i in at:
                        chosen[i] = [0] if wave < 2 else []
                    continue
                cells, low, high = boxes[dim]
                asked = np.array(b.column("v").take(pa.array(at)).to_pylist(), np.int64).reshape(len(at), dim)
                kind = np.float64 if exact_floats(np.concatenate([low, high]), asked) else np.int64
                bounds = np.maximum(asked, 0).astype(kind) @ high.astype(kind).T + np.minimum(asked, 0).astype(kind) @ low.astype(kind).T
                order = np.argsort(-bounds, axis=1, kind="stable")
                home[at] = cells[order[:, 0]]
                part = order[:, :1] if wave == 0 else order[:, :near] if wave == 1 else order[:, near:]
                for i, row, own in zip(at, part, bounds, strict=True):
                    chosen[i] = [int(cells[c]) for c in row if kth[i] is None or own[c] >= kth[i]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(chosen, pa.list_(pa.int32()))], [*b.schema.names, "home", "cells"])

    return run


def top_k(rows: DataFrame, queries: DataFrame, s: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each query its k best rows of the same length by inner product, ties to smaller ids.

    A query's own id never counts as its result; repeated ids in rows are candidates each by itself, a query row that
    is repeated is asked once. Null vectors, those with null or non-finite components, and null ids, take no part; empty
    vectors score 0 with each other. With fewer than k candidates all are returned; an empty table gives none. Scores
    have to fit a long.
    """
    base = cut(integers(rows, id_col, vec_col), "vectors")
    ask = cut(integers(queries, id_col, vec_col).distinct(), "queries")
    blocks = max(1, -(-ask.count() // s.query_rows))
    cell = F.lit(0)
    for dim, tree in (known := sampled_borders(base, s)).items():
        cell = F.when(F.col("dim") == dim, cell_of(tree, F.col("v"))).otherwise(cell)
    located = cut(base.withColumn("cell", cell), "located") if known else base.withColumn("cell", cell)
    # One row for each cell of a length.
    sizes = cut(located.groupBy("dim", "cell").agg(F.ceil(F.count("*") / s.shard_rows).cast("int").alias("pieces")), "cells")
    piece = F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")
    dealt = located.join(sizes, ["dim", "cell"]).select("dim", "cell", piece.alias("piece"), "id", "v")
    trees = cut(dealt.groupBy("dim", "cell", "piece").applyInPandas(make_tree(s.leaf), "dim int, cell int, piece int, tree array<binary>, low array<long>, high array<long>"), "trees")
    drop_cut(base, located)
    sides = trees.where(F.col("dim").isin(list(known))).select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("axis", "x"))
    got = sides.groupBy("dim", "cell", "axis").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high")).collect() if known else []  # lengths * box_numbers at most
    boxes: Boxes = {}
    for dim in known:
        own = sorted((r["cell"], r["axis"], r["low"], r["high"]) for r in got if r["dim"] == dim)
        table = np.array(own, np.int64).reshape(-1, dim, 4)
        boxes[dim] = table[:, 0, 0], table[:, :, 2], table[:, :, 3]
    schema = "query_id long, u long, vec_id long, score long"
    block = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")
    ask = ask.select("id", "v", "dim", F.xxhash64("v").alias("u"), block.alias("block"))

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id", "u").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= s.k)

    found, nothing = None, F.lit(None).cast("long")
    first = F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int")  # the shard of the best cell that is searched first
    on = ["dim", "cell", "piece", "block"]
    for wave in range(3):
        so_far = ask.withColumns({"kth": nothing, "kth_id": nothing})
        if found is not None:
            kth = best(found).where(F.col("rank") == s.k).select(F.col("query_id").alias("id"), "u", F.col("score").alias("kth"), F.col("vec_id").alias("kth_id"))
            so_far = ask.join(kth, ["id", "u"], "left")
        routed = so_far.select("id", "u", "v", "dim", "block", "kth", "kth_id").mapInArrow(
            route(boxes, wave, s.near), "id long, u long, v array<long>, dim int, block int, kth long, kth_id long, home int, cells array<int>"
        )
        to = routed.select("*", F.explode("cells").alias("cell")).drop("cells").join(sizes, ["dim", "cell"])
        if wave == 0:
            to = to.withColumn("piece", first)
        else:
            to = to.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).where((F.col("cell") != F.col("home")) | (F.col("piece") != first))
        asked = cut(to.select(*on, "id", "u", "v", "kth", "kth_id"), "asked")
        # A tree goes only to the blocks of queries that ask it.
        needed = trees.select("dim", "cell", "piece", "tree").join(asked.select(*on).distinct(), on[:3])
        needed = needed.toDF(*needed.columns)  # as columns of its own beside those of `asked`
        new = needed.groupBy(*on).cogroup(asked.groupBy(*on)).applyInPandas(meet(s.k), schema)
        found = cut(new if found is None else found.unionByName(new), f"wave-{wave}")
        drop_cut(asked)
    drop_cut(trees)
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
