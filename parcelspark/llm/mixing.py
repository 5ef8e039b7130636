"""Mix sources to target weights: token blocks, multinomial counts per output shard, index permutations, a join by index.

The words of a source, its documents in a fixed order, are packed into blocks of `block_words` (a block may hold parts
of several documents, a document may lie in several blocks). The output is a row of slots, dealt into output shards; how
many slots of a shard each source gets is drawn. The draws of all shards are multinomial with the sources' shares,
conditioned on what the sources get in all: the slots nearest their targets. Drawn without that condition a source of
80 slots would be off its target by 11 % as a rule, and a source whose target is `most` passes would go over them in half
of all draws. Multinomial counts under that condition are multivariate hypergeometric: they are drawn down a tree of
halves of the shards, so that any task can find a shard's counts, and the sources' slots before it, from seeds alone.
The k-th slot of a source takes block permutation(k mod n) of its n blocks, with another permutation in each pass over
them, so that no block comes again before all others came, and none in more than `most` passes. Documents join the
drawn blocks by (source, block).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm.common import cut, prefix_sums
from parcelspark.llm.common import slices as batch_slices

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block_words: int = 128
    shard_slots: int = 1 << 10
    seed: int = 20
    max_sources: int = 100_000  # the sources' totals are planned on the driver; beyond this the plan is refused


def targets(sizes: list[tuple[str | None, int]], s: Settings = Settings()) -> list[tuple[str | None, int, float]]:
    """(source, size, target words) by code point, null last: all sizes shared by weight, none above `most` times its own."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [s.weights[i % len(s.weights)] for i in range(len(rows))]
    out: list[float | None] = [None] * len(rows)
    left, total = set(range(len(rows))), float(sum(n for _, n in rows))
    while left:
        rest = max(0.0, total - sum(x for x in out if x is not None))
        unit = rest / sum(weight[i] for i in left)
        over = [i for i in left if unit * weight[i] > s.most * rows[i][1]]
        for i in over or left:
            out[i] = float(s.most * rows[i][1]) if over else unit * weight[i]
        left -= set(over or left)
    return [(name, n, float(t)) for (name, n), t in zip(rows, out, strict=True)]


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of each number i[j] below n[j] under the permutation of 0..n[j]-1 with key[j]: four Feistel rounds on the
    fewest even number of bits that hold n[j] - 1, repeated until the image is below n[j]."""
    u, sizes = np.uint64, np.unique(n)
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in sizes], u)[np.searchsorted(sizes, n)]
    mask, base = (u(1) << half) - u(1), key.astype(u) * u(4)

    def once(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        a, b = x >> half[at], x & mask[at]
        for r in range(4):
            mixed = (b + (base[at] + u(r)) * u(0x9E3779B97F4A7C15)) * u(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> u(29))) * u(0x94D049BB133111EB)
            a, b = b, a ^ ((mixed >> u(32)) & mask[at])
        return (a << half[at]) | b

    at = np.arange(len(i))
    out = once(i.astype(u), at)
    while len(at := at[out[at] >= n[at].astype(u)]):
        out[at] = once(out[at], at)
    return out.astype(np.int64)


def slots_of(plan: list[tuple[int, int, float]], most: int) -> np.ndarray:
    """Slots that each source of (sid, blocks, expected slots) gets in all: the expectation rounded down, and one slot more
    for those with the largest rest until their sum is that of the expectations. None gets more than `most` passes."""
    want, limit = np.array([e for _, _, e in plan]), np.array([most * n for _, n, _ in plan], np.int64)
    whole = np.minimum(np.floor(want + 1e-9).astype(np.int64), limit)
    left = int(np.rint(want.sum())) - int(whole.sum())
    for at in np.argsort(whole - want, kind="stable"):
        if left > 0 and whole[at] < limit[at]:
            whole[at] += 1
            left -= 1
    return whole


def split(totals: np.ndarray, slots: int, rng: np.random.Generator) -> np.ndarray:
    """A draw of `slots` out of slots of sources, `totals` of each, without replacement.

    numpy draws exactly up to 10^9 slots in all. Beyond that the top of the tree takes each source's normal limit,
    kept within what is possible.
    """
    if totals.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(totals, slots, method="marginals")
    out, rest, need = np.zeros_like(totals), int(totals.sum()), slots
    for k, good in enumerate(map(int, totals)):
        low, high = max(0, need - (rest - good)), min(good, need)
        mean = need * (good / rest) if rest else 0.0
        sd = (mean * (1 - good / rest) * ((rest - need) / max(rest - 1, 1))) ** 0.5 if rest else 0.0
        out[k] = min(high, max(low, round(mean + sd * rng.standard_normal())))
        rest, need = rest - good, need - int(out[k])
    return out


def shard_counts(totals: np.ndarray, per_shard: int, seed: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source before it, slots of each source in it) of the shards low .. high - 1.

    The tree's root has all slots; each node's are drawn apart over its two halves with a seed of its own, so whoever
    walks down meets the same counts. Only paths to the wanted shards are walked.
    """
    slots = int(totals.sum())
    todo = [(0, -(-slots // per_shard), np.zeros_like(totals), totals)]
    while todo:
        a, b, before, own = todo.pop()
        if b <= low or a >= high or a >= b:
            continue
        if b - a == 1:
            yield a, before, own
            continue
        middle = (a + b) // 2
        left = split(own, (middle - a) * per_shard, np.random.default_rng([seed, a, b]))
        todo += [(middle, b, before + left, own - left), (a, middle, before, left)]


def drawn_blocks(spark: SparkSession, plan: list[tuple[int, int, float]], s: Settings) -> DataFrame:
    """(sid, block, pass) of all slots, for a plan of (sid, blocks, expected slots)."""
    totals, schema = slots_of(plan, s.most), "sid int, block long, pass int"
    if not totals.sum():
        return spark.createDataFrame([], schema)
    sids, blocks = np.array([p[0] for p in plan], np.int32), np.array([p[1] for p in plan], np.int64)
    seed, most, per_shard = s.seed, s.most, s.shard_slots
    step = 64  # shards that are numbered at once: a bounded number of slots
    shards = -(-int(totals.sum()) // per_shard)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in b.column(0).to_pylist():
                at, k = [], []
                for _, before, own in shard_counts(totals, per_shard, seed, low * step, (low + 1) * step):
                    at.append(np.repeat(np.arange(len(own)), own))
                    k.append(np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(before, own))
                which, number = np.concatenate(at), np.concatenate(k)
                n = blocks[which]
                turn = number // n
                image = permute(number - turn * n, n, seed * 1_000_003 + sids[which].astype(np.int64) * most + turn)
                yield pa.RecordBatch.from_arrays([pa.array(sids[which]), pa.array(image), pa.array(turn.astype("int32"))], ["sid", "block", "pass"])

    return spark.range(-(-shards // step)).mapInArrow(place, schema)


@dataclass
class Plan:
    docs: DataFrame  # id, h, size, sid, __bucket, __pos, __start
    sources: DataFrame  # sid, source_size, target
    drawn: DataFrame  # sid, block, pass


def plan(docs: DataFrame, row_hash: Column, s: Settings, id_col: str, text_col: str, source_col: str) -> Plan:
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), size.alias("size"), row_hash.alias("h")), "mix-sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(s.max_sources + 1).collect()  # refused below, if more
    if len(sums) > s.max_sources:
        raise ValueError(f"over {s.max_sources} sources")
    known = [(i, *t) for i, t in enumerate(targets([(r["source"], r["size"]) for r in sums], s))]
    sources = spark.createDataFrame(known, "sid int, name string, source_size long, target double")
    numbered = rows.join(F.broadcast(sources.select("sid", "name")), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")  # max_sources bounds it
    placed = prefix_sums(numbered, "sid", "size", ["id", "size", "h"], rows=sum(r["n"] for r in sums))
    blocks = [(i, -(-n // s.block_words), t / n * -(-n // s.block_words)) for i, _, n, t in known if n > 0]
    # Written, so that joins see its size: the planner takes what comes out of a range for as small as the range.
    return Plan(placed, sources.drop("name"), cut(drawn_blocks(spark, blocks, s), "mix-drawn"))


def overlaps(p: Plan, s: Settings) -> DataFrame:
    """Documents by the blocks they lie in: `low` and `high` are the words of the document there. Empty ones are left out."""
    b, end = s.block_words, F.col("__start") + F.col("size")
    at = p.docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("__start") / b), F.floor((end - 1) / b))))
    low = F.greatest(F.col("block") * b, F.col("__start")) - F.col("__start")
    return at.withColumn("low", low).withColumn("high", F.least((F.col("block") + 1) * b, end) - F.col("__start"))


def taken(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken (words the mix takes of it, repeats counted).

    Null and empty texts have size 0 and nothing taken. A null source is a source, last in order. Repeated rows each
    have a place of their own. Sources of size 0 have target 0. Reruns on the same rows agree.
    """
    p = plan(docs, F.xxhash64(F.col(text_col).cast("string")), s, id_col, text_col, source_col)
    times = p.drawn.groupBy("sid", "block").agg(F.count("*").alias("times"))
    key = ["id", "size", "sid", "__bucket", "__pos"]
    got = overlaps(p, s).join(times, ["sid", "block"], "left").select(*key, (F.coalesce("times", F.lit(0)) * (F.col("high") - F.col("low"))).alias("taken"))
    none = p.docs.where("size = 0").select(*key, F.lit(0).cast("long").alias("taken"))
    total = got.groupBy(*key).agg(F.sum("taken").alias("taken")).unionByName(none)
    return total.join(F.broadcast(p.sources), "sid").select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def slices(text: str, spans: list[tuple[int, int]], words: int) -> str:
    """The words of text in the given ranges (disjoint, from `low` on), each range with the white space inside it."""
    merged: list[list[int]] = []
    for low, high in sorted(spans):
        if merged and merged[-1][1] == low:
            merged[-1][1] = high
        else:
            merged.append([low, high])
    if merged == [[0, words]]:
        return text
    edges = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[edges[low][0] : edges[high - 1][1]] for low, high in merged)


def mixed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The mix as rows of docs: for each pass over its source, a row per document with the words that pass takes of it.

    Same columns; text is the whole text where a pass takes all of it, n_chars is counted anew. Documents without a
    word are in no block and so in no mix.
    """
    names = docs.columns
    h = F.xxhash64(*[F.col(c) for c in names])
    p = plan(docs, h, s, "doc_id", "text", "source")
    key = ["id", "h", "size", "sid", "__bucket", "__pos"]
    spans = overlaps(p, s).join(p.drawn, ["sid", "block"]).groupBy(*key, "pass").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    # Rows that are equal in all columns share one text; each still has its own spans. The row is packed, so that no
    # column of it can clash with a name used here.
    packed = docs.select(h.alias("__h"), F.col("doc_id").alias("__id"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("__row"))
    texts = packed.dropDuplicates(["__id", "__h"])
    same = (F.col("h") == F.col("__h")) & F.col("id").eqNullSafe(F.col("__id"))
    out = spans.select("id", "h", F.col("size").alias("__size"), F.col("spans").alias("__spans")).join(texts, same)
    out = out.select(*[F.col(f"__row.c{i}").alias(f"c{i}") for i in range(len(names))], "__size", "__spans")
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batch_slices(batches):
            n = b.num_columns
            parts = [slices(t.as_py(), [(x["low"], x["high"]) for x in w.as_py()], z.as_py()) for t, z, w in zip(b.column(at), b.column(n - 2), b.column(n - 1), strict=True)]
            columns = list(b.columns)[: n - 2]
            columns[at] = pa.array(parts, pa.string())
            if chars is not None:
                columns[chars] = pa.array([len(t) for t in parts]).cast(b.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return out.mapInArrow(run, docs.schema)
