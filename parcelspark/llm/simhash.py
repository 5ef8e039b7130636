"""SimHash near-duplicates: 64-bit fingerprints, pigeonring candidate filtering, connected components.

Two fingerprints link when they differ in at most 2 bits. By the pigeonring principle, with the 64 bits cut into
three segments on a ring, such a pair has a segment i from which every chain of l consecutive segments differs in
at most floor(2 l / 3) bits: none in segment i, at most one over i and i + 1, at most two over all three. The first
two budgets are the candidates' join key: a fingerprint is listed under (i, segment i, segment i + 1), and looked up
with each single 0 bit of segment i + 1 set, so that of two that differ there only the one lacking the bit asks. The
whole distance is checked last.

Fingerprints that meet under one key lie anywhere in the third segment. A key of more than `split_over` of them is split
by going on with the chain there: the third segment too differs in at most 2 bits, so it is cut into three segments of 7 or 8
bits on a ring of their own, and its first two budgets extend the key in the same way. Under such a key 8 bits at most
are free, so at most 2^8 distinct fingerprints are listed there, however many the table has.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from parcelspark.llm.common import components, cut, drop_cut, slices

MAX_BITS = 2
SHINGLE_WORDS = 3
#: (lowest bit, number of bits) of each segment on the ring, and of each on the ring within a segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
INNER = tuple(tuple((low + at, bits) for at, bits in ((0, 7), (7, 7), (14, size - 14))) for low, size in SEGMENTS)
#: A key that more fingerprints share than this is split.
SPLIT_OVER = 32


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Bit j is set if it is in over half the XXH64 hashes of the word shingles, repeats included; 0 without a word."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # both act on ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hash_of = xxhash.xxh64_intdigest
        hashes = [hash_of(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    total, counts = len(hashes), np.zeros(64, np.int64)
    for at in range(0, total, 8192):  # bounded memory on very long texts
        block = np.array(hashes[at : at + 8192], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp as a signed long. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), values], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def bits_of(fp: Column, at: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(fp, at[0]).bitwiseAND(F.lit((1 << at[1]) - 1))


def chain_keys(ring: tuple[tuple[int, int], ...], i: int) -> Column:
    """Structs (first, second, asks) for chains of a ring that begin at segment i: segment i, and segment i + 1 as it is
    (the entry that is listed) or with one more bit set (those that ask)."""
    first, nxt = bits_of(F.col("fp"), ring[i]), bits_of(F.col("fp"), ring[(i + 1) % 3])
    unset = F.filter(F.array(*[F.lit(1 << j).cast("long") for j in range(ring[(i + 1) % 3][1])]), lambda bit: nxt.bitwiseAND(bit) == 0)
    entry = lambda second, asks: F.struct(first.alias("first"), second.alias("second"), F.lit(asks).alias("asks"))
    return F.concat(F.array(entry(nxt, False)), F.transform(unset, lambda bit: entry(nxt.bitwiseOR(bit), True)))


def outer_keys() -> Column:
    """Structs (key, asks) of all three chains: two segments have at most 43 bits, so with two more for i a key is a long."""
    key = lambda x, i: F.shiftleft(x["first"], 24).bitwiseOR(x["second"]).bitwiseOR(F.lit(i << 60))
    return F.concat(*[F.transform(chain_keys(SEGMENTS, i), lambda x: F.struct(key(x, i).alias("key"), x["asks"].alias("asks"))) for i in range(3)])


def inner_keys() -> Column:
    """Structs (sub, asks) for the rest of a chain: keys over the segment that `key` leaves free, 18 bits at most."""

    def of(i: int) -> Column:
        ring = INNER[(i + 2) % 3]
        sub = lambda x, j: F.shiftleft(x["first"], 8).bitwiseOR(x["second"]).bitwiseOR(F.lit(j << 20))
        return F.concat(*[F.transform(chain_keys(ring, j), lambda x: F.struct(sub(x, j).alias("sub"), x["asks"].alias("asks"))) for j in range(3)])

    which = F.shiftrightunsigned("key", 60)
    return F.when(which == 0, of(0)).when(which == 1, of(1)).otherwise(of(2))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def pigeonring_edges(fps: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Edges (a, b) of all pairs of distinct fingerprints `fp` within MAX_BITS."""
    # Each fingerprint gives dozens of rows, so their few bytes are dealt to as many tasks as a shuffle has.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = cut(fps.select("fp").repartition(tasks, "fp").select("fp", F.inline(outer_keys())), "ring")
    # Two that only ask don't meet, so a key counts if one is listed there.
    size = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("asks").alias("none")).where("n > 1 and not none")
    shared = cut(keys.join(size.select("key", (F.col("n") > split_over).alias("hot")), "key"), "ring-shared")
    rest = shared.where("not hot").select("key", F.lit(0).cast("long").alias("sub"), "fp", "asks", F.lit(False).alias("again"))
    hot = shared.where("hot").select("key", "fp", "asks", F.explode(inner_keys()).alias("k")).select("key", "k.sub", "fp", "asks", F.col("k.asks").alias("again"))
    each = cut(rest.unionByName(hot), "ring-keys")
    x = each.select("key", "sub", F.col("fp").alias("a"), F.col("asks").alias("a1"), F.col("again").alias("a2"))
    y = each.select("key", "sub", F.col("fp").alias("b"), F.col("asks").alias("b1"), F.col("again").alias("b2"))
    # On either ring one of the two at least has to be listed.
    near = x.join(y, ["key", "sub"]).where((F.col("a") < F.col("b")) & ~(F.col("a1") & F.col("b1")) & ~(F.col("a2") & F.col("b2")))
    out = cut(near.where(distance(F.col("a"), F.col("b")) <= MAX_BITS).select("a", "b").distinct(), "edges")
    drop_cut(keys, shared, each)
    return out


def fingerprint_groups(fp: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """(fp, root) of every distinct fingerprint: those that chains of links connect share a root."""
    own = cut(fp.select("fp").distinct(), "distinct")
    roots = components(pigeonring_edges(own, split_over)).withColumnRenamed("node", "fp")
    return cut(own.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "groups")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", split_over: int = SPLIT_OVER) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other; repeated ids and rows are each returned. A null
    id is returned too, and names a component only where it has no other. An empty table gives no rows.
    """
    fp = cut(fingerprints(docs, id_col, text_col), "fingerprints")
    groups = fingerprint_groups(fp, split_over)
    least = fp.groupBy("fp").agg(F.min("id").alias("least")).join(groups, "fp")
    smallest = least.groupBy("root").agg(F.min("least").alias("component_id"))
    out = fp.join(cut(groups.join(smallest, "root").select("fp", "component_id"), "labels"), "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """docs with one row of each near-duplicate group: that with the smallest doc_id, null ids last. Same columns.

    Of rows with the same id and fingerprint one stays.
    """
    at, names = docs.columns.index("text"), docs.columns
    own = "__fp"
    while own in names:
        own = f"_{own}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = pa.array([fingerprint(t.as_py()) for t in b.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, values], [*names, own])

    schema = StructType([*docs.schema.fields, StructField(own, LongType())])
    rows = cut(docs.mapInArrow(run, schema), "with-fingerprint")
    fp = rows.select(F.col(own).alias("fp"), F.col("doc_id").alias("id"))
    least = fp.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("least"))
    chosen = least.join(fingerprint_groups(fp, split_over), "fp").groupBy("root").agg(F.min(F.struct("least", "fp")).alias("c"))
    chosen = cut(chosen.select(F.col("c.fp").alias("fp"), F.col("c.least.id").alias("id")), "chosen")
    stay = rows.join(chosen, (rows[own] == chosen["fp"]) & rows["doc_id"].eqNullSafe(chosen["id"]), "left_semi")
    return stay.dropDuplicates(["doc_id", own]).select(*names)
