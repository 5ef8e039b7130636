"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Both models are distributions over hashed byte n-grams: the raw one counts every document, the target one the labelled
good documents (a bounded sample of their ids, a parameter), smoothed towards the raw one, so that n-grams too rare to
tell weigh nothing. A document's log weight is the sum over its n-grams of log target - log raw probability. Adding
Gumbel noise, made from a hash of the row, to the log weights and taking the k largest samples k documents without
replacement with probabilities in proportion to their weights. The k-th key is found by counting keys in ever finer
ranges, so that nothing is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import cut


@dataclass(frozen=True)
class Settings:
    """target_rows bounds the labelled good documents that the target model counts: those whose ids have the smallest
    hashes. keep_share of None: the share of good rows among the labelled ones."""

    buckets: int = 1 << 16
    grams: tuple[int, ...] = (2, 3, 4)
    smoothing: float = 30.0  # occurrences as in raw text that each n-gram of the target model starts with
    target_rows: int = 20_000
    keep_share: float | None = None
    noise: float = 1.0
    seed: int = 11
    block: int = 1 << 16  # bytes hashed at once


def hashes(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Hash numbers of a text's byte n-grams, white space runs as one space, in blocks that together cover it all."""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    top = max(s.grams)
    for at in range(0, len(data), s.block):
        part, whole = data[at : at + s.block + top - 1], min(s.block, len(data) - at)
        value = np.zeros(len(part), np.uint32)
        for n in range(1, min(top, len(part)) + 1):
            value = value[: len(part) - n + 1] * np.uint32(0x01000193) ^ part[n - 1 :]
            if n in s.grams:
                mixed = (value ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield (mixed >> np.uint32(15))[:whole] % np.uint32(s.buckets)


def count(docs: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) n-gram counts by bucket, of rows (text, target): summed in each task, then by bucket. The driver gets
    two numbers for each bucket, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = np.zeros((2, s.buckets), np.int64), ([], []), 0

        def add() -> None:
            for row in (0, 1):
                if held[row]:
                    sums[row] += np.bincount(np.concatenate(held[row]), minlength=s.buckets)
                    held[row].clear()

        for b in batches:
            for text, target in zip(b.column(0), b.column(1), strict=True):
                for h in hashes(text.as_py() or "", s):
                    held[0].append(h)
                    if target.as_py():
                        held[1].append(h)
                    size += len(h)
                    if size > 1 << 20:
                        add()
                        size = 0
        add()
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0][at]), pa.array(sums[1][at])], ["bucket", "raw", "target"])

    got = docs.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    out = np.zeros((2, s.buckets), np.int64)
    for bucket, raw, target in got:
        out[:, bucket] = raw, target
    return out[0], out[1]


def ratios(raw: np.ndarray, target: np.ndarray, s: Settings) -> np.ndarray:
    """log target - log raw probability of each bucket; 0 where there is no target text."""
    if target.sum() == 0:
        return np.zeros(s.buckets)
    expected = raw * (target.sum() / raw.sum())  # of the target's counts, were it raw text
    return np.log(target + s.smoothing) - np.log(expected + s.smoothing)


def weigh(docs: DataFrame, table: np.ndarray, s: Settings) -> DataFrame:
    """(id, h, n_ngrams, log_weight) of rows (id, h, text), in place."""
    shared = docs.sparkSession.sparkContext.broadcast(table)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            n, w = [], []
            for text in b.column(2):
                parts = [(len(h), float(t[h].sum())) for h in hashes(text.as_py() or "", s)]
                n.append(sum(p[0] for p in parts))
                w.append(sum(p[1] for p in parts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(w, pa.float64())], ["id", "h", "n_ngrams", "log_weight"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, h long, n_ngrams long, log_weight double")


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, rounds: int = 12) -> float | None:
    """The k-th largest value of a double column (fewer values: the least), by counts in ranges that narrow `bins`-fold.

    Each round is one grouping; the driver gets at most `bins` counts. None if there is no value or k is 0.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return None
    k = min(k, n)
    for _ in range(rounds):
        if low >= high:
            break
        width = (high - low) / bins
        if width <= 0:
            break
        inside = df.where(F.col(column).between(low, high))
        place = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
        counts = inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(counts, key=lambda r: -r["b"]):
            if k <= r["n"]:
                low, high = r["lo"], r["hi"]
                break
            k -= r["n"]
    return low


def target_ids(labels: DataFrame, n_good: int, s: Settings) -> DataFrame:
    """(__t): the target_rows good ids with the smallest seeded hashes, of equals the smaller id; all, if there are fewer.

    So that no task sorts more than about twice as many, ids with hashes far beyond the wanted ones are left out first:
    that share of them is expected to be 1.2 target_rows and 1000 more.
    """
    h = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30))
    share = min(1.0, (1.2 * s.target_rows + 1000) / max(n_good, 1))
    low = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__t"), h.alias("__h")).where(F.col("__h") <= int(share * (1 << 30)))
    return low.distinct().orderBy("__h", "__t").limit(s.target_rows).select("__t")


def select(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per row of docs: doc_id, n_ngrams, log_weight, kept (whether the sample holds it).

    Texts without a word (null and empty ones too) have log weight 0 and are not sampled. Rows equal in id and text share
    their noise and stay or go together: with such rows, or by chance with equal keys, at the k-th place, all of them stay
    and there are more than k. Without good labels all weights are 1. Labels without a quality or an id don't count.
    """
    good = F.col("quality") == 1
    known = labels.where("doc_id is not null and quality is not null")
    n, n_good = known.agg(F.count("*"), F.sum(F.when(good, 1).otherwise(0))).first()
    n_good = n_good or 0
    ids = target_ids(known, n_good, s)
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    flagged = rows.join(F.broadcast(ids), rows["id"] == ids["__t"], "left")  # target_rows bounds it
    table = ratios(*count(flagged.select("text", F.col("__t").isNotNull().alias("target")), s), s)
    weighed = cut(weigh(rows.select("id", F.xxhash64("id", "text").alias("h"), "text"), table, s), "weights")
    u = (F.shiftrightunsigned(F.xxhash64("h", F.lit(s.seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weighed.withColumn("key", F.when(F.col("n_ngrams") > 0, F.col("log_weight") - s.noise * F.log(-F.log(u))))
    total = weighed.where("n_ngrams > 0").count()
    share = s.keep_share if s.keep_share is not None else (n_good / n if n else 1.0)
    least = kth_largest(keyed, "key", round(share * total))
    kept = F.coalesce(F.col("key") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return keyed.select(F.col("id").alias("doc_id"), "n_ngrams", "log_weight", kept.alias("kept"))
