"""Token counts through a digest cache.

Counts are kept in a Parquet table under (digest of the normalised content, digest of the tokenizer's file). Texts are
joined to it by digest; only distinct texts that miss are encoded, and their counts are appended. As the key holds
the tokenizer's version, another file never reads old counts, and as it holds the content, a text counts once whatever
its copies.

For a plain byte-level BPE file the library's result is that of the file's ranks and its pattern, with special strings
taken out first, and a rank encoder gives it in a quarter of the library's time; files of any other kind go through the
library itself. The pattern looks at characters' classes only, and a test holds the classes of the two against each
other for every code point, so a text's script makes no difference.

The store is parted by the first byte of the digests, and a batch reads the parts that its digests lie in. Its rows are
appended by a Spark job: one that fails leaves no rows behind, and a batch that is counted twice, by a repeated call or
by two calls at once, stores the same count again, of which readers take one.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm.bpe import ByteBPE
from parcelspark.llm.common import cut, drop_cut, file_system, fresh_path

LIMIT = 512


def byte_table() -> dict[str, int]:
    """The printable stand-ins of bytes in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_encoder(spec: dict, pattern: str) -> ByteBPE | None:
    """An encoder of the file's ranks, or None if the file isn't plain byte-level BPE with ids in order of merges."""
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or not t["special"] for t in spec.get("added_tokens", []))
    if not plain:
        return None
    table, vocab = byte_table(), model["vocab"]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    for i, merge in enumerate(model["merges"]):
        if vocab.get("".join(merge.split(" ") if isinstance(merge, str) else merge)) != 256 + i:
            return None
    return ByteBPE({bytes(map(table.__getitem__, k)): v for k, v in vocab.items() if k not in special}, pattern)


def counter(path: str, pattern: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts, as the library for the file gives them with its defaults."""
    if path.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    fast = rank_encoder(spec, pattern)
    special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
    parts = re.compile("|".join(map(re.escape, special))) if special else None

    def one(text: str) -> int:
        if fast is None:
            return len(library.encode(text, add_special_tokens=False).ids)
        spans = parts.split(text) if parts else [text]
        return len(spans) - 1 + sum(len(fast.encode(s)) for s in spans if s)

    return lambda texts: [one(t) for t in texts]


_COUNTERS: dict[tuple[str, str], Callable[[list[str]], list[int]]] = {}


def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def count_tokens(
    docs: DataFrame, path: str, pattern: str, cache: str | None = None, normalise: Callable[[Column], Column] = lambda c: c, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit. Null texts count as empty; ids pass through as they are.

    cache: a folder for stored counts; without one, a fresh folder of the shared one is used. normalise is applied to
    the text before it is digested and encoded: identity, as any change of a byte may change the count.
    """
    spark = docs.sparkSession
    store = f"{cache or fresh_path(spark, 'token-counts')}/tokenizer={file_digest(path)}"
    text = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    part = F.substring(F.hex("digest"), 1, 2).alias("part")
    rows = cut(docs.select(F.col(id_col), F.octet_length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("n_bytes"), digest), "digests")
    asked = rows.select("digest").distinct()
    parts = [r["part"] for r in asked.select(part).distinct().collect()]  # 256 at most

    def read() -> DataFrame:
        return spark.read.schema("digest binary, n_tokens long, part string").parquet(store).where(F.col("part").isin(parts)).select("digest", "n_tokens")

    distinct = docs.select(digest, text.alias("text"))
    if exists(spark, store):
        # Few texts miss a warm cache: their digests are found without moving texts, and bring only their own.
        distinct = distinct.join(cut(asked.join(read(), "digest", "left_anti"), "missing"), "digest", "left_semi")
    misses = distinct.groupBy("digest").agg(F.first("text").alias("text"))  # copies meet on the map side first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _COUNTERS:
            _COUNTERS[path, pattern] = counter(path, pattern)
        for b in batches:
            counts = _COUNTERS[path, pattern]([t.as_py() for t in b.column(1)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    # Counted once and kept, then dealt by ranges of digests, so that a part of the store gets few files, by many tasks.
    counted = cut(misses.mapInArrow(run, "digest binary, n_tokens long"), "counted")
    counted.select("*", part).repartitionByRange("digest").write.mode("append").partitionBy("part").parquet(store)
    drop_cut(counted)
    # Only the batch's digests are looked up, however many the store holds; each comes once, and cut, so that the last
    # join's two sides are plain exchanges and a digest of many copies is a skew that AQE can split.
    known = read().join(asked, "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(cut(known, "counts"), "digest").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
