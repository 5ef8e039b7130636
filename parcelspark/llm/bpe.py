"""Byte-level BPE as a monoid: halves are encoded by themselves, neighbours joined by re-encoding a window at the seam.

An element is (text, ids). Two facts bound what a join has to look at:

* A single space between two visible characters begins a piece of the pattern, whatever stands around: ids left and
  right of it don't depend on each other. So a join re-encodes from the last such space of the left text to the first
  of the right one, widening its window until both sides hold one (or all of a side is in it).
* Within one piece, ids are its encoding exactly if each adjacent pair is the encoding of its own bytes. So where a
  long piece is cut, a window of ids at the seam is re-encoded and widened until its outermost ids come out
  unchanged; all pairs outside, and those at its edges, are then as they were on either side.

Decoding concatenates bytes up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import slices

LEAF_CHARS = 4096
LEAF_BYTES = 256
SEAM_CHARS = 64
SEAM_IDS = 8
_SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")


class ByteBPE:
    """Encoder and decoder for a rank file and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.bytes_of = dict(zip(ranks.values(), ranks.keys(), strict=True))
        self.lengths = {k: len(v) for k, v in self.bytes_of.items()}
        self.single = self.plain._encode_single_piece

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    # texts

    def encode(self, text: str) -> list[int]:
        return self.encode_span(text, 0, len(text))

    def encode_span(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= LEAF_CHARS:
            return self.leaf(text[low:high])
        middle = (low + high) // 2
        return self.join(text, low, middle, high, self.encode_span(text, low, middle), self.encode_span(text, middle, high))

    def leaf(self, text: str) -> list[int]:
        return self.plain.encode_ordinary(text) if _SAFE.search(text) or len(text) <= LEAF_BYTES else self.region(text)

    def join(self, text: str, low: int, middle: int, high: int, left: list[int], right: list[int]) -> list[int]:
        """Ids of text[low:high] from those of text[low:middle] and text[middle:high]."""
        reach = SEAM_CHARS
        while True:
            a, b = max(low, middle - reach), min(high, middle + reach)
            begin = low if a == low else None
            for m in _SAFE.finditer(text, a, middle):
                # the safe space and both its neighbours have to be in the left text
                if m.start() > low and m.start() + 1 < middle:
                    begin = m.start()
            after = _SAFE.search(text, middle + 1, b)
            end = after.start() if after and after.start() + 1 < b else high if b == high else None
            if begin is not None and end is not None:
                break
            reach *= 2
        if begin == low and end == high:
            return self.region(text[low:high])
        ids = self.keep(left, len(text[begin:middle].encode()), last=True)
        ids += self.region(text[begin:end])
        return ids + self.keep(right, len(text[middle:end].encode()), last=False)

    def keep(self, ids: list[int], drop: int, last: bool) -> list[int]:
        """ids without those at one end that make up `drop` bytes."""
        n, size = 0, 0
        while size < drop:
            size += self.lengths[ids[-1 - n] if last else ids[n]]
            n += 1
        assert size == drop, "a safe space is always an edge between ids"
        return ids[: len(ids) - n] if last else ids[n:]

    def region(self, text: str) -> list[int]:
        """Ids of a stretch without safe edges, or of a window: piece by piece."""
        out: list[int] = []
        for piece in self.pieces.findall(text):
            out += self.piece(piece.encode())
        return out

    # one piece

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.single(data)
        middle = len(data) // 2
        return self.join_piece(self.piece(data[:middle]), self.piece(data[middle:]))

    def join_piece(self, left: list[int], right: list[int]) -> list[int]:
        width = SEAM_IDS
        while True:
            a, b = left[-width:], right[:width]
            fresh = self.single(b"".join(map(self.bytes_of.__getitem__, a + b)))
            if (len(a) == len(left) or fresh[0] == a[0]) and (len(b) == len(right) or fresh[-1] == b[-1]):
                return left[: len(left) - len(a)] + fresh + right[len(b) :]
            width *= 2

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of ids, joined up a tree of halves."""
        if len(ids) <= LEAF_CHARS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """The tokenizer, read once in each Python worker."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.from_file(path, pattern)
    return _LOADED[path, pattern]


def encode_docs(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs, in place: id, n_tokens, ids_sha256, decoded_sha256, and with_ids ids and the decoded text.

    A null text counts as empty: no ids, hashes of nothing. Null and repeated ids are returned as they are.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]
    kinds = [pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int32()), pa.string()] * with_ids]

    def one(codec: ByteBPE, text: str | None) -> tuple:
        ids = codec.encode(text or "")
        data = codec.decode(ids)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        return len(ids), digest(" ".join(map(str, ids)).encode()), digest(data), *((ids, data.decode("utf-8", "replace")) if with_ids else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = loaded(path, pattern)
        for b in slices(batches):
            rows = [one(codec, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names)

    ddl = f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.mapInArrow(run, ddl)
