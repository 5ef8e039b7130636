"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection.

A text's vector is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes of the lower-cased text, white
space runs as one space); a linear layer and softmax turn it into language probabilities. As the mean and the layer
are both linear, prediction folds embeddings and layer into one score row per hash. After training, a temperature is
fitted on a part of the sample that training didn't see, and the least confidence under which a prediction is
rejected is the one that rejects `reject_share` of right answers there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
_SPACE_RUN = re.compile(r"[\s\d]+")


@dataclass(frozen=True)
class Settings:
    """per_lang bounds the labelled rows of each language that the fit takes: about that many, chosen by a hash of the id.
    max_langs bounds the languages that it learns: those with most rows, of equals the first by name. Others, such as
    misspelt codes of a few rows, are predicted as one of these."""

    per_lang: int = 600
    max_langs: int = 512
    buckets: int = 1 << 15
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    seed: int = 7
    grams: tuple[int, ...] = (2, 3, 4)
    reject_share: float = 0.01
    block: int = 1 << 16  # bytes hashed at once


def hashes(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Hash numbers of the text's n-grams, in blocks of bounded size that together cover it all."""
    data = np.frombuffer((" " + _SPACE_RUN.sub(" ", text.lower()).strip() + " ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    top = max(s.grams)
    for at in range(0, len(data), s.block):
        part = data[at : at + s.block + top - 1]
        whole = min(s.block, len(data) - at)
        value = np.zeros(len(part), np.uint32)
        for n in range(1, top + 1):
            if len(part) < n:
                break
            value = value[: len(part) - n + 1] * np.uint32(0x01000193) ^ part[n - 1 :]
            if n in s.grams:
                mixed = (value ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
                yield (mixed >> np.uint32(16))[:whole] % np.uint32(s.buckets)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages: embeddings times the layer
    bias: np.ndarray
    temperature: float
    least: float
    settings: Settings = field(default_factory=Settings)

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.langs)), 0
        for h in hashes(text, self.settings):
            total += self.scores[h].sum(axis=0, dtype=np.float64)
            n += len(h)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected). Without a letter, or with no language learned: und, 0, rejected."""
        if not text or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, True
        p = softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], s: Settings) -> Model:
    """rows: (language, distinct hashes, their counts), in a fixed order. One in five rows calibrates; the rest train."""
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(s.seed)
    emb, layer, bias = rng.normal(0, 0.1, (s.buckets, s.dim)), np.zeros((s.dim, len(langs))), np.zeros(len(langs))
    data = [(langs.index(lang), h, c / c.sum()) for lang, h, c in rows if len(h)]
    held = [d for i, d in enumerate(data) if i % 5 == 4]
    train = [d for i, d in enumerate(data) if i % 5 != 4]
    if len(langs) == 0:
        return Model([], np.zeros((s.buckets, 0)), bias, 1.0, 0.0, s)
    layer += rng.normal(0, 0.1, layer.shape)
    steps, done = s.epochs * max(1, len(train)), 0
    for _ in range(s.epochs):
        for k in rng.permutation(len(train)):
            y, h, w = train[k]
            rate = s.rate * (1 - done / steps)
            done += 1
            x = w @ emb[h]
            p = softmax((x @ layer + bias)[None])[0]
            p[y] -= 1
            back = layer @ p
            layer -= rate * np.outer(x, p)
            bias -= rate * 0.1 * p
            emb[h] -= rate * len(h) ** 0.5 * w[:, None] * back
    scores = emb @ layer
    temperature, least = 1.0, 0.0
    if held:
        logits = np.array([w @ scores[h] + bias for _, h, w in held])
        want = np.array([y for y, _, _ in held])
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(want)), want] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = softmax(logits / temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == want]
        least = float(np.quantile(right, s.reject_share)) if len(right) else 0.0
    return Model(langs, scores.astype(np.float32), bias, temperature, least, s)


def train(rows: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a sample of rows with a non-null language and a text with a letter: about per_lang of each language.

    Executors hash whole texts; the driver gets at most `buckets` counts for each of about max_langs * per_lang rows. A
    language of a single row is learned like any other.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(s.max_langs).collect()
    if not sizes:
        return fit([], s)
    parts = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, s.per_lang / r["count"])) for r in sizes], "lang string, __part double")
    rows = rows.join(F.broadcast(parts), "lang").select("id", "text", "lang", "__part")  # max_langs bounds it
    draw = F.pmod(F.xxhash64(F.col("id"), F.lit(s.seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[list, list, list, list] = ([], [], [], [])
            for i, t, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if has_letter(t):
                    counts = np.zeros(s.buckets, np.int64)
                    for h in hashes(t, s):
                        counts += np.bincount(h, minlength=s.buckets)
                    at = np.flatnonzero(counts)
                    for k, v in zip(found, (i, lang, at.astype("<i4").tobytes(), counts[at].astype("<i4").tobytes()), strict=True):
                        k.append(v)
            kinds = (b.schema.field(0).type, pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found, kinds, strict=True)], ["id", "lang", "h", "c"])

    got = rows.where(draw < F.col("__part")).drop("__part").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang string, h binary, c binary").collect()
    sample = sorted(got, key=lambda r: (str(r["id"]), r["lang"], bytes(r["h"])))
    return fit([(r["lang"], np.frombuffer(r["h"], "<i4"), np.frombuffer(r["c"], "<i4").astype(float)) for r in sample], s)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, in place: id, lang_pred, score, rejected. Only the text is read."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores, rejected = zip(*(m.predict(t.as_py()) for t in b.column(1)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Train on the rows that are not held out, then predict every row: doc_id, held_out, lang_pred, score, rejected.

    Null ids are neither held out nor trained on. Null and letterless texts get und. An empty table gives no rows.
    """
    learn = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    out = predict(docs, train(learn, s))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
