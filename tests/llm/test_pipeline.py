"""The pipeline stage by stage, and as a whole, against versions that work on plain rows."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as cp
from parcelspark.llm import bpe, common, mixing

from .conftest import DDL, prose
from .test_corpus_operators import brute_groups, brute_print, feistel
from .test_text_operators import base_spans, more_spans, redacted, verdict

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    """Documents with menus, near and exact copies, personal data, nulls, repeated rows and a hot source."""
    rng, out = random.Random(2), []
    for i in range(60):
        lines = [prose(rng.randint(10, 30), 100 * i + k) + "." for k in range(rng.randint(2, 8))]
        lines += ["Home | About | News | Contact"] * (i % 4 == 0) + [f"write to a{i}@b.co or call (988) 555-2{i:03d}."] * (i % 3 == 0) + ["no mark at the end of this one"] * (i % 5 == 0)
        out.append((i, "\n".join(lines), "en", "hot" if i % 3 else ("x", "y", None)[i % 2 + i % 5 // 4], 0))
    out += [(100 + i, out[7][1], "en", "hot", 0) for i in range(15)] + [(200 + i, out[8][1].replace("the", "thee", 1), "en", "x", 0) for i in range(3)]
    out += [(300, None, None, None, None), (301, "", "en", "x", 0), (302, "word " * 15, "en", "x", 0), out[3], (None, out[5][1] + " More.", "en", "y", 1)]
    return [(a, t, lang, s, len(t) if t is not None else None) for a, t, lang, s, _ in out]


def common_lines(texts):
    """Lines of many different texts, between different lines."""
    where, around = defaultdict(set), defaultdict(set)
    for t in texts:
        lines = [x.strip() for x in (t or "").split("\n") if x.strip()]
        for k, x in enumerate(lines):
            where[x].add(t)
            around[x].add((lines[k - 1] if k else None, lines[k + 1] if k + 1 < len(lines) else None))
    least = max(25, -(-len(texts) * 5 // 1000))
    return {x for x in where if len(where[x]) >= least and len(around[x]) >= 0.5 * len(where[x])}


def good(rows):
    shared = common_lines([r[1] for r in rows])
    judged = [(r, verdict(r[1], shared)) for r in rows]
    return [(r[0], text, r[2], r[3], len(text)) for r, (kept, _, text) in judged if kept]


def one_each(rows):
    """Of each group the row with the smallest id, null last; of rows alike in id and fingerprint one."""
    groups = brute_groups([brute_print(r[1]) for r in rows])
    return [min((rows[i] for i in g), key=lambda r: (r[0] is None, r[0] or 0, brute_print(r[1]) - (1 << 64) * (brute_print(r[1]) >> 63))) for g in groups]


def private(rows):
    return [(r[0], redacted(r[1]), r[2], r[3], len(redacted(r[1])) if base_spans(r[1]) + more_spans(r[1]) else r[4]) for r in rows]


def mixed_words(rows, placed, s):
    """Words that each document gives to each pass, from blocks filled word by word; placed: the rows' order."""
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += len(r[1].split())
    known = [(i, *t) for i, t in enumerate(mixing.targets(list(sums.items()), s))]
    blocks = [(i, -(-n // s.block_words), t / n * -(-n // s.block_words)) for i, _, n, t in known if n]
    drawn = defaultdict(set)
    for _, before, own in mixing.shard_counts(mixing.slots_of(blocks, s.most), s.shard_slots, s.seed, 0, 1 << 40):
        for (sid, n, _), first, count in zip(blocks, before, own, strict=True):
            for k in range(first, first + count):
                drawn[sid, feistel(k % n, n, s.seed * 1_000_003 + sid * s.most + k // n)].add(k // n)
    out, at = Counter(), defaultdict(int)
    texts = {r[0]: r[1].split() for r in rows}
    for r in sorted(placed, key=lambda r: (r.sid, r["__bucket"], r["__pos"])):
        for turn in range(s.most):
            words = tuple(w for k, w in enumerate(texts[r.id]) if turn in drawn[r.sid, (at[r.sid] + k) // s.block_words])
            if words:
                out[r.id, words] += 1
        at[r.sid] += r["size"]
    return out


def rows_of(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


def alike(a, b):
    return sorted(map(str, a)) == sorted(map(str, b))


def test_stages_against_plain_versions(spark):
    docs = spark.createDataFrame(corpus(), DDL).repartition(5)
    stages, step = dict(cp.STAGES), {}
    for name, plain in (("quality_rules", good), ("simhash_dedup", one_each), ("pii", private)):
        before = rows_of(docs)
        docs = common.cut(stages[name](spark, docs, ""), name)
        assert docs.columns == COLUMNS and alike(rows_of(docs), plain(before)), name
        step[name] = (before, rows_of(docs))
    assert len(step["quality_rules"][1]) < len(step["quality_rules"][0]) and len(step["simhash_dedup"][1]) < len(step["simhash_dedup"][0]) and step["pii"][0] != step["pii"][1]
    before, s = rows_of(docs), mixing.Settings()
    h = F.xxhash64(*[F.col(c) for c in docs.columns])
    placed = mixing.plan(docs, h, s, "doc_id", "text", "source").docs.collect()
    docs = common.cut(stages["mixing"](spark, docs, ""), "mixing")
    got = Counter((r[0], tuple(r[1].split())) for r in rows_of(docs))
    assert got == mixed_words(before, placed, s) and all(r[4] == len(r[1]) for r in rows_of(docs))
    codec = bpe.ByteBPE.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    library = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks={v: k for k, v in codec.bytes_of.items()}, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = Counter((r[0], len(i := library.encode_ordinary(r[1])), sha(" ".join(map(str, i)).encode()), sha(r[1].encode())) for r in rows_of(docs))
    last = stages["byte_bpe"](spark, docs, "").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last) == want


def test_whole_run(spark, tmp_path):
    """run() gives what the stages give one after the other, and the same again."""
    spark.createDataFrame(corpus(), DDL).write.parquet(str(tmp_path / "documents.parquet"))
    key = lambda df: sorted((str(r.doc_id), r.ids_sha256) for r in df.collect())
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in cp.STAGES:
        docs = common.cut(stage(spark, docs, str(tmp_path)), "stage")
    first = cp.run(spark, str(tmp_path))
    assert key(first) == key(docs) == key(cp.run(spark, str(tmp_path))) and first.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 3])
def test_nothing_to_do(spark, tmp_path, rows):
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
