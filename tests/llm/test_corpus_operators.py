"""Top-k search, SimHash groups, mixing, URL filters and the pipeline against brute-force versions."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parcelspark.llm import common, kdtree, mixing, simhash, urls


def brute_top(vectors, k=5):
    out = {}
    for q, v in vectors:
        if q is not None and q % 50 == 0:
            out[q] = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i is not None and i != q)[:k]
    return out


@pytest.mark.parametrize(("shard", "cells"), [(40, 1), (40, 8), (17, 256), (1000, 256)])
def test_top_k(spark, shard, cells):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 2, (5, 6))
    vecs = [(i, (centres[i % 5] + rng.normal(0, 0.3, 6)).round(3).tolist()) for i in range(260)]
    vecs += [(300 + i, vecs[7][1]) for i in range(60)] + [(400, vecs[7][1])]  # a hot vector, and a query on it
    bad = [(500, None), (550, [float("nan")] * 6), (600, [None] + [0.1] * 5), (650, [float("inf")] * 6), (None, [0.1] * 6)]
    df = spark.createDataFrame(vecs + bad, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("dim", F.lit(0))
    got = defaultdict(list)
    for r in kdtree.top_k(df, df.where("vec_id % 50 = 0"), kdtree.Settings(shard_rows=shard, leaf=8, query_rows=3, cells=cells, near=2)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.score, r.vec_id))
    floors = [(i, np.floor(256 * np.float32(v).astype(float)).astype(int)) for i, v in vecs]
    assert dict(got) == brute_top(floors)


def test_top_k_repeated_ids(spark):
    """Rows with one id are candidates each by itself; of a query id with two vectors each is asked, ties over shards to smaller ids."""
    rng = np.random.default_rng(5)
    vecs = [(i % 90, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(180)]
    df = spark.createDataFrame(vecs + vecs[:4], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in kdtree.top_k(df, df.where("vec_id % 50 = 0"), kdtree.Settings(shard_rows=16, leaf=4, query_rows=2, cells=4, near=1)).collect():
        got[r.query_id].append((r["rank"], -r.score, r.vec_id))
    rows, want = [*vecs, *vecs[:4]], defaultdict(list)
    for q, v in {(q, tuple(v)) for q, v in rows if q % 50 == 0}:
        best = sorted((-int(256 * 256 * np.dot(v, w)), i) for i, w in rows if i != q)[:5]
        want[q] += [(n, *x) for n, x in enumerate(best, 1)]
    assert {q: sorted(x) for q, x in got.items()} == {q: sorted(x) for q, x in want.items()}


def test_top_k_small(spark):
    one = spark.createDataFrame([(0, [1.0]), (50, [2.0, 3.0])], "vec_id long, embedding array<double>")
    assert kdtree.top_k(one, one).count() == 0  # no candidate of the same length
    big = spark.createDataFrame([(0, [3e9]), (1, [2e3]), (2, [-2e3])], "vec_id long, embedding array<double>")
    got = kdtree.top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, int(3e9 * 256) * 512_000), (2, -int(3e9 * 256) * 512_000)]
    empty = spark.createDataFrame([(0, []), (1, []), (2, [1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in kdtree.top_k(empty, empty.where("vec_id = 0")).collect()] == [(0, 1, 1, 0)]
    assert kdtree.top_k(big.limit(0), big.limit(0)).count() == 0


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), 42) for x in zip(w, w[1:], w[2:], strict=False)] or [xxhash.xxh64_intdigest(" ".join(w).encode(), 42)]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(set)
    for i in range(len(prints)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("limit", [32, 1])
def test_pigeonring(spark, limit):
    """Balls of fingerprints around random centres, whose links chain: all pairs, also with every key split."""
    rng = random.Random(limit)
    prints = set()
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(9):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    base = rng.getrandbits(64)
    prints |= {base ^ k << 50 for k in range(128)}  # a hot key: all differ within one segment only
    prints = sorted(prints)
    signed = [x - (1 << 64) * (x >> 63) for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    edges = [(r.a, r.b) for r in simhash.pigeonring_edges(df, limit).collect()]
    want = {frozenset((signed[i], signed[j])) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert len(edges) == len(want) and set(map(frozenset, edges)) == want
    got = {r.fp: r.root for r in simhash.fingerprint_groups(df, limit).collect()}
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[got[x]].add(i)
    assert {frozenset(g) for g in groups.values()} == brute_groups(prints)


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(1, 61)} == {0} and got[101] == 100
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(docs, rows, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {r[0]: brute_print(r[1]) for r in rows if r[0] is not None}
    ids = sorted(prints)
    want = {ids[i]: min(ids[j] for j in g) for g in brute_groups([prints[i] for i in ids]) for i in g}
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(empty).count() == 0
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns and one.count() == len({r.component_id if r.component_id is not None else r.fingerprint for r in got})
    assert simhash.keep_one(empty).count() == 0


def test_targets():
    t = mixing.targets([("b", 10), (None, 100), ("a", 1000), ("c", 0)])
    assert [x[0] for x in t] == ["a", "b", "c", None] and t[1][2] == 30 and t[2][2] == 0
    assert abs(sum(x[2] for x in t) - 1110) < 1e-6 and all(x[2] <= 3 * x[1] + 1e-9 for x in t)
    assert mixing.targets([]) == []


def feistel(i, n, key):
    """The permutation by its definition, with Python's integers."""
    m64, half = (1 << 64) - 1, max(1, ((n - 1).bit_length() + 1) // 2)
    while True:
        a, b = i >> half, i & ((1 << half) - 1)
        for r in range(4):
            x = (b + (key * 4 + r) * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & m64
            x = (x ^ x >> 29) * 0x94D049BB133111EB & m64
            a, b = b, a ^ x >> 32 & ((1 << half) - 1)
        i = a << half | b
        if i < n:
            return i


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000])
def test_permutation(n):
    for key in (0, 9):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key)).tolist()
        assert sorted(got) == list(range(n)) and got == [feistel(i, n, key) for i in range(n)]
    assert n < 10 or feistel(3, n, 0) != feistel(3, n, 1) or feistel(4, n, 0) != feistel(4, n, 1)


def test_draws():
    """Shards' counts add up to the sources' slots, vary as multinomial ones do, and are the same from any walk."""
    totals = np.array([80_000, 200, 3000, 50_000, 0])
    rows = list(mixing.shard_counts(totals, 1024, 7, 0, 1 << 40))
    own = np.array([r[2] for r in rows])
    assert (own.sum(axis=0) == totals).all() and (own[:-1].sum(axis=1) == 1024).all() and [r[0] for r in rows] == list(range(len(rows)))
    assert all((r[1] == own[:i].sum(axis=0)).all() for i, r in enumerate(rows))
    share = totals / totals.sum()
    assert np.abs(own[:-1].var(axis=0) / np.maximum(1024 * share * (1 - share), 1e-9) - 1)[:4].max() < 0.5
    part = list(mixing.shard_counts(totals, 1024, 7, 50, 60))
    assert [(r[0], *r[2]) for r in part] == [(r[0], *r[2]) for r in rows[50:60]]
    huge = np.array([3 * 10**10, 10**9, 5])
    for _, before, own in mixing.shard_counts(huge, 1024, 7, 10**7, 10**7 + 3):
        assert own.sum() == 1024 and (before >= 0).all() and (before + own <= huge).all()
    assert mixing.slots_of([(0, 2, 6.0), (1, 5, 3.4), (2, 5, 2.6)], 3).tolist() == [6, 3, 3]


def brute_taken(placed, known, s):
    """Words taken of each placed row: blocks filled word by word, slots mapped one by one."""
    blocks = [(i, -(-n // s.block_words), t / n * -(-n // s.block_words)) for i, _, n, t in known if n]
    totals, times = mixing.slots_of(blocks, s.most), defaultdict(int)
    for _, before, own in mixing.shard_counts(totals, s.shard_slots, s.seed, 0, 1 << 40):
        for (sid, n, _), first, count in zip(blocks, before, own, strict=True):
            for k in range(first, first + count):
                times[sid, feistel(k % n, n, s.seed * 1_000_003 + sid * s.most + k // n)] += 1
    out, at = [], defaultdict(int)
    for r in sorted(placed, key=lambda r: (r.sid, r["__bucket"], r["__pos"])):
        assert r["__start"] == at[r.sid]
        out.append((r.id, sum(times[r.sid, (at[r.sid] + w) // s.block_words] for w in range(r["size"]))))
        at[r.sid] += r["size"]
    return out


def test_taken_words(docs, rows):
    s = mixing.Settings(block_words=16, shard_slots=128)
    p = mixing.plan(docs, F.xxhash64(F.col("text").cast("string")), s, "doc_id", "text", "source")
    sums = defaultdict(int)
    for r in rows:
        sums[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    known = [(i, *t) for i, t in enumerate(mixing.targets(list(sums.items()), s))]
    want = brute_taken(p.docs.collect(), known, s)
    got = [(r.doc_id, r.taken) for r in mixing.taken(docs, s).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(n for _, n in want) > 5000


def test_prefix_sums(spark):
    """Positions in a group run on without a gap over buckets and blocks of buckets."""
    df = spark.range(700).select(F.col("id"), F.when(F.col("id") % 3 < 2, "hot").alias("g"), (F.col("id") % 7).alias("v"))
    for group in ("hot", None):
        got = [r for r in common.prefix_sums(df, "g", "v", ["id"], bucket_rows=4).collect() if r.g == group]
        at = 0
        for r in sorted(got, key=lambda r: (r["__bucket"], r["__pos"])):
            assert r["__start"] == at
            at += r.v


def test_mixing(docs, rows, empty):
    s = mixing.Settings(block_words=16, shard_slots=128)
    got = mixing.taken(docs, s).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(r["size"] for r in got) == sorted(size(r[1]) for r in rows)
    total, took, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        total[r.source_size] += r["size"]
        took[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(k == v for k, v in total.items())
    assert all(abs(took[k] - target[k]) < 0.02 * target[k] + 64 for k in target)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(docs, s).collect()))
    assert mixing.taken(empty).count() == 0


def test_mixed_rows(docs, rows, empty):
    s = mixing.Settings(block_words=16, shard_slots=128)
    out = mixing.mixed(docs, s)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert sum(words.values()) > 0 and set(words) <= {r[0] for r in rows}
    assert mixing.slices("a  b c d", [(0, 2), (3, 4)], 4) == "a  b\nd" and mixing.slices(" a b ", [(1, 2), (0, 1)], 2) == " a b "
    assert mixing.mixed(empty, s).count() == 0


RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def brute_url(url):
    m = re.search("://", url or "")
    rest = url[m.end() :] if m else ""
    host = re.sub("[A-Z]", lambda x: x[0].lower(), re.split("[/?#]", rest)[0])
    path = re.split("[?#]", rest[len(re.split("[/?#]", rest)[0]) :])[0]
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    given = [None, "", "x", "http://", "http://COM/", "http://a.com", "http://a.com/", "HTTP://WWW.Example.com/en/1?q=/en/", "http://example.com/en", "http://m.example.com/en/", "http://net/es/", "http://xnet/es/", "http://a.net/fr/?x://y", "ftp://a.net?/fr/", "http://ÀB.Org/ä#f", "http://é.net/es/1", "a://b://c/d"]
    real = [r.url for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*given, *real, *given])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("tokens", F.lit(1))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, u in enumerate([*given, *real, *given]):
        assert (got[i].host, got[i].path, got[i].rule) == brute_url(u)
        assert got[i].verdict == (RULES[got[i].rule] if got[i].rule else got[i].verdict) and got[i].verdict in ("allow", "block")
    assert got[0].verdict == "allow" and urls.judge(df.limit(0)).count() == 0


def brute_rules(rows, m):
    """{(items, verdict): confidence} of all rules that count and that pruning keeps: every set of tokens that a row holds."""
    from itertools import combinations

    sets = {c for t, _ in rows for k in range(1, len(set(t)) + 1) for c in combinations(sorted(set(t)), k)}
    rules, base = {}, {v: sum(x == v for _, x in rows) / len(rows) for v in ("block", "allow")}
    for s in sets:
        hit = [v for t, v in rows if set(s) <= set(t)]
        for v in base:
            if hit.count(v) / len(rows) >= m.support and hit.count(v) / len(hit) >= m.confidence:
                rules[s, v] = hit.count(v) / len(hit)
    parts = lambda s: [tuple(x for x in s if x != y) for y in s]
    return {(s, v): c for (s, v), c in rules.items() if c - base[v] >= m.lift_over_shorter - 1e-12 and all(c >= rules.get((p, v), 0) + m.lift_over_shorter for p in parts(s))}


def spelled(rules):
    """{(items, verdict): confidence} of mined rules with every token that will do in each place."""
    from itertools import product

    return {(tuple(sorted(c)), r.verdict): round(r.confidence, 6) for r in rules for c in product(*r.alike)}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_mined_rules(spark, seed):
    """Rules against counting by hand over every itemset: thinning loses none that pruning keeps."""
    rng = random.Random(seed)
    if seed == 0:
        rows = [(["a", "x"], "block")] * 30 + [(["a", "y"], "allow")] * 30 + [(["b", "x"], "allow")] * 30 + [(["c", "every"], "block")] * 10
    else:
        rows = []
        for _ in range(300):
            t = [x for x in "abcdef" if rng.random() < 0.4]
            t += ["twin"] * ("a" in t) + ["all"]
            rows.append((t, "block" if ("a" in t and "b" in t) or ("c" in t and rng.random() < 0.95) else "allow"))
    m = urls.Mining(support=0.05, confidence=0.9)
    got = urls.prune(urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), m), m).collect()
    want = {k: round(c, 6) for k, c in brute_rules(rows, m).items()}
    assert spelled(got) == want and (seed or {k[0] for k in want} == {("b",), ("c",), ("every",), ("y",), ("a", "x")})
    odd = spark.createDataFrame([(None, "block"), (["a"], None), ([], "allow")], "tokens array<string>, verdict string")
    assert urls.mine(odd, m).count() == 0 and urls.mine(odd.limit(0), m).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_mined_rules_of_wide_pages(spark, seed):
    """Pages of more tokens than go together: rules against counting by hand over every itemset, by levels alone and both ways."""
    rng = random.Random(seed)
    rows = []
    for _ in range(200):
        t = [x for x in "abcdefg" if rng.random() < (0.3, 0.6)[seed - 3]] + ["twin"] * (rng.random() < 0.5)
        rows.append((t, "block" if {"a", "b"} <= set(t) or ("c" in t and rng.random() < 0.97) or {"d", "e", "f"} <= set(t) else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    for together in (0, 3):
        m = urls.Mining(support=0.05, confidence=0.85, together=together)
        want = {k: round(c, 6) for k, c in brute_rules(rows, m).items()}
        assert spelled(urls.prune(urls.mine(df, m), m).collect()) == want and any(len(k[0]) > 1 for k in want)


def test_tokens_beyond_the_tenth_combine(spark):
    """x and y decide together and say nothing alone, beside twelve tokens that are each nearer to a verdict."""
    many = [f"k{i:02}" for i in range(12)]
    rows = [(["x"] * x + ["y"] * y + many[:i] + many[i + 1 :], "block" if x and y else "allow") for i in range(12) for x, y in ((1, 1), (1, 1), (1, 0), (0, 1))]
    rows += [(["x"] * x + ["y"] * y + many, "block" if x and y else "allow") for x, y in ((1, 1), (1, 0), (0, 1))]
    rows += [([k], "allow") for k in many for _ in range(12)] + [(["x"], "allow"), (["y"], "allow")] * 6
    m = urls.Mining(support=0.1)
    got = spelled(urls.prune(urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), m), m).collect())
    assert got[("x", "y"), "block"] == 1.0


def test_near_certain_tokens_combine(spark):
    """a alone is at 0.99; with i and j, which leave out its other pages only together, it is certain."""
    rows = [(["a"], "block")] * 290 + [(["a", "i", "j"], "block")] * 10 + [(["a", "i"], "allow")] * 2 + [(["a", "j"], "allow")] * 2
    rows += [(["i", "j"], "allow")] * 200 + [(["z"], "allow")] * 400
    m = urls.Mining()
    got = spelled(urls.prune(urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), m), m).collect())
    assert got == {k: round(c, 6) for k, c in brute_rules(rows, m).items()} and got[("a", "i", "j"), "block"] == 1.0


def brute_verdict(tokens, rules):
    """The verdict of the best rule (items, alike, verdict, confidence, gain) that fires, or None."""
    hit = [(r.confidence, len(r["items"]), r.gain, r.verdict) for r in rules if all(set(a) & set(tokens) for a in r.alike)]
    return max(hit)[3] if hit else None


def test_mined_verdicts(spark):
    """Every page's verdict against trying each rule on it; the rules are those of all pages that fixed rules judge."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    url = F.col("url")
    own = pages.select("page_id", urls.tokens(urls.host(url), urls.path(url), F.regexp_extract(urls.rest(url), r"\?([^#]*)", 1)).alias("t"), urls.fixed(urls.host(url), urls.path(url)).alias("f"))
    tokens = {r.page_id: (r.t, r.f) for r in own.collect()}
    m = urls.Mining()
    rules = urls.prune(urls.mine(own.where("f is not null").select(F.col("t").alias("tokens"), "f.verdict"), m), m).collect()
    assert rules
    for r in urls.judge(pages).collect():
        t, f = tokens[r.page_id]
        assert r.verdict == (f.verdict if f else brute_verdict(t, rules) or "allow")


def test_long_urls_end(spark):
    """40 common segments a url, of which no two urls share all: 2^40 itemsets without a bound on a transaction."""
    rng = random.Random(4)
    names = ["k" + a + b for a in "abcdefgh" for b in "qrstuvwx"]
    given = [(i, f"http://s{i % 9}.{('com', 'net')[i % 2]}/{('de', 'fr')[i % 2]}/" + "/".join(rng.sample(names, 40))) for i in range(300)]
    given += [(300 + i, "http://x.org/fr/" + "/".join(names)) for i in range(5)]
    m = urls.Mining(max_items=6)
    got = urls.judge(spark.createDataFrame(given, "page_id long, url string"), m).collect()
    assert len(got) == 305 and {r.verdict for r in got if r.rule is None} == {"block"}


def test_mined_rules_decide(spark):
    """Pages that no fixed rule judges get the verdict of a mined rule, but not of one that only repeats the base rate."""
    given = [f"http://a{i}.com/de/{i}" for i in range(30)] + [f"http://b{i}.net/fr/{i}" for i in range(70)]
    free = [f"http://c{i}.org/{s}/{i}" for i in range(60) for s in ("de", "fr", "en")]
    df = spark.createDataFrame(list(enumerate([*given, *free])), "page_id long, url string")
    got = [r for r in urls.judge(df).collect() if r.rule is None]
    assert len(got) == len(free) and all(r.verdict == {"de": "allow", "fr": "block", "en": "allow"}[r.path[1:3]] for r in got)
    assert all((r.confidence is None) == r.path.startswith("/en") for r in got)
    same = urls.mine(spark.createDataFrame([(["a"], "block")] * 40 + [(["b"], "block")] * 10, "tokens array<string>, verdict string"))
    assert same.count() == 2 and urls.prune(same).count() == 0
    real = urls.judge(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert real.where("rule is null and confidence is not null and verdict = 'block'").count() > 0


def test_pipeline(spark, docs):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality_rules", "simhash_dedup", "pii", "mixing", "byte_bpe"] and cp.ORACLE_SQL is None
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in cp.STAGES:
        nxt = common.cut(stage(spark, plain, ""), name)
        assert name == "byte_bpe" or nxt.columns == plain.columns
        plain = nxt
    assert plain.columns[0] == "doc_id" and plain.count() > 0
    assert plain.where("n_tokens <> size(ids)").count() == 0


def none_noise(hashed):
    """The noise of the row with a null id and a text."""
    r = next(r for r in hashed if r.doc_id is None and r.n_chars is not None)
    return -np.log(-np.log((((r.u & (1 << 64) - 1) >> 11) + 0.5) / 2.0**53))


def test_target_ids_are_the_smallest_hashes(spark):
    from parcelspark.llm import resample

    s = resample.Settings(target_rows=40)
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).unionByName(spark.createDataFrame([(1, 1), (None, 1), (3, 1)], "doc_id long, quality int"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(s.seed)), F.lit(1 << 30))
    order = [r.doc_id for r in labels.where("quality = 1 and doc_id is not null").select("doc_id", h.alias("h")).distinct().orderBy("h", "doc_id").collect()]
    for part in (labels, labels.repartition(7)):
        assert sorted(r[0] for r in resample.target_ids(part, 1502, s).collect()) == sorted(order[:40])
    assert resample.target_ids(labels, 1502, resample.Settings(target_rows=5000)).count() == 1500


def test_resampling(spark, docs, rows, empty):
    """Weights and the sample against the definitions: counts by hand, and the k largest keys by sorting."""
    from parcelspark.llm import resample

    s = resample.Settings(buckets=512, keep_share=0.5, block=40)
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (11, 0, 0), (4, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = resample.select(docs, labels, s).collect()
    assert len(got) == len(rows)
    counts = [np.concatenate([*resample.hashes(r[1] or "", s), np.zeros(0, int)]).astype(int) for r in rows]
    raw = sum(np.bincount(h, minlength=512) for h in counts)
    target = sum(np.bincount(h, minlength=512) for h, r in zip(counts, rows, strict=True) if r[0] in (0, 3))
    table = np.log(target + s.smoothing) - np.log(raw * (target.sum() / raw.sum()) + s.smoothing)
    want = sorted((len(h), round(float(table[h].sum()), 4)) for h in counts)
    assert sorted((r.n_ngrams, round(r.log_weight, 4)) for r in got) == want
    assert not any(r.kept for r in got if r.n_ngrams == 0)
    # The sample itself: each row's key from its weight and the noise of its hash, sorted, and the k-th one.
    hashed = docs.select("doc_id", "n_chars", F.xxhash64("doc_id", "text").alias("h")).withColumn("u", F.xxhash64("h", F.lit(s.seed))).collect()
    noise = {r.doc_id: -np.log(-np.log((((r.u & (1 << 64) - 1) >> 11) + 0.5) / 2.0**53)) for r in hashed if r.doc_id is not None}
    known = [r for r in got if r.doc_id is not None]
    keys = {r.doc_id: r.log_weight + noise[r.doc_id] for r in known if r.n_ngrams}
    full = sum(r.n_ngrams > 0 for r in got)
    every = sorted([k for r in known if r.n_ngrams for k in [keys[r.doc_id]]] + [r.log_weight + n for r in got if r.doc_id is None and r.n_ngrams for n in [none_noise(hashed)]], reverse=True)
    least = every[round(full / 2) - 1]
    assert all(r.kept == (keys[r.doc_id] >= least - 1e-9) for r in known if r.n_ngrams)
    assert sum(r.kept for r in got) == sum(k >= least - 1e-9 for k in every)
    assert all(r.log_weight == 0 for r in resample.select(docs, labels.limit(0), s).collect())
    assert resample.select(empty, labels, s).count() == 0


def test_hash_blocks_cover_texts():
    from parcelspark.llm import resample

    text = "Some text, être ou ne pas être. " * 30
    cat = lambda s: sorted(np.concatenate(list(resample.hashes(text, s))))
    assert cat(resample.Settings(block=50)) == cat(resample.Settings())


@pytest.mark.parametrize("k", [0, 1, 7, 250, 500, 900])
def test_kth_largest(spark, k):
    from parcelspark.llm import resample

    values = [float((i * 7919) % 251) ** 3 - 5e6 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    want = sorted(values, reverse=True)[min(k, 500) - 1] if k else None
    assert resample.kth_largest(df, "x", k, bins=5) == want
