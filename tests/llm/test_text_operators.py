"""PII, language ID, token counts, quality rules and BPE against brute-force versions."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelspark.llm import bpe, langid, pii, quality, tokens

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def luhn(d):
    return sum(c if i % 2 == 0 else 2 * c - 9 * (c > 4) for i, c in enumerate(map(int, reversed(d)))) % 10 == 0


def base_spans(text):
    out = []
    for kind, rx in PATTERNS.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(p) < 256 for p in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base(docs, rows):
    extra = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8 00001.2.3.255 256.1.1.1", "a..b@c.d..e 4337--1665 9846 4399 +1.2.3.4.5.6.7.8", "a@b" + ".c" * 9000, "1.1.1.1 " * 700, "+" * 500 + "1" * 20]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame([(100 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    texts = [r[1] for r in rows] + extra
    got = sorted((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(df).collect())
    want = []
    for t in texts:
        spans = base_spans(t)
        n = Counter(k for k, _, _ in spans)
        want.append((n["email"], n["ip"], n["card"], n["phone"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    assert got == sorted(want)


def test_pii_more_and_redaction(spark, docs, empty):
    t = "😀 IBAN GB82 WEST 1234 5698 7654 32, call (988) 555-2485, ssn 123-45-6789, card 378282246310005, mail a@1.2.3.4"
    df = spark.createDataFrame([(1, t), (2, "GB82 WEST 1234 5698 7654 33 and 378282246310005 and 123-45-6789")], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    kinds = [s.split(":")[0] for s in got[1].split(",")]
    assert kinds == ["email", "ip", "iban", "pan", "ssn", "tel"] and got[2] == ""
    for s in got[1].split(","):
        kind, a, b = s.split(":")
        assert kind != "iban" or t[int(a) : int(b)] == "GB82 WEST 1234 5698 7654 32"
    red = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert red[1] == "😀 IBAN [IBAN], call [TEL], ssn [SSN], card [PAN], mail [EMAIL]" and red[2].startswith("GB82")
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("text is null").count() == docs.where("text is null").count()
    assert pii.report(empty).count() == 0


MORE_PATTERNS = {"iban": (pii.IBAN, 0.8, pii.IBAN_WORDS), "pan": (pii.CARD, 0.4, pii.CARD_WORDS), "ssn": (pii.SSN, 0.4, pii.SSN_WORDS), "tel": (pii.TEL, 0.3, pii.TEL_WORDS)}


def more_spans(text):
    """The further kinds by their definition: pattern, check, context on both sides, no base span overlapped."""
    turned = lambda m: m.replace(" ", "")[4:] + m.replace(" ", "")[:4]
    ok = {
        "iban": lambda m: int("".join(str(int(c, 36)) for c in turned(m))) % 97 == 1,
        "pan": lambda m: 13 <= len(d := re.sub("[^0-9]", "", m)) <= 15 and luhn(d),
        "ssn": lambda m: not re.match("000|666|9", m) and not re.search("-00-|-0000$", m),
        "tel": lambda m: True,
    }
    base, out = base_spans(text), []
    for kind, (rx, start, words) in MORE_PATTERNS.items():
        for m in re.finditer(rx, text):
            near = re.search(words, text[max(0, m.start() - 40) : m.start()]) or re.search(words, text[m.end() : m.end() + 40])
            if ok[kind](m[0]) and start + 0.4 * bool(near) >= 0.7 and not any(a < m.end() and m.start() < b for _, a, b in base):
                out.append((kind, m.start(), m.end()))
    return out


def redacted(text):
    out, at, end = [], 0, -1
    for s, minus, kind in sorted((s, -e, k) for k, s, e in base_spans(text) + more_spans(text)):
        if s >= end:
            out += [text[at:s], f"[{kind.upper()}]"]
        end = max(end, -minus)
        at = end
    return "".join(out) + text[at:]


def pii_texts():
    """Random runs of span-like parts, with and without context words, close enough to overlap."""
    rng = np.random.default_rng(3)
    parts = ["a@b.co", "1.2.3.4", "256.1.1.1", "4337 1665 9846 4399", "+1 (234) 555-6789", "GB82 WEST 1234 5698 7654 32", "378282246310005", "123-45-6789", "000-12-3456", "(988) 555-2485", "988.555.2485", "call", "ssn", "card", "iban", "é😀", "word", "@", "+", ".", "-"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "  x "]) for _ in range(int(rng.integers(1, 40)))) for _ in range(120)]


@pytest.mark.parametrize(("fan", "piece"), [(2, 3), (64, 256)])
def test_pii_spans_and_redaction(spark, monkeypatch, fan, piece):
    """All spans, and the texts without them, against the definitions; also with tiny runs and pieces."""
    monkeypatch.setattr(pii, "FAN", fan)
    monkeypatch.setattr(pii, "PIECE", piece)
    texts = pii_texts() + ["", "x", "1.1.1.1 " * 70]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    name = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    assert {r.doc_id: r.spans for r in pii.report(df).collect()} == {i: name(base_spans(t) + more_spans(t)) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in pii.redact(df).collect()} == {i: redacted(t) for i, t in enumerate(texts)}


def test_redaction_of_a_written_table(spark, tmp_path):
    """Read back from Parquet, written in full, by single columns and by a filter on the new text."""
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "mail a@b.co", "en", "s", 11), (2, None, None, None, None), (3, "none", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(path)
    out = pii.redact(spark.read.parquet(path))
    out.write.parquet(f"{path}-out")
    got = spark.read.parquet(f"{path}-out")
    assert sorted(map(tuple, got.select("doc_id", "text", "n_chars").collect())) == [(1, "mail [EMAIL]", 12), (2, None, None), (3, "none", 4)]
    assert got.schema == spark.read.parquet(path).schema and [r.lang for r in out.where("text like '%EMAIL%'").select("lang").collect()] == ["en"]


def test_pii_long_texts(spark):
    """Texts on which matching or cutting from the beginning would take hours: each kind's runs, and many spans."""
    spans, ssn = "é a@b.co 1.2.3.4 " * 40_000, "ssn 123-45-6789 é " * 20_000
    texts = ["1" * 1_000_000, "1." * 400_000, "a." * 500_000, "+1" * 400_000, "+1 " + " " * 500_000, "4 " * 400_000, "AB12" * 200_000, spans, ssn]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    got = {r.doc_id: (r.n_email, r.n_ip, len(r.spans.split(","))) for r in pii.report(df).collect()}
    assert got[7] == (40_000, 40_000, 80_000) and got[8] == (0, 0, 20_000) and got[0][:2] == (0, 0)
    assert {r.doc_id: r.text for r in pii.redact(df).where("doc_id > 6").collect()} == {7: "é [EMAIL] [IP] " * 40_000, 8: "ssn [SSN] é " * 20_000}


def test_language(docs, empty, spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(real, langid.Settings(epochs=6)).join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    again = langid.identify(docs, langid.Settings(epochs=1)).collect()
    assert len(again) == docs.count()
    assert {r.lang_pred for r in again if r.doc_id in (5, 6, 9, 14)} == {"und"} and all(r.rejected for r in again if r.lang_pred == "und")
    assert not [r for r in again if r.doc_id is None and r.held_out]
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def brute_hashes(text, s):
    """Hash numbers of every n-gram of bytes, each by itself."""
    data, out = (" " + re.sub(r"[\s\d]+", " ", text.lower()).strip() + " ").encode("utf-8", "replace"), []
    for n in s.grams:
        for i in range(len(data) - n + 1):
            v = 0
            for b in data[i : i + n]:
                v = v * 0x01000193 % (1 << 32) ^ b
            out.append(((v ^ n * 0x9E3779B1 % (1 << 32)) * 0x85EBCA6B % (1 << 32) >> 16) % s.buckets)
    return out


def test_language_prediction_by_hand():
    """Mean embedding, layer, softmax with temperature and rejection, one number at a time."""
    s = langid.Settings(buckets=97, grams=(1, 3))
    rng = np.random.default_rng(1)
    emb, layer, bias = rng.normal(0, 1, (97, 5)), rng.normal(0, 1, (5, 3)), rng.normal(0, 1, 3)
    model = langid.Model(["a", "b", "c"], emb @ layer, bias, 0.7, 0.5, s)
    for text in ("Some text, être!", "x", "Aa 12 bb"):
        h = brute_hashes(text, s)
        mean = sum(emb[i] for i in h) / len(h)
        z = [(float(mean @ layer[:, k]) + bias[k]) / 0.7 for k in range(3)]
        p = [np.exp(x) / sum(np.exp(y) for y in z) for x in z]
        lang, score, rejected = model.predict(text)
        assert lang == "abc"[int(np.argmax(p))] and abs(score - max(p)) < 1e-9 and rejected == (max(p) < 0.5)
    assert model.predict("12 ,") == model.predict(None) == model.predict("") == ("und", 0.0, True)


def test_language_fit_by_hand():
    """One epoch of SGD step by step on dense numbers; then the temperature and the limit of rejection on the held rows."""
    s = langid.Settings(buckets=11, dim=3, epochs=2, per_lang=50)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        h = np.unique(rng.integers(0, 6, 4) + 5 * (i % 2)) % 11
        rows.append((("x", "y")[i % 2 if i % 13 else (i + 1) % 2], h, rng.integers(1, 5, len(h)).astype(float)))
    model = langid.fit(rows, s)
    rng = np.random.default_rng(s.seed)
    emb, layer, bias = rng.normal(0, 0.1, (11, 3)), rng.normal(0, 0.1, (3, 2)), np.zeros(2)
    train, held = [r for i, r in enumerate(rows) if i % 5 != 4], [r for i, r in enumerate(rows) if i % 5 == 4]
    dense = lambda h, c: np.array([sum(c[h == k]) / sum(c) for k in range(11)])
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    step = 0
    for _ in range(2):
        for k in rng.permutation(len(train)):
            lang, h, c = train[k]
            rate = 0.5 * (1 - step / (2 * len(train)))
            step += 1
            w = dense(h, c)
            x = w @ emb
            error = soft(x @ layer + bias) - np.eye(2)["xy".index(lang)]
            toward = error @ layer.T
            layer, bias = layer - rate * np.outer(x, error), bias - 0.1 * rate * error
            emb = emb - rate * len(h) ** 0.5 * np.outer(w, toward)
    assert np.allclose(model.scores, emb @ layer, atol=1e-5) and np.allclose(model.bias, bias)
    z = np.array([dense(h, c) @ emb @ layer + bias for _, h, c in held])
    want = ["xy".index(r[0]) for r in held]
    loss = lambda t: -np.mean([np.log(soft(a / t)[k] + 1e-12) for a, k in zip(z, want, strict=True)])
    grid = np.geomspace(0.05, 20, 60)
    assert abs(model.temperature - min(grid, key=loss)) < 1e-9 and all(loss(model.temperature) <= loss(t) + 1e-12 for t in grid)
    sure = [soft(a / model.temperature).max() for a, k in zip(z, want, strict=True) if a.argmax() == k]
    assert abs(model.least - np.quantile(sure, s.reject_share)) < 1e-6


def test_language_bounds(spark):
    """Only the languages with most rows are learned; one of a single row, and a very long text, do no harm."""
    rows = [(i, ("le chat est la " if i % 2 else "the cat is here ") * 5, "fr" if i % 2 else "en") for i in range(60)] + [(100 + i, "noise here", f"q{i}") for i in range(9)]
    df = spark.createDataFrame([*rows, (200, "the cat is here " * 60_000, "en")], "doc_id long, text string, lang string")
    few = langid.identify(df, langid.Settings(max_langs=2, epochs=4)).collect()
    assert {r.lang_pred for r in few} == {"en", "fr"} and len(few) == 70
    assert next(r for r in few if r.doc_id == 200).lang_pred == "en"
    assert langid.train(df, langid.Settings(epochs=1)).langs == ["en", "fr", *sorted(f"q{i}" for i in range(9))]


def test_language_blocks_cover_texts():
    s, t = langid.Settings(block=64), langid.Settings()
    text = "Some text, être ou ne pas être. " * 40
    assert sorted(np.concatenate(list(langid.hashes(text, s)))) == sorted(np.concatenate(list(langid.hashes(text, t))))


def test_token_counts(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    want = sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()), n(r[1]), n(r[1]) > 512) for r in rows)
    cache = str(tmp_path / "cache")
    for _ in range(2):  # cold, then warm
        got = tokens.count_tokens(docs, JSON, P.PATTERN, cache).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    stored = docs.sparkSession.read.parquet(cache)
    assert stored.count() == len({r[1] or "" for r in rows})  # every distinct text once, nothing added by the second call
    half = docs.where("doc_id < 4")
    more = str(tmp_path / "more")
    tokens.count_tokens(half, JSON, P.PATTERN, more)
    assert tokens.count_tokens(docs, JSON, P.PATTERN, more).count() == len(rows)
    assert docs.sparkSession.read.parquet(more).count() == len({r[1] or "" for r in rows})
    assert tokens.count_tokens(empty, JSON, P.PATTERN, str(tmp_path / "e")).count() == 0


def test_token_store_is_shared(spark, tmp_path):
    """Rows stored twice count once, other digests and other files' rows never show, and a batch stores only its misses."""
    cache = str(tmp_path / "c")
    a = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert tokens.count_tokens(a, JSON, P.PATTERN, cache).count() == 300
    part = spark.read.parquet(cache)
    part.limit(7).drop("tokenizer").write.mode("append").partitionBy("part").parquet(f"{cache}/tokenizer={tokens.file_digest(JSON)}")
    b = spark.createDataFrame([(i, f"text {i}") for i in range(290, 310)] + [(None, "text 1"), (5, "text 1")], "doc_id long, text string")
    got = tokens.count_tokens(b, JSON, P.PATTERN, cache).collect()
    assert len(got) == 22 and spark.read.parquet(cache).count() == 317
    assert tokens.count_tokens(b, P.path("word_bpe_49k.json"), P.PATTERN, cache).count() == 22
    assert spark.read.parquet(cache).where(F.col("tokenizer") == tokens.file_digest(P.path("word_bpe_49k.json"))).count() == 21


@pytest.fixture(scope="module")
def counters():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    return lib, tokens.counter(JSON, P.PATTERN)


def test_token_counter(counters):
    from tokenizers import Tokenizer

    lib, count = counters
    texts = ["a<|endoftext|>b", "中文 <|endoftext|>", "x\u2003y\x85z ǅ ĳ", "’s it’s 's", "", "<|endoftext|><|endoftext|>", "😀", "IT'S I'LL 'Re'd", "<|endoftext|", " <|endoftext|>  x"]
    assert count(texts) == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    word = P.path("word_bpe_49k.json")
    lib2 = Tokenizer.from_file(word)
    assert tokens.counter(word, P.PATTERN)(["A b  c"]) == [len(lib2.encode("A b  c", add_special_tokens=False).ids)]
    assert tokens.counter(P.path("piece_bpe_32k.model"), P.PATTERN)(["a b"])[0] > 0


def test_every_code_point_is_parted_alike(counters):
    """The pattern knows characters by class: after a letter, a space, a mark and itself each gives the library's ids."""
    lib, _ = counters
    spec = tokens.json.load(open(JSON, encoding="utf-8"))
    fast = tokens.rank_encoder(spec, P.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        texts = [f"a{c}1 {c}!{c}{c}" for c in points[at : at + 100_000]]
        want = [e.ids for e in lib.encode_batch_fast(texts, add_special_tokens=False)]
        assert fast.plain.encode_ordinary_batch(texts, num_threads=4) == want


@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["'s", "'LL", "’re", " ", "\n\n", "\u00a0", "1", "½", "<|endoftext|>", "<|end"])), max_size=20).map("".join))
@settings(max_examples=150, deadline=None)
def test_random_texts_count_as_the_library(counters, text):
    lib, count = counters
    assert count([text]) == [len(lib.encode(text, add_special_tokens=False).ids)]


def figures(text):
    """The base figures by their definitions."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


WHITE = r"[\x20\x09-\x0D]"


def fails(body, common=()):
    """Whether a line fails, each rule by its sentence in the settings, one after the other over regular expressions."""
    tight, words = re.sub(WHITE, "", body), body.split()
    if len(tight) > 1 and len(re.findall(r"[#*$%&|<>]", tight)) > 0.1 * len(tight):
        return True
    if re.search("|".join(map(re.escape, quality.PHRASES)), body.lower()) or body in common:
        return True
    if len(tight) >= 40 and len(re.findall(r"[!-@\[-`{-~\x7f]", tight)) > 0.5 * len(tight):
        return True
    if re.search(r"(\.\.\.|…)$", body) and len(words) <= 12:
        return True
    if re.search(r"[.!?:;,…\"'”’»)\]}。！？]$", body):
        return False
    marks = len(re.findall(r"[|»›•>]|::", body))
    if marks >= 2 and len(words) <= 4 * (marks + 1):
        return True
    if len(words) <= 5 and re.match(r"([-*•·▪‣◦»›]|[0-9]{1,3}[.)])[ \t]", body):
        return True
    if len(words) >= 3 and sum(1 for w in words if w[:1] != w[:1].lower() or w[:1].isupper()) >= 0.8 * len(words):
        return True
    ends = [i for i, w in enumerate(words) if re.search(r"[.!?:;…。！？][\"'”’»)\]}]*$", w)]
    return len(words) >= 5 and (not ends or len(words) - 1 - ends[-1] > 20)


def verdict(text, common=()):
    """(kept, lost characters, surviving text) of a text."""
    lines, gone, run = (text or "").split("\n"), set(), []
    strip = lambda x: re.sub(f"^{WHITE}+|{WHITE}+$", "", x)
    full = [i for i, x in enumerate(lines) if strip(x)]
    for i in full:
        if lines[i] in lines[:i] or fails(strip(lines[i]), common):
            gone.add(i)
    for i in [*full, None]:
        if i is not None and not re.search(r"[.!?:;,…\"'”’»)\]}。！？]$", strip(lines[i])) and len(lines[i].split()) <= 3:
            run.append(i)
        else:
            gone |= set(run) if len(run) >= 4 else set()
            run = []
    lost = sum(len(re.sub(WHITE, "", lines[i])) for i in gone)
    n, chars, _, _, again = figures(text)
    base = n < 20 or 100 * again > 30 * n
    return not base and lost <= 0.7 * chars, lost, "\n".join(x for i, x in enumerate(lines) if i not in gone)


LINES = [
    "A closed line of words.", "no closing mark here at all just words", "Home About Contact Products Services Careers", "Home | About | News | Contact", "word " * 30 + "end", "One. Two words", "Ends well. " + "then it goes on " * 7,
    "Tous droits réservés 2020.", "Alle Rechte vorbehalten", "Todos los derechos reservados.", "Datenschutzerklärung und Impressum", "Cliquez ici", "• a bullet", "- item one", "12. item", "Read on for the whole ...", "Und so weiter und so fort …",
    "### $$$ %%% text ***", "12345 67890 12345 67890 12345 67890 12345 67890 1", "heading", "Two words", "x", "News", "Sport", "He said: \"no\"", "et alors il dit que oui.", "  spaced out line here.  ", "\tand a tab", "a > b > c", "Ein Satz. Noch einer ohne Ende", "1) short",
]


def quality_texts():
    rng = np.random.default_rng(6)
    body = ["the quick fox number%d ran over hills and sleepy dogs today." % i for i in range(400)]
    return ["\n".join([*rng.choice(body, int(rng.integers(1, 12)), replace=False), *rng.choice(LINES, int(rng.integers(0, 9)))][:: 1 if rng.random() < 0.5 else -1]) for _ in range(150)]


def test_line_rules():
    for x in LINES:
        assert bool(quality.line_fails(x, quality.Rules())) == fails(x.strip()), x
    name = lambda x: quality.line_fails(x, quality.Rules())
    assert [name(LINES[i]) for i in (0, 1, 2, 3, 4, 5, 6)] == [None, "punctuation", "navigation", "symbols", "punctuation", None, "punctuation"]
    assert {name(x) for x in LINES[7:12]} == {"boilerplate"} and {name(x) for x in LINES[12:15]} == {"navigation"} and {name(x) for x in LINES[15:17]} == {"punctuation"}
    assert name(LINES[17]) == "symbols" and name(LINES[18]) == "letters" and name("heading") is None


def test_quality_verdicts(spark, docs, rows, empty):
    """Every verdict, loss and surviving text against the sentences of the rules."""
    texts = quality_texts() + [r[1] for r in rows]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.kept, r.lost_chars, r.clean_text) for r in quality.quality(df, with_text=True).collect()}
    assert got == {i: verdict(t) for i, t in enumerate(texts)} and {k for k, _, _ in got.values()} == {True, False}


def test_common_lines(spark):
    """A footer under different lines is boilerplate; the lines of copies and of near copies aren't."""
    prose = lambda i, n: [f"sentence number {i * 100 + k} stands here by itself without a copy." for k in range(n)]
    texts = ["\n".join([*prose(i, 6), "Our footer line says nothing new.", *(["and its end."] if i % 2 else [])]) for i in range(40)]
    texts += ["\n".join(prose(999, 8))] * 60  # copies
    texts += ["\n".join([*(x := prose(555, 8))[: i % 8], f"changed {i} only here.", *x[i % 8 + 1 :]]) for i in range(120)]  # near copies
    texts += ["rare line.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rules = quality.Rules(common_docs=20)
    strip = lambda t: [x.strip() for x in (t or "").split("\n") if x.strip()]
    where, around = {}, {}
    for t in texts:
        lines = strip(t)
        for k, x in enumerate(lines):
            where.setdefault(x, set()).add(t)
            around.setdefault(x, set()).add((lines[k - 1] if k else None, lines[k + 1] if k + 1 < len(lines) else None))
    want = {x for x in where if len(where[x]) >= 20 and len(around[x]) >= 0.5 * len(where[x])}
    assert quality.common_lines(df, rules) == {quality.line_hash(x) for x in want} and "Our footer line says nothing new." in want and len(want) <= 2
    got = {r.doc_id: r.clean_text for r in quality.quality(df, rules, with_text=True).collect()}
    assert got == {i: verdict(t, want)[2] for i, t in enumerate(texts)}
    assert quality.common_lines(df.limit(0), rules) == frozenset()


def test_quality(docs, rows, empty):
    got = quality.quality(docs).collect()
    want = sorted(figures(r[1]) for r in rows)
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    assert {r.doc_id for r in got if r.kept} >= {0, 3, 4, 10} and quality.quality(empty).count() == 0


def test_quality_stage(docs):
    out = quality.keep_good(docs)
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert out.columns == docs.columns and "About" not in texts[4][0] and texts[4][1] == len(texts[4][0])
    assert 11 not in texts and 5 not in texts and 6 not in texts


@given(st.lists(st.sampled_from(["a", "b", "c", "d", "\n", " ", "  "]), max_size=120))
@settings(max_examples=60, deadline=None)
def test_repeats(parts):
    text = " ".join(parts)
    assert quality.count_repeats(text.encode().split()) == figures(text)[4]


@pytest.fixture(scope="module")
def codec():
    return bpe.ByteBPE.from_file(RANKS, P.PATTERN)


@pytest.mark.parametrize(("leaf", "data", "seam", "ids"), [(16, 6, 4, 1), (7, 3, 2, 2), (4096, 256, 64, 8)])
def test_bpe_joins(codec, monkeypatch, leaf, data, seam, ids):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    monkeypatch.setattr(bpe, "LEAF_BYTES", data)
    monkeypatch.setattr(bpe, "SEAM_CHARS", seam)
    monkeypatch.setattr(bpe, "SEAM_IDS", ids)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "'s", "'ll", "'", "l", "1", "!", "ß", "中", "😀", "the", "ing", "\t", " of"]
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 250))) for _ in range(300)] + ["a" * 3000, " " * 999 + "x", "".join(rng.choice(list("abcdeinorst"), 3000)), "é" * 900]
    for t in texts:
        got = codec.encode(t)
        assert got == codec.plain.encode_ordinary(t) and codec.decode(got) == t.encode()


def test_bpe_query(docs, rows, codec, empty):
    got = bpe.encode_docs(docs, RANKS, P.PATTERN).collect()
    want = []
    for r in rows:
        ids = codec.plain.encode_ordinary(r[1] or "")
        want.append((len(ids), sha(" ".join(map(str, ids))), sha((r[1] or "").encode())))
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted(want)
    assert all(r.n_tokens == len(r.ids) for r in got) and bpe.encode_docs(empty, RANKS, P.PATTERN).count() == 0
