"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much is rejected.

Lines are judged by how they end (punctuation), by what marks menus (navigation), by phrases of sites in four languages
and by how many documents they stand in (boilerplate), and by their characters. Base figures (words, symbols, repeated
lines and word windows) are counted over the whole text beside that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import SPACES, cut, drop_cut, slices

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# What only pages' frames say, in lower case: English, French, German, Spanish.
PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies", "enable javascript",
    "click here", "sign up for", "log in to", "subscribe to our", "share this", "powered by", "skip to content", "skip to main content", "back to top", "read more", "follow us", "lorem ipsum",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "accepter les cookies", "accepter tous les cookies", "activer javascript",
    "cliquez ici", "abonnez-vous", "se connecter", "partager cet article", "aller au contenu", "haut de page", "lire la suite", "suivez-nous", "plan du site",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "impressum", "cookies akzeptieren", "javascript aktivieren",
    "klicken sie hier", "hier klicken", "jetzt anmelden", "newsletter abonnieren", "zum inhalt springen", "nach oben", "mehr lesen", "weiterlesen", "folgen sie uns", "seitenübersicht",
    "todos los derechos reservados", "términos de uso", "política de privacidad", "aviso legal", "aceptar cookies", "aceptar todas las cookies", "activar javascript",
    "haga clic aquí", "haz clic aquí", "suscríbete", "suscríbase", "iniciar sesión", "ir al contenido", "volver arriba", "leer más", "síguenos", "síganos", "mapa del sitio",
)
NAV_MARK = re.compile(r"[|»›•>]|::")
BULLET = re.compile(r"(?:[-*•·▪‣◦»›]|\d{1,3}[.)])[ \t]")
#: A line that ends in one of these is closed; a sentence ends in one of the marks, maybe before a quote or bracket.
CLOSING = frozenset(".!?:;,…\"'”’»)]}。！？")
SENTENCE = re.compile(r"[.!?:;…。！？][\"'”’»)\]}]*$")
NON_LETTERS = bytes(c for c in range(33, 128) if not chr(c).isalpha())
_NO_SPACE = dict.fromkeys(map(ord, SPACES))


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document's verdict."""

    symbol_share: float = 0.1  # of a line's characters without white space
    nav_marks: int = 2  # marks that make a line without a closing mark a navigation line
    nav_words: float = 4.0  # most words between two marks there
    title_words: int = 3  # an open line of so many words or more is a menu
    title_share: float = 0.8  # if so many of them begin in upper case
    run_lines: int = 4  # open lines of at most run_words words are a menu, if so many follow each other
    run_words: int = 3
    bullet_words: int = 5  # most words of an open line that begins with a bullet
    open_words: int = 5  # an open line of so many words or more holds a sentence's end
    tail_words: int = 20  # and has at most so many words after the last one
    teaser_words: int = 12  # a line of at most so many words that ends in an ellipsis is cut off
    letter_share: float = 0.5  # least share of characters other than ASCII digits and marks, in a line of some length
    letter_chars: int = 40
    common_share: float = 0.005  # of all documents: lines in so many different ones are boilerplate
    common_docs: int = 25  # and in so many at least
    common_around: float = 0.5  # if they stand between different lines in so large a share of them
    lost_share: float = 0.7  # a document that loses more of its word characters is rejected


def line_hash(body: str) -> int:
    """The signed number by which a line without outer white space is known, the same as Spark's xxhash64 of it."""
    h = xxhash.xxh64_intdigest(body.encode("utf-8", "replace"), 42)
    return h - (h >> 63 << 64)


def open_line(line: str, body: str, rules: Rules) -> str | None:
    """The rule that a line fails which doesn't end in a closing mark, or None."""
    words = line.split()
    marks = len(NAV_MARK.findall(line))
    if marks >= rules.nav_marks and len(words) <= rules.nav_words * (marks + 1):
        return "navigation"
    if len(words) <= rules.bullet_words and BULLET.match(body):
        return "navigation"
    if len(words) >= rules.title_words and sum(w[0].isupper() for w in words) >= rules.title_share * len(words):
        return "navigation"
    if len(words) >= rules.open_words:
        tail = next((k for k, w in enumerate(reversed(words)) if SENTENCE.search(w)), None)
        if tail is None or tail > rules.tail_words:
            return "punctuation"
    return None


def line_fails(line: str, rules: Rules, phrases: tuple[str, ...] = PHRASES, symbols: bool = True, common: frozenset[int] = frozenset()) -> str | None:
    """The rule that a line with a word fails by itself, or None. phrases and symbols: what the whole text has of them."""
    body = line.strip(SPACES)
    if symbols and (n := sum(body.count(c) for c in SYMBOLS)) and len(tight := body.translate(_NO_SPACE)) > 1 and n > rules.symbol_share * len(tight):
        return "symbols"
    if phrases and any(map(body.lower().__contains__, phrases)):
        return "boilerplate"
    if common and line_hash(body) in common:
        return "boilerplate"
    if len(body) >= rules.letter_chars:
        data = body.encode("utf-8", "replace")
        odd = len(data) - len(data.translate(None, NON_LETTERS))
        # Spaces are seldom over half of a line, so few lines are measured without them.
        if odd > (1 - rules.letter_share) * (len(body) - sum(map(body.count, SPACES))) >= (1 - rules.letter_share) * rules.letter_chars:
            return "letters"
    if body.endswith(("...", "…")) and len(line.split()) <= rules.teaser_words:
        return "punctuation"
    return None if body[-1] in CLOSING else open_line(line, body, rules)


def count_repeats(words: list[bytes], width: int = WINDOW) -> int:
    """Words covered by windows of `width` (a power of two) words that occur twice or more, the first occurrence included.

    Windows get exact numbers by doubling: a window of 2k words is the pair of its halves' numbers.
    """
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    if len(seen) == len(words):
        return 0
    step = 1
    while step < width:
        pair = ids[:-step] * (int(ids.max()) + 1) + ids[step:]
        distinct, ids = np.unique(pair, return_inverse=True)
        if len(distinct) == len(ids):
            return 0
        step *= 2
    again = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(again), 1)
    np.add.at(edge, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def menu_runs(lines: list[tuple[int, str]], rules: Rules) -> set[int]:
    """Places of the lines, of (place, line without outer white space) in order, that stand in a run of short open ones."""
    out: set[int] = set()
    run: list[int] = []
    for at, body in [*lines, (-1, ".")]:
        if body[-1] not in CLOSING and len(body.split()) <= rules.run_words:
            run.append(at)
            continue
        if len(run) >= rules.run_lines:
            out.update(run)
        run = []
    return out


def judge(text: str | None, rules: Rules, common: frozenset[int] = frozenset()) -> dict:
    """All figures of one text and the text of its surviving lines. common: hashes of the lines of many documents."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()  # parts at the six ASCII spaces only
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    low = text.lower()
    phrases = tuple(p for p in PHRASES if p in low)
    lines = text.split("\n")
    full = [(at, body) for at, line in enumerate(lines) if (body := line.strip(SPACES))]
    gone, seen, dups = menu_runs(full, rules) if len(full) >= rules.run_lines else set(), set(), 0
    for at, _ in full:
        line = lines[at]
        if line in seen:
            dups += 1
            gone.add(at)
        else:
            seen.add(line)
            if at not in gone and line_fails(line, rules, phrases, symbols > 0, common):
                gone.add(at)
    lost = sum(len(lines[at].translate(_NO_SPACE)) for at in gone)
    repeats = count_repeats(words)
    base = len(words) < 20 or 100 * repeats > 30 * len(words)
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats,
        "base_failed": base, "kept": not base and lost <= rules.lost_share * chars, "lost_chars": lost, "clean_text": "\n".join(x for at, x in enumerate(lines) if at not in gone) if gone else text,
    }


def bodies(text: Column) -> Column:
    """Hashes of a text's lines without outer white space, those without a word left out."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))
    return F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))


def common_lines(texts: DataFrame, rules: Rules = Rules()) -> frozenset[int]:
    """Hashes of the lines of many different texts (a column `text`): common_share of all documents, common_docs at least.

    Copies of a text count once. Near copies are many texts too, but in them a line stands between the same lines: it
    counts as boilerplate only if the pairs of lines around it are as many as common_around of its texts. The driver
    gets at most the average number of lines of a document / common_share of them, whatever the input.
    """
    hashes = texts.select(F.xxhash64("text").alias("d"), bodies(F.col("text")).alias("h"))
    at = lambda i: F.coalesce(F.try_element_at(F.col("h"), i), F.lit(0).cast("long"))
    each = F.transform("h", lambda x, i: F.struct(x.alias("h"), F.xxhash64(F.when(i > 0, at(i)), F.when(i < F.size("h") - 1, at(i + 2))).alias("around")))
    lines = cut(hashes.select("d", F.inline(each)), "lines")
    docs = texts.count()
    least = max(rules.common_docs, int(-(-rules.common_share * docs // 1)))
    # Few lines come often at all: the others are left out before anything is counted by text.
    often = lines.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h")
    # At most the lines of a document on average / common_share hashes.
    some = cut(lines.join(F.broadcast(often), "h", "left_semi"), "often")
    by_text = some.groupBy("h", "d").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    around = some.groupBy("h", "around").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("around"))
    found = by_text.join(around, "h").where(F.col("around") >= rules.common_around * F.col("texts")).select("h").collect()
    drop_cut(lines, some)
    return frozenset(r["h"] for r in found)


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs, in place (no text is moved): id, figures, base_failed, kept, lost_chars, and clean_text if asked.

    Null or empty text: no words, so base_failed. Repeated rows and null ids are judged like any other; repeated lines
    of a text fail but for the first.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"] + ["clean_text"] * with_text
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.string()] * with_text
    ddl = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long" + ", clean_text string" * with_text
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs, rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in slices(batches):
            rows = [judge(t.as_py(), rules, common) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True))], [id_col, *names])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema['id'].dataType.simpleString()}, {ddl}")


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of docs whose verdict is to keep, with failing lines removed from text and n_chars counted anew; same columns."""
    schema = docs.schema
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    shared = docs.sparkSession.sparkContext.broadcast(common_lines(docs.select(F.col("text").cast("string").alias("text")), rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for b in slices(batches):
            rows = [judge(t.as_py(), rules, common) for t in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array([r["clean_text"] for r in rows], pa.string())
            if chars is not None:
                columns[chars] = pa.array([len(r["clean_text"]) for r in rows]).cast(b.schema.field(chars).type)
            out = pa.RecordBatch.from_arrays(columns, names=b.schema.names)
            yield out.filter(pa.array([r["kept"] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, schema)
