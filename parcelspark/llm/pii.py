"""Personal data in texts, with DataFrame functions only: patterns propose spans, checksums confirm, context scores.

Base kinds (email, ip, card, phone) are accepted by their own checks. Further kinds get a score: a checksum or format
gives a start, a context word in the `near` characters before or after the span adds to it, and spans of at least
`accept` that don't overlap a base span are added: `iban` (mod-97), `pan` (13 to 15 digits passing Luhn), `ssn` and
`tel` (national formats). Positions are code points, ends exclusive. No row leaves its place: there is no shuffle.

Work grows in proportion to a text, however long it is and however many spans it holds: each pattern can begin only
where it can't have begun before, positions are sums over arrays that are summed in runs of `FAN` beforehand, and parts
of a text are taken from its pieces of `PIECE` characters, never counted from its beginning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the contract, written so that Java matches them without recursion. Possessive loops
# change nothing where no shorter match could succeed; an address starts where a run of its characters starts or
# where the match before it ended, as a later start in the same run fails whenever the first does. (The loop of numbers
# and of cards ends where a run of digits ends, so that no match ends within one.)
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
TEL = r"(?<![0-9+)(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
# Context words.
CARD_WORDS = r"(?i)\b(?:card|credit|debit|visa|amex|mastercard|carte|tarjeta|karte|kreditkarte)\b"
IBAN_WORDS = r"(?i)\b(?:iban|account|bank|konto|compte|cuenta|banque|banco)\b"
SSN_WORDS = r"(?i)\b(?:ssn|social|security|taxpayer|tin)\b"
TEL_WORDS = r"(?i)\b(?:tel|phone|telephone|call|mobile|cell|fax|contact|telefon|téléphone|teléfono|handy)\b"

FAN = 64
PIECE = 256
LEVELS = 4  # FAN^LEVELS matches in a text are summed at full speed


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    doubled = lambda c: F.when(c > 4, c * 2 - 9).otherwise(c * 2)
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number without spaces leaves 1 by 97, its first four characters put last, letters as 10 to 35."""
    turned = F.concat(F.substring(number, 5, 40), F.substring(number, 1, 4))
    step = lambda a, c: F.when(F.ascii(c) < 58, a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def ip_ok(m: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(short(p)) > 3, F.lit(False)).otherwise(short(p).cast("int") <= 255))


def card_ok(m: Column) -> Column:
    return F.when(F.length(digits(m)).between(16, 19), luhn(digits(m))).otherwise(F.lit(False))


def pan_ok(m: Column) -> Column:
    return F.when(F.length(digits(m)).between(13, 15), luhn(digits(m))).otherwise(F.lit(False))


def phone_ok(m: Column) -> Column:
    return F.length(digits(m)).between(8, 15)


def iban_ok(m: Column) -> Column:
    return mod97(F.replace(m, F.lit(" "), F.lit("")))


def ssn_ok(m: Column) -> Column:
    return ~m.rlike(r"^(?:000|666|9)") & ~m.rlike(r"-00-|-0000$")


def yes(m: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column]
    hint: str  # a text without a match of this cheap pattern has none of the kind
    score: float = 1.0
    words: str = ""


BASE = (
    Kind("email", EMAIL, yes, "@"),
    Kind("ip", IP, ip_ok, r"[0-9]\.[0-9]"),
    Kind("card", CARD, card_ok, r"(?:[0-9][\x20-]?){15}[0-9]"),
    Kind("phone", PHONE, phone_ok, r"\+[0-9]"),
)
MORE = (
    Kind("iban", IBAN, iban_ok, r"[A-Z]{2}[0-9]{2}", 0.8, IBAN_WORDS),
    Kind("pan", CARD, pan_ok, r"(?:[0-9][\x20-]?){12}[0-9]", 0.4, CARD_WORDS),
    Kind("ssn", SSN, ssn_ok, r"[0-9]-[0-9]{2}-[0-9]", 0.4, SSN_WORDS),
    Kind("tel", TEL, yes, r"[0-9]{3}[\x20.-][0-9]{4}", 0.3, TEL_WORDS),
)


@dataclass(frozen=True)
class Scoring:
    near: int = 40
    word_adds: float = 0.4
    accept: float = 0.7


def step(df: DataFrame, names: list[str], *cols: Column) -> DataFrame:
    """The columns in `names` and new ones, each computed once: as a generator of one row, which no later step, nor a
    filter on its result, is folded into."""
    return df.select(*names, F.inline(F.array(F.struct(*cols))))


def add(a: Column, x: Column) -> Column:
    return a + x


def larger(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), body), 0)


def levels(values: Column, op: Callable[[Column, Column], Column] = add) -> Column:
    """A struct of an array of longs (l0) and, level by level, of runs of FAN values of the one below (l1 ..), taken together
    by op (add or larger; 0 changes nothing)."""
    runs = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(c) - 1, F.lit(0)) / FAN).cast("int")), lambda r: F.aggregate(F.slice(c, r * FAN + 1, FAN), F.lit(0).cast("long"), op))

    def build(done: list[Column]) -> Column:
        if len(done) == LEVELS:
            return F.struct(*[c.alias(f"l{k}") for k, c in enumerate(done)])
        return let(runs(done[-1]), lambda c: build([*done, c]))

    return let(values, lambda c: build([c]))


def prefix(sums: Column, i: Column, op: Callable[[Column, Column], Column] = add) -> Column:
    """op over the first i values that `levels` has been given: at most FAN values of each level."""
    out = F.lit(0).cast("long")
    for k in range(LEVELS):
        high = F.floor(i / FAN**k).cast("int")
        low = F.floor(i / FAN ** (k + 1)).cast("int") * FAN if k < LEVELS - 1 else F.lit(0)
        out = F.aggregate(F.slice(sums[f"l{k}"], low + 1, high - low), out, op)
    return out


def part(pieces: Column, low: Column, high: Column) -> Column:
    """Characters low .. high - 1 of the text that is cut into pieces of PIECE characters."""
    first, last = F.floor(low / PIECE).cast("int"), F.floor((high - 1) / PIECE).cast("int")
    few = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(high > low, F.substring(few, (low - first * PIECE + 1).cast("int"), (high - low).cast("int"))).otherwise(F.lit(""))


def cut_text(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


SPANS = "array<struct<kind:string,s:bigint,e:bigint>>"


def find(docs: DataFrame, id_cols: list[str], text_col: str = "text", scoring: Scoring = Scoring()) -> DataFrame:
    """id_cols, __text (null: empty), __base and __more: arrays of structs (kind, s, e) by kind as listed, then start.

    Any text is taken whole; one without a hint of a kind costs one scan for it. Repeated and null ids pass through.
    """
    kinds = (*BASE, *MORE)
    own = [*id_cols, "__text"]
    df = docs.select(*id_cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    none = F.array().cast("array<string>")
    m = {k.name: f"__m_{k.name}" for k in kinds}
    df = step(df, own, *[F.when(F.col("__text").rlike(k.hint), F.regexp_extract_all("__text", F.lit(k.pattern), F.lit(0))).otherwise(none).alias(m[k.name]) for k in kinds])
    df = step(df, df.columns, *[F.when(F.exists(m[k.name], k.check), F.split("__text", k.pattern, -1)).alias(f"__g_{k.name}") for k in kinds])

    # The length of each match and of the gap after it: a match begins after the first gap and all such before it.
    def lens(k: Kind) -> Column:
        both = F.transform(m[k.name], lambda x, i: (F.length(x) + F.length(F.get(F.col(f"__g_{k.name}"), i + 1))).cast("long"))
        return F.when(F.col(f"__g_{k.name}").isNotNull(), levels(both)).alias(f"__l_{k.name}")

    first = [F.length(F.get(F.col(f"__g_{k.name}"), 0)).cast("long").alias(f"__f_{k.name}") for k in kinds]
    df = step(df, [*own, *m.values()], *first, *map(lens, kinds))

    def places(k: Kind) -> Column:
        get = lambda i: F.get(F.col(m[k.name]), i)
        passed = F.filter(F.sequence(F.lit(0), F.size(m[k.name]) - 1), lambda i: k.check(get(i)))
        begun = F.transform(passed, lambda i: F.struct((F.col(f"__f_{k.name}") + prefix(F.col(f"__l_{k.name}"), i)).alias("s"), F.length(get(i)).alias("n")))
        named = F.transform(begun, lambda x: F.struct(F.lit(k.name).alias("kind"), x["s"].alias("s"), (x["s"] + x["n"]).alias("e")))
        return F.when(F.col(f"__l_{k.name}").isNotNull(), named).otherwise(F.array().cast(SPANS))

    df = step(df, own, F.concat(*[places(k) for k in BASE]).alias("__base"), F.concat(*[places(k) for k in MORE]).alias("__maybe"))
    df = step(df, df.columns, F.when(F.size("__maybe") > 0, cut_text(F.col("__text"))).alias("__pieces"))

    # Candidates of the further kinds, by score; then those that no base span overlaps.
    def score(p: Column) -> Column:
        low, high = F.greatest(p["s"] - scoring.near, F.lit(0).cast("long")), p["e"] + scoring.near
        near = F.concat_ws("\n", part(F.col("__pieces"), low, p["s"]), part(F.col("__pieces"), p["e"], high))
        out = F.lit(None).cast("double")
        for k in MORE:
            out = F.when(p["kind"] == k.name, k.score + F.when(near.rlike(k.words), scoring.word_adds).otherwise(0.0)).otherwise(out)
        return out

    df = step(df, [*own, "__base"], F.filter("__maybe", lambda p: score(p) >= scoring.accept - 1e-9).alias("__sure"))
    order = lambda spans, base: F.transform(spans, lambda p: F.struct(p["s"].alias("s"), p["e"].alias("e"), F.lit(base).alias("base"), p["kind"].alias("kind")))
    every = F.array_sort(F.concat(order(F.col("__base"), True), order(F.col("__sure"), False)))
    df = step(df, df.columns, F.when((F.size("__sure") > 0) & (F.size("__base") > 0), every).alias("__all"))
    ends = F.transform("__all", lambda p: F.when(p["base"], p["e"]).otherwise(F.lit(0).cast("long")))
    df = step(df, df.columns, F.when(F.col("__all").isNotNull(), levels(ends, larger)).alias("__ends"))

    def free(p: Column, i: Column) -> Column:
        # As many spans of each kind begin within a span as it has characters, at most.
        within = F.slice("__all", i + 2, ((p["e"] - p["s"]) * len(kinds)).cast("int"))
        return ~p["base"] & (prefix(F.col("__ends"), i, larger) <= p["s"]) & ~F.exists(within, lambda q: q["base"] & (q["s"] < p["e"]))

    left = F.transform(F.filter("__all", free), lambda p: F.struct(p["kind"].alias("kind"), p["s"].alias("s"), p["e"].alias("e")))
    df = step(df, [*own, "__base"], F.when(F.col("__all").isNull(), F.col("__sure")).otherwise(left).alias("__left"))
    of = lambda k: F.filter("__left", lambda p: p["kind"] == k.name)
    return step(df, [*own, "__base"], F.when(F.size("__left") > 0, F.concat(*map(of, MORE))).otherwise(F.col("__left")).alias("__more"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p["kind"], p["s"].cast("string"), p["e"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all)."""
    df = find(docs, [id_col], text_col)
    count = lambda k: F.size(F.filter("__base", lambda p: p["kind"] == k.name)).cast("long").alias(f"n_{k.name}")
    counts = [count(k) for k in BASE]
    return df.select(id_col, *counts, F.sha2(joined(F.col("__base")), 256).alias("base_sha256"), joined(F.concat("__base", "__more")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; same columns, n_chars anew. Spans that overlap are replaced
    together, from the first one's begin to the last one's end, by the first one's kind (of equal begins the longest).

    Texts without a span, and null ones, stay as they are.
    """
    others = [c for c in docs.columns if c != text_col]
    # The other columns travel under names of their own, so that none can clash with one used here.
    own = {c: f"__o{i}" for i, c in enumerate(others)}
    packed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col(text_col).alias("__t"), F.col(text_col).isNull().alias("__null"))
    df, kept = find(packed, [*own.values(), "__null"], "__t"), [*own.values(), "__null", "__text"]
    by_start = F.array_sort(F.transform(F.concat("__base", "__more"), lambda p: F.struct(p["s"].alias("s"), (-p["e"]).alias("e"), p["kind"].alias("kind"))))
    df = step(df, kept, F.when(F.size("__base") + F.size("__more") > 0, by_start).alias("__spans"))
    ends, some = F.transform("__spans", lambda p: -p["e"]), F.col("__spans").isNotNull()
    df = step(df, df.columns, F.when(some, levels(ends, larger)).alias("__ends"), F.when(some, cut_text(F.col("__text"))).alias("__pieces"))
    upto = F.transform(F.sequence(F.lit(0), F.size("__spans")), lambda i: prefix(F.col("__ends"), i, larger))
    df = step(df, [*kept, "__spans", "__pieces"], F.when(F.col("__spans").isNotNull(), upto).alias("__upto"))
    span = lambda i: F.get(F.col("__spans"), i)
    done = lambda i: F.get(F.col("__upto"), i)
    first = F.filter(F.sequence(F.lit(0), F.size("__spans") - 1), lambda i: span(i)["s"] >= done(i))
    out = F.transform(first, lambda i: F.concat(part(F.col("__pieces"), done(i), span(i)["s"]), F.lit("["), F.upper(span(i)["kind"]), F.lit("]")))
    tail = part(F.col("__pieces"), done(F.size("__spans")), F.length("__text").cast("long"))
    new = F.when(F.col("__spans").isNotNull(), F.concat(F.array_join(out, ""), tail))
    text = F.when(F.col("__null"), F.lit(None)).when(F.col("__spans").isNull(), F.col("__text")).otherwise(new)
    df = step(df, list(own.values()), F.col("__spans").isNull().alias("__same"), text.alias("__new"))
    cols = {c: F.col(n) for c, n in own.items()} | {text_col: F.col("__new")}
    if "n_chars" in others:
        cols["n_chars"] = F.when(F.col("__same"), cols["n_chars"]).otherwise(F.length("__new")).cast(docs.schema["n_chars"].dataType)
    return df.select(*[cols[c].alias(c) for c in docs.columns])
