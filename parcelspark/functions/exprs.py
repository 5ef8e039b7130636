"""Column expressions: distances, clipped scores, ranks, text clean-up. All are built-in functions that Catalyst sees."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0
Val = Column | float | int


def _c(x: Val) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def haversine_km(lat1: Val, lon1: Val, lat2: Val, lon2: Val) -> Column:
    """Great-circle distance in km; null if a coordinate is."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


HAVERSINE_SQL = (
    "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN "
    "2 * 6371.0D * atan2(sqrt(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2)), "
    "sqrt(1 - (pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2))))"
)


def register_sql_functions(spark: SparkSession) -> None:
    """haversine_km as a SQL function: inlined into arithmetic by the optimizer."""
    spark.sql(HAVERSINE_SQL)


def within_km(lat: Column, lon: Column, lat0: float, lon0: float, radius: float) -> Column:
    """Distance test behind a box on plain columns, which reaches the scan as pushed filters."""
    import math

    dlat = math.degrees(radius / EARTH_KM) * 1.0001
    wide = abs(lat0) + dlat
    box = lat.between(lat0 - dlat, lat0 + dlat)
    if wide < 89:
        dlon = dlat / math.cos(math.radians(wide))
        if lon0 - dlon >= -180 and lon0 + dlon <= 180:
            box = box & lon.between(lon0 - dlon, lon0 + dlon)
    return box & (haversine_km(lat, lon, lat0, lon0) <= radius)


def planar_degrees(lat: Val, lon: Val, lat0: Val, lon0: Val) -> Column:
    return F.sqrt(F.pow(_c(lat) - _c(lat0), 2) + F.pow(_c(lon) - _c(lon0), 2))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def number(x: Column, default: float | None = None) -> Column:
    """x as double, with a decimal comma allowed; null or `default` where it is none."""
    text = F.trim(x.cast("string"))
    plain = text.try_cast("double")
    out = F.coalesce(plain, F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))
    out = F.nanvl(out, F.lit(None).cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def whole(x: Column) -> Column:
    """x as a whole number, 0 where it is none."""
    return F.coalesce(number(x).try_cast("long"), F.lit(0).cast("long"))


def day_first(x: Column) -> Column:
    """A timestamp from dd/MM/yyyy, else ISO, else null."""
    return F.coalesce(F.try_to_timestamp(x, F.lit("dd/MM/yyyy")), F.try_to_timestamp(x))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))) == "true", F.lit(False))


def continuous_score(value: Column, target: float | None, op: str, exclusive: bool = False) -> Column:
    """0 to 100 by how far a number meets a threshold (K1): 50 at the threshold, more beyond, 0 on the wrong side."""
    if target is None:
        return F.lit(0.0)
    v, t = number(value, 0.0), float(target)
    zero, full = F.lit(0.0), F.lit(100.0)
    strict = exclusive or op in (">", "<")
    if op in (">=", ">"):
        if t > 0:
            out = F.when((v <= t) if strict else (v < t), zero).otherwise(clip(v / t * 50, 0.0, 100.0))
        else:
            out = F.when((v <= 0) & F.lit(op == ">"), zero).otherwise(full)
    elif op in ("<=", "<"):
        if t > 0:
            out = F.when((v >= t) if strict else (v > t), zero).otherwise(clip(150 - v / t * 100, 0.0, 100.0))
        else:
            out = F.when(v <= 0, full).otherwise(zero)
    else:
        out = F.when(v == t, full).otherwise(zero)
    return F.bround(out, 1)


def preference_scores(prefs: Sequence[str]) -> list[tuple[str, float]]:
    """Cleaned preferences with 100 for the first down to 50 for the last; of a repeated one the last place counts."""
    clean = [p.strip().strip("'\"").lower() for p in prefs]
    n = len(clean)
    scores = {p: 100.0 if n == 1 else round(100 - 50 * i / (n - 1), 1) for i, p in enumerate(clean)}
    return list(scores.items())


def discrete_score(value: Column, prefs: Sequence[str]) -> Column:
    """0 to 100 by the place of a category in a list of preferences (K2): exact match first, else the first that contains it or is in it."""
    if not prefs:
        return F.lit(0.0)
    v = F.lower(F.trim(value.cast("string")))
    scored = preference_scores(prefs)
    out = F.lit(0.0)
    for p, s in reversed(scored):
        out = F.when(F.contains(v, F.lit(p)) | F.contains(F.lit(p), v), F.lit(s)).otherwise(out)
    for p, s in reversed(scored):
        out = F.when(v == p, F.lit(s)).otherwise(out)
    return F.when(v.isNull() | (v == ""), F.lit(0.0)).otherwise(out)


def norm_cdf(z: Column) -> Column:
    """The normal distribution's lower tail by a rational approximation of the error function (error below 2e-7)."""
    # The coefficients of the five-term approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + p * x)
    poly = reduce(lambda acc, c: acc * t + F.lit(c), reversed(a[:-1]), F.lit(a[-1])) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def minutes(km: Column, per_km: int = 12) -> Column:
    """Minutes for a distance: 12 per km on foot, 3 by car."""
    return F.bround(km * per_km, 0)


# Text


def slug(x: Column) -> Column:
    folded = F.translate(F.lower(x), "àáâäãèéêëìíîïòóôöõùúûüçñ", "aaaaaeeeeiiiiooooouuuucn")
    return F.regexp_replace(F.regexp_replace(folded, r"\W+", "_"), r"^_+|_+$", "")


# How a street begins and ends in registers, and what takes its place; {city} is the city or its province.
STREET_PATTERNS = (
    (r"^\d{{5}}\s+", ""),
    (r"^(?:{city})\b\s*-?\s*", ""),
    (r"\s*-?\s*\b(?:{city})$", ""),
    (r"^\d+\s+", ""),
    (r"^[:\-,. ]+", ""),
    (r"^(?:C\.?SO|C/S|C\s+SO|CORS|COROS)\b", "CORSO"),
    (r"^(?:V\.?IA|V/A|V\s+IA)\b", "VIA"),
    (r"^(?:P\.?ZZA|P/Z)\b", "PIAZZA"),
    (r"(?:[ ,]|CIVICO|N\.?)\s*\d+[A-Z\s/-]*$", ""),
    (r"^[ ,]+|[ ,]+$", ""),
)
HOUSE_NUMBER = r"(?:[ ,]|CIVICO|N\.?)\s*(\d+[A-Z\s/-]*)$"


def clean_street(street: Column, city: str = "TORINO", province: str = "TO") -> Column:
    """A street name in lower case without postcode, city, junk and house number, its type spelled out."""
    x = F.upper(F.trim(street))
    for pattern, by in STREET_PATTERNS:
        x = F.regexp_replace(x, pattern.format(city=f"{city}|{province}"), by)
    return F.lower(x)


def house_number(street: Column, given: Column | None = None) -> Column:
    """The given number unless it is none (snc), else the one at the end of the street."""
    found = F.lower(F.trim(F.regexp_extract(F.upper(street), HOUSE_NUMBER, 1)))
    found = F.nullif(found, F.lit(""))
    if given is None:
        return found
    own = F.lower(F.trim(given.cast("string")))
    return F.coalesce(F.when((own != "snc") & (own != ""), own), found)


# The three spellings of a cadastral identifier, in the order in which they are tried.
CADASTRAL_PATTERNS = (
    r"(?i)F\s*(\d+)\s+P\s*(\d+)\s+S\s*(\d+)",
    r"(?i)foglio\s*(\d+).*?part.*?(\d+).*?sub.*?(\d+)",
    r"(\d{1,5})\s*[/-]\s*(\d{1,6})\s*[/-]\s*(\d{1,4})",
)


def cadastral_parts(text: Column) -> Column:
    """(sheet, parcel, subaltern) as an array of texts, by the first spelling that the text holds (J7); null if none."""
    return F.coalesce(*[F.when(text.rlike(p), F.array(*[F.regexp_extract(text, p, i) for i in (1, 2, 3)])) for p in CADASTRAL_PATTERNS])


def cadastral_id(text: Column) -> Column:
    """sheet/parcel/subaltern."""
    return F.array_join(cadastral_parts(text), "/")


# What stands before a place's name, of which the first that fits goes, and then, one after the other, articles.
PLACE_PREFIXES = ("vicino a", "vicino", "presso", "nei pressi di", "in zona", "area di", "distretto di", "intorno a", "davanti a", "fronte")
PLACE_ARTICLES = ("l'", "lo", "la", "il", "a", "di")


def place_name(x: Column) -> Column:
    """A place's name in lower case without what leads to it, and the articles after that."""
    name, prefix = F.lower(F.trim(x)), f"^(?:{'|'.join(PLACE_PREFIXES)})"
    bare = F.trim(F.regexp_replace(name, prefix, ""))
    for article in PLACE_ARTICLES:
        bare = F.trim(F.regexp_replace(bare, f"^{article}", ""))
    return F.when(name.rlike(prefix), bare).otherwise(name)


# A payback time in running text.
PAYBACK = r"(?i)(\d+(?:[.,]\d+)?)\s*(?:anni|anno)\s*(?:di)?\s*(?:ritorno|payback)"


def payback_years(given: Column, full_text: Column) -> Column:
    """The payback time that is stated, else the first that the text speaks of, with a decimal point."""
    found = F.nullif(F.regexp_extract(full_text, PAYBACK, 1), F.lit(""))
    return F.coalesce(given, F.replace(found, F.lit(","), F.lit(".")))


def interventions(text: Column, first: int = 3) -> Column:
    """The first few parts of a list in text, parted by lines, semicolons, bullets and hyphens, those of over two characters."""
    parts = F.filter(F.split(text, r"[\r\n;•\-]+"), lambda x: F.length(F.trim(x)) > 2)
    return F.coalesce(F.slice(F.transform(parts, lambda x: F.btrim(x, F.lit(" .:;"))), 1, first), F.array().cast("array<string>"))


def places_in(x: Column) -> Column:
    """The places of a text that parts them by semicolons, without empty ones and those that say there is none."""
    parts = F.transform(F.split(x, ";"), lambda p: F.btrim(p, F.lit(" \t\r\n")))
    return F.filter(parts, lambda p: (p != "") & ~F.contains(F.upper(p), F.lit("NESSUN LUOGO")))


def list_of(x: Column) -> Column:
    """An array from a list written as text: ['a', 'b'], ["a"], or a, b."""
    inner = F.regexp_replace(F.trim(x), r"^\[|\]$", "")
    parts = F.transform(F.split(inner, ","), lambda p: F.regexp_replace(F.trim(p), r"^['\"]|['\"]$", ""))
    return F.filter(parts, lambda p: p != "")


def file_name(x: Column) -> Column:
    return F.regexp_extract(x, r"([^/\\]+)$", 1)


# First characters of encoded images and their kinds; what is none of them counts as the first kind.
IMAGE_KINDS = (("iVBOR", "image/png"), ("/9j/", "image/jpeg"), ("R0lGOD", "image/gif"))


def mime_of_base64(x: Column) -> Column:
    return reduce(lambda acc, k: F.when(x.startswith(k[0]), F.lit(k[1])).otherwise(acc), reversed(IMAGE_KINDS), F.lit(IMAGE_KINDS[0][1]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often it is referred to."""
    return F.get(F.transform(F.array(value), body), 0)


def _mended(x: Column) -> Column:
    """A text that is nearly JSON with its usual faults mended: escaped quotes around everything, Python's words and single
    quotes, commas before a closing bracket, brackets left open at the end."""

    def words(t: Column) -> Column:
        for pattern, by in ((r"([:\[,{]\s*)'((?:[^'\"\\]|\\.)*)'(?=\s*[,\]}:])", '$1"$2"'), (r"([:\[,]\s*)True\b", "$1true"), (r"([:\[,]\s*)False\b", "$1false"), (r"([:\[,]\s*)None\b", "$1null"), (r",(?=\s*[}\]])", "")):
            t = F.regexp_replace(t, pattern, by)
        return t

    missing = lambda t, o, c: F.greatest(F.regexp_count(t, F.lit(o)) - F.regexp_count(t, F.lit(c)), F.lit(0))
    closed = lambda t: F.concat(t, F.repeat(F.lit("]"), missing(t, r"\[", r"\]")), F.repeat(F.lit("}"), missing(t, r"\{", r"\}")))
    quoted = lambda t: F.when(t.rlike(r'(?<!\\)"'), t).otherwise(F.replace(t, F.lit('\\"'), F.lit('"')))
    return let(x, lambda t: let(words(quoted(t)), closed))


def json_value(x: Column) -> Column:
    """The outermost object or list of a model's answer as a variant, after thoughts and outside a fence, if need be with
    its usual faults mended; null if it isn't JSON (J16)."""
    bare = F.trim(F.regexp_replace(x, r"(?s)<think>.*?</think>", ""))
    inside = lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?(.*?)```", 1), F.lit("")), t)
    whole = lambda t: F.nullif(F.regexp_extract(t, r"(?s)([{\[].*[}\]])", 1), F.lit(""))
    open_end = lambda t: F.nullif(F.regexp_extract(t, r"(?s)([{\[].*)", 1), F.lit(""))
    tries = lambda t: F.coalesce(F.try_parse_json(whole(t)), F.try_parse_json(_mended(whole(t))), F.try_parse_json(_mended(open_end(t))))
    return let(bare, lambda t: let(inside(t), tries))


def json_object(x: Column) -> Column:
    """The same, where it is an object."""
    return let(json_value(x), lambda v: F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def top_carriers(consumption: Column, heat_value: Column, n: int = 5) -> Column:
    """The n largest positive energies of a carrier -> amount map, as (carrier, energy), by amount times heating value."""
    energy = F.transform_values(consumption, lambda k, v: v * F.coalesce(F.element_at(heat_value, k), F.lit(1.0)))
    entries = F.transform(F.map_entries(F.map_filter(energy, lambda k, v: v > 0)), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("carrier")))
    return F.transform(F.slice(F.array_sort(entries), 1, n), lambda e: F.struct(e["carrier"].alias("carrier"), (-e["minus"]).alias("energy")))
