"""Filters, lookups, paging and row projections over the estates table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import exprs as X
from parcelspark.schema import ENERGY_CLASSES, has, resolve


@dataclass(frozen=True)
class Filters:
    """The filter API. Fields left at their default don't filter; columns that a table lacks don't either."""

    min_surface: float | None = None
    max_surface: float | None = None
    min_score: float | None = None
    max_score: float | None = None
    energy_classes: Sequence[str] = ()
    city: str | None = None
    is_evaluated: bool | None = None
    construction_periods: Sequence[str] = ()
    property_types: Sequence[str] = ()
    asset_utilization: Sequence[str] = ()
    cultural_constraints: Sequence[str] = ()
    is_meta_building: bool | None = None
    run_ids: DataFrame | None = field(default=None, compare=False)  # a table of ids (id)


def parse_lists(params: dict[str, str]) -> Filters:
    """Filters from request parameters: classes part at commas, other lists at bars."""
    lists = {"energy_classes": ",", "construction_periods": "|", "property_types": "|", "asset_utilization": "|", "cultural_constraints": "|"}
    got: dict = {}
    for k, v in params.items():
        if k in lists:
            got[k] = tuple(p.strip() for p in v.split(lists[k]) if p.strip())
        elif k.startswith(("min_", "max_")):
            got[k] = float(v)
        elif k.startswith("is_"):
            got[k] = v.lower() == "true"
        else:
            got[k] = v
    return Filters(**got)


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def apply_filters(df: DataFrame, f: Filters) -> DataFrame:
    """Rows that pass every filter set: plain comparisons, which reach the scan."""
    col = lambda *names: next((F.col(r) for n in names if (r := resolve(n, df.columns))), None)
    tests: list[Column] = []
    if f.city and (c := col("city")) is not None:
        tests.append(F.lower(c) == f.city.lower())
    for name, low, high in (("surface_area", f.min_surface, f.max_surface), ("score", f.min_score, f.max_score)):
        if (c := col(name)) is not None:
            tests += [c >= low] * (low is not None) + [c <= high] * (high is not None)
    if f.energy_classes and (c := col("energy_class")) is not None:
        tests.append(any_of([F.upper(F.trim(c)).startswith(x.strip().upper()) for x in f.energy_classes]))
    if f.is_evaluated is not None and (c := col("is_evaluated")) is not None:
        tests.append(F.coalesce(c, F.lit(False)) == f.is_evaluated)
    if f.construction_periods and (c := col("construction_period")) is not None:
        tests.append(c.isin(*f.construction_periods))
    for values, name in ((f.property_types, "property_type"), (f.asset_utilization, "asset_utilization"), (f.cultural_constraints, "cultural_constraints")):
        if values and (c := col(name)) is not None:
            tests.append(F.lower(c).isin(*[v.lower() for v in values]))
    if f.is_meta_building is not None and (c := col("is_meta_estate")) is not None:
        tests.append(F.coalesce(c, F.lit(False)) == f.is_meta_building)
    out = df.where(reduce(lambda a, b: a & b, tests)) if tests else df
    return out.join(f.run_ids.select("id").distinct(), "id", "left_semi") if f.run_ids is not None else out


def contains_any(column: Column, values: Sequence[str]) -> Column:
    """Whether a text holds one of some values, in any case; null holds none."""
    return any_of([F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(v.lower())) for v in values])


@dataclass(frozen=True)
class MapFilters:
    """The filters of the map. Unlike those of the filter API, a missing surface counts as 0, usage and constraint are parts
    of texts, and there are the legal nature, certificates and tiers."""

    energy_classes: Sequence[str] = ()
    min_surface: float | None = None
    max_surface: float | None = None
    construction_periods: Sequence[str] = ()
    property_types: Sequence[str] = ()
    usage: Sequence[str] = ()
    constraints: Sequence[str] = ()
    is_meta_building: bool | None = None
    legal_nature: str | None = None
    has_certificate: bool | None = None
    tiers: Sequence[int] = ()  # (3,) for top picks, (2, 3) for results


def apply_map_filters(df: DataFrame, f: MapFilters) -> DataFrame:
    """Markers that pass every filter set; a marker without the value asked for doesn't."""
    c, surface = F.col, F.coalesce(F.col("surface_area"), F.lit(0.0))
    tests = [surface >= f.min_surface] * (f.min_surface is not None) + [surface <= f.max_surface] * (f.max_surface is not None)
    if f.energy_classes:
        tests.append(any_of([F.upper("energy_class").startswith(x) for x in f.energy_classes]))
    tests += [c("construction_period").isin(*f.construction_periods)] * bool(f.construction_periods) + [c("property_type").isin(*f.property_types)] * bool(f.property_types)
    tests += [contains_any(c("description"), f.usage)] if f.usage else []
    tests += [contains_any(c("cultural_constraint"), f.constraints)] if f.constraints else []
    if f.is_meta_building is not None:
        tests.append(F.coalesce(c("is_meta_estate"), F.lit(False)) == f.is_meta_building)
    if f.legal_nature:
        tests.append(F.upper("legal_nature") == f.legal_nature.upper())
    if f.has_certificate is not None:
        tests.append((F.coalesce(F.size("energy_files") > 0, F.lit(False)) | F.coalesce(c("energy_class") != "", F.lit(False))) == f.has_certificate)
    tests += [c("tier").isin(*f.tiers)] if f.tiers else []
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def sort_markers(df: DataFrame, by: str) -> DataFrame:
    """Markers by score or surface (largest first, missing as 0), energy (best class first, missing as the worst, unknown
    ones before all) or address (missing as empty); ties by id."""
    place = F.array_position(F.array(*[F.lit(x) for x in ENERGY_CLASSES]), F.coalesce(F.nullif("energy_class", F.lit("")), F.lit(ENERGY_CLASSES[-1])))
    orders = {
        "score": F.coalesce("ranking_score", F.lit(0.0)).desc() if "ranking_score" in df.columns else None,
        "surface": F.coalesce("surface_area", F.lit(0.0)).desc(),
        "energy": place.asc(),
        "address": F.coalesce("address", F.lit("")).asc() if "address" in df.columns else None,
    }
    return df.orderBy(orders[by], "id") if orders.get(by) is not None else df


def by_length(df: DataFrame, column: str) -> DataFrame:
    """Texts by their length, ties by the text."""
    return df.orderBy(F.length(column), column)


def newest_first(df: DataFrame, timestamp: str, key: str) -> DataFrame:
    """Rows by a timestamp in text, newest first and missing last; ties by key."""
    return df.orderBy(F.coalesce(F.col(timestamp).cast("string"), F.lit("")).desc(), key)


def owned(runs: DataFrame, user_id: int | None) -> DataFrame:
    """Runs that a user may see: their own, and those without an owner; without a user all."""
    return runs if user_id is None else runs.where(F.col("user_id").isNull() | (F.col("user_id") == user_id))


def user_by(users: DataFrame, column: str, value: str) -> DataFrame:
    """At most one user with a name or e-mail."""
    return users.where(F.col(column) == value).orderBy("user_id").limit(1)


def taken(users: DataFrame, username: str, email: str, besides: int | None = None) -> tuple[bool, bool]:
    """Whether a user name and an e-mail belong to someone, besides one user: one pass over the users."""
    others = users if besides is None else users.where(F.col("user_id") != besides)
    r = others.agg(F.max((F.col("username") == username).cast("int")), F.max((F.col("email") == email).cast("int"))).first()
    return bool(r[0]), bool(r[1])


def by_id(df: DataFrame, value: str, column: str = "id") -> DataFrame:
    """Point lookup: an equality that the scan's statistics and dictionaries prune by."""
    return df.where(F.col(column) == value).limit(1)


def counted(df: DataFrame) -> DataFrame:
    """One row: the number of rows before paging."""
    return df.agg(F.count("*").alias("total"))


def page(df: DataFrame, offset: int, size: int, order: Sequence[str | Column] = ("id",)) -> DataFrame:
    """Rows offset .. offset + size in a total order, with has_more on each: one row more is asked for."""
    rows = df.orderBy(*order).offset(offset).limit(size + 1)
    numbered = rows.select("*", F.monotonically_increasing_id().alias("__n"))
    last = numbered.agg(F.count("*").alias("__got"))
    kept = numbered.join(F.broadcast(last)).withColumn("has_more", F.col("__got") > size)  # one row
    return kept.orderBy("__n").limit(size).drop("__n", "__got")


# For each output of the light markers, the columns it is taken from, first of those that a table has.
MARKER_COLUMNS: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("id", ("id",), "string"),
    ("lat", ("latitude", "lat", "latitudine", "coordinata_y"), "double"),
    ("lng", ("longitude", "lon", "longitudine", "coordinata_x"), "double"),
    ("property_type", ("property_type", "tipologia_bene_immobile"), "string"),
    ("surface_area", ("surface_area", "superficie_di_riferimento_mq", "superficie"), "double"),
    ("energy_class", ("energy_class", "classe_energetica_ape", "classe"), "string"),
    ("is_meta", ("is_meta_estate",), "boolean"),
)


def markers_lite(df: DataFrame, limit: int = 1000, filters: Filters = Filters()) -> DataFrame:
    """Light map markers: filtered, the first `limit` by id, then those with coordinates; tier 1."""
    rows = apply_filters(df, filters).orderBy("id").limit(limit)
    cast = {"double": X.number, "boolean": X.truthy, "string": lambda c: c.cast("string")}
    cols = [cast[kind](F.col(c)).alias(out) if (c := next((n for n in names if has(df, n)), None)) else F.lit(None).cast(kind).alias(out) for out, names, kind in MARKER_COLUMNS]
    return rows.select(*cols, F.lit(1).alias("tier")).dropna(subset=["lat", "lng"])


# The plain fields of the full markers, of which a table may lack some, and the columns that hold them.
FULL_MARKER: tuple[tuple[str, str], ...] = (
    ("surface_area", "surface_area"), ("construction_year", "construction_period"), ("energy_class", "energy_class"), ("score", "score"), ("price", "price"), ("description", "description"),
    ("rooms", "rooms"), ("bathrooms", "bathrooms"), ("floor", "floor"), ("is_evaluated", "is_evaluated"), ("is_meta_building", "is_meta_estate"), ("annual_rent", "annual_rent"),
    ("third_party_tenure_type", "third_party_tenure_type"), ("start_date", "start_date"), ("cadastral_units_count", "cadastral_units_count"), ("id_list", "id_list"), ("property_type", "property_type"),
    ("legal_nature", "legal_nature"), ("cultural_constraint", "cultural_constraint"), ("purpose", "purpose"), ("omi_zone", "omi_zone"), ("cadastral_sheet", "cadastral_sheet"), ("cadastral_parcel", "cadastral_parcel"),
    ("energy_files", "energy_files"), ("sub_properties", "sub_properties"),
)
FULL_ENERGY = {"total": "total", "class_score": "class", "plant_score": "plant", "envelope_score": "envelope", "renewables_score": "renewables"}
FULL_PROXIMITY = {"healthcare": "healthcare", "mobility": "mobility", "greenery": "green", "education": "education", "commerce": "commercial", "sport": "sport"}


def markers_full(df: DataFrame, limit: int = 1000, filters: Filters = Filters(), city: str = "Torino") -> DataFrame:
    """Full map markers: filtered, the first `limit` by id, then those with coordinates; plain fields by column, address,
    city, energy and proximity scores as of nested buildings. Fields that the table lacks are null."""
    rows = apply_filters(df, filters).orderBy("id").limit(limit)
    names = [resolve(c, rows.columns) for _, c in FULL_MARKER]
    plain = [(F.col(n) if n else F.lit(None).cast("string")).alias(out) for (out, _), n in zip(FULL_MARKER, names, strict=True)]
    b = building_columns(rows, city)
    whole = lambda c, fields: F.when(c.isNotNull(), F.struct(*[c[x].alias(n) for n, x in fields.items()]))
    cols = [F.col("id").cast("string").alias("id"), b["coordinates"]["lat"].alias("lat"), b["coordinates"]["lng"].alias("lng"), b["address"].alias("address"), b["city"].alias("city"), *plain]
    out = rows.select(*cols, whole(b["energy_scores"], FULL_ENERGY).alias("energy_scores"), whole(b["proximity_scores"], FULL_PROXIMITY).alias("proximity_scores"))
    return out.dropna(subset=["lat", "lng"])


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """The first non-null value of those columns that the table has."""
    there = [F.col(n) for n in names if has(df, n)]
    return F.coalesce(*there) if there else F.lit(None)


def building_columns(df: DataFrame, city: str = "Torino") -> dict[str, Column]:
    """The fields of a nested building: coordinates, energy scores (only where one is there), proximity scores, address."""
    get = lambda *names: first_of(df, [x for n in names for x in (n, *_variants(n))])
    parts = ["class", "plant", "envelope", "renewables"]
    scores = {p: X.number(get(f"energy_score_{p}").cast("string")) for p in parts}
    total = F.coalesce(F.nullif(X.number(get("energy_score_total").cast("string")), F.lit(0.0)), sum((F.coalesce(scores[p], F.lit(0.0)) for p in parts[1:]), F.coalesce(scores["class"], F.lit(0.0))))
    energy = F.when(F.coalesce(*scores.values()).isNotNull(), F.struct(*[scores[p].alias(p) for p in parts], total.alias("total")))
    number = get("house_number").cast("string")
    address = F.when(number.isNotNull(), F.concat_ws(", ", get("address").cast("string"), number)).otherwise(get("address").cast("string"))
    near = F.struct(*[X.number(get(n).cast("string")).alias(n) for n in ("commercial", "education", "mobility", "healthcare", "sport", "green")])
    comune = get("comune_code").cast("string")
    return {
        "id": F.col("id").cast("string"),
        "coordinates": F.struct(X.number(get("latitude").cast("string")).alias("lat"), X.number(get("longitude").cast("string")).alias("lng")),
        "address": address,
        "city": F.when(comune == "L219", F.lit(city)).otherwise(comune),
        "property_type": get("property_type").cast("string"),
        "surface_area": X.number(get("surface_area").cast("string")),
        "energy_scores": energy,
        "proximity_scores": near,
    }


def building_struct(df: DataFrame, city: str = "Torino") -> DataFrame:
    """Rows as nested buildings."""
    return df.select(*[c.alias(n) for n, c in building_columns(df, city).items()])


def _variants(name: str) -> tuple[str, ...]:
    from parcelspark.schema import group

    return group(name)[1:]


def evaluation_rows(df: DataFrame, scores: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """Known columns only: scores as whole numbers with 0 for null, texts with N/D for null."""
    whole = [F.bround(X.number(F.col(c), 0.0)).cast("int").alias(c) for c in scores if has(df, c)]
    return df.select("id", *whole, *[F.coalesce(F.col(c).cast("string"), F.lit("N/D")).alias(c) for c in texts if has(df, c)])


def search_text(df: DataFrame, needle: str, columns: Sequence[str]) -> DataFrame:
    """Rows with the needle in one of the columns, in any case."""
    return df.where(any_of([F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle.lower())) for c in columns]))


def since_days(df: DataFrame, column: str, days: int, now: Column | None = None) -> DataFrame:
    return df.where(F.col(column) >= (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {int(days)} DAYS"))


def dated_in_zone(df: DataFrame, date: str = "effective_date", zone: str = "omi_zone") -> DataFrame:
    """Rows with a date and a zone that isn't empty."""
    return df.where(F.col(date).isNotNull() & (F.trim(zone) != ""))


def feedback_of(feedback: DataFrame, agent: str | None = None, building: str | None = None) -> DataFrame:
    """Feedback on an agent, on a building, or, without either, on a run as a whole."""
    if agent is not None:
        return feedback.where(F.col("agent_name") == agent)
    return feedback.where(F.col("building_id") == building if building is not None else F.col("agent_name").isNull() & F.col("building_id").isNull())


def valid_energy(df: DataFrame, kwh: str, surface: str) -> DataFrame:
    """Rows whose use per square metre lies strictly between 0 and 1000."""
    use = F.col(kwh) / F.nullif(F.col(surface), F.lit(0.0))
    return df.where((use > 0) & (use < 1000))
