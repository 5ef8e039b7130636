"""Canonical columns of the estates table, the other names they appear under, and lookups between them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Canonical column names and the variants that inputs and requirements use for them.
ALIASES: dict[str, tuple[str, ...]] = {
    "surface_area": ("superficie_di_riferimento_mq", "superficie", "surface"),
    "energy_class": ("classe", "classe_energetica_ape"),
    "mobility": ("mobilita", "mobilità"),
    "commercial": ("commerciale",),
    "healthcare": ("sanita", "sanità"),
    "green": ("greenery", "verde"),
    "education": ("educazione",),
    "property_type": ("tipologia_bene_immobile",),
    "cadastral_units_count": ("numero_immobili_per_catasto",),
    "latitude": ("coordinata_y", "lat", "latitudine"),
    "longitude": ("coordinata_x", "lon", "longitudine"),
    "energy_score_class": ("ape_score_classe",),
    "energy_score_plant": ("ape_score_impianto",),
    "energy_score_envelope": ("ape_score_involucro",),
    "energy_score_renewables": ("ape_score_rinnovabili",),
    "energy_score_total": ("ape_score_total",),
    "omi_zone": ("zona_omi",),
    "effective_date": ("data_decorrenza",),
    "cadastral_sheet": ("foglio",),
    "cadastral_parcel": ("particella",),
    "distance_km": ("distanza_km",),
    "construction_period": ("construction_year", "epoca_costruzione"),
}

# Energy classes, best first.
ENERGY_CLASSES = ("A4", "A3", "A2", "A1", "B", "C", "D", "E", "F", "G")

#: The five scoring dimensions, in the order that settles ties.
DIMENSIONS = ("location", "regulatory", "energy", "building", "proximity")

ESTATES_DDL = (
    "id string, is_meta_estate boolean, cadastral_units_count int, comune_code string, cadastral_sheet int, cadastral_parcel int, "
    "cadastral_subaltern int, surface_area double, address string, house_number string, latitude double, longitude double, "
    "omi_zone string, property_type string, construction_period string, effective_date timestamp, energy_class string, "
    "commercial double, education double, mobility double, healthcare double, sport double, green double, "
    "energy_score_class int, energy_score_plant int, energy_score_envelope int, energy_score_renewables int, energy_score_total int"
)


def canonical(name: str, aliases: Mapping[str, Iterable[str]] = ALIASES) -> str:
    """The canonical name of a column, itself if it has none."""
    if name in aliases:
        return name
    return next((k for k, v in aliases.items() if name in v), name)


def group(name: str, aliases: Mapping[str, Iterable[str]] = ALIASES) -> tuple[str, ...]:
    """All names of the column, the canonical one first, the rest sorted."""
    top = canonical(name, aliases)
    return (top, *sorted(aliases.get(top, ())))


def resolve(name: str | None, columns: Iterable[str], aliases: Mapping[str, Iterable[str]] = ALIASES) -> str | None:
    """The column of a table that a name means: itself, else its canonical name, else a variant; None if there is none.

    Without any columns to look in, the name is trusted.
    """
    if not name:
        return None
    there = set(columns)
    if not there or name in there:
        return name
    return next((c for c in group(name, aliases) if c in there), None)


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def with_aliases(df: DataFrame) -> DataFrame:
    """df with each canonical column that it lacks added from a variant that it has: a projection, nothing is read twice."""
    missing = {c: r for c in ALIASES if c not in df.columns and (r := resolve(c, df.columns))}
    return df.select("*", *[F.col(r).alias(c) for c, r in missing.items()])
