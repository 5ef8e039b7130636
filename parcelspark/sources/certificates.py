"""Energy certificates in XML: rows of the estates table, and the detailed view of one certificate.

A document is read once, by Python's expat, and all paths are looked up in its elements. Paths name elements without
their prefixes, which are taken off the tags beforehand. A document that isn't well-formed gives a row without values,
as one without elements does.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import lru_cache
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from parcelspark.functions import exprs as X
from parcelspark.operators.rollup import energy_percentile, energy_points, expert_points

# Codes of certificates and what they stand for.
ENVELOPE_LABELS = {"0": "Good", "1": "Neutral", "2": "Poor"}
FACE_LABELS = {"0": "Smiling", "1": "Neutral/Amazed", "2": "Sad"}
USE_LABELS = {
    "0": "Residential (Continuous)", "1": "Hospitals, retirement homes, prisons, barracks, convents", "2": "Residential (Temporary/Holiday)", "3": "Hotels, pensions, and similar",
    "4": "Offices and similar", "5": "Hospitals, clinics, nursing homes and similar", "6": "Cinemas, theaters, congress halls and similar",
    "7": "Exhibitions, museums, libraries, places of worship and similar", "8": "Bars, restaurants, dance halls and similar", "9": "Commercial activities and similar",
    "10": "Swimming pools, saunas and similar", "11": "Gyms and similar", "12": "Sports support services", "13": "Schools and educational activities", "14": "Industrial and artisanal activities",
}
PLANT_LABELS = {
    "0": "Standard boiler", "1": "Condensing boiler", "2": "Stove or fireplace", "3": "Electric heating", **{str(k): "Heat pump" for k in range(4, 16)}, "16": "Solar thermal system",
    "17": "Photovoltaic system", "18": "Cogenerator", "19": "District heating", "32": "Gas water heater", "33": "Gas water heater", "35": "Heat pump water heater", "36": "Electric boiler",
}
DETAIL_PLANT_LABELS = PLANT_LABELS | {"34": "Heat pump water heater"}
# Energy carriers: their element, their names in the table and in the detailed view, kWh of a unit.
CARRIERS = (
    ("energiaElettricaRete", "Electricity from grid", "Grid electricity", 1.0),
    ("gasNaturale", "Natural gas", "Natural gas", 9.94),
    ("gpl", "LPG", "LPG", 12.778),
    ("carbone", "Coal", "Coal", 7.917),
    ("gasolio", "Diesel", "Diesel", 11.87),
    ("olioCombustibile", "Fuel oil", "Heating oil", 11.75),
    ("biomasseSolide", "Solid biomass", "Solid biomass", 4.67),
    ("biomasseLiquide", "Liquid biomass", "Liquid biomass", 7.5),
    ("biomasseGassose", "Gaseous biomass", "Gaseous biomass", 6.4),
    ("solareFotovoltaico", "Solar photovoltaic", "Photovoltaic solar", 1.0),
    ("solareTermico", "Solar thermal", "Thermal solar", 1.0),
    ("eolico", "Wind", "Wind", 1.0),
    ("teleriscaldamento", "District heating", "District heating", 1.0),
    ("teleraffrescamento", "District cooling", "District cooling", 1.0),
)
# Flags of services that are there, with their names.
SERVICES = (("climatizzazioneEstiva", "Cooling"), ("ventilazioneMeccanica", "Ventilation"), ("illuminazione", "Lighting"), ("trasportoPersoneCose", "Elevators/Transport"))
# Where a certificate holds each field, in order of preference.
GENERAL, PERFORMANCE, PLANTS = "//datiGenerali", "//prestazioneGlobale", "//datiImpianti"
CADASTRE = "(//datiCatastali)[1]"
PATHS: dict[str, tuple[str, ...]] = {
    "epc_id": ("//datiAttestato/codiceIdentificativo",),
    "address": (f"{GENERAL}/indirizzo", "//datiCalcolo/datiGenerali/indirizzo"),
    "house_number": (f"{GENERAL}/datiIdentificativi/numeroCivico", f"{GENERAL}/datiIdentificativi/civico", "//datiCalcolo/datiGenerali/civico", "//civico"),
    "city": (f"{GENERAL}/datiExtra/comune", "//datiCalcolo/datiGenerali/comune"),
    "climate_zone": (f"{GENERAL}/zonaClimatica", "//datiCalcolo/datiGenerali/zonaClimatica"),
    "construction_period": (f"{GENERAL}/annoCostruzione", f"{GENERAL}/datiIdentificativi/annoCostruzione"),
    "latitude": (f"{GENERAL}/LatitudineGIS", "//datiCalcolo/datiGenerali/latitudineGIS", "//latitudineGIS"),
    "longitude": (f"{GENERAL}/LongitudineGIS", "//datiCalcolo/datiGenerali/longitudineGIS", "//longitudineGIS"),
    "surface_area": (f"{GENERAL}/datiIdentificativi/superficieUtileRiscaldata",),
    "effective_date": ("//dataEmissione",),
    "use_code": (f"{GENERAL}/destinazioneUso",),
    "dpr412_code": (f"{GENERAL}/classificazioneDPR412",),
    "attestation_object_code": (f"{GENERAL}/oggettoAttestato",),
    "building_typology_code": ("//datiExtra/tipologiaEdilizia",),
    "floor": (f"{GENERAL}/piano", "//datiFabbricato//piano"),
    "energy_class": (f"{PERFORMANCE}/prestazioneEnergeticaGlobale/classificazione/classeEnergetica",),
    "epglnren": (f"{PERFORMANCE}/prestazioneEnergeticaGlobale/classificazione/epglnren",),
    "epglren": ("//prestazioneImpianti/epglren",),
    "co2_emissions": ("//prestazioneImpianti/emissioniCO2",),
    "comune_code": (f"{CADASTRE}/codiceCatastale",),
    "cadastral_sheet": (f"{CADASTRE}/foglio",),
    "cadastral_parcel": (f"{CADASTRE}/particella",),
    "sub_from": (f"{CADASTRE}//subalterni/subDA",),
    "sub_to": (f"{CADASTRE}//subalterni/subA",),
    "winter_code": (f"{PERFORMANCE}/prestazioneEnergeticaFabbricato/inverno",),
    "summer_code": (f"{PERFORMANCE}/prestazioneEnergeticaFabbricato/estate",),
    "target_energy_class": ("//raccomandazioni//classificazioneRaggiungibile/classeEnergetica", f"{PERFORMANCE}//classeEnergeticaRaggiungibile"),
    "payback_period": ("//raccomandazioni//tempoRitornoInvestimento",),
    "heating_nominal_power": (f"{PLANTS}/climatizzazioneInvernale/impianto/potenzaNominale",),
    "dhw_nominal_power": (f"{PLANTS}/produzioneACS/impianto/potenzaNominale",),
    "opaque_envelope_area": ("//fabbricato/altriDatiSintetici/superficieOpacaTotale",),
    "transparent_envelope_area": ("//fabbricato/altriDatiSintetici/superficieVetrataTotale",),
    "heating_energy_need": ("//datiFabbricato/ephnd",),
    "cooling_energy_need": ("//datiFabbricato/epcnd",),
    "heating_limit": ("//datiExtra/ephndLim",),
    "primary_energy_limit": ("//datiExtra/EPglnrenRifStandard",),
    "assessor_name": ("//soggettoCertificatore/nome",),
    "assessor_surname": ("//soggettoCertificatore/cognome",),
}
# Where the plants of a service stand, the second place only if the first isn't there.
SYSTEMS = {
    "heating": (f"{PLANTS}//climatizzazioneInvernale", "//impianti//impiantoClimatizzazioneInvernale"),
    "dhw": (f"{PLANTS}//produzioneACS", "//impianti//impiantoAcquaCaldaSanitaria"),
    "cooling": (f"{PLANTS}//climatizzazioneEstiva", "//impianti//impiantoClimatizzazioneEstiva"),
}
# What only the detailed view reads.
NAMED = "translate(local-name(),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
MORE_PATHS: dict[str, tuple[str, ...]] = {
    "energy_class_ref": (f"{PERFORMANCE}/riferimenti/classificazioneNuovi/classeEnergetica",),
    "epglnren_ref": (f"{PERFORMANCE}/riferimenti/classificazioneNuovi/epglnren",),
    "section": (f"{CADASTRE}/sezione",),
    "identifier": (f"{GENERAL}/datiIdentificativi/identificativoCatastale",),
    "any_comune_code": ("//codiceCatastale",),
    "improvements": ("//informazioniMiglioramento", "//raccomandazioni"),
    "any_floor": (f"//*[contains({NAMED},'piano')][1]",),
    "any_target": (f"//*[contains({NAMED},'classe') and contains({NAMED},'raggiung')][1]", f"//*[contains({NAMED},'classe') and contains({NAMED},'miglior')][1]"),
    "whole_text": ("/*",),
}
NUMBERS = (
    "latitude", "longitude", "surface_area", "epglnren", "epglren", "co2_emissions", "payback_period", "heating_nominal_power", "dhw_nominal_power",
    "opaque_envelope_area", "transparent_envelope_area", "heating_energy_need", "cooling_energy_need", "heating_limit", "primary_energy_limit",
)
# Columns that the finished table leaves out, and those that come first in it.
TECHNICAL = ("dhw_system_type", "dhw_system_year", "heating_system_type", "heating_system_year", "renewable_sources", "envelope_summer_quality", "envelope_winter_quality", "floor", "has_dhw", "has_heating", "payback_period")
FIRST = ("id", "is_meta_estate", "cadastral_units_count", "id_list", "ape_file_list", "ape_file_list_filtered", "ape_file_list_filtered_parsed")

GAP = "␟"
STEP = re.compile(r"(//?)([\w.-]+|\*)((?:\[[^\[\]]*\])*)")


def steps(path: str) -> list[tuple]:
    """A path as steps (below, name, conditions): `below` at any depth; a condition is "1", the first of a parent's, or a
    test of names. A path in brackets with [1], of which only the first element counts, ends in the step None."""
    head = re.match(r"\(([^()]*)\)\[1\]", path)
    out = [*steps(head[1]), None] if head else []
    rest = path[head.end() :] if head else path
    for m in STEP.finditer(rest):
        out.append((m[1] == "//", m[2], tuple(_condition(c) for c in re.findall(r"\[([^\[\]]*)\]", m[3]))))
    if "".join(m[0] for m in STEP.finditer(rest)) != rest:
        raise ValueError(f"not a path that is read here: {path}")
    return out


def _condition(text: str) -> str | tuple[str, ...]:
    words = tuple(re.findall(re.escape(f"contains({NAMED},'") + r"(\w+)'\)", text))
    both, either = (sign.join(f"contains({NAMED},'{w}')" for w in words) for sign in (" and ", " or "))
    if text == "1" or not words or text not in (both, either):
        if text != "1":
            raise ValueError(f"not a condition that is read here: {text}")
        return "1"
    return ("and" if text == both else "or", *words)


@lru_cache(4096)
def _fits(tag: str, condition: tuple[str, ...]) -> bool:
    low = tag.rpartition(":")[2].translate(_LOWER)
    return (all if condition[0] == "and" else any)(w in low for w in condition[1:])


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _children(parent: ElementTree.Element, name: str, conditions: tuple) -> list[ElementTree.Element]:
    got = list(parent) if name == "*" else [e for e in parent if e.tag == name]
    for c in conditions:
        got = got[:1] if c == "1" else [e for e in got if _fits(e.tag, c)]
    return got


def _tree(doc: str) -> ElementTree.Element:
    """The elements under a node of their own, names as they are written; empty if the document can't be read."""
    builder, parser = ElementTree.TreeBuilder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = (lambda tag, _: builder.start(tag, {})), builder.end, builder.data
    top = ElementTree.Element("")
    builder.start("", {})
    try:
        parser.Parse(doc, True)
        builder.end("")
        top = builder.close()
    except expat.ExpatError:
        pass
    return top


def planned(paths: Sequence[str]) -> list[list[tuple[int, tuple | None]]]:
    """Each path as steps with numbers, the same for paths that begin alike."""
    numbers: dict[tuple, int] = {}
    return [[(numbers.setdefault(tuple(s[: k + 1]), len(numbers)), step) for k, step in enumerate(s)] for s in map(steps, paths)]


def texts_at(doc: str, paths: Sequence[Sequence[tuple]]) -> list[str]:
    """For each path, as planned, the text of the first element in the document's order, empty if there is none."""
    top = _tree(doc)
    order = {e: i for i, e in enumerate(top.iter())}
    named: dict[str, list] = {}
    for e in order:
        named.setdefault(e.tag, []).append(e)
    out, known = [], {}
    for path in paths:
        found = [top]
        for at, step in path:
            if at not in known:
                if step is None:
                    found = [min(found, key=order.__getitem__)] if found else []
                elif found[0] is top and step[0] and not step[2] and step[1] != "*":
                    found = named.get(step[1], [])
                else:
                    below, name, conditions = step
                    parents = order if below and found[0] is top else dict.fromkeys(p for e in found for p in (e.iter() if below else (e,)))
                    found = list(dict.fromkeys(c for p in parents for c in _children(p, name, conditions)))
                known[at] = found
            found = known[at]
            if not found:
                break
        out.append("".join(min(found, key=order.__getitem__).itertext()) if found else "")
    return out


def _reader(paths: Sequence[str], at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with a last column of the texts at the paths of the document in column `at`."""
    every = planned(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([texts_at(d.as_py(), every) for d in b.column(at)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if i != at), got], [*(n for i, n in enumerate(b.schema.names) if i != at), "__v"])

    return run


def plant_paths(base: str) -> dict[str, str]:
    """Where the first plant of a service says what, below the service's element."""
    return {
        "there": base,
        "code": f"{base}//impianto[1]/tipoImpianto",
        "description": f"{base}//impianto[1]/descrizioneImpianto",
        "year": f"{base}//*[contains({NAMED},'install') and contains({NAMED},'anno')][1]",
        "epnren": f"{base}//prestazione/epnren",
        "other": f"{base}//*[contains({NAMED},'tecnolog') or contains({NAMED},'tipogener') or contains({NAMED},'tipo')][1]",
    }


def wrapped(xml: Column) -> Column:
    """The document as one element, without what may stand only at its beginning, tags without their prefixes; null if it
    isn't well-formed."""
    body = F.regexp_replace(xml, r"(?s)<\?xml.*?\?>|<!DOCTYPE[^\[>]*(?:\[.*?\])?\s*>", "")
    body = F.regexp_replace(body, r"(</?)[A-Za-z_][\w.-]*:(?=[A-Za-z_])", "$1")
    whole = F.concat(F.lit("<certificate>"), F.replace(body, F.lit(GAP), F.lit("")), F.lit("</certificate>"))
    broken = F.from_xml(whole, "broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})["broken"]
    return F.when(broken.isNull(), whole)


def once(df: DataFrame, kept: Sequence[str], cols: Mapping[str, Column]) -> DataFrame:
    """The kept columns and new ones, each computed once: as a generator of one row, which later steps aren't folded into."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def values(df: DataFrame, paths: Mapping[str, Sequence[str]], xml: str) -> DataFrame:
    """df with a column `name` for each entry: the first non-empty text of its paths, trimmed, else null."""
    flat = [p for ps in paths.values() for p in ps]
    texts = df.withColumn("__doc", F.coalesce(wrapped(F.col(xml)), F.lit("<certificate/>")))
    texts = texts.mapInArrow(_reader(flat, len(df.columns)), StructType([*df.schema.fields, StructField("__v", ArrayType(StringType()))]))
    clean = lambda i: F.nullif(F.regexp_replace(F.get(F.col("__v"), i), r"^\s+|\s+$", ""), F.lit(""))
    out, at = {}, 0
    for name, ps in paths.items():
        out[name] = F.coalesce(*[clean(at + i) for i in range(len(ps))])
        at += len(ps)
    return once(texts, df.columns, out)


def label(code: Column, labels: Mapping[str, str]) -> Column:
    """What a code stands for, null for none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), code)


def all_paths(detail: bool) -> dict[str, tuple[str, ...]]:
    out = {f"v_{k}": p for k, p in (PATHS | (MORE_PATHS if detail else {})).items()}
    for service, bases in SYSTEMS.items():
        for n, base in enumerate(bases):
            out |= {f"s_{service}_{n}_{k}": (p,) for k, p in plant_paths(f"({base})[1]").items()}
    flags = [("climatizzazioneInvernale", "heating"), ("produzioneAcquaCaldaSanitaria", "dhw"), *((tag, tag) for tag, _ in SERVICES)]
    out |= {f"f_{name}": (f"{GENERAL}/serviziEnergeticiPresenti/{tag}",) for tag, name in flags}
    out |= {f"f_{name}_simulated": (f"{PLANTS}/{tag}/impiantoSimulato",) for tag, name in (("climatizzazioneInvernale", "heating"), ("produzioneACS", "dhw"))}
    return out | {f"c_{tag}": (f"//prestazioneImpianti/{tag}/consumoAnnuo",) for tag, *_ in CARRIERS}


def plant(service: str, key: str) -> Column:
    """A plant's text from the first of the service's places that is there."""
    first, second = (F.col(f"s_{service}_{n}_{key}") for n in (0, 1))
    there = [f"s_{service}_0_{k}" for k in ("there", "code", "description", "year", "epnren", "other")]
    return F.when(F.coalesce(*[F.col(c) for c in there]).isNotNull(), first).otherwise(second)


def services(lifts: str = "Elevators/Transport") -> Column:
    """Names of the services that are there; heating and hot water only with plants that aren't simulated."""
    own = [F.when((F.col(f"f_{n}") == "true") & F.col(f"f_{n}_simulated").isNull(), F.lit(text)) for n, text in (("heating", "Heating"), ("dhw", "DHW"))]
    more = [F.when(F.lower(f"f_{tag}") == "true", F.lit(lifts if tag.startswith("trasporto") else text)) for tag, text in SERVICES]
    return F.array_compact(F.array(*own, *more))


def carriers(detail: bool) -> Column:
    """(carrier, kwh) of all carriers with a number, the largest first, of equals the first listed."""
    each = [F.struct((-X.number(F.col(f"c_{tag}")) * heat).alias("minus"), F.lit(i).alias("i"), F.lit(long if detail else short).alias("carrier")) for i, (tag, short, long, heat) in enumerate(CARRIERS)]
    there = F.array_sort(F.filter(F.array(*each), lambda x: x["minus"].isNotNull()))
    return F.transform(there, lambda x: F.struct(x["carrier"].alias("carrier"), (-x["minus"]).alias("kwh")))


def subaltern() -> Column:
    """The first and last subaltern without leading zeros: one if they are equal or one is missing, else with a comma."""
    bare = lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.nullif(F.regexp_replace(c, "^0+", ""), F.lit("")), F.lit("0")))
    low, high = bare("v_sub_from"), bare("v_sub_to")
    return F.when(low == high, low).otherwise(F.nullif(F.concat_ws(",", low, high), F.lit("")))


def shred(df: DataFrame, comune: str | None = None, xml: str = "xml", file: str = "file") -> DataFrame:
    """(file, xml) rows as rows of the estates table before roll-ups: codes by their labels, decimal commas, day-first dates,
    services, main carrier, plants, ingest points. comune: the code of certificates that hold none."""
    v = values(df.select(file, xml), all_paths(False), xml)
    col = lambda n: X.number(F.col(f"v_{n}")) if n in NUMBERS else X.day_first(F.col("v_effective_date")) if n == "effective_date" else F.col(f"v_{n}")
    plain = [col(n).alias(n) for n in PATHS if n not in ("comune_code", "sub_from", "sub_to", "winter_code", "summer_code", "use_code", "dpr412_code")]
    code = F.coalesce("v_comune_code", F.lit(comune).cast("string"))
    text = lambda c: F.coalesce(c, F.lit("None"))
    unit = F.coalesce(subaltern(), F.regexp_replace(file, r"\.[^.]*$", ""))
    sun = lambda tag: F.coalesce(X.number(F.col(f"c_{tag}")), F.lit(0.0)) > 0
    out = v.select(
        F.array(file).alias("ape_file_list"), *plain, code.alias("comune_code"), subaltern().alias("cadastral_subaltern"), F.col("v_dpr412_code").alias("dpr412_class_code"), F.col("v_use_code").alias("use_destination_code"),
        label(F.col("v_dpr412_code"), USE_LABELS).alias("property_type"), label(F.col("v_winter_code"), ENVELOPE_LABELS).alias("envelope_winter_quality"), label(F.col("v_summer_code"), ENVELOPE_LABELS).alias("envelope_summer_quality"),
        services().alias("services_present"), F.try_element_at(carriers(False), F.lit(1))["carrier"].alias("main_energy_carrier"),
        F.when(sun("solareFotovoltaico") | sun("solareTermico"), "Yes").otherwise("No").alias("renewable_sources"),
        *[F.coalesce(label(plant(s, "code"), PLANT_LABELS), plant(s, "description")).alias(f"{s}_system_type") for s in ("heating", "dhw")], *[plant(s, "year").alias(f"{s}_system_year") for s in ("heating", "dhw")],
        F.concat_ws("_", text(code), text(F.col("v_cadastral_sheet")), text(F.col("v_cadastral_parcel")), unit).alias("id"),
    )
    out = out.withColumns({"has_heating": F.array_contains("services_present", "Heating"), "has_dhw": F.array_contains("services_present", "DHW"), "is_meta_estate": F.lit(False), "cadastral_units_count": F.lit(1), "id_list": F.array("id")})
    return energy_points(out, "heating_system_type", "envelope_winter_quality", "renewable_sources")


def of_comune(df: DataFrame, comune: str) -> DataFrame:
    return df.where(F.col("comune_code") == comune)


def finished(df: DataFrame, technical: Sequence[str] = TECHNICAL, first: Sequence[str] = FIRST) -> DataFrame:
    """df without technical columns, with ids and file lists before the others."""
    kept = [c for c in df.columns if c not in technical]
    return df.select(*[c for c in first if c in kept], *[c for c in kept if c not in first])


def detail(df: DataFrame, xml: str = "xml", file: str = "file") -> DataFrame:
    """(file, xml) rows as detailed certificates: further cadastral fields, the five largest carriers, plants of three
    services, target class, payback time and proposed interventions, expert points."""
    v = values(df.select(file, xml), all_paths(True), xml)
    col = lambda n: F.col(f"v_{n}")
    found = X.cadastral_parts(col("identifier"))
    ranked = F.filter(F.transform(carriers(True), lambda x: F.struct(x["carrier"].alias("carrier"), F.bround(x["kwh"], 2).alias("kwh"), (x["kwh"] > 0).alias("some"))), lambda x: x["some"])
    top = F.transform(ranked, lambda x: F.struct(x["carrier"].alias("carrier"), x["kwh"].alias("kwh")))
    numbers = {n: X.number(col(n)) for n in ("epglnren", "epglren", "co2_emissions", "surface_area", "latitude", "longitude", "epglnren_ref")}
    cadastre = col("sub_from").isNotNull() | col("sub_to").isNotNull()
    sheet, parcel = F.coalesce(col("cadastral_sheet"), F.get(found, 0)), F.coalesce(col("cadastral_parcel"), F.get(found, 1))
    plants = {}
    for s in SYSTEMS:
        plants[f"{s}_system_desc"] = F.coalesce(label(plant(s, "code"), DETAIL_PLANT_LABELS), plant(s, "description"), plant(s, "other"))
        plants |= {f"{s}_system_year": plant(s, "year"), f"{s}_system_type": plant(s, "code"), f"{s}_system_epnren": X.number(plant(s, "epnren"))}
    sun = lambda tag: F.coalesce(X.number(F.col(f"c_{tag}")), F.lit(0.0)) > 0
    winter = F.coalesce(label(col("winter_code"), FACE_LABELS), col("winter_code"))
    cols = [
        *[col(n).alias(n) for n in ("epc_id", "address", "house_number", "climate_zone", "use_code", "attestation_object_code", "building_typology_code", "energy_class", "energy_class_ref", "section", "assessor_name", "assessor_surname")],
        *[c.alias(n) for n, c in numbers.items()], col("city").alias("municipality"), col("construction_period").alias("construction_year"), col("effective_date").alias("emission_date"),
        F.coalesce(col("floor"), col("any_floor")).alias("floor"), F.coalesce(col("comune_code"), F.when(sheet.isNotNull() | parcel.isNotNull(), col("any_comune_code"))).alias("cadastral_code"),
        sheet.alias("sheet"), parcel.alias("parcel"), F.get(found, 2).alias("subaltern"), F.when(cadastre, col("sub_to")).otherwise(F.get(found, 2)).alias("sub_a"), col("sub_from").alias("sub_da"),
        col("winter_code").alias("winter_quality_code"), winter.alias("winter_quality"), col("summer_code").alias("summer_quality_code"), F.coalesce(label(col("summer_code"), FACE_LABELS), col("summer_code")).alias("summer_quality"),
        services("Lifts/Transport").alias("present_services"), F.slice(top, 1, 5).alias("top_vectors"), F.try_element_at(top, F.lit(1))["carrier"].alias("main_energy_vector"),
        F.aggregate(carriers(True), F.lit(0.0), lambda a, x: a + x["kwh"]).alias("total_annual_kwh"),
        F.when(sun("solareFotovoltaico") | sun("solareTermico"), "Yes").otherwise("No").alias("renewable_sources"), F.coalesce(col("target_energy_class"), col("any_target")).alias("target_class"),
        X.payback_years(col("payback_period"), col("whole_text")).alias("payback_period"), X.interventions(col("improvements")).alias("suggested_interventions"), *[c.alias(n) for n, c in plants.items()],
    ]
    out = v.select(file, F.inline(F.array(F.struct(*cols))))
    points, grade = expert_points(F.col("energy_class"), F.col("heating_system_desc"), F.col("winter_quality"), F.col("renewable_sources"))
    return out.withColumns({"energy_total_points": points, "energy_raw_score": grade})


def detail_view(details: DataFrame, file: str | None = None) -> DataFrame:
    """What the view of a certificate shows: texts and numbers without NaN, flags of services, and by its use the percentile,
    the yearly cost and the distance from the mean of its like; of one file, if asked for. The comparison is with all
    certificates of the table."""
    scored = energy_percentile(details, "use_code", "total_annual_kwh", "surface_area")
    some = lambda c: F.when(~F.isnan(c), c)
    has = lambda name: F.array_contains("present_services", name)
    kinds = dict(details.dtypes)
    plain = [some(F.col(c)).alias(c) if kinds[c] == "double" else F.col(c) for c in details.columns if c != "present_services"]
    flags = {"heating_service": "Heating", "hot_water_service": "DHW", "cooling_service": "Cooling", "ventilation_service": "Ventilation", "lighting_service": "Lighting", "transport_service": "Lifts/Transport"}
    x = F.col("total_annual_kwh") / F.nullif(F.col("surface_area"), F.lit(0.0))
    out = scored.select(
        *plain, *[has(name).alias(flag) for flag, name in flags.items()], F.col("energy_percentile").alias("energy_score"), F.bround(x, 1).alias("kwh_per_sqm"), F.bround("energy_cost", 2).alias("annual_cost_estimate"),
        F.bround("energy_cost_m2", 2).alias("cost_per_sqm_year"), F.col("energy_mean_m2").alias("average_kwh_sqm_comparison"), F.col("energy_diff_pct").alias("percentage_difference_comparison"),
    )
    return out.where(F.col("file") == file) if file is not None else out
