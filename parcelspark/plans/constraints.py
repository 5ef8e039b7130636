"""Constraints as data: severity, building from requirement dictionaries, rendering to Columns and SQL text, checks, repair.

These are small driver-side values. Rows meet them only as the Column conjunction that `render` gives.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions.exprs import haversine_km, within_km
from parcelspark.schema import ALIASES, canonical, group, resolve

# Columns that say which building is meant; a building constraint on one is hard.
IDENTITY = frozenset(("property_type", "id", "comune_code", "cadastral_sheet", "cadastral_parcel", "cadastral_subaltern", "cadastral_units_count"))
SEVERITIES = ("hard", "soft", "ranking_only", "human_review")
COMPARISONS = (">=", "<=", ">", "<", "=", "==", "!=", "<>")
SOURCES = ("building", "energy", "regulatory", "proximity")
DEFAULT_RADIUS_KM = 3.0
# Other spellings of identity columns.
IDENTITY_VARIANTS = {"codice_comune": "comune_code", "subalterno": "cadastral_subaltern", "number_immobili_per_catasto": "cadastral_units_count"}


@dataclass
class Constraint:
    constraint_id: str
    source: str
    kind: str = "predicate"  # or geo
    status: str = "success"  # or failed
    column: str | None = None
    operator: str | None = None
    value: Any = None
    lat: float | None = None
    lon: float | None = None
    radius_km: float | None = None
    severity: str = "soft"
    relaxable: bool = True
    weight: float = 0.0
    requirement: dict | None = None
    raw_preview: str | None = None
    reason: str | None = None


@dataclass
class ConstraintSet:
    query: str
    entries: list[Constraint] = field(default_factory=list)
    failures: list[Constraint] = field(default_factory=list)

    def of_kind(self, kind: str) -> list[Constraint]:
        return [e for e in self.entries if e.kind == kind]

    def hard(self) -> list[Constraint]:
        return [e for e in self.entries if e.severity == "hard"]

    def selected(self, hard_only: bool = False) -> list[Constraint]:
        """Entries to render: those understood; with hard_only the hard ones and every place."""
        return [e for e in self.entries if e.status == "success" and (not hard_only or e.severity == "hard" or e.kind == "geo")]

    def to_dict(self) -> dict:
        return asdict(self)


def severity(source: str, column: str | None, requirement: Mapping[str, Any] | None = None) -> tuple[str, bool]:
    """(severity, relaxable): as the requirement says, else by its source and column."""
    own = (requirement or {}).get("severity")
    if own in SEVERITIES:
        return own, bool((requirement or {}).get("relaxable", own != "hard"))
    name = canonical(IDENTITY_VARIANTS.get(column or "", column or ""))
    match (source or "").lower():
        case "regulatory":
            return "hard", False
        case "building":
            return ("hard", False) if name in IDENTITY else ("soft", True)
        case "energy" | "location" | "proximity":
            return "soft", True
    return "human_review", True


def build(query: str, payloads: Sequence[Mapping[str, Any]], places: Sequence[Mapping[str, Any]] = (), weights: Mapping[str, float] | None = None) -> ConstraintSet:
    """Constraints of parsed requirement payloads and places. What couldn't be parsed is kept as a failure."""
    out, weights = ConstraintSet(query), weights or {}
    for p in payloads:
        source, parsed = (p.get("source_agent") or "unknown").lower(), p.get("parsed")
        if not isinstance(parsed, Mapping):
            out.failures.append(
                Constraint(f"{source}_fail_{len(out.failures) + 1:03d}", source, status="failed", severity="human_review", relaxable=False, raw_preview=(p.get("raw_text") or "")[:300], reason="not parsed")
            )
            continue
        wanted: list[Mapping[str, Any]] = []
        if source == "building" and parsed.get("typologies"):
            wanted.append({"target_column": "property_type", "operator": "IN", "value": list(parsed["typologies"])})
        wanted += [r for r in parsed.get("requirements") or parsed.get("requisiti") or () if isinstance(r, Mapping)]
        for i, r in enumerate(wanted, 1):
            how, relaxable = severity(source, r.get("target_column"), r)
            out.entries.append(
                Constraint(f"{source}_{i:03d}", source, "predicate", "success", r.get("target_column"), r.get("operator"), r.get("value"), severity=how, relaxable=relaxable, weight=float(weights.get(source, 0.0)), requirement=dict(r))
            )
    for i, place in enumerate(places, 1):
        if place.get("lat") is not None and place.get("lon") is not None:
            out.entries.append(Constraint(f"location_{i:03d}", "location", "geo", lat=place["lat"], lon=place["lon"], radius_km=place.get("radius_km"), severity="soft", weight=float(weights.get("location", 0.0))))
    return out


# Rendering


@dataclass
class Rendered:
    conditions: list[Column]
    clauses: list[str]
    ids: list[str]
    skipped: dict[str, str]

    @property
    def condition(self) -> Column | None:
        return reduce(lambda a, b: a & b, self.conditions) if self.conditions else None

    def sql(self, table: str = "ESTATES", limit: int | None = None) -> str | None:
        if not self.clauses:
            return None
        return f"SELECT * FROM {table} WHERE {' AND '.join(self.clauses)}" + (f" LIMIT {int(limit)}" if limit is not None else "")


def literal(v: Any) -> str:
    """A value as Spark SQL text."""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "''") + "'"


def render(c: ConstraintSet, columns: Iterable[str], hard_only: bool = False, aliases: Mapping[str, Iterable[str]] = ALIASES) -> Rendered:
    """Each selected constraint as a Column and as a clause of SQL; those without a column, operator or value are skipped, with the reason."""
    out, there = Rendered([], [], [], {}), list(columns)
    for e in c.selected(hard_only):
        got = _geo(e, there, aliases) if e.kind == "geo" else _predicate(e, there, aliases)
        if isinstance(got, str):
            out.skipped[e.constraint_id] = got
        else:
            out.conditions.append(got[0])
            out.clauses.append(got[1])
            out.ids.append(e.constraint_id)
    return out


def _geo(e: Constraint, there: list[str], aliases: Mapping[str, Iterable[str]]) -> tuple[Column, str] | str:
    lat, lon = resolve("latitude", there, aliases), resolve("longitude", there, aliases)
    if lat is None or lon is None:
        return "no coordinate columns"
    if e.lat is None or e.lon is None:
        return "no coordinates"
    r = e.radius_km if e.radius_km is not None else DEFAULT_RADIUS_KM
    return within_km(F.col(lat), F.col(lon), e.lat, e.lon, r), f"haversine_km(`{lat}`, `{lon}`, {e.lat!r}, {e.lon!r}) <= {r!r}"


def _predicate(e: Constraint, there: list[str], aliases: Mapping[str, Iterable[str]]) -> tuple[Column, str] | str:
    name = resolve(e.column, there, aliases)
    if name is None:
        return "column not in the schema"
    op, col, text = (e.operator or "").strip().upper(), F.col(name), f"`{name}`"
    match op:
        case "IN" | "NOT IN":
            values = [v for v in (e.value if isinstance(e.value, (list, tuple)) else [e.value]) if v is not None]
            if not values:
                return "no values"
            test = col.isin(*values)
            return (test if op == "IN" else ~test), f"{text} {op} ({', '.join(map(literal, values))})"
        case "BETWEEN":
            if not isinstance(e.value, (list, tuple)) or len(e.value) != 2 or None in e.value:
                return "BETWEEN needs two values"
            return col.between(*e.value), f"{text} BETWEEN {literal(e.value[0])} AND {literal(e.value[1])}"
        case "LIKE" | "ILIKE":
            if e.value is None:
                return "no value"
            return col.ilike(str(e.value)), f"{text} ILIKE {literal(str(e.value))}"
    if op not in COMPARISONS:
        return f"operator {e.operator!r} is not known"
    if e.value is None:
        return "no value"
    tests: dict[str, Callable[[], Column]] = {">=": lambda: col >= e.value, "<=": lambda: col <= e.value, ">": lambda: col > e.value, "<": lambda: col < e.value, "=": lambda: col == e.value, "!=": lambda: col != e.value}
    plain = {"==": "=", "<>": "!="}.get(op, op)
    return tests[plain](), f"{text} {plain} {literal(e.value)}"


def consolidate(entries: Sequence[Constraint]) -> list[Constraint]:
    """Of several lower (or upper) bounds on one column only the strictest, in place of the first; hard if any was."""
    kept: dict[tuple, Constraint] = {}
    for i, e in enumerate(entries):
        side = {">": "low", ">=": "low", "<": "high", "<=": "high"}.get(e.operator or "")
        if e.kind != "predicate" or side is None or not isinstance(e.value, (int, float)):
            kept[(i,)] = e
            continue
        key, strict = (canonical(e.column or ""), side), e.operator in (">", "<")
        old = kept.get(key)
        sign = 1 if side == "low" else -1
        if old is None or (sign * e.value, strict) > (sign * old.value, old.operator in (">", "<")):
            hard = old is not None and old.severity == "hard"
            kept[key] = Constraint(**{**asdict(e), "severity": "hard" if hard else e.severity, "relaxable": e.relaxable and not hard})
        elif e.severity == "hard":
            old.severity, old.relaxable = "hard", False
    return list(kept.values())


# Reading SQL, by Spark's own parser


def parse(spark: SparkSession, sql: str) -> Any | None:
    """The unresolved plan of a query, or None where it doesn't parse."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except (PySparkException, Py4JJavaError):
        return None


def _each(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node: Any) -> str:
    return node.getClass().getSimpleName()


def _plans(plan: Any) -> list[Any]:
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += _each(p.children())
    return out


def _attributes(expression: Any) -> list[str]:
    out, todo = [], [expression]
    while todo:
        e = todo.pop()
        if _kind(e) == "UnresolvedAttribute":
            out.append(e.nameParts().last())
        todo += _each(e.children())
    return out


def conjuncts(spark: SparkSession, sql: str) -> list[Any]:
    """The AND-ed conditions of the WHERE clause, in order, as expressions of the parsed plan."""
    plan = parse(spark, sql)
    out: list[Any] = []
    for p in _plans(plan) if plan is not None else ():
        if _kind(p) == "Filter":
            todo = [p.condition()]
            while todo:
                e = todo.pop(0)
                todo = [e.left(), e.right(), *todo] if _kind(e) == "And" else todo
                out += [] if _kind(e) == "And" else [e]
    return out


def condition_tree(spark: SparkSession, sql: str, hide: tuple[str, ...] = ("latitude", "longitude", "haversine_km")) -> list[dict]:
    """The conditions of a WHERE clause as the parser groups them: entries (operator, content) or (operator, children), the
    first of a group without an operator. A range is one condition; conditions on places are hidden, and so are groups
    that hold nothing else."""

    def geo(e: Any) -> bool:
        return any(canonical(c) in hide for c in _attributes(e)) or any(h in e.sql().lower() for h in hide)

    def parts(e: Any, kind: str) -> list[Any]:
        return parts(e.left(), kind) + parts(e.right(), kind) if _kind(e) == kind and not is_range(e) else [e]

    def is_range(e: Any) -> bool:
        return _kind(e) == "And" and _kind(e.left()) == "GreaterThanOrEqual" and _kind(e.right()) == "LessThanOrEqual" and e.left().left().sql() == e.right().left().sql()

    def text(e: Any) -> str:
        if is_range(e):
            given = [e.left().left(), e.left().right(), e.right().right()]
        elif re.match(r"between\(", e.sql(), re.IGNORECASE) and e.children().size() == 3:
            given = [e.children().apply(i) for i in range(3)]
        else:
            return e.sql()
        return "{} BETWEEN {} AND {}".format(*(x.sql() for x in given))

    def group_of(e: Any) -> list[dict]:
        kind = _kind(e) if _kind(e) in ("And", "Or") and not is_range(e) else None
        out: list[dict] = []
        for x in parts(e, kind) if kind else [e]:
            if _kind(x) in ("And", "Or") and not is_range(x):
                if children := group_of(x):
                    out.append({"operator": kind.upper() if out else None, "children": children})
            elif not geo(x):
                out.append({"operator": kind.upper() if out and kind else None, "content": text(x)})
        return out

    plan = parse(spark, sql)
    if plan is None:
        return []
    return [row for p in _plans(plan) if _kind(p) == "Filter" for row in group_of(p.condition())]


def conjunct_rows(spark: SparkSession, sql: str) -> list[dict]:
    """(text, columns, kind) of each conjunct: geo where a distance or coordinate is tested."""
    rows = []
    for e in conjuncts(spark, sql):
        columns = sorted(set(_attributes(e)))
        geo = "haversine_km" in e.sql() or any(canonical(c) in ("latitude", "longitude") for c in columns)
        rows.append({"text": e.sql(), "columns": columns, "kind": "geo" if geo else "predicate"})
    return rows


def where_columns(spark: SparkSession, sql: str) -> list[str]:
    return sorted({c for e in conjuncts(spark, sql) for c in _attributes(e)})


def referenced_columns(spark: SparkSession, sql: str) -> list[str]:
    plan = parse(spark, sql)
    return sorted({c for p in _plans(plan) for e in _each(p.expressions()) for c in _attributes(e)}) if plan is not None else []


def repair_columns(spark: SparkSession, sql: str, columns: Iterable[str], aliases: Mapping[str, Iterable[str]] = ALIASES) -> tuple[str, dict[str, str], list[str]]:
    """(sql, renamed, unresolved): references that the table lacks but that resolve are renamed. Literals stay as they are."""
    there = list(columns)
    missing = [c for c in referenced_columns(spark, sql) if c not in there]
    renamed = {c: r for c in missing if (r := resolve(c, there, aliases))}
    if renamed:
        names = "|".join(re.escape(c) for c in sorted(renamed, key=len, reverse=True))
        # Quoted text is matched first and put back as it is, so that a name inside a literal is never touched.
        pattern = re.compile(rf"'(?:[^'\\]|\\.|'')*'|`?(?<![\w`])({names})(?!\w)`?")
        sql = pattern.sub(lambda m: f"`{renamed[m[1]]}`" if m[1] else m[0], sql)
    return sql, renamed, sorted(c for c in missing if c not in renamed)


def formatted(requirements: Sequence[Mapping[str, Any]], none: str = "No specific requirements identified.") -> str:
    """Requirements as `column operator value`, parted by semicolons: texts in quotes, lists in brackets unless of one value.
    Those without a column, an operator or a value are left out; keys may be English or Italian."""
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    out = []
    for r in requirements:
        column, op, value = (next((r[k] for k in keys if k in r), None) for keys in (("target_column", "colonna_target"), ("operator", "operatore"), ("value", "valore")))
        if column and op and value is not None:
            several = isinstance(value, list) and len(value) != 1
            text = "(" + ", ".join(map(quoted, value)) + ")" if several else quoted(value[0] if isinstance(value, list) else value)
            out.append(f"{column} {op} {text}")
    return "; ".join(out) or none


# The sections of a planner's answer and the fields of its filters, in English and Italian.
PLAN_SECTIONS = {"location": "localizzazione", "regulatory": "normativa", "energy": "energia", "building": "tipologia", "proximity": "servizi"}
PLAN_FILTERS = ("parameters", "filters", "requirements", "parametri")


def planned(answer: Mapping[str, Any]) -> tuple[str, dict[str, float], list[dict], list[dict]]:
    """(query, weights, payloads, places) of a planner's single answer: weights of 0.2 where it gives none, a payload for each
    section that it found, with what its filters say or a safe stand-in, and a place from coordinates."""
    both = lambda obj, name: obj.get(name, obj.get(PLAN_SECTIONS[name]))
    query = (answer.get("sql") or {}).get("query") or ""
    given = (answer.get("layer2") or {}).get("weights") or {}
    weights = {d: 0.2 if both(given, d) is None else float(both(given, d)) for d in PLAN_SECTIONS}
    found, payloads, places = (answer.get("layer1") or {}).get("analysis") or {}, [], []
    for name in ("building", "energy", "proximity", "regulatory", "location"):
        section = both(found, name)
        if not isinstance(section, Mapping) or not section.get("found"):
            continue
        asked = next((section[k] for k in PLAN_FILTERS if section.get(k)), {})
        asked = asked if isinstance(asked, Mapping) else {}
        parsed: dict[str, Any] = {"found": True}
        if name == "building":
            kinds = asked.get("tipologia_bene_immobile") or ["Apartment"]
            parsed |= {"typologies": [kinds] if isinstance(kinds, str) else list(kinds), "requirements": [{"column": "superficie_di_riferimento_mq"}]}
        elif name == "energy":
            parsed["requirements"] = [{"column": "classe_energetica_ape"}]
        elif name == "proximity":
            parsed["requirements"] = [{"amenity": a} for a in asked.get("amenity_proximity") or ["healthcare"]]
        elif name == "regulatory":
            parsed["requirements"] = [{"notes": asked.get("use_destination") or "Regulatory analysis"}]
        else:
            at = asked.get("coordinate") if isinstance(asked.get("coordinate"), Mapping) else {}
            lat, lon = asked.get("latitude") or asked.get("latitudine") or at.get("lat"), asked.get("longitude") or asked.get("longitudine") or at.get("lon")
            if lat and lon:
                places.append({"name": "planned place", "lat": lat, "lon": lon, "radius_km": asked.get("radius_km", asked.get("raggio_km", DEFAULT_RADIUS_KM))})
            continue
        payloads.append({"source_agent": name, "parsed": parsed})
    return query, weights, payloads, places


@dataclass
class Report:
    parsed: bool = True
    invalid_columns: list[str] = field(default_factory=list)
    invalid_values: list[tuple[str, Any]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    hard_kept: bool = True
    typology_kept: bool = True
    location_kept: bool = True

    @property
    def grounded(self) -> bool:
        return self.parsed and not self.invalid_columns and not self.invalid_values

    @property
    def valid(self) -> bool:
        return self.parsed and not self.invalid_columns and self.hard_kept and self.typology_kept and self.location_kept


def validate(spark: SparkSession, sql: str, c: ConstraintSet, columns: Iterable[str], values: Mapping[str, Iterable[str]] | None = None, aliases: Mapping[str, Iterable[str]] = ALIASES) -> Report:
    """Whether a query names real columns and values, and keeps each hard constraint, the typology and the places, adding nothing."""
    out, there = Report(parsed=parse(spark, sql) is not None), set(columns)
    known = lambda col: bool(there.intersection((col, *group(col, aliases))))
    canon = lambda col: canonical(col, aliases)
    allowed = {canon(k): {str(x) for x in v} for k, v in (values or {}).items()}
    predicates = [e for e in c.of_kind("predicate") if e.column]
    if there:
        out.invalid_columns = [x for x in referenced_columns(spark, sql) if not known(x)]
        out.warnings = [f"{e.source}: {e.column} is not in the schema" for e in predicates if not known(e.column)]
    for e in predicates:
        if canon(e.column) in allowed:
            given = e.value if isinstance(e.value, (list, tuple)) else [e.value]
            out.invalid_values += [(e.column, v) for v in given if v is not None and str(v) not in allowed[canon(e.column)]]
    tested = {canon(x) for x in where_columns(spark, sql)}
    geo = {"latitude", "longitude"}
    out.missing = [f"{e.source}:{e.column} {e.operator} {e.value}" for e in predicates if e.severity == "hard" and canon(e.column) not in tested]
    out.hard_kept = not out.missing
    out.typology_kept = "property_type" in tested or not any(canon(e.column) == "property_type" for e in predicates)
    out.location_kept = not c.of_kind("geo") or bool(geo & tested) or (out.parsed and "haversine_km" in sql.lower())
    out.extra = sorted(tested - {canon(e.column) for e in predicates} - geo)
    return out
