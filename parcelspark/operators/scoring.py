"""The five scorers, ranking weights, weighted total with its formula, and the older multi-factor rank."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions import exprs as X
from parcelspark.operators.spatial import Place, nearest_place
from parcelspark.schema import DIMENSIONS, ENERGY_CLASSES, canonical, resolve

# Names that stand for a dimension.
SYNONYMS = {
    "poi": "proximity", "pois": "proximity", "services": "proximity", "ape": "energy", "epc": "energy", "energetic": "energy", "property_technical": "building",
    "technical": "building", "property": "building", "normative": "regulatory", "regulation": "regulatory", "geo": "location", "geographic": "location",
}


@dataclass(frozen=True)
class Need:
    """A requirement: column, operator, value; exclusive makes an inequality strict."""

    column: str
    operator: str = ">="
    value: Any = None
    exclusive: bool = False


@dataclass(frozen=True)
class Range:
    """A column's least and largest value over the whole, unfiltered table."""

    low: float
    high: float


def ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, Range]:
    """Ranges of columns by one aggregate row."""
    there = [c for c in columns if c in df.columns]
    if not there:
        return {}
    r = df.agg(*[f(X.number(F.col(c))).alias(f"{n}_{i}") for i, c in enumerate(there) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return {c: Range(r[f"lo_{i}"], r[f"hi_{i}"]) for i, c in enumerate(there) if r[f"lo_{i}"] is not None}


def mean(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) / len(parts)


def scaled(value: Column, r: Range | None, empty: float) -> Column:
    """value from 0 to 1 within its range; `empty` where it is constant or has none."""
    if r is None or r.high <= r.low:
        return F.lit(float(empty))
    return (value - r.low) / (r.high - r.low)


def location_score(df: DataFrame, places: Sequence[Place]) -> DataFrame:
    """df with the nearest place's columns and location_score (K3): 100 at it, 20 at its radius, 0 beyond. A later place of
    the same name sets the radius."""
    out = nearest_place(df, places)
    radius = {p.name: round(p.radius_km, 2) if p.radius_km > 0 else 3.0 for p in places}
    rho = reduce(lambda acc, kv: F.when(F.col("nearest_place") == kv[0], F.lit(kv[1])).otherwise(acc), radius.items(), F.lit(None).cast("double"))
    d, scale = F.col("distance_km"), rho / F.lit((-math.log(0.2)) ** (1 / 3))
    raw = F.when(d.isNull() | (d > rho), 0.0).otherwise(100 * F.exp(-F.pow(d / scale, 3)))
    return out.withColumn("location_score", F.bround(raw, 1))


def class_targets(operator: str, value: Any) -> list[str]:
    """Energy classes that meet a requirement, best first. Greater means better."""
    order = list(ENERGY_CLASSES)
    if isinstance(value, (list, tuple)):
        wanted = {str(v).strip().upper() for v in value}
        return [c for c in order if c in wanted]
    v = str(value).strip().upper()
    if v not in order:
        return []
    i = order.index(v)
    return order[: i + 1] if operator in (">=", ">") else order[i:] if operator in ("<=", "<") else [v]


def need_score(df: DataFrame, need: Need, stats: Mapping[str, Range]) -> Column | None:
    """0 to 100 for one requirement; None if its column isn't there."""
    name = resolve(need.column, df.columns)
    if name is None or need.value is None:
        return None
    col = F.col(name)
    if canonical(need.column) == "energy_class":
        return X.discrete_score(col, class_targets(need.operator, need.value))
    if isinstance(need.value, (list, tuple)):
        return X.discrete_score(col, [str(v) for v in need.value])
    target = _float(need.value)
    if target is None:
        return X.discrete_score(col, [str(need.value)])
    if need.operator in (">=", ">", "<=", "<"):
        return X.continuous_score(col, target, need.operator, need.exclusive)
    r, v = stats.get(name), X.number(col)
    if r is None or r.high <= r.low:
        return F.when(v == target, 100.0).otherwise(0.0)
    return F.coalesce(X.clip(100 - F.abs(v - target) / (r.high - r.low) * 100, 0.0, 100.0), F.lit(0.0))


def _float(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def energy_score(df: DataFrame, needs: Sequence[Need] = (), stats: Mapping[str, Range] | None = None) -> DataFrame:
    """energy_score (K4): the mean over requirements; without any, the total points within their range."""
    stats = stats or {}
    parts = [s for n in needs if (s := need_score(df, n, stats)) is not None]
    if parts:
        return df.withColumn("energy_score", F.bround(mean(parts), 1))
    total = resolve("energy_score_total", df.columns)
    if needs or total is None:
        return df.withColumn("energy_score", F.lit(0.0))
    value = F.coalesce(scaled(X.number(F.col(total)), stats.get(total), 1.0) * 100, F.lit(0.0))
    return df.withColumn("energy_score", F.bround(value, 1))


def building_score(df: DataFrame, typologies: Sequence[str] = (), needs: Sequence[Need] = (), stats: Mapping[str, Range] | None = None) -> DataFrame:
    """building_score (K5): the mean of a typology part and a technical part; 100 if nothing was asked, 0 if nothing asked is usable."""
    stats, parts = stats or {}, []
    kind = resolve("property_type", df.columns)
    if typologies and kind:
        parts.append(X.discrete_score(F.col(kind), typologies))
    technical = []
    for n in needs:
        name = resolve(n.column, df.columns)
        if name is None:
            continue
        target = 1.0 if n.value is None else _float(n.value)
        if target is None:
            technical.append(F.when(F.col(name).cast("string") == str(n.value), 100.0).otherwise(0.0))
        elif n.operator in (">=", ">", "<=", "<"):
            technical.append(X.continuous_score(F.col(name), target, n.operator, n.exclusive))
        else:
            r = stats.get(name)
            span = max(1.0, r.high - r.low) if r else 1.0
            technical.append(F.coalesce(X.clip(100 - F.abs(X.number(F.col(name)) - target) / span * 100, 0.0, 100.0), F.lit(0.0)))
    if technical:
        parts.append(mean(technical))
    if not parts:
        return df.withColumn("building_score", F.lit(0.0 if typologies or needs else 100.0))
    return df.withColumn("building_score", X.clip(F.bround(mean(parts), 1), 0.0, 100.0))


def harmonic(n: int) -> list[float]:
    total = sum(1 / (i + 1) for i in range(n))
    return [1 / (i + 1) / total for i in range(n)]


def proximity_score(df: DataFrame, needs: Sequence[Need], stats: Mapping[str, Range] | None = None) -> DataFrame:
    """proximity_score (K6): requirements weigh 1, 1/2, 1/3, ...; each gives its column within range, or K1 if it has a value.
    For a repeated column the first requirement holds."""
    stats, first = stats or {}, {}
    valid = [(n, name) for n in needs if (name := resolve(n.column, df.columns))]
    for n, name in valid:
        first.setdefault(name, n)
    parts = []
    for (_, name), w in zip(valid, harmonic(len(valid)), strict=True):
        n = first[name]
        target = _float(n.value)
        value = X.continuous_score(F.col(name), target, n.operator, n.exclusive) / 100 if target is not None else scaled(X.number(F.col(name)), stats.get(name), 1.0 if name in stats else 0.0)
        parts.append(100 * w * F.coalesce(value, F.lit(0.0)))
    return df.withColumn("proximity_score", F.bround(reduce(lambda a, b: a + b, parts), 1) if parts else F.lit(0.0))


REGULATED = ("energy_class", "property_type", "surface_area", "construction_period", "omi_zone", "energy_score_total", "cadastral_units_count")


def regulatory_score(df: DataFrame, needs: Sequence[Need], allowed: Iterable[str] = REGULATED) -> DataFrame:
    """regulatory_score (K7): the mean over requirements on allowed columns: thresholds by K1, texts and lists by K2, else equality."""
    parts = []
    for n in needs:
        name = resolve(n.column, df.columns)
        if name is None or canonical(n.column) not in set(allowed) or n.value is None:
            continue
        col, target = F.col(name), _float(n.value) if not isinstance(n.value, (list, tuple)) else None
        if target is not None and n.operator in (">=", ">", "<=", "<"):
            parts.append(X.continuous_score(col, target, n.operator, n.exclusive))
        elif target is not None:
            parts.append(F.when(X.number(col) == target, 100.0).otherwise(0.0))
        else:
            values = list(map(str, n.value)) if isinstance(n.value, (list, tuple)) else [v.strip(" %") for v in str(n.value).split(",")]
            parts.append(X.discrete_score(col, values))
    return df.withColumn("regulatory_score", F.bround(mean(parts), 1) if parts else F.lit(0.0))


# Weights


def settle(weights: Mapping[str, float]) -> dict[str, float]:
    """Weights to 2 decimals that sum to exactly 1: what rounding leaves goes to the largest."""
    out = {k: round(v, 2) for k, v in weights.items()}
    left = round(1 - sum(out.values()), 2)
    if left and out:
        top = max(out, key=lambda k: out[k])
        out[top] = round(out[top] + left, 2)
    return out


def even() -> dict[str, float]:
    return dict.fromkeys(DIMENSIONS, 1 / len(DIMENSIONS))


def weights_of_ranks(ranks: Sequence[tuple[str, int]]) -> dict[str, float]:
    """Weights by 1 / rank, of the dimensions named (also by synonyms); even if none is."""
    raw: dict[str, float] = {}
    for name, rank in ranks:
        key = SYNONYMS.get(name.strip().lower(), name.strip().lower())
        if key in DIMENSIONS:
            raw[key] = 1 / max(1, rank)
    if not raw:
        return even()
    total = sum(raw.values())
    got = settle({k: v / total for k, v in raw.items()})
    return {d: got.get(d, 0.0) for d in DIMENSIONS}


def redistribute(weights: Mapping[str, float], active: Iterable[str]) -> dict[str, float]:
    """Weights of dimensions without requirements go to the others in proportion; even if none is left."""
    live = {d: weights.get(d, 0.0) for d in DIMENSIONS if d in set(active) and weights.get(d, 0.0) > 0}
    if not live:
        return even()
    total = sum(live.values())
    got = settle({k: v / total for k, v in live.items()})
    return {d: got.get(d, 0.0) for d in DIMENSIONS}


def total_score(df: DataFrame, weights: Mapping[str, float], explain: bool = False) -> DataFrame:
    """ranking_score: the weighted sum of the scores, unrounded (K15); with explain the weights and a formula of each row."""
    used = [(d, w) for d in DIMENSIONS if (w := weights.get(d, 0.0)) and f"{d}_score" in df.columns]
    parts = [F.lit(w) * F.coalesce(F.col(f"{d}_score"), F.lit(0.0)) for d, w in used]
    out = df.withColumn("ranking_score", reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0))
    if explain:
        terms = [F.format_string(f"{d}: %.1f x {w:.2f}", F.coalesce(F.col(f"{d}_score"), F.lit(0.0)).cast("double")) for d, w in used]
        out = out.withColumns({f"weight_{d}": F.lit(w) for d, w in used}).withColumn("ranking_formula", F.concat_ws(" + ", *terms) if terms else F.lit(""))
    return out


# Explanations


@dataclass(frozen=True)
class Part:
    """A partial score in an explanation: the column it is of, the score, its weight, and the range it is scaled by."""

    column: str
    score: Column
    weight: float
    range: Range | None = None
    whole_table: bool = True  # whether the range is of the whole table


def part_text(df: DataFrame, p: Part) -> Column:
    """How a partial score came about: by its place within a range, whichever end it counts from, else by its value."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("N/D"))
    value, score = F.col(p.column), F.bround(p.score, 1).cast("string")
    plain = F.concat(F.lit(f"{p.column}("), shown(value), F.lit("): "), score)
    if p.range is None:
        text = plain if df.schema[p.column].dataType.typeName() != "string" else F.concat(plain, F.lit(" (Match)"))
    else:
        low, high = p.range.low, p.range.high
        where = " [Global Ref]" if p.whole_table else " [Local Range]"
        v = X.number(value, 0.0)
        if high <= low:
            text = F.concat(F.lit(f"{p.column}("), shown(value), F.lit(f"): 100{where}"))
        else:
            up, down = 100 * (v - low) / (high - low), 100 * (high - v) / (high - low)
            rise = F.concat(F.lit(f"{p.column}: 100*("), v.cast("string"), F.lit(f"-{low})/({high}-{low})="), score, F.lit(where))
            fall = F.concat(F.lit(f"{p.column}: 100*({high}-"), v.cast("string"), F.lit(f")/({high}-{low})="), score, F.lit(where))
            other = F.concat(F.lit(f"{p.column}("), v.cast("string"), F.lit(f") [Min {low}, Max {high}]: "), score, F.lit(where))
            text = F.when(F.abs(F.bround(up, 1) - p.score) < 1, rise).when(F.abs(F.bround(down, 1) - p.score) < 1, fall).otherwise(other)
    return F.concat(text, F.lit(f" * Weight({p.weight:.3f})"))


def summed(lines: Sequence[Column], name: str = "Sum") -> Column:
    """Parts of an explanation as lines: one by itself, several within a sum."""
    if len(lines) == 1:
        return F.array(lines[0])
    inner = [F.concat(F.lit("  "), x, F.lit("," if i < len(lines) - 1 else "")) for i, x in enumerate(lines)]
    return F.array(F.lit(f"{name}("), *inner, F.lit(")"))


def need_parts(df: DataFrame, needs: Sequence[Need], stats: Mapping[str, Range] | None = None, harmonic_weights: bool = False) -> list[Part]:
    """The partial scores of requirements, as the energy and regulatory scorers weigh them (alike), or the proximity scorer."""
    stats = stats or {}
    usable = [(resolve(n.column, df.columns), s, n) for n in needs if (s := need_score(df, n, stats)) is not None]
    weights = harmonic(len(usable)) if harmonic_weights else [1 / len(usable)] * len(usable) if usable else []
    return [Part(name, score, w, stats.get(name)) for (name, score, _), w in zip(usable, weights, strict=True)]


def explained(df: DataFrame, dimension: str, parts: Sequence[Part]) -> DataFrame:
    """df with <dimension>_formula: the lines that say how its score came about."""
    lines = [part_text(df, p) for p in parts]
    return df.withColumn(f"{dimension}_formula", summed(lines) if lines else F.array(F.lit("Score(N/D)")))


def explained_location(df: DataFrame, places: Sequence[Place]) -> DataFrame:
    """df (scored by location_score) with location_formula: the decay with its length, or why the score is 0."""
    scale = F.lit(None).cast("double")
    for p in places:
        radius = round(p.radius_km, 2) if p.radius_km > 0 else 3.0
        scale = F.when(F.col("nearest_place") == p.name, radius / (-math.log(0.2)) ** (1 / 3)).otherwise(scale)
    km = F.format_string("%.2f", F.col("distance_km"))
    text = F.when(F.col("distance_km").isNull(), F.lit("no place -> 0")).when(F.col("location_score") > 0, F.concat(F.lit("100 * exp(-("), km, F.lit("/"), F.format_string("%.2f", scale), F.lit(")^3)"))).otherwise(F.concat(F.lit("too far ("), km, F.lit("km) -> 0")))
    return df.withColumn("location_formula", F.array(text))


def explained_building(df: DataFrame, typologies: Sequence[str], column: str = "property_type") -> DataFrame:
    """df with building_formula: the place of the typology in the list of preferences, the first that fits, or no match."""
    v, place = F.lower(F.trim(column)), F.lit(None).cast("int")
    clean = [t.strip().strip("'\"").lower() for t in typologies]
    for i, p in reversed(list(enumerate(clean, 1))):
        place = F.when(F.contains(v, F.lit(p)) | F.contains(F.lit(p), v), i).otherwise(place)
    for i, p in reversed(list(enumerate(clean, 1))):
        place = F.when(v == p, i).otherwise(place)
    return df.withColumn("building_formula", F.array(F.when(place.isNull() | (v == ""), "0 (No match)").otherwise(F.concat(F.lit("100 / Position("), place.cast("string"), F.lit(")")))))


def explained_total(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """df with ranking_steps: each dimension's score and weight within the sum, missing scores as 0."""
    score = lambda d: F.bround(F.coalesce(F.col(f"{d}_score"), F.lit(0.0)).cast("double"), 1).cast("string") if f"{d}_score" in df.columns else F.lit("0.0")
    lines = [F.concat(F.lit(f"{d}_score("), score(d), F.lit(f") * Weight({weights.get(d, 0.0)})")) for d in DIMENSIONS]
    return df.withColumn("ranking_steps", summed(lines, "RankingSum"))


def ranked(df: DataFrame) -> DataFrame:
    """Best first: score, then nearness, then id."""
    near = [F.col("distance_km").asc_nulls_last()] if "distance_km" in df.columns else []
    return df.orderBy(F.desc("ranking_score"), *near, "id")


def multi_factor(df: DataFrame, weights: Mapping[str, float], radius_km: float | None = None, granular: DataFrame | None = None, amenity_weights: Mapping[str, float] | None = None) -> DataFrame:
    """The older rank (K16): components out of 100, weights of present columns normalised, amenities and distance as parts.

    granular: (id, amenity, score) rows; only those of candidate ids count, averaged by amenity weight and scaled over them.
    """
    out, parts = df, {}
    for c in ("energy_score", "building_score", "regulatory_score"):
        if c in df.columns and weights.get(c, 0) > 0:
            parts[c] = X.clip(X.number(F.col(c), 0.0) / 100, 0.0, 1.0)
    if granular is not None and amenity_weights:
        w = F.element_at(F.create_map(*[F.lit(x) for kv in amenity_weights.items() for x in kv]), F.col("amenity"))
        mine = granular.withColumn("__w", w).where("__w is not null").join(df.select("id"), "id", "left_semi")
        poi = mine.groupBy("id").agg((F.sum(F.col("score") * F.col("__w")) / F.sum("__w")).alias("__poi"))
        span = poi.agg(F.min("__poi").alias("__lo"), F.max("__poi").alias("__hi"))
        out = out.join(poi, "id", "left").join(F.broadcast(span))  # one row
        scaled_poi = F.when(F.col("__hi") > F.col("__lo"), (F.col("__poi") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(1.0))
        parts["poi"] = F.coalesce(scaled_poi, F.lit(0.0))
    if radius_km and "distance_km" in df.columns:
        parts["distance"] = F.coalesce(X.clip(1 - F.col("distance_km") / min(0.6 * radius_km, 10.0), 0.0, 1.0), F.lit(0.0))
    total = sum(weights.get(k, 0.0) for k in parts)
    score = reduce(lambda a, b: a + b, [p * (weights.get(k, 0.0) / total) for k, p in parts.items()]) if total > 0 else F.lit(0.0)
    return out.withColumn("multi_factor_score", score).drop("__poi", "__lo", "__hi")
