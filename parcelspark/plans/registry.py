"""Named queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import exprs as X
from parcelspark.operators import filters, finalise, metrics, rollup, scoring, spatial, stats
from parcelspark.plans import constraints, engine
from parcelspark.plans.catalog import ORACLE_SQL, QUERIES, query
from parcelspark.plans.tables import ESTATES_SQL, FEEDBACK_SQL, NEAR, POIS_SQL, distance_sql, estates, feedback, pois, table
from parcelspark.sources import certificates, readers
from parcelspark.streaming import events as stream

E = "WITH " + ESTATES_SQL
EP = f"WITH {ESTATES_SQL}, {POIS_SQL}"
CENTRE = (45.03, 7.65)
DIST = distance_sql("latitude", "longitude", "45.03", "7.65")
ALL = "id, property_type, energy_class, surface_area, latitude, longitude"
SHOWN = ALL.split(", ")


def k1(v: str, t: float, op: str, exclusive: bool = False) -> str:
    """continuous_score as SQL, for positive thresholds."""
    strict = exclusive or op in (">", "<")
    if op in (">=", ">"):
        return f"round_even(CASE WHEN {v} {'<=' if strict else '<'} {t} THEN 0 ELSE greatest(0, least(100, {v} / {t} * 50)) END, 1)"
    return f"round_even(CASE WHEN {v} {'>=' if strict else '>'} {t} THEN 0 ELSE greatest(0, least(100, 150 - {v} / {t} * 100)) END, 1)"


def k2(v: str, prefs: list[str]) -> str:
    scored = scoring.X.preference_scores(prefs)
    exact = " ".join(f"WHEN lower(trim({v})) = '{p}' THEN {s}" for p, s in scored)
    part = " ".join(f"WHEN contains(lower(trim({v})), '{p}') OR contains('{p}', lower(trim({v}))) THEN {s}" for p, s in scored)
    return f"CAST(CASE WHEN {v} IS NULL OR trim({v}) = '' THEN 0 {exact} {part} ELSE 0 END AS DOUBLE)"


# Scans, predicates, geography


@query("estates_scan", f"{E} SELECT {ALL} FROM estates")
def _(spark, sf):
    return estates(spark, sf).select(*SHOWN)


@query("estates_point_lookup", f"{E} SELECT {ALL} FROM estates WHERE id = '42'")
def _(spark, sf):
    return filters.by_id(estates(spark, sf), "42").select(*SHOWN)


@query("estates_paging", f"{E} SELECT {ALL}, (SELECT count(*) FROM estates) > 60 AS has_more FROM estates ORDER BY id LIMIT 20 OFFSET 40")
def _(spark, sf):
    return filters.page(estates(spark, sf), 40, 20).select(*SHOWN, "has_more")


def _constraints() -> constraints.ConstraintSet:
    payloads = [
        {"source_agent": "building", "parsed": {"typologies": ["ECONOMY", "PROMO"], "requirements": [{"target_column": "superficie_di_riferimento_mq", "operator": "BETWEEN", "value": [100, 400]}]}},
        {"source_agent": "energy", "parsed": {"requirements": [{"target_column": "classe", "operator": "IN", "value": ["A1", "B", "C", "D"]}]}},
        {"source_agent": "proximity", "parsed": {"requirements": [{"target_column": "mobilita", "operator": ">=", "value": 20}]}},
    ]
    return constraints.build("offices", payloads)


@query("sql_predicates", f"{E} SELECT {ALL} FROM estates WHERE property_type IN ('ECONOMY', 'PROMO') AND surface_area BETWEEN 100 AND 400 AND energy_class IN ('A1', 'B', 'C', 'D') AND mobility >= 20")
def _(spark, sf):
    df = estates(spark, sf)
    return df.where(constraints.render(_constraints(), df.columns).condition).select(*SHOWN)


@query("sql_text_rendered", ORACLE_SQL["sql_predicates"])
def _(spark, sf):
    df = estates(spark, sf)
    rows, error = engine.run_sql(spark, constraints.render(_constraints(), df.columns).sql(), df)
    if error:
        raise ValueError(error)
    return rows.select(*SHOWN)


@query("sql_ilike", f"{E} SELECT {ALL} FROM estates WHERE property_type ILIKE '%econ%' AND address ILIKE 'brand#1%'")
def _(spark, sf):
    return estates(spark, sf).where(F.col("property_type").ilike("%econ%") & F.col("address").ilike("brand#1%")).select(*SHOWN)


@query("geo_radius", f"{E} SELECT id, round({DIST}, 4) AS distance_km FROM estates WHERE {DIST} <= 2.5")
def _(spark, sf):
    df = estates(spark, sf).where(X.within_km(F.col("latitude"), F.col("longitude"), *CENTRE, 2.5))
    return df.select("id", F.round(X.haversine_km(F.col("latitude"), F.col("longitude"), *CENTRE), 4).alias("distance_km"))


@query("geo_sorted_topk", f"{E} SELECT {ALL} FROM estates WHERE surface_area >= 100 ORDER BY {DIST}, id LIMIT 25")
def _(spark, sf):
    df = estates(spark, sf).where("surface_area >= 100")
    d = X.haversine_km(F.col("latitude"), F.col("longitude"), *CENTRE)
    return df.withColumn("__d", d).orderBy("__d", "id").limit(25).select(*SHOWN)


@query("sql_order_by_distance", f"{E} SELECT {ALL} FROM estates WHERE surface_area >= 150 AND {DIST} <= 3 ORDER BY {DIST}")
def _(spark, sf):
    sql = 'SELECT * FROM "ESTATES" WHERE surface_area >= 150 AND haversine_km(latitude, longitude, 45.03, 7.65) <= 3 ORDER BY haversine_km(latitude, longitude, 45.03, 7.65) ASC'
    rows, error = engine.run_sql(spark, sql, estates(spark, sf))
    if error:
        raise ValueError(error)
    return rows.select(*SHOWN)


# Filter API and projections


@query("filter_api_full", f"{E} SELECT {ALL} FROM estates WHERE surface_area BETWEEN 50 AND 450 AND (energy_class LIKE 'A%' OR energy_class LIKE 'B%') AND lower(property_type) IN ('economy', 'small') AND construction_period IN ('1946-1976', '1977-2005')")
def _(spark, sf):
    f = filters.Filters(min_surface=50, max_surface=450, energy_classes=("a", "B"), property_types=("Economy", "SMALL"), construction_periods=("1946-1976", "1977-2005"))
    return filters.apply_filters(estates(spark, sf), f).select(*SHOWN)


@query("filter_class_prefix", f"{E} SELECT {ALL} FROM estates WHERE energy_class LIKE 'A%'")
def _(spark, sf):
    return filters.apply_filters(estates(spark, sf), filters.parse_lists({"energy_classes": "a"})).select(*SHOWN)


@query("filter_meta_nulls", f"{E} SELECT id, is_meta_estate FROM estates WHERE is_meta_estate IS NULL OR NOT is_meta_estate")
def _(spark, sf):
    return filters.apply_filters(estates(spark, sf), filters.Filters(is_meta_building=False)).select("id", "is_meta_estate")


@query(
    "markers_lite",
    f"{E} SELECT id, latitude AS lat, longitude AS lng, property_type, surface_area, energy_class, coalesce(is_meta_estate, false) AS is_meta, CAST(1 AS INT) AS tier FROM (SELECT * FROM estates WHERE surface_area >= 100 ORDER BY id LIMIT 300)",
)
def _(spark, sf):
    return filters.markers_lite(estates(spark, sf), 300, filters.Filters(min_surface=100))


@query(
    "building_struct",
    f"{E} SELECT id, latitude AS lat, longitude AS lng, CASE WHEN house_number IS NULL THEN address ELSE address || ', ' || house_number END AS address, CASE WHEN comune_code = 'L219' THEN 'Torino' ELSE comune_code END AS city, CAST(energy_score_total AS DOUBLE) AS total, mobility FROM estates",
)
def _(spark, sf):
    b = filters.building_struct(estates(spark, sf))
    return b.select("id", "coordinates.lat", "coordinates.lng", "address", "city", "energy_scores.total", "proximity_scores.mobility")


@query("evaluation_rows", f"{E} SELECT id, CAST(round_even(mobility / 3, 0) AS INT) AS mobility_score, coalesce(house_number, 'N/D') AS house_number FROM estates")
def _(spark, sf):
    return filters.evaluation_rows(estates(spark, sf).withColumn("mobility_score", F.col("mobility") / 3), ["mobility_score"], ["house_number", "absent"])


@query("search_text", f"{E} SELECT {ALL} FROM estates WHERE contains(lower(address), '#2') OR contains(lower(id), '99')")
def _(spark, sf):
    df = estates(spark, sf)
    return df.where(filters.any_of([F.contains(F.lower("address"), F.lit("#2")), F.contains("id", F.lit("99"))])).select(*SHOWN)


@query("history_filter", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-12-31' - INTERVAL 90 DAYS ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def _(spark, sf):
    rows = filters.since_days(table(spark, sf, "orders"), "o_orderdate", 90, F.lit("1998-12-31").cast("timestamp_ntz"))
    return rows.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select("o_orderkey", "o_orderdate")


# Joins


@query("enrich_left_join", f"{E} SELECT r.id, r.n, e.property_type, e.energy_class FROM (SELECT CAST(l_partkey AS VARCHAR) AS id, count(*) AS n FROM lineitem GROUP BY 1) r LEFT JOIN estates e ON r.id = e.id")
def _(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("id")).agg(F.count("*").alias("n"))
    return finalise.enrich(r, estates(spark, sf).select("id", "property_type", "energy_class"))


RESULT_SQL = f"result AS (SELECT id, CAST(mobility AS DOUBLE) AS ranking_score, round({DIST}, 2) AS distance_km FROM estates WHERE energy_class LIKE 'A%')"


def _result(df: DataFrame) -> DataFrame:
    d = F.round(X.haversine_km(F.col("latitude"), F.col("longitude"), *CENTRE), 2)
    return df.where(F.col("energy_class").startswith("A")).select("id", F.col("mobility").alias("ranking_score"), d.alias("distance_km"))


@query("overlay_join", f"{E}, {RESULT_SQL} SELECT e.id, r.id IS NOT NULL AS is_match, coalesce(r.ranking_score, 0) AS ranking_score, r.distance_km FROM estates e LEFT JOIN result r ON e.id = r.id")
def _(spark, sf):
    df = estates(spark, sf)
    return finalise.overlay(df, _result(df)).select("id", "is_match", "ranking_score", "distance_km")


@query(
    "eval_coalesce_join",
    f"{E}, {RESULT_SQL}, ev AS (SELECT id, green AS score FROM estates WHERE CAST(id AS BIGINT) % 3 = 0) SELECT r.id, coalesce(ev.score, r.ranking_score) AS score, ev.id IS NOT NULL AS is_evaluated, ev.id IS NOT NULL AND ev.score >= 60 AS is_selected FROM result r LEFT JOIN ev ON r.id = ev.id",
)
def _(spark, sf):
    df = estates(spark, sf)
    ev = df.where(F.col("id").cast("long") % 3 == 0).select("id", F.col("green").alias("score"))
    return finalise.evaluated(_result(df), ev).select("id", "score", "is_evaluated", "is_selected")


@query(
    "finalise_order",
    f"{E}, {RESULT_SQL} SELECT id, is_match, score FROM (SELECT e.id, r.id IS NOT NULL AS is_match, coalesce(r.ranking_score, 0) AS score, r.distance_km AS d FROM estates e LEFT JOIN result r ON e.id = r.id) ORDER BY is_match DESC, score DESC, d NULLS LAST, id LIMIT 500",
)
def _(spark, sf):
    df = estates(spark, sf)
    rows = finalise.overlay(df, _result(df)).withColumn("score", F.col("ranking_score"))
    return finalise.final_order(rows, 500).select("id", "is_match", "score")


@query("tier_union", f"{E}, {RESULT_SQL} SELECT e.id, CAST(CASE WHEN t.id IS NOT NULL THEN 3 WHEN r.id IS NOT NULL THEN 2 ELSE 1 END AS INT) AS tier, coalesce(r.ranking_score, 0) AS score FROM estates e LEFT JOIN result r ON e.id = r.id LEFT JOIN (SELECT id FROM result ORDER BY ranking_score DESC, id LIMIT 25) t ON e.id = t.id")
def _(spark, sf):
    df = estates(spark, sf)
    return finalise.tiers(df, _result(df).select("id", F.col("ranking_score").alias("score")))


@query("run_semi_join", f"{E} SELECT {ALL} FROM estates WHERE id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem)")
def _(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("string")).alias("ids"))
    return finalise.result_filter(estates(spark, sf), runs).select(*SHOWN)


@query("missing_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def _(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "sub_properties_explode",
    f"{E}, m AS (SELECT CAST(cadastral_parcel AS VARCHAR) AS pid, CAST(id AS VARCHAR) AS sid, row_number() OVER (PARTITION BY cadastral_parcel ORDER BY id) AS rn FROM estates) SELECT pid AS id, count(*) AS n, min(e.surface_area) AS least, string_agg(e.id, ',' ORDER BY rn) AS ids FROM m JOIN estates e ON m.sid = e.id WHERE rn <= 20 GROUP BY pid",
)
def _(spark, sf):
    df = estates(spark, sf)
    metas = df.groupBy(F.col("cadastral_parcel").cast("string").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("id_list"))
    subs = finalise.sub_properties(metas, df, ["surface_area"])
    return subs.select("id", F.size("subs").cast("long").alias("n"), F.array_min("subs.surface_area").alias("least"), F.array_join("subs.id", ",").alias("ids"))


@query("combine_first", f"{E} SELECT id, coalesce(house_number, 'p' || id) AS house_number FROM estates")
def _(spark, sf):
    df = estates(spark, sf).select("id", "house_number")
    return finalise.combine_first(df, df.select("id", F.concat(F.lit("p"), "id").alias("house_number")))


PAIR = distance_sql("e.latitude", "e.longitude", "p.lat", "p.lon")


@query("poi_within_radius", f"{EP} SELECT e.id, p.poi_id, round({PAIR}, 4) AS distance_km FROM estates e, pois p WHERE {PAIR} <= 1.2")
def _(spark, sf):
    near = spatial.radius_join_by_place(estates(spark, sf).select("id", "latitude", "longitude"), pois(spark, sf).select("poi_id", "lat", "lon"), 1.2, 4)
    return near.select("id", "poi_id", "distance_km")


@query("nearest_poi", f"{EP}, d AS (SELECT e.id, p.poi_id, {PAIR} AS km FROM estates e, pois p) SELECT id, poi_id, round(km, 4) AS distance_km FROM d WHERE km <= 5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, poi_id) = 1")
def _(spark, sf):
    return spatial.nearest_row(estates(spark, sf), pois(spark, sf), 5.0).withColumn("distance_km", F.round("distance_km", 4))


FAR_LAT, FAR_LON = "CAST({k} * 37 % 2000 AS DOUBLE) / 1000 * {sign} + {base}", "CASE WHEN {k} % 2 = 0 THEN 179.95 + CAST({k} * 91 % 50 AS DOUBLE) / 1000 ELSE -179.95 - CAST({k} * 91 % 50 AS DOUBLE) / 1000 END"
FAR_A = [f"CAST(p_partkey AS BIGINT) AS id, {FAR_LAT.format(k='p_partkey', sign=s, base=b)} AS latitude, {FAR_LON.format(k='p_partkey')} AS longitude" for s, b in ((1, 66), (1, 87.9), (-1, -78))]
FAR_B = [f"CAST(s_suppkey AS BIGINT) AS poi_id, {FAR_LAT.format(k='s_suppkey', sign=s, base=b)} AS lat, {FAR_LON.format(k='s_suppkey')} AS lon" for s, b in ((1, 66), (1, 87.9), (-1, -78))]


@query(
    "radius_high_latitude",
    f"WITH a AS ({' UNION ALL '.join(f'SELECT {c} FROM part' for c in FAR_A)}), b AS ({' UNION ALL '.join(f'SELECT {c} FROM supplier' for c in FAR_B)}) SELECT id, poi_id, round(latitude, 3) AS latitude, round({distance_sql('a.latitude', 'a.longitude', 'b.lat', 'b.lon')}, 4) AS distance_km FROM a, b WHERE {distance_sql('a.latitude', 'a.longitude', 'b.lat', 'b.lon')} <= 2.5",
)
def _(spark, sf):
    """Near poles and across the date line."""
    of = lambda name, cols: functools.reduce(lambda x, y: x.unionByName(y), [table(spark, sf, name).selectExpr(f"inline(array(struct({c})))") for c in cols])
    estates_there = of("part", FAR_A).withColumn("shown", F.round("latitude", 3))
    near = spatial.radius_join_by_place(estates_there, of("supplier", FAR_B), 2.5, 4)
    return near.select("id", "poi_id", F.col("shown").alias("latitude"), "distance_km")


PLACES = (spatial.Place("north", 45.08, 7.66, 2.0), spatial.Place("south", 45.02, 7.62, 1.5))
D1, D2 = distance_sql("latitude", "longitude", "45.08", "7.66"), distance_sql("latitude", "longitude", "45.02", "7.62")


@query("nearest_place", f"{E} SELECT id, CASE WHEN {D1} <= {D2} THEN 'north' ELSE 'south' END AS nearest_place, round_even(least({D1}, {D2}), 2) AS distance_km, round_even(least({D1}, {D2}) * 12, 0) AS walk_min FROM estates")
def _(spark, sf):
    return spatial.nearest_place(estates(spark, sf), PLACES).select("id", "nearest_place", "distance_km", "walk_min")


SCALE = "CASE amenity WHEN 'stop' THEN 0.34 WHEN 'shop' THEN 0.34 WHEN 'park' THEN 0.68 ELSE 1.36 END * CAST(1.5 AS DOUBLE)"


@query(
    "amenity_decay",
    f"{EP}, d AS (SELECT e.id, p.category, {PAIR} AS km, {SCALE} AS s FROM estates e, pois p), n AS (SELECT category, count(DISTINCT amenity) AS n FROM pois GROUP BY 1), t AS (SELECT id, category, sum(exp(-pow(km / s, 3))) AS t FROM d WHERE km <= 5 GROUP BY 1, 2) SELECT e.id, n.category, round(coalesce(t.t, 0) / n.n, 4) AS raw FROM estates e CROSS JOIN n LEFT JOIN t ON t.id = e.id AND t.category = n.category",
)
def _(spark, sf):
    kind = F.when(F.col("amenity").isin("stop", "shop"), "neighbourhood").when(F.col("amenity") == "park", "district").otherwise("city")
    return spatial.amenity_scores(estates(spark, sf), pois(spark, sf), kind).withColumn("raw", F.round("raw", 4))


@query(
    "percentile_ties",
    f"{E} SELECT id, round_even((rank() OVER (PARTITION BY property_type ORDER BY mobility) + (count(*) OVER (PARTITION BY property_type, mobility) - 1) / 2.0) / count(*) OVER (PARTITION BY property_type) * 100, 2) AS percentile FROM estates",
)
def _(spark, sf):
    return stats.percentile_rank(estates(spark, sf).select("id", "property_type", "mobility"), ["property_type"], "mobility").select("id", "percentile")


@query(
    "point_in_zone",
    f"{E}, z AS (SELECT n_nationkey AS zi, n_name AS zone, CAST(45 AS DOUBLE) + CAST(n_nationkey AS DOUBLE) * 0.004 AS la, CAST(7.6 AS DOUBLE) + CAST((n_nationkey * 7) % 25 AS DOUBLE) * 0.004 AS lo FROM nation) SELECT e.id, (SELECT arg_min(zone, zi) FROM z WHERE e.latitude > la + 0.00001 AND e.latitude < la + 0.01999 AND e.longitude > lo + 0.00001 AND e.longitude < lo + 0.01999) AS zone FROM estates e",
)
def _(spark, sf):
    la = F.lit(45.0) + F.col("n_nationkey").cast("double") * 0.004
    lo = F.lit(7.6) + ((F.col("n_nationkey") * 7) % 25).cast("double") * 0.004
    corner = lambda dx, dy: F.struct((lo + dx).alias("lon"), (la + dy).alias("lat"))
    a, b = 0.00001, 0.01999
    zones = table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_index"), F.col("n_name").alias("zone"), F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b)).alias("ring"))
    return spatial.zone_of(estates(spark, sf), zones).select("id", "zone")


@query(
    "phrase_contains_join",
    "SELECT d.doc_id AS id, b.item_id AS phrase_id FROM documents d, (SELECT item_id, lower(text) AS p FROM benchmark) b WHERE contains(lower(d.text), b.p)",
)
def _(spark, sf):
    p = table(spark, sf, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return metrics.phrases_in(table(spark, sf, "documents"), p, key="doc_id")


@query(
    "address_match_score",
    "WITH g AS (SELECT 'via ' || lower(replace(p_name, ' ', ' di ')) AS street, CAST(p_partkey % 30 AS VARCHAR) AS hn, 'city' || CAST(p_partkey % 4 AS VARCHAR) AS gc FROM part), a AS (SELECT c_custkey AS id, 'via ' || ['small di ring', 'red di widget', 'ring', 'nothing'][c_custkey % 4 + 1] AS s, CAST(c_custkey % 30 AS VARCHAR) AS n, 'city' || CAST(c_custkey % 4 AS VARCHAR) AS c FROM customer), "
    "t AS (SELECT a.*, 0 AS t, s AS find FROM a UNION ALL SELECT a.*, 1, regexp_replace(s, '^\\S+\\s+', '') FROM a), j AS (SELECT id, t, (CASE WHEN c = gc THEN 100 ELSE 0 END) + (CASE WHEN s = street THEN 150 WHEN contains(street, s) OR contains(s, street) THEN 50 ELSE 0 END) + (CASE WHEN n = hn THEN 300 WHEN starts_with(hn, n) AND NOT regexp_matches(substr(hn, length(n) + 1, 1), '[0-9]') THEN 150 ELSE -100 END) AS score FROM t JOIN g ON contains(street, find) AND contains(gc, c)) "
    "SELECT id, CAST(arg_min(score, t * 10000 - score) AS INT) AS score FROM j GROUP BY id",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    street = F.concat(F.lit("via "), F.lower(F.replace("p_name", F.lit(" "), F.lit(" di "))))
    g = p.select(street.alias("street"), (F.col("p_partkey") % 30).cast("string").alias("house_number"), F.concat(F.lit("city"), (F.col("p_partkey") % 4).cast("string")).alias("city"), F.lit(45.0).alias("lat"), F.lit(7.6).alias("lon"))
    k = F.col("c_custkey")
    name = F.get(F.array(*[F.lit(x) for x in ("small di ring", "red di widget", "ring", "nothing")]), (k % 4).cast("int"))
    a = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("V.IA "), name).alias("street"), (k % 30).cast("string").alias("number"), F.concat(F.lit("City"), (k % 4).cast("string")).alias("city"))
    return readers.address_matches(a, g).select("id", F.col("score").cast("int").alias("score"))


# Statistics


@query(
    "column_stats_numeric",
    f"{E} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 2) AS \"min\", round(max({c}), 2) AS \"max\", round(avg({c}), 2) AS mean, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS median, round(quantile_cont({c}, 0.75), 2) AS p75 FROM estates"
        for c in ("surface_area", "mobility", "green")
    ),
)
def _(spark, sf):
    return stats.numeric_stats(estates(spark, sf), ["surface_area", "mobility", "green"])


@query(
    "column_stats_categorical",
    f"{E}, c AS (SELECT address AS value, count(*) AS n FROM estates GROUP BY 1 UNION ALL SELECT 'Brand#none', 0), s AS (SELECT value, n, (SELECT count(*) FROM c) AS \"distinct\" FROM c ORDER BY n DESC, value LIMIT 50) SELECT * FROM s UNION ALL SELECT 'other', CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM s) AS BIGINT), (SELECT count(*) FROM c) WHERE (SELECT sum(n) FROM c) > (SELECT sum(n) FROM s)",
)
def _(spark, sf):
    return stats.category_stats(estates(spark, sf), "address", ["Brand#none"])


@query("runtime_metadata", f"{E} SELECT 'energy_class' AS \"column\", array_to_string(list_sort(list(DISTINCT energy_class)), ',') AS \"values\", CAST(NULL AS DOUBLE) AS \"min\", CAST(NULL AS DOUBLE) AS \"max\" FROM estates UNION ALL SELECT 'surface_area', NULL, min(surface_area), max(surface_area) FROM estates")
def _(spark, sf):
    got = stats.runtime_metadata(estates(spark, sf), ["surface_area"], ["energy_class"])
    return got.select("column", F.array_join("values", ",").alias("values"), "min", "max")


# Roll-ups and energy


@query("dedup_latest", "SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem WHERE l_returnflag IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_extendedprice) = 1")
def _(spark, sf):
    rows = table(spark, sf, "lineitem")
    order = F.struct((-F.unix_micros(F.col("l_shipdate").cast("timestamp"))).alias("t"), "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")
    return rows.groupBy("l_orderkey").agg(F.min(order).alias("m")).select("l_orderkey", "m.l_linenumber", "m.l_partkey", "m.l_shipdate")


@query(
    "latest_unit",
    f"{E}, u AS (SELECT *, CAST(id AS BIGINT) % 13 AS d, first_value(house_number IGNORE NULLS) OVER (PARTITION BY cadastral_sheet ORDER BY CAST(id AS BIGINT) % 13 DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fa FROM estates) SELECT id, cadastral_sheet FROM u WHERE fa IS NULL OR house_number = fa QUALIFY row_number() OVER (PARTITION BY cadastral_sheet ORDER BY d DESC, id) = 1",
)
def _(spark, sf):
    df = estates(spark, sf).withColumn("d", F.col("id").cast("long") % 13)
    return rollup.latest_unit(df, ("cadastral_sheet",), "house_number", "d").select("id", "cadastral_sheet")


ROLL = (
    f"{E}, b AS (SELECT * FROM estates), g AS (SELECT cadastral_sheet, cadastral_parcel, CAST(count(*) AS INT) AS cadastral_units_count, sum(surface_area) AS surface_area, max(energy_score_plant) AS pp, max(energy_score_envelope) AS pe, max(energy_score_renewables) AS pr FROM b GROUP BY 1, 2 HAVING count(*) > 1), "
    "t AS (SELECT cadastral_sheet, cadastral_parcel, property_type AS ty, row_number() OVER (PARTITION BY cadastral_sheet, cadastral_parcel ORDER BY sum(surface_area) DESC, property_type) AS rn FROM b GROUP BY 1, 2, 3), "
    "c AS (SELECT cadastral_sheet, cadastral_parcel, energy_class AS ec, row_number() OVER (PARTITION BY cadastral_sheet, cadastral_parcel ORDER BY sum(surface_area) DESC, energy_class) AS rn FROM b GROUP BY 1, 2, 3), "
    "m AS (SELECT cadastral_sheet, cadastral_parcel, construction_period AS cp, row_number() OVER (PARTITION BY cadastral_sheet, cadastral_parcel ORDER BY count(*) DESC, construction_period) AS rn FROM b GROUP BY 1, 2, 3) "
    "SELECT 'M' || lpad(CAST(row_number() OVER (ORDER BY g.cadastral_sheet, g.cadastral_parcel) AS VARCHAR), 5, '0') AS id, g.cadastral_sheet, g.cadastral_parcel, cadastral_units_count, g.surface_area, ty AS property_type, ec AS energy_class, cp AS construction_period, "
    "CAST(pp + pe + pr + CASE WHEN ec LIKE 'A%' THEN 5 WHEN ec IN ('B', 'C', 'D', 'E') THEN 3 ELSE 1 END AS INT) AS energy_score_total FROM g JOIN t USING (cadastral_sheet, cadastral_parcel) JOIN c USING (cadastral_sheet, cadastral_parcel) JOIN m USING (cadastral_sheet, cadastral_parcel) WHERE t.rn = 1 AND c.rn = 1 AND m.rn = 1"
)


@query("rollup_entities", ROLL)
def _(spark, sf):
    r = rollup.rollup_entities(estates(spark, sf))
    return r.select("id", "cadastral_sheet", "cadastral_parcel", "cadastral_units_count", "surface_area", "property_type", "energy_class", "construction_period", F.col("energy_score_total").cast("int").alias("energy_score_total"))


@query("union_rollups", f"WITH r AS ({ROLL}) SELECT id, surface_area FROM r UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_size AS DOUBLE) * 10 FROM part")
def _(spark, sf):
    df = estates(spark, sf)
    return rollup.with_rollups(df, rollup.rollup_entities(df)).select("id", "surface_area")


USE = "u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS usage, l_extendedprice AS kwh, l_quantity * 10 AS surface FROM lineitem)"


def _use(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("usage"), F.col("l_extendedprice").alias("kwh"), (F.col("l_quantity") * 10).alias("surface"))


@query(
    "energy_distribution",
    f"WITH {USE}, x AS (SELECT usage, kwh / surface AS x FROM u WHERE kwh / surface > 0 AND kwh / surface < 1000) SELECT usage, round(avg(x), 3) AS mean, round(stddev_samp(x), 3) AS std, count(*) AS n FROM x GROUP BY 1 HAVING count(*) >= 10 UNION ALL SELECT NULL, round(avg(x), 3), round(stddev_samp(x), 3), count(*) FROM x",
)
def _(spark, sf):
    d = rollup.energy_distribution(_use(spark, sf), "usage", "kwh", "surface")
    return d.select("usage", F.round("mean", 3).alias("mean"), F.round("std", 3).alias("std"), "n")


CDF_T = "(1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)))"
CDF_ERF = f"(1 - ((((1.061405429 * {CDF_T} - 1.453152027) * {CDF_T} + 1.421413741) * {CDF_T} - 0.284496736) * {CDF_T} + 0.254829592) * {CDF_T} * exp(-z * z / 2))"


@query(
    "energy_percentile",
    f"WITH {USE}, x AS (SELECT *, kwh / surface AS x FROM u), s AS (SELECT usage, avg(x) AS m, stddev_samp(x) AS sd FROM x WHERE x > 0 AND x < 1000 GROUP BY 1), zz AS (SELECT l_orderkey, l_linenumber, l_partkey, kwh, CAST((x - m) / sd AS DOUBLE) AS z FROM x JOIN s USING (usage)) SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(least(100, greatest(0, 100 * (1 - CASE WHEN z >= 0 THEN (1 + {CDF_ERF}) / 2 ELSE (1 - {CDF_ERF}) / 2 END)))) AS INT) AS energy_percentile, kwh * 0.25 AS energy_cost FROM zz",
)
def _(spark, sf):
    got = rollup.energy_percentile(_use(spark, sf), "usage", "kwh", "surface")
    return got.select("l_orderkey", "l_linenumber", "l_partkey", F.col("energy_percentile").cast("int").alias("energy_percentile"), "energy_cost")


def cycle(values: list[str | None], div: int = 1) -> str:
    """One of some texts by the id, as SQL that both dialects read."""
    at = f"CAST(floor(CAST(id AS BIGINT) / {div}.0) AS BIGINT) % {len(values)}"
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


EPC_PLANTS = ["Heat pump air", "DISTRICT HEATING", "Condensing boiler", "solid biomass", "Standard boiler", "geotermico", None]
EPC_ENVELOPES = ["Good", "very good", "neutral", "Poor", None]
EPC_RENEWABLES = ["Yes", "Sì", "Si", "true", "yes", "No", "no", "False", None]
EXPERT_CLASSES = ["A4", "A", " a1 ", "A+", "B", "C", "d", "E", "F", None]
EXPERT_PLANTS = ["Pompa di calore", "impianto geotermico", "teleriscaldamento", "caldaia a condensazione", "stufa a pellet", "legna", "cippato", "Heat pump", "caldaia", None]
EXPERT_WINTERS = ["Smiling face", "faccina sorridente", "Basita", "NEUTRAL", "amazed", "alta", "good", None]
EXPERT_RENEWABLES = ["Sì", "si", "Yes", "no", "", "nessuna", "solare", None]


def _said(spark: SparkSession, sf: str, columns: dict[str, str]) -> DataFrame:
    """Estates with descriptions by turns, the same in Spark and in SQL."""
    return estates(spark, sf).withColumns({k: F.expr(v) for k, v in columns.items()})


SAID_A = {"plant": cycle(EPC_PLANTS), "envelope": cycle(EPC_ENVELOPES, 7), "renewables": cycle(EPC_RENEWABLES, 35), "said_class": cycle(EXPERT_CLASSES, 3)}
SAID_B = {"said_class": cycle(EXPERT_CLASSES), "plant": cycle(EXPERT_PLANTS, 3), "winter": cycle(EXPERT_WINTERS, 7), "renewables": cycle(EXPERT_RENEWABLES, 2)}


@query(
    "epc_points_a",
    f"{E}, s AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in SAID_A.items())} FROM estates), p AS (SELECT id, CASE WHEN contains(lower(plant), 'heat pump') OR contains(lower(plant), 'district heating') THEN 5 WHEN contains(lower(plant), 'condensing') OR contains(lower(plant), 'biomass') THEN 3 ELSE 1 END AS plant, "
    "CASE WHEN contains(lower(envelope), 'good') THEN 5 WHEN contains(lower(envelope), 'neutral') THEN 3 ELSE 1 END AS envelope, CASE WHEN renewables IN ('Yes', 'Sì', 'Si', 'true') THEN 5 ELSE 1 END AS renewables, CASE WHEN upper(trim(said_class)) LIKE 'A%' THEN 5 WHEN upper(trim(said_class)) IN ('B', 'C', 'D', 'E') THEN 3 ELSE 1 END AS class FROM s) "
    "SELECT id, CAST(plant AS INT) AS energy_score_plant, CAST(envelope AS INT) AS energy_score_envelope, CAST(renewables AS INT) AS energy_score_renewables, CAST(plant + envelope + renewables + class AS INT) AS energy_score_total FROM p",
)
def _(spark, sf):
    return rollup.energy_points(_said(spark, sf, SAID_A), "plant", "envelope", "renewables", "said_class").select("id", "energy_score_plant", "energy_score_envelope", "energy_score_renewables", "energy_score_total")


@query(
    "epc_points_b",
    f"{E}, s AS (SELECT id, {', '.join(f'{v} AS {k}' for k, v in SAID_B.items())} FROM estates), p AS (SELECT id, CASE WHEN upper(trim(said_class)) IN ('A', 'A1', 'A2', 'A3', 'A4') THEN 5 WHEN upper(trim(said_class)) = 'B' THEN 4 WHEN upper(trim(said_class)) IN ('C', 'D') THEN 3 WHEN upper(trim(said_class)) = 'E' THEN 2 ELSE 1 END "
    "+ CASE WHEN regexp_matches(lower(plant), 'pompa di calore|teleriscaldamento|geotermico') THEN 5 WHEN regexp_matches(lower(plant), 'condensazione|biomassa|cippato|legna|pellet') THEN 4 ELSE 2 END + CASE WHEN regexp_matches(lower(winter), 'smiling|sorridente') THEN 5 WHEN regexp_matches(lower(winter), 'basita|neutr|amazed') THEN 3 ELSE 1 END "
    "+ CASE WHEN contains(lower(renewables), 'si') OR contains(lower(renewables), 'sì') OR contains(lower(renewables), 'yes') THEN 5 ELSE 2 END AS t FROM s) SELECT id, CAST(t AS INT) AS points, CAST(CASE WHEN t >= 18 THEN 5 WHEN t >= 15 THEN 4 WHEN t >= 12 THEN 3 WHEN t >= 9 THEN 2 ELSE 1 END AS INT) AS grade FROM p",
)
def _(spark, sf):
    points, grade = rollup.expert_points(*[F.col(c) for c in ("said_class", "plant", "winter", "renewables")])
    return _said(spark, sf, SAID_B).select("id", points.alias("points"), grade.alias("grade"))


# Scoring

for _name, _op, _t, _x in (("ge", ">=", 170.0, False), ("gt", ">", 170.0, False), ("le", "<=", 230.0, False), ("lt", "<", 230.0, False), ("ge_exclusive", ">=", 170.0, True)):

    def _score(spark: SparkSession, sf: str, op: str = _op, t: float = _t, x: bool = _x) -> DataFrame:
        return estates(spark, sf).select("id", X.continuous_score(F.col("surface_area"), t, op, x).alias("score"))

    query(f"score_continuous_{_name}", f"{E} SELECT id, {k1('surface_area', _t, _op, _x)} AS score FROM estates")(_score)

PREFS = ["Promo", "small", "Econ", "LARGE building"]


@query("score_discrete", f"{E} SELECT id, {k2('property_type', PREFS)} AS score FROM estates")
def _(spark, sf):
    return estates(spark, sf).select("id", X.discrete_score(F.col("property_type"), PREFS).alias("score"))


DMIN = f"round_even(least({D1}, {D2}), 2)"
RHO = f"(CASE WHEN {D1} <= {D2} THEN 2.0 ELSE 1.5 END)"
LOC = f"CASE WHEN {DMIN} > {RHO} THEN 0 ELSE round_even(100 * exp(-pow({DMIN} / ({RHO} / pow(-ln(0.2), CAST(1 AS DOUBLE) / 3)), 3)), 1) END"
CLS = k2("energy_class", ["A4", "A3", "A2", "A1", "B", "C"])
EN = f"round_even(({CLS} + {k1('mobility', 37.0, '>=')}) / 2, 1)"
BUILD = f"round_even(({k2('property_type', ['ECONOMY', 'SMALL'])} + {k1('surface_area', 170.0, '>=')}) / 2, 1)"
W1, W2, W3 = (w for w in scoring.harmonic(3))
PROX = f"round_even(100 * CAST({W1!r} AS DOUBLE) * {k1('mobility', 37.0, '>=')} / 100 + 100 * CAST({W2!r} AS DOUBLE) * green / 100 + 100 * CAST({W3!r} AS DOUBLE) * {k1('sport', 61.0, '<=')} / 100, 1)"
REG = f"round_even(({k2('energy_class', ['A1', 'B'])} + {k1('surface_area', 170.0, '>')}) / 2, 1)"
Need = scoring.Need
STATS = {"green": scoring.Range(0.0, 100.0)}


@query("score_location", f"{E} SELECT id, CAST({LOC} AS DOUBLE) AS location_score FROM estates")
def _(spark, sf):
    return scoring.location_score(estates(spark, sf), PLACES).select("id", "location_score")


@query("score_energy", f"{E} SELECT id, {EN} AS energy_score FROM estates")
def _(spark, sf):
    needs = [Need("classe", ">=", "C"), Need("mobilita", ">=", 37)]
    return scoring.energy_score(estates(spark, sf), needs).select("id", "energy_score")


@query("score_building", f"{E} SELECT id, {BUILD} AS building_score FROM estates")
def _(spark, sf):
    return scoring.building_score(estates(spark, sf), ["ECONOMY", "SMALL"], [Need("surface", ">=", 170)]).select("id", "building_score")


PROX_NEEDS = [Need("mobility", ">=", 37), Need("green"), Need("sport", "<=", 61)]


@query("score_proximity", f"{E} SELECT id, round({PROX}, 1) AS proximity_score FROM estates")
def _(spark, sf):
    return scoring.proximity_score(estates(spark, sf), PROX_NEEDS, STATS).select("id", F.round("proximity_score", 1).alias("proximity_score"))


@query("score_regulatory", f"{E} SELECT id, {REG} AS regulatory_score FROM estates")
def _(spark, sf):
    needs = [Need("energy_class", "IN", ["A1", "B"]), Need("surface_area", ">", 170), Need("sport", ">", 5)]
    return scoring.regulatory_score(estates(spark, sf), needs).select("id", "regulatory_score")


WEIGHTS = scoring.weights_of_ranks([("building", 1), ("geo", 2), ("energy", 3)])


def _all_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = scoring.location_score(estates(spark, sf), PLACES)
    df = scoring.energy_score(df, [Need("classe", ">=", "C"), Need("mobilita", ">=", 37)])
    return scoring.building_score(df, ["ECONOMY", "SMALL"], [Need("surface", ">=", 170)])


TOTAL = f"{WEIGHTS['location']!r} * {LOC} + {WEIGHTS['energy']!r} * {EN} + {WEIGHTS['building']!r} * {BUILD}"


@query("rank_total", f"{E} SELECT id, round({TOTAL}, 3) AS ranking_score FROM estates WHERE surface_area >= 100 ORDER BY round({TOTAL}, 6) DESC, {DMIN}, id LIMIT 50")
def _(spark, sf):
    df = _all_scores(spark, sf).where("surface_area >= 100")
    total = scoring.total_score(df, WEIGHTS).withColumn("ranking_score", F.round("ranking_score", 6))
    return scoring.ranked(total).limit(50).select("id", F.round("ranking_score", 3).alias("ranking_score"))


@query(
    "rank_explained",
    f"{E} SELECT id, 'location: ' || printf('%.1f', CAST({LOC} AS DOUBLE)) || ' x {WEIGHTS['location']:.2f} + energy: ' || printf('%.1f', {EN}) || ' x {WEIGHTS['energy']:.2f} + building: ' || printf('%.1f', {BUILD}) || ' x {WEIGHTS['building']:.2f}' AS ranking_formula FROM estates",
)
def _(spark, sf):
    return scoring.total_score(_all_scores(spark, sf), WEIGHTS, explain=True).select("id", "ranking_formula")


@query(
    "legacy_rank",
    f"{E}, g AS (SELECT CAST(l_partkey AS VARCHAR) AS id, l_returnflag AS amenity, l_discount * 100 AS score FROM lineitem), p AS (SELECT id, sum(score * w) / sum(w) AS poi FROM (SELECT *, CASE amenity WHEN 'A' THEN 2.0 WHEN 'N' THEN 1.0 END AS w FROM g) WHERE w IS NOT NULL AND id IN (SELECT id FROM estates) GROUP BY 1), s AS (SELECT min(poi) AS lo, max(poi) AS hi FROM p) "
    f"SELECT e.id, round({BUILD} / 100 * 0.75 + coalesce((poi - lo) / (hi - lo), 0) * 0.25, 4) AS multi_factor_score FROM estates e LEFT JOIN p ON e.id = p.id, s",
)
def _(spark, sf):
    df = scoring.building_score(estates(spark, sf), ["ECONOMY", "SMALL"], [Need("surface", ">=", 170)])
    g = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.col("l_returnflag").alias("amenity"), (F.col("l_discount") * 100).alias("score"))
    got = scoring.multi_factor(df, {"building_score": 0.6, "poi": 0.2}, granular=g, amenity_weights={"A": 2.0, "N": 1.0})
    return got.select("id", F.round("multi_factor_score", 4).alias("multi_factor_score"))


@query("fallback_topk", f"{E} SELECT id, energy_score_total FROM estates ORDER BY energy_score_total DESC NULLS LAST, id LIMIT 500")
def _(spark, sf):
    return engine.fallback(estates(spark, sf)).select("id", "energy_score_total")


@query("fallback_nearest", f"{E} SELECT id FROM estates ORDER BY sqrt(pow(latitude - 45.03, 2) + pow(longitude - 7.65, 2)), id LIMIT 500")
def _(spark, sf):
    return engine.fallback(estates(spark, sf), "distance", *CENTRE).select("id")


@query(
    "relaxation_mask_counts",
    f"{E} SELECT CAST((CASE WHEN property_type = 'ECONOMY' THEN 1 ELSE 0 END) + (CASE WHEN surface_area >= 480 THEN 2 ELSE 0 END) + (CASE WHEN mobility >= 95 THEN 4 ELSE 0 END) + (CASE WHEN surface_area >= 300 THEN 8 ELSE 0 END) AS INT) AS mask, count(*) AS n FROM estates GROUP BY 1",
)
def _(spark, sf):
    tests = [F.col("property_type") == "ECONOMY", F.col("surface_area") >= 480, F.col("mobility") >= 95, F.col("surface_area") >= 300]
    mask = F.aggregate("met", F.lit(0), lambda a, i: a + F.pow(F.lit(2), i).cast("int"))
    return engine.condition_counts(estates(spark, sf), tests).select(mask.alias("mask"), "n")


Conditions = tuple[tuple[str, str, tuple[int, int, int, int]], ...]
# Conditions of three weaker levels each beside a hard one: column, operator, thresholds from asked to high. The first eight
# find too little at any level, so that most are dropped; the second find enough at some level, which one depends on the size.
RELAXED_FAR: Conditions = (
    ("mobility", ">=", (60, 55, 40, 20)), ("green", ">=", (70, 60, 40, 10)), ("sport", ">=", (80, 70, 50, 20)), ("education", ">=", (75, 65, 45, 15)),
    ("healthcare", "<=", (20, 30, 50, 80)), ("commercial", ">=", (85, 75, 55, 25)), ("surface_area", ">=", (300, 250, 200, 100)),
)
RELAXED_NEAR: Conditions = (("mobility", ">=", (99, 97, 90, 60)), ("surface_area", ">=", (480, 470, 440, 300)))


def relaxed_sql(asked: Conditions, enough: int) -> str:
    """The greedy search in SQL: every trial's rows are counted after the state before it, as a chain of one-row tables."""

    def test(i: int, level: str) -> str:
        column, op, limits = asked[i]
        return f"{column} {op} CASE {level} " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(limits)) + " END"

    n = len(asked)
    ok = lambda levels: " AND ".join(["(property_type = 'ECONOMY')", *[f"({levels[i]} = 4 OR {test(i, levels[i])})" for i in range(n)]])
    steps = [f"s0 AS MATERIALIZED (SELECT {', '.join(f'0 AS c{i}' for i in range(n))}, count(*) AS n0, count(*) AS n FROM estates WHERE {ok(['0'] * n)})"]
    k = 0
    for level in (1, 2, 3, 4):
        for i in range(n - 1, -1, -1):
            to = [str(level) if j == i else f"s{k}.c{j}" for j in range(n)]
            trial = f"(SELECT count(*) FROM estates WHERE {ok(to)})"
            steps.append(f"t{k} AS MATERIALIZED (SELECT s{k}.*, {trial} AS t FROM s{k})")
            take = f"n < {enough} AND (t >= {enough} OR t > n0)"
            cols = ", ".join(f"CASE WHEN {take} THEN {level} ELSE c{j} END AS c{j}" if j == i else f"c{j}" for j in range(n))
            steps.append(f"s{k + 1} AS MATERIALIZED (SELECT {cols}, n0, CASE WHEN {take} THEN t ELSE n END AS n FROM t{k})")
            k += 1
    end = ok([f"s{k}.c{j}" for j in range(n)])
    return f"{E}, {', '.join(steps)} SELECT {ALL}, {', '.join(f'CAST(c{j} AS INT) AS level_{asked[j][0]}' for j in range(n))} FROM estates, s{k} WHERE {end}"


def _relaxed(spark: SparkSession, sf: str, asked: Conditions, enough: int) -> DataFrame:
    df = estates(spark, sf)
    test = lambda c, op, t: F.col(c) >= t if op == ">=" else F.col(c) <= t
    parts = [engine.Conjunct("type", F.col("property_type") == "ECONOMY", hard=True)]
    parts += [engine.Conjunct(c, test(c, op, t[0]), variants=tuple(zip(engine.LEVELS, (test(c, op, x) for x in t[1:]), strict=True))) for c, op, t in asked]
    found = engine.relax(df, parts, enough=enough)
    at = ("asked", *engine.LEVELS, "dropped")
    return df.where(found.condition).select(*SHOWN, *[F.lit(at.index(level)).alias(f"level_{c}") for (c, _, _), level in zip(asked, found.levels[1:], strict=True)])


@query("relaxed_search", relaxed_sql(RELAXED_FAR, 40))
def _(spark, sf):
    return _relaxed(spark, sf, RELAXED_FAR, 40)


@query("relaxed_to_a_level", relaxed_sql(RELAXED_NEAR, engine.ENOUGH_ROWS))
def _(spark, sf):
    return _relaxed(spark, sf, RELAXED_NEAR, engine.ENOUGH_ROWS)


# Constraint layer and evaluation


@query(
    "gold_recall",
    "WITH e AS (SELECT l_orderkey AS query_id, 'c' || CAST(l_linenumber AS VARCHAR) AS \"column\", l_returnflag AS operator FROM lineitem), d AS (SELECT DISTINCT * FROM e), c AS (SELECT DISTINCT l_orderkey AS query_id, 'c' || CAST(l_linenumber AS VARCHAR) AS \"column\", l_returnflag AS operator FROM lineitem WHERE l_quantity > 20) SELECT query_id, count(*) AS expected, count(c.operator) AS captured, CAST(count(c.operator) AS DOUBLE) / count(*) AS recall FROM d LEFT JOIN c USING (query_id, \"column\", operator) GROUP BY 1",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = lambda d: d.select(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column"), F.col("l_returnflag").alias("operator")).distinct()
    return metrics.gold_recall(rows(li), rows(li.where("l_quantity > 20")))


@query("constraint_counters", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS n_entries, CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS n_failures, CAST(sum(l_linenumber) AS BIGINT) AS n_rendered, CAST(0 AS BIGINT) AS n_skipped, avg(CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END) AS valid_rate FROM lineitem")
def _(spark, sf):
    n = F.array_repeat(F.lit("x"), F.col("l_linenumber"))
    none = F.array().cast("array<string>")
    runs = table(spark, sf, "lineitem").select(n.alias("entries"), F.when(F.col("l_returnflag") == "A", F.array(F.lit("x"))).otherwise(none).alias("failures"), n.alias("rendered"), none.alias("skipped"), (F.col("l_linestatus") == "O").alias("valid"))
    return metrics.layer_counters(runs)


RANK_SQL = "r AS (SELECT o_custkey % 150 AS g, o_orderkey AS k, list(DISTINCT l_partkey % 40) AS items FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"
IOU = "CASE WHEN len(list_distinct(list_concat(a.items, b.items))) = 0 THEN 1 ELSE CAST(len(list_intersect(a.items, b.items)) AS DOUBLE) / len(list_distinct(list_concat(a.items, b.items))) END"


def _rankings(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select((F.col("o_custkey") % 150).alias("g"), F.col("o_orderkey").alias("k"))
    items = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("i"))  # small numbers make a small shuffle
    return orders.join(items, F.col("k") == F.col("l_orderkey")).groupBy("g", "k").agg(F.collect_set("i").alias("items"))


@query("set_iou_pairs", f"WITH {RANK_SQL} SELECT a.g, a.k AS a, b.k AS b, round({IOU}, 4) AS iou FROM r a JOIN r b ON a.g = b.g AND a.k < b.k")
def _(spark, sf):
    return metrics.pairs_within(_rankings(spark, sf), "g", "k", "items").withColumn("iou", F.round("iou", 4))


@query("self_consistency", f"WITH {RANK_SQL}, p AS (SELECT a.g, avg({IOU}) AS m FROM r a JOIN r b ON a.g = b.g AND a.k < b.k GROUP BY 1) SELECT round(avg(m), 6) AS consistency, count(*) AS groups FROM p")
def _(spark, sf):
    return metrics.self_consistency(_rankings(spark, sf), "g", "k", "items").withColumn("consistency", F.round("consistency", 6))


@query("ranking_impact", f"WITH {RANK_SQL}, p AS (SELECT {IOU} AS iou FROM r a JOIN r b ON a.g = b.g AND a.k < b.k) SELECT round(1 - avg(iou), 6) AS impact, round(avg(CASE WHEN iou = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM p")
def _(spark, sf):
    got = metrics.ranking_impact(_rankings(spark, sf), "g", "k", "items")
    return got.select(F.round("impact", 6).alias("impact"), F.round("zero_share", 6).alias("zero_share"))


@query(
    "shared_item_pairs",
    "WITH r AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem), n AS (SELECT k, count(*) AS n FROM r GROUP BY 1), s AS (SELECT a.k AS a, b.k AS b, count(*) AS s FROM r a JOIN r b ON a.i = b.i AND a.k < b.k GROUP BY 1, 2) SELECT a, b, round(CAST(s AS DOUBLE) / (x.n + y.n - s), 4) AS iou FROM s JOIN n x ON x.k = a JOIN n y ON y.k = b",
)
def _(spark, sf):
    got = metrics.overlap_pairs(table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    return got.withColumn("iou", F.round("iou", 4))


@query(
    "consensus_mode",
    "WITH v AS (SELECT l_partkey % 300 AS g, l_returnflag || l_linestatus AS sig, count(*) AS votes, min(l_orderkey) AS trial FROM lineitem GROUP BY 1, 2) SELECT g, sig, votes, trial FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY votes DESC, trial, sig) = 1",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_partkey") % 300).alias("g"), F.concat("l_returnflag", "l_linestatus").alias("sig"), "l_orderkey")
    return metrics.consensus(rows, "g", "l_orderkey", "sig").withColumnRenamed("l_orderkey", "trial")


@query(
    "activation_prf",
    "WITH c AS (SELECT CAST(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN toxic = 0 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN toxic = 1 AND quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM labels), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS r FROM c) SELECT tp, fp, fn, round(p, 3) AS \"precision\", round(r, 3) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 3) AS f1 FROM p",
)
def _(spark, sf):
    return metrics.confusion(table(spark, sf, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("latency_summary", "SELECT event_type, round(avg(value), 4) AS mean_ms, round(median(value), 4) AS median_ms, count(value) AS n FROM events GROUP BY 1")
def _(spark, sf):
    got = metrics.latency(table(spark, sf, "events"), "value", ["event_type"])
    return got.select("event_type", F.round("mean_ms", 4).alias("mean_ms"), F.round("median_ms", 4).alias("median_ms"), "n")


@query(
    "rank_corr",
    "WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1",
)
def _(spark, sf):
    return metrics.rank_correlation(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]).withColumn("rho", F.round("rho", 6))


@query(
    "ood_tightness",
    f"{E}, s AS (SELECT min(surface_area) AS lo, max(surface_area) AS hi FROM estates), l AS (SELECT CAST(o_orderkey % 70 AS DOUBLE) * 10 AS value FROM orders) SELECT value, (value < lo OR value > hi) AS ood, round(CASE WHEN value < lo THEN lo - value WHEN value > hi THEN value - hi ELSE 0 END / greatest(hi - lo, 1), 4) AS distance, round((value - lo) / greatest(hi - lo, 1), 4) AS tightness FROM l, s",
)
def _(spark, sf):
    lits = table(spark, sf, "orders").select(F.lit("surface_area").alias("column"), ((F.col("o_orderkey") % 70).cast("double") * 10).alias("value"))
    got = metrics.out_of_domain(lits, stats.numeric_stats(estates(spark, sf), ["surface_area"]).select("column", "min", "max"))
    return got.select("value", "ood", F.round("distance", 4).alias("distance"), F.round("tightness", 4).alias("tightness"))


@query("stability_labels", "SELECT o_custkey, count(*) AS appeared, CASE WHEN count(*) = 0 THEN 'BIAS' WHEN count(*) = 15 THEN 'STABLE' ELSE 'VARIANCE' END AS label FROM orders GROUP BY 1")
def _(spark, sf):
    return metrics.stability(table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("appeared")), 15)


@query("domain_coverage", f"{E} SELECT round(avg((CASE WHEN energy_class IN ('A4', 'B') THEN 1 ELSE 0 END + CASE WHEN property_type = 'ECONOMY' THEN 1 ELSE 0 END) / 2.0), 6) AS coverage FROM estates")
def _(spark, sf):
    rows = estates(spark, sf).select(F.array("energy_class", "property_type").alias("cols"))
    return metrics.domain_coverage(rows, "cols", {"energy": ["A4", "B"], "building": ["ECONOMY"]}).select(F.round("coverage", 6).alias("coverage"))


@query(
    "run_metrics",
    f"{E}, e AS (SELECT CASE WHEN house_number IS NULL THEN NULL ELSE energy_class END AS energy_class FROM estates) SELECT count(*) AS total, count(energy_class) AS with_epc, CAST(sum(CASE WHEN energy_class IN ('F', 'G') THEN 1 ELSE 0 END) AS BIGINT) AS worst, round(100.0 * count(energy_class) / count(*), 1) AS with_epc_pct, round(100.0 * sum(CASE WHEN energy_class IN ('F', 'G') THEN 1 ELSE 0 END) / count(*), 1) AS worst_pct FROM e",
)
def _(spark, sf):
    rows = estates(spark, sf).select(F.when(F.col("house_number").isNotNull(), F.col("energy_class")).alias("energy_class"))
    return metrics.run_summary(rows).select("total", "with_epc", "worst", "with_epc_pct", "worst_pct")


# Feedback, text, graphs


@query("feedback_average", f"WITH {FEEDBACK_SQL} SELECT building_id, round(avg(rating), 6) AS rating, count(rating) AS n FROM feedback WHERE building_id IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return feedback(spark, sf).where("building_id is not null").groupBy("building_id").agg(F.round(F.avg("rating"), 6).alias("rating"), F.count("rating").alias("n"))


@query("latest_rating", f"WITH {FEEDBACK_SQL} SELECT building_id, rating, feedback_id FROM feedback WHERE building_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY building_id ORDER BY created_at DESC, feedback_id DESC) = 1")
def _(spark, sf):
    return finalise.latest(feedback(spark, sf).where("building_id is not null"), ["building_id"], ["created_at", "feedback_id"]).select("building_id", "rating", "feedback_id")


@query("feedback_export", f"WITH {FEEDBACK_SQL} SELECT feedback_id, run_id, CASE WHEN agent_name IS NULL AND building_id IS NULL THEN 'GLOBAL' ELSE coalesce(agent_name, '') END AS agent, coalesce(building_id, '') AS building, coalesce(CAST(rating AS VARCHAR), '') AS rating FROM feedback")
def _(spark, sf):
    return finalise.feedback_export(feedback(spark, sf))


@query(
    "feedback_upsert",
    f"WITH {FEEDBACK_SQL}, o AS (SELECT run_id, agent_name, max(feedback_id) AS fid FROM feedback WHERE 2 * feedback_id < (SELECT count(*) FROM feedback) GROUP BY 1, 2), n AS (SELECT run_id, agent_name, max(feedback_id) AS fid FROM feedback WHERE 2 * feedback_id >= (SELECT count(*) FROM feedback) GROUP BY 1, 2) SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.run_id = o.run_id AND n.agent_name IS NOT DISTINCT FROM o.agent_name)",
)
def _(spark, sf):
    last = lambda d: d.groupBy("run_id", "agent_name").agg(F.max("feedback_id").alias("fid"))
    f = feedback(spark, sf)
    f = f.crossJoin(F.broadcast(f.agg((F.count("*") / 2).alias("half"))))
    return finalise.upsert(last(f.where("feedback_id < half")), last(f.where("feedback_id >= half")), ["run_id", "agent_name"])


@query("retry_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt FROM events")
def _(spark, sf):
    steps = table(spark, sf, "events").select("event_id", F.col("event_type").alias("agent"), F.col("user_id").alias("run"), F.lit(None).cast("string").alias("batch"), F.lit("m").alias("mode"), F.col("event_id").alias("position"))
    return finalise.retries(steps).select("event_id", F.col("attempt").cast("long").alias("attempt"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    wrapped = F.concat(F.lit("<think>no {</think>```json "), "props", F.lit(" ```"))
    return table(spark, sf, "events").select("event_id", F.try_variant_get(X.json_object(wrapped), "$.k", "bigint").alias("k"))


@query("list_literal_parse", f"{E} SELECT id, CAST(CASE WHEN house_number IS NULL THEN 2 ELSE 3 END AS BIGINT) AS n, energy_class AS first FROM estates")
def _(spark, sf):
    text = F.concat(F.lit("['"), "energy_class", F.lit("', \""), "address", F.lit('"'), F.coalesce(F.concat(F.lit(", "), "house_number"), F.lit("")), F.lit("]"))
    parsed = X.list_of(text)
    return estates(spark, sf).select("id", F.size(parsed).cast("long").alias("n"), F.get(parsed, 0).alias("first"))


@query("top_carriers", f"{E}, c AS (SELECT id, unnest(['gas', 'wood', 'power', 'oil', 'district', 'pellet']) AS carrier, unnest([commercial * 9.6, education * 4.0, mobility, healthcare * 10.0, sport, green * 4.7]) AS e FROM estates) SELECT id, string_agg(carrier, ',' ORDER BY e DESC, carrier) AS carriers FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY e DESC, carrier) AS rn FROM c WHERE e > 0) WHERE rn <= 5 GROUP BY id")
def _(spark, sf):
    use = F.create_map(*[x for n, c in zip(("gas", "wood", "power", "oil", "district", "pellet"), NEAR, strict=True) for x in (F.lit(n), F.col(c))])
    heat = F.create_map(*[F.lit(x) for kv in (("gas", 9.6), ("wood", 4.0), ("oil", 10.0), ("pellet", 4.7)) for x in kv])
    got = estates(spark, sf).select("id", F.array_join(F.transform(X.top_carriers(use, heat), lambda c: c["carrier"]), ",").alias("carriers"))
    return got.where("carriers <> ''")


@query("regex_extract", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) - length(replace(html, '<a ', 'a ')) AS links FROM pages")
def _(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.length("html") - F.length(F.replace("html", F.lit("<a "), F.lit("a ")))).cast("long").alias("links"))


@query("markup_extract", "SELECT doc_id, lang || '-' || source AS ape, CAST(n_chars AS DOUBLE) AS surface_area FROM documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    tags = "<n:datiAttestato><n:codiceIdentificativo> "
    xml = F.concat(F.lit(f"junk<n:ape xmlns:n='u'>{tags}"), "lang", F.lit("-"), "source", F.lit(" </n:codiceIdentificativo></n:datiAttestato><datiGenerali><datiIdentificativi><superficieUtileRiscaldata>"), F.col("n_chars").cast("string"), F.lit(",0</superficieUtileRiscaldata></datiIdentificativi></datiGenerali></n:ape>"))
    rows = d.select("doc_id", readers.decoded(xml.cast("binary")).alias("xml"))
    got = certificates.values(rows, {k: certificates.PATHS[k] for k in ("epc_id", "surface_area")}, "xml")
    return got.select("doc_id", F.col("epc_id").alias("ape"), X.number(F.col("surface_area")).alias("surface_area"))


def _turns(values: list[str | None], by: int = 1) -> str:
    """One of some texts by the part's key."""
    return f"CASE CAST(floor(p_partkey / {by}.0) AS BIGINT) % {len(values)} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


#: What the made certificates hold, the same for XML and for SQL; null: the element isn't there.
EPC = {
    "address": _turns(["Via Po", None, " Corso Re "]), "address2": _turns(["Via B", "Via C"]), "civic": _turns([None, "7"]), "civic2": _turns(["9", None, "10"]), "surface": "CAST(p_size AS VARCHAR(9)) || ',5'", "day": _turns(["03/02/2019", "2020-11-30", "31/12/2018", "none", None]),
    "dpr": _turns([str(i) for i in range(17)]), "class": _turns(["A1", "B", "f", None, " A4 ", "G"], 3), "sheet": _turns(["12", None, "7"]), "sub1": _turns(["003", "0", None, "12"]), "sub2": _turns(["3", "00", "5", None, "12"]), "comune": _turns(["L219", "A1", None]),
    "winter": _turns(["0", "1", "2", "9", None], 2), "plant": _turns(["0", "1", "4", "15", "19", "34", "35", "77", None]), "plant2": _turns(["4", None]), "text": _turns(["legna", None, "Condensing"], 5), "heat": _turns(["true", "false", "TRUE", None]), "sim": _turns([None, None, "x"]),
    "cool": _turns(["TRUE", "false", None], 2), "lift": _turns(["true", None], 3), "gas": _turns(["10,5", "0", None, "x", "100"], 2), "grid": _turns([None, "1000", "55.5", "104.37"]), "sun": _turns(["0", None, "3,5", "0"]), "pay": _turns(["12", None, None], 2),
}
EPC_XML = (
    "<n:ape xmlns:n='u'><n:datiGenerali>{address:indirizzo}{dpr:classificazioneDPR412}<n:datiIdentificativi>{civic:numeroCivico}{surface:superficieUtileRiscaldata}</n:datiIdentificativi>"
    "<n:serviziEnergeticiPresenti>{heat:climatizzazioneInvernale}{cool:climatizzazioneEstiva}{lift:trasportoPersoneCose}</n:serviziEnergeticiPresenti></n:datiGenerali><n:datiCalcolo><n:datiGenerali>{address2:indirizzo}{civic2:civico}</n:datiGenerali></n:datiCalcolo>{day:dataEmissione}<n:prestazioneGlobale><n:prestazioneEnergeticaGlobale><n:classificazione>{class:classeEnergetica}</n:classificazione></n:prestazioneEnergeticaGlobale>"
    "<n:prestazioneEnergeticaFabbricato>{winter:inverno}</n:prestazioneEnergeticaFabbricato></n:prestazioneGlobale><n:datiCatastali>{comune:codiceCatastale}{sheet:foglio}<n:subalterni>{sub1:subDA}{sub2:subA}</n:subalterni></n:datiCatastali><n:datiCatastali><n:foglio>99</n:foglio></n:datiCatastali>"
    "<n:datiImpianti><n:climatizzazioneInvernale>{sim:impiantoSimulato}<n:impianto>{plant:tipoImpianto}{text:descrizioneImpianto}</n:impianto><n:impianto><n:tipoImpianto>1</n:tipoImpianto></n:impianto></n:climatizzazioneInvernale></n:datiImpianti><n:impianti><n:impiantoAcquaCaldaSanitaria><n:impianto>{plant2:tipoImpianto}</n:impianto><n:annoInstallazione>1999</n:annoInstallazione></n:impiantoAcquaCaldaSanitaria></n:impianti>"
    "<n:prestazioneImpianti><n:gasNaturale>{gas:consumoAnnuo}</n:gasNaturale><n:energiaElettricaRete>{grid:consumoAnnuo}</n:energiaElettricaRete><n:solareFotovoltaico>{sun:consumoAnnuo}</n:solareFotovoltaico></n:prestazioneImpianti><n:raccomandazioni>{pay:tempoRitornoInvestimento} cappotto; infissi, 8,5 anni di ritorno</n:raccomandazioni></n:ape>"
)


def _certificates(spark: SparkSession, sf: str) -> DataFrame:
    """(file, xml): a certificate for each part, one in 50 of them cut off."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the parts are few bytes, that is one task, the documents are not
    rows = table(spark, sf, "part").repartition(tasks).selectExpr("p_partkey", *[f"{v} AS {k}" for k, v in EPC.items()])
    parts = [F.lit("<?xml version='1.0'?>")]
    for piece in re.split(r"(\{\w+:\w+\})", EPC_XML):
        held = re.fullmatch(r"\{(\w+):(\w+)\}", piece)
        parts.append(F.when(F.col(held[1]).isNull(), "").otherwise(F.concat(F.lit(f"<n:{held[2]}>"), F.col(held[1]), F.lit(f"</n:{held[2]}>"))) if held else F.lit(piece))
    xml = F.concat(*parts)
    return rows.select(F.concat("p_partkey", F.lit(".xml")).alias("file"), F.when(F.col("p_partkey") % 50 == 0, F.substring(xml, 1, 500)).otherwise(xml).alias("xml"))


def _say(column: str, labels: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items()) + " END"


EPC_SQL = f"WITH h AS (SELECT p_partkey, {', '.join(f'{v} AS {k}' for k, v in EPC.items())} FROM part), c AS (SELECT p_partkey, {', '.join(f'CASE WHEN p_partkey % 50 <> 0 THEN trim({k}) END AS {k}' for k in EPC)} FROM h), "
EPC_SQL += (
    "n AS (SELECT *, TRY_CAST(replace(gas, ',', '.') AS DOUBLE) * 9.94 AS k_gas, TRY_CAST(grid AS DOUBLE) AS k_grid, TRY_CAST(replace(sun, ',', '.') AS DOUBLE) AS k_sun, nullif(ltrim(sub1, '0'), '') AS s1, nullif(ltrim(sub2, '0'), '') AS s2, "
    f"{_say('plant', certificates.PLANT_LABELS)} AS kind, {_say('plant', certificates.DETAIL_PLANT_LABELS)} AS kind2 FROM c), m AS (SELECT *, CASE WHEN sub1 IS NOT NULL THEN coalesce(s1, '0') END AS a, CASE WHEN sub2 IS NOT NULL THEN coalesce(s2, '0') END AS b FROM n), "
    "f AS (SELECT *, CASE WHEN a = b THEN a ELSE nullif(concat_ws(',', a, b), '') END AS sub, coalesce(kind, text) AS plant_text FROM m)"
)


@query(
    "certificate_shred",
    f"{EPC_SQL} SELECT p_partkey || '.xml' AS file, coalesce(comune, 'T0') || '_' || coalesce(sheet, 'None') || '_None_' || coalesce(sub, CAST(p_partkey AS VARCHAR)) AS id, coalesce(address, address2) AS address, coalesce(civic, civic2) AS house_number, TRY_CAST(replace(surface, ',', '.') AS DOUBLE) AS surface_area, sheet AS cadastral_sheet, sub AS cadastral_subaltern, coalesce(comune, 'T0') AS comune_code, "
    "CASE day WHEN '03/02/2019' THEN '2019-02-03' WHEN '31/12/2018' THEN '2018-12-31' WHEN '2020-11-30' THEN day END AS day, class AS energy_class, "
    + _say("dpr", certificates.USE_LABELS)
    + " AS property_type, "
    + _say("winter", certificates.ENVELOPE_LABELS)
    + " AS envelope, plant_text AS heating_system_type, CASE WHEN p_partkey % 50 <> 0 THEN '1999' END AS dhw_system_year, CASE WHEN plant2 = '4' THEN 'Heat pump' END AS dhw_system_type, "
    "concat_ws(',', CASE WHEN heat = 'true' AND sim IS NULL THEN 'Heating' END, CASE WHEN lower(cool) = 'true' THEN 'Cooling' END, CASE WHEN lift = 'true' THEN 'Elevators/Transport' END) AS services, "
    "CASE WHEN greatest(k_gas, k_grid, k_sun) IS NULL THEN NULL WHEN k_grid = greatest(k_gas, k_grid, k_sun) THEN 'Electricity from grid' WHEN k_gas = greatest(k_gas, k_grid, k_sun) THEN 'Natural gas' ELSE 'Solar photovoltaic' END AS main_energy_carrier, CASE WHEN k_sun > 0 THEN 'Yes' ELSE 'No' END AS renewable_sources, "
    "CAST(CASE WHEN contains(lower(plant_text), 'heat pump') OR contains(lower(plant_text), 'district heating') THEN 5 WHEN contains(lower(plant_text), 'condensing') THEN 3 ELSE 1 END + CASE winter WHEN '0' THEN 5 WHEN '1' THEN 3 ELSE 1 END + CASE WHEN k_sun > 0 THEN 5 ELSE 1 END + CASE WHEN upper(class) LIKE 'A%' THEN 5 WHEN class = 'B' THEN 3 ELSE 1 END AS INT) AS energy_score_total FROM f",
)
def _(spark, sf):
    got = certificates.shred(_certificates(spark, sf), "T0")
    return got.select(
        F.get("ape_file_list", 0).alias("file"), "id", "address", "house_number", "surface_area", "cadastral_sheet", "cadastral_subaltern", "comune_code", F.date_format("effective_date", "yyyy-MM-dd").alias("day"), "energy_class", "property_type",
        F.col("envelope_winter_quality").alias("envelope"), "heating_system_type", "dhw_system_year", "dhw_system_type", F.array_join("services_present", ",").alias("services"), "main_energy_carrier", "renewable_sources", "energy_score_total",
    )


@query(
    "certificate_detail",
    f"{EPC_SQL} SELECT p_partkey || '.xml' AS file, coalesce(address, address2) AS address, sheet, comune AS cadastral_code, sub1 AS sub_da, sub2 AS sub_a, coalesce("
    + _say("winter", certificates.FACE_LABELS)
    + ", winter) AS winter_quality, coalesce(kind2, text, plant, CASE WHEN p_partkey % 50 <> 0 THEN '1' END) AS heating_system_desc, CASE WHEN p_partkey % 50 <> 0 THEN '1999' END AS dhw_system_year, "
    "(SELECT string_agg(n || ':' || CAST(CAST(round_even(v * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY v DESC, i) FROM (VALUES (0, 'Grid electricity', k_grid), (1, 'Natural gas', k_gas), (2, 'Photovoltaic solar', k_sun)) t(i, n, v) WHERE v > 0) AS vectors, CASE WHEN p_partkey % 50 <> 0 THEN coalesce(pay, '8.5') END AS payback_period, "
    "CASE WHEN p_partkey % 50 <> 0 THEN coalesce(pay || ' ', '') || 'cappotto' || '|infissi, 8,5 anni di ritorno' ELSE '' END AS interventions, concat_ws(',', CASE WHEN heat = 'true' AND sim IS NULL THEN 'Heating' END, CASE WHEN lower(cool) = 'true' THEN 'Cooling' END, CASE WHEN lift = 'true' THEN 'Lifts/Transport' END) AS services FROM f",
)
def _(spark, sf):
    d = certificates.detail(_certificates(spark, sf))
    vectors = F.array_join(F.transform("top_vectors", lambda x: F.concat(x["carrier"], F.lit(":"), F.bround(x["kwh"] * 100).cast("long").cast("string"))), ",")
    return d.select(
        "file", "address", "sheet", "cadastral_code", "sub_da", "sub_a", "winter_quality", "heating_system_desc", "dhw_system_year", F.nullif(vectors, F.lit("")).alias("vectors"), "payback_period", F.array_join("suggested_interventions", "|").alias("interventions"), F.array_join("present_services", ",").alias("services"),
    )


@query("query_combinations", "WITH a AS (SELECT unnest(['office', 'home']) AS a), b AS (SELECT unnest(['near metro', 'in centre', NULL]) AS b), c AS (SELECT unnest(['class A', 'class B', NULL]) AS c) SELECT concat_ws(' ', a, b, c) AS text FROM a, b, c")
def _(spark, sf):
    return metrics.query_combinations(spark, [["office", "home"], ["near metro", "in centre"], ["class A", "class B"]], partial=True)


@query(
    "graph_edges_lag",
    "WITH s AS (SELECT l_returnflag || l_linestatus AS line, l_partkey % 50 AS name, lag(l_partkey % 50) OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS p FROM lineitem) SELECT least(p, name) AS a, greatest(p, name) AS b, string_agg(DISTINCT line, '/' ORDER BY line) AS lines FROM s WHERE p IS NOT NULL AND p <> name GROUP BY 1, 2",
)
def _(spark, sf):
    s = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("line"), (F.col("l_partkey") % 50).alias("name"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("position"), F.expr("l_orderkey div 1000").alias("part"))
    return metrics.edges_by_line(s, part="part")


@query(
    "marker_clusters",
    f"{E}, p AS (SELECT latitude, longitude, (longitude + 180) / 360 AS x, 0.5 - ln((1 + sin(radians(latitude))) / (1 - sin(radians(latitude)))) / (4 * pi()) AS y, 256 * 8192.0 / 75 AS scale FROM estates) SELECT CAST(floor(x * scale) AS BIGINT) AS cell_x, CAST(floor(y * scale) AS BIGINT) AS cell_y, count(*) AS n, round(avg(latitude) + 0.0000137, 4) AS lat, round(avg(longitude) + 0.0000137, 4) AS lon FROM p GROUP BY 1, 2",
)
def _(spark, sf):
    got = spatial.marker_clusters(estates(spark, sf), 13)
    moved = lambda c: F.round(F.col(c) + 0.0000137, 4).alias(c)  # noqa: E731  off the places where rounding turns
    return got.select("cell_x", "cell_y", "n", moved("lat"), moved("lon"))


@query("seeded_sample")
def _(spark, sf):
    return readers.sample(table(spark, sf, "customer"), "c_custkey", 500)


@query("events_hourly", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(spark, sf):
    got = stream.hourly(table(spark, sf, "events"))
    return got.withColumn("total", F.round("total", 4))


@query("events_latest", "SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def _(spark, sf):
    return stream.latest(table(spark, sf, "events"))


from parcelspark.plans import more_queries  # noqa: E402  they add themselves

__all__ = ["ORACLE_SQL", "QUERIES", "more_queries"]
