"""Further named queries: sources and sinks read back, text functions, stores, evaluation and the driver-side layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions import exprs as X
from parcelspark.operators import evaluation, filters, finalise, metrics, scoring, spatial, stats
from parcelspark.plans import constraints, engine
from parcelspark.plans.catalog import query, scratch
from parcelspark.plans.tables import ESTATES_SQL, FEEDBACK_SQL, POIS_SQL, estates, feedback, pois, table
from parcelspark.sources import readers, sinks

E = "WITH " + ESTATES_SQL


def rows_sql(rows: list[tuple], columns: str) -> str:
    """Literal rows as SQL."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


def turns(key: str, values: list[str | None], by: int = 1) -> str:
    """One of some texts by a key, as SQL that both dialects read."""
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    return f"CASE CAST(floor({key} / {by}.0) AS BIGINT) % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


# Sources and sinks


@query("csv_read_back", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name, CAST(c_acctbal AS DOUBLE) AS balance FROM customer")
def _(spark, sf):
    path = scratch(spark, "customers")
    table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_name", F.col("c_acctbal").alias("balance")).write.option("header", True).option("sep", ";").csv(path)
    got = readers.semicolon_csv(spark, path)
    return got.select("id", "c_name", X.number(F.col("balance")).alias("balance"))


@query("sniffed_csv", "SELECT n_nationkey, n_name, 'a;b' AS note FROM nation")
def _(spark, sf):
    path = scratch(spark, "nations")
    table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit("a;b").alias("note")).write.option("header", True).csv(path)
    return readers.sniffed_csv(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", "note")


@query("json_lines_back", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 5 <> 0 THEN value END AS inner_value, event_type FROM events")
def _(spark, sf):
    path = scratch(spark, "events")
    e = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    inner = F.when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    sinks.json_lines(e.select("event_id", value.alias("value"), F.struct(F.array(inner).alias("a")).alias("s"), "event_type"), path)
    got = spark.read.schema("event_id long, value double, s struct<a: array<double>>, event_type string").json(path)
    return got.select("event_id", "value", F.get("s.a", 0).alias("inner_value"), "event_type")


@query("poi_file_back", f"WITH {POIS_SQL} SELECT poi_id AS id, category, amenity, lat, lon, CASE WHEN amenity = 'park' THEN 'neighbourhood' ELSE 'city' END AS reach FROM pois")
def _(spark, sf):
    path = scratch(spark, "pois")
    raw = F.when(F.col("category") == "green", "Verde").when(F.col("category") == "mobility", "mobilità").otherwise("commerciale")
    sinks.pois_json(pois(spark, sf).select(raw.alias("category"), "amenity", F.col("poi_id").alias("id"), "lat", "lon"), path)
    return readers.pois(spark, path).select("id", "category", "amenity", "lat", "lon", "reach")


@query("population_zones", "SELECT upper(n_name) || ' ' AS zone, coalesce(a.x, 0) AS young, coalesce(a.y, 0) AS old FROM nation n LEFT JOIN (SELECT c_nationkey AS k, CAST(count(*) AS DOUBLE) AS x, CAST(count(*) * 2 AS DOUBLE) AS y FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1) a ON a.k = n.n_nationkey")
def _(spark, sf):
    n = table(spark, sf, "nation")
    c = table(spark, sf, "customer").where("c_nationkey % 3 <> 0").groupBy("c_nationkey").agg(F.count("*").alias("0-4"), (F.count("*") * 2).alias("5+"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit(" "), "n_name").alias("zona"), F.col("0-4").cast("string").alias("0-4"), F.col("5+").cast("string").alias("5+"))
    total = spark.createDataFrame([("TOTALE", "9", "9"), ("Non localizzato", "9", "9")], "zona string, `0-4` string, `5+` string")
    got = finalise.zone_population(n.select(F.concat(F.upper("n_name"), F.lit(" ")).alias("zone")), readers.population(rows.unionByName(total), "zona"), ["0-4", "5+"])
    return got.select("zone", F.col("0-4").alias("young"), F.col("5+").alias("old"))


@query("schema_probe", "SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' ELSE 'string' END AS kind FROM (DESCRIBE SELECT * FROM customer)")
def _(spark, sf):
    return spark.createDataFrame(list(readers.schema_of(table(spark, sf, "customer")).items()), "name string, kind string")


@query("trace_payloads", "SELECT user_id AS run, event_type AS agent, arg_min(event_id, event_id) AS output FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2")
def _(spark, sf):
    path = scratch(spark, "traces")
    k = F.col("event_id")
    sinks.traces(table(spark, sf, "events").select(F.col("user_id").alias("run"), k.alias("position"), F.col("event_type").alias("agent"), F.when(k % 3 != 0, k).alias("output")), path)
    got = spark.read.schema("run long, steps array<struct<position: long, agent: string, output: long>>").json(path)
    return readers.trace_payloads(got.select("run", F.inline("steps")))


@query(
    "regional_extracts",
    "SELECT region, count(*) AS n FROM (SELECT 'amsterdam' AS region FROM customer WHERE 990 + c_custkey % 150 BETWEEN 1000 AND 1109 UNION ALL SELECT 'dublin' FROM customer WHERE c_custkey % 4 IN (0, 1, 2) UNION ALL SELECT 'london' FROM customer WHERE c_custkey % 3 IN (0, 1) UNION ALL SELECT 'liege' FROM customer WHERE c_custkey % 3 IN (0, 1)) GROUP BY 1",
)
def _(spark, sf):
    c = table(spark, sf, "customer")
    df = c.select(
        F.concat((990 + F.col("c_custkey") % 150).cast("string"), F.lit("AB")).alias("postcode"), F.expr(turns("c_custkey", ["Dublin 4", "Dublin 6W", " Co. Dublin", "Co. Cork"])).alias("county"),
        F.expr(turns("c_custkey", ["London", " LONDON ", "Leeds"])).alias("posttown"), F.expr(turns("c_custkey", ["Liège", "LIEGE", "Namur"])).alias("commune"),
    )
    each = [readers.regional(df, r).groupBy(F.lit(r).alias("region")).agg(F.count("*").alias("n")) for r in ("amsterdam", "dublin", "london", "liege")]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


@query("feedback_kinds", f"WITH {FEEDBACK_SQL} SELECT 'agent' AS kind, count(*) AS n FROM feedback WHERE agent_name = 'agent3' UNION ALL SELECT 'building', count(*) FROM feedback WHERE building_id = 'b7' UNION ALL SELECT 'run', count(*) FROM feedback WHERE agent_name IS NULL AND building_id IS NULL")
def _(spark, sf):
    f = feedback(spark, sf)
    n = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n(filters.feedback_of(f, agent="agent3"), "agent").unionByName(n(filters.feedback_of(f, building="b7"), "building")).unionByName(n(filters.feedback_of(f), "run"))


# Text

STREETS = ["10128 TORINO - C.SO Trapani 133", "VIA Roma 10 bis", "P.zza Castello", "Corso Re Umberto, 5 TO", " : via Po"]
CADASTRE = ["Foglio 12 particella 34 sub 5", "F 12 P 345 S 6", "12/345/6", "x 7 - 8 - 9", "none", None]
PLACES = ["vicino a Porta Nuova", "in zona Crocetta", "area di San Salvario", "davanti a il parco", "Mole", None]
PAYBACK = ["costo, 12,5 anni di ritorno", "3 anno payback", "nulla", None]


@query(
    "text_patterns",
    f"SELECT p_partkey AS id, {turns('p_partkey', ['corso trapani', 'via roma', 'piazza castello', 'corso re umberto', 'via po'])} AS street, {turns('p_partkey', ['133', '10 bis', None, None, None])} AS number, {turns('p_partkey', ['12/34/5', '12/345/6', '12/345/6', '7/8/9', None, None], 5)} AS cadastral, "
    f"{turns('p_partkey', ['porta nuova', 'crocetta', 'san salvario', 'parco', 'mole', None], 2)} AS place, {turns('p_partkey', ['12.5', '3', None, None], 3)} AS payback FROM part",
)
def _(spark, sf):
    t = lambda values, by=1: F.expr(turns("p_partkey", values, by))
    # A city after the number hides it from both patterns, as it stands at the end.
    s = t([x if not x.endswith(" TO") else "Corso Re Umberto TO" for x in STREETS])
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), X.clean_street(s).alias("street"), X.house_number(s).alias("number"), X.cadastral_id(t(CADASTRE, 5)).alias("cadastral"), X.place_name(t(PLACES, 2)).alias("place"), X.payback_years(F.lit(None).cast("string"), t(PAYBACK, 3)).alias("payback")
    )


NUMBERS = [" 12,5", "7", "x", None, "-3.25", "1e2"]
DATES = ["03/02/2019", "2020-11-30", "31/12/2018", "30/02/2018", None]


@query(
    "coercions",
    f"SELECT c_custkey AS id, TRY_CAST(replace(trim({turns('c_custkey', NUMBERS)}), ',', '.') AS DOUBLE) AS number, coalesce(TRY_CAST(replace(trim({turns('c_custkey', NUMBERS)}), ',', '.') AS DOUBLE), 1.0) AS or_one, CAST(coalesce(trunc(TRY_CAST(replace(trim({turns('c_custkey', NUMBERS)}), ',', '.') AS DOUBLE)), 0) AS BIGINT) AS whole, "
    f"{turns('c_custkey', ['2019-02-03', '2020-11-30', '2018-12-31', None, None], 2)} AS day, {turns('c_custkey', ['via_dell_universita', 'a_b', 'x'], 3)} AS slug, {turns('c_custkey', ['b.xml', 'c.txt', None])} AS file FROM customer",
)
def _(spark, sf):
    t = lambda values, by=1: F.expr(turns("c_custkey", values, by))
    n = t(NUMBERS)
    file = F.nullif(X.file_name(t(["a/b.xml", "d\\\\c.txt", None])), F.lit(""))
    day = F.date_format(X.day_first(t(DATES, 2)), "yyyy-MM-dd")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), X.number(n).alias("number"), X.number(n, 1.0).alias("or_one"), X.whole(n).alias("whole"), day.alias("day"), X.slug(t(["Via dell'Università", " A  b!", "_x_"], 3)).alias("slug"), file.alias("file"))


@query("landmarks", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'porta nuova' WHEN 1 THEN 'mole antonelliana' WHEN 2 THEN 'centro' END AS landmark FROM customer WHERE c_custkey % 4 <> 3")
def _(spark, sf):
    names = table(spark, sf, "customer").select(F.concat(F.expr(turns("c_custkey", ["vicino a Porta Nuova", "presso la Mole Antonelliana", "in centro", "nowhere"])), F.lit(" "), "c_custkey").alias("name"), "c_custkey")
    marks = spark.createDataFrame([("porta nuova", 45.0622, 7.6785), ("mole antonelliana", 45.0677, 7.693), ("centro", 45.07, 7.686), ("mole", 1.0, 1.0)], "landmark string, lat double, lon double")
    got = readers.landmarks_in(names.select("name"), marks)
    return got.join(names, "name").select(F.col("c_custkey").alias("id"), "landmark")


# Places


@query(
    "geocode_applied",
    f"{E} SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 AND (CAST(id AS BIGINT) % 200 >= 100 OR CAST(id AS BIGINT) % 5 = 0) THEN 1.0 WHEN CAST(id AS BIGINT) % 5 = 0 THEN NULL ELSE latitude END AS latitude FROM estates",
)
def _(spark, sf):
    df, k = estates(spark, sf), F.col("id").cast("long")
    df = df.withColumn("latitude", F.when(k % 5 != 0, F.col("latitude")))
    found = df.where(k % 3 == 0).select("id", F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), (k % 200).cast("int").alias("score"))
    return readers.apply_geocode(df, found).select("id", "latitude")


OSM_SQL = (
    "n AS (SELECT p_partkey AS id, CAST(45 AS DOUBLE) + CAST(p_partkey * 37 % 1000 AS DOUBLE) / 10000 AS lat, CAST(7 AS DOUBLE) + CAST(p_partkey * 91 % 1000 AS DOUBLE) / 10000 AS lon FROM part), w AS (SELECT l_orderkey AS id, avg(lat) AS lat, avg(lon) AS lon FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN n ON n.id = l_partkey GROUP BY 1), "
    "m AS (SELECT o_custkey AS id, w.lat, w.lon FROM orders JOIN w ON w.id = o_orderkey UNION ALL SELECT c_custkey, n.lat, n.lon FROM customer JOIN n ON n.id = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders))"
)


@query("osm_elements", f"WITH {OSM_SQL} SELECT 'node' AS type, id, round(round_even(lat, 7) + 0.00000371, 4) AS lat FROM n UNION ALL SELECT 'way', id, round(round_even(lat, 7) + 0.00000371, 4) FROM w UNION ALL SELECT 'relation', id, round(round_even(avg(lat), 7) + 0.00000371, 4) FROM m GROUP BY id")
def _(spark, sf):
    k = F.col("p_partkey")
    none, no_members = F.lit(None).cast("array<long>"), F.lit(None).cast("array<struct<type:string,ref:long>>")
    tags = F.create_map(F.lit("k"), F.lit("v"))
    nodes = table(spark, sf, "part").select(F.lit("node").alias("type"), k.alias("id"), (45 + (k * 37 % 1000).cast("double") / 10000).alias("lat"), (7 + (k * 91 % 1000).cast("double") / 10000).alias("lon"), none.alias("nodes"), no_members.alias("members"), tags.alias("tags"))
    empty = [F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon")]
    ways = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_partkey").alias("nodes")).select(F.lit("way").alias("type"), "id", *empty, "nodes", no_members.alias("members"), tags.alias("tags"))
    member = F.struct(F.lit("way").alias("type"), F.col("o_orderkey").alias("ref"))
    held = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_list(member).alias("members"))
    own = F.array(F.struct(F.lit("node").alias("type"), F.col("id").alias("ref")))
    relations = held.select(F.lit("relation").alias("type"), "id", *empty, none.alias("nodes"), F.concat("members", own).alias("members"), tags.alias("tags"))
    got = spatial.osm_points(nodes.unionByName(ways).unionByName(relations))
    return got.select("type", "id", F.round(F.col("lat") + 0.00000371, 4).alias("lat"))  # moved off the places where rounding turns


@query("poi_relocated", f"WITH {POIS_SQL} SELECT CASE WHEN category = 'green' AND amenity = 'stop' THEN 'mobility' ELSE category END AS category, count(*) AS n FROM pois GROUP BY 1")
def _(spark, sf):
    return spatial.relocate(pois(spark, sf), "green", "stop", "mobility").groupBy("category").agg(F.count("*").alias("n"))


@query("inherited_categories", f"WITH {POIS_SQL} SELECT poi_id % 6 AS parent, min(category) AS category FROM pois GROUP BY 1 HAVING min(category) = max(category)")
def _(spark, sf):
    return spatial.inherited_category(pois(spark, sf).select((F.col("poi_id") % 6).alias("parent"), "category"))


# Stores


@query("cascade_delete", "SELECT o_orderkey, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey % 4 <> 1 GROUP BY 1")
def _(spark, sf):
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("run_id"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    _, kept, left = finalise.cascade_delete(users, runs, lines, runs.select("user_id").distinct().where("user_id % 4 = 1"))
    n = left.groupBy(F.col("run_id").alias("__r")).agg(F.count("*").alias("lines"))
    return kept.join(n, F.col("run_id") == F.col("__r"), "left").select(F.col("run_id").alias("o_orderkey"), F.coalesce("lines", F.lit(0)).alias("lines"))


@query("runs_owned", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_custkey = 7")
def _(spark, sf):
    runs = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("user_id"))
    return filters.owned(runs, 7).select("o_orderkey")


@query("progress_steps", "SELECT event_id, CASE WHEN status = 'pending' AND event_id < last THEN 'done' ELSE status END AS status FROM (SELECT *, max(CASE WHEN status <> 'pending' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM (SELECT event_id, user_id, CASE event_id % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'running' ELSE 'pending' END AS status FROM events))")
def _(spark, sf):
    k = F.col("event_id")
    steps = table(spark, sf, "events").select("event_id", F.col("user_id").alias("run"), k.alias("position"), F.when(k % 4 == 0, "done").when(k % 4 == 1, "running").otherwise("pending").alias("status"))
    return finalise.progress(steps).select("event_id", "status")


@query("added_columns", f"WITH {FEEDBACK_SQL} SELECT feedback_id, agent_name, CAST(NULL AS BIGINT) AS user_id FROM feedback")
def _(spark, sf):
    return finalise.add_columns(feedback(spark, sf), {"agent_name": "string", "user_id": "long"}).select("feedback_id", "agent_name", "user_id")


@query("set_cells", "SELECT c_custkey, coalesce(u.v, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer LEFT JOIN (SELECT user_id, arg_max('s' || event_id, event_id) AS v FROM events WHERE event_type = 'view' OR event_id % 3 = 0 GROUP BY 1) u ON u.user_id = c_custkey")
def _(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    u = table(spark, sf, "events").where("event_type = 'view' OR event_id % 3 = 0").select(F.col("user_id").alias("c_custkey"), F.lit("c_mktsegment").alias("column"), F.concat(F.lit("s"), "event_id").alias("value"), F.col("event_id").alias("at"))
    return finalise.cells(c, u, "c_custkey")


@query("payload_projection", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, CAST(NULL AS VARCHAR) AS other FROM events")
def _(spark, sf):
    got = finalise.payload_keys(table(spark, sf, "events").select("event_id", "props"), "props", ["k", "other"])
    return got.select("event_id", F.col("props")["k"].alias("k"), F.col("props")["other"].alias("other"))


@query("stored_steps", "SELECT o_orderkey AS run_id, CAST(number AS INT) AS number, key, CASE key WHEN 'sql_generation' THEN 'SELECT ' || o_custkey WHEN 'evaluation' THEN o_orderstatus ELSE o_orderpriority END AS response FROM orders, (VALUES (1, 'sql_generation'), (2, 'evaluation'), (3, 'another')) s(number, key)")
def _(spark, sf):
    j = lambda *kv: F.to_json(F.struct(*[c.alias(k) for k, c in kv]))
    steps = F.create_map(F.lit("another"), F.concat(F.lit('"'), "o_orderpriority", F.lit('"')), F.lit("evaluation"), j(("response", F.lit("")), ("answer", F.col("o_orderstatus"))), F.lit("sql_generation"), j(("sql_query", F.concat(F.lit("SELECT "), "o_custkey")), ("note", F.lit("x"))))
    return finalise.agent_steps(table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), steps.alias("payload")))


@query("read_time_scores", f"{E} SELECT id, CAST(coalesce(CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 5.0 END, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN mobility END, 70) AS DOUBLE) AS score, CAST(coalesce(CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN 1.0 END, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN energy_score_total * 5.0 END, 60) AS DOUBLE) AS energy FROM estates")
def _(spark, sf):
    k = F.col("id").cast("long")
    df = estates(spark, sf).withColumns({"score": F.when(k % 3 == 0, 5.0), "ranking_score": F.when(k % 2 == 0, F.col("mobility")), "energy_score": F.when(k % 4 == 0, 1.0), "energy_score_total": F.when(k % 5 != 0, F.col("energy_score_total").cast("double")), "location_score": F.lit(None).cast("double")})
    return finalise.read_time_scores(df).select("id", "score", F.col("energy_display").alias("energy"))


# Filters, markers and statistics


def _map_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id").cast("long")
    return estates(spark, sf).withColumns(
        {"description": F.expr(turns("CAST(id AS BIGINT)", ["Public OFFICE", "home", None, "shop"])), "cultural_constraint": F.expr(turns("CAST(id AS BIGINT)", ["none", "Protected site"], 3)), "legal_nature": F.expr(turns("CAST(id AS BIGINT)", ["public", "Private", None], 5)), "energy_files": F.when(k % 3 == 0, F.array(F.lit("f"))), "tier": (k % 3 + 1).cast("int"), "surface_area": F.when(k % 11 != 0, F.col("surface_area"))}
    )


@query(
    "map_filters",
    f"{E} SELECT id FROM (SELECT *, CAST(id AS BIGINT) AS k, CASE WHEN CAST(id AS BIGINT) % 11 <> 0 THEN surface_area END AS s FROM estates) WHERE coalesce(s, 0) <= 450 AND (energy_class LIKE 'A%' OR energy_class LIKE 'B%' OR energy_class LIKE 'C%' OR energy_class LIKE 'D%') AND k % 4 IN (0, 3) AND NOT coalesce(is_meta_estate, false) AND k % 3 + 1 IN (2, 3) AND CAST(floor(k / 3.0) AS BIGINT) % 2 = 1 AND CAST(floor(k / 5.0) AS BIGINT) % 3 = 1",
)
def _(spark, sf):
    f = filters.MapFilters(energy_classes=("A", "B", "C", "D"), max_surface=450.0, usage=("office", "SHOP"), constraints=("site",), is_meta_building=False, legal_nature="PRIVATE", has_certificate=True, tiers=(2, 3))
    return filters.apply_map_filters(_map_rows(spark, sf), f).select("id")


@query("markers_sorted", f"{E} SELECT id, energy_class FROM (SELECT *, CAST(id AS BIGINT) % 7 AS r FROM estates) ORDER BY CASE WHEN r = 0 THEN 10 ELSE list_position(['A4', 'A3', 'A2', 'A1', 'B', 'C', 'D', 'E', 'F', 'G'], energy_class) END, id LIMIT 150")
def _(spark, sf):
    df = estates(spark, sf)
    hidden = df.withColumns({"shown": F.col("energy_class"), "energy_class": F.when(F.col("id").cast("long") % 7 != 0, F.col("energy_class"))})
    return filters.sort_markers(hidden, "energy").limit(150).select("id", F.col("shown").alias("energy_class"))


@query(
    "markers_full",
    f"{E} SELECT id, latitude AS lat, CASE WHEN house_number IS NULL THEN address ELSE address || ', ' || house_number END AS address, construction_period AS construction_year, is_meta_estate AS is_meta_building, CAST(energy_score_plant AS DOUBLE) AS plant, green AS greenery FROM (SELECT * FROM estates WHERE surface_area >= 100 ORDER BY id LIMIT 400)",
)
def _(spark, sf):
    m = filters.markers_full(estates(spark, sf), 400, filters.Filters(min_surface=100))
    return m.select("id", "lat", "address", "construction_year", "is_meta_building", F.col("energy_scores.plant_score").alias("plant"), F.col("proximity_scores.greenery").alias("greenery"))


@query("table_totals", "SELECT count(*) AS total_records, count(CASE WHEN p_size % 5 <> 0 THEN 1 END) AS target_count FROM part")
def _(spark, sf):
    return stats.totals(table(spark, sf, "part").select(F.when(F.col("p_size") % 5 != 0, 1).alias("x")), "x")


@query("district_counts", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def _(spark, sf):
    return stats.counts_by(table(spark, sf, "customer"), "c_mktsegment")


@query("search_and_recent", "SELECT o_orderkey FROM orders WHERE contains(lower(o_orderpriority), 'high') OR contains(CAST(o_orderkey AS VARCHAR), '77')")
def _(spark, sf):
    return filters.search_text(table(spark, sf, "orders"), "HIGH", ["o_orderpriority"]).select("o_orderkey").unionByName(filters.search_text(table(spark, sf, "orders"), "77", ["o_orderkey"]).select("o_orderkey")).distinct()


@query("dated_in_zone", f"{E} SELECT id FROM estates WHERE CAST(id AS BIGINT) % 3 <> 0 AND CAST(id AS BIGINT) % 5 IN (1, 2, 3)")
def _(spark, sf):
    k = F.col("id").cast("long")
    df = estates(spark, sf).withColumns({"effective_date": F.when(k % 3 != 0, F.current_date()), "omi_zone": F.when(k % 5 == 0, " ").when(k % 5 != 4, "C1")})
    return filters.dated_in_zone(df).select("id")


# Evaluation


@query("recall_totals", "WITH e AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS c, l_returnflag AS o FROM lineitem), f AS (SELECT DISTINCT l_orderkey AS q, l_linenumber AS c, l_returnflag AS o FROM lineitem WHERE l_quantity > 20), r AS (SELECT e.q, count(*) AS n, count(f.q) AS k FROM e LEFT JOIN f USING (q, c, o) GROUP BY 1) SELECT round(sum(k) / sum(n), 6) AS micro, round(avg(k / n), 6) AS macro FROM r")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = lambda d: d.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("column"), F.col("l_returnflag").alias("operator")).distinct()
    got = metrics.recall_totals(metrics.gold_recall(rows(li), rows(li.where("l_quantity > 20"))))
    return got.select(F.round("micro", 6).alias("micro"), F.round("macro", 6).alias("macro"))


@query(
    "judge_means",
    "WITH j AS (SELECT *, l_tax > 0.03 AS a, l_discount > 0.05 AS r FROM lineitem), m AS (SELECT count(DISTINCT l_orderkey) AS samples, " + ", ".join(f"round(avg(CASE WHEN l_linenumber % 2 = {p} THEN CASE WHEN {c} THEN 1.0 ELSE 0.0 END END), 3) AS {n}" for n, c, p in (("accuracy_pros", "a", 1), ("accuracy_cons", "a", 0), ("relevance_pros", "r", 1), ("relevance_cons", "r", 0))) + " FROM j) SELECT samples, accuracy_pros, accuracy_cons, relevance_pros, relevance_cons FROM m",
)
def _(spark, sf):
    answer = F.struct((F.col("l_tax") > 0.03).alias("accuracy"), (F.col("l_discount") > 0.05).alias("relevance"))
    of = lambda parity: F.collect_list(F.when(F.col("l_linenumber") % 2 == parity, answer))
    judged = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(of(1).alias("pros"), of(0).alias("cons"))
    return evaluation.judge_means(judged).select("samples", "accuracy_pros", "accuracy_cons", "relevance_pros", "relevance_cons")


@query(
    "replay_summary",
    "WITH r AS (SELECT o_orderstatus AS mode, o_orderkey % 3 <> 0 AS v, o_orderkey % 4 <> 1 AS x, o_orderkey % 5 AS n, o_custkey % 2 AS ic, o_custkey % 3 AS mh, coalesce(CASE o_orderkey % 6 WHEN 0 THEN 'ir' WHEN 1 THEN 'llm' WHEN 2 THEN 'fallback' END, 'llm') AS src FROM orders), h AS (SELECT mode, string_agg(src || ':' || c, ',' ORDER BY src) AS sources FROM (SELECT mode, src, count(*) AS c FROM r GROUP BY 1, 2) GROUP BY 1) "
    "SELECT r.mode, count(*) AS n, round(avg(CASE WHEN v THEN 1.0 ELSE 0.0 END), 2) AS valid_rate, round(avg(CASE WHEN x THEN 1.0 ELSE 0.0 END), 2) AS exec_rate, CAST(sum(CASE WHEN r.n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_row_queries, CAST(sum(ic) AS BIGINT) AS invalid_columns, CAST(sum(mh) AS BIGINT) AS missing_hard, any_value(sources) AS sources FROM r JOIN h ON h.mode = r.mode GROUP BY 1",
)
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    zero = F.lit(0)
    runs = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("mode"), (k % 3 != 0).alias("sql_valid"), (k % 4 != 1).alias("executes"), (k % 5).alias("rows"), (c % 2).alias("invalid_columns"), (c % 3).alias("missing_hard"), zero.alias("repairs"), zero.alias("relax_hits"), zero.alias("relax_blocked"),
        F.when(k % 6 == 0, "ir").when(k % 6 == 1, "llm").when(k % 6 == 2, "fallback").alias("sql_source"),
    )
    got = evaluation.replay_summary(runs)
    sources = F.array_join(F.transform(F.array_sort(F.map_entries("sql_source")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return got.select("mode", "n", "valid_rate", "exec_rate", "zero_row_queries", "invalid_columns", "missing_hard", sources.alias("sources"))


ACT = "q AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) FILTER (l_quantity > 20) AS e, list(DISTINCT l_returnflag) FILTER (l_discount > 0.04) AS f FROM lineitem GROUP BY 1)"


def _activations(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("l_returnflag"))))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(of(F.col("l_quantity") > 20).alias("expected"), of(F.col("l_discount") > 0.04).alias("found"))


@query(
    "activation_by_domain",
    f"WITH {ACT}, g AS (SELECT d, coalesce(list_contains(e, d), false) AS x, coalesce(list_contains(f, d), false) AS y FROM q, (VALUES ('A'), ('N'), ('R')) v(d) WHERE len(e) > 0) SELECT d AS domain, CAST(sum(CASE WHEN x AND y THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT x AND y THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN x AND NOT y THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM g GROUP BY 1",
)
def _(spark, sf):
    return evaluation.activation_by_domain(_activations(spark, sf), ["A", "N", "R"]).select("domain", "tp", "fp", "fn")


@query(
    "activation_summary",
    f"WITH {ACT}, s AS (SELECT len(e) > 0 AS asked, list_sort(coalesce(e, [])) AS e, list_sort(coalesce(f, [])) AS f FROM q) SELECT round(sum(CASE WHEN asked AND e = f THEN 1.0 ELSE 0.0 END) / count(*), 3) AS pmr, round(sum(CASE WHEN asked THEN CAST(len(list_intersect(e, f)) AS DOUBLE) / len(list_distinct(list_concat(e, f))) ELSE 0 END) / count(*), 3) AS mean_jaccard FROM s",
)
def _(spark, sf):
    return evaluation.activation_summary(_activations(spark, sf), ["A", "N", "R"]).select("pmr", "mean_jaccard")


@query(
    "ablation_sensitivity",
    "WITH r AS (SELECT l_returnflag AS config, l_orderkey % 500 AS file, list(DISTINCT l_partkey % 25) AS ids FROM lineitem GROUP BY 1, 2) SELECT o.config, round(coalesce(avg(CASE WHEN f.file IS NOT NULL THEN CAST(len(list_intersect(f.ids, o.ids)) AS DOUBLE) / len(list_distinct(list_concat(f.ids, o.ids))) END), 1), 6) AS sensitivity FROM r o LEFT JOIN (SELECT * FROM r WHERE config = 'A') f ON f.file = o.file WHERE o.config <> 'A' GROUP BY 1",
)
def _(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("config"), (F.col("l_orderkey") % 500).alias("file")).agg(F.collect_set(F.col("l_partkey") % 25).alias("ids"))
    return evaluation.ablation(runs, full="A").withColumn("sensitivity", F.round("sensitivity", 6))


@query("activated_domains", "SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'building' END, CASE WHEN c_custkey % 3 = 0 THEN 'energy' END, CASE WHEN c_custkey % 5 = 0 THEN 'proximity' END) AS domains FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    cols = F.array_compact(F.array(F.when(k % 2 == 0, "epoca_costruzione"), F.when(k % 3 == 0, "epglnren_ape"), F.when(k % 5 == 0, "verde"), F.lit("something")))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(evaluation.activated(cols), ",").alias("domains"))


@query(
    "rank_contribution",
    "WITH w AS (SELECT o_orderkey, d, CAST((o_orderkey * m) % 7 AS DOUBLE) AS w, i FROM orders, (VALUES (0, 'location', 2), (1, 'regulatory', 3), (2, 'energy', 4), (3, 'building', 5), (4, 'proximity', 6)) v(i, d, m)), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY w DESC, i) AS rank FROM w) SELECT CAST(rank AS INT) AS rank, round(avg(CASE WHEN (o_orderkey + i) % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM r GROUP BY 1",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    names = ["location", "regulatory", "energy", "building", "proximity"]
    weights = F.create_map(*[x for i, d in enumerate(names) for x in (F.lit(d), ((k * (i + 2)) % 7).cast("double"))])
    found = F.array_compact(F.array(*[F.when((k + i) % 3 == 0, d) for i, d in enumerate(names)]))
    ranked = evaluation.ranked_weights(table(spark, sf, "orders").select(k.alias("run"), weights.alias("weights"), found.alias("found")))
    return evaluation.contribution(ranked)[1].withColumn("rate", F.round("rate", 6))


@query("evaluation_rows", "SELECT l_orderkey AS run, l_linenumber AS position, u.i AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, u.i) - 1 AS batch_id FROM lineitem, (VALUES (0), (1), (2)) u(i) WHERE u.i <= l_linenumber % 3")
def _(spark, sf):
    trace = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("position"), F.sequence(F.lit(0), F.col("l_linenumber") % 3).alias("items"))
    return evaluation.evaluation_rows(trace).select("run", "position", "item", F.col("batch_id").cast("long").alias("batch_id"))


@query("explained_scores", f"{E} SELECT id, CASE WHEN property_type = 'ECONOMY' THEN '100 / Position(2)' WHEN property_type = 'PROMO' THEN '100 / Position(1)' ELSE '0 (No match)' END AS building, 'mobility: 100*(' || mobility || '-0.0)/(100.0-0.0)=' || mobility || ' [Global Ref] * Weight(1.000)' AS proximity FROM estates")
def _(spark, sf):
    df = scoring.explained_building(estates(spark, sf), ["PROMO", "ECONOMY"])
    df = scoring.explained(df, "proximity", [scoring.Part("mobility", F.col("mobility"), 1.0, scoring.Range(0.0, 100.0))])
    return df.select("id", F.get("building_formula", 0).alias("building"), F.get("proximity_formula", 0).alias("proximity"))


# The driver-side layers, as rows

WHERE = "SELECT * FROM ESTATES WHERE surface_area >= 80 AND (energy_class IN ('A1', 'B') OR mobility > 5) AND haversine_km(latitude, longitude, 45.0, 7.6) <= 3"


@query("sql_conjuncts", rows_sql([("geo", "latitude,longitude"), ("predicate", "energy_class,mobility"), ("predicate", "surface_area")], "kind, columns"))
def _(spark, sf):
    rows = constraints.conjunct_rows(spark, WHERE)
    return spark.createDataFrame([(r["kind"], ",".join(r["columns"])) for r in rows], "kind string, columns string")


@query("sql_columns", rows_sql([("where", "energy_class,latitude,longitude,mobility,surface_area"), ("all", "energy_class,id,latitude,longitude,mobility,surface_area")], "part, columns"))
def _(spark, sf):
    sql = WHERE.replace("*", "id")
    return spark.createDataFrame([("where", ",".join(constraints.where_columns(spark, sql))), ("all", ",".join(constraints.referenced_columns(spark, sql)))], "part string, columns string")


@query("sql_repaired", f"{E} SELECT id FROM estates WHERE surface_area >= 200 AND property_type <> 'superficie'")
def _(spark, sf):
    df = estates(spark, sf)
    sql, renamed, missing = constraints.repair_columns(spark, "SELECT id FROM ESTATES WHERE superficie >= 200 AND tipologia_bene_immobile <> 'superficie'", df.columns)
    rows, error = engine.run_sql(spark, sql, df)
    if error or missing or len(renamed) != 2:
        raise ValueError(error or missing)
    return rows


SAID = ["SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "DROP TABLE x", "SELECT 1; DELETE FROM x", "SELECT 'DROP'"]


@query("sql_guard", rows_sql([(s, s in (SAID[0], SAID[1], SAID[4])) for s in SAID], "text, allowed"))
def _(spark, sf):
    return spark.createDataFrame([(s, engine.guard(s) is None) for s in SAID], "text string, allowed boolean")


@query("sql_cleaned", rows_sql([(1, "SELECT ';' AS a \nFROM t"), (2, "SELECT 'a'"), (3, "SELECT x FROM t")], "i, text"))
def _(spark, sf):
    texts = ["<think>select</think>```sql\nSELECT ';' AS a -- c\nFROM t; DROP x```", "SELECT 'a", "Sure: SELECT x FROM t /* why */"]
    return spark.createDataFrame([(i, engine.clean_sql(t)) for i, t in enumerate(texts, 1)], "i int, text string")


@query("sql_errors_routed", rows_sql([(True, "retry"), (True, "fallback"), (False, "relax"), (False, "fallback"), (False, "continue")], "failed, step"))
def _(spark, sf):
    _, error = engine.run_sql(spark, "SELECT * FROM ESTATES WHERE surfce = 1", estates(spark, sf))
    steps = [(error, 0, 0, 0), (error, 0, 3, 0), (None, 3, 0, 0), (None, 0, 0, 3), (None, 3, 0, 3)]
    return spark.createDataFrame([(e is not None, engine.route(e, *rest)) for e, *rest in steps], "failed boolean, step string")


SEVERITIES = [("regulatory", "surface_area", "hard", False), ("building", "property_type", "hard", False), ("building", "subalterno", "hard", False), ("building", "surface_area", "soft", True), ("energy", "energy_class", "soft", True), ("other", "x", "human_review", True)]


@query("constraint_severity", rows_sql(SEVERITIES, "source, name, severity, relaxable"))
def _(spark, sf):
    return spark.createDataFrame([(s, c, *constraints.severity(s, c)) for s, c, *_ in SEVERITIES], "source string, name string, severity string, relaxable boolean")


@query("constraints_or_hard", f"{E} SELECT id FROM estates WHERE property_type = 'ECONOMY'")
def _(spark, sf):
    """No row meets all constraints, so that the hard ones alone decide."""
    payloads = [{"source_agent": "building", "parsed": {"typologies": ["ECONOMY"], "requirements": [{"target_column": "superficie", "operator": ">=", "value": 1e9}]}}]
    rows, _ = engine.deterministic(estates(spark, sf), constraints.build("q", payloads))
    return rows.select("id")


@query("weights_redistributed", rows_sql([("building", 0.44), ("energy", 0.56), ("location", 0.0), ("proximity", 0.0), ("regulatory", 0.0)], "dimension, weight"))
def _(spark, sf):
    got = scoring.redistribute({"location": 0.3, "energy": 0.4, "building": 0.31}, ["energy", "building", "proximity"])
    return spark.createDataFrame(sorted(got.items()), "dimension string, weight double")
