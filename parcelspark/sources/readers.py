"""Readers: estates tables, delimited text, certificates in XML, POI and zone files, stored results, regional extracts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelspark.functions import exprs as X
from parcelspark.operators.filters import newest_first
from parcelspark.operators.finalise import add_columns
from parcelspark.operators.spatial import flatten_pois
from parcelspark.sources.certificates import wrapped


def estates(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with id as text."""
    return spark.read.parquet(path).withColumn("id", F.col("id").cast("string"))


def semicolon_csv(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """A ;-separated file with header; lines that don't parse are skipped, a file that isn't there is None."""
    try:
        r = spark.read.option("sep", ";").option("header", True).option("mode", "DROPMALFORMED").option("encoding", "UTF-8")
        df = (r.schema(schema) if schema else r).csv(path)
        return df.withColumn("id", F.col("id").cast("string")) if "id" in df.columns else df
    except PySparkException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def sniffed_csv(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file: comma, or semicolon where the header has none."""
    head = spark.read.text(path).first()
    sep = "," if head and "," in head[0] and head[0].count(",") >= head[0].count(";") else ";"
    return spark.read.option("sep", sep).option("header", True).csv(path)


def csv_after_preamble(spark: SparkSession, path: str, skip: int = 2, sep: str = ",") -> DataFrame:
    """A small delimited file whose first lines are no data: of each file the first `skip` lines go, the next is the header."""
    every = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    lines = every.where((F.col("at") >= skip) & (F.trim("line") != "")).select("line")
    header = every.where(F.col("at") == skip).select("line").first()[0]
    names = [c.strip().strip('"') for c in header.split(sep)]
    ddl = ", ".join(f"`{n}` string" for n in names)
    rows = lines.where(F.col("line") != header).select(F.from_csv("line", ddl, {"sep": sep}).alias("r"))
    return rows.select("r.*").where(F.size(F.array_compact(F.array(*[f"`{n}`" for n in names]))) > 0)


def stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations (name, line, latitude, longitude); empty where the file is missing."""
    got = semicolon_csv(spark, path)
    return got if got is not None else spark.createDataFrame([], "name string, line string, latitude double, longitude double")


def schema_of(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)


# Certificates

ILLEGAL = r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]"


def decoded(content: Column) -> Column:
    """Text of XML bytes: UTF-16 by its mark, else UTF-8 where it is valid, else Latin-1; junk before the document and characters that XML forbids go."""
    start = F.hex(F.substring(content, 1, 2))
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = F.when(start.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(F.coalesce(utf8, F.decode(content, "ISO-8859-1")))
    return F.regexp_replace(F.regexp_replace(text, r"^[^<]*(?=<)", ""), ILLEGAL, "")


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, xml) of a folder of certificates."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", True).load(path)
    return df.select(X.file_name(F.col("path")).alias("file"), decoded(F.col("content")).alias("xml"))


def image_of(xml: Column, least: int = 100) -> Column:
    """(mime, data) of the first text long enough to be an encoded image; null also where the document isn't well-formed."""
    texts = F.filter(F.xpath(F.coalesce(wrapped(xml), F.lit("<certificate/>")), F.lit("//*/text()")), lambda t: (F.length(t) > least) & t.rlike(r"^[A-Za-z0-9+/=\s]+$"))
    data = F.try_element_at(texts, F.lit(1))
    return F.when(data.isNotNull(), F.struct(X.mime_of_base64(data).alias("mime"), data.alias("data")))


# POIs, zones, places


# Names of POI categories and what they are here.
CATEGORY_NAMES = {
    "sanità": "healthcare", "sanita": "healthcare", "healthcare": "healthcare", "mobilità": "mobility", "mobilita": "mobility", "mobility": "mobility", "verde": "green", "green": "green",
    "sport": "sport", "commerciale": "commercial", "commercial": "commercial", "educazione": "education", "education": "education",
}
# Amenities of the shortest reach, and of the middle one; all others have the longest.
NEIGHBOURHOOD = (
    "pharmacy defibrillator bus_stop tram_stop bicycle_parking taxi subway_entrance charging_station playground garden grass park fitness_centre pitch supermarket bakery greengrocer newsagent kiosk "
    "convenience tobacco laundry hairdresser butcher pastry ice_cream deli stationery grocery vending_machine kindergarten school community_centre"
).split()
DISTRICT = (
    "doctor dentist clinic physiotherapist veterinary optometrist psychotherapist physiotherapist-osteopathy alternative parking bicycle_rental car_sharing recreation_ground scrub swimming_pool "
    "sports_centre bowling_alley clothes shoes florist hardware chemist pet books gift optician beauty mobile_phone jewelry toys electronics bicycle travel_agency dry_cleaning photo video confectionery "
    "alcohol wine cheese dairy seafood pasta spices tea coffee coffee_roasting herbalist tattoo massage spa copyshop shoe_repair tailor sewing fabric bag fashion_accessories cosmetics variety_store "
    "second_hand video_games sports nutrition_supplements perfumery watches baby_goods houseware repair mobile_phone_accessories party religion locksmith art frame ticket food general pet_grooming "
    "library music_school driving_school"
).split()


def amenity_class(amenity: Column) -> Column:
    """neighbourhood, district or city: how far people go for an amenity."""
    return F.when(amenity.isin(NEIGHBOURHOOD), "neighbourhood").when(amenity.isin(DISTRICT), "district").otherwise("city")


def pois(spark: SparkSession, path: str) -> DataFrame:
    """(category, amenity, id, lat, lon, reach) of a nested JSON file, categories by their names here."""
    shape = "map<string, map<string, array<struct<id: bigint, lat: double, lon: double>>>>"
    text = spark.read.text(path, wholetext=True)
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_NAMES.items() for x in kv])
    rows = text.select(F.explode(flatten_pois(F.from_json("value", shape))).alias("p"))
    return rows.select(F.coalesce(F.try_element_at(names, F.lower(F.trim("p.category"))), F.lower(F.trim("p.category"))).alias("category"), "p.amenity", "p.id", "p.lat", "p.lon", amenity_class(F.col("p.amenity")).alias("reach"))


#: Reference systems of GeoJSON files: degrees, by any of their names, and the map projection in metres.
DEGREES, METRES = re.compile(r"CRS84|EPSG:+4326$"), re.compile(r"EPSG:+(?:3857|900913)$")


def zones(spark: SparkSession, path: str, name: str = "zone") -> DataFrame:
    """(zone_index, zone, ring, holes) of the polygons of a GeoJSON file in degrees, one row for each part of a multipolygon.
    A file in map metres (EPSG 3857) is turned into degrees; one in another reference system is refused."""
    shape = "crs struct<properties: struct<name: string>>, features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("g"))
    systems = [r[0] for r in text.select("g.crs.properties.name").distinct().limit(2).collect()]
    if len(systems) > 1 or (systems and systems[0] and not DEGREES.search(systems[0]) and not METRES.search(systems[0])):
        raise ValueError(f"reference system {systems} isn't supported")
    metres = bool(systems and systems[0] and METRES.search(systems[0]))
    f = text.select(F.posexplode("g.features").alias("zone_index", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    parts = F.when(kind == "Polygon", F.array(F.from_json(raw, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(raw, "array<array<array<array<double>>>>"))
    f = f.select("zone_index", F.element_at("f.properties", name).alias("zone"), F.explode(parts).alias("rings"))
    half = 20037508.342789244  # half of the earth's circumference in metres

    def point(p: Column) -> Column:
        x, y = F.get(p, 0), F.get(p, 1)
        if metres:
            x, y = x / half * 180, F.degrees(2 * F.atan(F.exp(y / half * F.lit(3.141592653589793))) - F.lit(1.5707963267948966))
        return F.struct(x.alias("lon"), y.alias("lat"))

    rings = F.transform("rings", lambda r: F.transform(r, point))
    return f.select("zone_index", "zone", rings.alias("r")).select("zone_index", "zone", F.get("r", 0).alias("ring"), F.slice("r", 2, F.greatest(F.size("r") - 1, F.lit(0))).alias("holes"))


# The stored tables of users, runs and feedback.
STORED = {
    "users": "user_id long, username string, email string, created_at timestamp",
    "runs": "run_id string, user_id long, query string, status string, created_at timestamp, results_count int, final_sql string",
    "feedback": "feedback_id long, run_id string, agent_name string, building_id string, rating int, comment string, user_id long, created_at timestamp",
}


def stored(spark: SparkSession, source: str, name: str, partitions: int = 8) -> DataFrame:
    """A stored table of a folder of Parquet tables or of a database (a jdbc: address), with columns that an older store lacks
    as null. A table that isn't there is empty. From a database it is read in parts by its first column, if that is a number."""
    ddl = [c.strip().split(" ") for c in STORED[name].split(",")]
    if source.startswith("jdbc:"):
        key, kind = ddl[0]
        bounds = spark.read.jdbc(source, f"(SELECT min({key}) AS lo, max({key}) AS hi FROM {name}) b").first() if kind == "long" else None
        split = {"column": key, "lowerBound": bounds["lo"], "upperBound": bounds["hi"] + 1, "numPartitions": partitions} if bounds and bounds["lo"] is not None else {}
        df = spark.read.jdbc(source, name, **split)
    else:
        try:
            df = spark.read.parquet(f"{source}/{name}.parquet")
        except PySparkException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], STORED[name])
    return add_columns(df, dict(ddl))


def gazetteer(df: DataFrame) -> DataFrame:
    """(street, house_number, city, lon, lat) in lower case of tagged nodes; those without a street go."""
    tag = lambda k: F.lower(F.trim(F.try_element_at("tags", F.lit(k))))
    return df.select(tag("addr:street").alias("street"), tag("addr:housenumber").alias("house_number"), tag("addr:city").alias("city"), "lon", "lat").where("street is not null")


def landmarks_in(names: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(name, landmark, lat, lon): the longest landmark whose words the cleaned name contains, joined by its first word."""
    n = names.select("name", F.lower(X.place_name(F.col("name"))).alias("__n")).withColumn("__w", F.explode(F.array_distinct(F.split("__n", r"\s+"))))
    k = landmarks.select(F.lower("landmark").alias("__l"), "landmark", "lat", "lon").withColumn("__w", F.element_at(F.split("__l", r"\s+"), 1))
    hit = n.join(k, "__w").where(F.contains("__n", "__l"))
    best = hit.groupBy("name").agg(F.max(F.struct(F.length("__l").alias("z"), "landmark", "lat", "lon")).alias("m"))
    return best.select("name", "m.landmark", "m.lat", "m.lon")


def address_matches(addresses: DataFrame, gaz: DataFrame, key: str = "id") -> DataFrame:
    """(id, street, house_number, lat, lon, score) of the best gazetteer entry for each (id, street, number, city) row.

    Candidates hold the cleaned street, or else what follows its first word, and the city. Rather than test each pair,
    entries are listed under every word of their street and addresses under their rarest one (the longest), so all
    entries that hold the text meet it. Scores: city 100; street 150, or 50 if one holds the other; number 300, 150
    for a prefix, -100 for another. Ties to the smallest entry, so of entries alike in street, number and city only the
    smallest is listed.
    """
    a = addresses.select(F.col(key).alias("__id"), X.clean_street(F.col("street")).alias("s"), X.house_number(F.col("street"), F.col("number")).alias("n"), F.lower(F.trim("city")).alias("c"))
    a = a.where(F.length("s") >= 3)
    short = F.regexp_replace("s", r"^\S+\s+", "")
    tries = F.array_distinct(F.array(F.struct(F.lit(0).alias("t"), F.col("s").alias("find")), F.struct(F.lit(1).alias("t"), short.alias("find"))))
    a = a.withColumn("__t", F.explode(tries)).select("*", "__t.t", "__t.find").drop("__t")
    # The middle words of the text must be whole words of the street; its first and last may be parts of one, so a text
    # of up to two words is looked up by the first three letters of its longer word, at any place of the street.
    longest = lambda ws: F.array_max(F.transform(ws, lambda w: F.struct(F.length(w).alias("z"), w.alias("w"))))["w"]
    words = F.split("find", r"\s+")
    a = a.withColumn("__w", F.when(F.size(words) > 2, longest(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))).otherwise(F.substring(longest(words), 1, 3)))
    a = a.where(F.length("find") >= 3)
    parts = F.split("street", r"\s+")
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("street") - 2, F.lit(1))), lambda i: F.substring(F.col("street"), i, F.lit(3)))
    gaz = gaz.groupBy("street", "house_number", F.col("city").alias("gc")).agg(F.min(F.struct("lat", "lon")).alias("__at"))
    g = gaz.select("street", "house_number", "gc", "__at.lat", "__at.lon", F.explode(F.array_distinct(F.concat(parts, threes))).alias("__w"))
    hit = a.join(g, "__w").where(F.contains("street", "find") & (F.col("c").isNull() | F.contains("gc", "c")))
    street = F.when(F.col("s") == F.col("street"), 150).when(F.contains("street", "s") | F.contains("s", "street"), 50).otherwise(0)
    bare = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    own, theirs = bare(F.col("n")), F.lower(F.coalesce("house_number", F.lit("")))
    prefix = F.startswith(theirs, own) & ~F.substring(theirs, F.length(own) + 1, F.lit(1)).rlike("[0-9]")
    number = F.when(F.col("n").isNull(), 0).when(own == bare(theirs), 300).when((theirs != "") & prefix, 150).when(theirs != "", -100).otherwise(0)
    scored = hit.withColumn("score", F.when(F.col("c") == F.col("gc"), 100).otherwise(0) + street + number)
    pick = F.struct("t", (-F.col("score")).alias("minus"), "street", "house_number", "lat", "lon")
    best = scored.groupBy("__id").agg(F.min(pick).alias("m"))
    return best.select(F.col("__id").alias(key), "m.street", "m.house_number", "m.lat", "m.lon", (-F.col("m.minus")).alias("score"))


def apply_geocode(df: DataFrame, found: DataFrame, key: str = "id", least: int = 100) -> DataFrame:
    """df with coordinates replaced where the match scores enough, or where it has none."""
    f = found.select(F.col(key).alias("__k"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"), F.col("score").alias("__sc"))
    use = (F.col("__sc") >= least) | F.col("latitude").isNull() | F.col("longitude").isNull()
    out = df.join(f, df[key] == F.col("__k"), "left")
    new = lambda c, n: F.when(F.col("__k").isNotNull() & use, F.col(n)).otherwise(F.col(c))
    return out.withColumns({"latitude": new("latitude", "__lat"), "longitude": new("longitude", "__lon")}).drop("__k", "__lat", "__lon", "__sc")


def population(df: DataFrame, zone: str) -> DataFrame:
    """(zone, ages map) of a table with a column per age band; total and unlocated rows go."""
    bands = [c for c in df.columns if "-" in c or "+" in c]
    rows = df.where(~F.col(zone).rlike("(?i)totale|non localizzato"))
    ages = F.map_from_arrays(F.array(*[F.lit(b) for b in bands]), F.array(*[X.number(F.col(f"`{b}`"), 0.0) for b in bands]))
    return rows.select(F.lower(F.trim(F.col(zone))).alias("zone"), ages.alias("ages"))


# Regional extracts and samples

REGIONS: dict[str, Callable[[], Column]] = {
    "amsterdam": lambda: F.substring("postcode", 1, 4).try_cast("int").between(1000, 1109),
    "residential": lambda: F.lower(F.trim(F.col("usage"))).isin("residential", "woonfunctie"),
    "dublin": lambda: F.trim(F.col("county")).rlike(r"^Dublin\s+\d+W?$|^Co\. Dublin$"),
    "london": lambda: F.upper(F.trim(F.col("posttown"))) == "LONDON",
    "liege": lambda: F.upper(F.trim(F.col("commune"))).isin("LIEGE", "LIÈGE"),
}


def regional(df: DataFrame, region: str) -> DataFrame:
    return df.where(REGIONS[region]())


def sample(df: DataFrame, key: str, k: int = 150_000, seed: int = 42) -> DataFrame:
    """A uniform sample of k rows that is the same on each run: the smallest seeded hashes, ties by key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)


# Stored runs


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents query_*.json with their file name; trial files (_tr) are left out."""
    df = spark.read.option("multiLine", True).option("pathGlobFilter", "query_*.json").json(path)
    return df.withColumn("file", X.file_name(F.input_file_name())).where(~F.col("file").contains("_tr"))


def demo_rows(spark: SparkSession, folder: str, n: int = 50) -> DataFrame:
    """Rows of a stored demo with id and coordinates, at most n (1 to 200), with the demo's query and, from the first place
    of its metadata, the city; without metadata the query is the folder's name."""
    df = semicolon_csv(spark, f"{folder}/results.csv")
    got = df.where((F.col("id") != "") & X.number(F.col("latitude")).isNotNull() & X.number(F.col("longitude")).isNotNull())
    name = f"Demo: {folder.rstrip('/').rsplit('/', 1)[-1]}"
    meta = demo_metadata(spark, folder)
    query = meta["query"] if meta and meta["query"] else name
    place = meta["place"] if meta else None
    city = place.rsplit(",", 1)[-1].strip() if place and "," in place else None
    return got.orderBy("id").limit(min(max(n, 1), 200)).withColumns({"demo_query": F.lit(query), "demo_city": F.lit(city).cast("string")})


def demo_metadata(spark: SparkSession, folder: str) -> dict | None:
    """query, timestamp, results_count and the first place of a demo; None without a file that can be read."""
    shape = "query string, timestamp string, results_count int, location_data array<array<string>>"
    try:
        row = spark.read.text(f"{folder}/metadata.json", wholetext=True).select(F.from_json("value", shape).alias("m")).select("m.query", "m.timestamp", "m.results_count", F.get(F.get("m.location_data", 0), 0).alias("place")).first()
    except PySparkException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return row.asDict() if row else None


def demos(spark: SparkSession, folder: str) -> DataFrame:
    """(demo_id, query, timestamp, results_count) of the folders that hold metadata, the newest first, those without a time last."""
    shape = "query string, timestamp string, results_count int"
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").text(folder, wholetext=True)
    rows = rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/metadata\.json$", 1).alias("demo_id"), F.from_json("value", shape).alias("m"))
    return newest_first(rows.select("demo_id", "m.*"), "timestamp", "demo_id")


def rule_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): texts as they are, other files as base64."""
    df = spark.read.format("binaryFile").load(path).select(X.file_name(F.col("path")).alias("file"), "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return df.select("file", F.coalesce(text, F.base64("content")).alias("text"))


def metro_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, position, name) of a folder with a CSV per line, in file order."""
    whole = spark.read.text(path, wholetext=True).select(X.file_name(F.input_file_name()).alias("f"), F.posexplode(F.split("value", r"\r?\n")).alias("position", "row"))
    return whole.where("position > 0 and trim(row) <> ''").select(F.regexp_replace("f", r"\.csv$", "").alias("line"), "position", F.trim(F.element_at(F.split("row", "[;,]"), 1)).alias("name"))


def trace_payloads(trace: DataFrame) -> DataFrame:
    """(run, agent, output): the first non-null output of each agent of a stored trace (run, position, agent, output)."""
    return trace.where("output is not null").groupBy("run", "agent").agg(F.min_by("output", "position").alias("output"))
