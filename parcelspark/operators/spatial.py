"""Spatial joins without cross products: grid-cell radius join, nearest named place, point in polygon, amenity decay."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.functions.exprs import EARTH_KM, haversine_km, minutes
from parcelspark.operators.stats import percentile_rank

DECAY_KM = {"neighbourhood": 0.340, "district": 0.680, "city": 1.360}
URBAN = 1.5
REACH_KM = 5.0


def band_cells(band: Column, radius_km: float) -> Column:
    """The number of cells around the earth in a band of latitude: none is narrower than the longitudes between two points
    within the radius, of which one lies in the band and the other in it or the next; near a pole there is one."""
    half, tall = radius_km / EARTH_KM / 2, radius_km / EARTH_KM * 1.0001
    edge = F.least(F.greatest(F.abs((band - 1) * tall), F.abs((band + 2) * tall)), F.lit(math.pi / 2))
    ratio = F.lit(math.sin(min(half, math.pi / 2))) / F.greatest(F.cos(edge), F.lit(1e-12))
    return F.when(ratio >= 1, 1).otherwise(F.greatest(F.lit(1), F.floor(F.lit(math.pi) / F.asin(ratio) * (1 - 1e-9)))).cast("long")


def band_of(lat: Column, radius_km: float) -> Column:
    return F.floor(F.radians(lat) / (radius_km / EARTH_KM * 1.0001)).cast("long")


def cell_in(lon: Column, cells: Column) -> Column:
    return F.least(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * cells).cast("long"), cells - 1)


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, lat: str = "latitude", lon: str = "longitude", right_lat: str = "lat", right_lon: str = "lon") -> DataFrame:
    """Pairs within radius_km, with distance_km: right points are listed in the cells around them, in their own band of
    latitude and the next on both sides, then joined by cell, then tested. Each band has as many cells as fit its latitude,
    the last next to the first, so that it holds at poles and at the date line.

    The side that is listed nine times should be the smaller. A hot cell is a skewed join key, which AQE splits.
    """
    own = band_of(F.col(lat), radius_km)
    a = left.withColumn("__band", own).withColumn("__cell", cell_in(F.col(lon), band_cells(F.col("__band"), radius_km)))
    b = right.withColumn("__band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: band_of(F.col(right_lat), radius_km) + d)))
    b = b.withColumn("__cells", band_cells(F.col("__band"), radius_km))
    around = F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.pmod(cell_in(F.col(right_lon), F.col("__cells")) + d, F.col("__cells")))
    b = b.withColumn("__cell", F.explode(F.array_distinct(around))).drop("__cells")
    joined = a.join(b, ["__band", "__cell"]).withColumn("distance_km", haversine_km(F.col(lat), F.col(lon), F.col(right_lat), F.col(right_lon)))
    return joined.where(F.col("distance_km") <= radius_km).drop("__band", "__cell")


def radius_join_by_place(left: DataFrame, right: DataFrame, radius_km: float, digits: int | None = None, lat: str = "latitude", lon: str = "longitude", right_lat: str = "lat", right_lon: str = "lon") -> DataFrame:
    """radius_join, with distances rounded to some digits, for points that share their places: each pair of places is looked
    for and measured once, then given to the rows that lie there, the side listed first being the smaller. Where most points
    have a place of their own, which an estimate tells, rows are joined directly, as pairs of places would only be shuffled."""
    shown = lambda df: df.withColumn("distance_km", F.round("distance_km", digits)) if digits is not None else df
    rows = lambda df, y, x: df.agg(F.count("*"), F.approx_count_distinct(F.struct(y, x))).first()
    (n, n_places), (m, m_places) = rows(left, lat, lon), rows(right, right_lat, right_lon)
    if n * m < 4 * n_places * m_places:
        return shown(radius_join(left, right, radius_km, lat, lon, right_lat, right_lon))
    a = left.select(F.col(lat).alias("__lat"), F.col(lon).alias("__lon")).distinct()
    b = right.select(F.col(right_lat).alias("__right_lat"), F.col(right_lon).alias("__right_lon")).distinct()
    near = shown(radius_join(a, b, radius_km, "__lat", "__lon", "__right_lat", "__right_lon"))
    there = near.join(right, (F.col("__right_lat") == F.col(right_lat)) & (F.col("__right_lon") == F.col(right_lon))).drop("__right_lat", "__right_lon")
    # Small tables may come in one partition, also where the result is large.
    there = there.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = there.join(left, (F.col("__lat") == F.col(lat)) & (F.col("__lon") == F.col(lon)))
    return both.select(*left.columns, *right.columns, "distance_km")


@dataclass(frozen=True)
class Place:
    name: str
    lat: float
    lon: float
    radius_km: float = 3.0


def nearest_place(df: DataFrame, places: Sequence[Place], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """df with nearest_place, distance_km (2 decimals), walking and driving minutes; the earlier place wins ties.

    Places are literals, so the result is a projection. Rows without coordinates, or no places, get nulls.
    """
    if not places:
        return df.withColumns({"nearest_place": F.lit(None).cast("string"), "distance_km": F.lit(None).cast("double"), "walk_min": F.lit(None).cast("double"), "drive_min": F.lit(None).cast("double")})
    each = F.array(*[F.struct(haversine_km(F.col(lat), F.col(lon), p.lat, p.lon).alias("d"), F.lit(i).alias("i"), F.lit(p.name).alias("name")) for i, p in enumerate(places)])
    out = df.withColumn("__n", F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.array_min(each)))
    km = F.col("__n.d")
    return out.withColumns({"nearest_place": F.col("__n.name"), "distance_km": F.bround(km, 2), "walk_min": minutes(km, 12), "drive_min": minutes(km, 3)}).drop("__n")


def nearest_row(df: DataFrame, points: DataFrame, reach_km: float, key: str = "id", point_key: str = "poi_id", rings: int = 3, grows: float = 4.0) -> DataFrame:
    """(key, point, distance_km): the nearest point of a table within reach of each row, ties to the smaller point key.

    Places look around in growing rings: the first is reach / grows^(rings - 1), and a place that found a point there has
    its nearest one, so few meet the many points within the whole reach. Rows at one place share what it finds, and of the
    points at one place only that with the smallest key can be nearest. Points listed in cells are many times their table,
    by whose size Spark would broadcast them through the driver: rings and rows are joined by shuffles.
    """
    at = ["latitude", "longitude"]
    rest, found = df.select(*at).distinct(), []
    there = points.groupBy("lat", "lon").agg(F.min(point_key).alias(point_key))
    for i in range(rings):
        near = radius_join(rest, there.hint("shuffle_merge"), reach_km / grows ** (rings - 1 - i))
        best = near.groupBy(*at).agg(F.min(F.struct("distance_km", point_key)).alias("b"))
        found.append(best.select(*at, F.col(f"b.{point_key}").alias(point_key), F.col("b.distance_km").alias("distance_km")))
        rest = rest.join(best.select(*at).hint("shuffle_merge"), at, "left_anti")
    nearest = reduce(lambda a, b: a.unionByName(b), found)
    return df.select(key, *at).join(nearest.hint("shuffle_merge"), at).select(key, point_key, "distance_km")


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point lies in a ring of (lon, lat) structs, by crossings of a ray to the east."""
    n = F.size(ring)

    def crossing(acc: Column, k: Column) -> Column:
        p, q = F.get(ring, k), F.get(ring, (k + 1) % n)
        spans = (p["lat"] > lat) != (q["lat"] > lat)
        x = (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lon"]
        return acc != (spans & F.coalesce(lon < x, F.lit(False)))

    return (n >= 3) & F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crossing)


def zone_of(df: DataFrame, zones: DataFrame, cell_deg: float = 0.05, lat: str = "latitude", lon: str = "longitude", key: str = "id") -> DataFrame:
    """df with `zone`: the first (by zone_index) polygon that holds the point, null if none.

    zones: zone_index, zone, ring, and maybe holes (an array of rings). A polygon is listed under each grid cell of its box, points look up their own cell,
    then the ring is tested; so any number of zones joins by equality.
    """
    lons, lats = F.transform("ring", lambda p: p["lon"]), F.transform("ring", lambda p: p["lat"])
    span = lambda xs: F.sequence(F.floor(F.array_min(xs) / cell_deg), F.floor(F.array_max(xs) / cell_deg))
    zones = zones if "holes" in zones.columns else zones.withColumn("holes", F.array().cast("array<array<struct<lon:double,lat:double>>>"))
    listed = zones.where(F.size("ring") >= 3).select("zone_index", "zone", "ring", "holes", F.explode(span(lons)).alias("__x"), lats.alias("__lats"))
    listed = listed.select("zone_index", "zone", "ring", "holes", "__x", F.explode(span(F.col("__lats"))).alias("__y"))
    points = df.select(F.col(key).alias("__k"), F.col(lon).alias("__lon"), F.col(lat).alias("__lat"))
    points = points.withColumns({"__x": F.floor(F.col("__lon") / cell_deg), "__y": F.floor(F.col("__lat") / cell_deg)})
    inside = lambda ring: in_ring(F.col("__lon"), F.col("__lat"), ring)
    hit = points.join(listed, ["__x", "__y"]).where(inside(F.col("ring")) & ~F.coalesce(F.exists("holes", inside), F.lit(False)))
    first = hit.groupBy("__k").agg(F.min_by("zone", "zone_index").alias("zone"))
    return df.join(first, df[key] == F.col("__k"), "left").drop("__k")


def flatten_pois(tree: Column) -> Column:
    """(category, amenity, id, lat, lon) structs of a category -> amenity -> points map."""
    inner = lambda c: F.flatten(F.transform(F.map_entries(c["value"]), lambda a: F.transform(a["value"], lambda p: F.struct(c["key"].alias("category"), a["key"].alias("amenity"), p["id"].alias("id"), p["lat"].alias("lat"), p["lon"].alias("lon")))))
    return F.flatten(F.transform(F.map_entries(tree), inner))


def poi_tree(pois: DataFrame) -> DataFrame:
    """The other way: (category, tree), a category -> amenity -> points map of one category in each row, for JSON files."""
    points = pois.groupBy("category", "amenity").agg(F.array_sort(F.collect_list(F.struct("id", "lat", "lon"))).alias("points"))
    amenities = points.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("amenity", "points")))).alias("amenities"))
    return amenities.select("category", F.create_map("category", "amenities").alias("tree"))


def relocate(pois: DataFrame, category: str, amenity: str, to: str) -> DataFrame:
    """Points of one amenity moved to another category."""
    return pois.withColumn("category", F.when((F.col("category") == category) & (F.col("amenity") == amenity), F.lit(to)).otherwise(F.col("category")))


def osm_points(elements: DataFrame) -> DataFrame:
    """(type, id, lat, lon, tags) of nodes, ways and relations: a way lies at the mean of its nodes, a relation at that of
    its members (nodes and ways). elements: type, id, lat, lon, nodes, members (type, ref), tags."""
    nodes = elements.where("type = 'node'").select(F.col("id").alias("ref"), "lat", "lon")
    mean = [F.avg("lat").alias("lat"), F.avg("lon").alias("lon")]
    ways = elements.where("type = 'way'").select("id", F.explode(F.array_distinct("nodes")).alias("ref")).join(nodes, "ref").groupBy("id").agg(*mean)
    at = nodes.withColumn("kind", F.lit("node")).unionByName(ways.select(F.col("id").alias("ref"), "lat", "lon", F.lit("way").alias("kind")))
    member = elements.where("type = 'relation'").select("id", F.explode(F.array_distinct("members")).alias("m")).select("id", F.col("m.type").alias("kind"), F.col("m.ref").alias("ref"))
    relations = member.join(at, ["kind", "ref"]).groupBy("id").agg(*mean)
    tags = elements.select("type", "id", "tags")
    found = at.where("kind = 'node'").select(F.lit("node").alias("type"), F.col("ref").alias("id"), "lat", "lon")
    found = found.unionByName(ways.select(F.lit("way").alias("type"), "id", "lat", "lon")).unionByName(relations.select(F.lit("relation").alias("type"), "id", "lat", "lon"))
    return found.join(tags, ["type", "id"]).select("type", "id", F.bround("lat", 7).alias("lat"), F.bround("lon", 7).alias("lon"), "tags")


def inherited_category(members: DataFrame) -> DataFrame:
    """(parent, category): the members' category where all that have one agree. members: parent, category."""
    got = members.groupBy("parent").agg(F.min("category").alias("category"), F.max("category").alias("__other"))
    return got.where(F.col("category") == F.col("__other")).select("parent", "category")


#: Beyond so many of its lengths, cubed in the exponent, a decay is less than a double adds to 1.
DECAY_REACH = 37.0 ** (1 / 3)


def amenity_scores(estates: DataFrame, pois: DataFrame, amenity_class: Column, reach_km: float = REACH_KM) -> DataFrame:
    """(id, category, raw): decayed presence within reach, summed for each amenity, then averaged over all amenities of the
    category. Every estate has a row for every category, 0 where nothing is near or its place is unknown.

    pois: category, amenity, poi_id, lat, lon. amenity_class: a column over pois, neighbourhood, district or city. Points
    of one kind at one place are one with a number, and a kind is looked for only as far as its decay is not nothing.
    """
    scale = F.lit(DECAY_KM["city"])
    for name in ("district", "neighbourhood"):
        scale = F.when(amenity_class == name, F.lit(DECAY_KM[name])).otherwise(scale)
    size = pois.groupBy("category").agg(F.countDistinct("amenity").alias("__n"))
    places = pois.select("category", "lat", "lon", (scale * URBAN).alias("__s")).groupBy("category", "__s", "lat", "lon").agg(F.count("*").alias("__many"))
    located = estates.select("id", "latitude", "longitude").where("latitude is not null and longitude is not null")
    sums = []
    for km in DECAY_KM.values():
        near = radius_join(located, places.where(F.col("__s") == km * URBAN), min(reach_km, km * URBAN * DECAY_REACH))
        sums.append(near.select("id", "category", (F.col("__many") * F.exp(-F.pow(F.col("distance_km") / F.col("__s"), 3))).alias("__t")))
    total = reduce(lambda a, b: a.unionByName(b), sums).groupBy("id", "category").agg(F.sum("__t").alias("__t"))
    every = estates.select("id").join(F.broadcast(size))  # one row for each category
    return every.join(total, ["id", "category"], "left").select("id", "category", (F.coalesce("__t", F.lit(0.0)) / F.col("__n")).alias("raw"))


def amenity_percentiles(scores: DataFrame) -> DataFrame:
    """scores with the percentile of raw within its category."""
    return percentile_rank(scores, ["category"], "raw")


def marker_clusters(df: DataFrame, zoom: int, pixels: int = 75) -> DataFrame:
    """(cell_x, cell_y, n, lat, lon): markers by map tile cell of some pixels at a zoom level."""
    scale = 256 * 2.0**zoom / pixels
    x = (F.col("longitude") + 180) / 360
    s = F.sin(F.radians("latitude"))
    y = F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)
    cell = df.select(F.floor(x * scale).alias("cell_x"), F.floor(y * scale).alias("cell_y"), "latitude", "longitude")
    return cell.groupBy("cell_x", "cell_y").agg(F.count("*").alias("n"), F.avg("latitude").alias("lat"), F.avg("longitude").alias("lon"))
