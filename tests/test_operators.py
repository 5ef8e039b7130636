"""Scorers, spatial joins, roll-ups, sources, sinks, metrics and streams on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import exprs as X
from parcelspark.operators import filters, finalise, metrics, rollup, scoring, spatial, stats
from parcelspark.sources import certificates, readers, sinks
from parcelspark.streaming import events


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


@pytest.mark.parametrize(
    ("v", "t", "op", "x", "want"),
    [(200, 100, ">=", False, 100), (100, 100, ">=", False, 50), (100, 100, ">=", True, 0), (100, 100, ">", False, 0), (99, 100, ">=", False, 0), (150, 100, ">=", False, 75), (50, 100, "<=", False, 100), (100, 100, "<=", False, 50), (100, 100, "<", False, 0), (101, 100, "<=", False, 0), (75, 100, "<=", False, 75), (0, 0, ">=", False, 100), (0, 0, ">", False, 0), (1, 0, ">", False, 100), (0, 0, "<=", False, 100), (1, 0, "<=", False, 0), (5, 5, "==", False, 100), (4, 5, "=", False, 0), (None, 5, ">=", False, 0), (3, None, ">=", False, 0)],
)
def test_continuous(spark, v, t, op, x, want):
    df = spark.createDataFrame([(v,)], "v double" if not isinstance(v, int) else "v long")
    assert values(df, X.continuous_score(F.col("v"), t, op, x)) == [want]


def test_discrete(spark):
    df = spark.createDataFrame([("Office",), ("office space",), ("HOME",), ("barn",), ("",), (None,)], "v string")
    assert values(df, X.discrete_score(F.col("v"), ["'office'", "shop", "home"])) == [100, 100, 50, 0, 0, 0]
    assert values(df, X.discrete_score(F.col("v"), [])) == [0] * 6
    assert values(df, X.discrete_score(F.col("v"), ["home"]))[2] == 100


def test_norm_cdf(spark):
    df = spark.createDataFrame([(-3.0,), (-0.5,), (0.0,), (1.96,)], "z double")
    for z, got in df.select("z", X.norm_cdf(F.col("z"))).collect():
        assert abs(got - 0.5 * math.erfc(-z / math.sqrt(2))) < 2e-7


def test_numbers_and_dates(spark):
    df = spark.createDataFrame([("1,5",), (" 2.5 ",), ("x",), (None,), ("NaN",)], "v string")
    assert values(df, X.number(F.col("v"))) == [1.5, 2.5, None, None, None]
    assert values(df, X.whole(F.col("v"))) == [1, 2, 0, 0, 0]
    d = spark.createDataFrame([("31/12/2020",), ("2020-01-02",), ("no",)], "v string")
    assert [str(v)[:10] for v in values(d, X.day_first(F.col("v")))] == ["2020-12-31", "2020-01-02", "None"]


def test_addresses(spark):
    df = spark.createDataFrame([("10128 TORINO - C.so Trapani, 133",), ("V.IA Roma 10 bis",), ("P.ZZA Castello",), ("12 : via po TORINO",)], "v string")
    assert values(df, X.clean_street(F.col("v"))) == ["corso trapani", "via roma", "piazza castello", "via po"]
    assert values(df, X.house_number(F.col("v")))[:3] == ["133", "10 bis", None]
    assert values(df, X.house_number(F.col("v"), F.lit("snc")))[0] == "133"
    t = spark.createDataFrame([("Foglio 12 particella 34, sub 5",), ("F 12 P 345 S 6",), ("n. 12/345/6",), ("7 - 8 - 9 and f1 p2 s3",), ("F1 P2 S3 but 12/345/6",), ("none",)], "v string")
    assert values(t, X.cadastral_id(F.col("v"))) == ["12/34/5", "12/345/6", "12/345/6", "1/2/3", "1/2/3", None]
    names = {"Vicino al Mole": "l mole", "in zona Crocetta": "crocetta", "area di San Salvario": "san salvario", "davanti a l'università": "università", "fronte la stazione": "stazione", "distretto di  Nord": "nord", "intorno a il parco": "parco", "presso Politecnico": "politecnico", " Near the Mole ": "near the mole", "nei pressi di di qua": "qua"}
    p = spark.createDataFrame([(k,) for k in names], "v string").coalesce(1)
    assert values(p, X.place_name(F.col("v"))) == list(names.values())
    texts = [(None, "costo; 12,5 anni di ritorno"), ("7", "3 anni payback"), (None, "nulla"), (None, "10 anno ritorno e 3 anni di ritorno")]
    assert values(spark.createDataFrame(texts, "g string, t string").coalesce(1), X.payback_years(F.col("g"), F.col("t"))) == ["12.5", "7", None, "10"]
    lists = [("Isolamento tetto;\nnuova caldaia • infissi - ok - pannelli",), ("a;bb;.",), (None,)]
    assert values(spark.createDataFrame(lists, "t string").coalesce(1), X.interventions(F.col("t"))) == [["Isolamento tetto", "nuova caldaia", "infissi"], [], []]


def test_within_box_matches_distance(spark):
    df = spark.range(400).select((F.col("id") / 20 + 40).alias("a"), (F.col("id") % 20 + 0.5).alias("b"))
    near = df.where(X.within_km(F.col("a"), F.col("b"), 47.0, 9.0, 300.0)).count()
    assert near == df.where(X.haversine_km(F.col("a"), F.col("b"), 47.0, 9.0) <= 300).count() > 0
    assert df.where(X.within_km(F.col("a"), F.col("b"), 89.9, 0.0, 5000.0)).count() == df.where(X.haversine_km(F.col("a"), F.col("b"), 89.9, 0.0) <= 5000).count()


def test_location_score(spark):
    df = spark.createDataFrame([("a", 45.0, 7.6), ("b", None, None), ("c", 46.0, 9.0)], "id string, latitude double, longitude double")
    got = {r.id: r for r in scoring.location_score(df, [spatial.Place("x", 45.0, 7.6, 0.0), spatial.Place("y", 45.0, 7.6)]).collect()}
    assert got["a"].location_score == 100 and got["a"].nearest_place == "x" and got["b"].location_score == 0 == got["c"].location_score
    assert spatial.nearest_place(df, []).where("nearest_place is null").count() == 3


def test_scores_without_needs(spark):
    df = spark.createDataFrame([("a", 4, "A1"), ("b", 20, "G")], "id string, energy_score_total int, energy_class string")
    s = scoring.ranges(df, ["energy_score_total"])
    assert values(scoring.energy_score(df, (), s), "energy_score") == [0, 100]
    assert values(scoring.energy_score(df, [scoring.Need("absent", ">=", 1)]), "energy_score") == [0, 0]
    assert values(scoring.building_score(df), "building_score") == [100, 100]
    assert values(scoring.building_score(df, [], [scoring.Need("absent", ">=", 1)]), "building_score") == [0, 0]
    assert scoring.class_targets(">=", "A2") == ["A4", "A3", "A2"] and scoring.class_targets("<=", "F") == ["F", "G"]
    assert values(scoring.regulatory_score(df, [scoring.Need("energy_score_total", "==", 4)]), "regulatory_score") == [100, 0]


def test_weights():
    w = scoring.weights_of_ranks([("poi", 1), ("APE", 2), ("unknown", 1), ("geo", 3)])
    assert w == {"location": 0.18, "regulatory": 0.0, "energy": 0.27, "building": 0.0, "proximity": 0.55}
    assert scoring.weights_of_ranks([]) == dict.fromkeys(w, 0.2)
    assert scoring.redistribute(w, ["energy", "location"]) == {"location": 0.4, "regulatory": 0.0, "energy": 0.6, "building": 0.0, "proximity": 0.0}
    assert sum(scoring.settle({"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).values()) == 1


def test_proximity_repeats_first(spark):
    df = spark.createDataFrame([("a", 80.0)], "id string, mobility double")
    needs = [scoring.Need("mobility", ">=", 40), scoring.Need("mobility", ">=", 400)]
    assert values(scoring.proximity_score(df, needs), "proximity_score") == [100]


def great_circle(x, y):
    p, q = math.radians(x[0]), math.radians(y[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y[1] - x[1]) / 2) ** 2
    return 12742 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize(("lat", "lon", "km"), [((44, 46), (7, 9), 20.0), ((65.5, 66.5), (20, 21), 2.0), ((-90, -88), (-180, 180), 60.0), ((88, 90), (-180, 180), 90.0), ((-1, 1), (179, 181), 15.0), ((50, 90), (-180, 180), 1500.0), ((-90, 90), (-180, 180), 9000.0)])
def test_radius_join_against_all_pairs(spark, lat, lon, km):
    """Every pair, also by the poles, over the date line and for radii of a third of the earth; and the nearest of each."""
    rng = random.Random(7)
    place = lambda: (rng.uniform(*lat), (rng.uniform(*lon) + 180) % 360 - 180)
    pts, others = {str(i): place() for i in range(70)}, {i: place() for i in range(70)}
    a = spark.createDataFrame([(k, *v) for k, v in pts.items()], "id string, latitude double, longitude double")
    b = spark.createDataFrame([(k, *v) for k, v in others.items()], "poi_id int, lat double, lon double")
    want = {(i, j) for i, x in pts.items() for j, y in others.items() if great_circle(x, y) <= km}
    rows = [(r.id, r.poi_id) for r in spatial.radius_join(a, b, km).collect()]
    assert len(rows) == len(want) and set(rows) == want and want
    near = {i: min((great_circle(x, y), j) for j, y in others.items()) for i, x in pts.items()}
    assert {(r.id, r.poi_id) for r in spatial.nearest_row(a, b, km).collect()} == {(i, j) for i, (d, j) in near.items() if d <= km}


def test_ranks_and_quantiles(spark):
    """Mean ranks and quantiles of groups against sorting them, with ties, nulls, a null group and one of a single row."""
    rng = random.Random(3)
    rows = [(g, float(rng.randint(0, 40)) if rng.random() > 0.1 else None, i) for i, g in enumerate(rng.choices(["a", "b", None], [6, 3, 1], k=400))] + [("one", 5.0, 999), ("none", None, 998)]
    df = spark.createDataFrame(rows, "g string, v double, i int").repartition(5)
    got = {r.i: r.rank for r in stats.with_mean_rank(df, ["g"], "v").collect()}
    pct = {r.i: r.percentile for r in stats.percentile_rank(df, ["g"], "v").collect()}
    q = {r.g: (r.low, r.mid, r.odd) for r in stats.quantiles(df, ["g"], "v", {"low": 0.25, "mid": 0.5, "odd": 0.37}).collect()}
    for g in ("a", "b", None, "one", "none"):
        own = sorted(v for h, v, _ in rows if h == g and v is not None)
        for h, v, i in rows:
            if h == g:
                rank = None if v is None else sum(x < v for x in own) + (own.count(v) + 1) / 2
                assert got[i] == rank and pct[i] == (None if v is None else pytest.approx(100 * rank / len(own), abs=0.0051))
        if own:
            at = lambda p, s=own: s[int(p * (len(s) - 1))] + (s[min(len(s) - 1, int(p * (len(s) - 1)) + 1)] - s[int(p * (len(s) - 1))]) * (p * (len(s) - 1) % 1)
            assert q[g] == pytest.approx((at(0.25), at(0.5), at(0.37)))
    assert set(q) == {"a", "b", None, "one"}
    assert stats.quantiles(df, [], "v", {"m": 0.5}).first().m == sorted(v for _, v, _ in rows if v is not None)[len([v for _, v, _ in rows if v is not None]) // 2]
    assert stats.value_counts(df.limit(0), ["g"], "v").count() == 0


def test_energy_points_of_every_kind(spark):
    """Yes may be a word, a truth value or a number."""
    base = spark.createDataFrame([("Heat pump", "Good", "A1")], "plant string, envelope string, energy_class string")
    for value, points in ((F.lit("Yes"), 5), (F.lit("no"), 1), (F.lit(True), 5), (F.lit(False), 1), (F.lit(1), 5), (F.lit(1.0), 5), (F.lit(2), 1), (F.lit(None).cast("string"), 1), (F.lit("True"), 1)):
        r = rollup.energy_points(base.withColumn("sun", value), "plant", "envelope", "sun").first()
        assert (r.energy_score_renewables, r.energy_score_total) == (points, 15 + points)


def test_running_numbers(spark):
    """Numbers run on over groups, blocks of groups, and missing group numbers."""
    rows = [(g, k) for g in (0, 1, 2, 5, 9, 10, 11, 30, -3) for k in range(abs(g) % 4 + 1)]
    got = rollup.running_number(spark.createDataFrame(rows, "g int, k int").repartition(4), ["g", "k"], "n", "g", block=4).orderBy("n").collect()
    assert [(r.g, r.k) for r in got] == sorted(rows) and [r.n for r in got] == list(range(1, len(rows) + 1))


def test_rollup_of_other_columns(spark):
    ddl = "id string, cadastral_sheet int, cadastral_parcel int, surface_area double, construction_period string, energy_score_plant int, energy_score_envelope int, energy_score_renewables int, latitude double, longitude double, property_type string, energy_class string, files array<string>, kwh double, carrier string"
    rows = [("a", 1, 1, 10.0, "p", 1, 1, 1, 45.0, 7.0, "x", "A1", ["f2", "f1"], 9.0, "gas"), ("b", 1, 1, 30.0, "p", 3, 5, 1, 45.0, 7.0, "y", "B", ["f1", "f3"], 7.0, "oil"), ("c", 1, 1, 5.0, "q", 1, 1, 5, 45.0, 7.0, "x", "B", None, None, "gas")]
    r = rollup.rollup_entities(spark.createDataFrame(rows, ddl), "files", ("kwh",), ("carrier",)).first()
    assert (r.id, r.cadastral_units_count, r.surface_area, r.property_type, r.energy_class, r.construction_period) == ("M00001", 3, 45.0, "y", "B", "p")
    assert (r.files, r.kwh, r.carrier, r.energy_score_total) == (["f1", "f2", "f3"], 7.0, "gas", 3 + 5 + 5 + 3)


def test_osm_and_trees(spark):
    ddl = "type string, id long, lat double, lon double, nodes array<long>, members array<struct<type:string,ref:long>>, tags map<string,string>"
    rows = [("node", 1, 1.0, 1.0, None, None, {}), ("node", 2, 3.0, 3.0, None, None, {}), ("way", 9, None, None, [1, 2, 1], None, {}), ("relation", 7, None, None, None, [("way", 9), ("node", 2)], {})]
    got = {(r.type, r.id): (r.lat, r.lon) for r in spatial.osm_points(spark.createDataFrame(rows, ddl)).collect()}
    assert got["way", 9] == (2, 2) and got["relation", 7] == (2.5, 2.5)
    m = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "parent int, category string")
    assert [tuple(r) for r in spatial.inherited_category(m).collect()] == [(1, "a")]


def test_files(spark, tmp_path):
    (tmp_path / "pois.json").write_text('{"Green ": {"park": [{"id": 1, "lat": 45.0, "lon": 7.0}]}}')
    p = readers.pois(spark, str(tmp_path / "pois.json"))
    assert [tuple(r) for r in p.collect()] == [("green", "park", 1, 45.0, 7.0, "neighbourhood")]
    sinks.pois_json(p, str(tmp_path / "out"))
    assert readers.pois(spark, str(tmp_path / "out")).count() == 1
    (tmp_path / "z.geojson").write_text('{"features": [{"properties": {"zone": "Z"}, "geometry": {"type": "Polygon", "coordinates": [[[7, 45], [8, 45], [8, 46], [7, 46]]]}}]}')
    df = spark.createDataFrame([("a", 45.5, 7.5), ("b", 44.0, 7.5)], "id string, latitude double, longitude double")
    assert {r.id: r.zone for r in spatial.zone_of(df, readers.zones(spark, str(tmp_path / "z.geojson"))).collect()} == {"a": "Z", "b": None}
    (tmp_path / "a.csv").write_text("id;x\n1;2\n")
    assert values(readers.semicolon_csv(spark, str(tmp_path / "a.csv")), "x") == ["2"]
    assert readers.semicolon_csv(spark, str(tmp_path / "none.csv")) is None and readers.stations(spark, str(tmp_path / "none.csv")).count() == 0
    assert readers.sniffed_csv(spark, str(tmp_path / "a.csv")).columns == ["id", "x"]
    (tmp_path / "pre.csv").write_text("title\nnote\nzone,0-4,5+\nA,1,2\nTOTALE,3,4\n")
    pop = readers.population(readers.csv_after_preamble(spark, str(tmp_path / "pre.csv")), "zone")
    assert [(r.zone, r.ages) for r in pop.collect()] == [("a", {"0-4": 1.0, "5+": 2.0})]
    (tmp_path / "xml").mkdir()
    whole = "junk<?xml version='1.0'?><n:a xmlns:n='u'><n:datiCatastali><n:foglio>12</n:foglio><n:subalterni><n:subDA>004</n:subDA><n:subA>9</n:subA></n:subalterni></n:datiCatastali><n:datiGenerali><n:datiIdentificativi><n:superficieUtileRiscaldata>80,5</n:superficieUtileRiscaldata></n:datiIdentificativi></n:datiGenerali></n:a>"
    (tmp_path / "xml/a.xml").write_bytes(whole.encode("utf-16"))
    (tmp_path / "xml/b.xml").write_text("<a><b></a>")
    r, broken = certificates.shred(readers.xml_files(spark, str(tmp_path / "xml")), "L219").orderBy("ape_file_list").collect()
    assert (r.ape_file_list, r.cadastral_sheet, r.cadastral_subaltern, r.surface_area, r.services_present, r.id) == (["a.xml"], "12", "4,9", 80.5, [], "L219_12_None_4,9")
    assert (broken.id, broken.surface_area, broken.energy_score_total) == ("L219_None_None_b", None, 4)
    done = certificates.finished(certificates.of_comune(certificates.shred(readers.xml_files(spark, str(tmp_path / "xml")), "L219"), "L219"))
    assert done.columns[:5] == ["id", "is_meta_estate", "cadastral_units_count", "id_list", "ape_file_list"] and not set(certificates.TECHNICAL) & set(done.columns) and done.count() == 2
    view = certificates.detail_view(certificates.detail(readers.xml_files(spark, str(tmp_path / "xml"))), "a.xml").first()
    assert (view.sheet, view.sub_da, view.sub_a, view.heating_service, view.energy_score, view.energy_raw_score) == ("12", "004", "9", False, 0, 1)
    img = spark.createDataFrame([("<a><b>iVBORw0KGgo" + "A" * 120 + "</b></a>",), ("<a/>",)], "x string")
    assert [v and v["mime"] for v in values(img, readers.image_of(F.col("x")))] == ["image/png", None]
    assert sinks.dataset(df, str(tmp_path / "d")) and not sinks.dataset(df, str(tmp_path / "d"))
    nan = spark.createDataFrame([(float("nan"), None)], "a double, b string")
    sinks.json_lines(nan, str(tmp_path / "j"))
    assert values(spark.read.text(str(tmp_path / "j")), "value") == ['{"a":null,"b":null}']


def test_addresses_match(spark):
    g = spark.createDataFrame([("via roma", "10", "torino", 45.0, 7.0), ("via roma antica", "1", "torino", 45.1, 7.1), ("corso po", "", "torino", 45.2, 7.2)], "street string, house_number string, city string, lat double, lon double")
    a = spark.createDataFrame([(1, "V.IA ROMA, 10", None, "Torino"), (2, "Largo Po", None, "Torino"), (3, "xx", None, None), (4, "via roma", "1", "torino")], "id int, street string, number string, city string")
    got = {r.id: (r.street, r.score) for r in readers.address_matches(a, g).collect()}
    assert got == {1: ("via roma", 550), 4: ("via roma", 150)} or got[1] == ("via roma", 550)
    assert 3 not in got


def test_rollup_and_dedup(spark):
    rows = [("a", 1, 1, 0, "x", None, 3), ("b", 1, 1, 0, None, None, 2), ("c", 1, 1, 0, "x", None, 1), ("d", 1, 1, 1, "y", None, 1)]
    df = spark.createDataFrame(rows, "id string, cadastral_sheet int, cadastral_parcel int, cadastral_subaltern int, address string, z string, effective_date int")
    assert sorted(values(rollup.latest_unit(df), "id")) == ["a", "d"]
    n = rollup.running_number(df, ["cadastral_sheet", "id"], "n", "cadastral_sheet")
    assert sorted((r.id, r.n) for r in n.collect()) == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]


def test_stats_many_values(spark):
    df = spark.range(1000).select((F.col("id") % 150).cast("string").alias("v"), F.lit(1.005).alias("x"))
    got = stats.category_stats(df, "v").collect()
    assert len(got) == 11 and got[-1].value == "other" and sum(r.n for r in got) == 1000
    assert stats.thresholds(spark.range(101).select(F.col("id").alias("x")), "x") == (25.0, 75.0)


def test_metrics(spark):
    df = spark.createDataFrame([(1, ["a"], ["a"]), (2, [], []), (3, ["a", "b"], ["b", "c"])], "q int, e array<string>, f array<string>")
    r = metrics.activation(df, "e", "f").first()
    assert (round(r.perfect_rate, 3), round(r.jaccard, 3)) == (0.667, 0.778)
    opts = [[f"{p}{c}" for c in "ab"] for p in range(6)]
    assert metrics.query_combinations(spark, opts, True).count() == 486 and metrics.query_combinations(spark, opts, False).count() == 64
    t = metrics.recall_totals(spark.createDataFrame([(2, 1, 0.5), (2, 2, 1.0)], "expected int, captured int, recall double")).first()
    assert (t.micro, t.macro) == (0.75, 0.75)
    texts = spark.createDataFrame([(1, "One big green house."), (2, "abig green"), (3, "")], "id int, text string")
    ph = spark.createDataFrame([(7, "big green house"), (8, "green"), (9, "One")], "phrase_id int, phrase string")
    assert {tuple(r) for r in metrics.phrases_in(texts, ph).collect()} == {(1, 7), (1, 8), (1, 9), (2, 8)}
    sets = [(["a", "b"], ["b", "c", "d"]), ([], ["a"]), ([], []), (["a"], []), (["a", "a"], ["a"])]
    got = spark.createDataFrame(sets, "e array<string>, f array<string>").coalesce(1).select(metrics.set_scores(F.col("e"), F.col("f")).alias("s")).collect()
    assert [tuple(r.s) for r in got] == [(0.333, 0.5, 0.4), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]


def test_phrases_in(spark):
    """Equal to contains of every pair: phrases of one, two and more words, within words, at marks, odd blanks, no letters."""
    texts = ["One big green house.", "abig green", "", "He said (big green house), twice", "a big  green\thouse", "\"Big green\" it was", "unhoused", "x [one big green house in town] y", "é ÀB. c", None, "big\ngreen house", "i"]
    phrases = ["house", "big green house", "green", "One", "big green", "one big green house in town", "g green h", " ", "", "house.", "(big", "é", "ab. c", "big  green\thouse", "green house", "s", "reen", " green house", "it was", None, "one big", "e big green h"]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    p = spark.createDataFrame(list(enumerate(phrases)), "phrase_id int, phrase string")
    brute = lambda ps: sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(phrases) if a is not None and b is not None and j in ps and b.lower() in a.lower())
    assert sorted(map(tuple, metrics.phrases_in(t, p).collect())) == brute(range(len(phrases)))
    assert sorted(map(tuple, metrics.phrases_in(t, p, block_chars=20).collect())) == brute(range(len(phrases)))  # many blocks
    for only in ([1], [0], [5, 11], [8]):
        assert sorted(map(tuple, metrics.phrases_in(t, p.where(F.col("phrase_id").isin(only))).collect())) == brute(only)


def test_finalise_stores(spark):
    old = spark.createDataFrame([(1, None, 1), (2, "a", 1)], "run int, agent string, r int")
    new = spark.createDataFrame([(1, None, 5)], "run int, agent string, r int")
    assert sorted(values(finalise.upsert(old, new, ["run", "agent"]), "r")) == [1, 5]
    users = spark.createDataFrame([(1,), (2,)], "user_id int")
    runs = spark.createDataFrame([(1, 10), (2, 20)], "user_id int, run_id int")
    fb = spark.createDataFrame([(10, "x"), (20, "y")], "run_id int, t string")
    u, r, f = finalise.cascade_delete(users, runs, fb, users.where("user_id = 1"))
    assert values(u, "user_id") == [2] and values(r, "run_id") == [20] and values(f, "t") == ["y"]
    s = spark.createDataFrame([("r", 1, "pending"), ("r", 2, "done"), ("r", 3, "pending")], "run string, position int, status string")
    assert [(x.status, x.percent) for x in finalise.progress(s).orderBy("position").collect()] == [("done", 33.3), ("done", 66.7), ("pending", 100.0)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, latitude double, longitude double, energy_class string, surface_area double")
    assert filters.markers_lite(none).count() == 0 and filters.page(none, 0, 5).count() == 0
    assert spatial.radius_join(none, spark.createDataFrame([], "lat double, lon double"), 1.0).count() == 0
    assert stats.numeric_stats(none, ["surface_area"]).first().n == 0


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    (tmp_path / "in").mkdir()
    batch.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    s = events.hourly(events.read(spark, str(tmp_path / "in"), batch.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1), "2 hours")
    got = events.run_once(s.select("hour", "event_type", "n"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.hourly(batch).select("hour", "event_type", "n").collect()))


def test_radius_join_by_place(spark):
    """Rows that share places, those that don't, and null, NaN and negative zero: the rows of the plain join, with rounded
    distances, dealt into more than one task before the join that multiplies them."""
    shared = [(k, None if k == 7 else float("nan") if k == 8 else -0.0 if k == 9 else k % 5 / 100, k % 3 / 100) for k in range(300)]
    own = [(k, k / 100, k * 7 % 100 / 100) for k in range(300)]
    for rows in (shared, own):
        a, b = spark.createDataFrame(rows, "id long, latitude double, longitude double"), spark.createDataFrame(rows, "poi_id long, lat double, lon double").coalesce(1)
        got = spatial.radius_join_by_place(a, b, 1.6, 3)
        assert got.columns == ["id", "latitude", "longitude", "poi_id", "lat", "lon", "distance_km"]
        key = lambda r: (r.id, r.poi_id, str(r.latitude), str(r.lat), r.distance_km)
        want = sorted(map(key, spatial.radius_join(a, b, 1.6).withColumn("distance_km", F.round("distance_km", 3)).collect()))
        assert sorted(map(key, got.collect())) == want and len(want) >= 300
        if rows is shared:
            assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString() and len(want) > 10_000


def test_certificate_paths(spark, tmp_path):
    """Texts at paths: the first in the document's order, below each other, by place and by parts of names; and the documents
    dealt out from one small partition."""
    doc = "<r><a><a><b>1</b></a><b>2</b></a><c xmlns='u' x:y='1'><b>3</b><Piano_x>4<!-- no --><i>5</i></Piano_x></c><c><b>6</b><b>7</b></c></r>"
    want = {"//a/b": "1", "//c//b": "3", "(//c)[1]/b": "3", "(//a)[1]//b": "1", "//c/b": "3", "//none/b": "", "/*": "1234567", f"//*[contains({certificates.NAMED},'piano')][1]": "45", "(//none)[1]/b": ""}
    assert certificates.texts_at(doc, certificates.planned(list(want))) == list(want.values())
    assert certificates.texts_at("<r><a>", certificates.planned(["//a", "/*"])) == ["", ""]
    with pytest.raises(ValueError):
        certificates.steps("//a[last()]")
    from parcelspark.plans import registry

    spark.range(3).selectExpr("id AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    docs = registry._certificates(spark, str(tmp_path))
    assert docs.count() == 3 and docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
