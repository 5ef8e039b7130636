"""Evaluation, map filters, markers, stored documents, zones, explanations and sinks against results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import exprs as X
from parcelspark.operators import evaluation as E
from parcelspark.operators import filters, finalise, scoring, spatial
from parcelspark.plans import constraints as C
from parcelspark.sources import readers, sinks


def one(df):
    return df.first().asDict(recursive=True)


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


JUDGED = "pros array<struct<accuracy: boolean, relevance: boolean>>, cons array<struct<accuracy: boolean, relevance: boolean>>"


def test_judge_means(spark):
    rows = [([(True, True), (False, True), (None, None)], [(True, False)]), ([], None), (None, [(True, True), (True, False), (False, False)])]
    got = one(E.judge_means(spark.createDataFrame(rows, JUDGED)))
    assert got == {"samples": 3, "accuracy_pros": 0.333, "relevance_pros": 0.667, "accuracy_cons": 0.75, "relevance_cons": 0.25, "accuracy_avg": 0.542, "relevance_avg": 0.459} or got["relevance_avg"] == 0.458
    assert one(E.judge_means(spark.createDataFrame([], JUDGED)))["accuracy_avg"] in (0.0, None)


def test_replay_summary(spark):
    ddl = "mode string, sql_valid boolean, executes boolean, rows int, invalid_columns int, missing_hard int, repairs int, relax_hits int, relax_blocked int, sql_source string"
    rows = [("a", True, True, 0, 1, 0, None, 2, 0, None), ("a", False, True, 5, 0, 1, 3, 0, 0, "ir"), ("a", None, False, 0, 0, 0, 0, 0, 1, "llm"), ("b", True, True, 1, 0, 0, 0, 0, 0, "llm")]
    got = {r["mode"]: r.asDict() for r in E.replay_summary(spark.createDataFrame(rows, ddl)).collect()}
    assert (got["a"]["valid_rate"], got["a"]["exec_rate"], got["a"]["zero_row_queries"], got["a"]["repairs"], got["a"]["relax_hits"], got["a"]["sql_source"]) == (0.33, 0.67, 2, 3, 2, {"llm": 2, "ir": 1})
    assert got["b"]["n"] == 1


def test_activation(spark):
    cols = spark.createDataFrame([(["mobilita", "id", "x"],), ([],), (["latitudine", "sport"],)], "c array<string>").coalesce(1)
    assert column(cols, E.activated(F.col("c"))) == [["building", "proximity"], [], ["location", "proximity"]]
    rows = [(["a", "b"], ["a"]), (["a"], ["a"]), ([], ["c"]), (["b"], ["c", "b"])]
    q = spark.createDataFrame(rows, "expected array<string>, found array<string>")
    by = {r.domain: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in E.activation_by_domain(q, ["a", "b", "c"]).collect()}
    assert by == {"a": (2, 0, 0, 1.0, 1.0, 1.0), "b": (1, 0, 1, 1.0, 0.5, 0.667), "c": (0, 1, 0, 0.0, 0.0, 0.0)}
    s = one(E.activation_summary(q, ["a", "b", "c"]))
    assert (s["pmr"], s["mean_jaccard"], s["mean_precision"], s["mean_recall"]) == (0.25, 0.5, 1.0, 0.75) and abs(s["mean_f1"] - 0.834) < 0.0011


def test_pairs_and_ablation(spark):
    ddl = "config string, file string, ids array<string>"
    rows = [("all_enabled", "q1", ["a", "b"]), ("all_enabled", "q2", []), ("no_poi", "q1", ["b", "c"]), ("no_poi", "q2", []), ("no_poi", "q9", ["z"]), ("no_geo", "q9", ["z"])]
    df = spark.createDataFrame(rows, ddl)
    assert {r.config: round(r.sensitivity, 4) for r in E.ablation(df).collect()} == {"no_poi": round((1 / 3 + 1) / 2, 4), "no_geo": 1.0}
    a, b = df.where("config = 'all_enabled'").drop("config"), df.where("config = 'no_poi'").drop("config")
    assert one(E.comparison(a, b, {"mean_ranking_iou": "ids"})) == {"mean_ranking_iou": 0.667, "sample_size": 2}


def test_evaluation_rows_and_contribution(spark):
    rows = [("r", 1, ["x", "y"]), ("r", 2, None), ("r", 3, ["z"]), ("s", 1, [])]
    got = E.evaluation_rows(spark.createDataFrame(rows, "run string, position int, items array<string>")).orderBy("run", "batch_id").collect()
    assert [(r.run, r.position, r.item, r.batch_id) for r in got] == [("r", 1, "x", 0), ("r", 1, "y", 1), ("r", 2, None, 2), ("r", 3, "z", 3), ("s", 1, None, 0)]
    runs = spark.createDataFrame([("a", {"energy": 0.6, "location": 0.4}, ["energy"]), ("b", {"building": 1.0}, ["building", "energy"]), ("c", {}, None)], "run string, weights map<string,double>, found array<string>")
    ranked = E.ranked_weights(runs)
    assert [(r["rank"], r.domain, r.contributed) for r in ranked.where("run = 'a'").orderBy("rank").collect()] == [(1, "energy", 1), (2, "location", 0), (3, "regulatory", 0), (4, "building", 0), (5, "proximity", 0)]
    rho, by_rank, by_domain = E.contribution(ranked)
    data = [(r["rank"], r.contributed) for r in ranked.collect()]
    mean = lambda xs, v: sum(x < v for x in xs) + (xs.count(v) + 1) / 2
    rx, ry = [mean([d[0] for d in data], d[0]) for d in data], [mean([d[1] for d in data], d[1]) for d in data]
    mx, my = sum(rx) / len(rx), sum(ry) / len(ry)
    want = sum((p - mx) * (q - my) for p, q in zip(rx, ry, strict=True)) / (sum((p - mx) ** 2 for p in rx) * sum((q - my) ** 2 for q in ry)) ** 0.5
    assert rho.first().rho == pytest.approx(want, abs=1e-4) and {r["rank"]: round(r.rate, 3) for r in by_rank.collect()}[1] == 0.667
    assert {r.domain: (r.total, round(r.rate, 3)) for r in by_domain.collect()}["energy"] == (3, 0.667)


MARKERS = "id string, energy_class string, surface_area double, construction_period string, property_type string, description string, cultural_constraint string, is_meta_estate boolean, legal_nature string, energy_files array<string>, tier int, ranking_score double, address string, latitude double, longitude double"


def markers(spark):
    rows = [
        ("1", "a1", 50.0, "p", "x", "Public Office", "none", True, "Public", ["f"], 3, 9.0, "Via B", 45.0, 7.0), ("2", None, None, None, None, None, None, None, None, None, 1, None, None, 45.0, 7.0),
        ("3", "B", 80.0, "q", "y", "home", "Protected site", False, "private", [], 2, 5.0, "Via A", None, None), ("4", "Z", 20.0, "p", "y", "HOME office", None, None, "PRIVATE", None, 2, 7.0, "", 45.1, 7.1),
    ]
    return spark.createDataFrame(rows, MARKERS)


def test_map_filters(spark):
    df, M = markers(spark), filters.MapFilters
    ids = lambda **k: sorted(column(filters.apply_map_filters(df, M(**k)), "id"))
    assert ids(energy_classes=("A", "B")) == ["1", "3"] and ids(max_surface=30.0) == ["2", "4"] and ids(min_surface=0.0) == ["1", "2", "3", "4"]
    assert ids(usage=("office", "none")) == ["1", "4"] and ids(constraints=("SITE",)) == ["3"] and ids(is_meta_building=False) == ["2", "3", "4"]
    assert ids(legal_nature="Private") == ["3", "4"] and ids(has_certificate=True) == ["1", "3", "4"] and ids(has_certificate=False) == ["2"]
    assert ids(tiers=(2, 3)) == ["1", "3", "4"] and ids(construction_periods=("p",), property_types=("y",)) == ["4"] and len(ids()) == 4


def test_marker_sorts(spark):
    df = markers(spark)
    order = lambda by: column(filters.sort_markers(df, by), "id")
    assert order("score") == ["1", "4", "3", "2"] and order("surface") == ["3", "1", "4", "2"] and order("address") == ["2", "4", "3", "1"]
    assert order("energy") == ["1", "4", "3", "2"]  # a1 and Z are no classes of the list, which stand first, as an index of -1 does
    t = spark.createDataFrame([("a", "2024-01-02"), ("b", None), ("c", "2024-05-01"), ("d", "2024-01-02")], "k string, ts string")
    assert column(filters.newest_first(t, "ts", "k"), "k") == ["c", "a", "d", "b"]
    assert column(filters.by_length(spark.createDataFrame([("ccc",), ("b",), ("a",)], "t string"), "t"), "t") == ["a", "b", "ccc"]
    assert filters.counted(df).first().total == 4


def test_full_markers(spark):
    df = markers(spark).withColumns({"house_number": F.lit("5"), "comune_code": F.lit("L219"), "energy_score_class": F.lit(5), "mobility": F.lit(3.0)})
    rows = {r.id: r for r in filters.markers_full(df).collect()}
    assert set(rows) == {"1", "2", "4"}
    r = rows["1"]
    assert (r.lat, r.city, r.address, r.construction_year, r.legal_nature, r.price, r.energy_scores.class_score, r.energy_scores.total, r.proximity_scores.mobility) == (45.0, "Torino", "Via B, 5", "p", "Public", None, 5.0, 5.0, 3.0)


def test_users(spark):
    users = spark.createDataFrame([(1, "ann", "a@x"), (2, "bob", "b@x")], "user_id long, username string, email string")
    runs = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", None)], "run_id string, user_id long")
    assert sorted(column(filters.owned(runs, 1), "run_id")) == ["r1", "r3"] and filters.owned(runs, None).count() == 3
    assert filters.user_by(users, "email", "b@x").first().user_id == 2 and filters.user_by(users, "username", "eve").count() == 0
    assert filters.taken(users, "ann", "z@x") == (True, False) and filters.taken(users, "ann", "a@x", besides=1) == (False, False) and filters.taken(users.limit(0), "a", "b") == (False, False)


def test_stored_documents(spark):
    z = spark.createDataFrame([("1", "A")], "Zona Urbanistica string, n string".replace("Zona Urbanistica", "`Zona Urbanistica`"))
    assert finalise.renamed_like(z).columns == ["zona_urbanistica", "n"] and finalise.renamed_like(z.select("n")).columns == ["n"]
    zones = spark.createDataFrame([(" Centro ", 1), ("Nord", 2)], "zone string, i int")
    pop = spark.createDataFrame([("centro", {"0-4": 5.0, "5+": 7.0}), ("CENTRO ", {"0-4": 3.0, "5+": 9.0})], "zone string, ages map<string,double>")
    assert sorted(map(tuple, finalise.zone_population(zones, pop, ["0-4", "5+"]).collect())) == [(" Centro ", 1, 3.0, 9.0), ("Nord", 2, 0.0, 0.0)]
    df = spark.createDataFrame([(1, '{"a": {"x": 1}, "b": "t"}'), (2, "[1]"), (3, None)], "run_id int, payload string")
    got = {r.run_id: r.payload for r in finalise.payload_keys(df, "payload", ["a", "q", "a"]).collect()}
    assert json.loads(got[1]["a"]) == {"x": 1} and got[1]["q"] is None and got[2] == {"a": None, "q": None} and got[3]["a"] is None
    steps = {"zzz": '"plain"', "evaluation": '{"response": "", "answer": "yes"}', "sql_generation": '{"sql_query": "SELECT 1", "raw": null}', "aaa": '{"other": 1}'}
    rows = finalise.agent_steps(spark.createDataFrame([("r", steps)], "run_id string, payload map<string,string>")).orderBy("number").collect()
    assert [(r.number, r.key, r.response) for r in rows] == [(1, "sql_generation", "SELECT 1"), (2, "evaluation", "yes"), (3, "aaa", None), (4, "zzz", "plain")]
    only = finalise.agent_steps(spark.createDataFrame([("r", steps)], "run_id string, payload map<string,string>"), keys=["zzz"])
    assert [(r.number, r.key) for r in only.collect()] == [(1, "zzz")]
    t = spark.createDataFrame([("q1", "todo", 1), ("q2", None, 2)], "q string, status string, n int")
    u = spark.createDataFrame([("q1", "status", "run", 1), ("q1", "status", "done", 2), ("q2", "n", "9", 1), ("q7", "n", "1", 1)], "q string, column string, value string, at int")
    assert sorted(map(tuple, finalise.cells(t, u, "q").collect())) == [("q1", "done", 1), ("q2", None, 9)]


def test_first_rows_are_chosen(spark):
    left = spark.createDataFrame([("a", None), ("b", "x")], "id string, v string")
    right = spark.createDataFrame([("a", "z"), ("a", "m"), ("b", "q")], "id string, v string")
    for part in (1, 5):
        assert sorted(map(tuple, finalise.combine_first(left, right.repartition(part)).collect())) == [("a", "m"), ("b", "x")]
    full = spark.createDataFrame([("a",), ("b",)], "id string")
    result = spark.createDataFrame([("a", 5.0, 2.0), ("a", 9.0, 3.0), ("a", 9.0, 1.0)], "id string, ranking_score double, distance_km double")
    assert sorted(map(tuple, finalise.overlay(full, result.repartition(4)).collect())) == [("a", True, 9.0, 1.0), ("b", False, 0.0, None)]


def test_condition_tree(spark):
    tree = C.condition_tree(spark, "SELECT * FROM t WHERE a = 1 AND (b > 2 OR c IN ('x', 'y AND z')) AND d BETWEEN 3 AND 4 AND haversine_km(latitudine, longitudine, 1, 2) <= 3")
    text = lambda rows: [(r["operator"], text(r["children"]) if "children" in r else r["content"].replace("(", "").replace(")", "").replace("'", "")) for r in rows]
    got = text(tree)
    assert [o for o, _ in got] == [None, "AND", "AND"] and got[0][1] == "a = 1" and [o for o, _ in got[1][1]] == [None, "OR"] and "y AND z" in got[1][1][1][1] and "BETWEEN 3 AND 4" in got[2][1].upper()
    assert C.condition_tree(spark, "SELECT * FROM t") == [] and C.condition_tree(spark, "SELECT * FROM t WHERE latitudine > 3") == [] and C.condition_tree(spark, "nonsense (") == []
    assert text(C.condition_tree(spark, "SELECT * FROM t WHERE x = 1 OR y = 2")) == [(None, "x = 1"), ("OR", "y = 2")]


def test_formatted_requirements():
    r = [{"target_column": "a", "operator": "IN", "value": ["x", "y"]}, {"colonna_target": "b", "operatore": ">=", "valore": 3}, {"target_column": "c", "operator": "=", "value": ["z"]}, {"target_column": "d", "operator": "=", "value": None}, {"operator": "=", "value": 1}, {"target_column": "e", "operator": "=", "value": "t"}, {"target_column": "f", "operator": "IN", "value": []}]
    assert C.formatted(r) == "a IN ('x', 'y'); b >= 3; c = 'z'; e = 't'; f IN ()" and C.formatted([]).startswith("No specific")


def test_planned():
    answer = {"sql": {"query": "SELECT 1"}, "layer2": {"weights": {"localizzazione": 0.5, "energy": 0.0}}, "layer1": {"analysis": {"tipologia": {"found": True, "parametri": {"tipologia_bene_immobile": "Office"}}, "energy": {"found": False}, "servizi": {"found": True}, "location": {"found": True, "filters": {"coordinate": {"lat": 45.0, "lon": 7.0}, "raggio_km": 2}}, "normativa": {"found": True, "filters": {"use_destination": "School"}}}}}
    query, weights, payloads, places = C.planned(answer)
    assert query == "SELECT 1" and weights == {"location": 0.5, "regulatory": 0.2, "energy": 0.0, "building": 0.2, "proximity": 0.2}
    assert [(p["source_agent"], p["parsed"].get("typologies"), p["parsed"]["requirements"]) for p in payloads] == [("building", ["Office"], [{"column": "superficie_di_riferimento_mq"}]), ("proximity", None, [{"amenity": "healthcare"}]), ("regulatory", None, [{"notes": "School"}])]
    assert places == [{"name": "planned place", "lat": 45.0, "lon": 7.0, "radius_km": 2}] and C.planned({}) == ("", dict.fromkeys(C.PLAN_SECTIONS, 0.2), [], [])


def test_explanations(spark):
    df = spark.createDataFrame([("a", "Office", 40.0, 45.0, 7.0), ("b", None, 10.0, 46.0, 7.0)], "id string, property_type string, mobility double, latitude double, longitude double")
    parts = [scoring.Part("mobility", F.lit(40.0), 0.5, scoring.Range(0.0, 100.0)), scoring.Part("property_type", F.lit(100.0), 0.5)]
    a, b = (r.energy_formula for r in scoring.explained(df, "energy", parts).orderBy("id").collect())
    assert a == ["Sum(", "  mobility: 100*(40.0-0.0)/(100.0-0.0)=40.0 [Global Ref] * Weight(0.500),", "  property_type(Office): 100.0 (Match) * Weight(0.500)", ")"]
    assert b[1] == "  mobility(10.0) [Min 0.0, Max 100.0]: 40.0 [Global Ref] * Weight(0.500)," and b[2].startswith("  property_type(N/D)")
    down = scoring.explained(df, "energy", [scoring.Part("mobility", F.lit(60.0), 1.0, scoring.Range(0.0, 100.0), False)]).orderBy("id").first().energy_formula
    assert down == ["mobility: 100*(100.0-40.0)/(100.0-0.0)=60.0 [Local Range] * Weight(1.000)"]
    needs = [scoring.Need("mobility", ">=", 20), scoring.Need("absent", ">=", 1), scoring.Need("property_type", "IN", ["Office"])]
    assert [(p.column, round(p.weight, 3)) for p in scoring.need_parts(df, needs, harmonic_weights=True)] == [("mobility", 0.667), ("property_type", 0.333)]
    place = [spatial.Place("c", 45.0, 7.0, 2.0)]
    loc = [r.location_formula for r in scoring.explained_location(scoring.location_score(df, place), place).orderBy("id").collect()]
    assert loc == [["100 * exp(-(0.00/1.71)^3)"], ["too far (111.19km) -> 0"]]
    assert [r.building_formula for r in scoring.explained_building(df, ["home", "office space"]).orderBy("id").collect()] == [["100 / Position(2)"], ["0 (No match)"]]
    total = scoring.explained_total(df.withColumn("energy_score", F.lit(12.34)), {"energy": 0.5}).first().ranking_steps
    assert total[0] == "RankingSum(" and "  energy_score(12.3) * Weight(0.5)," in total and total[-1] == ")" and len(total) == 7


def test_places_in(spark):
    df = spark.createDataFrame([(" a ;b;; nessun luogo ;",), ("NESSUN LUOGO",), (None,)], "t string").coalesce(1)
    assert column(df, X.places_in(F.col("t"))) == [["a", "b"], [], None]


def test_zones_of_every_shape(spark, tmp_path):
    square = lambda x, y, d: [[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]
    features = [
        {"properties": {"zone": "holed"}, "geometry": {"type": "Polygon", "coordinates": [square(7, 45, 1), square(7.4, 45.4, 0.2)]}},
        {"properties": {"zone": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[square(9, 45, 0.5)], [square(7.45, 45.45, 0.05)]]}},
        {"properties": {"zone": "point"}, "geometry": {"type": "Point", "coordinates": [7, 45]}},
    ]
    points = spark.createDataFrame([("in", 45.1, 7.1), ("hole", 45.55, 7.55), ("island", 45.46, 7.46), ("far", 45.2, 9.2), ("none", 40.0, 7.0)], "id string, latitude double, longitude double")
    want = {"in": "holed", "hole": None, "island": "two", "far": "two", "none": None}
    (tmp_path / "z.json").write_text(json.dumps({"crs": {"properties": {"name": "urn:ogc:def:crs:OGC:1.3:CRS84"}}, "features": features}))
    assert {r.id: r.zone for r in spatial.zone_of(points, readers.zones(spark, str(tmp_path / "z.json"))).collect()} == want
    import math

    def metres(c):
        return [metres(x) for x in c] if isinstance(c[0], list) else [c[0] * 20037508.342789244 / 180, math.log(math.tan(math.pi / 4 + math.radians(c[1]) / 2)) * 6378137]

    moved = [{**f, "geometry": {**f["geometry"], "coordinates": metres(f["geometry"]["coordinates"])}} for f in features]
    (tmp_path / "m.json").write_text(json.dumps({"crs": {"properties": {"name": "EPSG:3857"}}, "features": moved}))
    assert {r.id: r.zone for r in spatial.zone_of(points, readers.zones(spark, str(tmp_path / "m.json"))).collect()} == want
    (tmp_path / "u.json").write_text(json.dumps({"crs": {"properties": {"name": "EPSG:32632"}}, "features": features}))
    with pytest.raises(ValueError, match="32632"):
        readers.zones(spark, str(tmp_path / "u.json"))


def test_pois_by_category_and_reach(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"Verde": {"park": [{"id": 1, "lat": 45.0, "lon": 7.0}]}, "sanità": {"clinic": [{"id": 2, "lat": 45.0, "lon": 7.0}]}, "other": {"airport": [{"id": 3, "lat": 1.0, "lon": 2.0}]}}))
    got = {r.id: (r.category, r.reach) for r in readers.pois(spark, str(tmp_path / "p.json")).collect()}
    assert got == {1: ("green", "neighbourhood"), 2: ("healthcare", "district"), 3: ("other", "city")}


def test_stored_tables(spark, tmp_path):
    spark.createDataFrame([(1, "r", 4)], "feedback_id long, run_id string, rating int").write.parquet(str(tmp_path / "feedback.parquet"))
    got = readers.stored(spark, str(tmp_path), "feedback")
    assert got.count() == 1 and {"agent_name", "user_id", "created_at"} <= set(got.columns)
    assert readers.stored(spark, str(tmp_path), "users").columns == ["user_id", "username", "email", "created_at"] and readers.stored(spark, str(tmp_path), "users").count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, float("nan")], {"a": float("inf")}, (float("nan"), "x"), None)], "i int, a array<double>, m map<string,double>, s struct<d: double, t: string>, z array<double>")
    r = sinks.json_safe(rows).first()
    assert (r.a, r.m, tuple(r.s), r.z) == ([1.0, None], {"a": None}, (None, "x"), None)
    for n in range(12):
        (tmp_path / f"2024-01-{n + 1:02d}.json").write_text("{}")
    assert sorted(sinks.keep_newest(spark, str(tmp_path), 10)) == ["2024-01-01.json", "2024-01-02.json"] and len(list(tmp_path.glob("*.json"))) == 10
    assert sinks.keep_newest(spark, str(tmp_path / "none")) == []
    text = sinks.latex(spark.createDataFrame([("a_b", 0.12345), (None, 1.0)], "name string, f1 double"), "T & U")
    assert r"a\_b & 0.123 \\" in text and "-- & 1.000" in text and r"\caption{T \& U}" in text


def test_json_of_answers(spark):
    """Thoughts, fences, Python words, single quotes, commas too many and brackets too few."""
    texts = {
        '<think>{"no": 1}</think>```json\n{"k": 1}\n``` and {x}': {"k": 1}, "Sure: {'k': 'it', 'b': True, 'n': None}": {"k": "it", "b": True, "n": None}, '{"k": [1, 2,], }': {"k": [1, 2]},
        '{"k": [1, 2': {"k": [1, 2]}, '{\\"k\\": 3}': {"k": 3}, "no json": None, '{"k": "don\'t", "b": False}': {"k": "don't", "b": False}, "": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    assert [v and json.loads(v) for v in column(df, F.to_json(X.json_object(F.col("t"))))] == list(texts.values())
    lists = spark.createDataFrame([("here: [1, 2]",), ('{"a": [1]}',)], "t string").coalesce(1)
    assert [json.loads(v) for v in column(lists, F.to_json(X.json_value(F.col("t"))))] == [[1, 2], {"a": [1]}] and column(lists, F.to_json(X.json_object(F.col("t"))))[0] is None


def test_demos(spark, tmp_path):
    for name, meta in (("one", {"query": "q1", "timestamp": "2024-02-01", "location_data": [["Porta Nuova, Torino", 45.0, 7.0]]}), ("two", {"timestamp": "2024-03-01"}), ("three", {})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps(meta, indent=1))
        (tmp_path / name / "results.csv").write_text("id;latitude;longitude\n2;45,1;7.1\n1;45.0;7.0\n;1;1\n3;x;7\n")
    assert column(readers.demos(spark, str(tmp_path)), "demo_id") == ["two", "one", "three"]
    got = [(r.id, r.demo_query, r.demo_city) for r in readers.demo_rows(spark, str(tmp_path / "one")).collect()]
    assert got == [("1", "q1", "Torino"), ("2", "q1", "Torino")]
    assert [(r.id, r.demo_query, r.demo_city) for r in readers.demo_rows(spark, str(tmp_path / "two"), 1).collect()] == [("1", "Demo: two", None)]


def test_sample_is_the_smallest_hashes(spark):
    """The same rows however the table is parted, spread over it, and all of a small table."""
    df = spark.range(900).withColumnRenamed("id", "k")
    order = [r.k for r in df.withColumn("h", F.xxhash64("k", F.lit(42))).orderBy("h", "k").collect()]
    for parts in (1, 6):
        assert sorted(column(readers.sample(df.repartition(parts), "k", 90), "k")) == sorted(order[:90])
    assert readers.sample(df, "k", 5000).count() == 900 and 250 < sum(order[:90]) / 90 < 650


def test_gazetteer_and_landmarks(spark):
    nodes = spark.createDataFrame([({"addr:street": " Via Po ", "addr:housenumber": "7A", "addr:city": "Torino"}, 7.0, 45.0), ({"name": "x"}, 7.1, 45.1), ({"addr:street": "Via X"}, 7.2, 45.2)], "tags map<string,string>, lon double, lat double")
    assert sorted(map(tuple, readers.gazetteer(nodes).select("street", "house_number", "city").collect()), key=str) == [("via po", "7a", "torino"), ("via x", None, None)]


def test_rule_documents_and_lines(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/a.txt").write_text("rules à")
    (tmp_path / "docs/b.bin").write_bytes(bytes([255, 254, 0, 1]))
    assert {r.file: r.text for r in readers.rule_documents(spark, str(tmp_path / "docs")).collect()} == {"a.txt": "rules à", "b.bin": "//4AAQ=="}
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/M1.csv").write_text("name;x\nA;1\nB;2\n\nC;3\n")
    (tmp_path / "lines/M2.csv").write_text("name,x\nB,1\nA,2\n")
    from parcelspark.operators import metrics

    got = readers.metro_lines(spark, str(tmp_path / "lines"))
    assert sorted((r.line, r.name) for r in got.collect()) == [("M1", "A"), ("M1", "B"), ("M1", "C"), ("M2", "A"), ("M2", "B")]
    assert sorted(map(tuple, metrics.edges_by_line(got).collect())) == [("A", "B", "M1/M2"), ("B", "C", "M1")]


def test_result_documents(spark, tmp_path):
    for name in ("query_1.json", "query_1_tr2.json", "other.json"):
        (tmp_path / name).write_text(json.dumps({"query": name, "ranking": [{"id": "a", "score": 1.0}]}, indent=1))
    got = readers.results(spark, str(tmp_path)).collect()
    assert [(r.file, r.query, r.ranking[0].id) for r in got] == [("query_1.json", "query_1.json", "a")]
