"""Severity, building, rendering, repair, validation, relaxation and fallbacks."""

import random

import pytest
from pyspark.sql import functions as F

from parcelspark import schema
from parcelspark.plans import constraints as C
from parcelspark.plans import engine

COLUMNS = ["tipologia_bene_immobile", "superficie_di_riferimento_mq", "mobilita", "latitudine", "longitudine", "note"]


@pytest.fixture(scope="module")
def frame(spark):
    rows = [("office", 1500.0, 80.0, 45.06, 7.68, "o'x"), ("home", 90.0, 20.0, 45.2, 7.9, "mobility")]
    return spark.createDataFrame(rows, "tipologia_bene_immobile string, superficie_di_riferimento_mq double, mobilita double, latitudine double, longitudine double, note string")


def sample():
    payloads = [
        {"source_agent": "building", "parsed": {"typologies": ["office"], "requirements": [{"target_column": "surface_area", "operator": ">=", "value": 1000}]}},
        {"source_agent": "proximity", "parsed": {"requirements": [{"target_column": "mobility", "operator": ">=", "value": 50}]}},
        {"source_agent": "energy", "parsed": None, "raw_text": "x" * 900},
    ]
    return C.build("q", payloads, [{"lat": 45.06, "lon": 7.68}, {"lat": None, "lon": 1}], {"building": 0.3})


def test_severity():
    assert C.severity("regulatory", "x") == ("hard", False)
    assert C.severity("building", "tipologia_bene_immobile") == ("hard", False)
    assert C.severity("building", "codice_comune") == ("hard", False)
    assert C.severity("building", "surface_area") == ("soft", True)
    assert C.severity("other", "x") == ("human_review", True)
    assert C.severity("energy", "x", {"severity": "hard"}) == ("hard", False)
    assert C.severity("energy", "x", {"severity": "hard", "relaxable": True}) == ("hard", True)


def test_build():
    c = sample()
    assert [e.constraint_id for e in c.entries] == ["building_001", "building_002", "proximity_001", "location_001"]
    assert c.entries[0].weight == 0.3 and c.entries[0].operator == "IN"
    assert [f.constraint_id for f in c.failures] == ["energy_fail_001"] and len(c.failures[0].raw_preview) == 300


def test_resolve():
    assert schema.resolve("surface_area", COLUMNS) == "superficie_di_riferimento_mq"
    assert schema.resolve("mobilità", COLUMNS) == "mobilita"
    assert schema.resolve("nothing", COLUMNS) is None
    assert schema.resolve("nothing", []) == "nothing"


def test_render_runs_both_ways(spark, frame):
    r = C.render(sample(), frame.columns)
    assert r.ids == ["building_001", "building_002", "proximity_001", "location_001"] and not r.skipped
    assert frame.where(r.condition).count() == 1
    rows, error = engine.run_sql(spark, r.sql(limit=5), frame)
    assert error is None and rows.count() == 1


def test_render_skips(frame):
    bad = [C.Constraint("a", "x", column="absent", operator="=", value=1), C.Constraint("b", "x", column="mobility", operator="IN", value=[None]), C.Constraint("c", "x", column="mobility", operator="BETWEEN", value=[1]), C.Constraint("d", "x", column="mobility", operator="~", value=1), C.Constraint("e", "x", column="mobility", operator="=", value=None)]
    r = C.render(C.ConstraintSet("q", bad), frame.columns)
    assert sorted(r.skipped) == ["a", "b", "c", "d", "e"] and r.sql() is None and r.condition is None


def test_literals(spark, frame):
    c = C.ConstraintSet("q", [C.Constraint("a", "x", column="note", operator="=", value="o'x")])
    rows, error = engine.run_sql(spark, C.render(c, frame.columns).sql(), frame)
    assert error is None and rows.count() == 1
    assert C.literal(True) == "TRUE" and C.literal("a\\b") == "'a\\\\b'"


def test_hard_only(frame):
    assert C.render(sample(), frame.columns, hard_only=True).ids == ["building_001", "location_001"]


def test_consolidate():
    e = [C.Constraint("a", "x", column="surface_area", operator=">=", value=100, severity="hard", relaxable=False), C.Constraint("b", "x", column="superficie", operator=">", value=200), C.Constraint("c", "x", column="mobility", operator="<=", value=9)]
    got = C.consolidate(e)
    assert [(x.value, x.severity) for x in got] == [(200, "hard"), (9, "soft")]


def test_repair(spark, frame):
    sql = "SELECT * FROM ESTATES WHERE mobility >= 50 AND note <> 'mobility is it''s' AND nowhere = 1"
    fixed, renamed, lost = C.repair_columns(spark, sql, frame.columns)
    assert renamed == {"mobility": "mobilita"} and lost == ["nowhere"]
    assert "'mobility is it''s'" in fixed and "`mobilita` >= 50" in fixed
    assert C.repair_columns(spark, "not sql at all(", frame.columns)[1] == {}


def test_validate(spark, frame):
    c = sample()
    good = "SELECT * FROM E WHERE tipologia_bene_immobile IN ('office') AND superficie_di_riferimento_mq >= 1000 AND haversine_km(latitudine, longitudine, 1, 2) < 3"
    r = C.validate(spark, good, c, frame.columns)
    assert r.valid and r.hard_kept and r.location_kept and not r.extra
    r = C.validate(spark, "SELECT * FROM E WHERE note = 'a' AND bogus = 2", c, frame.columns)
    assert not r.valid and r.extra == ["bogus", "note"] and r.missing and not r.typology_kept and not r.location_kept and r.invalid_columns == ["bogus"]
    r = C.validate(spark, good, c, frame.columns, {"property_type": ["home"]})
    assert r.invalid_values == [("property_type", "office")] and r.valid and not r.grounded
    assert not C.validate(spark, "SELEC nothing", c, frame.columns).parsed


def test_conjunct_rows(spark):
    got = C.conjunct_rows(spark, "SELECT * FROM E WHERE a > 1 AND (b = 2 OR c = 3) AND lat BETWEEN 1 AND 2")
    assert got[0]["columns"] == ["a"] and got[1]["columns"] == ["b", "c"] and got[-1]["kind"] == "geo"


def test_guard_and_clean():
    assert engine.guard("SELECT 'drop table' FROM x") is None
    assert engine.guard("WITH a AS (SELECT 1) SELECT * FROM a") is None
    assert engine.guard("DROP TABLE x") and engine.guard("SELECT 1; DELETE FROM x")
    assert engine.clean_sql("<think>select</think>```sql\nSELECT ';' AS a -- c\nFROM t; DROP x```") == "SELECT ';' AS a \nFROM t"
    assert engine.clean_sql("SELECT 'a") == "SELECT 'a'"
    assert engine.to_spark_dialect("SELECT * EXCLUDE (a) FROM \"t\" WHERE b = '\"x//y\"' AND c // 2 = 1") == "SELECT * EXCEPT(a) FROM `t` WHERE b = '\"x//y\"' AND c  div  2 = 1"


def test_errors_come_back(spark, frame):
    rows, error = engine.run_sql(spark, "SELECT * FROM ESTATES WHERE surfce = 1", frame)
    assert rows is None and "surfce" in error
    assert engine.route(error, 0, 0, 0) == "retry" and engine.route(error, 0, 3, 0) == "fallback"
    assert engine.route(None, 3, 0, 0) == "relax" and engine.route(None, 0, 0, 3) == "fallback" and engine.route(None, 3, 0, 3) == "continue"


@pytest.mark.parametrize("enforce", [True, False])
def test_relaxation_keeps_hard_conditions(spark, enforce):
    df = spark.range(53).select(F.when(F.col("id") < 3, "office").otherwise("home").alias("kind"), F.lit(1500.0).alias("area"))
    parts = [engine.Conjunct("kind", F.col("kind") == "office", hard=True), engine.Conjunct("area", F.col("area") >= 2000, variants=(("low", F.col("area") >= 1800), ("medium", F.col("area") >= 1000)))]
    got = engine.relax(df, parts, enforce)
    # A drop is compared with the first count, as a weaker level is, not with the best so far.
    assert got.levels == (("asked", "dropped") if enforce else ("dropped", "dropped"))
    assert got.rows == (3 if enforce else 53)
    assert df.where(got.condition).count() == got.rows


def greedy(rows, conjuncts, enforce, enough):
    """The search by its sentence, with every trial counted over the rows. conjuncts: (hard, [tests from asked on])."""
    count = lambda levels: sum(all(k == 4 or tests[k](r) for k, (_, tests) in zip(levels, conjuncts, strict=True)) for r in rows)
    now = [0] * len(conjuncts)
    first = n = count(now)
    for level in (1, 2, 3, 4):
        for i in range(len(conjuncts) - 1, -1, -1):
            if n >= enough or (enforce and conjuncts[i][0]) or (level < 4 and level not in range(len(conjuncts[i][1]))):
                continue
            trial = [*now[:i], level, *now[i + 1 :]]
            if (m := count(trial)) >= enough or m > first:
                now, n = trial, m
    return now, n


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("most", [100_000, 3])
def test_relaxation_of_many_conditions(spark, monkeypatch, seed, most):
    """Eight conditions of three levels each, counted here or where the rows are, against the search by its sentence."""
    monkeypatch.setattr(engine, "counter", lambda counts, f=engine.counter: f(counts, most))
    rng = random.Random(seed)
    rows = [tuple(rng.randint(0, 99) for _ in range(8)) for _ in range(250)]
    limits = [sorted(rng.sample(range(5, 95), 4), reverse=True) for _ in range(8)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(8)))
    parts = [engine.Conjunct(f"c{i}", F.col(f"c{i}") >= t[0], hard=i in (0, 5), variants=tuple((level, F.col(f"c{i}") >= x) for level, x in zip(engine.LEVELS, t[1:], strict=True))) for i, t in enumerate(limits)]
    enforce, enough = seed % 2 == 0, (10, 60, 150, 30)[seed]
    got = engine.relax(df, parts, enforce, enough)
    want, n = greedy(rows, [(i in (0, 5), [lambda r, i=i, x=x: r[i] >= x for x in t]) for i, t in enumerate(limits)], enforce, enough)
    assert [("asked", *engine.LEVELS, "dropped").index(x) for x in got.levels] == want and got.rows == n == df.where(got.condition).count()


def test_fallback_order(spark, frame):
    c = sample()
    rows, source = engine.deterministic(frame, c)
    assert source == "all" and rows.count() == 1
    c.entries[1].value = 9e9
    assert engine.deterministic(frame, c)[1] == "hard"
    c.entries[0].value = ["castle"]
    assert engine.deterministic(frame, c) == (None, None)
