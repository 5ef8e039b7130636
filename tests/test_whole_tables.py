"""Registered queries against brute force on small tables whose ids no fixed range or remainder selects."""

import random
from collections import Counter
from datetime import datetime
from itertools import combinations

import pytest

from parcelspark.operators import metrics, spatial
from parcelspark.plans.registry import QUERIES

LINES = [(k, n, k * 7 % 11 + n, "ANR"[k % 3], "FO"[n % 2], 100.0 * n + k) for k in range(1001, 1031) for n in range(1, k % 4 + 2)]
DDL = {
    "lineitem": "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string, l_linestatus string, l_extendedprice double",
    "documents": "doc_id long, text string",
    "benchmark": "item_id long, text string",
    "events": "event_id long, user_id long, event_type string, ts timestamp, value double",
    "orders": "o_orderkey long, o_custkey long",
    "customer": "c_custkey long",
    "part": "p_partkey long, p_name string, p_type string, p_size int, p_brand string",
}
ROWS = {
    "lineitem": LINES,
    "orders": [(k, k % 4 + 150 * (k % 2)) for k in range(1001, 1031)],
    "part": [(k, "small ring", "ECONOMY", k % 50 + 1, "Brand") for k in (*range(1, 21), 1228)],
    "documents": [(1, "He wrote (Ab. Then a second sentence.) there"), (2, "Ab. Then a third sentence."), (3, "no dots at all, long enough to be kept")],
    "benchmark": [(1, "Ab. Then a second sentence."), (2, "Dots at all"), (3, "third"), (4, "no dots at all, long enough to be kept. But more")],
    "events": [(k, u, "view", datetime(2024, 1, 1), 1.0) for k, u in (*enumerate((1, 2, 1, 2, 5, 2, 1, 1, 3, 2, 98)), (7001, 60), (7003, 1))],
    "customer": [(28,), (9,)],
}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("whole")
    for name, ddl in DDL.items():
        spark.createDataFrame(ROWS[name], ddl).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def run(spark, sf, name):
    return [tuple(r) for r in QUERIES[name](spark, sf).collect()]


def iou(a, b):
    return len(a & b) / len(a | b)


def test_run_semi_join(spark, sf):
    got = {r[0] for r in run(spark, sf, "run_semi_join")}
    assert got == {str(x[2]) for x in LINES} & {str(x[0]) for x in ROWS["part"]} and len(got) > 5


def test_rankings(spark, sf):
    items = {}
    for x in LINES:
        items.setdefault(x[0], set()).add(x[2] % 40)
    cust = dict(ROWS["orders"])
    pairs = [(cust[a] % 150, a, b, iou(items[a], items[b])) for a, b in combinations(sorted(items), 2) if cust[a] % 150 == cust[b] % 150]
    assert sorted(run(spark, sf, "set_iou_pairs")) == [(g, a, b, round(v, 4)) for g, a, b, v in sorted(pairs)]
    by = {g: [p[3] for p in pairs if p[0] == g] for g in {p[0] for p in pairs}}
    assert run(spark, sf, "self_consistency") == [(pytest.approx(sum(sum(v) / len(v) for v in by.values()) / len(by), abs=1e-6), len(by))]
    mean, none = sum(p[3] for p in pairs) / len(pairs), sum(p[3] == 0 for p in pairs) / len(pairs)
    assert run(spark, sf, "ranking_impact") == [(pytest.approx(1 - mean, abs=1e-6), pytest.approx(none, abs=1e-6))]


def test_pairs_make_their_sets_once(spark, sf):
    """both sides of the join read one shuffle, or the sets would be made, and fill the disk, twice."""
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        plan = QUERIES["set_iou_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert plan.count("partial_collect_set") == 1 and plan.count("ReusedExchange") == 1, plan


def test_pairs_of_odd_sets(spark):
    rows = [(1, "k1", [1, 1, 2]), (1, "k2", [2, 3]), (1, "k3", []), (1, "k4", []), (1, "k5", None), (2, "k6", [1]), (None, "k7", [1]), (None, "k8", [1]), (1, None, [1])]
    got = metrics.pairs_within(spark.createDataFrame(rows, "q int, name string, ids array<int>"), "q", "name", "ids")
    assert got.columns == ["q", "a", "b", "iou"]
    want = {(1, "k1", "k2", 1 / 3), (1, "k1", "k3", 0.0), (1, "k1", "k4", 0.0), (1, "k2", "k3", 0.0), (1, "k2", "k4", 0.0), (1, "k3", "k4", 1.0), *((1, f"k{i}", "k5", None) for i in range(1, 5))}
    assert {tuple(r) for r in got.collect()} == want


def test_shared_item_pairs(spark, sf):
    items = {}
    for x in LINES:
        items.setdefault(x[0], set()).add(x[2])
    want = [(a, b, round(iou(items[a], items[b]), 4)) for a, b in combinations(sorted(items), 2) if items[a] & items[b]]
    assert sorted(run(spark, sf, "shared_item_pairs")) == want


def test_graph_edges_lag(spark, sf):
    edges = {}
    for line in {x[3] + x[4] for x in LINES}:
        names = [x[2] % 50 for x in sorted(LINES) if x[3] + x[4] == line]
        for p, q in zip(names, names[1:], strict=False):
            if p != q:
                edges.setdefault((min(p, q), max(p, q)), set()).add(line)
    assert sorted(run(spark, sf, "graph_edges_lag")) == sorted((a, b, "/".join(sorted(v))) for (a, b), v in edges.items())


@pytest.mark.parametrize("part", [None, "part"])
def test_edges_over_parts(spark, part):
    """Parts of one row, of several, and missing ones; equal names beside each other; null names."""
    names = [3, 3, 1, None, 2, 5, 5, 4, 1, 2, 2, 7]
    rows = [(line, n, i, i * i // 10) for line in "xy" for i, n in enumerate(names)]
    got = metrics.edges_by_line(spark.createDataFrame(rows, "line string, name int, position int, part int").repartition(5), part).collect()
    want = {(min(p, q), max(p, q), "x/y") for p, q in zip(names, names[1:], strict=False) if p and q and p != q}
    assert sorted(map(tuple, got)) == sorted(want)


def test_ood_tightness(spark, sf):
    got = sorted(r[:2] for r in run(spark, sf, "ood_tightness"))
    sizes = [10.0 * x[3] for x in ROWS["part"]]
    values = [10.0 * (k % 70) for k, _ in ROWS["orders"]]
    assert got == sorted((v, not min(sizes) <= v <= max(sizes)) for v in values)


def test_address_match_score(spark, sf):
    """Customer 28 asks for the street, number and city that only part 1228 has; 9 finds none of its street."""
    assert sorted(run(spark, sf, "address_match_score")) == [(28, 550)]


def test_phrase_contains_join(spark, sf):
    want = [(d, i) for d, t in ROWS["documents"] for i, p in ROWS["benchmark"] if p.lower() in t.lower()]
    assert sorted(run(spark, sf, "phrase_contains_join")) == want == [(1, 1), (2, 3), (3, 2)]


def test_feedback_upsert(spark, sf):
    """Old rows are those of ids below half the count, at any size; the newest id of a key is that of the new side."""
    last = {(u % 97, f"agent{k % 5}" if k % 3 == 0 else None): k for k, u, *_ in ROWS["events"]}
    got = run(spark, sf, "feedback_upsert")
    assert sorted(got, key=str) == sorted([(*key, k) for key, k in last.items()], key=str)
    assert any(2 * k < len(ROWS["events"]) for *_, k in got) and any(2 * k >= len(ROWS["events"]) for *_, k in got)


def test_sub_properties_explode(spark, sf):
    """All four units of a parcel, as the bound is the first 20."""
    parcels = {}
    for k, _, _, size, _ in ROWS["part"]:
        parcels.setdefault(str(k // 4), []).append((str(k), 10.0 * size))
    want = [(p, len(u), min(s for _, s in u), ",".join(sorted(i for i, _ in u))) for p, u in parcels.items()]
    got = run(spark, sf, "sub_properties_explode")
    assert sorted(got) == sorted(want) and max(n for _, n, *_ in got) == 4


def test_overlap_counts(spark):
    """Pairs by shared items and sizes: copies, empty, null and large sets, a small group, and a group of 2 * 10^10 pairs."""
    rng = random.Random(3)
    few = [("a", k, rng.sample(range(6), rng.randint(0, 4)) + [1] * (k % 2)) for k in range(60)]
    large = [("b", k, rng.sample(range(40), rng.choice((1, 2, 14, 20)))) for k in range(40)]
    rows = [*few, *large, ("b", 99, large[0][2]), ("c", 1, [1, 2, 3]), ("c", 2, [3, 4]), ("d", 1, [1]), ("e", 1, None), ("e", 2, [1]), (None, 1, [1]), (None, 2, [1]), ("f", None, [1]), ("f", 1, [None, 1]), ("f", 2, [None])]
    df = spark.createDataFrame(rows, "g string, k long, items array<long>")
    want = Counter()
    for (g, i, x), (h, j, y) in combinations(rows, 2):
        if g is not None and g == h and None not in (i, j) and x is not None and y is not None:
            want[g, len(set(x) & set(y)), len(set(x)) + len(set(y))] += 1
    assert {(r.g, r.both, r.sizes): r.pairs for r in metrics.overlap_counts(df, "g", "k", "items").collect()} == dict(want)
    own = spark.range(200_000).selectExpr("'g' AS g", "id AS k", "filter(sequence(0, 5), i -> (id >> i) % 2 = 1) AS items")
    sets = Counter(sum(1 << i for i in range(6) if k >> i & 1) for k in range(200_000))
    zero = sum(n * m for a, n in sets.items() for b, m in sets.items() if a < b and not a & b)
    got = metrics.ranking_impact(own, "g", "k", "items").first()
    assert got.zero_share == pytest.approx(zero / (200_000 * 199_999 / 2), abs=1e-12)


def test_nearest_of_shared_places(spark):
    """rows and points that share places, ties to the smaller point, and no broadcast of points listed in cells."""
    homes = [(45.0, 7.0), (45.01, 7.0), (45.2, 7.3), (None, 7.0), (46.0, 8.0)]
    shops = [(45.001, 7.0), (45.01, 7.001), (45.2, 7.34), (45.0, None)]
    rows = [(f"r{i}", *homes[i % 5]) for i in range(40)]
    points = [(100 - i, *shops[i % 4]) for i in range(40)]
    near = spatial.nearest_row(spark.createDataFrame(rows, "id string, latitude double, longitude double"), spark.createDataFrame(points, "poi_id long, lat double, lon double"), 5.0)
    least = [min(k for k, *at in points if tuple(at) == s) for s in shops]
    got = near.collect()
    assert sorted((r.id, r.poi_id) for r in got) == sorted((f"r{i}", least[i % 5]) for i in range(40) if i % 5 < 3)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan, plan


def test_overlaps_of_odd_sets(spark):
    """small and large sets, repeated rows, missing items and keys, numbers beyond an int; nothing is dealt out by pair
    while no set is large."""
    rng = random.Random(5)
    rows = [(k, rng.randrange(60)) for k in range(40) for _ in range(rng.randint(1, 9))]
    rows += [(k, i) for k in (3, 50, 51) for i in range(k % 7, 45)] + [(k, None) for k in (1, 2, 50, 60)] + [(None, 1), (None, 2), *rows[:9]]
    for far in (0, 1 << 40):
        sets = {k: {i if i is None else i + far for j, i in rows if j == k} for k, _ in rows if k is not None}
        want = {(a, b): len((sets[a] & sets[b]) - {None}) / (len(sets[a]) + len(sets[b]) - len((sets[a] & sets[b]) - {None})) for a, b in combinations(sorted(sets), 2) if (sets[a] & sets[b]) - {None}}
        df = spark.createDataFrame([(k, i if i is None else i + far) for k, i in rows], "k long, i long")
        for most in (2, 32, 100):
            got = metrics.overlap_pairs(df, "k", "i", most).collect()
            assert len(got) == len(want) and {(r.a, r.b): r.iou for r in got} == pytest.approx(want)
    few = spark.createDataFrame([(k, i) for k, i in rows if k and k < 3], "k long, i long")
    plan = metrics.overlap_pairs(few, "k", "i")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [a" not in plan and plan.count("Join Inner") == 1, plan
