"""Evaluation metrics over stored results: set overlaps, confusion counts, consistency, consensus, latency, gold recall."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from parcelspark.operators.stats import quantiles, with_mean_rank


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 1 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def set_scores(expected: Column, found: Column) -> Column:
    """A struct (precision, recall, f1) of a found set against the expected one, 3 decimals; all 0 without an expected one."""
    both, e, f = F.size(F.array_intersect(expected, found)), F.size(F.array_distinct(expected)), F.size(F.array_distinct(found))
    ratio = lambda n: F.when((e > 0) & (n > 0), both / n).otherwise(0.0)
    f1 = F.when(both > 0, 2 * both / (e + f)).otherwise(0.0)
    return F.struct(F.bround(ratio(f), 3).alias("precision"), F.bround(ratio(e), 3).alias("recall"), F.bround(f1, 3).alias("f1"))


def set_f1(expected: Column, found: Column) -> Column:
    return set_scores(expected, found)["f1"]


def pairs_within(df: DataFrame, group: str, key: str, items: str) -> DataFrame:
    """(group, a, b, iou) of each pair of sets within a group (trials of a query: few). Sets are counted once each, so that
    a pair costs one intersection. The result has as many rows as pairs, which a hot group's join shares among tasks. Both
    sides of the join have the same columns, so that Spark makes the sets and deals them out once, not once a side."""
    own = df.select(F.col(group).alias("__g"), F.col(key).alias("__k"), F.array_distinct(items).alias("__x")).withColumn("__n", F.size("__x"))
    both = F.size(F.array_intersect("x.__x", "y.__x"))
    pairs = own.alias("x").join(own.alias("y"), F.expr("x.__g = y.__g AND x.__k < y.__k"))
    pairs = pairs.select(F.col("x.__g").alias(group), F.col("x.__k").alias("a"), F.col("y.__k").alias("b"), both.alias("__b"), F.expr("x.__n + y.__n").alias("__s"))
    return pairs.select(group, "a", "b", F.when(F.col("__s") == 0, 1.0).otherwise(F.col("__b") / (F.col("__s") - F.col("__b"))).alias("iou"))


def overlap_pairs(df: DataFrame, key: str, item: str, most: int = 32) -> DataFrame:
    """(a, b, iou) of all pairs of sets that share an item, from (key, item) rows: through the items, without a cross
    product. Pairs that share nothing have 0 and are not listed; averages over all pairs divide by their number.

    Each item of a set of up to `most` items takes the others along, so that two sets that meet at an item are compared
    there and then, and only their smallest shared item gives the row: what is dealt out are the items, not the pairs. Both
    sides of the join have the same columns, so that it is dealt out once. Pairs with a larger set are counted by item.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(item).alias("__i"))
    if isinstance(df.schema[item].dataType, LongType):  # half as many bytes, where all numbers allow it
        low, high = df.agg(F.min(item), F.max(item)).first()
        if low is not None and low >= -(1 << 31) and high < 1 << 31:
            rows = rows.withColumn("__i", F.col("__i").cast("int"))
    longest = rows.groupBy("__k").agg(F.count("__i").alias("__n")).agg(F.max("__n")).first()[0] or 0
    # A missing item is one of its set, but shared with none.
    sets = rows.groupBy("__k").agg(F.array_sort(F.collect_set("__i")).alias("__x"), F.max(F.col("__i").isNull().cast("int")).alias("__e"))
    own = sets.where(F.size("__x") <= most).select("__k", "__x", "__e", F.explode("__x").alias("__i")).select("__k", "__i", "__e", F.array_remove("__x", F.col("__i")).alias("__x"))
    both, others = F.array_intersect("x.__x", "y.__x"), F.arrays_overlap("x.__x", "y.__x")  # mostly nothing, which is told sooner
    met = own.alias("x").join(own.alias("y").hint("shuffle_merge"), F.expr("x.__i = y.__i AND x.__k < y.__k") & (~others | (F.get(both, F.lit(0)) > F.col("x.__i"))))
    more, sizes = F.when(others, F.size(both)).otherwise(0), F.expr("size(x.__x) + x.__e + size(y.__x) + y.__e + 2")
    pairs = met.select(F.col("x.__k").alias("a"), F.col("y.__k").alias("b"), (more + 1).cast("long").alias("__s"), sizes.alias("__n"))
    if longest > most:
        items = sets.select("__k", (F.size("__x") + F.col("__e")).alias("__n"), (F.size("__x") > most).alias("__large"), F.explode("__x").alias("__i"))
        met = items.where("__large").alias("x").join(items.alias("y").hint("shuffle_merge"), F.expr("x.__i = y.__i AND (x.__k < y.__k OR (x.__k > y.__k AND NOT y.__large))"))
        by = met.groupBy(F.expr("least(x.__k, y.__k)").alias("a"), F.expr("greatest(x.__k, y.__k)").alias("b"))
        pairs = pairs.unionByName(by.agg(F.count("*").alias("__s"), F.first(F.expr("x.__n + y.__n")).alias("__n")))
    return pairs.select("a", "b", (F.col("__s") / (F.col("__n") - F.col("__s"))).alias("iou"))


def overlap_counts(df: DataFrame, group: str, key: str, items: str, most: int = 12) -> DataFrame:
    """(group, both, sizes, pairs): the number of pairs within a group that share `both` items and whose sizes add up to
    `sizes`, for figures over all pairs without a row for each. Keys are distinct within a group; a null set is in no pair.

    Equal sets count together. A set of n items then goes the way that costs less, its 2^n subsets (up to `most` items)
    or the d distinct sets of its group. Sets that hold a subset of k items, squared and summed over all subsets, count
    each pair once for every k of its shared items, from which the numbers by shared items follow exactly. The other
    sets meet all of the group one by one.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(items).isNotNull())
    sets = rows.select(group, F.array_sort(F.array_distinct(items)).alias("__x")).groupBy(group, "__x").agg(F.count("*").alias("__c"))
    many = sets.groupBy(group).agg(F.count("*").alias("__d"))
    n = F.size("__x")
    sets = sets.join(many, group).select(group, "__x", "__c", n.alias("__n"), ((n <= most) & (F.pow(F.lit(2.0), n) <= F.col("__d"))).alias("__way"))
    small = sets.where("__way")
    none = F.array(F.slice("__x", 1, 0))
    subsets = F.aggregate("__x", none, lambda acc, x: F.concat(acc, F.transform(acc, lambda s: F.concat(s, F.array(x)))))
    held = small.select(group, "__n", "__c", F.explode(subsets).alias("__t")).groupBy(group, "__t")
    by = held.agg(*[F.sum(F.when(F.col("__n") == i, F.col("__c")).otherwise(0)).alias(f"__h{i}") for i in range(most + 1)])
    both = lambda t: reduce(lambda a, b: a + b, [F.col(f"__h{i}") * F.col(f"__h{t - i}") for i in range(max(0, t - most), min(t, most) + 1)])
    squares = by.groupBy(group, F.size("__t").alias("__k")).agg(*[F.sum(both(t)).alias(f"__p{t}") for t in range(2 * most + 1)])
    squares = squares.select(group, "__k", F.inline(F.array(*[F.struct(F.lit(t).alias("sizes"), F.col(f"__p{t}").alias("__p")) for t in range(2 * most + 1)]))).where("__p > 0")
    signed = F.array(*[F.array(*[F.struct(F.lit(s).alias("both"), F.lit((-1) ** (k - s) * math.comb(k, s)).cast("long").alias("f")) for s in range(k + 1)]) for k in range(most + 1)])
    parts = squares.select(group, "sizes", "__p", F.inline(F.get(signed, F.col("__k")))).select(group, "both", "sizes", (F.col("f") * F.col("__p")).alias("pairs"))
    self_pairs = small.groupBy(group, "__n").agg(F.sum("__c").alias("__c")).select(group, F.col("__n").alias("both"), (2 * F.col("__n")).alias("sizes"), (-F.col("__c")).alias("pairs"))
    ordered = parts.unionByName(self_pairs).groupBy(group, "both", "sizes").agg(F.sum("pairs").alias("pairs"))
    a = sets.where("not __way").select(group, "__x", "__n", "__c")
    b = sets.select(group, F.col("__x").alias("__y"), F.col("__n").alias("__m"), F.col("__c").alias("__e"), "__way")
    number = F.when(~F.col("__way") & (F.col("__x") == F.col("__y")), F.expr("__c * (__c - 1) div 2")).otherwise(F.col("__c") * F.col("__e"))
    plain = a.join(b, group).where(F.col("__way") | (F.col("__x") <= F.col("__y"))).select(group, F.size(F.array_intersect("__x", "__y")).alias("both"), (F.col("__n") + F.col("__m")).alias("sizes"), number.alias("pairs"))
    every = ordered.select(group, "both", "sizes", F.expr("pairs div 2").alias("pairs")).unionByName(plain)
    return every.groupBy(group, "both", "sizes").agg(F.sum("pairs").alias("pairs")).where("pairs > 0")


def _mean_overlap() -> Column:
    """The mean overlap of pairs from (both, sizes, pairs)."""
    each = F.when(F.col("sizes") == 0, 1.0).otherwise(F.col("both") / (F.col("sizes") - F.col("both")))
    return F.sum(each * F.col("pairs")) / F.sum("pairs")


def self_consistency(df: DataFrame, group: str, key: str, items: str) -> DataFrame:
    """One row: the mean over groups of the mean pair overlap within the group, and the number of groups with pairs."""
    per = overlap_counts(df, group, key, items).groupBy(group).agg(_mean_overlap().alias("m"))
    return per.agg(F.avg("m").alias("consistency"), F.count("*").alias("groups"))


def ranking_impact(df: DataFrame, group: str, key: str, items: str) -> DataFrame:
    """One row over all pairs within groups: 1 - mean overlap, and the share of pairs that share nothing."""
    nothing = F.sum(F.when((F.col("both") == 0) & (F.col("sizes") > 0), F.col("pairs")).otherwise(0))
    return overlap_counts(df, group, key, items).agg((1 - _mean_overlap()).alias("impact"), (nothing / F.sum("pairs")).alias("zero_share"))


def consensus(df: DataFrame, group: str, trial: str, signature: str) -> DataFrame:
    """(group, signature, votes, trial): the most frequent signature and its first trial; ties to the earliest trial."""
    votes = df.groupBy(group, signature).agg(F.count("*").alias("votes"), F.min(trial).alias("trial"))
    best = votes.groupBy(group).agg(F.min(F.struct((-F.col("votes")).alias("v"), "trial", signature)).alias("m"))
    return best.select(group, F.col(f"m.{signature}").alias(signature), (-F.col("m.v")).alias("votes"), F.col("m.trial").alias("trial"))


def confusion(df: DataFrame, expected: Column, found: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (3 decimals; 0 where undefined), in all or by group."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    agg = (df.groupBy(*by) if by else df.groupBy()).agg(n(expected & found).alias("tp"), n(~expected & found).alias("fp"), n(expected & ~found).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = agg.withColumns({"__p": p, "__r": r}).withColumn("__f", ratio(2 * F.col("__p") * F.col("__r"), F.col("__p") + F.col("__r")))
    return out.withColumns({"precision": F.round("__p", 3), "recall": F.round("__r", 3), "f1": F.round("__f", 3)}).drop("__p", "__r", "__f")


def activation(queries: DataFrame, expected: str, found: str) -> DataFrame:
    """One row from (query, expected set, found set): perfect-match rate, mean overlap, mean F1."""
    e, g = F.array_sort(F.array_distinct(expected)), F.array_sort(F.array_distinct(found))
    return queries.agg(F.avg((e == g).cast("int")).alias("perfect_rate"), F.avg(iou(F.col(expected), F.col(found))).alias("jaccard"), F.avg(set_f1(F.col(expected), F.col(found))).alias("f1"))


def phrases_in(texts: DataFrame, phrases: DataFrame, text: str = "text", phrase: str = "phrase", key: str = "id", block_chars: int = 1 << 20) -> DataFrame:
    """(id, phrase_id) where a text contains a phrase, in lower case, anywhere; the empty phrase is in every text.

    Phrases are the query set: they are taken in blocks of about block_chars characters, so that what a worker holds is
    bounded, and each block passes once over the texts, in which one automaton finds all its phrases at once. A null
    text or phrase has no row; repeated rows of either give repeated rows.
    """
    rows = phrases.select("phrase_id", F.lower(phrase).alias("__p")).where("__p is not null")
    chars = rows.agg(F.sum(F.length("__p") + 1)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    given = texts.select(F.col(key).alias("id"), F.lower(text).alias("__t")).where("__t is not null")
    kind = phrases.schema["phrase_id"].dataType
    schema = StructType([StructField("id", given.schema["id"].dataType), StructField("phrase_id", kind)])
    out = []
    for block in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("phrase_id", "__p"), F.lit(blocks)) == block).collect()  # about block_chars characters
        found: dict[str, list] = {}
        for r in some:
            found.setdefault(r["__p"], []).append(r["phrase_id"])
        if found:
            out.append(given.mapInArrow(_finder(found, to_arrow_type(kind)), schema))
    return reduce(lambda a, b: a.unionByName(b), out) if out else texts.sparkSession.createDataFrame([], schema)


def _finder(found: dict[str, list], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each text the phrases in it, by an Aho-Corasick automaton that each task builds once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in found:
            if p:
                automaton.add_word(p, p)
        automaton.make_automaton()
        always = found.get("", [])
        for b in batches:
            at, ids = [], []
            for i, t in enumerate(b.column(1)):
                hits = {p for _, p in automaton.iter(t.as_py())} if len(automaton) else ()
                own = [x for p in hits for x in found[p]] + always
                at += [i] * len(own)
                ids += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ids, kind)], ["id", "phrase_id"])

    return run


def gold_recall(expected: DataFrame, captured: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, expected, captured, recall) from expected and captured (query, column, operator) rows."""
    c = captured.select(query, "column", "operator").distinct().withColumn("__hit", F.lit(1))
    per = expected.join(c, [query, "column", "operator"], "left").groupBy(query).agg(F.count("*").alias("expected"), F.sum(F.coalesce("__hit", F.lit(0))).alias("captured"))
    return per.withColumn("recall", F.col("captured") / F.col("expected"))


def recall_totals(per_query: DataFrame) -> DataFrame:
    return per_query.agg((F.sum("captured") / F.sum("expected")).alias("micro"), F.avg("recall").alias("macro"))


def latency(df: DataFrame, ms: str, by: list[str] | None = None) -> DataFrame:
    """(by, mean_ms, median_ms, n) of a column of milliseconds; groups without a value are left out."""
    rows = df.select(*(by or []), F.col(ms).cast("double").alias("__ms")).where("__ms is not null")
    plain = rows.groupBy(*(by or [])).agg(F.avg("__ms").alias("mean_ms"), F.count("*").alias("n"))
    middle = quantiles(rows, by or [], "__ms", {"median_ms": 0.5})
    if not by:
        return plain.join(F.broadcast(middle)).select("mean_ms", "median_ms", "n")  # one row
    m = middle.toDF(*[f"__{c}" for c in by], "median_ms")
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return plain.join(m, on).select(*by, "mean_ms", "median_ms", "n")


def rank_correlation(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """(by, n, rho): Spearman's correlation within each group, ties sharing their mean rank."""
    rows = df.select(*by, F.col(x).cast("double").alias("__vx"), F.col(y).cast("double").alias("__vy")).where("__vx is not null and __vy is not null")
    ranked = with_mean_rank(with_mean_rank(rows, by, "__vx", "__x"), by, "__vy", "__y")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), F.corr("__x", "__y").alias("rho"))


def out_of_domain(literals: DataFrame, stats: DataFrame) -> DataFrame:
    """(column, value, ood, distance, tightness) of query literals against their column's range, which counts as 1 at least.

    distance: how far outside, as a share of the range; tightness: the place within the range, from 0 to 1, and below or
    above that outside.
    """
    j = literals.join(F.broadcast(stats), "column")  # one row for each column
    span = F.greatest(F.col("max") - F.col("min"), F.lit(1.0))
    off = F.greatest(F.col("min") - F.col("value"), F.col("value") - F.col("max"), F.lit(0.0))
    return j.select("column", "value", (off > 0).alias("ood"), (off / span).alias("distance"), ((F.col("value") - F.col("min")) / span).alias("tightness"))


def ood_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(F.col("ood").cast("int")).alias("rate"), F.avg(F.when(F.col("ood"), F.col("distance"))).alias("severity"), F.avg(F.when(~F.col("ood"), F.col("tightness"))).alias("tightness"))


def stability(samples: DataFrame, k: int) -> DataFrame:
    """samples with a label: BIAS if never found in k runs, STABLE if in all, else VARIANCE."""
    label = F.when(F.col("appeared") == 0, "BIAS").when(F.col("appeared") == k, "STABLE").otherwise("VARIANCE")
    return samples.withColumn("label", label)


def domain_coverage(df: DataFrame, columns: str, domains: dict[str, list[str]]) -> DataFrame:
    """One row: the mean share of domains of which a row's columns name one."""
    hit = [F.when(F.arrays_overlap(F.col(columns), F.array(*[F.lit(c) for c in cs])), 1).otherwise(0) for cs in domains.values()]
    return df.agg(F.avg(sum(hit[1:], hit[0]) / len(hit)).alias("coverage"))


def run_summary(df: DataFrame, energy_class: str = "energy_class") -> DataFrame:
    """One row: rows, those with a class, those of the two worst classes, their percentages, and a histogram as a map."""
    c = F.col(energy_class)
    counts = df.groupBy(c.alias("k")).agg(F.count("*").alias("n"))
    n = lambda t: F.sum(F.when(t, F.col("n")).otherwise(0))
    out = counts.agg(
        F.sum("n").alias("total"), n(F.col("k").isNotNull()).alias("with_epc"), n(F.col("k").isin("F", "G")).alias("worst"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n"))))).alias("classes"),
    )
    pct = lambda a: F.round(100 * F.col(a) / F.col("total"), 1)
    return out.withColumns({"with_epc_pct": pct("with_epc"), "worst_pct": pct("worst")})


def layer_counters(runs: DataFrame) -> DataFrame:
    """One row of sums over runs: entries, failures, rendered, skipped, repaired (arrays of each run)."""
    return runs.agg(*[F.sum(F.size(c)).alias(f"n_{c}") for c in ("entries", "failures", "rendered", "skipped")], F.avg(F.col("valid").cast("int")).alias("valid_rate"))


def query_combinations(spark: SparkSession, lists: Sequence[Sequence[str]], partial: bool) -> DataFrame:
    """(text) of all sentences from option lists: one of the first list, one (with partial: or none) of each other.

    The lists are literals, so this is one row exploded once for each list.
    """
    out = spark.range(1).select(F.lit("").alias("text"))
    for i, choices in enumerate(lists):
        each = F.array(*[F.lit(c) for c in choices], *[F.lit(None).cast("string")] * (partial and i > 0))
        out = out.select("text", F.explode(each).alias("__c")).select(F.concat_ws(" ", F.nullif(F.col("text"), F.lit("")), "__c").alias("text"))
    return out


def edges_by_line(stations: DataFrame, part: str | None = None) -> DataFrame:
    """(a, b, lines): neighbours in the order of each line, the lines of one edge merged.

    part: a column that never falls as position rises. Each part of a line is ordered by itself and only its two ends,
    one row, meet those of the next part, so that no task gets a whole line.
    """
    s = stations.select("line", "name", "position", (F.col(part) if part else F.lit(0)).alias("__part"))
    prev = F.lag("name").over(Window.partitionBy("line", "__part").orderBy("position"))
    inside = s.select("line", prev.alias("p"), F.col("name").alias("q"))
    ends = s.groupBy("line", "__part").agg(F.min_by("name", "position").alias("q"), F.max_by("name", "position").alias("__last"))
    across = ends.select("line", F.lag("__last").over(Window.partitionBy("line").orderBy("__part")).alias("p"), "q")
    e = inside.unionByName(across).where("p is not null and p <> q")
    return e.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.concat_ws("/", F.array_sort(F.collect_set("line"))).alias("lines"))
