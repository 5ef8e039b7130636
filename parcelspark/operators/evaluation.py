"""Evaluation of stored runs: judged answers, replays, activated domains, ablations, ranks against contributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelspark.operators.metrics import iou, rank_correlation
from parcelspark.schema import DIMENSIONS

# Columns that stand for a domain in a query.
DOMAIN_COLUMNS = {
    "energy": ("classe_energetica_ape", "epglnren_ape"),
    "location": ("indirizzo", "latitudine", "longitudine"),
    "proximity": ("sanita", "mobilita", "verde", "sport"),
    "regulatory": ("superficie_di_riferimento_mq", "tipologia_bene_immobile"),
    "building": ("epoca_costruzione", "id"),
}


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def judge_means(judged: DataFrame) -> DataFrame:
    """One row from answers with arrays `pros` and `cons` of (accuracy, relevance): the number of answers, the share of
    accurate and of relevant entries of each kind, 3 decimals, and the means of the two kinds. Null counts as no."""
    out = {}
    for kind in ("pros", "cons"):
        for what in ("accuracy", "relevance"):
            out[f"{what}_{kind}"] = F.round(ratio(F.sum(_yes(kind, what)), F.sum(F.coalesce(F.greatest(F.size(kind), F.lit(0)), F.lit(0)))), 3)
    row = judged.agg(F.count("*").alias("samples"), *[c.alias(n) for n, c in out.items()])
    return row.withColumns({f"{what}_avg": F.round((F.col(f"{what}_pros") + F.col(f"{what}_cons")) / 2, 3) for what in ("accuracy", "relevance")})


def _yes(kind: str, what: str) -> Column:
    """How many entries of an array say yes."""
    return F.coalesce(F.greatest(F.size(F.filter(kind, lambda x: F.coalesce(x[what], F.lit(False)))), F.lit(0)), F.lit(0))


def replay_summary(runs: DataFrame, by: Sequence[str] = ("mode",)) -> DataFrame:
    """Replayed queries by mode: shares that are valid and that run, queries without a row, sums of faults and repairs, and a
    histogram of where the SQL came from (llm, where it isn't said)."""
    share = lambda c: F.round(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")), 2)
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("invalid_columns", "missing_hard", "repairs", "relax_hits", "relax_blocked")]
    plain = runs.groupBy(*by).agg(F.count("*").alias("n"), share("sql_valid").alias("valid_rate"), share("executes").alias("exec_rate"), F.sum((F.col("rows") == 0).cast("int")).alias("zero_row_queries"), *sums)
    source = runs.groupBy(*by, F.coalesce("sql_source", F.lit("llm")).alias("k")).agg(F.count("*").alias("v"))
    hist = source.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("sql_source"))
    return plain.join(hist, list(by))


def activated(columns: Column, domains: Mapping[str, Sequence[str]] = DOMAIN_COLUMNS) -> Column:
    """The sorted domains of an array of column names; a column may stand for several."""
    hit = [F.when(F.arrays_overlap(columns, F.array(*[F.lit(c) for c in cs])), F.lit(d)) for d, cs in domains.items()]
    return F.array_sort(F.array_compact(F.array(*hit)))


def activation_by_domain(queries: DataFrame, domains: Sequence[str], expected: str = "expected", found: str = "found") -> DataFrame:
    """(domain, tp, fp, fn, precision, recall, f1) over the queries that expect something; 3 decimals, 0 where undefined."""
    rows = queries.where(F.size(expected) > 0).select(expected, found, F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"))
    e, f = F.array_contains(expected, F.col("domain")), F.array_contains(found, F.col("domain"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    got = rows.groupBy("domain").agg(n(e & f).alias("tp"), n(~e & f).alias("fp"), n(e & ~f).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return got.withColumns({"precision": F.round(p, 3), "recall": F.round(r, 3), "f1": F.round(f1, 3)})


def activation_summary(queries: DataFrame, domains: Sequence[str], expected: str = "expected", found: str = "found") -> DataFrame:
    """One row: the share of queries whose domains are found exactly and their mean overlap, both of all queries, those
    that expect nothing too; and the means over the domains that are expected at least once."""
    some = F.size(expected) > 0
    e, f = F.array_sort(F.array_distinct(expected)), F.array_sort(F.array_distinct(found))
    share = lambda c: F.coalesce(F.round(F.sum(F.when(some, c).otherwise(0.0)) / F.count("*"), 3), F.lit(0.0))
    whole = queries.agg(share((e == f).cast("double")).alias("pmr"), share(iou(F.col(expected), F.col(found))).alias("mean_jaccard"))
    each = activation_by_domain(queries, domains, expected, found).where("tp + fn > 0")
    means = each.agg(*[F.coalesce(F.round(F.avg(c), 3), F.lit(0.0)).alias(f"mean_{c}") for c in ("precision", "recall", "f1")])
    return whole.join(F.broadcast(means))  # one row each


def paired(a: DataFrame, b: DataFrame, name: str = "file") -> DataFrame:
    """Runs of the same name from two folders, the columns of the second with `other_` before them."""
    return a.join(b.select(name, *[F.col(c).alias(f"other_{c}") for c in b.columns if c != name]), name)


def comparison(a: DataFrame, b: DataFrame, sets: Mapping[str, str], name: str = "file") -> DataFrame:
    """One row: for each (output name, array column) the mean overlap of the pairs, 3 decimals, and the number of pairs."""
    means = [F.coalesce(F.round(F.avg(iou(F.col(c), F.col(f"other_{c}"))), 3), F.lit(0.0)).alias(out) for out, c in sets.items()]
    return paired(a, b, name).agg(*means, F.count("*").alias("sample_size"))


def ablation(runs: DataFrame, config: str = "config", name: str = "file", items: str = "ids", full: str = "all_enabled") -> DataFrame:
    """(config, sensitivity): the mean overlap of each configuration's rankings with those of the full one for the same
    query; 1 where they share no query."""
    whole = runs.where(F.col(config) == full).select(name, F.col(items).alias("__full"))
    others = runs.where(F.col(config) != full)
    got = others.join(whole, name, "left").groupBy(config).agg(F.avg(F.when(F.col("__full").isNotNull(), iou(F.col("__full"), F.col(items)))).alias("m"))
    return got.select(config, F.coalesce("m", F.lit(1.0)).alias("sensitivity"))


def evaluation_rows(trace: DataFrame, run: str = "run", order: str = "position", items: str = "items") -> DataFrame:
    """A row for each evaluation of a batched step, numbered through the run from 0; a step without any keeps its own row."""
    each = trace.select("*", F.posexplode_outer(items).alias("__at", "item")).drop(items)
    number = F.row_number().over(Window.partitionBy(run).orderBy(order, F.col("__at").asc_nulls_first())) - 1
    return each.withColumn("batch_id", number).drop("__at")


def ranked_weights(runs: DataFrame, domains: Sequence[str] = DIMENSIONS, weights: str = "weights", found: str = "found", key: str = "run") -> DataFrame:
    """(run, rank, domain, contributed): the domains of each run by weight, of equals in their own order, without one as 0."""
    entry = lambda i, d: F.struct((-F.coalesce(F.try_element_at(weights, F.lit(d)), F.lit(0.0))).alias("w"), F.lit(i).alias("i"), F.lit(d).alias("domain"))
    order = F.array_sort(F.array(*[entry(i, d) for i, d in enumerate(domains)]))
    rows = runs.select(key, found, F.posexplode(order).alias("at", "x"))
    return rows.select(key, (F.col("at") + 1).alias("rank"), F.col("x.domain").alias("domain"), F.coalesce(F.array_contains(found, F.col("x.domain")), F.lit(False)).cast("int").alias("contributed"))


def contribution(ranked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ranked weights: the rank correlation with having contributed (0 where all did or none), the share by rank, and
    number and share by domain."""
    rho = rank_correlation(ranked.withColumn("one", F.lit(0)), "rank", "contributed", ["one"]).select(F.round(F.coalesce(F.nanvl("rho", F.lit(0.0)), F.lit(0.0)), 4).alias("rho"), "n")
    by_rank = ranked.groupBy("rank").agg(F.avg("contributed").alias("rate"))
    by_domain = ranked.groupBy("domain").agg(F.count("*").alias("total"), F.avg("contributed").alias("rate"))
    return rho, by_rank, by_domain
