"""Column statistics for prompts and checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, by: Sequence[str], value: str, buckets: int = 255) -> DataFrame:
    """(by, value, __n, __before, __all): how many rows of its group have a value, a smaller one, and any; nulls left out.

    Nothing sorts a whole group: its distinct values are dealt into ordered buckets by borders from a quantile sketch (of
    any accuracy: they decide the size of buckets only), counted up within each, and the buckets' totals, one row each,
    over the group. `value` is a column of numbers.
    """
    kind = df.schema[value].dataType
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    share = [i / (buckets + 1) for i in range(1, buckets + 1)]
    borders = counts.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.percentile_approx(value, share, 1000).alias("__borders"))
    same = [counts[c].eqNullSafe(F.col(f"__{c}")) for c in by] or [F.lit(True)]
    at = F.size(F.filter("__borders", lambda b: b < F.col(value).cast(kind)))
    dealt = counts.join(borders if by else F.broadcast(borders), reduce(lambda a, b: a & b, same)).withColumn("__bucket", at).drop("__borders", *[f"__{c}" for c in by])  # one row, if no group is asked for
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = [F.col(c).alias(f"__{c}") for c in by]
    totals = dealt.groupBy(*own, F.col("__bucket").alias("__b")).agg(F.sum("__n").alias("__t"))
    group = Window.partitionBy(*[f"__{c}" for c in by])
    totals = totals.withColumns({"__base": F.sum("__t").over(upto(group.orderBy("__b"))) - F.col("__t"), "__all": F.sum("__t").over(group)})
    inner = upto(Window.partitionBy(*by, "__bucket").orderBy(value))
    local = dealt.withColumn("__local", F.sum("__n").over(inner) - F.col("__n"))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by], F.col("__bucket") == F.col("__b"))
    return local.join(totals, on).select(*by, value, "__n", (F.col("__local") + F.col("__base")).alias("__before"), "__all")


def with_mean_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "rank", total: str | None = None) -> DataFrame:
    """df with the rank of each row's value in its group, tied values sharing the mean of their ranks; null for null. total:
    a name for the number of values in the group."""
    counts = value_counts(df, by, value)
    ranks = counts.select(*[F.col(c).alias(f"__k_{c}") for c in by], F.col(value).alias("__k"), (F.col("__before") + (F.col("__n") + 1) / 2).alias(name), *([F.col("__all").alias(total)] if total else []))
    on = reduce(lambda a, b: a & b, [df[c].eqNullSafe(F.col(f"__k_{c}")) for c in by], df[value] == F.col("__k"))
    return df.join(ranks, on, "left").drop("__k", *[f"__k_{c}" for c in by])


def percentile_rank(df: DataFrame, by: Sequence[str], value: str, name: str = "percentile") -> DataFrame:
    """df with the percent rank of a value in its group, ties by their mean rank, 2 decimals; null for null (G1)."""
    out = with_mean_rank(df, by, value, "__rank", "__total")
    return out.withColumn(name, F.bround(F.col("__rank") / F.col("__total") * 100, 2)).drop("__rank", "__total")


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each share): exact quantiles of a column of doubles, between two values by linear interpolation.

    Only the one or two values at each place are picked from the counted ones, so no task holds a group's values.
    """
    counts = value_counts(df, by, value)
    place = {k: F.lit(float(p)) * (F.col("__all") - 1) for k, p in shares.items()}
    inside = lambda x: (F.col("__before") <= x) & (x < F.col("__before") + F.col("__n"))
    figures = []
    for k, h in place.items():
        for side, at in (("low", F.floor(h)), ("high", F.ceil(h))):
            figures.append(F.max(F.when(inside(at), F.col(value))).alias(f"__{side}_{k}"))
    out = counts.groupBy(*by).agg(F.max("__all").alias("__all"), *figures)
    part = {k: h - F.floor(h) for k, h in place.items()}
    return out.select(*by, *[(F.col(f"__low_{k}") + (F.col(f"__high_{k}") - F.col(f"__low_{k}")) * part[k]).alias(k) for k in shares])


def numeric_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, min, p25, median, p75, max, mean) of each column, 2 decimals; a column without a number has n 0."""
    each = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.column", "s.x")
    plain = each.groupBy("column").agg(F.count("x").alias("n"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))
    out = plain.join(quantiles(each, ["column"], "x", {"p25": 0.25, "median": 0.5, "p75": 0.75}), "column", "left")
    asked = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return asked.join(out, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"), *[F.round(k, 2).alias(k) for k in ("min", "max", "mean", "p25", "median", "p75")])


def totals(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row: the rows of a table, and how many have a value of the target column."""
    return df.agg(F.count("*").alias("total_records"), F.count(target if target else F.lit(1)).alias("target_count"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """(column, n) of a column's values, such as districts, the most frequent first, ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column).asc_nulls_last())


def category_stats(df: DataFrame, column: str, values: Sequence[str] | None = None, many: int = 100, top_many: int = 10, top_few: int = 50) -> DataFrame:
    """(value, n, distinct): counts of the top values and, under 'other', of the rest; known values that are absent count 0.

    Over `many` distinct values only the top 10 stand by themselves, else the top 50. Ties by value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    if values:
        known = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
        counts = known.join(counts, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"))
    distinct = counts.agg(F.count("*").alias("distinct"))
    top = counts.orderBy(F.desc("n"), "value").limit(top_few)
    ranked = top.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("n"), "value"))).join(F.broadcast(distinct))  # 50 rows and one
    shown = ranked.where(F.col("__r") <= F.when(F.col("distinct") > many, top_many).otherwise(top_few)).select("value", "n", "distinct")
    total = counts.agg(F.sum("n").alias("__all")).join(shown.agg(F.sum("n").alias("__in"))).join(distinct)
    rest = total.select(F.lit("other").alias("value"), (F.col("__all") - F.col("__in")).alias("n"), "distinct").where("n > 0")
    return shown.unionByName(rest)


def runtime_metadata(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], most: int = 1000) -> DataFrame:
    """(column, values, min, max, mean): sorted distinct values of categories, ranges of numbers.

    The lists are for prompts: of a column with more than `most` values the first so many, in order, are listed.
    """
    none = [F.lit(None).cast("double").alias(k) for k in ("min", "max", "mean")]
    listed = lambda c: df.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().orderBy("v").limit(most)
    parts = [listed(c).agg(F.array_sort(F.collect_list("v")).alias("values")).select(F.lit(c).alias("column"), "values", *none) for c in categories]
    if numbers:
        figures = [F.struct(F.lit(c).alias("column"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean")).alias(f"s_{i}") for i, c in enumerate(numbers) for x in [F.col(c).cast("double")]]
        one = df.agg(*figures).select(F.explode(F.array(*[f"s_{i}" for i in range(len(numbers))])).alias("s"))
        parts.append(one.select("s.column", F.lit(None).cast("array<string>").alias("values"), "s.min", "s.max", "s.mean"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def thresholds(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    """(first, third) quartile of a column, for calibrated limits."""
    r = numeric_stats(df, [column]).first()
    return r["p25"], r["p75"]
