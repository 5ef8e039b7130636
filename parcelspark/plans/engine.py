"""Running queries over estates: views, guard, retries, relaxation in one pass, deterministic fallbacks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.functions.exprs import planar_degrees, register_sql_functions
from parcelspark.plans.constraints import ConstraintSet, render
from parcelspark.schema import with_aliases

VIEWS = ("PROPERTIES", "ESTATES", "IMMOBILI")
# Statements a query must not hold.
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "ATTACH", "COPY", "PRAGMA", "MERGE", "GRANT", "SET")
ENOUGH_ROWS, MAX_RELAX, MAX_RETRY = 10, 3, 3


def register(df: DataFrame) -> None:
    """The three view names over one table, with canonical names for variants, and the SQL distance function."""
    named = with_aliases(df)
    for v in VIEWS:
        named.createOrReplaceTempView(v)
    register_sql_functions(df.sparkSession)


def clean_sql(text: str) -> str:
    """The one query in a model's answer: without thoughts, fences, comments and what follows a semicolon; quotes closed."""
    text = re.sub(r"(?s)<think>.*?</think>|```(?:sql)?", "", text)
    text = re.sub(r"(?m)--[^\n]*$|(?s:/\*.*?\*/)", "", text)
    m = re.search(r"(?is)\b(?:SELECT|WITH)\b.*", text)
    text = m[0] if m else text
    out, quoted = [], False
    for ch in text:
        quoted ^= ch == "'"
        if ch == ";" and not quoted:
            break
        out.append(ch)
    sql = "".join(out).strip()
    return sql + "'" if sql.count("'") % 2 else sql


def guard(sql: str) -> str | None:
    """Why a text must not run, or None: only SELECT or WITH, no statement words outside quotes."""
    if not re.match(r"(?is)\s*(?:SELECT|WITH)\b", sql):
        return "only SELECT is allowed"
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
    found = re.search(rf"(?i)\b(?:{'|'.join(FORBIDDEN)})\b", bare)
    return f"{found[0].upper()} is not allowed" if found else None


def to_spark_dialect(sql: str) -> str:
    """Double-quoted identifiers to backticks, star EXCLUDE to EXCEPT, // to div, outside quotes."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", sql)
    for i in range(0, len(parts), 2):
        p = re.sub(r'"([^"]*)"', r"`\1`", parts[i])
        p = re.sub(r"(?i)\*\s*EXCLUDE\s*\(", "* EXCEPT(", p)
        parts[i] = p.replace("//", " div ")
    return "".join(parts)


def sort_by_distance(sql: str) -> str:
    """A SQL function can't stand in ORDER BY: the distance is projected, sorted by, and dropped again."""
    m = re.match(r"(?is)^\s*SELECT\s+\*\s+FROM\s+(.*?)\s+ORDER\s+BY\s+(haversine_km\s*\([^()]*\))\s*(ASC|DESC)?\s*(.*)$", sql)
    if not m:
        return sql
    return f"SELECT * EXCEPT(__d) FROM (SELECT *, {m[2]} AS __d FROM {m[1]}) ORDER BY __d {m[3] or 'ASC'} NULLS LAST {m[4]}".strip()


def run_sql(spark: SparkSession, sql: str, df: DataFrame | None = None) -> tuple[DataFrame | None, str | None]:
    """(rows, None) or (None, error): guarded, in Spark's dialect. Nothing runs here but the analysis."""
    if df is not None:
        register(df)
    error = guard(sql)
    if error:
        return None, error
    try:
        return spark.sql(sort_by_distance(to_spark_dialect(sql))), None
    except PySparkException as e:
        return None, str(e)


def route(error: str | None, rows: int, retries: int, relaxed: int) -> str:
    """The next step after a query: retry, fallback, relax or go on."""
    if error:
        return "retry" if retries < MAX_RETRY else "fallback"
    if rows < ENOUGH_ROWS and relaxed < MAX_RELAX:
        return "relax"
    return "fallback" if rows == 0 else "continue"


# Relaxation


@dataclass(frozen=True)
class Conjunct:
    name: str
    test: Column
    hard: bool = False
    variants: tuple[tuple[str, Column], ...] = ()  # (low | medium | high, weaker test)


@dataclass(frozen=True)
class Relaxed:
    levels: tuple[str, ...]  # for each conjunct: asked, low, medium, high or dropped
    rows: int
    condition: Column  # true where every conjunct has been dropped


LEVELS = ("low", "medium", "high")


def condition_counts(df: DataFrame, tests: Sequence[Column]) -> DataFrame:
    """(met, n): rows by the numbers of the conditions that they meet, in order. One scan and one grouping answer every
    combination of any number of conditions; a null condition isn't met."""
    met = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)])) if tests else F.array().cast("array<int>")
    return df.select(met.alias("met")).groupBy("met").agg(F.count("*").alias("n"))


def counter(counts: DataFrame, most: int = 100_000) -> Callable[[Iterable[int]], int]:
    """A function from condition numbers to the rows that meet them all. Up to `most` combinations are counted here, more
    of them where they are."""
    got = counts.limit(most + 1).collect()
    if len(got) <= most:
        local = [(frozenset(r["met"]), r["n"]) for r in got]
        return lambda want: sum(n for met, n in local if met.issuperset(want))

    def remote(want: Iterable[int]) -> int:
        wanted = F.array(*[F.lit(i) for i in want]).cast("array<int>")
        return counts.where(F.size(F.array_except(wanted, F.col("met"))) == 0).agg(F.sum("n")).first()[0] or 0

    return remote


def relax(df: DataFrame, conjuncts: Sequence[Conjunct], enforce: bool = True, enough: int = ENOUGH_ROWS) -> Relaxed:
    """Weaken or drop conditions until enough rows match: last conjunct first, level by level, then drops the same way.

    A trial is accepted at `enough` rows and ends the search, else kept if it is better than the first count. With
    `enforce` hard conjuncts are never touched. All trials are answered by one pass over the rows.
    """
    tests: list[Column] = [c.test for c in conjuncts]
    at: dict[tuple[int, str], int] = {(i, "asked"): i for i in range(len(conjuncts))}
    for i, c in enumerate(conjuncts):
        for level, test in c.variants:
            at[i, level] = len(tests)
            tests.append(test)
    counts = condition_counts(df, tests).persist()
    count = counter(counts)
    wanted = lambda levels: [at[i, level] for i, level in enumerate(levels) if level != "dropped"]
    current, free = ["asked"] * len(conjuncts), [i for i in range(len(conjuncts) - 1, -1, -1) if not (enforce and conjuncts[i].hard)]
    trials = [(level, i) for level in (*LEVELS, "dropped") for i in free if level == "dropped" or (i, level) in at]
    first = rows = count(wanted(current))
    for level, i in trials:
        if rows >= enough:
            break
        trial = [*current[:i], level, *current[i + 1 :]]
        n = count(wanted(trial))
        if n >= enough or n > first:
            current, rows = trial, n
    counts.unpersist()
    return Relaxed(tuple(current), rows, reduce(lambda a, b: a & b, [tests[i] for i in wanted(current)], F.lit(True)))


# Fallbacks


def deterministic(df: DataFrame, c: ConstraintSet) -> tuple[DataFrame | None, str | None]:
    """Rows of all constraints, else of the hard ones, whichever first has any: a probe of one row each."""
    for hard_only, name in ((False, "all"), (True, "hard")):
        condition = render(c, df.columns, hard_only).condition
        if condition is not None and not (rows := df.where(condition)).isEmpty():
            return rows, name
    return None, None


def fallback(df: DataFrame, by: str = "energy", lat: float | None = None, lon: float | None = None, limit: int = 500) -> DataFrame:
    """The best `limit` rows by energy score, the nearest ones to a point, or a seeded sample; ties by id."""
    if by == "energy":
        return df.orderBy(F.col("energy_score_total").desc_nulls_last(), "id").limit(limit)
    if by == "distance":
        d = planar_degrees(F.col("latitude"), F.col("longitude"), lat, lon)
        return df.withColumn("__d", d).orderBy(F.col("__d").asc_nulls_last(), "id").limit(limit).drop("__d")
    return df.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(limit)


def search(spark: SparkSession, df: DataFrame, ask: Callable[[str | None], str], c: ConstraintSet, columns: Iterable[str] | None = None) -> tuple[DataFrame, str]:
    """Query, retry with the error, then the constraints themselves, then the generic fallback; (rows, where they came from)."""
    error: str | None = None
    for _ in range(MAX_RETRY + 1):
        rows, error = run_sql(spark, clean_sql(ask(error)), df)
        if rows is not None and not rows.isEmpty():
            return rows, "sql"
        if error is None:
            break
    rows, source = deterministic(df, c)
    if rows is not None:
        return rows, f"constraints:{source}"
    return fallback(df), "fallback"
