"""Estates and related tables derived from the driver's tables, in Spark and as SQL for the same rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PERIODS = ("before 1945", "1946-1976", "1977-2005", "after 2005")
CLASSES = ("A4", "A3", "A2", "A1", "B", "C", "D", "E", "F", "G")
#: Multipliers that spread keys over scores.
NEAR = {"commercial": 3, "education": 7, "mobility": 11, "healthcare": 13, "sport": 17, "green": 19}
POINTS = {"class": 5, "plant": 7, "envelope": 11, "renewables": 13}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers find this package where the driver does, if it isn't installed; elsewhere the entry does nothing.
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], at: str) -> str:
    return "CASE " + " ".join(f"WHEN {at} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _columns(div: str) -> list[str]:
    """Select items that both dialects read; `div` is the sign of whole division."""
    k = "p_partkey"
    near = [f"CAST(({k} * {m}) % 101 AS DOUBLE) AS {n}" for n, m in NEAR.items()]
    points = [f"CAST(1 + 2 * (({k} * {m}) % 3) AS INT) AS energy_score_{n}" for n, m in POINTS.items()]
    total = "CAST(" + " + ".join(f"1 + 2 * (({k} * {m}) % 3)" for m in POINTS.values()) + " AS INT) AS energy_score_total"
    return [
        f"CAST({k} AS {'STRING' if div == 'div' else 'VARCHAR'}) AS id",
        "p_type AS property_type",
        pick(CLASSES, f"{k} % 10") + " AS energy_class",
        "CAST(p_size AS DOUBLE) * 10 AS surface_area",
        f"CAST(45 AS DOUBLE) + CAST({k} * 37 % 1000 AS DOUBLE) / 10000 AS latitude",
        f"CAST(7.6 AS DOUBLE) + CAST({k} * 91 % 1000 AS DOUBLE) / 10000 AS longitude",
        f"CAST({k} {div} 100 AS INT) AS cadastral_sheet",
        f"CAST({k} {div} 4 AS INT) AS cadastral_parcel",
        f"CAST({k} % 4 AS INT) AS cadastral_subaltern",
        f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE {k} % 7 = 0 END AS is_meta_estate",
        pick(PERIODS, f"({k} * 5) % 7 % 4") + " AS construction_period",
        "p_brand AS address",
        f"CASE WHEN {k} % 5 = 0 THEN NULL ELSE CAST({k} % 50 AS {'STRING' if div == 'div' else 'VARCHAR'}) END AS house_number",
        f"CASE WHEN {k} % 3 = 0 THEN 'A123' ELSE 'L219' END AS comune_code",
        *near,
        *points,
        total,
    ]


def estates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_columns("div"))


ESTATES_SQL = "estates AS (SELECT " + ", ".join(_columns("//")) + " FROM part)"


def pois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(*_poi("div"))


def _poi(div: str) -> list[str]:
    k = "s_suppkey"
    return [
        f"CAST({k} AS BIGINT) AS poi_id",
        pick(("mobility", "commercial", "green"), f"{k} % 3") + " AS category",
        pick(("stop", "shop", "park", "station"), f"{k} % 4") + " AS amenity",
        f"CAST(45 AS DOUBLE) + CAST({k} * 53 % 1000 AS DOUBLE) / 10000 AS lat",
        f"CAST(7.6 AS DOUBLE) + CAST({k} * 71 % 1000 AS DOUBLE) / 10000 AS lon",
    ]


POIS_SQL = "pois AS (SELECT " + ", ".join(_poi("//")) + " FROM supplier)"


def distance_sql(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"(CAST(12742 AS DOUBLE) * atan2(sqrt({h}), sqrt(1 - {h})))"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback rows from events: ratings 1 to 5 of buildings or agents."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("feedback_id"),
        (F.col("user_id") % 97).alias("run_id"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("agent"), (F.col("event_id") % 5).cast("string"))).alias("agent_name"),
        F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("b"), (F.col("event_id") % 41).cast("string"))).alias("building_id"),
        F.when(F.col("event_id") % 13 != 0, (F.col("event_id") % 5 + 1).cast("int")).alias("rating"),
        F.col("ts").alias("created_at"),
    )


FEEDBACK_SQL = (
    "feedback AS (SELECT event_id AS feedback_id, user_id % 97 AS run_id, CASE WHEN event_id % 3 = 0 THEN 'agent' || CAST(event_id % 5 AS VARCHAR) END AS agent_name, "
    "CASE WHEN event_id % 3 = 1 THEN 'b' || CAST(event_id % 41 AS VARCHAR) END AS building_id, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 5 + 1 AS INT) END AS rating, ts AS created_at FROM events)"
)
