"""Building the estates table: latest unit per cadastral key, roll-up entities, energy points, percentile energy score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from parcelspark.functions.exprs import norm_cdf

KEY = ("cadastral_sheet", "cadastral_parcel", "cadastral_subaltern")


def latest_unit(df: DataFrame, key: tuple[str, ...] = KEY, address: str = "address", date: str = "effective_date", tie: str = "id") -> DataFrame:
    """One row of each unit: of those at the address that comes first by date (newest first), the newest; ties by id."""
    order = [F.col(date).desc_nulls_last(), F.col(tie).asc()]
    w = Window.partitionBy(*key).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = df.withColumn("__a", F.first(address, ignorenulls=True).over(whole)).where(F.col(address).eqNullSafe(F.col("__a")) | F.col("__a").isNull())
    return same.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__a", "__n")


def heaviest(df: DataFrame, keys: list[str], category: str, weight: str) -> DataFrame:
    """(keys, category): the category with the largest summed weight, ties to the smallest."""
    sums = df.where(F.col(category).isNotNull()).groupBy(*keys, category).agg(F.sum(F.coalesce(F.col(weight), F.lit(0.0))).alias("__w"))
    return sums.groupBy(*keys).agg(F.min(F.struct((-F.col("__w")).alias("w"), F.col(category).alias("c"))).alias("__m")).select(*keys, F.col("__m.c").alias(category))


def class_points(energy_class: Column) -> Column:
    return F.when(energy_class.startswith("A"), 5).when(energy_class.isin("B", "C", "D", "E"), 3).otherwise(1)


def rollup_entities(df: DataFrame, files: str | None = None, least: tuple[str, ...] = (), modes: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (sheet, parcel) of more than one unit: summed surface, heaviest type and class, smallest most frequent
    period and value of each column in `modes`, best points, smallest value of each column in `least`, sorted unit ids,
    sorted distinct files (an array column), running id M00001 in order of (sheet, parcel)."""
    keys = ["cadastral_sheet", "cadastral_parcel"]
    points = ("plant", "envelope", "renewables")
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(files)))).alias(files)] if files else []
    agg = df.groupBy(*keys).agg(
        F.count("*").cast("int").alias("cadastral_units_count"),
        F.sum("surface_area").alias("surface_area"),
        *[F.mode(c, True).alias(c) for c in ("construction_period", *modes)],
        *[F.max(f"energy_score_{p}").alias(f"energy_score_{p}") for p in points],
        *[F.min(c).alias(c) for c in least],
        F.array_sort(F.collect_set("id")).alias("id_list"),
        F.avg("latitude").alias("latitude"),
        F.avg("longitude").alias("longitude"),
        *more,
    )
    agg = agg.where("cadastral_units_count > 1")
    out = agg.join(heaviest(df, keys, "property_type", "surface_area"), keys, "left").join(heaviest(df, keys, "energy_class", "surface_area"), keys, "left")
    out = out.withColumn("energy_score_class", class_points(F.col("energy_class")))
    out = out.withColumn("energy_score_total", sum((F.col(f"energy_score_{p}") for p in points), F.col("energy_score_class")))
    out = running_number(out, keys, "__n", groups="cadastral_sheet")
    return out.withColumns({"id": F.format_string("M%05d", F.col("__n").cast("long")), "cadastral_subaltern": F.lit(0), "is_meta_estate": F.lit(True)}).drop("__n")


def running_number(df: DataFrame, order: list[str], name: str, groups: str, block: int = 1024) -> DataFrame:
    """Row numbers in a total order that begins with the whole-number column `groups`, without one task that sorts all rows:
    numbers within each group, plus the sizes of the groups before it in its block of `block` group numbers, plus those of
    the blocks before, of which there is one row each."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = df.groupBy(F.col(groups).alias("__g")).agg(F.count("*").alias("__c")).withColumn("__k", F.floor(F.col("__g") / block))
    blocks = sizes.groupBy(F.col("__k").alias("__k2")).agg(F.sum("__c").alias("__all"))
    blocks = blocks.withColumn("__before", F.sum("__all").over(upto(Window.orderBy("__k2"))) - F.col("__all")).drop("__all")
    sizes = sizes.withColumn("__base", F.sum("__c").over(upto(Window.partitionBy("__k").orderBy("__g"))) - F.col("__c"))
    sizes = sizes.join(blocks, F.col("__k").eqNullSafe(F.col("__k2"))).select("__g", (F.col("__base") + F.col("__before")).alias("__base"))
    within = Window.partitionBy(groups).orderBy(*order)
    return df.join(sizes, F.col(groups).eqNullSafe(F.col("__g"))).withColumn(name, F.row_number().over(within) + F.col("__base")).drop("__g", "__base")


def with_rollups(df: DataFrame, entities: DataFrame) -> DataFrame:
    """Units and roll-ups as one table, by column name."""
    return df.unionByName(entities, allowMissingColumns=True)


# What the descriptions say, with their points; the first that fits counts.
PLANT_POINTS = (("heat pump|district heating", 5), ("condensing|biomass", 3))
ENVELOPE_POINTS = (("good", 5), ("neutral", 3))
RENEWABLE_YES = ("Yes", "Sì", "Si", "true")
EXPERT_CLASS_POINTS = (("A1", 5), ("A2", 5), ("A3", 5), ("A4", 5), ("A", 5), ("B", 4), ("C", 3), ("D", 3), ("E", 2))
EXPERT_PLANT_POINTS = (("pompa di calore|teleriscaldamento|geotermico", 5), ("condensazione|biomassa|cippato|legna|pellet", 4))
EXPERT_ENVELOPE_POINTS = (("smiling|sorridente", 5), ("basita|neutr|amazed", 3))
EXPERT_RENEWABLE_YES = "s[iì]|yes"
EXPERT_GRADES = ((18, 5), (15, 4), (12, 3), (9, 2))


def points(text: Column, table: tuple[tuple[str, int], ...], otherwise: int) -> Column:
    """Points of the first pattern that a description holds, in lower case; `otherwise` for none and for null."""
    out = F.lit(otherwise)
    for pattern, n in reversed(table):
        out = F.when(F.coalesce(F.lower(text).rlike(pattern), F.lit(False)), n).otherwise(out)
    return out


def says_yes(df: DataFrame, column: str) -> Column:
    """Whether a column says that there is something: true, the number 1, or one of the words exactly."""
    kind, c = df.schema[column].dataType, F.col(column)
    yes = c.isin(*RENEWABLE_YES) if isinstance(kind, StringType) else c if isinstance(kind, BooleanType) else c == 1
    return F.coalesce(yes, F.lit(False))


def energy_points(df: DataFrame, plant: str, envelope: str, renewables: str, energy_class: str = "energy_class") -> DataFrame:
    """The four-part score of the ingest (K9), 4 to 20 points: plant and envelope by what their descriptions hold."""
    parts = {
        "plant": points(F.col(plant), PLANT_POINTS, 1),
        "envelope": points(F.col(envelope), ENVELOPE_POINTS, 1),
        "renewables": F.when(says_yes(df, renewables), 5).otherwise(1),
        "class": F.coalesce(class_points(F.upper(F.trim(energy_class))), F.lit(1)),
    }
    out = df.withColumns({f"energy_score_{k}": v for k, v in parts.items()})
    return out.withColumn("energy_score_total", sum((F.col(f"energy_score_{k}") for k in ("envelope", "renewables", "class")), F.col("energy_score_plant")))


def expert_points(energy_class: Column, plant: Column, winter: Column, renewables: Column) -> tuple[Column, Column]:
    """(points 6 to 20, grade 1 to 5) of the expert scale."""
    c, by_class = F.upper(F.trim(energy_class)), F.lit(1)
    for name, n in EXPERT_CLASS_POINTS:
        by_class = F.when(c == name, n).otherwise(by_class)
    total = by_class + points(plant, EXPERT_PLANT_POINTS, 2) + points(winter, EXPERT_ENVELOPE_POINTS, 1) + points(renewables, ((EXPERT_RENEWABLE_YES, 5),), 2)
    grade = F.lit(1)
    for least, n in reversed(EXPERT_GRADES):
        grade = F.when(total >= least, n).otherwise(grade)
    return total, grade


def energy_distribution(df: DataFrame, usage: str, kwh: str, surface: str, least: int = 10) -> DataFrame:
    """(usage, mean, std, n) of use per square metre strictly between 0 and 1000, of usages with enough rows, and of all (null)."""
    use = df.select(F.col(usage).alias("usage"), (F.col(kwh) / F.nullif(F.col(surface), F.lit(0.0))).alias("x")).where("x > 0 and x < 1000")
    figures = [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.count("*").alias("n")]
    every = use.agg(*figures).select(F.lit(None).cast(use.schema["usage"].dataType).alias("usage"), "mean", "std", "n")
    return use.where("usage is not null").groupBy("usage").agg(*figures).where(F.col("n") >= least).unionByName(every)


def energy_percentile(df: DataFrame, usage: str, kwh: str, surface: str, price: float = 0.25) -> DataFrame:
    """df with energy_percentile (K11), yearly cost, cost per square metre, the usage's mean and the percent difference from it."""
    dist = energy_distribution(df, usage, kwh, surface)
    own = dist.where("usage is not null").select(F.col("usage").alias("__u"), F.col("mean").alias("__m"), F.col("std").alias("__s"))
    every = dist.where("usage is null").select(F.col("mean").alias("__gm"), F.col("std").alias("__gs"))
    x = F.col(kwh) / F.nullif(F.col(surface), F.lit(0.0))
    out = df.withColumn("__x", x).join(own, F.col(usage) == F.col("__u"), "left").join(F.broadcast(every))  # every is one row
    mean = F.coalesce("__m", "__gm")
    std = F.when(F.col("__m").isNotNull(), F.col("__s")).otherwise(F.col("__gs"))
    low = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (1 - norm_cdf((F.col("__x") - mean) / F.nullif(std, F.lit(0.0))))))
    score = F.when(F.col("__x").isNull() | (F.col("__x") <= 0), 0).when(F.coalesce(std, F.lit(0.0)) == 0, 50).otherwise(F.floor(low).cast("int"))
    out = out.withColumns({"energy_percentile": score, "energy_cost": F.col(kwh) * price, "energy_cost_m2": F.col("__x") * price, "energy_mean_m2": F.bround(mean, 1), "energy_diff_pct": F.bround((F.col("__x") - mean) / mean * 100, 1)})
    return out.drop("__x", "__u", "__m", "__s", "__gm", "__gs")
