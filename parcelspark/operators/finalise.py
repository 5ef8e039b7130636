"""From ranked candidates to the result: enrichment and overlay joins, evaluation, tiers, final order, sub-properties, stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enrich(result: DataFrame, full: DataFrame, key: str = "id") -> DataFrame:
    """result with the columns it lacks from the full table, one row of it per key (the smallest row, as struct)."""
    missing = [c for c in full.columns if c not in result.columns]
    if not missing:
        return result
    one = full.groupBy(F.col(key).cast("string").alias("__k")).agg(F.min(F.struct(*missing)).alias("__r"))
    out = result.join(one, result[key].cast("string") == F.col("__k"), "left")
    return out.select(*result.columns, *[F.col(f"__r.{c}").alias(c) for c in missing])


def one_row(df: DataFrame, key: str, best: list[Column] | None = None) -> DataFrame:
    """df with one row for each key: the first by `best`, else and of equals the smallest as a struct of its columns. Maps
    can't be compared, so none may be among them."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(best or [])], F.struct(*rest).alias("row")) if rest else F.struct(F.lit(0).alias("row"))
    got = df.groupBy(key).agg(F.min(order).alias("__m"))
    return got.select(*[F.col(key) if c == key else F.col(f"__m.row.{c}").alias(c) for c in df.columns])


def combine_first(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """left with nulls of shared columns filled from right; of right rows with one key the smallest, as a struct, counts."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    r = one_row(right.select(key, *[F.col(c).alias(f"__{c}") for c in shared]), key)
    out = left.join(r, key, "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in shared else F.col(c) for c in left.columns])


def overlay(full: DataFrame, result: DataFrame) -> DataFrame:
    """Every row of the table with is_match, ranking_score and distance_km of the result; no match and 0 where there is none."""
    r = result.select(F.col("id").alias("__id"), F.lit(True).alias("__m"), F.col("ranking_score").alias("__s"), F.col("distance_km").alias("__d"))
    r = one_row(r, "__id", [-F.coalesce("__s", F.lit(0.0)), F.col("__d")])  # of repeated results the best, then the nearest
    base = full.drop("is_match", "ranking_score", "distance_km").join(r, full["id"] == F.col("__id"), "left")
    return base.withColumns({"is_match": F.coalesce("__m", F.lit(False)), "ranking_score": F.coalesce("__s", F.lit(0.0)), "distance_km": F.col("__d")}).drop("__id", "__m", "__s", "__d")


def evaluated(df: DataFrame, evaluations: DataFrame, chosen_from: float = 60.0) -> DataFrame:
    """df with score (evaluated, else ranking score, else 0), is_evaluated and is_selected (score of at least 60 when evaluated)."""
    e = evaluations.groupBy(F.col("id").alias("__id")).agg(F.max("score").alias("__e"), F.count("*").alias("__n"))
    out = df.join(e, df["id"] == F.col("__id"), "left")
    done = F.col("__id").isNotNull()
    out = out.withColumns({"score": F.coalesce("__e", "ranking_score", F.lit(0.0)), "is_evaluated": done})
    return out.withColumn("is_selected", F.col("is_evaluated") & (F.col("score") >= chosen_from)).drop("__id", "__e", "__n")


def final_order(df: DataFrame, cap: int = 1000) -> DataFrame:
    """Matches first, then score, then nearness, then id; at most cap rows: a bounded top-k, not a full sort."""
    return df.orderBy(F.desc("is_match"), F.desc("score"), F.col("distance_km").asc_nulls_last(), "id").limit(cap)


def evaluation_cap(asked: int, hard: int = 10) -> int:
    return min(max(1, asked), hard)


def tiers(base: DataFrame, matches: DataFrame, top: int = 25) -> DataFrame:
    """(id, tier, score) with one row per id: tier 3 for the best `top` matches, 2 for other matches, 1 for the rest."""
    best = matches.orderBy(F.desc("score"), "id").limit(top).select("id", F.lit(3).alias("tier"), "score")
    every = base.select("id", F.lit(1).alias("tier"), F.lit(0.0).alias("score")).unionByName(matches.select("id", F.lit(2).alias("tier"), "score")).unionByName(best)
    got = every.groupBy("id").agg(F.max(F.struct("tier", "score")).alias("m"))
    return got.select("id", F.col("m.tier").alias("tier"), F.col("m.score").alias("score"))


def sub_properties(df: DataFrame, full: DataFrame, columns: list[str], first: int = 20, list_col: str = "id_list") -> DataFrame:
    """(id, subs): for each roll-up the rows of its first ids, in their order; ids without a row are left out."""
    parts = df.select(F.col("id").alias("__p"), F.posexplode(F.slice(list_col, 1, first)).alias("__pos", "__sub"))
    got = parts.join(full.select(F.col("id").alias("__sub"), *columns), "__sub")
    subs = F.array_sort(F.collect_list(F.struct("__pos", F.col("__sub").alias("id"), *columns)))
    return got.groupBy("__p").agg(F.transform(subs, lambda x: F.struct(x["id"].alias("id"), *[x[c].alias(c) for c in columns])).alias("subs")).withColumnRenamed("__p", "id")


def result_filter(df: DataFrame, results: DataFrame) -> DataFrame:
    """Rows whose id a stored run holds. results: (run_id, ids array)."""
    return df.join(results.select(F.explode("ids").alias("id")).distinct(), "id", "left_semi")


def read_time_scores(df: DataFrame) -> DataFrame:
    """Missing display scores from their fallbacks."""
    out = {"score": F.coalesce("score", "ranking_score", F.lit(70.0)), "energy_display": F.coalesce("energy_score", F.col("energy_score_total") * 5, F.lit(60.0)), "location_display": F.coalesce("location_score", F.lit(80.0))}
    return df.withColumns(out)


# Stores of append and latest wins


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key; null keys form keys too."""
    got = df.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*[c for c in df.columns if c not in keys]).alias("__r"))).alias("__m"))
    return got.select(*[c if c in keys else F.col(f"__m.__r.{c}").alias(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with rows of new put in or over those of the same keys (null keys meet null keys)."""
    on = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new, on, "left_anti").unionByName(new)


def cascade_delete(users: DataFrame, runs: DataFrame, feedback: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users, runs and feedback without the users in `gone` (user_id) and what hangs on them."""
    kept = runs.join(gone, "user_id", "left_anti")
    return users.join(gone, "user_id", "left_anti"), kept, feedback.join(kept.select("run_id"), "run_id", "left_semi")


def add_columns(df: DataFrame, ddl: dict[str, str]) -> DataFrame:
    """df with columns it lacks added as null: an additive migration."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in ddl.items() if c not in df.columns})


def feedback_export(feedback: DataFrame) -> DataFrame:
    """Rows for a CSV: GLOBAL where neither agent nor building is named, empty text for null."""
    agent = F.when(F.col("agent_name").isNull() & F.col("building_id").isNull(), F.lit("GLOBAL")).otherwise(F.coalesce("agent_name", F.lit("")))
    return feedback.select("feedback_id", "run_id", agent.alias("agent"), F.coalesce("building_id", F.lit("")).alias("building"), F.coalesce(F.col("rating").cast("string"), F.lit("")).alias("rating"))


def retries(steps: DataFrame) -> DataFrame:
    """Steps with their running number within (agent, run, batch, mode); null is a value of its own."""
    return steps.withColumn("attempt", F.row_number().over(Window.partitionBy("agent", "run", "batch", "mode").orderBy("position")))


def progress(steps: DataFrame) -> DataFrame:
    """Steps with percent of position; pending steps before a running or done one count as done."""
    w = Window.partitionBy("run")
    last = F.max(F.when(F.col("status") != "pending", F.col("position"))).over(w)
    out = steps.withColumn("percent", F.bround(100 * F.col("position") / F.count("*").over(w), 1))
    return out.withColumn("status", F.when((F.col("status") == "pending") & (F.col("position") < last), F.lit("done")).otherwise(F.col("status")))


# Stored documents


def renamed_like(df: DataFrame, parts: tuple[str, ...] = ("zona", "urban"), to: str = "zona_urbanistica") -> DataFrame:
    """df with the first column whose name holds all parts, in any case, under another name."""
    found = next((c for c in df.columns if all(p in c.lower() for p in parts)), None)
    return df if found is None or to in df.columns else df.withColumnRenamed(found, to)


def zone_population(zones: DataFrame, population: DataFrame, bands: list[str]) -> DataFrame:
    """Zones with the inhabitants of each age band by the zone's name, in any case and without outer blanks; 0 without a
    row. Of population rows with one name that with the smallest ages counts. population: zone, ages (a map)."""
    ages = population.select(F.lower(F.trim("zone")).alias("__z"), *[F.col("ages")[b].alias(b) for b in bands])
    one = one_row(ages, "__z")
    out = zones.join(one, F.lower(F.trim(zones["zone"])) == F.col("__z"), "left")
    return out.select(*zones.columns, *[F.coalesce(b, F.lit(0.0)).alias(b) for b in bands])


def payload_keys(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """df with only the asked top-level keys of a JSON object, as a map of JSON texts; a key that isn't there is null."""
    v = F.try_parse_json(column)
    each = [F.struct(F.lit(k).alias("key"), F.to_json(F.try_variant_get(v, f"$['{k}']", "variant")).alias("value")) for k in dict.fromkeys(keys)]
    return df.withColumn(column, F.map_from_entries(F.array(*each)))


# The order of steps in a stored payload, and the fields that may hold a step's answer, the first that does.
STEP_ORDER = (
    "location_extraction", "property_technical_extraction", "needs_metric_plan", "use_case_generation", "sql_generation", "ape_analysis", "poi_analysis", "evaluation", "broker_review", "agent_context", "_demo",
)
RESPONSE_FIELDS = ("response", "response_text", "raw_text", "raw", "text", "sql_query", "answer", "results")


def agent_steps(payloads: DataFrame, run: str = "run_id", column: str = "payload", keys: list[str] | None = None) -> DataFrame:
    """(run, number, key, response): the steps of a stored payload (a map of key to JSON), known ones in their order, then
    the others by name; only those asked for. The response is the first answer of a step that isn't empty, or the step
    itself where it is no object."""
    place = F.array_position(F.array(*[F.lit(k) for k in STEP_ORDER]), F.col("key"))
    rows = payloads.select(run, F.explode(column).alias("key", "step"))
    rows = rows.where(F.col("key").isin(keys)) if keys else rows
    v = F.try_parse_json("step")
    answer = F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{f}", "string"), F.lit("")) for f in RESPONSE_FIELDS])
    own = F.when(F.trim("step").startswith("{"), answer).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.col("step")))
    order = Window.partitionBy(run).orderBy(F.when(place > 0, place).otherwise(len(STEP_ORDER) + 1), "key")
    return rows.select(run, F.row_number().over(order).alias("number"), "key", own.alias("response"))


def cells(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """A table with single cells set by appended updates (key, column, value, at): of a cell the newest holds, and of equals
    the larger value. Cells without an update stay; keys that the table lacks are left out."""
    last = updates.groupBy(F.col(key).alias("__k"), "column").agg(F.max(F.struct("at", "value")).alias("m"))
    wide = last.groupBy("__k").pivot("column", [c for c in table.columns if c != key]).agg(F.first("m.value"))
    out = table.join(wide.select("__k", *[F.col(c).alias(f"__{c}") for c in wide.columns if c != "__k"]), F.col(key).eqNullSafe(F.col("__k")), "left")
    kinds = dict(table.dtypes)
    return out.select(*[F.coalesce(F.col(f"__{c}").cast(kinds[c]), table[c]).alias(c) if c != key else table[c] for c in table.columns])
