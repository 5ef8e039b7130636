"""Writers: the dataset, POI file, runs, feedback, traces."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from parcelspark.operators.finalise import feedback_export
from parcelspark.operators.spatial import poi_tree


def dataset(df: DataFrame, path: str, skip_existing: bool = True) -> bool:
    """Write Parquet; with skip_existing a table that is there stays. Returns whether it wrote."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if skip_existing and p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def pois_json(pois: DataFrame, path: str) -> None:
    """A folder with a nested JSON file for each category, so that no task holds more than one; readers.pois reads it."""
    poi_tree(pois).select(F.to_json("tree").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def safe(c: Column, kind: DataType) -> Column:
    """A value without NaN and infinities, at any depth: null stands in for them. Times come out in ISO form as JSON does it."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if not any(isinstance(k, (DoubleType, FloatType)) for k in leaves(kind)):
        return c
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: safe(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: safe(v, kind.valueType))
    return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))


def leaves(kind: DataType) -> list[DataType]:
    if isinstance(kind, ArrayType):
        return leaves(kind.elementType)
    if isinstance(kind, MapType):
        return leaves(kind.valueType)
    return [x for f in kind.fields for x in leaves(f.dataType)] if isinstance(kind, StructType) else [kind]


def json_safe(df: DataFrame) -> DataFrame:
    """df with NaN and infinities as null at any depth, so that it is valid JSON."""
    return df.select(*[safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def json_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON with all fields, null ones too; timestamps in ISO form."""
    safe = json_safe(df)
    safe.select(F.to_json(F.struct(*safe.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def traces(steps: DataFrame, path: str, run: str = "run", order: str = "position") -> None:
    """A trace of each run as a JSON line: the run and its steps in order, with all fields, in a file for each part."""
    fields = [c for c in steps.columns if c != run]
    rows = json_safe(steps).groupBy(run).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in fields if c != order]))).alias("steps"))
    rows.select(F.to_json(F.struct(run, "steps"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def append(df: DataFrame, path: str) -> None:
    """Append to a store whose newest row of a key holds (see operators.finalise.latest)."""
    df.write.mode("append").parquet(path)


def feedback_csv(feedback: DataFrame, path: str) -> None:
    feedback_export(feedback).write.mode("overwrite").option("header", True).csv(path)


def newest(names: list[str], keep: int = 10) -> tuple[list[str], list[str]]:
    """(kept, dropped) of run files by name, which begins with their time."""
    order = sorted(names, reverse=True)
    return order[:keep], order[keep:]


def keep_newest(spark: SparkSession, folder: str, keep: int = 10) -> list[str]:
    """Delete all but the newest run files of a folder, by name; returns the names deleted. A folder that isn't there has none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    there = {s.getPath().getName(): s.getPath() for s in fs.listStatus(path)}
    dropped = newest([n for n in there if not n.startswith((".", "_"))], keep)[1]
    for n in dropped:
        fs.delete(there[n], True)
    return dropped


def latex(df: DataFrame, caption: str, limit: int = 1000) -> str:
    """A bounded table as a LaTeX table: numbers to 3 decimals, special characters escaped."""
    escaped = lambda t: re.sub(r"([&%$#_{}])", r"\\\1", t.replace("\\", r"\textbackslash "))
    cell = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else escaped(str(v))
    rows = [" & ".join(map(cell, r)) + r" \\" for r in df.limit(limit).collect()]
    head = " & ".join(map(escaped, df.columns)) + r" \\"
    return "\n".join([r"\begin{table}", rf"\caption{{{escaped(caption)}}}", rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\toprule", head, r"\midrule", *rows, r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A bounded table as Markdown."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
