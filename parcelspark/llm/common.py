"""Shared helpers: written cuts of the lineage, tokenizer files, distributed prefix sums, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, may leave it unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple:
    """(file system, path) of the JVM's Hadoop client."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own part of the shared folder. It is deleted when the driver's JVM ends: what
    is cut there outlives executors, not the application."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.deleteOnExit(p)
    return path


#: Where the rows of each frame made by `cut` lie.
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: later stages don't depend on executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files of cuts that no later step reads."""
    for df in frames:
        if path := _PATHS.pop(df, None):
            fs, p = file_system(df.sparkSession, path)
            fs.delete(p, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows: what Python makes of a batch is held until its end."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tokenizer_path(name: str) -> str:
    """A vocabulary file; TOKENIZER_DIR may name another folder."""
    own = os.environ.get("TOKENIZER_DIR")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def prefix_sums(df: DataFrame, group: str, value: str, order: list[str], bucket_rows: int = 1024, rows: int | None = None) -> DataFrame:
    """Add __start (sum of `value` before the row within `group`) and __bucket, __pos that identify the row.

    Three levels, so that no task gets a whole group: rows are dealt into hashed buckets of about bucket_rows, each summed
    by itself; buckets' totals are summed within blocks of bucket_rows buckets; only the blocks' totals, one row for about
    bucket_rows^2 rows of the table, are summed in one task of a group.
    """
    n = df.count() if rows is None else rows
    buckets = max(1, -(-n // bucket_rows))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("long"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = Window.partitionBy(group, "__bucket").orderBy(*order)
    local = dealt.withColumn("__pos", F.row_number().over(inner)).withColumn("__local", F.sum(value).over(upto(inner)) - F.col(value))
    totals = dealt.groupBy(F.col(group).alias("__g"), F.col("__bucket").alias("__b")).agg(F.sum(value).alias("__t"))
    totals = totals.withColumn("__block", F.floor(F.col("__b") / bucket_rows))
    middle, outer = Window.partitionBy("__g", "__block").orderBy("__b"), Window.partitionBy("__g2").orderBy("__block2")
    blocks = totals.groupBy(F.col("__g").alias("__g2"), F.col("__block").alias("__block2")).agg(F.sum("__t").alias("__t2"))
    blocks = blocks.withColumn("__base2", F.sum("__t2").over(upto(outer)) - F.col("__t2")).drop("__t2")
    totals = totals.withColumn("__base", F.sum("__t").over(upto(middle)) - F.col("__t"))
    totals = totals.join(blocks, totals["__g"].eqNullSafe(blocks["__g2"]) & (totals["__block"] == blocks["__block2"]))
    totals = totals.select("__g", "__b", (F.col("__base") + F.col("__base2")).alias("__base"))
    joined = local.join(totals, local[group].eqNullSafe(totals["__g"]) & (local["__bucket"] == totals["__b"]))
    return joined.withColumn("__start", F.col("__local") + F.col("__base")).drop("__g", "__b", "__base", "__local")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges: every node that has an edge, with the smallest node of its component as root.

    Alternates large-star and small-star steps, each a grouping with a map-side minimum and a join, until no edge
    changes, which takes about log^2 of the longest chain in rounds. Each round is cut. A star's centre gets its edges
    through joins that AQE can split, never a list.
    """
    cur = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    last = None
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "cc")
        # An xor of hashes over the edges tells whether a round changed them; with counts it is as good as equality.
        mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)"))).first())
        now = mark(new)
        drop_cut(cur)
        cur = new
        if now == last or now[0] == 0:
            break
        last = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
