"""Readers and writers of the text formats: CSV, baskets, edge lists, adjacency files, ledgers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_LOCAL: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, or in a temporary folder where that is unset; removed with the driver's process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        if not _LOCAL or not os.path.isdir(_LOCAL[0]):
            _LOCAL[:] = [tempfile.mkdtemp(prefix="minekit-")]
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = f"file://{_LOCAL[0]}"
    path = f"{base.rstrip('/')}/minekit-{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def parse_date_columns(df: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Every string column whose name contains "date" (any case) becomes a date."""
    names = [c for c, kind in df.dtypes if "date" in c.lower() and kind == "string"]
    return df.withColumns({c: F.to_date(c, fmt) for c in names})


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """(basket, item): one basket a line, integers parted by white space, each item once. Empty lines are no baskets."""
    lines = spark.read.text(path).withColumn("basket", F.monotonically_increasing_id())
    items = F.array_distinct(F.split(F.trim("value"), r"\s+"))
    return lines.where(F.trim("value") != "").select("basket", F.explode(items).alias("item")).select("basket", F.col("item").cast("long").alias("item"))


def undirected(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Each edge once with u < v; loops and repeats go."""
    return edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).distinct()


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(u, v) of lines of two integers, without loops and repeats."""
    parts = F.split(F.trim("value"), r"\s+")
    return undirected(spark.read.text(path).where(F.trim("value") != "").select(parts[0].cast("long").alias("u"), parts[1].cast("long").alias("v")))


def parse_edge_lines(lines: DataFrame) -> DataFrame:
    """The same on a stream of lines, where repeats are left to the consumer."""
    parts = F.split(F.trim("value"), r"\s+")
    own = lines.where(F.trim("value") != "").select(parts[0].cast("long").alias("a"), parts[1].cast("long").alias("b"))
    return own.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def read_edge_list(spark: SparkSession, path: str, weight: bool = False) -> DataFrame:
    """(src, dst, w) in both directions from comma-separated lines; of repeated edges the greatest weight stays."""
    own = spark.read.schema("src long, dst long" + ", w double" * weight).csv(path)
    own = own if weight else own.withColumn("w", F.lit(1.0))
    both = own.unionByName(own.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(F.max("w").alias("w"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(id, neighbour) of an adjacency file: comment lines before the header n m, then line i lists the neighbours of vertex i.

    Lines are numbered inside each file split and shifted by the splits before it, so no task
    reads the whole file. Comments behind the header take a vertex number, as the format has it.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    sizes = lines.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    numbered = lines.join(F.broadcast(before), "part").select("value", (F.col("o") + F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)).alias("line"))
    comment = F.col("value").rlike("^[%#]")
    head = numbered.where(~comment & (F.trim("value") != "")).agg(F.min("line").alias("h"))
    body = numbered.crossJoin(F.broadcast(head)).where((F.col("line") > F.col("h")) & ~comment)
    found = body.select((F.col("line") - F.col("h")).alias("id"), F.explode(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).alias("neighbour"))
    return found.select("id", F.col("neighbour").cast("long").alias("neighbour"))


def append_ledger(old: DataFrame | None, row: DataFrame) -> DataFrame:
    """A score ledger with a row more: columns are united, doubles rounded to 6 digits."""
    row = row.withColumns({c: F.round(c, 6) for c, kind in row.dtypes if kind == "double"})
    return row if old is None else old.unionByName(row, allowMissingColumns=True)


def write_submission(df: DataFrame, path: str, id_col: str = "id", pred_col: str = "prediction") -> None:
    df.select(id_col, pred_col).write.mode("overwrite").option("header", True).csv(path)
