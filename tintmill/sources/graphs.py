"""Graphs as tables of nodes and arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_arcs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(src, dst) of a Parquet, CSV or whitespace-separated text table; repeated arcs count once."""
    if fmt == "text":
        part = F.split(F.trim("value"), r"\s+")
        own = spark.read.text(path).filter("trim(value) <> '' and not startswith(value, '#')").select(part[0].cast("long").alias("src"), part[1].cast("long").alias("dst"))
    elif fmt == "csv":
        own = spark.read.csv(path, schema="src long, dst long")
    else:
        own = spark.read.parquet(path).select(F.col("src").cast("long"), F.col("dst").cast("long"))
    return own.distinct()


def nodes_of(spark: SparkSession, n: int) -> DataFrame:
    """Nodes 0 to n-1."""
    return spark.range(n)


def successors(arcs: DataFrame) -> DataFrame:
    """(src, successors): each node's arcs, ascending."""
    return arcs.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("successors"))
