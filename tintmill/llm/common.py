"""Shared plumbing: reading tables, words, bounded broadcasts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut  # noqa: F401  for the operators

#: A word: a run of characters outside space, tab and the controls up to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a narrow table (a few dozen bytes a row) may be broadcast.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the limit, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= limit else df


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Batches to Python workers of so many bytes, for what runs inside: long texts stand in memory several times on their way."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def total_chars(docs: DataFrame, text_col: str = "text") -> int:
    return int(docs.agg(F.sum(F.length(text_col))).first()[0] or 0)
