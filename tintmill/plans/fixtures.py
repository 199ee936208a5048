"""Transaction and graph tables derived from the star schema's orders.

``records`` (seq, block_id, tx_id, outputs) and ``inputs`` (seq, tx_id, pos, prev_tx_id, amount): an
order spends its customer's previous order and, where its key divides by five, the order seven
before it. The key is the arrival order, fifty keys a block; a customer's first order is a coinbase.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lineage import present, written


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("tx_id"), F.expr("o_orderkey div 50").alias("block_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), before.alias("p0"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _orders(spark, sf_dir)
    paid = own.select(F.col("tx_id").alias("prev_tx_id"), F.col("cents").alias("amount"))
    seven = F.when((F.col("tx_id") % 5 == 0) & F.col("p0").isNotNull(), F.col("tx_id") - 7)
    spent = own.select("tx_id", F.posexplode(F.array("p0", seven)).alias("pos", "prev_tx_id")).filter("prev_tx_id is not null")
    return spent.join(paid, "prev_tx_id").select(F.col("tx_id").alias("seq"), "tx_id", "pos", "prev_tx_id", "amount")


def records(spark: SparkSession, sf_dir: str, inputs_: DataFrame | None = None) -> DataFrame:
    named = (inputs(spark, sf_dir) if inputs_ is None else inputs_).groupBy("prev_tx_id").agg(F.count("*").alias("n")).withColumnRenamed("prev_tx_id", "tx_id")
    own = _orders(spark, sf_dir).join(named, "tx_id", "left")
    spare = (F.col("tx_id") % 3 == 0).cast("long")
    return own.select(F.col("tx_id").alias("seq"), "block_id", "tx_id", (F.coalesce("n", F.lit(0)) + spare).alias("outputs"))


_tables: dict[tuple[str, str, str], DataFrame] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, made) -> DataFrame:
    """A table written once a session: it stands for what a source would hold, and is no part of a query."""
    key = spark.sparkContext.applicationId, sf_dir, name
    if key not in _tables or not present(_tables[key]):
        _tables[key] = written(made())
    return _tables[key]


def _paid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "inputs", lambda: inputs(spark, sf_dir))


def stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``records`` and ``inputs`` as tables, written once a session."""
    paid = _paid(spark, sf_dir)
    return _kept(spark, sf_dir, "records", lambda: records(spark, sf_dir, paid)), paid


def broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stream with repeated ids, overspent outputs, unknown ancestors and inputs of zero amount.

    Keys that leave 3 when divided by 11 take the id of the key five before them; keys that divide by
    13 have an output less; inputs of keys that divide by 17 name an id nobody has; every seventh
    amount is zero.
    """
    tx = F.when(F.col("tx_id") % 11 == 3, F.greatest(F.col("tx_id") - 5, F.lit(0))).otherwise(F.col("tx_id"))
    out = F.greatest(F.col("outputs") - (F.col("seq") % 13 == 0).cast("long"), F.lit(0))
    made, paid = stream(spark, sf_dir)
    own = made.select("seq", "block_id", tx.alias("tx_id"), out.alias("outputs"))
    prev = F.when(F.col("seq") % 17 == 0, F.col("prev_tx_id") + 100_000_000).otherwise(F.col("prev_tx_id"))
    spent = paid.select("seq", tx.alias("tx_id"), "pos", prev.alias("prev_tx_id"), F.when(F.col("amount") % 7 == 0, 0).otherwise(F.col("amount")).alias("amount"))
    return own, spent


def _arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order spends which, as ``inputs`` names them; only orders seven back may be ones that aren't there."""
    own = _orders(spark, sf_dir).filter("p0 is not null").select("tx_id", "p0")
    there = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("src"))
    seven = own.filter("tx_id % 5 = 0").select((F.col("tx_id") - 7).alias("src"), F.col("tx_id").alias("dst")).join(there, "src", "left_semi")
    return own.select(F.col("p0").alias("src"), F.col("tx_id").alias("dst")).unionByName(seven)


def graph(spark: SparkSession, sf_dir: str, cycles: bool = True) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (id) and ``arcs`` (src, dst), a table written once a session: spends as arcs, and with ``cycles`` arcs three back from every 97th node."""
    own = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))

    def made() -> DataFrame:
        arcs = _arcs(spark, sf_dir)
        if cycles:
            arcs = arcs.unionByName(own.filter("id % 97 = 0 and id >= 3").select(F.col("id").alias("src"), (F.col("id") - 3).alias("dst")))
        return arcs.distinct()

    return own, _kept(spark, sf_dir, "arcs and cycles" if cycles else "arcs", made)
