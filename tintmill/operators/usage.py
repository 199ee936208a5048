"""What the live colors hold as the stream goes on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import utxo


def lifetimes(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """(version_seq, gone): the record that spends a version's last output or displaces it (null: none does)."""
    last = utxo.spends(records, inputs).filter("spend_rank = outputs").select("version_seq", F.col("seq").alias("used"))
    return utxo.versions(records).join(last, "version_seq", "left").select("version_seq", F.least("used", "until_seq").alias("gone"))


def progress(records: DataFrame, inputs: DataFrame, sizes: DataFrame, every: int, n: int) -> DataFrame:
    """(records, live, peak, txs) after each ``every`` of the ``n`` records, for colors of (seq, size).

    ``live`` sums the sizes of the versions that may still be spent, ``txs`` counts them, ``peak`` is
    the largest ``live`` after any record so far. Sizes are those of the colors themselves: versions
    with equal colors count each. A version adds its size when it comes and takes it away when it
    goes; running sums are taken within spans of ``every`` records, then over the spans.
    """
    held = lifetimes(records, inputs).join(sizes, F.col("version_seq") == F.col("seq")).select("version_seq", "gone", "size")
    change = F.explode(F.array(F.struct(F.col("version_seq").alias("seq"), F.lit(1).alias("n"), F.col("size").alias("d")), F.struct(F.col("gone").alias("seq"), F.lit(-1).alias("n"), (-F.col("size")).alias("d"))))
    each = held.select(change.alias("c")).select("c.*").filter("seq is not null").groupBy("seq").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).withColumn("span", F.expr(f"seq div {every}"))
    inside = each.withColumn("upto", F.sum("d").over(Window.partitionBy("span").orderBy("seq")))
    spans = inside.groupBy("span").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("upto").alias("top"))
    whole = records.sparkSession.range(n // every).withColumnRenamed("id", "span").join(spans, "span", "left").na.fill(0, ["n", "d", "top"])
    order = Window.orderBy("span")
    whole = whole.withColumn("live", F.sum("d").over(order)).withColumn("txs", F.sum("n").over(order))
    whole = whole.withColumn("peak", F.max(F.col("live") - F.col("d") + F.greatest("top", F.lit(0))).over(order))
    return whole.select(((F.col("span") + 1) * every).alias("records"), "live", "peak", "txs")
