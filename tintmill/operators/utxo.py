"""Keyed state of the stream as relations: versions, spends and what is left unspent.

A record with outputs makes a version of its id, which an input finds if it is the latest earlier
one. A version may be spent as often as it has outputs, in arrival order and, within a record, from
the last input to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Records of a span of the stream, within which a key's events are put in order together.
SPAN = 1 << 20


def limited(records: DataFrame, limit: int | None = 1_000_001) -> DataFrame:
    """The first ``limit`` records by arrival order (all: None)."""
    return records if limit is None else records.filter(F.col("seq") < limit)


def versions(records: DataFrame) -> DataFrame:
    """(tx_id, version_seq, until_seq, outputs): a version holds for records after its own up to ``until_seq`` (null: the end)."""
    order = Window.partitionBy("tx_id").orderBy("seq")
    made = records.filter("outputs > 0")
    return made.select("tx_id", F.col("seq").alias("version_seq"), F.lead("seq").over(order).alias("until_seq"), F.col("outputs").cast("long").alias("outputs"))


def spends(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """``inputs`` with ``version_seq`` (null: none), the version's ``outputs`` and the ``spend_rank`` among its spends.

    An as-of join over the events of a key, in two levels: within a span of the stream the latest
    version before an input is found in order, and spans without one take the last of an earlier
    span. Spends are numbered alike. So a key with a third of all events is dealt over its spans, no
    version meets a spend that isn't its own, and wide rows are exchanged once.
    """
    span = F.expr(f"seq div {SPAN}").alias("_span")
    paid = F.struct(*inputs.columns)
    bought = inputs.select(F.col("prev_tx_id").alias("_key"), "seq", F.lit(0).alias("_kind"), paid.alias("_input"), F.lit(None).cast("struct<v:bigint,o:bigint>").alias("_made"), span)
    made = records.filter("outputs > 0").select(F.col("tx_id").alias("_key"), "seq", F.lit(1).alias("_kind"), F.lit(None).cast(bought.schema["_input"].dataType).alias("_input"), F.struct(F.col("seq").alias("v"), F.col("outputs").cast("long").alias("o")).alias("_made"), span)
    # Inputs come before the version of their own record.
    inside = Window.partitionBy("_key", "_span").orderBy("seq", "_kind")
    events = bought.unionByName(made).withColumn("_near", F.last("_made", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = Window.partitionBy("_key").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = events.groupBy("_key", "_span").agg(F.max("_made").alias("_end"), F.count("_input").alias("_n")).withColumn("_far", F.last("_end", ignorenulls=True).over(earlier))
    ends = ends.filter("_n > 0").select("_key", "_span", "_far")
    found = events.filter("_kind = 0").join(ends, ["_key", "_span"]).withColumn("_at", F.coalesce("_near", "_far")).select("_key", "_span", "_input", F.col("_at.v").alias("version_seq"), F.col("_at.o").alias("outputs"))
    own = Window.partitionBy("_key", "_span", "version_seq").orderBy("_input.seq", F.col("_input.pos").desc())
    found = found.withColumn("_rank", F.row_number().over(own))
    before = Window.partitionBy("_key", "version_seq").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = found.groupBy("_key", "_span", "version_seq").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = counts.select(F.col("_key").alias("_k"), F.col("_span").alias("_s"), F.col("version_seq").alias("_v"), "_before").filter("_before > 0")
    same = (F.col("_key") == F.col("_k")) & (F.col("_span") == F.col("_s")) & (F.col("version_seq") == F.col("_v"))
    rank = F.when(F.col("version_seq").isNotNull(), F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long")
    return found.join(counts, same, "left").select(*(F.col(f"_input.{c}").alias(c) for c in inputs.columns), "version_seq", "outputs", rank.alias("spend_rank"))


def unknown_message() -> Column:
    """What is said of an input (tx_id, prev_tx_id) that finds nothing to spend."""
    return F.concat(F.lit("transaction "), F.col("tx_id").cast("string"), F.lit(" spends unknown transaction "), F.col("prev_tx_id").cast("string"))


def unknown(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """Spends of an unknown transaction: (seq, pos, tx_id, prev_tx_id), with no version or none of its outputs left."""
    return spends(records, inputs).filter("version_seq is null or spend_rank > outputs").select("seq", "pos", "tx_id", "prev_tx_id")


def first_unknown(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """The failure that stops a strict run, at most one row with its ``message``: the earliest record's last such input."""
    first = unknown(records, inputs).orderBy("seq", F.col("pos").desc()).limit(1)
    return first.withColumn("message", unknown_message())


def checked(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """``spends`` that raises an error at an unknown transaction, wherever its rows are read."""
    found = spends(records, inputs)
    bad = F.col("version_seq").isNull() | (F.col("spend_rank") > F.col("outputs"))
    fail = F.raise_error(unknown_message()).cast("long")
    return found.withColumn("version_seq", F.when(bad, fail).otherwise(F.col("version_seq")))


def remaining(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """(tx_id, version_seq, outputs, spent, unspent, live) of every version; displaced and spent ones aren't live."""
    used = spends(records, inputs).filter("spend_rank <= outputs").groupBy("version_seq").agg(F.count("*").alias("spent"))
    own = versions(records).join(used, "version_seq", "left").withColumn("spent", F.coalesce("spent", F.lit(0)))
    return own.select("tx_id", "version_seq", "outputs", "spent", (F.col("outputs") - F.col("spent")).alias("unspent"), (F.col("until_seq").isNull() & (F.col("spent") < F.col("outputs"))).alias("live"))


def live(records: DataFrame, inputs: DataFrame) -> DataFrame:
    """The versions that a record after the last could spend."""
    return remaining(records, inputs).filter("live").drop("live")
