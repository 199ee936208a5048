"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source whose target is t times its size gives floor(t) complete epochs, then a fractional one:
documents in the order of exponential keys -ln(u) / w, w being a document's quality weight (any
column: a classifier's score, say) and u a hash of its id and text, until their summed sizes reach the rest of the target. The document at which
they do is cut: the mix takes as many of its first words as the budget has left.

The prefix sum doesn't gather a source anywhere. Keys fall into 256 * 256 buckets a source; the
buckets' sums locate the one in which the budget ends, and only that bucket's documents are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, small, word_count

WEIGHTS, CAP = (5.0, 2.0, 1.0), 3.0
_SIDE = 256


def quality_weight(text: Column) -> Column:
    """0.1 to 1: the share of letters and white space among a text's characters; 1 for an empty text."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    return F.coalesce(F.greatest(F.lit(0.1), plain / F.nullif(F.length(text), F.lit(0))), F.lit(1.0))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP) -> DataFrame:
    """(_source, _total) with ``_target``: weights by the sources' code point order (null last), repeating.

    The sources share ``share`` of all sizes by weight; none gets more than ``cap`` times its size,
    and what that frees goes to the others by weight. Reading the sources in the order of cap to
    weight, those before the first that its share doesn't fill stop at their cap; one level, target
    per weight, holds for the others. A row a source is sorted in one task here, never documents.
    """
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.col("_total") * cap).withColumn("_fills", F.col("_cap") / F.col("_weight"))
    order = Window.orderBy("_fills", "_rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ranked.withColumn("_level", (F.sum("_total").over(everything) * share - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    open_ = F.when(F.col("_fills") >= F.col("_level"), F.struct("_fills", "_rank", "_level"))
    level = level.withColumn("_level", F.min(open_).over(everything)["_level"])
    capped = F.col("_level").isNull() | (F.col("_fills") < F.col("_level"))
    return level.select("_source", "_total", F.when(capped, F.col("_cap")).otherwise(F.col("_weight") * F.col("_level")).alias("_target"))


def mix(docs: DataFrame, carry: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.0, cap: float = CAP, quality: Column | None = None, seed: int = 17) -> DataFrame:
    """The columns ``carry`` (all by default) of every row, with ``size, source_size, target, taken, copies, part``.

    ``taken`` is ``copies`` times ``size`` plus ``part``: the words of the row's document in the mix.
    ``copies`` is the source's complete epochs, and one more where the fractional epoch selects the
    row; ``quality`` is the weight, by default the text's share of letters; ``part`` counts the first words of a cut copy, of one document a source at most. A source's
    taken words miss its target by a word at most. Reruns agree.

    A null or empty text has size 0; a null source is a source of its own, the last. A null id draws
    a key by its text. Rows of equal id and text share a key and are taken one by one. An empty table gives
    no rows; all sources empty give targets of 0. Carried columns with the names of new ones are
    replaced by these.
    """
    new = {"size", "source_size", "target", "taken", "copies", "part"}
    carry = [c for c in (docs.columns if carry is None else carry) if c.lower() not in new]
    text = F.col(f"`{text_col}`")
    u = (F.shiftrightunsigned(F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    key = -F.log(u) / (quality_weight(text) if quality is None else quality)
    base = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry), F.lit(True).alias("_all")).alias("_row"), F.col(f"`{source_col}`").alias("_source"), word_count(text).alias("_size"), F.col(f"`{id_col}`").alias("_id"), F.xxhash64(text).alias("_tie"), key.alias("_key"))
    base = base.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * _SIDE * _SIDE), F.lit(_SIDE * _SIDE - 1)).cast("int"))
    if text_col not in carry:
        base = cut(base)

    sums = cut(base.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_sum")))
    plan = targets(sums.groupBy("_source").agg(F.sum("_sum").alias("_total")), weights, share, cap)
    plan = plan.withColumn("_epochs", F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total"))).otherwise(F.lit(0)).cast("long"))
    plan = cut(plan.withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_total")))
    n = plan.count()

    def ends(df: DataFrame, part: Column) -> DataFrame:
        """By source, the part in which the summed sizes reach ``_rest``, and the sum before it."""
        df = df.withColumn("_part", part).groupBy("_source", "_part", "_rest").agg(F.sum("_sum").alias("_sum"))
        upto = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_part"))
        return df.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_rest")) & (F.col("_upto") - F.col("_sum") < F.col("_rest"))).select("_source", F.col("_part"), (F.col("_upto") - F.col("_sum")).alias("_before"))

    def with_source(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
        other = other.withColumnRenamed("_source", "_other")
        return df.join(small(other, n), F.col("_source").eqNullSafe(F.col("_other")), how).drop("_other")

    open_ = with_source(sums, plan.filter("_rest > 0").select("_source", "_rest"))
    coarse = ends(open_, F.floor(F.col("_bucket") / _SIDE))
    inner = with_source(open_, coarse.withColumnRenamed("_part", "_coarse")).filter(F.floor(F.col("_bucket") / _SIDE) == F.col("_coarse"))
    fine = ends(inner.withColumn("_rest", F.col("_rest") - F.col("_before")), F.col("_bucket")).withColumnRenamed("_before", "_inside")
    bounds = with_source(plan, fine, "left")
    bounds = cut(with_source(bounds, coarse.select("_source", "_before"), "left").select("_source", "_total", "_target", "_epochs", (F.col("_rest") - F.col("_before") - F.col("_inside")).alias("_rest"), F.coalesce("_part", F.lit(-1)).alias("_bound")))

    rows = with_source(base, bounds)
    clear = rows.filter("_bucket <> _bound").select("*", (F.col("_bucket") < F.col("_bound")).cast("long").alias("_more"), F.lit(0).cast("long").alias("_cut"))
    before = F.sum("_size").over(Window.partitionBy("_source").orderBy("_key", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    left = F.least(F.greatest(F.round(F.col("_rest") - before), F.lit(0.0)), F.col("_size")).cast("long")
    edge = rows.filter("_bucket = _bound").withColumn("_left", left).withColumn("_more", (F.col("_left") == F.col("_size")).cast("long"))
    edge = edge.withColumn("_cut", F.when(F.col("_more") == 0, F.col("_left")).otherwise(F.lit(0))).drop("_left")
    copies = F.col("_epochs") + F.col("_more")
    facts = (F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (copies * F.col("_size") + F.col("_cut")).alias("taken"), copies.alias("copies"), F.col("_cut").alias("part"))
    return clear.unionByName(edge).select(*(F.col(f"_row.`{c}`").alias(c) for c in carry), *facts)


def emit(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: every row of ``mix``'s result as often as it is taken, a cut copy with its first words.

    Rows taken not at all go; so do texts without words, unless their source has a complete epoch
    or the fractional one passes them.
    """
    whole = mixed.filter("copies > 0").withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_n")
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("part").cast("int")), " ")
    return whole.unionByName(mixed.filter("part > 0").withColumn(text_col, head)).drop("size", "source_size", "target", "taken", "copies", "part")
