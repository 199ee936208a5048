"""Document fingerprints: threshold-scaled sketches, by DataFrame functions alone.

A fingerprint keeps every shingle hash below a fixed fraction of the hash range. Which hashes stay
doesn't depend on the document's other shingles, so fingerprints merge by union and estimate
containment between documents of very unequal size. A shingle is a run of five words, and at the
text's two ends the shorter runs that reach it, so that a text of four words has several.

A text of at most ``WHOLE`` shingles keeps them all: its fraction is one. The fraction is part of the
sketch, and two sketches are compared, or merged, at the lesser fraction of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

SHINGLE, FRACTION, WHOLE = 5, 0.25, 64
#: Rows of (id, hash) that are put in order together, about.
RANGE_ROWS = 1_000_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where a lambda refers to it."""
    return F.transform(F.array(value), body)[0]


def _limit(fraction: float) -> Column:
    return F.lit(int(fraction * 2**64) - 2**63)


def sketch(text: Column, size: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """A struct of ``part`` (the fraction kept, in 64ths) and ``hashes``: ascending distinct hashes of the text's shingles.

    Without words there are none, and the fraction is one.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))

    def shingles(w: Column) -> Column:
        # Places before the first word and after the last are null, which a hash passes over.
        begins = F.when(F.size(w) > 0, F.sequence(F.lit(1 - size), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(begins, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size)))))

    def kept(h: Column) -> Column:
        whole = F.size(h) <= WHOLE
        part = F.when(whole, F.lit(64)).otherwise(F.lit(int(fraction * 64)))
        return F.struct(part.alias("part"), F.array_sort(F.when(whole, h).otherwise(F.filter(h, lambda x: x < _limit(fraction)))).alias("hashes"))

    return _let(_let(F.transform(words, lambda x: F.xxhash64(x)), shingles), kept)


def _common(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The lesser fraction of two sketches, and their hashes below it."""
    part = F.least(a["part"], b["part"])
    # part / 64 of the range, whose least value is -2**63.
    limit = (F.least(part, F.lit(63)) - 32).cast("long") * F.lit(2**58)
    cut_ = lambda x: F.when(x["part"] == part, x["hashes"]).otherwise(F.filter(x["hashes"], lambda h: h < limit))
    return part, cut_(a), cut_(b)


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents' shingles together, at the lesser fraction of both."""
    part, x, y = _common(a, b)
    return F.struct(part.alias("part"), F.array_sort(F.array_union(x, y)).alias("hashes"))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles in all of both; two equal sketches have 1, also without hashes."""
    _, x, y = _common(a, b)
    both = F.size(F.array_intersect(x, y))
    return F.when(a == b, 1.0).otherwise(F.coalesce(both / F.nullif(F.size(x) + F.size(y) - both, F.lit(0)), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 0 for a sketch without hashes."""
    _, x, y = _common(a, b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(x), F.lit(0)), F.lit(0.0))


def printed(sketch_: Column) -> Column:
    """A sketch as text: its fraction in 64ths, then its hashes in hexadecimal, joined by spaces; empty without hashes."""
    hashes = F.array_join(F.transform(sketch_["hashes"], lambda h: F.lower(F.hex(h))), " ")
    return F.when(F.size(sketch_["hashes"]) > 0, F.concat(sketch_["part"].cast("string"), F.lit(":"), hashes)).otherwise(F.lit(""))


def following(keys: DataFrame) -> DataFrame:
    """``keys`` (_id, _tie, ...), distinct by the first two, with ``_next``: the struct of the row after it in their order, cyclically.

    Narrow rows are dealt into ranges of the order, whatever the ids' spread; each range finds its
    own followers, and its last row takes the first of the next range from a table of the ranges.
    """
    own = F.struct(*keys.columns)
    parts = max(1, -(-keys.count() // RANGE_ROWS))
    order = (F.col("_id").asc_nulls_first(), F.col("_tie").asc())
    dealt = cut(keys.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order)
    rows = dealt.withColumn("_next", F.lead(own).over(inside))
    heads = dealt.groupBy("_range").agg(F.min(own).alias("_head"))
    along = Window.orderBy("_range")
    first = F.first("_head").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("_range").alias("_r"), F.coalesce(F.lead("_head").over(along), first).alias("_far"))
    return rows.join(heads, F.col("_range") == F.col("_r")).withColumn("_next", F.coalesce("_next", "_far")).drop("_range", "_r", "_far")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document, by ascending id; the first follows the last. Likenesses compare the
    text's sketch with the edited text's and the next document's; equal sketches have 1.

    A null text is an empty one: no code points, an empty fingerprint. Null ids come first; rows
    that share an id follow each other by a hash of the text, rows of the same text directly. A table
    of one row follows itself; an empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), text.alias("_t")).withColumn("_tie", F.xxhash64("_t"))
    # The order needs ids, hashes and lengths alone. Repeated rows are one key.
    keys = cut(own.select("_id", "_tie", F.length("_t").alias("_n")).groupBy("_id", "_tie").agg(F.first("_n").alias("_n"), F.count("*").alias("_rows")))
    links = following(keys)

    def key(id_: Column, tie: Column) -> list[Column]:
        return [F.coalesce(id_, F.lit(0)).alias("_k"), id_.isNull().alias("_null"), tie.alias("_tie")]

    # A text goes to its key's place once; from there its beginning and its sketch go to the document before.
    texts = own.select(*key(F.col("_id"), F.col("_tie")), "_t").groupBy("_k", "_null", "_tie").agg(F.first("_t").alias("_t"))
    before = F.struct(*key(F.col("_id"), F.col("_tie")), F.floor(F.col("_n") / 4).cast("int").alias("m"), F.col("_rows").alias("rows"))
    asked = links.select(*key(F.col("_next._id"), F.col("_next._tie")), before.alias("_before"))
    told = asked.join(texts, ["_k", "_null", "_tie"]).select(*(F.col(f"_before.{c}") for c in ("_k", "_null", "_tie")), F.col("_before.m").alias("_m"), F.col("_before.rows").alias("_rows"), F.substring("_t", F.lit(1), F.col("_before.m")).alias("_nh"), sketch(F.col("_t")).alias("_ns"))
    rows = texts.join(told, ["_k", "_null", "_tie"]).withColumn("_s", sketch(F.col("_t"))).withColumn("_id", F.when(~F.col("_null"), F.col("_k")))
    # Of equal rows each follows the other, and the last the next key.
    again = F.when(F.col("_rows") > 1, F.array(F.struct((F.col("_rows") - 1).alias("n"), F.substring("_t", F.lit(1), F.col("_m")).alias("h"), F.col("_s").alias("s"))))
    last = F.array(F.struct(F.lit(1).cast("long").alias("n"), F.col("_nh").alias("h"), F.col("_ns").alias("s")))
    rows = rows.withColumn("_f", F.explode(F.concat(last, F.coalesce(again, F.slice(last, 1, 0)))))
    rows = rows.withColumn("_n", F.length("_t")).withColumn("_e", F.concat(F.substring("_t", F.lit(1), F.col("_n") - F.col("_m")), F.col("_f.h")))
    rows = rows.withColumn("_es", sketch(F.col("_e")))
    out = rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_n").cast("long").alias("n_chars"),
        F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"),
        printed(F.col("_s")).alias("fingerprint"),
        printed(F.col("_es")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_es")).alias("near_edited"),
        likeness(F.col("_s"), F.col("_f.s")).alias("near_next"),
        F.col("_f.n").alias("_times"),
    )
    return out.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times")
