"""A corpus pipeline over ``documents``: quality, near-duplicates, repeated passages, mix, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and, but for the last, gives
back the columns of ``documents``. ``labels`` is read beside them, from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tintmill.llm import mixing, neardup, packing, quality, substring
from tintmill.llm.common import cut, small, table
from tintmill.llm.queries import tokenizer_path
from tintmill.plans.lineage import written

#: Score under which a document is rejected, and the least weight that a score gives in the mix.
REJECT_BELOW, LEAST_WEIGHT = 0.5, 0.05
#: Bytes of a batch of rows on its way to a Python worker: texts are long, and each running task holds a few batches.
BATCH = "8m"


def _sized(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


#: The columns that stages look at.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """``docs`` with further columns under names that no stage or operator uses."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"further_{k}") for k, c in enumerate(docs.columns)))


def _named(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, by their own names, from a result that has those of ``_plain``."""
    return done.select(*(F.col(c if c in OWN else f"further_{k}").alias(c) for k, c in enumerate(docs.columns)))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Decisions go back to rows by id and text, nulls included, so a null id, a null or empty text and
    repeated rows are judged like others, and equal texts alike. Without labels of both kinds
    nothing is rejected. No rows give none; further columns pass through, whatever their names.
    """
    _sized(spark)
    keyed = _plain(docs).withColumn("_hash", F.xxhash64("text"))
    scored = quality.score(keyed, table(spark, sf_dir, "labels"), carry=["doc_id", "_hash"])
    bad = cut(scored.filter(F.col("score") < REJECT_BELOW).select(F.col("doc_id").alias("_bad_id"), F.col("_hash").alias("_bad_hash")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("_bad_id")) & F.col("_hash").eqNullSafe(F.col("_bad_hash"))
    return _named(keyed.join(small(bad, bad.count()), same, "left_anti"), docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest id; of an id's rows, one.

    Rows of null id stay, and so do texts without words (they are like nothing). No rows give none;
    further columns pass through, whatever their names.
    """
    _sized(spark)
    own = _plain(docs)
    found = cut(neardup.near_duplicates(own).groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("kept").alias("kept")).filter("doc_id is not null and (not kept or rows > 1)"))
    n = found.count()
    alone = own.join(small(found.select("doc_id"), n), "doc_id", "left_anti")
    again = own.join(small(found.filter("kept").select("doc_id"), n), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return _named(alone.unionByName(again), docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that occur earlier; those of which nothing is left go.

    Null and empty texts stay as they are. A null id counts as the smallest; rows that share an id
    are one place, of which none repeats another. No rows give none; further columns pass through.
    """
    _sized(spark)
    done = substring.remove_repeats(_plain(docs)).filter("n_removed = 0 or n_removed < n_words")
    return _named(done.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")), docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them, by the quality classifier's score of the text as it is now.

    A null source is one more source; null and empty texts have no words and come with whole epochs.
    Ties of keys go by id and text; repeated rows are taken one by one. The one cut copy a source
    keeps its first words. Without labels of both kinds all weigh the same. No rows give none; further
    columns pass through, whatever their names.
    """
    _sized(spark)
    own = _plain(docs)
    scored = written(quality.score(own, table(spark, sf_dir, "labels")))
    mixed = mixing.mix(scored, carry=own.columns, quality=F.greatest(F.col("score"), F.lit(LEAST_WEIGHT)))
    return _named(mixing.emit(mixed).withColumn("n_chars", F.length("text").cast("long")), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document taken: its token ids, and its place in a training sequence.

    ``row_id`` tells the copies of a document that the mix took several times apart. A null or empty
    text is its end token alone; null ids and repeated rows are packed like others. No rows give none.
    """
    _sized(spark)
    return packing.pack(docs.drop("n_chars"), tokenizer_path(), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("source mix", mix_stage),
    ("best-fit packing", packing_stage),
]
#: SQL expresses neither the classifier nor the mix; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the rows that its predecessor kept."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if k < len(STAGES) - 1 else docs
    return docs
