"""Coloring a stream of records, batch by batch, against a table of what is unspent.

Each micro-batch looks up the live versions of the ids that it names, resolves its spends among
those and its own versions, colors its records, appends their lines and writes what became of the
ids as a change. Live versions are the last change of each id since a base table; a new base is
written once the changes since have as many rows as the base, so a version is rewritten a few times,
not every batch, and no batch touches the colors of ids it doesn't name. Batches are replayed from
the changes before them, so a batch that is tried again gives the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import color, utxo
from ..plans.lineage import cut

_LIVE = "tx_id long, version_seq long, unspent long, color array<struct<block:long,w:double>>"
#: Rows of changes for which a base is written at least.
BASE_ROWS = 1000


def step(live: DataFrame, records: DataFrame, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(colors, next live table) of a batch of records (seq, block_id, tx_id, outputs, inputs) after ``live``.

    Live versions join the batch as records that came before and whose colors are known. A spend of
    an unknown transaction is an error; nothing is dropped for being late. ``live`` may leave out
    versions of ids that the batch doesn't name; the next table leaves them out too.
    """
    batch = cut(records)
    edges = batch.select("seq", "tx_id", F.explode("inputs").alias("i")).select("seq", "tx_id", "i.pos", "i.prev_tx_id", "i.amount")
    held = live.select(F.col("version_seq").alias("seq"), F.lit(0).cast("long").alias("block_id"), "tx_id", F.col("unspent").alias("outputs"))
    every = cut(held.unionByName(batch.select("seq", "block_id", "tx_id", "outputs")))
    found = cut(utxo.checked(every, edges))
    known = live.select(F.col("version_seq").alias("seq"), F.explode("color").alias("c")).select("seq", "c.block", "c.w")
    fresh = color.coinbase(batch.select("seq", "tx_id", "block_id"), edges).select("seq", "block", F.lit(1.0).alias("w"))
    base = known.unionByName(fresh)
    if weighted:
        reach = color._reach(base, color._edges(color.shares(found), F.col("share")))
    else:
        reach = color._reach(base.select("seq", "block"), color._edges(found, None)).withColumn("w", F.lit(1.0))
    left = utxo.live(every, edges)
    colors = reach.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("block", "w"))).alias("color"))
    next_ = left.join(colors, left["version_seq"] == colors["seq"]).select("tx_id", "version_seq", "unspent", "color")
    return reach.join(batch.select("seq"), "seq", "left_semi"), next_


def named(records: DataFrame) -> DataFrame:
    """(tx_id): the ids that a batch spends or makes."""
    return records.select("tx_id").unionByName(records.select(F.explode("inputs").alias("i")).select(F.col("i.prev_tx_id").alias("tx_id"))).distinct()


class Changes:
    """Live versions as a base table and the changes after it, a table a batch, in a shared folder.

    A change (tx_id, version_seq, unspent, color) without a version says that the id has none left.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        self.files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.at = at

    def numbers(self, kind: str) -> list[int]:
        """Batches that have a finished table of a kind."""
        if not self.files.exists(self.at):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in self.files.listStatus(self.at)]
        return sorted(int(x.partition("=")[2]) for x in names if x.startswith(f"{kind}=") and self.files.exists(path(f"{self.folder}/{x}/_SUCCESS")))

    def live(self, before: int, ids: DataFrame | None = None) -> DataFrame:
        """Live versions before a batch; of those ids alone, if given."""
        base = max((n for n in self.numbers("base") if n < before), default=-1)
        tables = [("base", base)] * (base >= 0) + [("change", n) for n in self.numbers("change") if base < n < before]
        rows = self.spark.createDataFrame([], f"{_LIVE}, _n long")
        for kind, n in tables:
            own = self.spark.read.schema(_LIVE).parquet(f"{self.folder}/{kind}={n}").withColumn("_n", F.lit(n).cast("long"))
            rows = rows.unionByName(own if ids is None else own.join(ids, "tx_id", "left_semi"))
        last = rows.groupBy("tx_id").agg(F.max_by(F.struct("version_seq", "unspent", "color"), "_n").alias("v"))
        return last.select("tx_id", "v.version_seq", "v.unspent", "v.color").filter("version_seq is not null")

    def add(self, number: int, ids: DataFrame, next_: DataFrame) -> None:
        """Writes what became of a batch's ids, and a base where one is due; earlier tables that no replay needs go."""
        ids.join(next_, "tx_id", "left").select("tx_id", "version_seq", "unspent", "color").write.mode("overwrite").parquet(f"{self.folder}/change={number}")
        bases = [n for n in self.numbers("base") if n < number]
        base = bases[-1] if bases else -1
        count = lambda kind, n: self.spark.read.parquet(f"{self.folder}/{kind}={n}").count()
        since = sum(count("change", n) for n in self.numbers("change") if base < n <= number)
        if since >= max(BASE_ROWS, count("base", base) if base >= 0 else 0):
            self.live(number + 1).write.mode("overwrite").parquet(f"{self.folder}/base={number}")
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
            for kind in ("base", "change"):
                for n in self.numbers(kind):
                    # The batch just done may be tried again, from the base before.
                    if n < base or (n == base and kind == "change"):
                        self.files.delete(path(f"{self.folder}/{kind}={n}"), True)


def start(stream: DataFrame, state: str, out: str, weighted: bool = False, **options: str) -> StreamingQuery:
    """Colors the stream into Parquet files under ``out``; changes of the live versions stand under ``state``."""
    changes = Changes(stream.sparkSession, state)

    def run(batch: DataFrame, number: int) -> None:
        batch = cut(batch)
        ids = cut(named(batch))
        colors, next_ = step(cut(changes.live(number, ids)), batch, weighted)
        (colors if weighted else colors.drop("w")).write.mode("overwrite").parquet(f"{out}/batch={number}")
        changes.add(number, ids, next_)

    return stream.writeStream.foreachBatch(run).options(**options).start()
