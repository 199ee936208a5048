"""Cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names.

    Where it names none, one of its own: a temporary one if all runs in this process, as in local
    tests, else one in the warehouse, which all machines see.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            alone = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
            folder = tempfile.mkdtemp(prefix="checkpoint-") if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint. Spark removes its files when nothing refers to it, where it is set to."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session, or its gateway, is gone already
        pass


_written: weakref.WeakSet[DataFrame] = weakref.WeakSet()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a table in the shared folder, for loops.

    A checkpoint keeps the size estimates of the plan it cuts; round after round of joins multiplies
    them without end. A table read back has its own size. It goes when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.add(out)
    return out


def as_table(df: DataFrame) -> DataFrame:
    """``df`` itself if it is such a table already, else its rows from one."""
    return df if df in _written else written(df)


def written_text(lines: DataFrame, order: str = "seq") -> str:
    """A folder with the column ``value`` as text files whose names follow ``order``. It goes when Python ends."""
    spark = lines.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    lines.repartitionByRange(order).sortWithinPartitions(order).select("value").write.text(path)
    atexit.register(_remove, spark, path)
    return path


def present(df: DataFrame) -> bool:
    """Whether the files of a ``written`` table still stand."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    paths = [jvm.org.apache.hadoop.fs.Path(x) for x in df.inputFiles()[:1]]
    return all(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in paths)


def dropped(df: DataFrame) -> None:
    """Removes the files of a ``written`` table that nothing reads any more."""
    for path in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, path)
