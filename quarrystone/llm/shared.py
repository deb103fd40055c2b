"""Where operators of this subpackage keep intermediate tables, and how."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share, ``spark.checkpoint.dir``.

    Where the session names none, a local master gets a local folder, for the
    session's life; on a cluster that would not be shared, so it is an error.
    """
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = spark.conf.get("quarrystone.shared.dir", None)
    if not conf:
        spark.conf.set("quarrystone.shared.dir", conf := "file://" + tempfile.mkdtemp(prefix="quarrystone-"))
    return f"{conf.rstrip('/')}/quarrystone-{context.applicationId}"


def remove_saved(spark: SparkSession) -> None:
    """Delete what this application wrote in the shared folder; results that were not yet taken are lost with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of the Arrow batches that Python gets, where rows hold whole texts: each is held several times over, by the JVM and by a worker.
BATCH = 4 << 20
#: The folders of saved tables that are still in use.
PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most ``most`` bytes for what is run meanwhile."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts lineage: a lost executor costs no recomputation of what came before.
    ``batch``: bytes of the Arrow batches that Python gets, where rows are long; else as the session has it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with arrow_batches(spark, batch) if batch else contextlib.nullcontext():
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    PLACES[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing reads any more: what was made from them stands in saved tables of its own."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(PLACES.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
