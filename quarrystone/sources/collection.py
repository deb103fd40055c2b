"""A keyed collection as versions of Parquet: upserts, deletes, replaced children, compaction.

A version is a folder that Spark writes and closes with its mark of success.
Until then nobody reads it, so that a write that fails, or whose executors are
lost, leaves all earlier rows as they were. Of a key the rows of its last
version are live: all of them together (the chunks of a document, the one
vector of an id). A version that names a key without rows deletes it.

One writer at a time, compaction included; readers need not wait.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA, BASE = "delta", "base"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name where driver and executors share one, ``spark.checkpoint.dir``; a local master without it takes a local folder."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="collection-")
    return f"{place.rstrip('/')}/{label}-{uuid.uuid4().hex}"


class Collection:
    """``key`` names the columns whose rows are replaced together; ``schema`` all columns, the key's among them.

    Columns that a later version brings are null in the rows of earlier ones. A
    null key is a key like another. Own columns are ``_version`` and ``_there``.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], schema: str):
        self.spark, self.path, self.key, self.schema = spark, path.rstrip("/"), list(key), schema
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ versions

    def versions(self) -> list[str]:
        """Names of the finished versions, in order."""
        root = self._path(self.path)
        found = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n for n in found if n.endswith((DELTA, BASE)) and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def _current(self) -> list[str]:
        """The last base and what came after it."""
        names = self.versions()
        return names[max((i for i, n in enumerate(names) if n.endswith(BASE)), default=0) :]

    def _write(self, rows: DataFrame, kind: str) -> str:
        """One version; its name has an own part, so that the rest of a failed write is never met again."""
        last = max((int(n.split("-")[0]) for n in self.versions()), default=-1)
        name = f"{last + 1:012d}-{uuid.uuid4().hex}-{kind}"
        rows.withColumn("_version", F.lit(name)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.path}/{name}")
        return name

    # -------------------------------------------------------------- writes

    def upsert(self, rows: DataFrame, order: Sequence[str] = ()) -> str:
        """One row a key: of a repeated key in ``rows`` the one that is last by ``order``, then by the greatest of its other columns' hash."""
        rank = F.struct(*order, F.xxhash64(*rows.columns))
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rows.columns), rank).alias("row")).select("row.*")
        return self._write(last.withColumn("_there", F.lit(True)), DELTA)

    def replace(self, rows: DataFrame, keys: DataFrame | None = None) -> str:
        """All rows of the keys in ``rows``; those of ``keys`` without rows lose what they had, in the same version."""
        whole = rows.withColumn("_there", F.lit(True))
        if keys is not None:
            named = keys.select(*self.key).distinct().withColumn("_there", F.lit(False))
            whole = whole.unionByName(named, allowMissingColumns=True)
        return self._write(whole, DELTA)

    def delete(self, keys: DataFrame) -> str:
        return self._write(keys.select(*self.key).distinct().withColumn("_there", F.lit(False)), DELTA)

    def compact(self) -> str:
        """The live rows as a base of their own: readers from now on begin there."""
        return self._write(self.live().withColumn("_there", F.lit(True)), BASE)

    def vacuum(self) -> int:
        """Delete versions before the last base, and what failed writes left; how many. For when no reader is at an earlier version."""
        keep, root = set(self._current()), self._path(self.path)
        gone = [s.getPath() for s in self._fs.listStatus(root) if s.getPath().getName() not in keep] if self._fs.exists(root) else []
        for folder in gone:
            self._fs.delete(folder, True)
        return len(gone)

    # --------------------------------------------------------------- reads

    def live(self) -> DataFrame:
        """The live rows. A sole base is read as it is; deltas cost one shuffle of keys and versions and one join."""
        names = self._current()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        own = self.spark.createDataFrame([], self.schema).schema
        kept = self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{n}" for n in names])
        for f in own:
            if f.name not in kept.columns:
                kept = kept.withColumn(f.name, F.lit(None).cast(f.dataType))
        if len(names) > 1:
            last = kept.groupBy(*[F.col(k).alias(f"_{k}") for k in self.key]).agg(F.max("_version").alias("_last"))
            same = F.col("_version") == F.col("_last")
            for k in self.key:
                same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
            kept = kept.join(last, same, "left_semi")
        more = [c for c in kept.columns if c not in {*own.names, "_version", "_there"}]
        return kept.where("_there").select(*own.names, *more)
