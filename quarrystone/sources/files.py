"""File sources and sinks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of each file; bytes that are no UTF-8 are dropped."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "ignore").removeprefix("﻿") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, text string")


BLOCKS = "array<array<struct<type:string,text:string,level:int>>>"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """A layout parser's JSON (a list of blocks per page) as rows: path, page_index, block_no, type, text, level."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", BLOCKS).alias("pages"))
    pages = raw.select("path", F.posexplode("pages").alias("page_index", "blocks"))
    return pages.select("path", "page_index", F.posexplode("blocks").alias("block_no", "b")).select("path", "page_index", "block_no", "b.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; a byte-order mark before the first name goes."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mark: bool = True) -> None:
    """CSV with a header in every part file, nulls empty, a byte-order mark first."""
    first = ("﻿" if mark else "") + columns[0]
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(first if i == 0 else c) for i, c in enumerate(columns)]
    df.select(*cells).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` has rows of: all children of their parents at once."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def upserted(rows: DataFrame, changes: DataFrame, key: Sequence[str], deleted: DataFrame | None = None) -> DataFrame:
    """The next state of a keyed table: changed rows replace, deleted keys go."""
    kept = rows.join(changes.select(*key), list(key), "left_anti")
    after = kept.unionByName(changes)
    return after if deleted is None else after.join(deleted.select(*key), list(key), "left_anti")


def append_audit(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def slug(text: str) -> str:
    """A name for paths: letters, digits and CJK characters, the rest as single hyphens."""
    return re.sub(r"[^0-9A-Za-z一-鿿]+", "-", text).strip("-").lower() or "untitled"


def backup_manifest(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Each document with whether its file is there."""
    there = files.select("path").distinct().withColumn("found", F.lit(True))
    return documents.join(there, "path", "left").withColumn("state", F.when(F.col("found"), "copied").otherwise("missing")).drop("found")
