"""Ingest of documents: chunks replaced as a whole, chosen documents sliced anew, metadata filled down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.documents import chunked
from quarrystone.sources.collection import Collection

CHUNKS = "doc_id long, chunk_index int, content string"


def ingested(collection: Collection, docs: DataFrame, prepare: Callable[[DataFrame], DataFrame] = chunked) -> DataFrame:
    """Write the chunks of ``docs`` as one version: doc_id and chunk_count of each document that was given.

    A document without text loses its old chunks. Rows that repeat an id are one document, the one with the greatest text.
    """
    once = docs.groupBy("doc_id").agg(F.max("text").alias("text"))
    version = collection.replace(prepare(once), once)
    written = collection.spark.read.parquet(f"{collection.path}/{version}")
    return written.groupBy("doc_id").agg(F.count_if("_there").alias("chunk_count"))


def resliced(collection: Collection, chosen: DataFrame, stored: DataFrame, prepare: Callable[[DataFrame], DataFrame] = chunked) -> DataFrame:
    """Slice the chosen documents anew from their stored texts: doc_id, status and chunk_count of each.

    Only stored rows of chosen ids are sliced; an id without a stored row is a
    missing document, and its chunks stay.
    """
    ids = chosen.select("doc_id").distinct()
    done = ingested(collection, stored.join(ids, "doc_id", "left_semi"), prepare)
    status = F.when(F.col("chunk_count").isNull(), "missing_document").otherwise("reingested")
    return ids.join(done, "doc_id", "left").select("doc_id", status.alias("status"), "chunk_count")


def headings_refilled(chunks: DataFrame, chapter: Column, section: Column) -> DataFrame:
    """Chunks with the chapter and section in force: ``chapter`` and ``section`` tell a chunk's own headings, else null.

    A chapter closes the section before it; before the first heading the
    chunk's columns ``own_chapter`` and ``own_section``, those of its document, hold.
    """
    order = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = chunks.withColumns({"_c": chapter, "_s": section})
    rows = rows.withColumns({"chapter": F.coalesce(F.last("_c", True).over(order), F.col("own_chapter")), "_n": F.count("_c").over(order)})
    inner = Window.partitionBy("doc_id", "_n").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.when(F.col("_n") == 0, F.col("own_section"))
    return rows.withColumn("section", F.coalesce(F.last("_s", True).over(inner), first)).drop("_c", "_s", "_n")
