"""A corpus pipeline: quality, line dedup, near duplicates, decontamination, packing.

Each stage takes what its predecessor kept and returns a DataFrame, written as
Parquet and read again as the next one's documents. All stages but the last
return the columns of ``documents``, other columns included.

Null and empty texts: they get the classifier's score of no words, are one
empty line (null becomes empty), link with nothing, hold no benchmark words,
and pack as the end id alone. Long texts are read whole. Rows that repeat an id
are one document to the near-duplicate stage, which keeps or drops all of them,
and documents of their own to the others; of equal ones under different ids the
least id stays. Rows with a null id keep their lines and are no near duplicates.
An empty table gives no rows.

Stages set the session's Arrow batches to at most 4 MB, also for what is run
after them: their rows hold whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.decontaminate import decontaminate
from quarrystone.llm.jaccard import near_duplicates
from quarrystone.llm.line_dedup import line_dedup
from quarrystone.llm.packing import pack
from quarrystone.llm.quality import quality_model, quality_scores
from quarrystone.llm.shared import BATCH, saved
from quarrystone.sources.tables import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(spark: SparkSession) -> None:
    """Python gets Arrow batches of at most ``BATCH`` bytes. This stays, as what a stage returns is run later."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half go."""
    small_batches(spark)
    return quality_scores(docs, quality_model(spark, sf_dir)).where("score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; n_chars follows. All documents stay, if need be empty."""
    done = line_dedup(docs).withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return done.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    gone = near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    small_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packing),
]

#: Learnt scores and tokens are not for SQL: the stages are tested against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
