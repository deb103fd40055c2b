"""Quality classifier: hashed n-gram logistic regression learnt with follow-the-regularised-leader updates.

A bounded sample of labelled documents is dealt by hash to a few tasks; each
makes FTRL-proximal passes over its rows, in an order fixed by their ids, and
the weights are averaged. Scoring is a sparse dot product per document, in one
pass over the documents that shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.classify import bounded_sample, features, held_out
from quarrystone.llm.shared import saved
from quarrystone.sources.tables import table


class Ftrl:
    """FTRL-proximal logistic regression over 2^bits hashed features and a bias."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0):
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(0, np.abs(z) - self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def with_bias(found: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at, value in found:
        yield np.append(at, 2**bits), np.append(value, 1.0)


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, most: int = 12_000, shards: int = 4, passes: int = 10) -> np.ndarray:
    """Weights of the features, the bias last.

    ``docs``: doc_id, text. ``labels``: doc_id, label (0 or 1). At most
    ``most`` labelled documents are learnt from. Without any the weights are
    zero, and every score is a half.
    """
    sample = bounded_sample(labels, most)
    rows = docs.join(F.broadcast(sample), "doc_id").select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.xxhash64("doc_id", "text").alias("place"), "text", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[int, int, np.ndarray, np.ndarray, int]] = []
        for batch in batches:
            shard, place, label = (batch.column(i).to_pylist() for i in (0, 1, 3))
            seen += [(shard[i], place[i], at.astype(np.int32), value.astype(np.float32), label[i]) for i, (at, value) in enumerate(with_bias(features(batch.column(2), bits), bits))]
        for shard in sorted({s[0] for s in seen}):
            own = sorted((s for s in seen if s[0] == shard), key=lambda s: s[1])
            model = Ftrl(bits)
            for _ in range(passes):
                for _, _, at, value, label in own:
                    model.learn(at, value, label)
            w = model.weights()
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(w[used])], names=["at", "w"])

    fitted = saved(rows.repartition(shards, "shard").mapInArrow(fit, "at long, w double"), "weights")
    # At most 2^bits + 1 rows, whatever the corpus.
    mean = fitted.groupBy("at").agg((F.sum("w") / shards).alias("w")).toArrow()
    w = np.zeros(2**bits + 1)
    w[mean.column("at").to_numpy()] = mean.column("w").to_numpy()
    return w


def quality_scores(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and their score, 0 to 1 (higher: label 1 likelier).

    Null and empty texts get the score of no words. An own column ``score``
    gives way. An empty table gives no rows.
    """
    bits = (len(weights) - 1).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    docs = docs.drop("score")
    at_text = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            margin = np.array([w[at] @ value for at, value in with_bias(features(batch.column(at_text), bits), bits)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-margin)))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(score, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + ", score double")


def quality_model(spark: SparkSession, sf_dir: str) -> np.ndarray:
    """Learnt from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL").where(~held_out(F.col("doc_id"), 3, 1)).select("doc_id", F.col("quality").alias("label"))
    return train(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)


def op5_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    scored = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
