"""Names counted in tasks, and the frequent ones told to all tasks in a bounded number of bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many bits tell tasks which names are frequent; more names make them tell less, and change no result.
MOST_BITS = 1 << 27
#: Names that a task gathers before it counts them.
GATHER = 1 << 22


class Frequent:
    """A set of names in a bounded number of bits: it holds all of them, and may hold others."""

    def __init__(self, names: DataFrame, n: int, most_bits: int):
        self.bits = 1 << min(most_bits.bit_length() - 1, max(16, (64 * n).bit_length()))
        marks = (
            names.select(F.col("name").bitwiseAND(F.lit(self.bits - 1)).alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
            .toArrow()
        )
        words = np.zeros(self.bits // 64, dtype=np.uint64)
        words[marks.column("word").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
        self.words = words

    def of(self, names: np.ndarray) -> np.ndarray:
        bit = names & np.uint64(self.bits - 1)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


class Tally:
    """Names, counted as they come: rows (name, n) of distinct names, now and then, for Spark to add up."""

    def __init__(self, gather: int = GATHER):
        self.gather, self.held, self.size = gather, [], 0

    def add(self, names: np.ndarray, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        self.held.append((names, np.ones(len(names), dtype=np.int64) if n is None else n))
        self.size += len(names)
        if self.size >= self.gather:
            yield from self.flushed()

    def flushed(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            found, at = np.unique(np.concatenate([x for x, _ in self.held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n for _, n in self.held]), minlength=len(found)).astype(np.int64)
            columns = [pa.array(found.view(np.int64)), pa.array(n)]
            for k in range(0, len(found), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 16) for c in columns], names=["name", "n"])
        self.held, self.size = [], 0
