"""Hashed word n-gram features and the labelled samples that classifiers learn from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.words import NONSPACE, SAME, Words, grams, pieces

#: Kinds of bytes whose mixture is a word's shape.
SHAPES = np.zeros(256, dtype=np.uint8)
SHAPES[65:91] = 1
SHAPES[97:123] = 2
SHAPES[48:58] = 4
SHAPES[list(b".,;:'\"()-?")] = 8
SHAPES[list(b"!")] = 16
SHAPES[list(b"|")] = 32
SHAPES[list(b"#$%&*+/<=>@[\\]^_`{}~")] = 64
SHAPES[128:] = 128

#: Seeds that keep feature families apart.
WORD1, WORD2, SHAPE1, SHAPE2, SHAPE3, AGAIN = (np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64) for i in range(6))


def held_out(id_col: Column, parts: int, part: int) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, by ``parts``, is ``part``."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts == part


def bounded_sample(labels: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled rows, the first by the hash of their id: one per id."""
    one = labels.groupBy(id_col).agg(F.max("label").alias("label"))
    return one.orderBy(F.xxhash64(id_col), id_col).limit(most)


def features(column: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text, sorted feature numbers under 2^bits and their values.

    Families: words and pairs of words as they stand; shapes of words (the
    kinds of their bytes) singly, in pairs and in threes; a word that repeats
    the one before. In a family values are square roots of relative counts.
    """
    last = np.uint64(2**bits - 1)
    for _, _, raw, at in pieces(column):
        w = Words(raw, at, NONSPACE, SAME)
        if not len(w):
            yield from ((np.zeros(0, dtype=np.int64), np.zeros(0)) for _ in range(len(at) - 1))
            continue
        h = w.hashes()
        # Up to the next word's start: white space between has no kind.
        shape = np.bitwise_or.reduceat(SHAPES[raw], w.starts).astype(np.uint64)
        same = np.zeros(len(h), dtype=np.uint64)
        same[1:] = h[1:] == h[:-1]
        families = [(h ^ WORD1, 1), (grams(h, 2) ^ WORD2, 2), (grams(shape + SHAPE1, 1), 1), (grams(shape + SHAPE2, 2), 2), (grams(shape + SHAPE3, 3), 3), (grams(same + AGAIN, 1), 1)]
        numbers = [((f & last).astype(np.int64), k) for f, k in families]
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            found = [f[a : max(a, b - k + 1)] for f, k in numbers]
            weight = np.concatenate([np.full(len(f), 1 / max(1, len(f))) for f in found])
            order, where = np.unique(np.concatenate(found), return_inverse=True)
            yield order, np.sqrt(np.bincount(where, weight, minlength=len(order)))
