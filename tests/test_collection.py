import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import ingest as I
from quarrystone.operators.vector import nearest
from quarrystone.sources.collection import Collection

VECTORS = "vec_id long, v array<double>, tag string"


def state(c):
    return sorted((tuple(r) for r in c.live().collect()), key=str)


def test_mixed_batches_and_nearest(spark, tmp_path):
    """Every state equals a dictionary's; the nearest of the live rows those by brute force."""
    rng, own = random.Random(3), {}
    c = Collection(spark, str(tmp_path / "c"), ["vec_id"], VECTORS)
    assert state(c) == []
    for turn in range(5):
        rows = [(rng.randrange(40), [rng.random() for _ in range(4)], f"t{turn}") for _ in range(15)]
        rows = list({r[0]: r for r in rows}.values())
        c.upsert(spark.createDataFrame(rows, VECTORS))
        own |= {r[0]: r for r in rows}
        gone = [rng.randrange(40) for _ in range(5)]
        c.delete(spark.createDataFrame([(g,) for g in [*gone, gone[0], 999]], "vec_id long"))
        own = {k: r for k, r in own.items() if k not in gone}
        if turn % 2:
            c.compact()
            assert c.live().count() == len(own)
        assert state(c) == sorted(own.values(), key=str)
    asked = [[rng.random() for _ in range(4)] for _ in range(3)]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, q array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest(queries, c.live(), 5).collect())
    want = []
    for i, q in enumerate(asked):
        best = sorted(own.values(), key=lambda r: (-round(float(np.dot(q, r[1])), 6), r[0]))[:5]
        want += [(i, n, r[0]) for n, r in enumerate(best, 1)]
    assert got == want
    before = state(c)
    assert c.vacuum() > 0 and state(c) == before


def test_repeats_nulls_and_new_columns(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), ["vec_id"], VECTORS)
    c.upsert(spark.createDataFrame([(1, [1.0], "a"), (1, [2.0], "b"), (None, None, None)], VECTORS), order=["tag"])
    assert state(c) == sorted([(1, [2.0], "b"), (None, None, None)], key=str)
    c.upsert(spark.createDataFrame([(2, [3.0], "c", 7)], VECTORS + ", more int"))
    assert sorted(((r.vec_id, r.more) for r in c.live().collect()), key=str) == sorted([(1, None), (2, 7), (None, None)], key=str)
    c.delete(spark.createDataFrame([(None,)], "vec_id long"))
    assert sorted(r.vec_id for r in c.live().collect()) == [1, 2]
    c.upsert(spark.createDataFrame([], VECTORS))
    assert c.live().count() == 2


DOCS = "doc_id long, text string"


def chunks(c):
    return sorted((r.doc_id, r.chunk_index, r.content) for r in c.live().collect())


def test_ingest_and_reslice(spark, tmp_path):
    c = Collection(spark, str(tmp_path / "c"), ["doc_id"], I.CHUNKS)
    docs = [(1, "One. " * 300), (2, "two"), (3, "three")]
    got = {r.doc_id: r.chunk_count for r in I.ingested(c, spark.createDataFrame(docs, DOCS)).collect()}
    assert got[1] > 1 and got[2] == got[3] == 1
    first = chunks(c)
    stored = spark.createDataFrame([(1, "short now"), (2, None), (3, "unchosen"), (9, "other")], DOCS)
    chosen = spark.createDataFrame([(1,), (2,), (7,), (1,)], "doc_id long")
    out = sorted(tuple(r) for r in I.resliced(c, chosen, stored).collect())
    assert out == [(1, "reingested", 1), (2, "reingested", 0), (7, "missing_document", None)]
    assert chunks(c) == [(1, 0, "short now"), *[r for r in first if r[0] == 3]]


def test_failed_write_loses_nothing(spark, tmp_path):
    """A task that fails after others wrote their files: the version is never seen, and the next write goes on."""
    c = Collection(spark, str(tmp_path / "c"), ["doc_id"], I.CHUNKS)
    I.ingested(c, spark.createDataFrame([(i, f"old {i}") for i in range(20)], DOCS))
    before = chunks(c)

    def broken(docs):
        def run(batches):
            for b in batches:
                if 13 in b.column(0).to_pylist():
                    raise ValueError("planted")
                yield b

        made = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
        return made.repartition(8, "doc_id").mapInArrow(run, I.CHUNKS)

    fresh = spark.createDataFrame([(i, f"new {i}") for i in range(20)], DOCS)
    with pytest.raises(Exception, match="planted"):
        I.ingested(c, fresh, broken)
    assert chunks(c) == before and len(c.versions()) == 1
    I.resliced(c, spark.createDataFrame([(13,)], "doc_id long"), fresh)
    assert chunks(c) == [(i, 0, "new 13" if i == 13 else f"old {i}") for i in range(20)]
    assert c.vacuum() <= 1 and chunks(c)[13][2] == "new 13"


def test_headings_refilled(spark):
    rows = [(1, 0, None, None), (1, 1, "C1", None), (1, 2, None, "S1"), (1, 3, None, None), (1, 4, "C2", None), (2, 0, None, "S9")]
    df = spark.createDataFrame([(*r, "D", "E") for r in rows], "doc_id int, chunk_index int, c string, s string, own_chapter string, own_section string")
    out = [(r.chapter, r.section) for r in I.headings_refilled(df, F.col("c"), F.col("s")).orderBy("doc_id", "chunk_index").collect()]
    assert out == [("D", "E"), ("C1", None), ("C1", "S1"), ("C1", "S1"), ("C2", None), ("D", "S9")]
