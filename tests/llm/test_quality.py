import zlib

import numpy as np
import pyarrow as pa

from quarrystone.llm.classify import features
from quarrystone.llm.quality import Ftrl, op5_ftrl_quality, quality_scores, train


def test_features_are_of_each_text_alone():
    texts = ["one two two", None, "", "THREE!! four|", "one two two", "word " * 5000]
    together = list(features(pa.array(texts), 12))
    for text, (at, value) in zip(texts, together, strict=True):
        ((alone, own),) = features(pa.array([text]), 12)
        assert (at == alone).all() and np.allclose(value, own) and (np.diff(at) > 0).all()
    assert len(together[1][0]) == len(together[2][0]) == 0


def test_ftrl_learns_a_line():
    rng = np.random.default_rng(0)
    model = Ftrl(4)
    for _ in range(3000):
        at = np.unique(rng.integers(0, 16, 4))
        model.learn(at, np.ones(len(at)), int((at < 8).sum() * 2 > len(at)))
    w = model.weights()
    assert w[:8].min() > 0 > w[8:16].max()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op5_ftrl_quality(spark, sf_dir).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == 1000
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [d for d in labels if rows[d].held_out]
    assert sum(rows[d].predicted == labels[d] for d in held) / len(held) > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here", 9.0), (1, "good words here", 9.0), (2, None, 1.0), (3, "", 1.0), (None, "BAD!! " * 20_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (5, 0)], "doc_id long, label int")
    w = train(docs, labels, bits=10)
    out = quality_scores(docs, w)
    assert out.columns == ["doc_id", "text", "score"]
    found = out.collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    empty = {r.score for r in found if not r.text}
    assert len(empty) == 1
    assert quality_scores(docs.limit(0), w).count() == 0
    none = train(docs, labels.limit(0), bits=10)
    assert {r.score for r in quality_scores(docs, none).collect()} == {0.5}


def test_conflicting_labels_count_as_one(spark):
    """Of an id's labels the greatest counts, however often it is there."""
    docs = spark.createDataFrame([(i, f"{'good plain' if i % 2 else 'BAD!! |'} words {i}") for i in range(40)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(40)]
    more = [(1, 0), (1, 0), (3, 0), (5, 1)]
    one, other = (train(docs, spark.createDataFrame(rows, "doc_id long, label int"), bits=10) for rows in (labels, labels + more))
    assert (one == other).all()


def test_query_against_plain_python(spark, sf_dir):
    """The whole query, written anew: features by dictionaries, one weight at a time, shards one after the other."""
    import math

    from pyspark.sql import functions as F

    bits, passes, alpha, beta, l1, l2, shards = 18, 10, 0.5, 1.0, 0.02, 1.0, 4
    bias = 2**bits
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hashed = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), F.xxhash64("doc_id", "text").alias("place")).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    rows = {r.doc_id: {**dict(zip(at.tolist(), value.tolist(), strict=True)), bias: 1.0} for r, (at, value) in zip(hashed, features(pa.array([r.text for r in hashed]), bits), strict=True)}

    def weight(z, n):
        return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)

    total = {}
    for shard in range(shards):
        own = sorted((r for r in hashed if r.shard == shard and r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 3 != 1), key=lambda r: r.place)
        z, n = {}, {}
        for _ in range(passes):
            for r in own:
                x = rows[r.doc_id]
                w = {i: weight(z.get(i, 0.0), n.get(i, 0.0)) for i in x}
                p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * v for i, v in x.items())))))
                for i, v in x.items():
                    g = (p - labels[r.doc_id]) * v
                    z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha * w[i]
                    n[i] = n.get(i, 0.0) + g * g
        for i in z:
            total[i] = total.get(i, 0.0) + weight(z[i], n[i]) / shards
    want = {d: 1 / (1 + math.exp(-sum(total.get(i, 0.0) * v for i, v in x.items()))) for d, x in rows.items()}
    got = {r.doc_id: r.score for r in op5_ftrl_quality(spark, sf_dir).collect()}
    assert set(got) == set(want) and all(abs(got[d] - want[d]) < 1e-3 for d in want)
