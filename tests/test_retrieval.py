import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarrystone.functions import context as X
from quarrystone.functions import policy as P
from quarrystone.operators import analytics as A
from quarrystone.operators import vector as V


def test_labels(spark):
    kinds = "kind string, grade int, chapter string, section string, level string, number int, first int, last int, pictures boolean"
    rows = spark.createDataFrame(
        [
            ("exercise", 1, "函数", "单调性", "basic", 3, 2, 2, True),
            (None, 7, " ", "", "odd", 0, 2, 4, False),
            ("", None, None, None, None, None, None, None, None),
            ("other", 0, "c", None, "", 12, 0, 4, None),
        ],
        kinds,
    )
    names = [c.split()[0] for c in kinds.split(", ")]
    assert [r.x for r in rows.select(X.labels(*map(F.col, names)).alias("x")).collect()] == [
        ["习题例题", "高一", "函数", "单调性", "难度:基础", "第3题", "p2", "含图片"],
        ["知识讲义", "7年级", "难度:odd", "p2-4"],
        ["知识讲义"],
        ["资料", "c", "第12题"],
    ]
    pieces = spark.createDataFrame([(2, ["b"], "two"), (10, ["z"], "ten"), (1, [], None)], "n int, about array<string>, content string")
    assert pieces.select(F.col("n"), X.piece(F.col("n"), F.col("about"), F.col("content")).alias("t")).agg(X.context(F.col("n"), F.col("t")).alias("c")).first().c == "[资料片段 1] \n\n[资料片段 2 | b] two\n\n[资料片段 10 | z] ten"


def plain_quantile(values, bounds, q):
    """The bucket that the quantile falls in, evenly filled."""
    wanted, under, low = q * len(values), 0, None
    for top in [*bounds, math.inf]:
        n = sum(v <= top for v in values)
        if n >= wanted:
            if top == math.inf:
                return low
            if low is None and top <= 0:
                return top
            return (low or 0.0) + (top - (low or 0.0)) * (wanted - under) / (n - under)
        under, low = n, top


def test_bucket_quantiles(spark):
    rng = random.Random(5)
    bounds = [-1.0, 0.0, 1.0, 2.0, 5.0]
    groups = {"mixed": [rng.uniform(-3, 9) for _ in range(200)], "one": [0.5], "over": [9.0, 8.0], "under": [-7.0], "edge": [1.0, 1.0, 5.0], "hot": [1.5] * 3000}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("mixed", None), ("mixed", math.nan), ("none", None)]
    table = A.bucketed(spark.createDataFrame(rows, "k string, value double"), bounds, ["k"])
    counts = {(r.k, r.le): r.n for r in table.collect()}
    assert counts == {(k, b): sum(v <= b for v in vs) for k, vs in groups.items() for b in [*bounds, math.inf]}
    asked = {"low": 0.1, "half": 0.5, "high": 0.95}
    out = A.bucket_quantiles(table.unionByName(table), ["k"], asked).collect()
    assert {r.k: [r.low, r.half, r.high] for r in out} == {k: [round(plain_quantile(vs, bounds, q), 6) for q in asked.values()] for k, vs in groups.items()}
    empty = spark.createDataFrame([("a", 1.0, 0), ("a", math.inf, 0)], "k string, le double, n long")
    assert A.bucket_quantiles(empty, ["k"], {"half": 0.5}).first().half is None


def test_nearest_of_own_kind(spark):
    """Equal to brute force over many small cells, with a hot kind, ties and rows without a kind."""
    rng = np.random.default_rng(3)
    held = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), None if i % 41 == 0 else 0 if i % 3 else i % 5, "ab"[i % 2]) for i in range(400)]
    vectors = spark.createDataFrame(held, "vec_id long, v array<double>, kind int, side string")
    queries = vectors.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "kind")
    out = V.nearest(queries, vectors, 3, by=["side"], own=["kind"], shard_rows=50, block_rows=7).collect()
    wanted = set()
    for i, q, kind, _ in held[::10]:
        for side in "ab":
            rows = sorted((-round(float(np.dot(q, v)), 6), j) for j, v, k, s in held if kind is not None and k == kind and s == side)
            wanted |= {(i, j, side, kind, -s, n) for n, (s, j) in enumerate(rows[:3], 1)}
    assert {(r.query_id, r.vec_id, r.side, r.kind, r.score, r["rank"]) for r in out} == wanted and len(out) == len(wanted)
    assert V.nearest(queries.limit(0), vectors, 3).count() == 0 == V.nearest(queries, vectors.limit(0), 3).count()


def test_hashed_pairs(spark):
    """Characters beyond the first plane, one sign, none, null and a repeated id."""
    import hashlib
    from collections import Counter

    texts = {1: "a𝄞b\na𝄞", 2: "𝄞", 3: "", 4: None, 5: "aa" * 500}
    out = V.hashed_counts(spark.createDataFrame([*texts.items(), (5, "ab")], "doc_id long, text string"), 16).collect()
    wanted = Counter()
    for doc, text in [*texts.items(), (5, "ab")]:
        text = (text or "").replace("\n", " ")
        for p in [text[i : i + 2] for i in range(len(text) - 1)] or list(text):
            wanted[doc, int.from_bytes(hashlib.sha256(p.encode()).digest()[:4], "big") % 16] += 1
    assert {(r.doc_id, r.bucket): r.n for r in out} == wanted


def test_every_blocked_kind(spark):
    asked = [p.split("|")[-1] + "函数" for p in P.BLOCKED.values()] + ["今天 Prompt 函数", "函数"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select(P.decision(F.col("q"), F.lit(None).cast("string")).alias("d")).collect()
    assert [r.d.reason for r in rows] == ["blocked_non_subject"] * 6 + ["keyword_match"]


def test_nearest_whatever_the_partitions(spark):
    """Each cell's two sides meet however many partitions they are dealt over; ids of queries' own values may be of another width."""
    rng = np.random.default_rng(5)
    data = rng.normal(size=(120, 4)).round(3)
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(data)], "vec_id long, v array<double>, label long")
    asked = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").cast("int").alias("label"))
    want = lambda q, ids: sorted(ids, key=lambda i: (-round(float(data[q] @ data[i]), 6), i))[:3]
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for own in ([], ["label"]):
            found = {}
            for r in V.nearest(asked, rows, 3, own=own, shard_rows=50, block_rows=5).orderBy("query_id", "rank").collect():
                found.setdefault(r.query_id, []).append(r.vec_id)
            assert found == {q: want(q, [i for i in range(120) if not own or i % 3 == q % 3]) for q in range(0, 120, 10)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
