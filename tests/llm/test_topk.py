import random

from pyspark.sql import functions as F

from quarrystone.llm.topk import scaled, top_k


def brute(queries, vectors, k):
    out = []
    for q, v in set((q, tuple(v)) for q, v in queries if q is not None and v is not None):
        found = [(-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i is not None and w is not None and i != q and len(w) == len(v)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, queries, vectors, k, **how):
    schema = "vec_id long, v array<long>, extra string"
    a, b = (spark.createDataFrame([(i, v, "x") for i, v in rows], schema) for rows in (queries, vectors))
    return sorted(map(tuple, top_k(a, b, k, **how).collect()))


def test_equal_to_brute_force(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.randint(-9, 9) for _ in range(5)]) for i in range(700)]
    vectors += [(1000 + i, [1, 2, 3, 4, 5]) for i in range(300)]  # one very common vector
    vectors += [(2000, None), (None, [1, 1, 1, 1, 1]), (2001, [3, 4]), (2002, [5, 4]), (7, [9, 9, 9, 9, 9]), (8, vectors[8][1])]
    queries = [v for v in vectors if v[0] is None or v[0] % 20 == 0] + [(2001, [3, 4]), (0, vectors[0][1]), (0, [1, 0, 0, 0, 0])]
    for how in ({}, {"shard_rows": 60, "least_rows": 10, "sample_rows": 50}, {"shard_rows": 5000, "least_rows": 5000, "sample_rows": 3}):
        assert run(spark, queries, vectors, 6, **how) == brute(queries, vectors, 6)


def test_few_rows_and_huge_values(spark):
    few = [(1, [2**28, 2**28]), (2, [2**28, 2**28 + 1]), (3, [2**28 + 1, 2**28])]
    assert run(spark, few, few, 5) == brute(few, few, 5)
    assert run(spark, [], few, 5) == [] == run(spark, few, [], 5)
    assert run(spark, few[:1], few[:1], 5) == []


def test_scaled(spark):
    rows = [([0.5, -0.01],), ([None, 1.0],), ([float("nan")],), ([float("inf")],), (None,), ([],)]
    out = spark.createDataFrame(rows, "e array<float>").select(scaled(F.col("e")).alias("v")).collect()
    assert [r.v for r in out] == [[32, -1], None, None, None, None, []]
