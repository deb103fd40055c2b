import random
import re

import pytest

from quarrystone.llm import jaccard
from quarrystone.llm.components import components
from quarrystone.llm.jaccard import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def roots(nodes, edges):
    of = {n: n for n in nodes}

    def find(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    edges = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)]
    of = roots({d for d, _ in docs if d is not None}, edges)
    return sorted(((d, len(s), of.get(d)) for d, s in sets), key=str)


def run(spark, docs, **how):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, rep string")
    return sorted(map(tuple, near_duplicates(frame, **how).collect()), key=str)


def corpus(seed, groups=12, copies=9):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out, ids = [], list(range(1000))
    rng.shuffle(ids)
    common = rng.choices(words, k=12)
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 7, 30, 60, 120]))
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = common + text
            base = text if rng.random() < 0.4 else base  # chains
            out.append((ids.pop(), rng.choice([" ", "\n", " \t"]).join(text)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_brute_force(spark, seed):
    docs = corpus(seed)
    # Bounded and hot buckets take unlike ways to equal results.
    assert run(spark, docs, hot=(jaccard.HOT, 0, 3, 9)[seed]) == brute(docs)


def test_documents_made_of_shared_passages(spark):
    # Most of each text is passages that others share, so that unlike groups meet in many buckets; some ids have several texts.
    rng = random.Random(11)
    passages = [" ".join(f"p{i}_{j}" for j in range(12)) for i in range(6)]
    docs = [(rng.randrange(90), " ".join(rng.sample(passages, rng.randint(1, 5)))) for _ in range(120)]
    assert run(spark, docs, hot=6) == brute(docs)
    now = spark.createDataFrame([(h, d, 0, 40, at, d) for d in (1, 2) for at, h in enumerate((5, 6, 7, 8))], "h long, id long, part int, n long, at int, root long")
    odd = spark.createDataFrame([(d, 0, [0] * jaccard.PARITIES) for d in (1, 2)], "id long, part int, parities array<long>")
    assert [tuple(r) for r in jaccard.first_meetings(now, odd, 75).collect()] == [(1, 2)]


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    docs = [(9, None), (8, ""), (7, " \n\t"), (6, "a b c"), (5, "A  b\nC"), (4, "a b c d"), (3, long), (2, long + " more"), (None, "a b c"), (1, "é É"), (0, "É É")]
    docs += [(20, "a b c"), (20, "one two three four five six"), (15, "one two three four five six"), (30, "z z z z z z z z"), (31, "z z z z z")]
    assert run(spark, docs) == brute(docs)
    assert run(spark, []) == []


def test_shingles_are_those_of_plain_words():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = [None, "", " ", "a", "a b c d", "A  b c d\u3000e f"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    sets = list(jaccard.shingle_sets(pa.array(texts), 5))
    words = [(t or "").lower().split(" ") for t in texts]
    words = [[w for w in ws if w] for ws in words]
    assert [len(s) for s in sets] == [len({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}) if ws else 0 for ws in words]
    assert all((np.diff(s.view(np.int64).astype(object) % (1 << 64)) > 0).all() for s in sets)
    found = np.concatenate(list(jaccard.shingles(pa.array(texts), 5)))
    assert len(found) == sum(max(1, len(ws) - 4) for ws in words if ws) and set(found.tolist()) == {h for s in sets for h in s.tolist()}
    # What a task counts is not looked at text by text.
    calls = []
    grams, jaccard.grams = jaccard.grams, lambda h, k: calls.append(k) or grams(h, k)
    try:
        list(jaccard.shingles(pa.array(["a b c d e f g"] * 500), 5))
    finally:
        jaccard.grams = grams
    assert calls == [5]


def test_suffix_filter_drops_nothing():
    import numpy as np

    rng = np.random.default_rng(1)
    kept = 0
    for _ in range(600):
        x = np.unique(rng.integers(0, 2**64, rng.integers(1, 90), dtype=np.uint64))
        y = np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 2**64, rng.integers(1, 60), dtype=np.uint64)]))
        both = len(set(x.tolist()) & set(y.tolist()))
        want = 100 * both >= 75 * (len(x) + len(y) - both)
        assert jaccard.similar(x, y, 75) == want
        differ = int(np.bitwise_count((jaccard.parities(x) ^ jaccard.parities(y)).view(np.uint64)).sum())
        assert differ <= len(x) + len(y) - 2 * both and (not want or 175 * differ <= 25 * (len(x) + len(y)))
        may = jaccard.may_reach(jaccard.bitmap(x), len(x), jaccard.bitmap(y), len(y), 75)
        assert may or not want
        kept += may
    assert kept < 300


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(5, 5), (70, 71), (71, 70)]
    found = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges for n in e}
    assert {n: found.get(n, n) for n in nodes} == roots(nodes, edges)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hot_buckets_are_split(spark):
    """Two thirds of the rows on one key: the final plan of the joins with aggregates says that they were split."""
    from quarrystone.llm.jaccard import buckets, drawn

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        index = spark.range(60_000).repartition(16).selectExpr("IF(id % 3 < 2, 7, id) AS h", "id", "1 AS part", "10L AS n", "0 AS at", "true AS hot", "id AS root")
        for df in (buckets(index), drawn(index.drop("hot"), 1)):
            assert df.where("id >= 0").count()
            held = df.select("h", "id")
            held.write.format("noop").mode("overwrite").save()
            held.collect()
            assert "skew=true" in held._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
