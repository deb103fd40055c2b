import random
import re
from collections import Counter

from quarrystone.llm.collocations import collocations

UPPER = {i: i + 32 for i in range(65, 91)}


def brute(rows, most_words=3, min_count=10, covered=50, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, most_words + 1):
                for i in range(len(words) - k + 1):
                    g = tuple(words[i : i + k])
                    f[lang, g] = f.get((lang, g), 0) + 1
    good = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= min_count}
    out = []
    for (lang, g), a in good.items():
        inside = any(
            x == lang and len(h) > len(g) and 100 * b >= covered * a and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))
            for (x, h), b in good.items()
        )
        if not inside:
            score, _, left, right = min((10**6 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
            out.append((lang, -score, -a, " ".join(g).encode(), left, right))
    out.sort()
    ranks, found = Counter(), set()
    for lang, score, a, phrase, left, right in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            found.add((lang, ranks[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return found


def made(seed, n):
    dice = random.Random(seed)
    words = ["a", "B", "é", "É", "new", "york", "city", "hall", "of", "x-y", "日本", "ﬀ"]
    rows = []
    for _ in range(n):
        text = "".join(dice.choice(words) + dice.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\xa0"]) for _ in range(dice.randint(0, 60)))
        rows.append((dice.choice(["en", "en", "de", None, "und"]), dice.choice([text, text, text, None, "New York City Hall! new york city"])))
    return rows


SCHEMA = "lang string, text string"


def found(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_equal_to_brute_force(spark):
    rows = made(1, 250) + [("en", "word " * 30000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(collocations(df)) == brute(rows)
    assert found(collocations(df, most_words=4, min_count=5, covered=80, top=7)) == brute(rows, 4, 5, 80, 7)


def test_few_bits_change_nothing(spark):
    rows = made(2, 120)
    assert found(collocations(spark.createDataFrame(rows, SCHEMA), min_count=3, most_bits=64)) == brute(rows, min_count=3)


def test_odd_tables(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([("en", None), (None, ""), ("en", "one")], SCHEMA)).count() == 0
    rows = [("en", "a b. " * 12)]
    assert found(collocations(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", name long, n int"))) == brute(rows)


def test_large_counts_stay_exact(spark):
    from quarrystone.llm.collocations import scored

    a, left, right = 99_999_999_999_999, 99_999_999_999_999, 100_000_000_000_007
    rows = spark.createDataFrame([(a, [left, a], [right, a])], "a long, heads array<long>, tails array<long>")
    assert scored(rows, 2).first().score == 10**6 * a * a // (left * right)


def test_query_and_oracle(spark, sf_dir):
    import duckdb

    from quarrystone.llm.collocations import ORACLE, op12_collocations

    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()]
    out = found(op12_collocations(spark, sf_dir))
    assert out
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert {tuple(r[c] for c in names) for r in con.sql(ORACLE).to_arrow_table().to_pylist()} == out
    assert len(docs)


def test_names_travel_in_blocks_of_short_gaps():
    import numpy as np

    from quarrystone.llm.collocations import packed, unpacked

    names = np.unique(np.random.default_rng(5).integers(0, 2**64, 1 << 20, dtype=np.uint64))
    blocks = [(k, own.stop - own.start, raw) for k, own, raw in packed(names, 10)]
    assert sum(len(raw) for _, _, raw in blocks) <= 6 * len(names)
    assert (np.concatenate([unpacked(*b, 10) for b in blocks]) == names).all()
    for few in ([], [0], [2**64 - 1], [0, 1, 2**63, 2**64 - 1]):
        own = np.array(few, dtype=np.uint64)
        assert [x for k, at, raw in packed(own, 10) for x in unpacked(k, at.stop - at.start, raw, 10).tolist()] == few


def test_counts_of_pairs_add_up(spark):
    from pyspark.sql import functions as F

    from quarrystone.llm import collocations as C

    docs = spark.range(4000, numPartitions=2).select(F.lit("en").alias("lang"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(300)).cast("string")) for i in range(20)]).alias("text"))
    words = C.counts(docs, [], "words", 2)
    known = [C.Frequent(words.select("name"), words.count(), C.MOST_BITS)]
    pairs = C.counts(docs, known, "pairs", 1)
    assert pairs.agg(F.sum("n")).first()[0] == 4000 * 19 and pairs.count() > 30_000
