import hashlib
import os
import random
from collections import Counter

import pytest

from quarrystone.llm.repeats import remove_repeats
from quarrystone.llm.shared import shared_dir


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        over = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                over[i : i + length] = b"\1" * length
        kept = bytes(b for b, o in zip(r, over, strict=True) if not o)
        runs = sum(o and not (i and over[i - 1]) for i, o in enumerate(over))
        out.append((kept, len(r), sum(over), runs))
    return out


def made(seed, n, length):
    """Texts with shared passages, changed copies, whole copies, runs of one letter, and short ones."""
    dice = random.Random(seed)

    def prose(m, letters="abcdefgh é"):
        return "".join(dice.choice(letters) for _ in range(m))

    passages = [prose(dice.randint(length - 3, 4 * length)) for _ in range(4)]
    texts = [None, "", "x" * (3 * length), "x" * (length + 1), "ab" * length, prose(length), "日本" * length]
    for _ in range(n):
        text = prose(dice.randint(0, 3 * length))
        for _ in range(dice.randint(0, 2)):
            text += dice.choice(passages)[dice.randint(0, 3) :] + prose(dice.randint(0, length))
        texts.append(text)
        if dice.random() < 0.3:
            at = dice.randint(0, len(text))
            texts += [text, text[:at] + "#" + text[at + 1 :]]
    dice.shuffle(texts)
    return texts


def found(df):
    return {r.doc_id: (bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in df.collect()}


@pytest.mark.parametrize(("length", "gram", "window", "rounds", "bits"), [(24, 3, 8, 4, 1 << 27), (24, 4, 4, 1, 1 << 27), (40, 2, 6, 9, 64)])
def test_equal_to_brute_force(spark, length, gram, window, rounds, bits):
    texts = made(length + rounds, 40, length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = found(remove_repeats(df, length, gram, window, rounds, most_bits=bits))
    assert out == dict(enumerate(brute(texts, length)))


def test_low_entropy(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice("ab") for _ in range(dice.randint(0, 90))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert found(remove_repeats(df, 12, 2, 5, 3)) == dict(enumerate(brute(texts, 12)))


def test_odd_tables(spark):
    schema = "doc_id long, text string, k1 string, kept int"
    assert remove_repeats(spark.createDataFrame([], schema)).count() == 0
    text = "one two three " * 40
    rows = [(1, text, "a", 1), (1, text, "b", 2), (None, text[:405] + "!", None, None), (2, None, None, None)]
    out = sorted((r.n_bytes, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, schema)).collect())
    expected = sorted((n, gone) for _, n, gone, _ in brute([r[1] for r in rows], 400))
    assert out == expected
    with pytest.raises(ValueError, match="symbol"):
        remove_repeats(spark.createDataFrame(rows, schema), length=100)


def test_query(spark, sf_dir):
    import duckdb

    from quarrystone.llm.repeats import ORACLE, op13_repeats

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = {r.doc_id: (r.kept_sha256, r.n_bytes, r.n_removed, r.n_spans) for r in op13_repeats(spark, sf_dir).collect()}
    expected = {r.doc_id: (hashlib.sha256(k).hexdigest(), *rest) for r, (k, *rest) in zip(rows, brute([r.text for r in rows], 400), strict=True)}
    assert out == expected
    assert any(gone for _, _, gone, _ in out.values())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    names = ("kept_sha256", "n_bytes", "n_removed", "n_spans")
    assert {r["doc_id"]: tuple(r[c] for c in names) for r in con.sql(ORACLE).to_arrow_table().to_pylist()} == out


def test_only_the_starts_stay_saved(spark):
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = spark.createDataFrame([(i, f"{i} " + "some words that stand in each text " * 20) for i in range(4)], "doc_id long, text string")
    done = remove_repeats(docs)
    left = set(os.listdir(folder)) - before
    assert {p.rsplit("-", 1)[0] for p in left} == {"repeated-starts"}
    assert all(r.n_removed > 600 for r in done.collect())
