import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarrystone.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's 12² don't", "<|endoftext|> a", "naïve İstanbul", "ß ſ ŉ \x00 a\x85b\xa0c", "'s'T'LL I'VE!'s", "a_b-c…d", "ÀÉÎ «x» ½ª", '"token" = a/b\\c', "", "  \n", "中文 text", "é", "''s ''", "😀 x"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def exact(tokenizer, text):
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_ids_equal_the_tokenizer(tokenizer, spark, sf_dir):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = K.Ids(PATH)
    ids.MOST = 500  # so that the table starts anew now and then
    for k in range(0, len(texts), 7):
        assert list(ids.of(texts[k : k + 7])) == [exact(tokenizer, t) for t in texts[k : k + 7]]


def test_table_equals_the_tokenizer(tokenizer, spark, sf_dir, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K.Ids, "MOST", 3000)
    texts = ODD + ["ÀÉ é×÷ ÿ", "it's", "x'y ' z", "1234 a1b2", "A\tB\nC", "ñandú-Ñandú", "", "é", "Ã", "a" * 5000, "don't <b|c"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    table = K.Table(PATH)
    for _ in range(2):
        assert list(table.of(K.text_array(pa.array(texts)))) == [exact(tokenizer, t) for t in texts]
    assert list(table.of(K.text_array(pa.array([], pa.string())))) == []


def test_a_table_of_many_words_is_small():
    import tracemalloc

    import pyarrow as pa

    dice, n = random.Random(3), 60_000
    words = ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)]
    texts = K.text_array(pa.array([" ".join(words[k : k + 2000]) for k in range(0, n, 2000)]))
    table = K.Table(PATH)
    K.powers(1 << 20)  # kept for all tables
    tracemalloc.start()
    assert sum(map(len, table.of(texts))) > 4 * n
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 80 * n


def test_a_table_of_long_words_starts_anew(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(K.Table, "MOST_IDS", 1000, raising=False)
    dice = random.Random(4)
    texts = ["".join(dice.choices("bcdfghjklmnpqrstvwxz", k=4000)) for _ in range(6)]
    table = K.Table(PATH)
    for t in texts:
        assert list(table.of(K.text_array(pa.array([t])))) == [exact(tokenizer, t)]
        assert len(table.flat) < 5000


def test_texts_come_in_small_batches(spark, monkeypatch):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            rest = [pa.array([x] * b.num_rows, t) for x, t in ((0, pa.int32()), (0, pa.int64()), (1, pa.int64()), (b.nbytes, pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *rest], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(K, "BATCH", 100_000)
    monkeypatch.setattr(K, "pieces", lambda rows, *_: rows.mapInArrow(sizes, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    docs = spark.createDataFrame([(i, "word " * 2000) for i in range(100)], "doc_id long, text string").coalesce(1)
    seen = [r.ids_crc32 for r in K.pack(docs, PATH).collect()]
    assert len(seen) == 100 and max(seen) < 200_000
    assert spark.conf.get(key) == before


def places(histogram, slots, cap):
    ranks, sequences = defaultdict(list), defaultdict(list)
    for length, first, n, per, s, offset in slots.tolist():
        ranks[length].append((first, n))
        for i in range(n):
            sequences[s + i // per].append((offset + i % per * length, length))
    for length, n in histogram.items():
        end = 0
        for first, count in sorted(ranks[length]):
            assert first == end
            end += count
        assert end == n
    assert set(ranks) <= set(histogram)
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= cap
    return len(sequences)


def best_fit_decreasing(histogram, cap):
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = min((r for r in rooms if r >= length), default=None)
            if fit is not None:
                rooms.remove(fit)
            rooms.append((cap if fit is None else fit) - length)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plans_are_whole_and_tight(seed):
    rng = random.Random(seed)
    cap = rng.choice([20, 100, 2048])
    histogram = {rng.randint(1, cap): rng.randint(1, 25) for _ in range(rng.randint(0, 40))}
    slots = K.plan(histogram, cap, groups=rng.choice([3, 48]))
    n = places(histogram, slots, cap)
    assert -(-sum(k * v for k, v in histogram.items()) // cap) <= n <= best_fit_decreasing(histogram, cap)


def test_plan_does_not_grow_with_the_counts():
    small = {n: 3 + n % 5 for n in range(1, 2048, 3)}
    large = {n: c * 10**7 for n, c in small.items()}
    assert len(K.plan(large, 2048)) < 3 * len(K.plan(small, 2048)) + 1000


@pytest.mark.parametrize("cap", [16, 2048])
def test_rows(spark, tokenizer, cap):
    rows = [(1, "one two three " * 40), (1, "one two three " * 40), (2, None), (3, ""), (None, "null id"), (5, "word " * 9000), *[(i, "same text here") for i in range(10, 60)]]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, length int, salt string")
    out = K.pack(docs, PATH, cap=cap, with_ids=True).collect()
    whole, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        assert r.length == len(r.ids) <= cap and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        whole[r.doc_id].append((r.start, r.piece, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for d, t in rows:
        ids = np.frombuffer(exact(tokenizer, t or ""), dtype="<u4").tolist() + [0]
        want[d] += [(k, k // cap, ids[k : k + cap]) for k in range(0, len(ids), cap)]
    assert {d: sorted(v) for d, v in whole.items()} == {d: sorted(v) for d, v in want.items()}
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= cap
    assert K.pack(docs.limit(0), PATH).count() == 0
