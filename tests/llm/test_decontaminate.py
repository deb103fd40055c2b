import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarrystone.llm.decontaminate import decontaminate, overlaps

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, span=10):
    out = {}
    for i, (_, text) in enumerate(docs):
        w, hit, of = words(text), set(), set()
        for item, item_text in items:
            b = words(item_text)
            n = min(len(b), span)
            if item is None or not n:
                continue
            known = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)}
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in known:
                    hit |= set(range(j, j + n))
                    of.add(str(item))
        out[i] = (len(w), len(hit), sorted(of))
    return out


def run(spark, docs, items, **how):
    frame = spark.createDataFrame([(d, t, f"s{i}", 7) for i, (d, t) in enumerate(docs)], "doc_id long, text string, own string, hits int")
    found = overlaps(frame, spark.createDataFrame(items, "item_id long, text string"), **how).collect()
    return {int(r.own[1:]): (r.n_words, r.n_hit, r["items"]) for r in found}


W = [f"w{i}" for i in range(60)]
ITEMS = [(1, " ".join(W[:12])), (2, "Short item, HERE"), (3, ""), (4, None), (None, "null id item"), (5, " ".join(W[5:30])), (2, "Short item, HERE"), (6, "one")]
DOCS = [
    (1, " ".join(W[:12])),
    (2, "x " + " ".join(W[2:13]).upper() + " y"),
    (3, None),
    (4, ""),
    (5, "a short-item here b short item. HERE!"),
    (5, " ".join(W[:9])),
    (5, " ".join(W[:9])),
    (None, "One two"),
    (7, "ré " * 30 + " ".join(W[3:40]) + "é one"),
    (8, ("lorem ipsum " * 4000) + " ".join(W[1:11])),
]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equal_to_brute_force_by_broadcast_and_by_join(spark, limit):
    assert run(spark, DOCS, ITEMS, broadcast_bytes=limit) == brute(DOCS, ITEMS)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_empty_tables(spark, limit):
    assert run(spark, [], ITEMS, broadcast_bytes=limit) == {}
    assert run(spark, DOCS[:2], [], broadcast_bytes=limit) == brute(DOCS[:2], [])


def test_decontaminate_keeps_clean_rows_whole(spark):
    frame = spark.createDataFrame(DOCS, "doc_id long, text string")
    left = decontaminate(frame, spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert left.columns == ["doc_id", "text"]
    clean = [d for i, d in enumerate(DOCS) if brute(DOCS, ITEMS)[i][1] == 0]
    assert sorted(map(tuple, left.collect()), key=str) == sorted(clean, key=str)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=6), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=6))
def test_random_small_alphabets(spark, docs, items):
    d = [(i, " ".join(x)) for i, x in enumerate(docs)]
    b = [(i, " ".join(x)) for i, x in enumerate(items)]
    assert run(spark, d, b) == brute(d, b)
