import itertools
import zlib

import numpy as np
import pyarrow as pa

from quarrystone.llm.toxicity import Model, chains, emissions, fit, marginals, op6_crf_toxicity, sigmoid, toxic_spans, train
from quarrystone.llm.words import ALNUM, Words, pieces


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    lengths = np.array([4, 1, 6, 3])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    score, moves, begin = rng.normal(size=lengths.sum()), rng.normal(size=(2, 2)), 0.4
    odds, expected = marginals(score, starts, lengths, moves, begin)
    want, want_moves = np.zeros(len(score)), np.zeros((2, 2))
    for a, n in zip(starts, lengths, strict=True):
        total, on, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            weight = np.exp(begin * y[0] + sum(score[a + i] * y[i] for i in range(n)) + sum(moves[p, q] for p, q in zip(y, y[1:], strict=False)))
            total += weight
            on += weight * np.array(y)
            for p, q in zip(y, y[1:], strict=False):
                pairs[p, q] += weight
        want[a : a + n] = on / total
        want_moves += pairs / total
    assert np.allclose(sigmoid(odds), want) and np.allclose(expected, want_moves)


def test_long_chains_equal_a_plain_walk():
    rng = np.random.default_rng(6)
    lengths = np.array([1, 700, 128, 129, 5, 256, 2])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    score, moves, begin = rng.normal(0, 3, size=lengths.sum()), np.array([[3.0, -2.0], [-4.0, 2.5]]), -1.5
    odds, expected = marginals(score, starts, lengths, moves, begin)
    want, want_moves = np.zeros(len(score)), np.zeros((2, 2))
    for a, n in zip(starts.tolist(), lengths.tolist(), strict=True):
        f, g = np.zeros((n, 2)), np.zeros((n, 2))
        f[0] = 0, begin + score[a]
        for t in range(1, n):
            f[t] = np.logaddexp(f[t - 1, 0] + moves[0], f[t - 1, 1] + moves[1]) + [0, score[a + t]]
        for t in range(n - 2, -1, -1):
            ahead = g[t + 1] + [0, score[a + t + 1]]
            g[t] = np.logaddexp(moves[:, 0] + ahead[0], moves[:, 1] + ahead[1])
        want[a : a + n] = (f + g)[:, 1] - (f + g)[:, 0]
        for t in range(1, n):
            joint = f[t - 1][:, None] + moves + g[t] + [0, score[a + t]]
            want_moves += np.exp(joint - np.logaddexp.reduce(joint, axis=None))
    assert np.allclose(odds, want) and np.allclose(expected, want_moves)


def test_a_text_is_one_chain():
    starts, lengths = chains(np.array([0, 0, 300, 300, 301, 557]))
    assert starts.tolist() == [0, 300, 301] and lengths.tolist() == [300, 1, 256]


def toy(n=300):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(n):
        t = list(rng.choice(words, 40))
        if i % 4 == 0:
            for at in rng.integers(0, 40, 4):
                t[at] = rng.choice(["vile", "nasty"])
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_spans_and_odd_rows(spark):
    texts, labels = toy()
    model = fit(pa.array(texts), np.array(labels), 14)
    rows = [(1, "word1 é vile nasty word2", "x"), (2, "word1 word2", "x"), (3, None, "x"), (4, "", "x"), (None, "VILE", "x"), (5, "word3 " * 30_000 + "nasty", "x"), (5, "word3 " * 30_000 + "nasty", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = toxic_spans(docs, model)
    assert out.columns == ["doc_id", "text", "score", "spans"]
    found = {(r.doc_id, (r.text or "")[:4]): r for r in out.collect()}
    assert [(s.start, s.end) for s in found[(1, "word")].spans] == [(9, 19)]
    assert found[(2, "word")].score < 0.3 < found[(1, "word")].score
    assert found[(3, "")].spans == [] and found[(3, "")].score == found[(4, "")].score < 0.3
    assert [(s.start, s.end) for s in found[(5, "word")].spans] == [(180_000, 180_005)]
    assert toxic_spans(docs.limit(0), model).count() == 0


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels in ([], [(1, 0), (2, 0)], [(7, 1)]):
        model = train(docs, spark.createDataFrame(labels, "doc_id long, label int"), bits=10)
        assert all(r.score < 0.3 for r in toxic_spans(docs, model).collect())


def test_training_on_empty_and_short_texts(spark):
    texts, labels = toy(60)
    texts, labels = [*texts, *["", "", "", "a", "b", "", ".", "é"] * 3], [*labels, *[0, 1, 0, 0, 1, 0, 0, 0] * 3]
    plain, odd = fit(pa.array(texts[:60]), np.array(labels[:60]), 10), fit(pa.array(texts), np.array(labels), 10)
    assert odd.w.shape == plain.w.shape and np.isfinite(odd.w).all() and odd.w.any()
    assert fit(pa.array(["", "", "a"]), np.array([0, 1, 1]), 10).w.shape == (1024,)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = train(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int"), bits=10)
    scores = {r.doc_id: r.score for r in toxic_spans(docs, model).collect()}
    assert min(scores[i] for i in range(60) if labels[i]) > max(scores[i] for i in range(60) if not labels[i])


def test_all_clean_texts_are_learnt():
    texts, labels = toy(40)
    late = [f"late{i} " * 30 for i in range(20)]
    first = " ".join(f"word{i % 80}" for i in range(128 * 400))  # more chains than four for each toxic text and 200
    model = fit(pa.array([first, *texts, *late]), np.array([0, *labels, *[0] * 20]), 14)
    used = [model.w[emissions(w, 14)[0]] for t in late for w in [Words(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]), ALNUM)]]
    assert all((u < 0).all() for u in used)


def test_scores_do_not_depend_on_neighbours():
    texts, labels = toy(120)
    model = fit(pa.array(texts), np.array(labels), 12)
    some = pa.array([*texts[:20], "", "x"])
    together = [x for _, _, raw, at in pieces(some) for w in [Words(raw, at, ALNUM)] for x in model.document(model.tag(w), w.first)]
    alone = [x for t in some.to_pylist() for w in [Words(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]), ALNUM)] for x in model.document(model.tag(w), w.first)]
    assert np.allclose(together, alone)
    assert Model(4).document(np.zeros(0), np.array([0, 0])).shape == (1,)


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op6_crf_toxicity(spark, sf_dir).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for d, r in rows.items())
    held = [d for d in labels if rows[d].held_out]
    toxic, clean = ([rows[d] for d in held if labels[d] == y] for y in (1, 0))
    assert len(toxic) > 5
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.7
    assert sum(r.predicted for r in clean) / len(clean) < 0.03
    assert sum((x.score > y.score) + (x.score == y.score) / 2 for x in toxic for y in clean) / len(toxic) / len(clean) > 0.9  # area under the curve
