"""Toxicity: a linear-chain conditional random field tags toxic spans.

Labels are of documents, tokens get theirs from them: a token of a toxic
document is toxic if its word, or the word's first or last letters, is found in
toxic documents' words far more often than in others'. The field has two states; its
emissions are hashed features of a word and its neighbours. Forward-backward
marginals give each token's probability, they aggregate to the document's
score through a calibration, and tokens over the threshold are the offending
spans.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.classify import bounded_sample, held_out
from quarrystone.llm.words import ALNUM, Words, mixed, pieces
from quarrystone.sources.tables import table

#: Words of a stretch of a chain. A text is one chain, however long; stretches of all chains are walked
#: together, and joined exactly by the products of their moves.
STRETCH = 128
#: Words of a block of chains that are held at once beside the features.
BLOCK = 1 << 17
SEEDS = [np.uint64(0xD6E8FEB86659FD93 * (i + 1) % 2**64) for i in range(9)]


def token_keys(w: Words) -> list[np.ndarray]:
    """Hashes of each word, of its beginnings of four to eight bytes and of its last five."""
    starts = [w.spans(w.starts, np.minimum(w.starts + n, w.ends)) ^ SEEDS[n - 2] for n in range(4, 9)]
    return [w.hashes(), *starts, w.spans(np.maximum(w.ends - 5, w.starts), w.ends) ^ SEEDS[7]]


def emissions(w: Words, bits: int) -> np.ndarray:
    """Feature numbers of each word: itself, its beginnings and end, and the words beside it."""
    keys = token_keys(w)
    word = keys[0]
    before, after = np.zeros_like(word), np.zeros_like(word)
    before[1:], after[:-1] = word[:-1], word[1:]
    if len(word):
        before[w.first[:-1][np.diff(w.first) > 0]] = 0
        after[w.first[1:][np.diff(w.first) > 0] - 1] = 0
    last = np.uint64(2**bits - 1)
    return np.stack([((f * (s | np.uint64(1))) >> np.uint64(20) & last).astype(np.int64) for f, s in zip([*keys, before, after], SEEDS, strict=True)])


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the chains of texts whose words begin at ``first``: one for each text with words."""
    lengths = np.diff(first)
    return first[:-1][lengths > 0], lengths[lengths > 0]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def marginals(score: np.ndarray, starts: np.ndarray, lengths: np.ndarray, moves: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each word the log odds of the toxic state; of all chains together the expected moves between states.

    ``score``: emissions' log odds; ``moves``: log weights of the 2 x 2 moves;
    ``begin``: log odds of the first state. Odds take the place of sums of
    logarithms: a step forward is r' = e (m01 + r m11) / (m00 + r m10), one
    backward s' = (m10 + m11 e s) / (m00 + m01 e s), and a stretch is the
    product of its steps' matrices.
    """
    out, expected = np.zeros(len(score)), np.zeros((2, 2))
    if not len(starts):
        return out, expected
    e = np.exp(np.clip(score, -100, 100))
    m, first = np.exp(moves - moves.max()), np.exp(np.clip(begin, -100, 100))
    # Stretches, the longest first.
    parts = -(-lengths // STRETCH)
    chain = np.repeat(np.arange(len(starts)), parts)
    number = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    at, size = starts[chain] + STRETCH * number, np.minimum(STRETCH, lengths[chain] - STRETCH * number)
    order = np.argsort(-size, kind="stable")
    at, size, head = at[order], size[order], number[order] == 0
    steps = int(size[0])
    width = np.searchsorted(-size, -np.arange(steps), side="left")  # stretches longer than each step

    # What enters each stretch, from before and from behind.
    before, behind = np.zeros(len(at)), np.ones(len(at))
    if parts.max() > 1:
        p = np.empty((2, 2, len(at)))
        p[:] = m[:, :, None]
        p[:, 0, head], p[:, 1, head] = 1, first
        p[:, 1] *= e[at]
        for t in range(1, steps):
            k = width[t]
            q = np.stack([p[:, 0, :k] * m[0, 0] + p[:, 1, :k] * m[1, 0], (p[:, 0, :k] * m[0, 1] + p[:, 1, :k] * m[1, 1]) * e[at[:k] + t]], axis=1)
            p[:, :, :k] = q / q.max(axis=(0, 1))
        place = np.empty(len(at), dtype=np.int64)
        place[order] = np.arange(len(at))
        begins = np.cumsum(parts) - parts
        long = np.argsort(-parts, kind="stable")
        counts = parts[long]
        for j in range(1, int(counts[0])):
            own = begins[long[: np.searchsorted(-counts, -j, side="left")]] + j
            a, x = place[own - 1], before[place[own - 1]]
            before[place[own]] = (p[0, 1, a] + x * p[1, 1, a]) / (p[0, 0, a] + x * p[1, 0, a])
        for j in range(int(counts[0]) - 1, 0, -1):
            own = begins[long[: np.searchsorted(-counts, -j, side="left")]] + j
            b, y = place[own], behind[place[own]]
            behind[place[own - 1]] = (p[1, 0, b] + p[1, 1, b] * y) / (p[0, 0, b] + p[0, 1, b] * y)

    forward, backward = np.zeros(len(score)), np.zeros(len(score))
    r = np.where(head, first, (m[0, 1] + before * m[1, 1]) / (m[0, 0] + before * m[1, 0])) * e[at]
    forward[at] = r
    for t in range(1, steps):
        k = width[t]
        r = e[at[:k] + t] * (m[0, 1] + r[:k] * m[1, 1]) / (m[0, 0] + r[:k] * m[1, 0])
        forward[at[:k] + t] = r
    s = behind.copy()
    backward[at + size - 1] = s
    for t in range(steps - 2, -1, -1):
        k = width[t + 1]
        x = e[at[:k] + t + 1] * s[:k]
        s[:k] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
        backward[at[:k] + t] = s[:k]
    words = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    out[words] = np.log(forward[words]) + np.log(backward[words])
    inner = np.delete(words, np.cumsum(lengths) - lengths)
    a, b = forward[inner - 1], e[inner] * backward[inner]
    joint = np.stack([np.full(len(inner), m[0, 0]), m[0, 1] * b, m[1, 0] * a, m[1, 1] * a * b])
    return out, (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


class Model:
    """Weights of the field and of the calibration."""

    def __init__(self, bits: int):
        self.bits, self.w = bits, np.zeros(2**bits)
        self.moves, self.begin, self.bias, self.scale = np.zeros((2, 2)), 0.0, -4.0, np.array([-3.0, 0.0, 0.0, 0.0, 0.0])

    def tag(self, w: Words) -> np.ndarray:
        """The log odds of each word of being toxic."""
        if not len(w):
            return np.zeros(0)
        score = self.w[emissions(w, self.bits)].sum(axis=0) + self.bias
        return marginals(score, *chains(w.first), self.moves, self.begin)[0]

    def document(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Scores of texts from their words' log odds: the calibrated greatest, expected number and share."""
        return sigmoid(self.summary(odds, first) @ self.scale)

    @staticmethod
    def summary(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros((len(first) - 1, 5))
        out[:, 0], out[:, 1] = 1, -10
        full = np.flatnonzero(np.diff(first))
        if len(full):
            out[full, 1] = np.clip(np.maximum.reduceat(odds, first[full]), -10, 10)
            p = sigmoid(odds)
            expected = np.add.reduceat(np.where(p > 0.1, p, 0), first[full])
            out[full, 2] = np.log1p(expected)
            out[full, 3] = np.log1p(np.maximum(0, expected - 1))
            out[full, 4] = np.log1p(200 * expected / np.diff(first)[full])
        out[:, 1] /= 5
        return out


def each(texts: pa.Array) -> Iterator[Words]:
    """The words of one text after the other; none is kept, for their sums take eight times a text's room."""
    # A run of ``pieces`` may hold several texts where some are empty.
    for _, _, raw, at in pieces(texts, 1):
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield Words(raw[a:b], np.array([0, b - a]), ALNUM)


def lexicon(texts: pa.Array, labels: np.ndarray, odds: float = 12.0) -> np.ndarray:
    """Keys of toxic words, from labels of texts, sorted.

    Those that at least three (or 0.4 %) of the toxic texts have, and that are
    ``odds`` times as frequent among their words as among others'.
    """
    toxic = [np.unique(np.concatenate(token_keys(w)), return_counts=True) for w, y in zip(each(texts), labels, strict=True) if y]
    if not toxic:
        return np.zeros(0, dtype=np.uint64)
    keys, which = np.unique(np.concatenate([k for k, _ in toxic]), return_inverse=True)
    n = np.bincount(which, np.concatenate([c for _, c in toxic]), minlength=len(keys))
    texts_of = np.bincount(which, minlength=len(keys))
    clean, total = np.zeros(len(keys)), 0
    for w, y in zip(each(texts), labels, strict=True):
        if not y and len(w) and len(keys):
            own = np.concatenate(token_keys(w))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            total += len(own)
            np.add.at(clean, at[keys[at] == own], 1)
    rate = (n / max(1, n.sum())) / ((clean + 0.5) / max(1, total))
    return keys[(texts_of >= max(3, 0.004 * len(toxic))) & (rate >= odds)]


def field(texts: pa.Array, labels: np.ndarray, bits: int, rounds: int = 25, rate: float = 0.5) -> Model:
    """Gradient ascent (AdaGrad) on the field's likelihood; the calibration is left as it is.

    Texts are whole chains. The field learns from all clean texts and from toxic
    ones in which words are known to be toxic.
    """
    model = Model(bits)
    model.bias = -10.0
    if len(set(labels.tolist())) < 2:
        return model
    bad = lexicon(texts, labels)
    # Features of whole texts, in blocks of about BLOCK words.
    found, marks, toxic, blocks = [], [], [], []

    def close() -> None:
        if found:
            blocks.append((np.concatenate(found, axis=1), np.array(marks), np.concatenate(toxic)))
            found.clear(), marks.clear(), toxic.clear()

    for w, y in zip(each(texts), labels, strict=True):
        t = np.any([np.isin(k, bad) for k in token_keys(w)], axis=0) if y else np.zeros(len(w), dtype=bool)
        if not len(w) or (y and not t.any()):
            continue
        found.append(emissions(w, bits).astype(np.int32))
        marks.append(len(w))
        toxic.append(t)
        if sum(marks) >= BLOCK:
            close()
    close()
    if not blocks:
        return model
    true_moves = np.zeros((2, 2))
    for _, lengths, y in blocks:
        inner = np.ones(len(y), dtype=bool)
        inner[np.cumsum(lengths) - lengths] = False
        now, prior = y[inner].astype(int), np.concatenate([[0], y[:-1]])[inner].astype(int)
        true_moves += np.bincount(prior * 2 + now, minlength=4).reshape(2, 2)
    weight, square = np.zeros(2**bits), np.full(2**bits, 1e-6)
    other, other_square = np.array([-4.0, *([0.0] * 5)]), np.full(6, 1e-6)
    for _ in range(rounds):
        slope, total, at_start, expected = -0.05 * weight, 0.0, 0.0, np.zeros((2, 2))
        for f, lengths, y in blocks:
            starts = np.cumsum(lengths) - lengths
            odds, moves = marginals(weight[f].sum(axis=0) + other[0], starts, lengths, other[2:].reshape(2, 2), other[1])
            miss = y - sigmoid(odds)
            for row in f:
                slope += np.bincount(row, miss, minlength=2**bits)
            total, at_start, expected = total + miss.sum(), at_start + miss[starts].sum(), expected + moves
        square += slope**2
        weight += rate * slope / np.sqrt(square)
        slope = np.concatenate([[total, at_start], (true_moves - expected).ravel()]) - 0.05 * other
        other_square += slope**2
        other += rate * slope / np.sqrt(other_square)
    model.w = weight
    model.bias, model.begin, model.moves = other[0], other[1], other[2:].reshape(2, 2)
    return model


def summaries(model: Model, texts: pa.Array) -> np.ndarray:
    """What the calibration sees of each text."""
    runs = (Words(raw, at, ALNUM) for _, _, raw, at in pieces(texts))
    return np.concatenate([np.zeros((0, 5)), *(model.summary(model.tag(w), w.first) for w in runs)])


def calibrated(model: Model, x: np.ndarray, labels: np.ndarray) -> Model:
    """Set the calibration: Newton steps of a logistic regression on summaries of texts that their fields had not seen."""
    if len(set(labels.tolist())) < 2:
        model.scale = np.array([-2.0, 0.0, 0.0, 0.0, 0.0])
        return model
    for _ in range(400):
        p = sigmoid(x @ model.scale)
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(5)
        step = np.linalg.solve(bend, x.T @ (labels - p) - 0.1 * model.scale)
        model.scale += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-6:
            break
    return model


def half(n: int, part: int) -> np.ndarray:
    """Which of ``n`` texts are in this half: dealt by a hash of their place."""
    return (mixed(np.arange(n, dtype=np.uint64)) & np.uint64(1)).astype(int) == part


def unseen(texts: pa.Array, labels: np.ndarray, part: int, bits: int) -> np.ndarray:
    """Summaries of the texts of one half, by a field learnt from the other."""
    own = half(len(texts), part)
    return summaries(field(texts.filter(pa.array(~own)), labels[~own], bits), texts.filter(pa.array(own)))


def fit(texts: pa.Array, labels: np.ndarray, bits: int) -> Model:
    """The field of all texts, calibrated by two fields of half of them, each on the other half."""
    x = np.concatenate([unseen(texts, labels, part, bits) for part in (0, 1)])
    return calibrated(field(texts, labels, bits), x, np.concatenate([labels[half(len(texts), part)] for part in (0, 1)]))


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, most: int = 6_000) -> Model:
    """Learn from at most ``most`` labelled documents; the model comes back.

    Three tasks learn: two fields of half of the texts, which only score the
    other half for the calibration, and the field of all. ``docs``: doc_id,
    text. ``labels``: doc_id, label (0 or 1). Without both labels no text
    scores over a half.
    """
    sample = bounded_sample(labels, most)
    rows = docs.where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id", "text").alias("place"), "text", F.col("label").cast("int").alias("label"))
    schema = pa.schema([("part", pa.int32()), ("place", pa.int64()), ("text", pa.string()), ("label", pa.int32())])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = pa.Table.from_batches([b.cast(schema) for b in batches], schema)
        for part in sorted(set(every.column("part").to_pylist())):
            seen = every.filter(pa.compute.equal(every.column("part"), part)).sort_by("place")
            texts, y = seen.column("text").combine_chunks(), seen.column("label").to_numpy().astype(int)
            out: list = [part, b"", b"", "", b"", b""]
            if part == 2:
                model = field(texts, y, bits)
                used = np.flatnonzero(model.w)
                out[1:4] = used.astype(np.int32).tobytes(), model.w[used].tobytes(), json.dumps([model.moves.tolist(), model.begin, model.bias])
            else:
                out[4:6] = unseen(texts, y, part, bits).tobytes(), y[half(len(y), part)].tobytes()
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(out, kinds, strict=True)], names=["part", "at", "w", "rest", "x", "y"])

    # Three rows, of at most 2^bits weights, or five numbers for each text of the sample.
    dealt = rows.select(F.explode(F.array(*map(F.lit, range(3)))).alias("part"), "place", "text", "label").repartition(8, "part")
    found = {r["part"]: r for r in dealt.mapInArrow(learn, "part int, at binary, w binary, rest string, x binary, y binary").collect()}
    if not found:  # nothing to learn from
        return fit(pa.array([], pa.string()), np.zeros(0, dtype=int), bits)
    model = Model(bits)
    model.w[np.frombuffer(found[2]["at"], dtype=np.int32)] = np.frombuffer(found[2]["w"])
    moves, model.begin, model.bias = json.loads(found[2]["rest"])
    model.moves = np.array(moves)
    x, y = (np.concatenate([np.frombuffer(found[p][c], dtype=kind) for p in (0, 1)]) for c, kind in (("x", float), ("y", int)))
    return calibrated(model, x.reshape(-1, 5), y)


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def toxic_spans(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, their toxicity (score, 0 to 1) and offending spans.

    spans: byte offsets in the UTF-8 text of runs of words with a marginal of
    ``threshold`` or more, and the run's greatest. Null and empty texts get the
    score of no words and no spans. Own columns of these names give way. An
    empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "spans")
    at_text = docs.columns.index(text_col)

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            scores, spans = [np.zeros(0)], [[] for _ in range(batch.num_rows)]
            for lo, _, raw, at in pieces(batch.column(at_text)):
                w = Words(raw, at, ALNUM)
                odds = field.tag(w)
                scores.append(field.document(odds, w.first))
                p = sigmoid(odds)
                before = -2
                for i in np.flatnonzero(p >= threshold).tolist():
                    doc = int(np.searchsorted(w.first, i, side="right")) - 1
                    own = spans[lo + doc]
                    if own and before == i - 1 and i > w.first[doc]:
                        own[-1]["end"], own[-1]["probability"] = int(w.ends[i] - at[doc]), max(own[-1]["probability"], float(p[i]))
                    else:
                        own.append({"start": int(w.starts[i] - at[doc]), "end": int(w.ends[i] - at[doc]), "probability": float(p[i])})
                    before = i
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores)), pa.array(spans, SPANS)], names=[*batch.schema.names, "score", "spans"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(tag, f"{kinds}, score double, spans array<struct<start:long,end:long,probability:double>>")


def op6_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic IS NOT NULL").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("toxic").alias("label"))
    tagged = toxic_spans(docs, train(docs, labels))
    return tagged.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")
