"""Benchmark decontamination by winnowing.

A document's k-grams are hashed, and of each run of ``span - k + 1`` successive
ones the least is kept as a fingerprint; the benchmark's likewise. Any shared
run of ``span`` words then has a fingerprint in common. Where fingerprints
meet, the hit is extended to all windows of ``span`` words around it, and these
are compared word by word with the benchmark's windows: only equal words count.

A benchmark whose text is under ``broadcast_bytes`` is sent to all tasks, and
one pass over the documents does it all. A larger one is joined by shuffles:
fingerprints first, then the windows around those that met.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.shared import saved
from quarrystone.llm.words import ALNUM, LOWER, Words, grams, pieces
from quarrystone.sources.tables import table

FOLD = bytes(LOWER)


def selected(g: np.ndarray, room: np.ndarray, k: int, span: int) -> np.ndarray:
    """Winnowing: numbers of the k-grams that are least in some window of ``span`` words of one text."""
    n, w = len(room) - span + 1, span - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    whole = room[:n] >= span
    least = g[:n].copy()
    for i in range(1, w):
        np.minimum(least, g[i : i + n], out=least)
    keep = np.zeros(len(g), dtype=bool)
    for i in range(w):
        keep[i : i + n] |= whole & (g[i : i + n] == least)
    return np.flatnonzero(keep)


def windows_at(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """Hashes of the runs of ``span`` words that start at ``at``."""
    return grams(np.ascontiguousarray(h[at[:, None] + np.arange(span)]).T, span)[0] if len(at) else np.zeros(0, dtype=np.uint64)


def fingerprints(w: Words, h: np.ndarray, room: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and hashes of all fingerprints of some texts."""
    g = grams(h, min(k, span))
    at = selected(g, room, min(k, span), span)
    return at, g[at]


def around(at: np.ndarray, room: np.ndarray, doc: np.ndarray, k: int, span: int) -> np.ndarray:
    """Starts of all windows that hold a k-gram at one of ``at`` in the same text."""
    near = (at[:, None] - np.arange(span - min(k, span) + 1)).ravel()
    back = np.repeat(at, span - min(k, span) + 1)
    ok = near >= 0
    near, back = near[ok], back[ok]
    return np.unique(near[(room[near] >= span) & (doc[near] == doc[back])])


class Phrase:
    """Words of one window as bytes with single spaces."""

    def __init__(self, w: Words):
        self.raw, self.starts, self.ends = w.buf.tobytes().translate(FOLD), w.starts.tolist(), w.ends.tolist()

    def __call__(self, at: int, span: int) -> bytes:
        return b" ".join([self.raw[self.starts[i] : self.ends[i]] for i in range(at, at + span)])


def item_windows(texts: list[str | None], k: int, span: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """Of each text: its number, its windows' length, fingerprints, windows' hashes, windows' words."""
    for i, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
        w = Words(raw, np.array([0, len(raw)]), ALNUM)
        if n := min(len(w), span):
            h, room = w.hashes(), w.room()
            yield i, n, fingerprints(w, h, room, k, n)[1], grams(h, n), list(map(lambda at, p=Phrase(w), n=n: p(at, n), range(len(w) - n + 1)))


class Index:
    """A small benchmark: fingerprints and windows by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], k: int, span: int):
        self.k = k
        marks: dict[int, list[np.ndarray]] = defaultdict(list)
        self.items: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(dict))
        for i, n, prints, hashes, phrases in item_windows([t for _, t in items], k, span):
            marks[n].append(prints)
            for x, phrase in zip(hashes.tolist(), phrases, strict=True):
                self.items[n][x].setdefault(phrase, set()).add(items[i][0])
        self.prints = {n: np.unique(np.concatenate(m)) for n, m in marks.items()}
        self.items = {n: dict(x) for n, x in self.items.items()}
        self.windows = {n: np.array(sorted(x), dtype=np.uint64) for n, x in self.items.items()}

    def hits(self, w: Words) -> Iterator[tuple[int, int, set[str]]]:
        """Starts and lengths of the windows of ``w`` that are the benchmark's, with their items."""
        h, room, phrase, doc = w.hashes(), w.room(), None, None
        for n, prints in self.prints.items():
            at, found = fingerprints(w, h, room, self.k, n)
            at = at[among(found, prints)]
            if len(at):
                doc = w.doc() if doc is None else doc
                starts = around(at, room, doc, self.k, n)
                hashes = windows_at(h, starts, n)
                known = among(hashes, self.windows[n])
                phrase = phrase or Phrase(w)
                for start, x in zip(starts[known].tolist(), hashes[known].tolist(), strict=True):
                    if items := self.items[n][x].get(phrase(start, n)):
                        yield start, n, items


def among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(of):
        return np.zeros(len(values), dtype=bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


RESULT = "n_words long, n_hit long, items array<string>, hits array<struct<word:long,words:long>>"
HITS = pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64())]))


def merged(spans: list[tuple[int, int]]) -> list[dict]:
    """Windows as disjoint runs of words."""
    out: list[list[int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [{"word": a, "words": b - a} for a, b in out]


def result(n_words: list[int], spans: dict[int, list[tuple[int, int]]], items: dict[int, set[str]]) -> list[pa.Array]:
    runs = [merged(spans[i]) if i in spans else [] for i in range(len(n_words))]
    return [
        pa.array(n_words, pa.int64()),
        pa.array([sum(r["words"] for r in x) for x in runs], pa.int64()),
        pa.array([sorted(items[i]) if i in items else [] for i in range(len(n_words))], pa.list_(pa.string())),
        pa.array(runs, HITS),
    ]


def overlaps(docs: DataFrame, benchmark: DataFrame, span: int = 10, k: int = 6, broadcast_bytes: int = 16 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """What each document shares with a benchmark, in windows of ``span`` words.

    Words are runs of ASCII letters and digits and all non-ASCII characters,
    A-Z in lower case. An item of fewer than ``span`` words is one window of
    all its words. All rows and columns of ``docs`` come back with n_words,
    n_hit (words inside shared windows), items (sorted ids as strings) and hits
    (disjoint runs of words).

    Null and empty texts have no words; items without words or with a null id
    take no part; repeated rows each get the same answer; an item that repeats
    counts once; own columns of the four names give way; either table may be
    empty.
    """
    spark = docs.sparkSession
    names = ("n_words", "n_hit", "items", "hits")
    docs = docs.drop(*names)
    items = benchmark.where(F.col(f"`{item_col}`").isNotNull()).select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").alias("words")).distinct()
    bytes_all = items.agg(F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item") + 64), F.lit(0))).first()[0]
    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    at_text = docs.columns.index(text_col)

    if bytes_all <= broadcast_bytes:
        index = spark.sparkContext.broadcast([(r["item"], r["words"]) for r in items.collect()])

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Index(index.value, k, span)
            for batch in batches:
                n_words: list[int] = []
                spans, found = defaultdict(list), defaultdict(set)
                for lo, _, raw, at in pieces(batch.column(at_text)):
                    w = Words(raw, at, ALNUM)
                    n_words += np.diff(w.first).tolist()
                    for start, n, of in known.hits(w):
                        doc = int(np.searchsorted(w.first, start, side="right")) - 1
                        spans[lo + doc].append((start - int(w.first[doc]), n))
                        found[lo + doc] |= of
                yield pa.RecordBatch.from_arrays([*batch.columns, *result(n_words, spans, found)], names=[*batch.schema.names, *names])

        return docs.mapInArrow(find, f"{kinds}, {RESULT}")
    return overlaps_by_join(docs, items, span, k, text_col, kinds)


def overlaps_by_join(docs: DataFrame, items: DataFrame, span: int, k: int, text_col: str, kinds: str) -> DataFrame:
    """The same for a benchmark of any size, by shuffles."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(1).to_pylist()
            for i, n, prints, hashes, phrases in item_windows(texts, k, span):
                item = batch.column(0)[i].as_py()
                rows += [(item, n, x, None) for x in prints.view(np.int64).tolist()]
                rows += [(item, n, x, p) for x, p in zip(hashes.view(np.int64).tolist(), phrases, strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["item", "span", "hash", "phrase"])

    marks = saved(items.mapInArrow(of_items, "item string, span int, hash long, phrase binary"), "benchmark-windows")
    spans = [r["span"] for r in marks.select("span").distinct().collect()]  # 1 to ``span`` at most
    # Each side of a join is read from a written table, so that adaptive execution can split a print or window of many documents.
    prints = saved(marks.where("phrase IS NULL").select("span", "hash").distinct(), "benchmark-prints")
    windows = saved(marks.where("phrase IS NOT NULL").distinct(), "benchmark-phrases")
    phrases = saved(windows.select("span", "hash", "phrase").distinct(), "phrases")

    # Rows of one text are one: what is found holds for all of them.
    texts = docs.select(F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL").withColumn("key", F.sha2("text", 256)).dropDuplicates(["key"])

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in pieces(batch.column(0)):
                w = Words(raw, at, ALNUM)
                h, room, doc = w.hashes(), w.room(), w.doc()
                for n in spans:
                    where, found = fingerprints(w, h, room, k, n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(lo, hi - lo).take(pa.array(doc[where])), pa.array(np.full(len(where), n, dtype=np.int32)), pa.array(where - w.first[doc[where]]), pa.array(found.view(np.int64))],
                        names=["key", "span", "word", "hash"],
                    )

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in pieces(batch.column(0)):
                w = Words(raw, at, ALNUM)
                h, room, doc, phrase = w.hashes(), w.room(), w.doc(), Phrase(w)
                met = batch.column(2).slice(lo, hi - lo).to_pylist()
                for n in spans:
                    here = [int(w.first[i]) + m["word"] for i, each in enumerate(met) for m in each if m["span"] == n]
                    starts = around(np.array(sorted(here), dtype=np.int64), room, doc, k, n)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(lo, hi - lo).take(pa.array(doc[starts])), pa.array(np.full(len(starts), n, dtype=np.int32)), pa.array(starts - w.first[doc[starts]]), pa.array(windows_at(h, starts, n).view(np.int64)), pa.array([phrase(x, n) for x in starts.tolist()], pa.binary())],
                        names=["key", "span", "word", "hash", "phrase"],
                    )

    met = texts.select("text", "key").mapInArrow(of_docs, "key string, span int, word long, hash long").join(prints, ["span", "hash"], "left_semi")
    places = met.groupBy("key").agg(F.collect_set(F.struct("span", "word")).alias("met"))
    near = saved(texts.join(places, "key").select("text", "key", "met").mapInArrow(windows_of, "key string, span int, word long, hash long, phrase binary"), "document-windows")
    hit = saved(near.join(phrases, ["span", "hash", "phrase"], "left_semi"), "hits")
    once = saved(hit.select("key", "span", "hash", "phrase").distinct(), "hit-windows")
    shared = windows.join(once, ["span", "hash", "phrase"]).select("key", "item").distinct()
    found = hit.groupBy("key").agg(F.collect_set(F.struct("word", "span")).alias("spans")).join(shared.groupBy("key").agg(F.collect_set("item").alias("of")), "key")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.schema.names[:-2]
            n_words = []
            for _, _, raw, at in pieces(batch.column(text_col)):
                n_words += np.diff(Words(raw, at, ALNUM).first).tolist()
            spans = {i: [(x["word"], x["span"]) for x in v] for i, v in enumerate(batch.column("__spans").to_pylist()) if v}
            of = {i: set(v) for i, v in enumerate(batch.column("__of").to_pylist()) if v}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], *result(n_words, spans, of)], names=[*own, "n_words", "n_hit", "items", "hits"])

    keyed = docs.withColumn("__key", F.sha2(f"`{text_col}`", 256))
    found = found.select(F.col("key").alias("__key"), F.col("spans").alias("__spans"), F.col("of").alias("__of"))
    whole = keyed.join(found, "__key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__spans", "__of")
    return whole.mapInArrow(settle, f"{kinds}, {RESULT}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that share no window with the benchmark, with their own columns."""
    clean = overlaps(docs.select("*"), benchmark, **how).where("n_hit = 0")
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_words", "n_hit", "items", "hits")])


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, hit words and items that each document shares with the benchmark."""
    found = overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )



ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS phrase
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase
       FROM d, (SELECT DISTINCT n FROM bw) AS spans, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS t(i)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(0, CAST(n AS BIGINT))) AS t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items_sha256 FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
