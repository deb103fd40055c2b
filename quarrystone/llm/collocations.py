"""Phrase collocations by hierarchical pair naming.

A phrase of k words is the pair of the frequent phrases of k - 1 words that it
begins and ends with: its name is a hash of their names, and a phrase can only
be frequent if both are. Level by level, tasks replace adjacent frequent names
by the names of their pairs and count these; a name that is frequent over the
whole corpus gets its row by joins with its two parents, from which it takes
the counts of all its beginnings and ends. So the parents serve to cut a phrase
at any place, and to look up what a longer phrase stands for.

Names are shuffled in blocks: a task's names of one range of hashes, sorted, as
the gaps between them, which are two bytes shorter than the names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.frequent import MOST_BITS, Frequent
from quarrystone.llm.shared import BATCH, partitions, saved
from quarrystone.llm.words import GRAM, Words, mixed, pieces, unmixed
from quarrystone.sources.tables import table

#: Bytes that end a piece of text; words are runs of others but space and tab.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = np.zeros(256, dtype=bool)
BREAK[list(BREAKS)] = True
WORD = ~BREAK
WORD[list(b" \t")] = False

#: Names that a task gathers before it counts them, and words that it remembers to have told.
GATHER = 1 << 22
TOLD = 1 << 19
#: A block of names with their counts.
BLOCKS = pa.schema([("part", pa.int32()), ("many", pa.int32()), ("names", pa.binary()), ("counts", pa.binary())])
#: A block of names with what they stand for: the names' left parents, or the words of a language, a line each.
ENTRIES = pa.schema([("level", pa.int32()), ("part", pa.int32()), ("many", pa.int32()), ("names", pa.binary()), ("lefts", pa.binary()), ("lang", pa.string()), ("words", pa.string())])


def levels(w: Words, of_text: np.ndarray, known: list[Frequent]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2 ... words, up to one more than is known: the name of the phrase at each word, and whether there is one whose parents are frequent."""
    names = mixed(w.hashes() ^ of_text[w.doc()]) if len(w) else np.zeros(0, dtype=np.uint64)
    ok = np.ones(len(names), dtype=bool)
    yield names, ok
    if len(w):
        place = np.cumsum(BREAK[w.buf])[w.starts]
        doc = w.doc()
        beside = (place[1:] == place[:-1]) & (doc[1:] == doc[:-1])
    for j, frequent in enumerate(known):
        if len(names) < 2:
            return
        alive = ok & frequent.of(names)
        ok = alive[:-1] & alive[1:] & (beside if j == 0 else True)
        names = mixed(names[:-1] * GRAM + names[1:])
        yield names, ok


def read(batch: pa.RecordBatch) -> Iterator[tuple[Words, np.ndarray, list[str]]]:
    """The words of a batch (lang, text), a seed for each text's language, and the languages."""
    langs = batch.column(0).to_pylist()
    seeds = {x: np.uint64(int.from_bytes(hashlib.sha256(x.encode()).digest()[:8], "little")) for x in set(langs)}
    for i, j, raw, at in pieces(batch.column(1)):
        yield Words(raw, at, WORD), np.array([seeds[x] for x in langs[i:j]], dtype=np.uint64), langs[i:j]


def range_bits(spark: SparkSession) -> int:
    """Names are dealt out by so many of their first bits: at least four ranges for each shuffle partition.

    A task makes a block for each, so that more would make blocks of few names.
    """
    return max(10, (4 * partitions(spark)).bit_length())


def packed(names: np.ndarray, bits: int) -> Iterator[tuple[int, slice, bytes]]:
    """Sorted distinct names by range: its number, their places, and the gaps between them in as few bytes each as hold the largest."""
    if not len(names):
        return
    number = (names >> np.uint64(64 - bits)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])
    gaps = names.astype("<u8")
    gaps[1:] -= names[:-1]
    gaps[first] = names[first] & np.uint64((1 << (64 - bits)) - 1)
    raw = gaps.view(np.uint8).reshape(-1, 8)
    ends = [*first[1:].tolist(), len(names)]
    for a, b, k, most in zip(first.tolist(), ends, number[first].tolist(), np.maximum.reduceat(gaps, first).tolist(), strict=True):
        yield k, slice(a, b), raw[a:b, : max(1, (most.bit_length() + 7) // 8)].tobytes()


def unpacked(number: int, many: int, raw: bytes, bits: int) -> np.ndarray:
    """The names of one range."""
    wide = np.zeros((many, 8), dtype=np.uint8)
    wide[:, : len(raw) // many] = np.frombuffer(raw, dtype=np.uint8).reshape(many, -1)
    return np.cumsum(wide.view("<u8")[:, 0], dtype=np.uint64) + (np.uint64(number) << np.uint64(64 - bits))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in their first ``keys`` columns and follow each other."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, lambda r: r[:keys]):
        yield key, [r[keys:] for r in own]


def counts(docs: DataFrame, known: list[Frequent], label: str, min_count: int) -> DataFrame:
    """name, n (and for single words lang) of all phrases one word longer than is known; but for words only those of ``min_count``."""
    shared = docs.sparkSession.sparkContext.broadcast(known)
    words = not known
    bits = range_bits(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                found, n = np.unique(np.concatenate(parts), return_counts=True)
                if not words:
                    # Counts by the place of their bytes: all but the first are mostly zero.
                    by_byte = n.astype("<u4").view(np.uint8).reshape(-1, 4)
                    rows = [(k, own.stop - own.start, raw, by_byte[own].T.tobytes()) for k, own, raw in packed(found, bits)]
                    for k in range(0, len(rows), 256):
                        yield pa.RecordBatch.from_pylist([dict(zip(BLOCKS.names, r, strict=True)) for r in rows[k : k + 256]], BLOCKS)
                    continue
                columns = [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64)), pa.array([lang] * len(found), pa.string())]
                for k in range(0, len(found), 1 << 16):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 16) for c in columns], names=["name", "n", "lang"])

        for batch in batches:
            for w, seeds, langs in read(batch):
                names, ok = list(levels(w, seeds, shared.value))[-1] if len(w) > len(shared.value) else (np.zeros(0, np.uint64), np.zeros(0, bool))
                if words:
                    doc = w.doc()
                    for lang in set(langs):
                        mine = np.array([x == lang for x in langs])
                        held.setdefault(lang, []).append(names[mine[doc]])
                else:
                    held.setdefault("", []).append(names[ok])
                size += len(names)
                if size >= GATHER:
                    yield from flushed()
                    held, size = {}, 0
        yield from flushed()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k,), rows in runs(batches, 1):
            names = np.concatenate([unpacked(k, many, raw, bits) for many, raw, _ in rows])
            n = np.concatenate([np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, -1).T).view("<u4")[:, 0] for _, _, raw in rows])
            found, at = np.unique(names, return_inverse=True)
            total = np.bincount(at, weights=n, minlength=len(found)).astype(np.int64)
            often = total >= min_count
            yield pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(total[often])], names=["name", "n"])

    if words:
        rows = docs.mapInArrow(count, "name long, n long, lang string")
        return saved(rows.groupBy("lang", "name").agg(F.sum("n").alias("n")), label)
    rows = docs.mapInArrow(count, "part int, many int, names binary, counts binary").repartition("part").sortWithinPartitions("part")
    return saved(rows.mapInArrow(added, "name long, n long"), label, BATCH)


def dictionary(docs: DataFrame, known: list[Frequent]) -> DataFrame:
    """level, name and either lang and word or the names of both parents, of all names that may be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    bits = range_bits(docs.sparkSession)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        held: list[list[tuple]] = [[] for _ in known]
        held_words: dict[str, dict[int, str]] = {}
        size = 0

        def blocks() -> Iterator[tuple]:
            for lang, words in held_words.items():
                name = np.array(list(words), dtype=np.uint64)
                order = np.argsort(name)
                text = np.array(list(words.values()), dtype=object)[order]
                for k, own, raw in packed(name[order], bits):
                    yield 1, k, own.stop - own.start, raw, None, lang, "\n".join(text[own])
            for level, rows in enumerate(held, 1):
                if rows:
                    name, left = (np.concatenate(x) for x in zip(*rows, strict=True))
                    found, at = np.unique(name, return_index=True)
                    left = left[at].astype("<u8")
                    for k, own, raw in packed(found, bits):
                        yield level, k, own.stop - own.start, raw, left[own].tobytes(), None, None
                    rows.clear()
            held_words.clear()

        def flushed() -> Iterator[pa.RecordBatch]:
            rows = list(blocks())
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist([dict(zip(ENTRIES.names, r, strict=True)) for r in rows[k : k + 256]], ENTRIES)

        for batch in batches:
            for w, seeds, langs in read(batch):
                before = None
                for level, (names, ok) in enumerate(levels(w, seeds, shared.value[:-1])):
                    alive = np.flatnonzero(ok & shared.value[level].of(names))
                    found, first = np.unique(names[alive], return_index=True)
                    at = alive[first]
                    if level:
                        held[level].append((found, before[at]))
                        size += len(found)
                    else:
                        new = np.array([x not in told for x in found.tolist()], dtype=bool)
                        found, at = found[new], at[new]
                        told.update(found.tolist())
                        low, doc = w.buf + (32 * ((w.buf >= 65) & (w.buf <= 90))).astype(np.uint8), w.doc()
                        for name, i, a, b in zip(found.tolist(), doc[at].tolist(), w.starts[at].tolist(), w.ends[at].tolist(), strict=True):
                            held_words.setdefault(langs[i], {})[name] = low[a:b].tobytes().decode("utf-8")
                        # A word takes some ten times the room of a name.
                        size += 10 * len(found)
                        if len(told) >= TOLD:
                            told = set()
                    before = names
                if size >= GATHER:
                    yield from flushed()
                    size = 0
        yield from flushed()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each name once. It gives the right parent of the left one, so that rows travel without it."""
        for (level, k), rows in runs(batches, 2):
            name, at = np.unique(np.concatenate([unpacked(k, many, raw, bits) for many, raw, *_ in rows]), return_index=True)
            left = right = lang = word = None
            if level == 1:
                lang = np.array([x for many, _, _, x, _ in rows for _ in range(many)], dtype=object)[at]
                word = np.array([x for r in rows for x in r[4].split("\n")], dtype=object)[at]
            else:
                left = np.concatenate([np.frombuffer(r[2], dtype="<u8") for r in rows])[at]
                right = (unmixed(name) - left * GRAM).view(np.int64)
                left = left.view(np.int64)
            columns = [pa.nulls(len(name), t) if x is None else pa.array(x, t) for x, t in ((left, pa.int64()), (lang, pa.string()), (word, pa.string()), (right, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), level, dtype=np.int32)), pa.array(name.view(np.int64)), *columns], names=["level", "name", "left", "lang", "word", "right"])

    rows = docs.mapInArrow(looked_up, "level int, part int, many int, names binary, lefts binary, lang string, words string")
    rows = rows.repartition("part").sortWithinPartitions("level", "part")
    return saved(rows.mapInArrow(once, "level int, name long, left long, lang string, word string, right long"), "names", BATCH)


def phrases(docs: DataFrame, most_words: int, min_count: int, most_bits: int = MOST_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2 ... words, and the words of each language (lang, n).

    A phrase has its name, its parents (left, right), lang, phrase, a (its
    count), and heads and tails: the counts of its first and of its last 1, 2
    ... words.
    """
    known: list[Frequent] = []
    counted: list[DataFrame] = []
    for level in range(1, most_words + 1):
        rows = counts(docs, known, f"counts-{level}", min_count)
        counted.append(rows.where(F.col("n") >= min_count).select("name", F.col("n").alias("a")))
        known.append(Frequent(counted[-1], counted[-1].count(), most_bits))
        if level == 1:
            totals = rows.groupBy("lang").agg(F.sum("n").alias("n"))
    names = dictionary(docs, known)
    tables: list[DataFrame] = []
    for level, rows in enumerate(counted, 1):
        mine = rows.join(names.where(F.col("level") == level).drop("level"), "name")
        if level == 1:
            mine = mine.select("name", "left", "right", "lang", F.col("word").alias("phrase"), "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
        else:
            above = tables[-1]
            left = above.select(F.col("name").alias("left"), "lang", F.col("phrase").alias("begin"), "heads")
            right = above.select(F.col("name").alias("right"), F.substring_index("phrase", " ", -1).alias("last"), "tails")
            mine = mine.drop("lang", "word").join(left, "left").join(right, "right")
            mine = mine.select("name", "left", "right", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"))
        tables.append(saved(mine, f"phrases-{level}"))
    return tables, totals


def scored(rows: DataFrame, words: int) -> DataFrame:
    """With score, l and r of the lowest-scoring cut; of equal ones the first."""
    cuts = []
    for k in range(1, words):
        left, right = f"heads[{k - 1}]", f"tails[{words - k - 1}]"
        whole = "1000000BD * CAST(a AS decimal(14,0)) * CAST(a AS decimal(14,0))"
        score = F.expr(f"({whole}) div (CAST({left} AS decimal(18,0)) * CAST({right} AS decimal(18,0)))")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r")))
    best = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return rows.withColumn("cut", best).select("*", "cut.l", "cut.r", "cut.score").drop("cut")


def collocations(docs: DataFrame, most_words: int = 3, min_count: int = 10, covered: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``most_words`` words by score.

    lang, rank (from 1), phrase, a (its count), l and r (those of both sides of
    the cut), n (the language's words), score: floor(1000000 * a * a / (l * r))
    of the lowest-scoring cut. Phrases of fewer than ``min_count`` occurrences
    are none; one that lies in a longer phrase of at least ``covered`` per cent
    of its count is left out. Ranks are by score, then count, descending, then
    by the phrase's bytes. ``most_bits`` bounds what is broadcast and changes no
    result. Products are decimals of 38 digits: counts may have 14.

    Null and empty texts have no words; a null language is ``und``. Every row
    counts, be it a repeated one. Very long texts are read whole. Other columns
    are not read. An empty table gives no rows.
    """
    docs = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    tables, totals = phrases(docs, most_words, min_count, most_bits)
    kept = []
    for words, rows in enumerate(tables[1:], 2):
        if words < most_words:
            # Enough to look one word further: what lies in a longer phrase lies in one of these, which is as frequent.
            longer = tables[words]
            above = longer.select(F.col("left").alias("name"), F.col("a").alias("over")).unionByName(longer.select(F.col("right").alias("name"), F.col("a").alias("over")))
            above = above.groupBy("name").agg(F.max("over").alias("over"))
            rows = rows.join(above, "name", "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a")))
        kept.append(scored(rows, words).select("lang", "phrase", "a", "l", "r", "score", "name"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    # In two steps: a language's phrases are first cut to the best of each of some shares.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("name"), F.lit(32))).orderBy(*order)
    best = reduce(DataFrame.unionByName, kept).withColumn("at", F.row_number().over(share)).where(F.col("at") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS g, count(*) AS f
      FROM w, unnest(range(1, 4)) AS t(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE k > 1 AND f >= 10),
cuts AS (SELECT c.lang, c.g, c.f AS a, j, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * c.f * c.f) // (CAST(x.f AS HUGEINT) * y.f) AS score
         FROM c, unnest(range(1, c.k)) AS t(j) JOIN g AS x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, j) JOIN g AS y ON y.lang = c.lang AND y.g = list_slice(c.g, j + 1, c.k)),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
gone AS (SELECT DISTINCT s.lang, s.g FROM c AS s JOIN (SELECT lang, f, unnest([list_slice(g, 1, 2), list_slice(g, 2, 3)]) AS part FROM c WHERE k = 3) AS t ON t.lang = s.lang AND t.part = s.g WHERE s.k = 2 AND 100 * t.f >= 50 * s.f),
ranked AS (SELECT best.*, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank
           FROM best ANTI JOIN gone USING (lang, g))
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
