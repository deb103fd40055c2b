"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents become pieces of at most ``cap`` tokens (only longer ones are cut).
The histogram of piece lengths, which has at most ``cap`` rows whatever the
corpus, is all that the driver sees. From it the linear grouping scheme makes a
plan: large lengths, sorted, are rounded up to the greatest of their group of
equal cardinality; the few rounded sizes are packed by a linear program over
configurations (column generation); actual documents, which are no longer,
take the rounded ones' places; what is left, and all small pieces, go best-fit
into the remaining room. The plan is a list of runs, each giving places to a
range of ranks within one length, so its size too depends on ``cap`` alone.
Every piece's rank within its length comes from Spark, salted, so that a
length that a third of the pieces share is spread over many tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import BATCH, partitions, saved
from quarrystone.llm.words import VALUES, mixed, powers, text_array
from quarrystone.llm.words import pieces as pieces_of
from quarrystone.sources.tables import table

# ---------------------------------------------------------------- tokens

#: Texts of these characters alone are split by the pattern below as the
#: tokenizer splits them; all others go to the tokenizer whole. Most need not
#: even that: see KIND.
PLAIN = re.compile("[\t-\r -~\xa0-\xff]*")
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")


class Ids(dict):
    """Token ids (little-endian, unsigned 32 bits) of single words, for one tokenizer file.

    The tokenizer merges within words only, so a word's ids hold wherever it
    stands. New words of a batch are encoded together, with spaces between;
    a token that ends a word tells so by its suffix. A full table starts anew.
    """

    MOST = 800_000

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 500):
            part = words[k : k + 500]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1]).tolist()
            if len(cuts) == len(part) + 1 and cuts[-1] == len(ids):
                raw = ids.tobytes()
                self.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(part, cuts, cuts[1:], strict=False))
            else:  # a tokenizer without such suffixes
                self.update((w, self.raw(w)) for w in part)

    def of(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of whole texts."""
        words = [None if "<|" in t or not PLAIN.fullmatch(t) else WORD.findall(t.lower()) for t in texts]
        if len(self) > self.MOST:
            self.clear()
        self.learn(list(set().union(*(w for w in words if w)) - self.keys()))
        for text, own in zip(texts, words, strict=True):
            yield self.raw(text) if own is None else b"".join(map(self.__getitem__, own))


#: Kinds of bytes in texts of ASCII and of the letters from U+00C0 to U+00FF:
#: 0 white space, 1 letter, 2 digit, 3 other, 9 not of such a text.
KIND = np.full(256, 9, dtype=np.uint8)
KIND[list(b" \t\n\x0b\x0c\r")] = 0
KIND[33:127] = 3
KIND[48:58] = 2
KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 1


class Table:
    """Ids of words by the words' hashes, so that whole buffers are looked up at once.

    Sorted arrays, of some 40 bytes a word: a dict takes several times that, in
    every worker. A full table starts anew.
    """

    #: Ids of all words together: long words have many.
    MOST_IDS = 1 << 22

    def __init__(self, path: str):
        self.words = Ids(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.flat = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype="<u4")
        self.start, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Words that are not known yet, by ascending hashes."""
        self.words.clear()
        self.words.learn(words)
        raw = [self.words[w] for w in words]
        size = np.array([len(r) // 4 for r in raw], dtype=np.int64)
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(raw), dtype="<u4")])
        at = np.searchsorted(self.keys, hashes)
        self.keys, self.start, self.size = np.insert(self.keys, at, hashes), np.insert(self.start, at, start), np.insert(self.size, at, size)

    def of(self, column: pa.Array) -> Iterator[bytes]:
        """The ids of whole texts."""
        for lo, hi, raw, at in pieces_of(column):
            kind = KIND[raw]
            after = np.concatenate([[0], raw[:-1]]) == 0xC3 if len(raw) else np.zeros(0, dtype=bool)
            # Other characters, signs among the letters, or what may be a contraction or a special token.
            odd = (kind == 9) | ((raw >= 0x80) & (raw != 0xC3) & ~after) | (after & ((raw == 0x97) | (raw == 0xB7)))
            if len(raw) > 1:
                odd[:-1] |= (raw[:-1] == 39) & (kind[1:] == 1) | (raw[:-1] == 60) & (raw[1:] == 124)
            odd = np.concatenate([[0], np.cumsum(odd)])
            odd = odd[at[1:]] > odd[at[:-1]]
            low = np.where((raw >= 65) & (raw <= 90) | after & (raw >= 0x80) & (raw <= 0x9E), raw + 32, raw).astype(np.uint8)
            bounds, ids = self.looked_up(low, kind, at)
            for i, plain in enumerate((~odd).tolist()):
                yield ids[bounds[i] : bounds[i + 1]].tobytes() if plain else next(self.words.of([column[lo + i].as_py()]))
            self.words.clear()

    def looked_up(self, low: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and the ids of all."""
        n = len(low)
        inside = (kind > 0) & (kind < 9)
        cut = np.zeros(n + 1, dtype=bool)
        cut[at] = True
        other = np.ones(n + 1, dtype=bool)
        other[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        other |= cut
        starts, ends = np.flatnonzero(inside & other[:-1]), np.flatnonzero(inside & other[1:]) + 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(VALUES[low] * up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        keys, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > Ids.MOST or len(self.flat) > self.MOST_IDS:
            self.clear()
        at_key = np.searchsorted(self.keys, keys)
        known = at_key < len(self.keys)
        known[known] = self.keys[at_key[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            raw = low.tobytes()
            at_first = first[new]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at_first].tolist(), ends[at_first].tolist(), strict=True)]
            self.learn(keys[new], words)
        place = np.searchsorted(self.keys, keys)[where]
        size = self.size[place]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.start[place] - stop + size, size)]
        return np.concatenate([[0], stop])[np.searchsorted(starts, at)], ids


_ids: dict[str, Table] = {}


def ids_of(path: str) -> Table:
    """One table per tokenizer and Python worker."""
    if path not in _ids:
        _ids[path] = Table(path)
    return _ids[path]


def pieces(docs: DataFrame, tokenizer: str, cap: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32 (and ids)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, raw in zip(batch.column(0).to_pylist(), ids.of(text_array(batch.column(1))), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * cap)):
                    part = raw[at : at + 4 * cap]
                    row = (doc, k, at // 4, len(part) // 4, zlib.crc32(part))
                    out.append((*row, np.frombuffer(part, dtype="<u4").tolist()) if with_ids else row)
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)
    names = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.mapInArrow(cut, names)


# ---------------------------------------------------------------- plan


def best_configuration(sizes: list[int], worth: np.ndarray, cap: int) -> np.ndarray:
    """Copies of each size that fit in ``cap`` and are worth most together (a knapsack)."""
    best, pick = np.zeros(cap + 1), np.full(cap + 1, -1)
    order = np.array(sizes)
    for room in range(min(sizes), cap + 1):
        fit = order <= room
        value = np.where(fit, best[room - np.minimum(order, room)] + worth, -1.0)
        k = int(np.argmax(value))
        best[room] = best[room - 1]
        if value[k] > best[room] + 1e-12:
            best[room], pick[room] = value[k], k
    found, room = np.zeros(len(sizes)), cap
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            found[pick[room]] += 1
            room -= sizes[pick[room]]
    return found


def configurations(sizes: list[int], counts: list[int], cap: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations of few sizes and how often to use each: the linear program, rounded down."""
    need = np.array(counts, dtype=float)
    basis = np.diag([float(cap // s) for s in sizes])
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        new = best_configuration(sizes, worth, cap)
        if new @ worth <= 1 + 1e-7:
            break
        use, step = np.linalg.solve(basis, need), np.linalg.solve(basis, new)
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = new
    use = np.linalg.solve(basis, need)
    left, found = np.array(counts), []
    for k in np.argsort(-use):
        column = basis[:, k].astype(int)
        n = int(min(max(0, np.floor(use[k] + 1e-6)), *(left[column > 0] // column[column > 0])))
        if n:
            left -= n * column
            found.append((column, n))
    return found


def plan(histogram: dict[int, int], cap: int, groups: int = 48, large: tuple[float, ...] = (1 / 8, 1 / 3, 1 / 2)) -> np.ndarray:
    """The scheme with each bound of ``large`` lengths in turn; the plan with fewest sequences.

    A low bound gives the linear program more to decide, a high one leaves more
    to best-fit: which is better depends on the histogram.
    """
    plans = [one_plan(histogram, cap, groups, bound) for bound in large]
    return min(plans, key=lambda p: int((p[:, 4] + -(-p[:, 2] // p[:, 3])).max(initial=0)))


def one_plan(histogram: dict[int, int], cap: int, groups: int, large: float) -> np.ndarray:
    """Places for all pieces: rows of length, first rank, ranks, ranks per sequence, first sequence, offset.

    Rank ``first + i`` of that length goes to sequence ``s + i // per`` at
    ``offset + i % per * length``. ``groups``: of the large lengths, those over
    ``large * cap`` tokens.
    """
    slots: list[tuple[int, int, int, int, int, int]] = []
    given: dict[int, int] = defaultdict(int)  # ranks of each length that have a place
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(cap + 1)]  # by room left: first sequence, sequences
    sequences = 0

    sizeable = sorted((n for n in histogram if n > large * cap), reverse=True)
    total = sum(histogram[n] for n in sizeable)
    if total:
        # Groups of equal cardinality over the sorted lengths; a length may lie in several.
        per = -(-total // groups)
        queues: list[list[list[int]]] = []  # of each group: [length, count], longest first
        room = 0
        for n in sizeable:
            count = histogram[n]
            while count:
                if not room:
                    queues.append([])
                    room = per
                take = min(room, count)
                queues[-1].append([n, take])
                count -= take
                room -= take
        sizes, members = [], []
        for q in queues:  # groups that round up to the same length are one
            if sizes and sizes[-1] == q[0][0]:
                members[-1] += q
            else:
                sizes.append(q[0][0])
                members.append(q)
        for column, n in configurations(sizes, [sum(c for _, c in q) for q in members], cap):
            streams = []  # each place in the configuration: n actual documents of its group
            for g in np.flatnonzero(column):
                for _ in range(column[g]):
                    stream, need = [], n
                    while need:
                        length, count = members[g][0]
                        take = min(need, count)
                        stream.append((length, given[length], take))
                        given[length] += take
                        need -= take
                        members[g][0][1] -= take
                        if not members[g][0][1]:
                            members[g].pop(0)
                    streams.append(stream)
            edges = sorted({0, n, *(int(x) for s in streams for x in np.cumsum([p[2] for p in s]))})
            used = {a: 0 for a in edges[:-1]}
            for stream in streams:
                at = 0
                for length, rank, take in stream:
                    for a, b in zip(edges, edges[1:], strict=False):
                        if at <= a < at + take:
                            slots.append((length, rank + a - at, b - a, 1, sequences + a, used[a]))
                            used[a] += length
                    at += take
            for a, b in zip(edges, edges[1:], strict=False):
                rooms[cap - used[a]].append((sequences + a, b - a))
            sequences += n

    for length in sorted(histogram, reverse=True):  # the rest, best-fit
        count, at = histogram[length] - given[length], length
        while count:
            while at < cap and not rooms[at]:
                at += 1
            if rooms[at] and at <= cap:
                room, (first, n) = at, rooms[at].pop()
            else:
                room, first, n = cap, sequences, -(-count // (cap // length))
                sequences += n
            per = room // length
            full = min(n, count // per)
            for more, per_one in ((full, per), (int(full < n and count % per > 0 and count < n * per), count % per)):
                if more:
                    slots.append((length, given[length], more * per_one, per_one, first, cap - room))
                    given[length] += more * per_one
                    count -= more * per_one
                    rooms[room - per_one * length].append((first, more))
                    first, n = first + more, n - more
            if n:
                rooms[room].append((first, n))
            at = length
    return np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)


# ---------------------------------------------------------------- Spark


def pack(docs: DataFrame, tokenizer: str, cap: int = 2048, end_id: int = 0, groups: int = 48, large: tuple[float, ...] = (1 / 8, 1 / 3, 1 / 2), with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents of ``docs`` into sequences of at most ``cap`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids, with ``with_ids``). Null and empty texts are
    one piece, of the end id alone. Rows that repeat an id, or have none, are
    packed as documents of their own. An empty table gives no rows. Other
    columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    cut = saved(pieces(rows, tokenizer, cap, end_id, with_ids), "pieces", BATCH)
    # At most cap rows, whatever the corpus.
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(histogram, cap, groups, large)
    pieces_all = sum(histogram.values())

    # Ranks within a length: within salts, plus how many rows lesser salts have. These sums go over blocks of salts
    # first, so that no task holds a row of every salt of a length.
    salts = max(4 * partitions(spark), pieces_all // 50_000)
    block = math.isqrt(salts - 1) + 1
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    within = Window.partitionBy("salt", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within))
    counts = saved(salted.groupBy("salt", "length").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("salt") / block)), "salt-counts")

    def before(*keys: str, order: str) -> Column:
        over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(over), F.lit(0))

    blocks = counts.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", before("length", order="block").alias("low"))
    inner = counts.select("length", "block", "salt", before("length", "block", order="salt").alias("base"))
    bases = inner.join(blocks, ["length", "block"]).select("salt", "length", (F.col("low") + F.col("base")).alias("base"))
    placed = ranked.join(bases, ["salt", "length"]).withColumn("rank", F.col("rank") + F.col("base") - 1).drop("salt", "base")

    key = (slots[:, 0] << 44) + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            slot = slots[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            i = rank - slot[:, 1]
            columns = [batch.column(c) for c in names] + [pa.array(slot[:, 4] + i // slot[:, 3]), pa.array(slot[:, 5] + i % slot[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    names = cut.columns
    kinds = ", ".join(f"{c} {t}" for c, t in cut.dtypes)
    return placed.select(*names, "rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
