"""Removal of repeated byte strings, by merged Burrows-Wheeler transforms of shards.

Texts are cut at places that depend on what stands around them alone, so that
equal strings are cut alike: a cut is the last least hash of ``gram`` bytes in
a window of ``window`` places. The bytes between two cuts are a symbol, and a
text is a row of symbols. Each shard sorts its suffixes once and keeps its
transform: the symbols in front of its sorted suffixes, and the row that each
step to the front leads to. Then the shards' orders are interleaved, round by
round: in round h an interval of suffixes that share h symbols, got by a step
to the front from the intervals of round h - 1, meets the intervals of the same
name in all other shards, and only repeated intervals go on. No suffix is sorted
again; the round that a suffix falls out in is the common prefix that it has
with any other.

Every repeated string of ``length`` bytes holds at least one symbol, so that it
begins where a suffix has a common prefix with another. These few places are
then checked exactly: first all strings that begin before one cut at once, by a
hash of all bytes that they cover, then, where these are unlike, each string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.frequent import MOST_BITS, Frequent, Tally
from quarrystone.llm.shared import discard, saved
from quarrystone.llm.words import GRAM, VALUES, mixed, pieces, powers
from quarrystone.sources.tables import table

#: Symbols of a shard: its suffixes are sorted in one task.
SHARD = 1 << 19
#: A common prefix whose end is not known, as it goes on after the last round.
ENDLESS = 1 << 62
#: For the second half of hashes of 128 bits.
VALUES_2 = mixed(VALUES ^ np.uint64(0x5851F42D4C957F2D))


class Cuts:
    """The cuts of some texts (bytes ``raw``, text i from ``at[i]`` on) and the strings of ``length`` bytes that begin before them.

    f: places of cuts; text: the text of each; least: of each place the cut that
    the window from there on chooses. Strings that begin in zs to ze have their
    first cut in ``f[zj]``; la and lb number the last cut that the first and the
    last of these strings choose.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, gram: int, window: int, length: int):
        self.raw, self.at, self.length = raw, at, length
        self.wide = window + gram - 1
        n = len(raw)
        up, self.down = powers(n + 1)
        self.sums = [np.zeros(n + 1, dtype=np.uint64)]
        np.cumsum(VALUES[raw] * up[:n], out=self.sums[0][1:])
        if n < length:
            self.f = self.text = self.zs = self.ze = self.zj = self.la = self.lb = np.zeros(0, dtype=np.int64)
            return
        starts = np.arange(n - gram + 1)
        key = mixed((self.sums[0][gram:] - self.sums[0][:-gram]) * self.down[: n - gram + 1])
        low = np.uint64(0xFFFFFFFF)
        key = (key & ~low) | (low - starts.astype(np.uint64))
        span = 1
        while 2 * span <= window:
            key = np.minimum(key[:-span], key[span:])
            span *= 2
        if span < window:
            key = np.minimum(key[: len(key) - (window - span)], key[window - span :])
        self.least = (low - (key & low)).astype(np.int64)
        at_least = np.diff(at) >= length
        first, after = at[:-1][at_least], at[1:][at_least]
        mark = np.zeros(n + 1, dtype=bool)
        mark[self.least[self._inside(first, after - self.wide)]] = True
        self.f = np.flatnonzero(mark)
        self.text = np.searchsorted(at, self.f, side="right") - 1
        x = self._inside(first, after - length)
        chosen = self.least[x]
        edge = np.flatnonzero(chosen[1:] != chosen[:-1])
        begin, end = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(x) - 1]])
        if not len(x):
            begin = end = np.zeros(0, dtype=np.int64)
        self.zs, self.ze = x[begin], x[end]
        self.zj, self.la, self.lb = (np.searchsorted(self.f, y) for y in (chosen[begin], self.last(self.zs), self.last(self.ze)))

    def _inside(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """All places from each first to its last."""
        step = np.zeros(len(self.least) + 1, dtype=np.int32)
        np.add.at(step, first, 1)
        np.add.at(step, last + 1, -1)
        return np.flatnonzero(np.cumsum(step[:-1]))

    def last(self, x: np.ndarray) -> np.ndarray:
        """The last cut that is chosen within the strings from ``x`` on."""
        return self.least[x + self.length - self.wide]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, half: int = 0) -> np.ndarray:
        """Hashes of spans; the second half is made when it is asked for."""
        if half and len(self.sums) == 1:
            up, _ = powers(len(self.raw) + 1)
            self.sums.append(np.zeros(len(self.raw) + 1, dtype=np.uint64))
            np.cumsum(VALUES_2[self.raw] * up[: len(self.raw)], out=self.sums[1][1:])
        sums = self.sums[half]
        return mixed((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """The name of the symbol that begins at each cut, and whether one does: after a text's last cut there is none."""
        whole = np.zeros(len(self.f), dtype=bool)
        whole[:-1] = self.text[1:] == self.text[:-1]
        names = np.zeros(len(self.f), dtype=np.uint64)
        at = np.flatnonzero(whole)
        names[at] = self.hashes(self.f[at], self.f[at + 1])
        return names, whole


class Plan:
    """Lengths that belong together: a string of ``length`` bytes holds a whole symbol."""

    def __init__(self, length: int, gram: int, window: int, rounds: int):
        if 2 * window + gram - 1 > length:
            raise ValueError("a string of this length may hold no whole symbol: lessen window or gram")
        self.length, self.gram, self.window, self.rounds = length, gram, window, rounds

    def cuts(self, column: pa.Array) -> Iterator[tuple[int, int, Cuts]]:
        for i, j, raw, at in pieces(column):
            yield i, j, Cuts(raw, at, self.gram, self.window, self.length)


# ---------------------------------------------------------------- shards


class Shard:
    """What a shard gathers: the rows of symbols that may be repeated, and the places before them."""

    ZONE = ("k1", "k2", "s", "e", "r1", "r2", "name", "pos", "need")

    def __init__(self):
        self.n, self.names, self.ends, self.on, self.zones = 0, [], [], [], []

    def add(self, c: Cuts, k1: np.ndarray, k2: np.ndarray, frequent: Frequent) -> None:
        names, whole = c.symbols()
        if not len(c.zj):
            return
        live = whole & frequent.of(names)
        dead = np.concatenate([[0], np.cumsum(~live)])
        good = np.flatnonzero(dead[c.la] == dead[c.zj])
        if not len(good):
            return
        zj, lb = c.zj[good], c.lb[good]
        step = np.zeros(len(names) + 1, dtype=np.int64)
        np.add.at(step, zj, 1)
        np.add.at(step, lb, -1)
        kept = np.flatnonzero((np.cumsum(step[:-1]) > 0) & live)
        start = c.at[c.text]
        on = np.zeros(len(kept), dtype=bool)
        on[:-1] = kept[1:] == kept[:-1] + 1
        self.names.append(names[kept])
        self.ends.append((c.f[kept + 1] - start[kept]).astype(np.int64))
        self.on.append(on)
        text = c.text[zj]
        s, e = c.zs[good], c.ze[good]
        span = [c.hashes(s, e + c.length, half) for half in (0, 1)]
        pos = self.n + np.searchsorted(kept, zj)
        self.zones.append([k1[text], k2[text], s - c.at[text], e - c.at[text], *span, names[zj], pos, c.la[good] - zj])
        self.n += len(kept)

    def row(self, rounds: int) -> dict[str, list]:
        """The shard's transform and zones, as one row of binary columns."""
        names, on = np.concatenate(self.names), np.concatenate(self.on)
        n = len(names)
        # Prefix doubling: ranks by 1, 2, 4 ... symbols.
        _, rank = np.unique(names, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        follows = np.where(on, np.arange(1, n + 1), n)
        deep = 1
        while deep < rounds:
            ahead = np.concatenate([rank, [0]])[follows]
            _, rank = np.unique(rank * np.int64(n + 2) + ahead, return_inverse=True)
            rank = rank.astype(np.int64) + 1
            follows = np.concatenate([follows, [n]])[follows]
            deep *= 2
        order = np.argsort(rank, kind="stable")
        row_of = np.empty(n, dtype=np.int64)
        row_of[order] = np.arange(n)
        front = np.full(n, -1, dtype=np.int64)
        before = np.flatnonzero(on)
        front[row_of[before + 1]] = row_of[before]
        zones = [np.concatenate([z[i] for z in self.zones]) for i in range(len(self.ZONE))]
        binary = {"names": names[order], "front": front.astype(np.int32), "row_of": row_of.astype(np.int32), "ends": np.concatenate(self.ends), **dict(zip(self.ZONE, zones, strict=True))}
        return {k: [v.tobytes()] for k, v in binary.items()}


COLUMNS = ("names", "front", "row_of", "ends", *Shard.ZONE)


def shards(docs: DataFrame, plan: Plan, frequent: Frequent) -> DataFrame:
    """A row per shard: see ``Shard``."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Shard()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for i, j, c in plan.cuts(batch.column(2)):
                now.add(c, k1[i:j], k2[i:j], shared.value)
                if now.n >= SHARD:
                    yield pa.RecordBatch.from_pydict(now.row(plan.rounds))
                    now = Shard()
        if now.n:
            yield pa.RecordBatch.from_pydict(now.row(plan.rounds))

    return saved(docs.mapInArrow(gather, ", ".join(f"{c} binary" for c in COLUMNS)), "shards")


def interleaved(names: np.ndarray, front: np.ndarray, known: list[Frequent]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For h = 1, 2 ... symbols: the name of each sorted suffix's prefix, and whether it may be repeated.

    A step to the front of row r leads to row front[r], whose prefix is the
    symbol there and r's prefix of one symbol less. The last pair is of the
    first round that is not known yet.
    """
    prefix, alive = names, np.ones(len(names), dtype=bool)
    yield prefix, alive
    rows = np.flatnonzero(front >= 0)
    to = front[rows]
    for j in range(len(known) + 1):
        longer = np.zeros(len(names), dtype=np.uint64)
        longer[to] = mixed(names[to] * GRAM + prefix[rows])
        may = np.zeros(len(names), dtype=bool)
        may[to] = alive[rows] & alive[to]
        if j < len(known):
            may &= known[j].of(longer)
        prefix, alive = longer, may
        yield prefix, alive


def column(batch: pa.RecordBatch, name: str, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(name)[i].as_py(), dtype=kind)


def merged(parts: DataFrame, plan: Plan, most_bits: int) -> list[Frequent]:
    """The repeated prefixes of 2, 3 ... symbols over all shards, round by round."""
    known: list[Frequent] = []
    slim = parts.select("names", "front")
    while len(known) < plan.rounds - 1:
        shared = parts.sparkSession.sparkContext.broadcast(known)

        def intervals(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tally = Tally()
            for batch in batches:
                for i in range(batch.num_rows):
                    prefix, may = list(interleaved(column(batch, "names", i, np.uint64), column(batch, "front", i, np.int32), shared.value))[-1]
                    prefix = prefix[may]
                    if len(prefix):
                        edges = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(prefix)]])
                        yield from tally.add(prefix[edges[:-1]], np.diff(edges))
            yield from tally.flushed()

        counted = slim.mapInArrow(intervals, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name")
        counted = saved(counted, "intervals")
        n = counted.count()
        known.append(Frequent(counted, n, most_bits))
        discard(counted)
        if not n:
            break
    return known


def zones(parts: DataFrame, plan: Plan, known: list[Frequent]) -> DataFrame:
    """k1, k2 (of the text), s, e (strings that begin from s to e), r1, r2 (a hash of all bytes of theirs), name (of the first symbol), reach.

    Only where the common prefix with another suffix holds the symbols that the
    first of the strings needs. ``reach``: where that common prefix ends.
    """
    shared = parts.sparkSession.sparkContext.broadcast(known)
    kinds = ("k1", "k2", "s", "e", "r1", "r2", "name", "reach")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, front = column(batch, "names", i, np.uint64), column(batch, "front", i, np.int32)
                common = np.zeros(len(names), dtype=np.int64)
                for h, (_, alive) in enumerate(interleaved(names, front, shared.value)):
                    if h <= len(shared.value):
                        common += alive
                z = {c: column(batch, c, i, np.int64) for c in Shard.ZONE}
                mine = common[column(batch, "row_of", i, np.int32)[z["pos"]]]
                most = len(shared.value) + 1
                # With fewer rounds than planned the last one found nothing: no prefix goes on.
                open_end = mine >= most if most == plan.rounds else np.zeros(len(mine), dtype=bool)
                keep = np.flatnonzero(open_end | (mine >= z["need"]))
                ends = column(batch, "ends", i, np.int64)
                z["reach"] = np.where(open_end, ENDLESS, ends[np.minimum(z["pos"] + mine - 1, len(ends) - 1)])
                for k in range(0, len(keep), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(z[c][keep[k : k + (1 << 16)]]) for c in kinds], names=list(kinds))

    return parts.mapInArrow(told, ", ".join(f"{c} long" for c in kinds))


# ---------------------------------------------------------------- exact check


def strings(work: DataFrame, plan: Plan, frequent: Frequent | None) -> DataFrame:
    """The strings of zones (k1, k2, text, zs, ze, reach): counted by the first half of their hash, or if told which of these are repeated, each."""
    shared = work.sparkSession.sparkContext.broadcast(frequent)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for i, j, c in plan.cuts(batch.column(2)):
                zs, ze, reach, text = [], [], [], []
                for t in range(i, j):
                    lists = [batch.column(k)[t].values.to_numpy() for k in (3, 4, 5)]
                    zs.append(lists[0] + c.at[t - i])
                    ze.append(lists[1] + c.at[t - i])
                    reach.append(lists[2] + c.at[t - i])
                    text.append(np.full(len(lists[0]), t - i))
                zs, ze, reach, text = (np.concatenate(a) for a in (zs, ze, reach, text))
                if not len(zs):
                    continue
                sizes = ze - zs + 1
                x = np.repeat(zs - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
                ok = c.last(x) <= np.repeat(reach, sizes)
                x, of = x[ok], np.repeat(text, sizes)[ok]
                h = c.hashes(x, x + plan.length)
                if shared.value is None:
                    yield from tally.add(h)
                    continue
                ok = shared.value.of(h)
                x, of, h = x[ok], of[ok], h[ok]
                h2 = c.hashes(x, x + plan.length, 1)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (h.view(np.int64), h2.view(np.int64), k1[i:j][of], k2[i:j][of], x - c.at[of])], names=["h1", "h2", "k1", "k2", "x"])
        yield from tally.flushed()

    schema = "name long, n long" if frequent is None else "h1 long, h2 long, k1 long, k2 long, x long"
    return work.mapInArrow(each, schema)


def told_apart(docs: DataFrame, keys: Frequent, inside: bool) -> DataFrame:
    """The rows of ``docs`` whose k1 is among the keys, or those whose k1 is not."""
    shared = docs.sparkSession.sparkContext.broadcast(keys)
    at = docs.columns.index("k1")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = shared.value.of(batch.column(at).to_numpy().view(np.uint64))
            yield batch.filter(pa.array(known if inside else ~known))

    return docs.mapInArrow(chosen, docs.schema)


def keys_of(rows: DataFrame, most_bits: int) -> Frequent:
    names = rows.select(F.col("k1").alias("name"))
    return Frequent(names, rows.count(), most_bits)


def repeated_starts(docs: DataFrame, plan: Plan, most_bits: int) -> DataFrame:
    """k1, k2 (the hash of a text) and lists of the first and last places, zs and ze, from which strings are repeated."""
    texts = docs.select("k1", "k2", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            for _, _, c in plan.cuts(batch.column(2)):
                names, whole = c.symbols()
                yield from tally.add(names[whole])
        yield from tally.flushed()

    repeated = saved(texts.mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"), "symbols")
    parts = shards(texts, plan, Frequent(repeated, repeated.count(), most_bits))
    discard(repeated)
    found = saved(zones(parts, plan, merged(parts, plan, most_bits)), "places")
    discard(parts)

    # Zones all of whose bytes stand elsewhere too; written, so that adaptive execution can split those of many copies.
    alike = saved(found.groupBy("r1", "r2").agg(F.count("*").alias("n")).where("n > 1").select("r1", "r2", F.lit(True).alias("alike")), "alike-zones")
    places, found = found, saved(found.join(alike, ["r1", "r2"], "left"), "zones")
    discard(places, alike)
    sure, open_zones = found.where("alike"), found.where("alike IS NULL")
    # Strings of the others may be equal to some of zones that are sure: one of each kind is enough.
    beside = saved(open_zones.select("name").distinct(), "open-symbols")
    own = ["k1", "k2", "s", "e", "reach"]
    partners = sure.join(beside, "name", "left_semi").groupBy("r1", "r2").agg(F.min(F.struct(*own)).alias("z")).select("z.*")
    listed = open_zones.select(*own).unionByName(partners).groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e", "reach")).alias("z"))
    listed = saved(listed.select("k1", "k2", F.col("z.s").alias("zs"), F.col("z.e").alias("ze"), F.col("z.reach").alias("reach")), "open-zones")
    once = told_apart(texts, keys_of(listed, most_bits), True).dropDuplicates(["k1", "k2"])
    work = saved(once.join(listed, ["k1", "k2"]), "open-texts")
    discard(listed, beside)
    counted = saved(strings(work, plan, None).groupBy("name").agg(F.sum("n").alias("n")).where("n > 1").select("name"), "strings")
    each = saved(strings(work, plan, Frequent(counted, counted.count(), most_bits)), "open-strings")
    discard(work, counted)
    same = saved(each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "same-strings")
    more = each.join(same, ["h1", "h2"], "left_semi").select("k1", "k2", F.col("x").alias("s"), F.col("x").alias("e"))
    # Distinct first: a text of many copies has the same zones in each.
    spans = sure.select("k1", "k2", "s", "e").unionByName(more).distinct()
    starts = saved(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("z")).select("k1", "k2", F.col("z.s").alias("zs"), F.col("z.e").alias("ze")), "repeated-starts")
    discard(found, each, same)
    return starts


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = 16, window: int = 128, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """Each document without the bytes that a string of ``length`` bytes covers which also starts anywhere else.

    A row per document: its id, kept (the remaining bytes of its UTF-8,
    concatenated; binary, as a cut may fall within a character), n_bytes,
    n_removed and n_spans (maximal removed runs), longs. Strings are judged on
    the input and never cross documents; those that overlap count, in one
    document too.

    Null and empty texts have no bytes. Very long texts are read whole. Rows
    that repeat an id, or whose id is null, are documents of their own. Texts
    all of one byte are cut everywhere, which is slow but right. An empty table
    gives no rows. Other columns are not read. ``gram``, ``window``, ``rounds``
    and ``most_bits`` change the work, never the result.
    """
    plan = Plan(length, gram, window, rounds)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    starts = repeated_starts(docs, plan, most_bits)
    keys = keys_of(starts, most_bits)
    kind = dict(docs.dtypes)["id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, runs = [], [], [], []
            for raw, s, e in zip(batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2), batch.column(3), strict=True):
                sizes.append(len(raw))
                if not s.is_valid or not len(s):
                    kept.append(raw)
                    gone.append(0)
                    runs.append(0)
                    continue
                step = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(step, s.values.to_numpy(), 1)
                np.add.at(step, e.values.to_numpy() + length, -1)
                over = np.cumsum(step[:-1]) > 0
                kept.append(np.frombuffer(raw, dtype=np.uint8)[~over].tobytes())
                gone.append(int(over.sum()))
                runs.append(int(over[0]) + int((over[1:] & ~over[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))], names=["id", "kept", "n_bytes", "n_removed", "n_spans"])

    touched = told_apart(docs, keys, True).join(starts, ["k1", "k2"], "left").select("id", "text", "zs", "ze")
    none = F.lit(0).cast("long")
    rest = told_apart(docs, keys, False).select("id", F.encode("text", "UTF-8").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"))
    done = touched.mapInArrow(cut, f"id {kind}, kept binary, n_bytes long, n_removed long, n_spans long").unionByName(rest)
    return done.withColumnRenamed("id", id_col)


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What 400-byte repeats leave of every document."""
    done = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 399]) AS h FROM d, unnest(range(1, octet_length(b) - 398)) AS t(i) WHERE octet_length(b) >= 400),
same AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 1 ELSE 0 END AS new FROM w SEMI JOIN same USING (h)),
runs AS (SELECT r, min(i) AS lo, max(i) + 399 AS hi FROM (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS run FROM starts) GROUP BY r, run),
gone AS (SELECT r, list(lo ORDER BY lo) AS lo, list(hi ORDER BY lo) AS hi, CAST(sum(hi - lo + 1) AS BIGINT) AS n FROM runs GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, CAST(coalesce(len(lo), 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(lo) + 1), lambda k: b[CASE WHEN k = 0 THEN 1 ELSE hi[k] + 1 END:CASE WHEN k = len(lo) THEN octet_length(b) ELSE lo[k + 1] - 1 END]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
