"""N-gram Jaccard join: connected groups of documents that share most word shingles.

Documents with equal sets of shingles are one class. A class's shingles are
put in one order for all, rare first (by counts over all documents, kept in a
table of bounded size, then by hash); two sets can only reach the similarity if
their prefixes in that order meet. Pairs that meet must pass the length and the
positional filter, and a suffix filter before the one full comparison.

Groups are wanted, not all pairs: first each member of a prefix bucket is held
against the bucket's first member, then, in buckets that still hold unlike
groups, against one member drawn per bucket, and what links is joined. After
that all pairs that meet and are still in unlike groups are formed, each where
it meets first (or near there: see ``first_meetings``), without those that were
formed before. No link between groups is lost, and a large group of near copies
costs some comparisons per member instead of one per pair.

A bucket's first member comes from a window where its shingle's counter is
low, which bounds the bucket; where it is high, from an aggregate that is
written and joined back: adaptive execution can split a shingle of a third of
all documents only in a join whose sides both come straight from a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.components import components
from quarrystone.llm.shared import BATCH, arrow_batches, saved
from quarrystone.llm.words import NONSPACE, Words, grams, mixed, pieces
from quarrystone.sources.tables import table

#: Counters of shingles, by the last bits of their hash: about one for each document, within these bounds.
COUNTERS = 1 << 18, 1 << 23
#: Shingles whose counter is over this are hot: their buckets have no bound.
HOT = 4096
#: Words of 64 bits of a set's parities.
PARITIES = 8
#: Bits of the filter that spares most texts outside all pairs a shuffle.
BITS = 1 << 23


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values in order."""
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct shingles (all its words where they are fewer)."""
    for _, _, raw, at in pieces(column):
        w = Words(raw, at, NONSPACE)
        h = w.hashes()
        whole = grams(h, size)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= size:
                yield distinct(whole[a : b - size + 1])
            else:
                yield grams(h[a:b], b - a) if b > a else np.zeros(0, dtype=np.uint64)


def shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The hashes of the shingles of all texts, in arrays of whole runs of texts and of single short ones."""
    for _, _, raw, at in pieces(column):
        w = Words(raw, at, NONSPACE)
        h = w.hashes()
        whole = grams(h, size)
        yield whole[w.room()[: len(whole)] >= size]
        n = np.diff(w.first)
        for i in np.flatnonzero((n > 0) & (n < size)).tolist():
            yield grams(h[w.first[i] : w.first[i + 1]], int(n[i]))


def counts_of(docs: DataFrame, size: int) -> np.ndarray:
    """How many shingles of all documents fall to each counter, repeated ones included: whole runs of texts are counted at once."""
    counters = 1 << min(max(docs.count().bit_length(), COUNTERS[0].bit_length() - 1), COUNTERS[1].bit_length() - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, dtype=np.int64)
        for batch in batches:
            for h in shingles(batch.column(0), size):
                np.add.at(total, (h & np.uint64(counters - 1)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["counter", "n"])

    rows = docs.select("text").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(counters, dtype=np.int64)
    total[rows.column("counter").to_numpy()] = rows.column("n").to_numpy()
    return total


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int, hot: int = HOT) -> DataFrame:
    """doc_id, n (of its set), k1 and k2 (its class), prefix (rare first), bits and parities (of all its shingles), cold (how many of the prefix are not hot)."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = shared.value
        for batch in batches:
            n, k1, k2, parts, bits, cold, odd = [], [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                k1.append(int(mixed(s).sum(dtype=np.uint64)))
                k2.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)))
                keep = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                rare = total[(s & np.uint64(len(total) - 1)).astype(np.int64)]
                order = np.lexsort((s, rare))[:keep]
                parts.append(s[order].view(np.int64))
                cold.append(int(np.searchsorted(rare[order], hot, side="right")))
                bits.append(bitmap(s))
                odd.append(parities(s))
            ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            long = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (n, k1, k2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *long, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(bits, pa.binary()), pa.array(cold, pa.int32()), pa.array(odd, pa.list_(pa.int64()))], names=["doc_id", "n", "k1", "k2", "prefix", "bits", "cold", "parities"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, n long, k1 long, k2 long, prefix array<long>, bits binary, cold int, parities array<long>")


def may_link(n: Column, at: Column, m: Column, bt: Column, percent: int) -> Column:
    """Length and positional filter of two sets that meet at these places of their orders.

    The place where a pair meets first passes if the pair has the similarity:
    before it nothing is shared, and after it no more than what is left.
    """
    left = F.least(n - at, m - bt)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * left >= percent * (n + m))


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each shingle's last bits; four or more times as many bits as shingles."""
    size = max(64, 1 << (4 * len(s) - 1).bit_length()) if len(s) else 64
    marks = np.zeros(size, dtype=bool)
    marks[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of the set's shingles falls to each of 64 * PARITIES bits."""
    odd = np.bincount((s >> np.uint64(20) & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def near_enough(a: Column, n: Column, b: Column, m: Column, percent: int) -> Column:
    """A filter that needs no shuffle: a shingle that only one of two sets has changes one parity.

    So the parities that differ are no more than the shingles that differ, of
    which similar sets have but a part of all.
    """
    differ = sum((F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITIES)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (n + m)


def may_reach(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """Suffix filter: shingles in common are bits in common, but for those that share a bit."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    double = min(n - int(np.bitwise_count(a).sum()), m - int(np.bitwise_count(b).sum()))
    return (100 + percent) * (int(np.bitwise_count(a & b).sum()) + double) >= percent * (n + m)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets have the Jaccard similarity."""
    shared = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * shared >= percent * (len(x) + len(y) - shared)


def suffix_filtered(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of ids, and ``may``: whether their bits leave the similarity possible."""
    side = sets.where("doc_id IS NOT NULL AND n > 0")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, m, b = (batch.column(i).to_pylist() for i in range(2, 6))
            may = pa.array([may_reach(a[i], n[i], b[i], m[i], percent) for i in range(len(n))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), may], names=["u", "v", "may"])

    left = pairs.join(side.select(F.col("doc_id").alias("u"), "n", F.col("bits").alias("a")), "u")
    both = left.join(side.select(F.col("doc_id").alias("v"), F.col("n").alias("m"), F.col("bits").alias("b")), "v")
    return both.select("u", "v", "n", "a", "m", "b").mapInArrow(rate, "u long, v long, may boolean").groupBy("u", "v").agg(F.max("may").alias("may"))


def linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of ids whose documents have the similarity. ``pairs`` is read twice: a saved table."""
    marks = (
        pairs.select(F.explode(F.array("u", "v")).alias("id"))
        .select(F.pmod(F.xxhash64("id"), F.lit(BITS)).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits"))
        .toArrow()
    )
    bits = np.zeros(BITS // 64, dtype=np.int64)
    bits[marks.column("word").to_numpy()] = marks.column("bits").to_numpy()
    shared = pairs.sparkSession.sparkContext.broadcast(np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value[batch.column(2).to_numpy()])).select([0, 1])

    marked = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("bit"))
    texts = marked.mapInArrow(named, "doc_id long, text string")
    left = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u")
    both = left.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in (2, 3):
                codes = batch.column(c).dictionary_encode()
                known = list(shingle_sets(codes.dictionary, size))
                sets.append([known[i] for i in codes.indices.to_pylist()])
            keep = [similar(x, y, percent) for x, y in zip(*sets, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return both.select("u", "v", "a", "b").mapInArrow(verify, "u long, v long")


def merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (u, root v) after more links: only roots that links join are looked at again."""
    roots = groups.select(F.col("u").alias("id"), F.col("v").alias("root"))
    ends = links
    for side in ("u", "v"):
        ends = ends.join(roots.withColumnRenamed("id", side), side, "left").withColumn(side, F.coalesce("root", side)).drop("root")
    changed = saved(components(ends.select("u", "v")), "changed-roots")
    moved = groups.join(changed.select(F.col("u").alias("v"), F.col("v").alias("to")), "v", "left").select("u", F.coalesce("to", "v").alias("v"))
    return saved(moved.unionByName(changed), "groups")


def unlike(met: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of buckets that hold unlike groups, with their group: h, id, part, n, at, root."""
    rows = met.select("h", "id", "part", "n", "at").join(groups.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = saved(rows, "labelled")
    several = saved(rows.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h"), "open-buckets")
    return saved(rows.join(several, "h", "left_semi"), "open")


def buckets(index: DataFrame) -> DataFrame:
    """Rows (h, id, part, n, at) of shingles that several rows hold, with the bucket's first row: cid, cn, cat."""
    head = F.struct("id", "n", "at")
    own = ["h", "id", "part", "n", "at"]
    by = Window.partitionBy("h").orderBy("id", "at")
    cold = index.where("NOT hot").select(*own, F.lag("id").over(by).alias("before"), F.lead("id").over(by).alias("after"), F.first(head).over(by).alias("c")).where("before IS NOT NULL OR after IS NOT NULL").drop("before", "after")
    hot = index.where("hot").select(*own)
    heads = saved(hot.groupBy("h").agg(F.min(head).alias("c"), F.count("*").alias("rows")).where("rows > 1").select("h", "c"), "heads")
    return cold.unionByName(hot.join(heads, "h")).select(*own, F.col("c.id").alias("cid"), F.col("c.n").alias("cn"), F.col("c.at").alias("cat"))


def drawn(rows: DataFrame, turn: int) -> DataFrame:
    """The rows, each with one row of its bucket as ``c``, drawn by hash; aggregated and written first, so that hot buckets are split."""
    one = rows.groupBy("h").agg(F.min(F.struct(F.xxhash64("id", "h", F.lit(turn)).alias("draw"), "id", "at", "n", "root")).alias("c"))
    return rows.join(saved(one, "drawn"), "h")


def first_meetings(now: DataFrame, parities: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of unlike groups that meet in a bucket and may link.

    Documents that share a passage meet in a bucket for each of its shingles.
    Where the shingles before, of those in open buckets, are equal too, the
    pair has met there already and is not formed again. The first meeting is
    never left out, and it is there that a pair that links passes the filter.
    ``parities``: id, part, parities.
    """
    before = F.lag("h").over(Window.partitionBy("id", "part").orderBy("at"))
    rows = saved(now.withColumn("prior", before).join(parities, ["id", "part"]).select("h", "id", "n", "at", "root", "prior", "parities"), "meeting")
    other = rows.select("h", *[F.col(c).alias(f"{c}_2") for c in rows.columns if c != "h"])
    new = F.coalesce(F.col("prior") != F.col("prior_2"), F.lit(True))
    may = may_link(F.col("n"), F.col("at"), F.col("n_2"), F.col("at_2"), percent) & near_enough(F.col("parities"), F.col("n"), F.col("parities_2"), F.col("n_2"), percent)
    meet = rows.join(other, "h").where((F.col("root") < F.col("root_2")) & new & may)
    return meet.select(F.col("id").alias("u"), F.col("id_2").alias("v"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Words are runs of all but ASCII white space, A-Z in lower case; two
    documents link when their sets of ``size``-word shingles have a Jaccard
    similarity of ``percent`` or more; component_id is the least id that links
    reach. A text of fewer words is one shingle; one without words, or null,
    links with nothing. Rows that repeat an id are one document. Rows with a
    null id keep a null component. An empty table gives no rows; other columns
    are not read, so their names cannot clash. ``hot`` decides by which of two
    ways a bucket's first member is found, never what is found.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    with arrow_batches(docs.sparkSession, BATCH):
        return _near_duplicates(docs, size, percent, hot)


def _near_duplicates(docs: DataFrame, size: int, percent: int, hot: int) -> DataFrame:
    """Of doc_id and text. All that runs in Python is run here; what is returned joins saved tables."""
    sets = saved(prefixes(docs, counts_of(docs, size), size, percent, hot), "prefixes")

    full = sets.where("doc_id IS NOT NULL AND n > 0")
    # Rows of one id with unlike texts are several classes of one document; ``part`` tells them apart.
    part = F.row_number().over(Window.partitionBy("rep").orderBy("n", "k1", "k2"))
    classes = saved(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")).withColumn("part", part), "classes")
    reps = full.join(classes.withColumn("doc_id", F.col("rep")), ["n", "k1", "k2", "doc_id"])
    index = reps.select(F.col("doc_id").alias("id"), "part", "n", "cold", F.posexplode("prefix").alias("at", "h"))
    met = saved(buckets(index.select("h", "id", "part", "n", "at", (F.col("at") >= F.col("cold")).alias("hot"))), "buckets")

    members = full.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).select("doc_id", "rep")
    same = members.groupBy("doc_id").agg(F.min("rep").alias("v"), F.collect_set("rep").alias("all")).where(F.size("all") > 1)
    edges = same.select(F.explode("all").alias("u"), "v")

    formed: list[DataFrame] = []

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs that were not formed before."""
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        for earlier in formed:
            pairs = pairs.join(earlier, ["u", "v"], "left_anti")
        formed.append(saved(suffix_filtered(pairs, sets, percent), "pairs"))
        return linked(formed[-1].where("may").select("u", "v"), docs, size, percent)

    def linkable() -> Column:
        return may_link(F.col("n"), F.col("at"), F.col("c.n"), F.col("c.at"), percent)

    star = met.withColumn("c", F.struct(F.col("cid").alias("id"), F.col("cn").alias("n"), F.col("cat").alias("at"))).where("id <> c.id")
    groups = components(edges.unionByName(verified(star.where(linkable()).select(F.col("id").alias("u"), F.col("c.id").alias("v")))))

    now = unlike(met, groups)
    if not now.isEmpty():
        star = drawn(now, 1).where("root <> c.root").where(linkable())
        links = saved(verified(star.select(F.col("id").alias("u"), F.col("c.id").alias("v"))), "links")
        if not links.isEmpty():
            groups = merged(groups, links)
            now = unlike(met, groups)
        # All pairs that meet and are still in unlike groups.
        own = reps.select(F.col("doc_id").alias("id"), "part", "parities")
        links = saved(verified(first_meetings(now, own, percent)), "links")
        if not links.isEmpty():
            groups = merged(groups, links)

    roots = saved(classes.join(groups.select(F.col("u").alias("rep"), F.col("v").alias("root")), "rep", "left").select("n", "k1", "k2", F.coalesce("root", "rep").alias("root")), "roots")
    rows = sets.select("doc_id", "n", "k1", "k2")
    return rows.join(roots, ["n", "k1", "k2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"),
    )


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ')) AS sh, md5_number_lower(array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ')) AS sh2
      FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.sh2 = b.sh2 AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n AS a ON a.doc_id = u JOIN n AS b ON b.doc_id = v WHERE 100 * n_both >= 75 * (a.n + b.n - n_both)),
r(u, v) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.v) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.u = d.doc_id GROUP BY d.doc_id
"""
