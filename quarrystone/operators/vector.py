"""Embeddings, exact nearest neighbours, re-ranking and tiered recommendation."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _signs(pair: int) -> str:
    """The characters of a pair's number."""
    return chr(pair >> 32) + chr(pair & 0xFFFFFFFF) if pair >= 0 else chr(pair & 0xFFFFFFFF)


def hashed_counts(docs: DataFrame, buckets: int = 128) -> DataFrame:
    """Counts of hashed character pairs per document: doc_id, bucket, n.

    A text is counted where it is read; no more than its buckets are shuffled,
    to add up rows that repeat an id. A pair is hashed once per task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1), strict=True):
                text = (value.as_py() or "").replace("\n", " ")
                signs = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
                # A pair of code points is one number; a text of one sign counts that sign alone.
                pairs, n = np.unique(signs[:-1] << 32 | signs[1:] if len(signs) > 1 else signs | -1 << 53, return_counts=True)
                for pair in pairs.tolist():
                    if pair not in known:
                        known[pair] = int.from_bytes(hashlib.sha256(_signs(pair).encode()).digest()[:4], "big") % buckets
                found = np.bincount([known[p] for p in pairs.tolist()], n, buckets).astype(np.int64) if len(pairs) else np.zeros(buckets, np.int64)
                if len(known) > 1 << 20:
                    known.clear()
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(at), batch.column(0).type), pa.array(at, pa.int32()), pa.array(found[at])], names=["doc_id", "bucket", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, bucket int, n long")
    return counted.groupBy("doc_id", "bucket").agg(F.sum("n").alias("n"))


def hashed_embedding(docs: DataFrame, buckets: int = 128) -> DataFrame:
    """Unit vectors of the counts, sparse: doc_id, bucket, weight."""
    counts = hashed_counts(docs, buckets)
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("doc_id")))
    return counts.select("doc_id", "bucket", F.round(F.col("n") / norm, 6).alias("weight"))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, by: Sequence[str] = (), own: Sequence[str] = (), shard_rows: int = 131_072, block_rows: int = 32_768) -> DataFrame:
    """The k vectors with the greatest inner product (to six places) for each query of a stated set.

    ``queries``: query_id, q. ``vectors``: vec_id, v, and the columns ``by``,
    each combination of which is ranked on its own. ``own`` are columns of both
    in which a query and its vectors are equal (null meets nothing): cells are
    made within their values, so no other vector is scored. Shards of vectors
    meet blocks of queries, a task scores one such cell as a product of
    matrices, some queries at a time, and only its best k go on to the ranking.
    A query travels once to each shard and a vector once to each block, so both
    are large; with little data there are as many shards as cores. Ties go to
    the smaller id. Columns: query_id, vec_id, ``by``, ``own``, score, rank.
    """
    rows, cores = vectors.count(), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, -(-rows // shard_rows), min(cores, rows // 4_096))
    blocks = max(1, -(-queries.count() // block_rows))
    cells = ["shard", "block", *own]
    # A cell's numbers are ints on both sides: an int and a long of one value hash to different partitions, where the sides would not meet.
    left = queries.select("query_id", "q", *own).withColumns({"block": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    right = vectors.select("vec_id", "v", *dict.fromkeys([*by, *own])).withColumns({"shard": F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    for c in own:
        left = left.withColumn(c, F.col(c).cast(dict(right.dtypes)[c]))
    left, right = left.dropna(subset=list(own)) if own else left, right.dropna(subset=list(own)) if own else right
    kinds = dict(vectors.dtypes)
    kept = list(dict.fromkeys([*by, *own]))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        return np.stack([np.asarray(x, dtype=np.float64) for x in column.to_pylist()])

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("query_id", "vec_id", "score", *kept)}
        if a.num_rows and b.num_rows:
            asked, held = matrix(a.column("q")), matrix(b.column("v"))
            all_ids, names = b.column("vec_id").to_numpy(), a.column("query_id").to_numpy()
            groups = b.select(kept).to_pandas().groupby(kept, dropna=False).indices.items() if kept else [((), np.arange(b.num_rows))]
            for key, part in groups:
                ids, those = all_ids[part], held[part].T
                step = max(1, (1 << 22) // len(part))
                for at in range(0, len(asked), step):
                    scores = np.round(asked[at : at + step] @ those, 6)
                    best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                    out["query_id"] += np.repeat(names[at : at + step], best.shape[1]).tolist()
                    out["vec_id"] += ids[best].ravel().tolist()
                    out["score"] += np.take_along_axis(scores, best, 1).ravel().tolist()
                    for c, value in zip(kept, key if isinstance(key, tuple) else (key,), strict=True):
                        out[c] += [value] * best.size
        types = [pa.int64(), pa.int64(), pa.float64(), *(b.schema.field(c).type for c in kept)]
        return pa.table({c: pa.array(v, t, from_pandas=True) for (c, v), t in zip(out.items(), types, strict=True)})

    schema = "query_id long, vec_id long, score double" + "".join(f", {c} {kinds[c]}" for c in kept)
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(cell, schema)
    best = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def decayed(distance: Column, rank: Column) -> Column:
    """max(0, 1.1 - distance) and a bonus that falls with the rank from 0."""
    return F.greatest(F.lit(0.0), 1.1 - F.coalesce(distance, F.lit(0.8))) + F.greatest(F.lit(0.0), 0.12 - 0.01 * rank)


def reranked(hits: DataFrame, bonus: Column, k: int, disabled: Column) -> DataFrame:
    """Re-scored hits: the best k first, disabled ones dropped after that (so there may be fewer)."""
    scored = hits.withColumn("final", F.round(decayed(1 - F.col("score"), F.col("rank") - 1) + bonus, 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("final"), "rank")
    return scored.withColumn("place", F.row_number().over(best)).where((F.col("place") <= k) & ~disabled)


def recommended(queries: DataFrame, vectors: DataFrame, preferred: Column, group: str, tiers: tuple[tuple[float, float], tuple[float, float]], k: int) -> DataFrame:
    """Two tiers: preferred rows near their best, then others of groups without a preferred one.

    A tier is its floor and how far below its own best a row may be; the best
    ``k`` of each tier are enough to tell.
    """
    rows = vectors.withColumn("tier", F.when(preferred, 1).otherwise(2))
    has = rows.where("tier = 1").select(group).distinct()
    rows = rows.where("tier = 1").unionByName(rows.where("tier = 2").join(has, group, "left_anti").select(rows.columns))
    found = nearest(queries, rows, k, by=["tier"])
    best = F.max("score").over(Window.partitionBy("query_id", "tier"))
    near = F.lit(False)
    for tier, (floor, delta) in enumerate(tiers, 1):
        near = near | ((F.col("tier") == tier) & (F.col("score") >= floor) & (F.col("score") >= F.col("best") - delta))
    order = Window.partitionBy("query_id").orderBy("tier", F.desc("score"), "vec_id")
    return found.withColumn("best", best).where(near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("best", "rank")
