"""Exact top-k search by inner product with ball trees.

Vectors are dealt into shards by hash. A task takes a shard's vectors, builds
one ball tree over them, and lets all queries stream past it in batches, branch
and bound, nodes in order of their upper bound: for a node with centre c and
radius r no vector scores over q.c + |q| r. Nodes that cannot reach a query's
kth score are skipped. That score is shared by all shards: each query gets it
once from a bounded sample of the vectors, then raises it over a first part of
the shards, and carries it to the others.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.llm.shared import saved
from quarrystone.sources.tables import table

NONE = np.iinfo(np.int64).min


class BallTree:
    """Nodes over rows of ``x``; children follow their parent, leaves hold up to ``leaf`` rows."""

    def __init__(self, x: np.ndarray, leaf: int = 128):
        self.order = np.arange(len(x))
        self.bounds: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centres, radii = [], []
        stack: list[tuple[int, int, int]] = [(0, len(x), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            own, rows = len(self.bounds), x[self.order[lo:hi]]
            centre = rows.mean(axis=0)
            away = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            self.bounds.append((lo, hi))
            self.children.append(None)
            centres.append(centre)
            radii.append(away.max())
            if parent >= 0:
                self.children[parent] = (*(self.children[parent] or ()), own)
            if hi - lo > leaf:
                far = rows[int(away.argmax())]
                along = rows @ (far - rows[int(((rows - far) ** 2).sum(axis=1).argmax())])
                half = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(along, half)]
                stack += [(lo, lo + half, own), (lo + half, hi, own)]
        self.centres, self.radii = np.array(centres), np.array(radii)


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; floats hold them exactly unless they are huge."""
    most = max(abs(float(a)) for m in (q, x) for a in (m.min(initial=0), m.max(initial=0)))
    if most * most * max(1, q.shape[1]) < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def search(tree: BallTree, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of each query's best ``k`` rows of ``x``, without its own id; absent ones score NONE.

    ``tree``: over ``x``. ``floor``: a score that each query's kth best over all
    shards is known to reach.
    """
    top = np.full((len(queries), k), NONE)
    who = np.full((len(queries), k), np.iinfo(np.int64).max)
    kth = floor.copy()
    real = queries.astype(np.float64)
    norm = np.sqrt((real**2).sum(axis=1))

    def bound(node: int, rows: np.ndarray) -> np.ndarray:
        value = real[rows] @ tree.centres[node] + norm[rows] * tree.radii[node]
        return value + 1e-9 * (np.abs(value) + norm[rows] * (1 + np.abs(tree.centres[node]).max(initial=0))) + 1e-6

    everyone = np.arange(len(queries))
    upper = bound(0, everyone)
    queue = [(-upper.max(initial=0), 0, everyone, upper)]
    while queue:
        _, node, rows, upper = heapq.heappop(queue)
        rows = rows[upper >= kth[rows]]
        if not len(rows):
            continue
        if tree.children[node]:
            for child in tree.children[node]:
                upper = bound(child, rows)
                heapq.heappush(queue, (-upper.max(), child, rows, upper))
            continue
        lo, hi = tree.bounds[node]
        at = tree.order[lo:hi]
        scores = exact_scores(queries[rows], x[at])
        scores[ids[at][None, :] == query_ids[rows][:, None]] = NONE
        better = (scores >= np.maximum(kth[rows], NONE + 1)[:, None]).any(axis=1)
        rows, scores = rows[better], scores[better]
        if len(rows):
            s = np.concatenate([top[rows], scores], axis=1)
            i = np.concatenate([who[rows], np.broadcast_to(ids[at], scores.shape)], axis=1)
            best = np.lexsort((i, -np.maximum(s, NONE + 1)), axis=1)[:, :k]
            top[rows], who[rows] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
            kth[rows] = np.maximum(kth[rows], top[rows, -1])
    top[top < floor[:, None]] = NONE  # cannot be among the best of all shards
    return top, who


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(column), -1)


def shard_search(spark: SparkSession, queries: DataFrame, vectors: DataFrame, shards: int, some: tuple[int, int], k: int) -> DataFrame:
    """query_id, mark, vec_id, score: each query's best of the shards ``some`` (from, to) that reach its floor.

    A shard's rows are sorted so that its vectors come first; queries follow
    and are searched batch by batch, so a task holds one shard and one batch.
    """
    lo, hi = some
    own = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).where(F.col("shard").between(lo, hi - 1))
    # Every query goes to every shard: queries are a stated set, searched in blocks.
    to_all = queries.withColumn("shard", F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))))
    none = F.lit(None).cast("long")
    both = own.select("dim", "shard", F.lit(0).alias("kind"), "vec_id", none.alias("mark"), none.alias("floor"), "v").unionByName(to_all.select("dim", "shard", F.lit(1).alias("kind"), "vec_id", "mark", "floor", "v"))
    dealt = both.repartition(hi - lo, "dim", "shard").sortWithinPartitions("dim", "shard", "kind")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, tree, ids, x = None, [], None, None, None
        for batch in batches:
            cell = np.stack([batch.column(i).to_numpy() for i in (0, 1, 2)]).astype(np.int64)
            cuts = np.flatnonzero((np.diff(cell) != 0).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                run, (dim, shard, kind) = batch.slice(a, b - a), cell[:, a].tolist()
                if at != (dim, shard):
                    at, parts, tree = (dim, shard), [], None
                if not kind:
                    parts.append((run.column(3).to_numpy(), matrix(run.column(6))))
                    continue
                if not parts:
                    continue
                if tree is None:
                    ids, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                    tree = BallTree(x.astype(np.float64))
                query_ids, mark, floor = (run.column(i).to_numpy() for i in (3, 4, 5))
                top, who = search(tree, query_ids, matrix(run.column(6)), floor, ids, x, k)
                row, col = np.nonzero(top > NONE)
                found = (query_ids[row], mark[row], who[row, col], top[row, col])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "mark", "vec_id", "score"])

    return dealt.mapInArrow(walk, "query_id long, mark long, vec_id long, score long")


def with_floor(queries: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """The queries and, as ``floor``, their kth score on the sample (the least number where it has fewer)."""
    by_dim = {d: (c.column("vec_id").to_numpy(), matrix(c.column("v").combine_chunks())) for d in set(sample.column("dim").to_pylist()) for c in [sample.filter(pa.compute.equal(sample.column("dim"), d))]}
    shared = queries.sparkSession.sparkContext.broadcast(by_dim)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, query_ids = batch.column(2).to_numpy(), batch.column(0).to_numpy()
            floor = np.full(batch.num_rows, NONE)
            for d, (ids, x) in shared.value.items():
                rows = np.flatnonzero(dim == d)
                if len(ids) > k and len(rows):
                    seen = exact_scores(matrix(batch.column(1).take(pa.array(rows))), x)
                    seen[ids[None, :] == query_ids[rows][:, None]] = NONE
                    floor[rows] = np.partition(seen, len(ids) - k, axis=1)[:, len(ids) - k]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor)], names=[*batch.schema.names, "floor"])

    return queries.select("vec_id", "v", "dim", "mark").mapInArrow(rate, "vec_id long, v array<long>, dim int, mark long, floor long")


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 20, shard_rows: int = 32_768, least_rows: int = 4_096, sample_rows: int = 2_048) -> DataFrame:
    """Each query's ``k`` best vectors by inner product: query_id, rank, vec_id, score.

    Both tables have vec_id (long) and v (array<long>). A query never gets rows
    of its own id; ties go to the smaller id. Queries meet vectors of their own
    length only. A row that repeats counts again among the candidates; a query
    that repeats is answered once. Rows with null ids or vectors take no part,
    and either table may be empty. A shard has about ``shard_rows`` vectors,
    or fewer, down to ``least_rows``, where cores would be idle; each query is
    copied once per shard, each vector never. ``sample_rows`` vectors at most
    set the first bounds; every row is searched.
    """
    spark = queries.sparkSession
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    queries = queries.where(usable).select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("mark")).distinct()
    vectors = vectors.where(usable).select("vec_id", "v", F.size("v").alias("dim"))
    rows = vectors.count()
    shards = max(1, -(-rows // shard_rows), min(-(-rows // least_rows), spark.sparkContext.defaultParallelism))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows).toArrow()
    queries = saved(with_floor(queries, sample, k), "queries")

    first = -(-shards // 8)
    found = saved(shard_search(spark, queries, vectors, shards, (0, first), k), "first-shards")
    if first < shards:
        kth = found.groupBy("query_id", "mark").agg(F.array_sort(F.collect_list(F.col("score") * -1)).alias("s")).where(F.size("s") >= k)
        kth = kth.select(F.col("query_id").alias("vec_id"), "mark", (F.get("s", F.lit(k - 1)) * -1).alias("kth"))
        raised = queries.join(kth, ["vec_id", "mark"], "left").withColumn("floor", F.greatest("floor", "kth")).drop("kth")
        found = found.unionByName(shard_search(spark, raised, vectors, shards, (first, shards), k))
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vector: Column, scale: int = 64) -> Column:
    """Whole components floor(scale * x); null where the vector or a component is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def op7_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("v"))
    return top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
