"""Queries of versioned collections and guarded streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import formulas as M
from quarrystone.operators import ingest as I
from quarrystone.operators.vector import nearest
from quarrystone.plans.catalogue import query
from quarrystone.plans.layout_queries import ORACLES, QUERIES
from quarrystone.sources.collection import Collection, scratch
from quarrystone.sources.tables import table
from quarrystone.streaming import folds as L

__all__ = ["ORACLES", "QUERIES"]


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_reverse(embedding) ELSE embedding END AS v FROM embeddings WHERE vec_id % 7 <> 0 OR vec_id % 35 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.v AS DOUBLE[])), 6) AS score FROM embeddings AS q, v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def vector_collection_nearest(spark, d):
    """All vectors come in, those of ids divisible by seven go, a fifth comes anew reversed (some of them after they went), a base is written between; then the nearest of what is live."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    held = Collection(spark, scratch(spark, "vectors"), ["vec_id"], "vec_id long, v array<float>")
    held.upsert(rows)
    held.delete(rows.where("vec_id % 7 = 0"))
    held.compact()
    held.upsert(rows.where("vec_id % 5 = 0").withColumn("v", F.reverse("v")))
    return nearest(rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), held.live(), 5)


def by_lines(docs):
    """Each line of a document as a chunk; a text of null has none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))


@query("""WITH t AS (SELECT doc_id, max(text) AS text FROM documents GROUP BY doc_id), n AS (SELECT doc_id, CASE WHEN doc_id % 15 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'new' || chr(10) || text ELSE text END AS text FROM t),
l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM n)
SELECT doc_id, CAST(i - 1 AS INT) AS chunk_index, ls[i] AS content FROM l, unnest(range(1, len(ls) + 1)) AS u(i)""")
def chunks_resliced(spark, d):
    """All documents come in by lines; a fifth was stored anew and is sliced again, a third of it without text; ids that are not stored change nothing."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    held = Collection(spark, scratch(spark, "chunks"), ["doc_id"], I.CHUNKS)
    I.ingested(held, docs, by_lines)
    stored = docs.withColumn("text", F.when(F.col("doc_id") % 15 != 0, F.concat(F.lit("new\n"), "text")))
    chosen = docs.where("doc_id % 5 = 0").select("doc_id").unionByName(docs.select((-1 - F.col("doc_id")).alias("doc_id")))
    I.resliced(held, chosen, stored, by_lines)
    return held.live()


GIVEN = "(de|en|an|in) [a-z]{3,5}[ .]"


@query(f"""WITH t AS (SELECT conv_id || '-' || turn AS key, text, CAST(ceil(length(text) / 40.0) AS INT) AS n FROM conversations WHERE text <> ''),
p AS (SELECT key, text, i - 1 AS seq, substr(text, 40 * (i - 1) + 1, 40) AS piece, regexp_matches(substr(text, 1, 40 * i), '{GIVEN}') AS hit FROM t, unnest(range(1, n + 1)) AS u(i)),
f AS (SELECT *, min(CASE WHEN hit THEN seq END) OVER (PARTITION BY key) AS over FROM p)
SELECT key, seq, CASE WHEN seq = over THEN CASE WHEN seq = 0 OR substr(text, 40 * seq, 1) IN ('。','！','？','!','?',';','；',chr(10),'.') THEN '' ELSE chr(10) || chr(10) END || 'Try it yourself.' ELSE piece END AS shown
FROM f WHERE over IS NULL OR seq <= over""")
def guarded_streams(spark, d):
    """Turns as snapshots that grow by 40 characters, to what each adds; it is shown until the text so far gives too much away."""
    turns = table(spark, d, "conversations")
    n = F.greatest(F.ceil(F.char_length("text") / 40), F.lit(1)).cast("int")
    grown = turns.select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text", F.explode(F.sequence(F.lit(1), n)).alias("i")).select("key", (F.col("i") - 1).cast("long").alias("seq"), F.substr("text", F.lit(1), F.col("i") * 40).alias("piece"))
    added = L.fold_table(grown, "key", ["seq"], L.deltas()).withColumnRenamed("delta", "segment")
    return L.fold_table(added, "key", ["seq"], L.guarded(GIVEN, "Try it yourself."))


@query(r"""SELECT p_partkey, '$\mathrm{kg}_{' || p_size || '}^{-' || p_size || '}$ and $\frac{1.' || p_size || '}{' || p_brand || '}$' AS line,
CASE WHEN p_size % 3 = 0 THEN [p_name, p_type, '1', CAST(p_size AS VARCHAR)] WHEN p_size % 3 = 1 THEN [p_name, '2.5', CAST(p_size AS VARCHAR)] ELSE ['1', '2', '3 ' || p_size] END AS cells FROM part""")
def formulas_spaced(spark, d):
    """Spaced formulas in a line, and rows of three kinds."""
    size = F.col("p_size").cast("string")
    wide = F.array_join(F.split(size, ""), " ")
    line = F.concat(F.lit(r"$\mathrm { { k }  g } _ { "), wide, F.lit(" } ^ { - "), wide, F.lit(r" }$  and $ \frac { 1 . "), wide, F.lit(" } { "), F.col("p_brand"), F.lit(" }$"))
    kind = F.col("p_size") % 3
    cells = F.when(kind == 0, F.array(F.col("p_name"), F.col("p_type"), F.concat(F.lit("1 "), size))).when(kind == 1, F.array(F.col("p_name"), F.concat(F.lit("2.5 "), size), F.lit(""))).otherwise(F.array(F.lit("1"), F.lit("2"), F.concat(F.lit("3 "), size)))
    return table(spark, d, "part").select("p_partkey", M.fragments_spaced(line).alias("line"), M.sparse_row(cells).alias("cells"))
