"""Queries of Office files, of retrieval with metadata and of bucketed quantiles."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import functions as F

from quarrystone.functions import context as X
from quarrystone.functions import scoring as S
from quarrystone.operators import analytics as A
from quarrystone.operators import vector as V
from quarrystone.plans.catalogue import query
from quarrystone.plans.state_queries import ORACLES, QUERIES
from quarrystone.sources import docx as D
from quarrystone.sources.collection import scratch
from quarrystone.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]

SPACES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def office_files(docs):
    """Each document as a DOCX file: its lines as paragraphs, a table with a table in a cell, a formula, its text as the bytes of a picture shown twice."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def said(text: object) -> str:
            return f"<w:p><w:r><w:t>{escape(str(text))}</w:t></w:r></w:p>"

        def grid(*rows: list[str]) -> str:
            return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"

        shown = '<w:p><w:r><w:drawing><a:blip r:embed="p"/></w:drawing></w:r></w:p>'
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                power = f"<w:p><m:oMath><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>{row['n_chars']}</m:t></m:r></m:sup></m:sSup></m:oMath></w:p>"
                body = "".join(map(said, (row["text"] or "").split("\n"))) + grid([said(row["lang"] or ""), said(row["source"] or "") + grid([said(row["doc_id"]), shown])], [said(""), power]) + shown
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(D.MAIN, f"<w:document {SPACES}><w:body>{body}</w:body></w:document>")
                    z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="p" Target="media/p.png"/></Relationships>')
                    z.writestr("word/media/p.png", row["text"] or "")
                yield pa.RecordBatch.from_pylist([{"path": str(row["doc_id"]), "content": out.getvalue()}], pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return docs.mapInArrow(put, "path string, content binary")


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda t: trim(t)), lambda t: t <> '')
|| [concat_ws(' | ', nullif(lang, ''), concat_ws(chr(10), nullif(source, ''), doc_id || ' | [[asset:image-001]]')) || chr(10) || '${x}^{' || n_chars || '}$', '[[asset:image-001]]'] AS b FROM documents)
SELECT doc_id, CAST(i - 1 AS INT) AS block_no, b[i] AS text FROM l, unnest(range(1, len(b) + 1)) AS u(i)""")
def docx_blocks(spark, d):
    """All documents through DOCX files and back."""
    return D.blocks(D.parsed(office_files(table(spark, d, "documents")))).select(F.col("path").cast("long").alias("doc_id"), "block_no", "text")


@query("""SELECT doc_id, 'image-001' AS asset_id, 'image-001.png' AS filename, 'image/png' AS content_type, sha256(coalesce(text, '')) || '.png' AS stored, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents""")
def docx_assets(spark, d):
    """The manifest of the pictures of all these files, written to the shared folder."""
    found = D.write_assets(D.assets(D.parsed(office_files(table(spark, d, "documents")))), scratch(spark, "assets"))
    return found.select(F.col("path").cast("long").alias("doc_id"), "asset_id", "filename", "content_type", F.element_at(F.split("storage_path", "/"), -1).alias("stored"), "n_bytes")


LEVELS = ["basic", "standard", "advanced", "challenge"]


def _materials(spark, d):
    """Vectors as chunks, with the part of the same number as their metadata, if there is one."""
    size = F.col("p_size")
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("vec_id"),
        F.get(F.array(*map(F.lit, S.PREFERRED["concept"])), size % 5).alias("kind"),
        F.get(F.array(*map(F.lit, LEVELS)), size % 4).alias("level"),
        F.col("p_brand").alias("chapter"),
        F.col("p_type").alias("section"),
        F.split("p_name", " ").alias("tags"),
        F.col("p_name").alias("content"),
        (size % 5).alias("grade"),
        F.array(size % 3 + 1).alias("grades"),
        (size % 7).alias("number"),
        (size % 6).alias("first"),
        (size % 6 + size % 2).alias("last"),
        (size % 2 == 0).alias("pictures"),
    )
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v")).join(part, "vec_id", "left")


def _ranked(spark, d):
    """Every twentieth vector asks for what its own part is about, in one of three forms; the best four of sixteen by relevance, without disabled ones."""
    rows = _materials(spark, d)
    form = F.col("vec_id") % 60
    about = F.coalesce(
        F.when(form == 0, F.concat(F.lit("计算 "), "chapter", F.lit(" "), "content", F.lit(" 基础题"))).when(form == 20, F.concat(F.lit("分析 "), "content", F.lit(" 的应用"))).otherwise(F.concat(F.lit("What is the "), "section", F.lit(" "), "chapter", F.lit("? 提高"))),
        F.lit(""),
    )
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), about.alias("question"), (F.col("vec_id") % 3 + 1).cast("int").alias("own"))
    hits = V.nearest(asked, rows, 16).join(rows.drop("v"), "vec_id").join(asked.drop("q"), "query_id")
    gain = S.metadata_score(*map(F.col, ("question", "kind", "level", "chapter", "section", "tags"))) + S.grade_score(F.col("grades"), F.col("own"))
    return V.reranked(hits, gain, 4, F.col("vec_id") % 7 == 0)


RELEVANCE = r"""WITH m AS (SELECT vec_id, embedding AS v, ['knowledge_note','textbook','exercise','question_set','extension'][p_size % 5 + 1] AS kind, ['basic','standard','advanced','challenge'][p_size % 4 + 1] AS level,
p_brand AS chapter, p_type AS section, string_split(p_name, ' ') AS tags, p_name AS content, p_size FROM embeddings LEFT JOIN part ON p_partkey = vec_id),
q AS (SELECT vec_id AS query_id, v AS qv, coalesce(CASE vec_id % 60 WHEN 0 THEN '计算 ' || chapter || ' ' || content || ' 基础题' WHEN 20 THEN '分析 ' || content || ' 的应用' ELSE 'What is the ' || section || ' ' || chapter || '? 提高' END, '') AS question,
CASE WHEN chapter IS NULL THEN 'none' ELSE ['calculation','analysis','concept'][CAST(vec_id % 60 / 20 AS INT) + 1] END AS type, vec_id % 3 + 1 AS own FROM m WHERE vec_id % 20 = 0),
s AS (SELECT *, round(list_inner_product(CAST(qv AS DOUBLE[]), CAST(v AS DOUBLE[])), 6) AS score FROM q, m),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 16),
w AS (SELECT *, coalesce(kind, 'knowledge_note') AS k, CASE type WHEN 'calculation' THEN 'basic' WHEN 'concept' THEN 'advanced' END AS wanted, CASE type WHEN 'calculation' THEN ['exercise','question_set','knowledge_note','textbook','extension']
WHEN 'analysis' THEN ['extension','knowledge_note','textbook','exercise','question_set'] ELSE ['knowledge_note','textbook','exercise','question_set','extension'] END AS wish, lower(question) AS low, regexp_replace(lower(question), '[\s\-_.,:;()\[\]<>]', '', 'g') AS key FROM h),
g AS (SELECT *, round(greatest(0.04, 0.26 - 0.05 * (list_position(wish, k) - 1)) + CASE WHEN type = 'analysis' AND k = 'extension' THEN 0.18 ELSE 0 END
+ CASE WHEN k NOT IN ('exercise', 'question_set') OR wanted IS NULL THEN 0 WHEN wanted = level THEN 0.14 WHEN wanted = 'basic' AND level = 'standard' THEN 0.06 ELSE 0 END
+ CASE WHEN contains(low, lower(chapter)) OR contains(key, lower(chapter)) THEN 0.22 ELSE 0 END + CASE WHEN contains(low, lower(section)) OR contains(key, lower(section)) THEN 0.16 ELSE 0 END
+ 0.08 * coalesce(len(list_filter(list_distinct(tags), lambda t: contains(low, lower(t)))), 0), 6) AS meta, CASE WHEN p_size IS NULL THEN 0 WHEN p_size % 3 + 1 = own THEN 0.34 ELSE -0.1 END AS fit FROM w),
f AS (SELECT *, round(greatest(0, 1.1 - (1 - score)) + greatest(0, 0.12 - 0.01 * (rank - 1)) + meta + fit, 6) AS final FROM g),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank) AS INT) AS place FROM f),
r AS (SELECT * FROM p WHERE place <= 4 AND vec_id % 7 <> 0)
"""


@query(RELEVANCE + "SELECT query_id, vec_id, final, place FROM r")
def relevance_rerank(spark, d):
    """Hits ranked anew by kind, level, grade, chapter, section and tags that the question names."""
    return _ranked(spark, d).select("query_id", "vec_id", "final", "place")


@query(RELEVANCE + """, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS i FROM r)
SELECT query_id, string_agg('[' || concat_ws(' | ', '资料片段 ' || i, CASE k WHEN 'knowledge_note' THEN '知识讲义' WHEN 'textbook' THEN '教材' WHEN 'exercise' THEN '习题例题' WHEN 'question_set' THEN '题库试卷' ELSE '拓展资料' END,
CASE p_size % 5 WHEN 1 THEN '高一' WHEN 2 THEN '高二' WHEN 3 THEN '高三' WHEN 4 THEN '4年级' END, chapter, section, '难度:' || CASE level WHEN 'basic' THEN '基础' WHEN 'standard' THEN '标准' WHEN 'advanced' THEN '提高' ELSE '挑战' END,
CASE WHEN p_size % 7 > 0 THEN '第' || (p_size % 7) || '题' END, CASE WHEN p_size % 6 > 0 THEN 'p' || (p_size % 6) || CASE WHEN p_size % 2 = 1 THEN '-' || (p_size % 6 + 1) ELSE '' END END,
CASE WHEN p_size % 2 = 0 THEN '含图片' END) || '] ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY i) AS context FROM n GROUP BY 1""".replace("'难度:' || CASE level", "CASE WHEN level IS NOT NULL THEN '难度:' || CASE level").replace("ELSE '挑战' END,", "ELSE '挑战' END END,"))
def retrieved_context(spark, d):
    """The kept chunks of each question under their labels, numbered as they stand."""
    kept = _ranked(spark, d)
    n = F.row_number().over(V.Window.partitionBy("query_id").orderBy("place"))
    about = X.labels(*map(F.col, ("kind", "grade", "chapter", "section", "level", "number", "first", "last", "pictures")))
    pieces = kept.withColumn("n", n).select("query_id", "n", X.piece(F.col("n"), about, F.col("content")).alias("text"))
    return pieces.groupBy("query_id").agg(X.context(F.col("n"), F.col("text")).alias("context"))


BOUNDS = [0.5, 1.0, 2.5, 5.0, 7.5, 10.0, 25.0, 50.0, 75.0, 100.0]


@query(f"""WITH b AS (SELECT unnest([{", ".join(f"CAST({b} AS DOUBLE)" for b in BOUNDS)}, CAST('inf' AS DOUBLE)]) AS le), e AS (SELECT date_trunc('day', ts) AS day, event_type AS label, value FROM events WHERE value IS NOT NULL),
c AS (SELECT day, label, le, count_if(value <= le) AS n FROM e, b GROUP BY ALL), w AS (SELECT *, coalesce(lag(n) OVER o, 0) AS under, coalesce(lag(le) OVER o, 0) AS low, max(n) OVER (PARTITION BY day, label) AS whole FROM c WINDOW o AS (PARTITION BY day, label ORDER BY le)),
x AS (SELECT *, unnest([0.5, 0.95, 0.99]) AS q FROM w), y AS (SELECT day, label, q, CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (q * whole - under) / (n - under) END AS v FROM x WHERE n >= q * whole QUALIFY row_number() OVER (PARTITION BY day, label, q ORDER BY le) = 1)
SELECT day, label, round(max(v) FILTER (q = 0.5), 6) AS p50, round(max(v) FILTER (q = 0.95), 6) AS p95, round(max(v) FILTER (q = 0.99), 6) AS p99 FROM y GROUP BY 1, 2""")
def bucket_quantiles_daily(spark, d):
    """Quantiles from bucket counts of a day and label, with values beyond the last bound."""
    events = table(spark, d, "events").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.col("event_type").alias("label"), "value")
    keys = ["day", "label"]
    return A.bucket_quantiles(A.bucketed(events, BOUNDS, keys), keys, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
