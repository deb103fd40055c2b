"""Line dedup: lines that many documents share stay in one document only.

DataFrame functions only. Lines are exploded as two 64-bit hashes of their
normalised form, distinct documents are counted per hash, and the positions to
drop go back to their document, which is cut and reassembled without the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.shared import saved
from quarrystone.sources.tables import table

#: ASCII white space, as [\x20\x09-\x0D].
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without outer ASCII white space, A-Z in lower case.

    lower() is the quick form for lines of ASCII alone, where both agree.
    """
    cut = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(cut) == F.char_length(cut), F.lower(cut)).otherwise(F.translate(cut, UPPER, LOWER))


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key has ``min_chars`` code points and is in ``min_docs`` documents.

    The largest id that holds a key keeps all its lines of it. Every row of
    ``docs`` comes back with its own columns, ``text_col`` holding the lines
    that stay, and ``n_lines`` and ``n_dropped`` (longs) after them.

    Null or empty text is one empty line, and stays (null becomes empty). Rows
    with a null id keep their lines and count nowhere. Rows that repeat an id
    count as one document; each is cut on its own. Own columns named
    ``n_lines`` or ``n_dropped`` give way. An empty table gives no rows. A text
    without any line to drop passes unchanged, byte for byte.
    """
    rows = docs.drop("n_lines", "n_dropped")
    kept = [F.col(f"`{c}`") for c in rows.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Rows of one id with unlike texts are told apart by the text's hash.
    rows = rows.select(*kept, F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__of"))
    split = F.split(text, "\n", -1)

    lines = saved(
        rows.where(F.col("__id").isNotNull())
        .select("__id", "__of", F.posexplode(split).alias("__at", "line"))
        .where(F.char_length("line") >= min_chars)
        .select("__id", "__of", "__at", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("__id", "__of", "__at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")),
        "lines",
    )
    # Written: adaptive execution splits hot keys only in a join of two tables that are both shuffled for it.
    common = saved(
        lines.groupBy("h1", "h2")
        .agg(F.countDistinct("__id").alias("n"), F.max("__id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper"),
        "common-lines",
    )
    drops = (
        lines.join(common, ["h1", "h2"])
        .where(F.col("__id") != F.col("keeper"))
        .groupBy("__id", "__of")
        .agg(F.collect_set("__at").alias("__drop"))
    )
    cut = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    # Split again after the join: the texts are shuffled once, not beside their lines.
    whole = rows.join(drops, ["__id", "__of"], "left").withColumn("__lines", split)
    new_text = F.when(F.col("__drop").isNull(), text).otherwise(F.array_join(F.transform(cut, lambda i: F.get("__lines", i)), "\n"))
    return whole.select(
        *[(new_text.alias(c) if c == text_col else F.col(f"`{c}`")) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and dropped lines of every document, and the digest of what stays."""
    done = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line,
             translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM docs, unnest(range(1, len(lines) + 1)) AS t(i)),
common AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20
           GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.*, common.key IS NOT NULL AND doc_id <> keeper AS gone FROM l LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
