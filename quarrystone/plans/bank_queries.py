"""Queries of question banks, filters, states, prompts and assets."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import answers as N
from quarrystone.functions import policy as P
from quarrystone.functions import scoring as G
from quarrystone.functions import sections as S
from quarrystone.operators import bank as B
from quarrystone.operators import catalog as C
from quarrystone.plans.document_queries import ORACLES, QUERIES, query
from quarrystone.sources.tables import table

__all__ = ["ORACLES", "QUERIES"]


# ---------------------------------------------------------------- filters


@query("""SELECT p_partkey, string_split(lower(p_type), ' ') AS tags FROM part WHERE len(list_filter(string_split(p_type, ' '), lambda t: contains(lower(trim(t)), 'eco'))) > 0""")
def any_tag_contains(spark, d):
    """B04."""
    rows = table(spark, d, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("tags"))
    return C.tagged(rows, "ECO")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def member_list(spark, d):
    """B05."""
    wanted = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return B.among(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", wanted)


def _people(spark, d):
    grade = F.when(F.col("c_nationkey") % 4 > 0, F.col("c_nationkey") % 4)
    left = F.when(F.col("c_custkey") % 3 == 0, F.to_timestamp(F.lit("2024-07-01")))
    return table(spark, d, "customer").select("c_custkey", "c_name", grade.alias("grade"), left.alias("graduated_at"))


@query("""
WITH p AS (SELECT c_custkey, c_name, CASE WHEN c_nationkey % 4 > 0 THEN c_nationkey % 4 END AS grade, c_custkey % 3 = 0 AS gone FROM customer)
SELECT '2' AS filter, c_custkey FROM p WHERE grade = 2 AND NOT gone AND contains(c_name, '1')
UNION ALL SELECT 'unset', c_custkey FROM p WHERE grade IS NULL AND NOT gone AND contains(c_name, '1')
UNION ALL SELECT 'graduated', c_custkey FROM p WHERE gone AND contains(c_name, '1')
UNION ALL SELECT '', c_custkey FROM p WHERE contains(c_name, '1')""")
def grade_filters(spark, d):
    """B08 B09."""
    people = _people(spark, d)
    parts = [B.containing(B.of_grade(people, w), "c_name", " 1 ").select(F.lit(w).alias("filter"), "c_custkey") for w in ("2", "unset", "graduated", "")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(CAST(p_size AS VARCHAR)), 'ring')""")
def question_keyword(spark, d):
    """Texts and numbers of questions."""
    rows = table(spark, d, "part").withColumn("number", F.col("p_size").cast("string"))
    return C.keyword(rows, " RING ".strip(), ["number", "p_name"]).select("p_partkey", "p_name")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_newest(spark, d):
    """Conditions hold before the limit."""
    rows = table(spark, d, "events").select("event_id", "ts", "event_type")
    return B.newest_where(rows, {"event_type": "error", "user_id": None}, [F.desc("ts"), F.desc("event_id")], 200)


@query("""SELECT p_partkey, p_name AS question, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS answer, coalesce(nullif(p_brand, 'Brand#1'), 'none') AS brand FROM part""")
def solutions_masked(spark, d):
    """B30."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("question"), F.col("p_type").alias("answer"), F.coalesce(F.nullif("p_brand", F.lit("Brand#1")), F.lit("none")).alias("brand"))
    return B.masked(rows, ["answer"], F.when(F.col("p_partkey") % 2 == 0, "staff").otherwise("student"))


@query("""
WITH t AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1)
SELECT t.conv_id, t.turn, list(c.role || ':' || md5(c.text) ORDER BY c.turn, c.role, c.text) FILTER (WHERE c.turn < t.turn) AS history FROM t JOIN conversations AS c USING (conv_id) GROUP BY ALL""")
def history_before_turn(spark, d):
    """What was said before the last turn."""
    rows = table(spark, d, "conversations")
    done = B.history_before(rows, rows.groupBy("conv_id").agg(F.max("turn").alias("turn")))
    said = F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["text"])))
    return done.select("conv_id", "turn", F.when(F.size("history") > 0, said).alias("history"))


# ---------------------------------------------------------------- nested reads and summaries


@query("""
WITH o AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS ids, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(ids, []) AS order_ids, CAST(coalesce(len(ids), 0) AS BIGINT) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def nested_children(spark, d):
    """C02."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_totalprice")
    done = B.with_children(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderdate", "o_orderkey"], "orders")
    return done.select("c_custkey", F.col("orders.o_orderkey").alias("order_ids"), F.size("orders").cast("long").alias("n"))


@query("""
WITH e AS (SELECT p_partkey AS place, CASE WHEN p_partkey % 3 = 0 THEN 'chapter' ELSE 'section' END AS kind, p_name AS chapter, p_size AS number, CASE WHEN p_partkey % 5 = 0 THEN 'decimal' ELSE 'word' END AS style FROM part),
x AS (SELECT e.*, EXISTS (SELECT 1 FROM e AS s WHERE s.style = 'decimal' AND s.number = e.number AND s.chapter = e.chapter) AS dec FROM e WHERE kind = 'chapter'),
t AS (SELECT s_suppkey AS title_id, s_nationkey AS number, s_suppkey % 2 = 0 AS decimal FROM supplier)
SELECT title_id, coalesce(CASE WHEN decimal THEN (SELECT arg_min(chapter, place) FROM x WHERE x.number = t.number AND dec) END,
                          (SELECT arg_min(chapter, place) FROM x WHERE x.number = t.number)) AS chapter
FROM t WHERE number IN (SELECT number FROM x)""")
def chapter_by_number(spark, d):
    """C17."""
    entries = table(spark, d, "part").select(
        F.col("p_partkey").alias("place"),
        F.when(F.col("p_partkey") % 3 == 0, "chapter").otherwise("section").alias("kind"),
        F.col("p_name").alias("chapter"),
        F.col("p_size").alias("number"),
        F.when(F.col("p_partkey") % 5 == 0, "decimal").otherwise("word").alias("style"),
    )
    titles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("title_id"), F.col("s_nationkey").alias("number"), (F.col("s_suppkey") % 2 == 0).alias("decimal"))
    return B.by_chapter_number(titles, entries)


@query("""
SELECT p_brand AS doc_id, count(*) AS chunks, count(p_name) AS questions, count(CASE WHEN p_size > 10 THEN p_type END) AS answers, count(CASE WHEN p_size > 40 THEN p_type END) AS explanations,
       count(DISTINCT string_split(p_type, ' ')[1]) AS chapters, count(DISTINCT p_type) AS sections, CAST(sum(p_size % 3) AS BIGINT) AS images, bool_or(p_partkey % 7 = 0) AS grouped FROM part GROUP BY 1""")
def ingest_summaries(spark, d):
    """D11."""
    size = F.col("p_size")
    chunks = table(spark, d, "part").select(
        F.col("p_brand").alias("doc_id"),
        F.col("p_name").alias("question"),
        F.when(size > 10, F.col("p_type")).otherwise(" ").alias("answer"),
        F.when(size > 40, F.col("p_type")).alias("explanation"),
        F.split("p_type", " ")[0].alias("chapter"),
        F.col("p_type").alias("section"),
        (size % 3).alias("images"),
        F.when(F.col("p_partkey") % 7 == 0, "1-3").otherwise("4").alias("number"),
    )
    return B.ingest_summary(chunks, "doc_id")


@query("SELECT l_suppkey, min(l_quantity) AS first_page, max(l_quantity) AS last_page, list_sort(list(DISTINCT l_quantity)) AS pages FROM lineitem GROUP BY 1")
def page_sets(spark, d):
    """D32."""
    return B.page_spans(table(spark, d, "lineitem"), "l_suppkey", "l_quantity")


@query("""
WITH a AS (SELECT o_custkey, list(DISTINCT o_orderstatus) AS asked, list(DISTINCT CASE WHEN o_totalprice > 100000 THEN o_orderstatus ELSE left(o_orderpriority, 1) END) AS answered FROM orders GROUP BY 1)
SELECT o_custkey, len(answered) >= 2 AND len(list_filter(answered, lambda x: NOT list_contains(asked, x))) = 0 AS fits FROM a""")
def answer_banks_fit(spark, d):
    """G05."""
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("asked"), F.collect_set(F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).otherwise(F.substring("o_orderpriority", 1, 1))).alias("answered"))
    return sets.select("o_custkey", B.bank_answers_fit(F.col("asked"), F.col("answered")).alias("fits"))


# ---------------------------------------------------------------- texts


def _papers(spark, d):
    """Parts as lines of exam papers, of several kinds."""
    kinds = [
        F.concat(F.lit("第"), F.col("p_size"), F.lit("题 "), F.col("p_name")),
        F.concat(F.col("p_size"), F.lit(". "), F.col("p_name")),
        F.concat(F.col("p_size"), F.lit(".5 kg of "), F.col("p_name")),
        F.lit("A、C"),
        F.concat(F.lit("已知"), F.col("p_type"), F.lit("，求"), F.col("p_name")),
        F.lit("学校：____ 姓名：____ 班级：____"),
        F.concat(F.lit("答案 "), F.col("p_type")),
        F.concat(F.col("p_brand"), F.lit(" | "), F.col("p_type"), F.lit(" |  "), F.col("p_name")),
        F.lit("ab~12"),
        F.lit("B\n对\n3.5"),
    ]
    text = F.coalesce(*[F.when(F.col("p_partkey") % len(kinds) == i, k) for i, k in enumerate(kinds)])
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("number"), text.alias("text"))


PAPERS = """p AS (SELECT p_partkey, p_partkey % 10 AS k, CAST(p_size AS VARCHAR) AS number, p_name, p_type, p_brand,
  CASE p_partkey % 10 WHEN 0 THEN '第' || p_size || '题 ' || p_name WHEN 1 THEN p_size || '. ' || p_name WHEN 2 THEN p_size || '.5 kg of ' || p_name WHEN 3 THEN 'A、C'
  WHEN 4 THEN '已知' || p_type || '，求' || p_name WHEN 5 THEN '学校：____ 姓名：____ 班级：____' WHEN 6 THEN '答案 ' || p_type
  WHEN 7 THEN p_brand || ' | ' || p_type || ' |  ' || p_name WHEN 8 THEN 'ab~12' ELSE 'B' || chr(10) || '对' || chr(10) || '3.5' END AS text FROM part)"""


@query(f"WITH {PAPERS} SELECT p_partkey, CASE WHEN k IN (0, 1) THEN p_name ELSE text END AS text FROM p")
def number_prefixes(spark, d):
    """H30."""
    return _papers(spark, d).select("p_partkey", N.without_number(F.col("text"), F.col("number")).alias("text"))


@query(f"""
WITH {PAPERS}, l AS (SELECT p_partkey, unnest(string_split(text, chr(10))) AS t FROM p)
SELECT p_partkey, bool_and(NOT contains(t, '题') AND (contains(t, '答案') OR regexp_matches(t, '^([A-H]([、,，/ ]*[A-H])*|对|[0-9.]+)$') OR (length(t) <= 80 AND NOT regexp_matches(t, '如图|求|已知|下列|判断|计算|实验|分析|选择')))) AS answer,
       bool_or(regexp_matches(t, '学校[:：].*姓名[:：].*班级[:：]')) AS cover, bool_or(length(t) BETWEEN 1 AND 10 AND contains(t, '~')) AS noise FROM l GROUP BY 1""")
def line_kinds(spark, d):
    """H34 B26 B21."""
    text = F.col("text")
    return _papers(spark, d).select("p_partkey", N.looks_like_answer(text).alias("answer"), N.looks_like_cover(text).alias("cover"), F.exists(F.split(text, "\n"), N.noisy_line).alias("noise"))


@query(f"WITH {PAPERS} SELECT p_partkey, [p_brand, p_type, p_name] AS cells FROM p WHERE k = 7")
def table_lines(spark, d):
    """Lines that stand for rows of tables."""
    return _papers(spark, d).select("p_partkey", N.table_cells(F.col("text")).alias("cells")).where("cells IS NOT NULL")


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_filter(list_transform(string_split(regexp_replace(text || chr(13) || chr(10) || 'a~b' || chr(10) || chr(10) || chr(10) || chr(10) || chr(9) || ' end' || chr(7), '\r\n?', chr(10), 'g'), chr(10)),
  lambda x: trim(regexp_replace(regexp_replace(x, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]+', ' ', 'g'))), lambda x: NOT ((length(x) BETWEEN 1 AND 10 AND contains(x, '~')) OR (length(x) BETWEEN 1 AND 8 AND regexp_matches(x, '[A-Za-z]{2,}.*[^\w\s\x{4e00}-\x{9fff}\p{L}\p{N}]')))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS digest FROM documents""")
def page_texts(spark, d):
    """H16."""
    tail = F.lit("\r\na~b\n\n\n\n\t end\x07")
    return table(spark, d, "documents").select("doc_id", F.md5(N.page_text(F.concat("text", tail))).alias("digest"))


@query("""
WITH n AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.md' WHEN 2 THEN '.tex' WHEN 3 THEN '.exe' ELSE '' END AS filename, CASE p_partkey % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN ' Application/octet-stream' END AS told, p_partkey % 5 AS k, p_partkey % 3 AS t FROM part)
SELECT p_partkey, CASE WHEN k IN (1, 2) AND t = 0 THEN 'text/plain' WHEN t > 0 THEN CASE k WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' WHEN 2 THEN 'text/x-tex' END END AS media_type FROM n""")
def media_types(spark, d):
    """H40 A12."""
    key = F.col("p_partkey")
    end = F.coalesce(*[F.when(key % 5 == i, e) for i, e in enumerate((".PDF", ".md", ".tex", ".exe"))], F.lit(""))
    told = F.when(key % 3 == 0, "text/plain").when(key % 3 == 1, " Application/octet-stream")
    return table(spark, d, "part").select("p_partkey", N.media_type(F.concat("p_name", end), told).alias("media_type"))


@query("SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS local, CAST(ts AS DATE) AS utc_day, event_id % 2 = 0 AND ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-15' AS over FROM events")
def local_times(spark, d):
    """An odd event's record never expires."""
    ts = F.col("ts").cast("timestamp")
    expires = F.when(F.col("event_id") % 2 == 0, ts + F.expr("INTERVAL 1 DAY"))
    return table(spark, d, "events").select("event_id", N.beijing_iso(ts).alias("local"), F.to_date(ts).alias("utc_day"), N.expired(expires, F.to_timestamp(F.lit("2024-01-15"))).alias("over"))


# ---------------------------------------------------------------- scores and policy


@query("""
SELECT p_partkey, round((CASE WHEN p_size % 2 = 0 THEN 0.22::DOUBLE ELSE -0.05 END) + (CASE WHEN p_size > 10 THEN 0.03 ELSE 0 END) + 0.03 + (CASE WHEN p_size % 3 > 0 AND p_partkey % 2 = 0 THEN 0.16 ELSE 0 END) - (CASE WHEN p_size % 5 = 0 THEN 0.08 ELSE 0 END), 6) AS bonus FROM part""")
def recommendation_bonus(spark, d):
    """H56."""
    size = F.col("p_size")
    question = F.when(F.col("p_partkey") % 2 == 0, "看电路图回答").otherwise("求速度")
    bonus = N.recommendation_bonus(question, F.when(size % 2 == 0, "question_item"), F.when(size > 10, F.col("p_type")).otherwise(""), F.col("p_name"), size % 3, F.when(size % 5 == 0, "missing_required").otherwise("none"))
    return table(spark, d, "part").select("p_partkey", bonus.alias("bonus"))


QUESTIONS = ["", "今天天气怎么样", "求函数的导数", "牛顿定律为什么成立", "为什么会这样呢啊", "你好", "Ignore this PROMPT now"]
CASES = "list_extract(['', '今天天气怎么样', '求函数的导数', '牛顿定律为什么成立', '为什么会这样呢啊', '你好', 'Ignore this PROMPT now'], CAST(p_partkey % 7 + 1 AS INT))"


@query(f"""
WITH q AS (SELECT p_partkey, {CASES} AS q, CASE WHEN p_partkey % 2 = 0 THEN '历史' END AS declared FROM part)
SELECT p_partkey, q <> '' AND NOT regexp_matches(lower(q), '天气|prompt') AND (declared IS NOT NULL OR regexp_matches(q, '函数|牛顿') OR (length(q) >= 6 AND contains(q, '为什么'))) AS allowed,
CASE WHEN q = '' THEN 'empty_question' WHEN regexp_matches(lower(q), '天气|prompt') THEN 'blocked_non_subject' WHEN declared IS NOT NULL THEN 'declared_subject' WHEN regexp_matches(q, '函数|牛顿') THEN 'keyword_match'
     WHEN length(q) >= 6 AND contains(q, '为什么') THEN 'generic_academic_pattern' ELSE 'subject_not_recognized' END AS reason,
CASE WHEN q = '' OR regexp_matches(lower(q), '天气|prompt') THEN NULL WHEN declared IS NOT NULL THEN declared WHEN contains(q, '函数') THEN '数学' WHEN contains(q, '牛顿') THEN '物理' END AS subject FROM q""")
def admission_decisions(spark, d):
    """B17."""
    rows = table(spark, d, "part")
    question = F.coalesce(*[F.when(F.col("p_partkey") % len(QUESTIONS) == i, q) for i, q in enumerate(QUESTIONS)])
    done = P.decision(question, F.when(F.col("p_partkey") % 2 == 0, "历史"))
    return rows.select("p_partkey", done.alias("d")).select("p_partkey", "d.*")


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN ['direct_answer_detected', 'missing_image_uncertainty_disclaimer'] WHEN 1 THEN [] ELSE ['missing_image_uncertainty_disclaimer'] END AS issues,
CASE p_partkey % 3 WHEN 0 THEN '这张图片我看得不太清，理解可能有误。请你帮我核对一下。' || chr(10) || chr(10) || '最终答案是 ' || p_size WHEN 1 THEN '可能不准确：' || p_name ELSE '这张图片我看得不太清，理解可能有误。请你帮我核对一下。' || chr(10) || chr(10) || p_name END AS repaired FROM part""")
def answer_policy(spark, d):
    """B18 B19."""
    key = F.col("p_partkey")
    answer = F.when(key % 3 == 0, F.concat(F.lit("最终答案是 "), "p_size")).when(key % 3 == 1, F.concat(F.lit("可能不准确："), "p_name")).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", P.answer_issues(answer, image=True).alias("issues"), P.with_image_note(answer).alias("repaired"))


@query(r"""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0::DOUBLE WHEN p_size % 4 = 1 THEN 0.34 WHEN p_size % 4 = 2 THEN 0.46 ELSE -0.1 END AS grade,
       len(list_filter(string_split(left(p_name, 12), ''), lambda c: c <> '' AND contains(p_type, c))) / 20 AS overlap, p_size || ' 平方 点乘 ' || p_partkey AS words FROM part""")
def relevance_parts(spark, d):
    """H07 H09 H55."""
    size = F.col("p_size")
    grades = F.when(size % 4 == 0, F.array().cast("array<int>")).when(size % 4 == 1, F.array(F.lit(2))).when(size % 4 == 2, F.array(F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1)))
    formula = F.concat(F.lit("$"), size, F.lit(r"^{2} \cdot "), "p_partkey", F.lit("$"))
    return table(spark, d, "part").select("p_partkey", G.grade_score(grades, F.lit(2)).alias("grade"), G.overlap_bonus(F.col("p_name"), F.col("p_type")).alias("overlap"), G.formula_words(formula).alias("words"))


# ---------------------------------------------------------------- states


@query("SELECT p_partkey, p_name, CASE WHEN p_size > 40 THEN TIMESTAMP '2024-01-01' WHEN p_size < 5 THEN NULL WHEN p_size % 2 = 0 THEN TIMESTAMP '2023-01-01' END AS deleted_at FROM part")
def soft_states(spark, d):
    """Large parts are deleted, small ones restored."""
    part = table(spark, d, "part")
    rows = part.select("p_partkey", "p_name", F.when(F.col("p_size") % 2 == 0, F.to_timestamp(F.lit("2023-01-01"))).alias("deleted_at"))
    gone = B.marked(rows, part.where("p_size > 40"), "p_partkey", "deleted_at", F.to_timestamp(F.lit("2024-01-01")))
    return B.marked(gone, part.where("p_size < 5"), "p_partkey", "deleted_at", F.lit(None).cast("timestamp"))


@query("SELECT p_partkey, coalesce(nullif(p_size, 7), 1) AS p_size, 'note' AS kind, CAST(p_retailprice AS BIGINT) % 3 AS version FROM part")
def schema_patched(spark, d):
    """M11."""
    rows = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"), "p_retailprice")
    return B.patched(rows, {"p_size": ("int", F.lit(1)), "kind": ("string", F.lit("note")), "version": ("long", F.rint("p_retailprice").cast("long") % 3)}).drop("p_retailprice")


@query("""SELECT p_partkey, '{"billing_mode":"' || p_type || '","user_daily_request_limit":' || p_size || ',"count_cache_hit":' || CASE WHEN p_size > 10 THEN 'true' ELSE 'false' END || '}' AS snapshot FROM part""")
def policy_snapshots(spark, d):
    """H67."""
    kept = F.struct(F.col("p_type").alias("billing_mode"), F.col("p_size").alias("user_daily_request_limit"), (F.col("p_size") > 10).alias("count_cache_hit"))
    return table(spark, d, "part").select("p_partkey", F.to_json(kept).alias("snapshot"))


# ---------------------------------------------------------------- assets and prompts


@query("""SELECT p_partkey, 'see 【附图1：' || p_type || '】 and 【附图】 and 【附图' || CASE WHEN p_size > 10 THEN '2' ELSE '1：' || p_type END || '】 end' AS text, CASE WHEN p_size > 10 THEN ['a' || p_partkey, 'b'] ELSE ['a' || p_partkey] END AS assets FROM part""")
def asset_labels(spark, d):
    """H65 E09."""
    own, other = F.concat(F.lit("a"), "p_partkey"), F.when(F.col("p_size") > 10, "b").otherwise(F.concat(F.lit("a"), "p_partkey"))
    part = table(spark, d, "part")
    texts = part.select("p_partkey", F.concat(F.lit("see [[asset:"), own, F.lit("]] and [[asset:gone]] and [[asset:"), other, F.lit("]] end")).alias("text"))
    assets = part.select("p_partkey", own.alias("asset_id"), F.col("p_type").alias("title")).unionByName(part.select("p_partkey", F.lit("b").alias("asset_id"), F.lit(None).cast("string").alias("title")))
    return B.labelled_assets(texts, assets, "p_partkey")


@query("SELECT o_custkey, list(DISTINCT o_orderstatus ORDER BY o_orderstatus) AS ids FROM orders GROUP BY 1")
def assets_deduplicated(spark, d):
    """H64."""
    refs = F.array_sort(F.collect_list(F.struct(F.col("o_orderstatus").alias("asset_id"), F.lit("f").alias("filename"), F.lit(None).cast("string").alias("url"))))
    return table(spark, d, "orders").groupBy("o_custkey").agg(refs.alias("refs")).select("o_custkey", B.distinct_assets(F.col("refs"))["asset_id"].alias("ids"))


@query("SELECT p_partkey, p_name || chr(10) || 'equation_inline' || chr(10) || 'x_' || p_size || chr(10) || p_type AS text, ['title_content', 'list_items'] AS roles FROM part")
def content_flattened(spark, d):
    """H63."""
    tree = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("text").alias("type"), F.col("p_name").alias("content"))).alias("title_content"),
            F.array(F.struct(F.lit("equation_inline").alias("type"), F.concat(F.lit("x_"), "p_size").alias("content")), F.struct(F.lit("text").alias("type"), F.col("p_type").alias("content"))).alias("list_items"),
            F.lit(" ").alias("page_number_content"),
        )
    )
    return B.flattened(table(spark, d, "part").select("p_partkey", tree.alias("tree")), "p_partkey", "tree")


@query("""
WITH t AS (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1),
h AS (SELECT t.conv_id, c.role, c.turn, row_number() OVER (PARTITION BY t.conv_id ORDER BY c.turn DESC, c.role DESC, c.text DESC) AS back FROM t JOIN conversations AS c ON c.conv_id = t.conv_id AND c.turn < t.turn)
SELECT t.conv_id AS turn_id, ['system'] || coalesce((SELECT list(role ORDER BY back DESC) FROM h WHERE h.conv_id = t.conv_id AND back <= 6), []) || ['user'] AS roles,
       'Guide.' || chr(10) || '学科：s' || t.conv_id % 3 || CASE WHEN t.conv_id % 2 = 0 THEN chr(10) || '知识库参考：c' ELSE '' END AS system FROM t""")
def prompt_messages(spark, d):
    """J09 E12."""
    rows = table(spark, d, "conversations")
    turns = B.history_before(rows, rows.groupBy("conv_id").agg(F.max("turn").alias("turn")))
    asked = turns.select(F.col("conv_id").alias("turn_id"), F.concat(F.lit("s"), F.col("conv_id") % 3).alias("subject"), F.lit(None).cast("string").alias("stage"), F.when(F.col("conv_id") % 2 == 0, "c").alias("context"), "history", F.lit("?").alias("question"))
    return B.prompts(asked, "Guide.").select("turn_id", F.col("messages.role").alias("roles"), F.col("messages")[0]["text"].alias("system"))


@query("""SELECT conv_id, turn, length(regexp_replace(lower(text), '[^\\w\\x{4e00}-\\x{9fff}\\p{L}\\p{N}]', '', 'g')) >= 6 AND turn = 0 AND conv_id % 2 = 0 AS cacheable FROM conversations""")
def cacheable_questions(spark, d):
    """B28."""
    history = F.when(F.col("turn") > 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "conversations").select("conv_id", "turn", N.cacheable(F.col("text"), history, F.col("conv_id") % 2 == 1).alias("cacheable"))


# ---------------------------------------------------------------- sections and headings


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN NULL ELSE p_brand || CASE WHEN p_size % 4 = 0 THEN chr(10) || p_name ELSE '' END END AS answer,
       CASE WHEN p_size % 4 = 1 THEN NULL ELSE p_type END AS explanation FROM part""")
def bank_sections(spark, d):
    """An answer of two lines, none, and explanations under a head, at a mark, behind white space."""
    size, line = F.col("p_size") % 4, lambda *parts: F.concat(*[F.lit(x) if "p_" not in x else F.col(x) for x in parts])
    text = (
        F.when(size == 0, line("【答案】", "p_brand", "\n", "p_name", "\n难度：易\n解析：", "p_type"))
        .when(size == 1, line("p_brand", "\n知识点：力"))
        .when(size == 2, F.when(F.col("p_partkey") % 2 == 0, line("答案: ", "p_brand", "【解析】：", "p_type")).otherwise(line("p_brand", "  点拨 ", "p_type")))
        .otherwise(line("【详解】", "p_type"))
    )
    done = S.answer_sections(text)
    return table(spark, d, "part").select("p_partkey", done["answer"].alias("answer"), done["explanation"].alias("explanation"))


@query("""
SELECT p_partkey, unnest(['1', '12', '3']) AS number, unnest([p_brand || '；', CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_name END, NULL]) AS entry FROM part""")
def numbered_answers(spark, d):
    """A number's last entry counts."""
    text = F.concat(F.lit("1. "), "p_brand", F.lit("；第12题 "), "p_type", F.when(F.col("p_size") % 2 == 1, F.concat(F.lit("\n12、"), "p_name")).otherwise(F.lit("")))
    entries = S.numbered_entries(text, F.array(F.lit("1"), F.lit("12"), F.lit("3")))
    return table(spark, d, "part").select("p_partkey", F.inline(entries))


@query("""SELECT p_partkey, p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || chr(10) || '（1）' || p_size AS shown,
CASE WHEN p_size % 2 = 0 THEN '（1）对' || chr(10) || '（2）错' ELSE '对 ' || p_size END AS judged FROM part""")
def readable_questions(spark, d):
    """H31 H32."""
    text = F.concat("p_name", F.lit("\tA. "), "p_brand", F.lit(" B. "), "p_type", F.lit("\n（1）"), F.col("p_size").cast("string"))
    text = F.replace(text, F.lit(" B. "), F.lit("B. "))
    answer = F.concat(F.lit("对 "), F.when(F.col("p_size") % 2 == 0, "错").otherwise(F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", S.readable(text).alias("shown"), S.judgement_lines(F.lit("判断（1）甲（2）乙"), answer).alias("judged"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) || p_type WHEN p_size % 3 = 1 THEN p_name || chr(10) || '  2. ' || p_type ELSE p_name END AS text FROM part""")
def formula_marks_dropped(spark, d):
    """Before a formula, before a question, before a picture's path."""
    size = F.col("p_size") % 3
    behind = F.when(size == 0, F.concat(F.lit("  "), "p_type")).when(size == 1, F.concat(F.lit("  2. "), "p_type")).otherwise(F.lit(" images/a1.PNG"))
    return table(spark, d, "part").select("p_partkey", S.without_formula_marks(F.concat("p_name", F.lit("\n Equation_Inline\n"), behind)).alias("text"))


@query("""
WITH e AS (SELECT n_regionkey AS doc_id, lower(n_name) AS key, arg_min(n_name, n_nationkey) AS written FROM nation GROUP BY 1, 2)
SELECT s_suppkey AS heading_id, CASE WHEN s_suppkey % 2 = 0 THEN n_name ELSE '〔' || lower(n_name) || '〕' END AS title, s_suppkey % 2 = 0 AS normalized FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN e ON doc_id = n_regionkey AND key = lower(n_name)""")
def heading_titles(spark, d):
    """Titles in lower case with a bracket are found under the key; those in unknown brackets are not."""
    nation = table(spark, d, "nation")
    entries = nation.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("title"))
    low = F.lower("n_name")
    title = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("（"), low, F.lit("）"))).otherwise(F.concat(F.lit("〔"), low, F.lit("〕")))
    headings = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("heading_id"), F.col("n_regionkey").alias("doc_id"), title.alias("title"))
    return B.catalogue_titles(headings, entries)


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate FROM lineitem GROUP BY 1, 2),
c AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, CASE WHEN l_linenumber % 4 = 2 THEN '第' || l_linenumber || '章 ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS ch, CASE WHEN l_linenumber % 4 IN (1, 3) THEN '1.' || l_linenumber || ' ' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS se FROM l),
g AS (SELECT *, count(ch) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM c)
SELECT doc_id, i AS chunk_index, coalesce(last_value(ch IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i), 'own chapter') AS chapter,
       coalesce(last_value(se IGNORE NULLS) OVER (PARTITION BY doc_id, no ORDER BY i), CASE WHEN no = 0 THEN 'own section' END) AS section, '{"tags":"t' || i || '"}' AS metadata FROM g""")
def metadata_reread(spark, d):
    """Chapters at every fourth line, sections between them, sentences that are neither."""
    n, mode = F.col("l_linenumber"), F.col("l_shipdate").cast("date").cast("string")
    first = F.when(n % 4 == 2, F.concat(F.lit("第"), n, F.lit("章 "), mode)).when(n % 4 == 0, F.lit("1. 下列哪个正确")).otherwise(F.concat(F.lit("1."), n, F.lit(" "), mode))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"))
    chunks = lines.select(
        F.col("l_orderkey").alias("doc_id"),
        n.alias("chunk_index"),
        F.concat(F.lit("一句话。\n\n"), first, F.lit("\n正文")).alias("text"),
        F.lit("textbook").alias("kind"),
        F.concat(F.lit('{"tags":"t'), n, F.lit('","filename":"f"}')).alias("metadata"),
        F.lit("own chapter").alias("doc_chapter"),
        F.lit("own section").alias("doc_section"),
    )
    return B.reread_metadata(chunks, ["tags", "difficulty"])


@query("""SELECT p_partkey, '{"number":"' || p_size || '","chapter":"' || p_brand || '"}' AS metadata FROM part""")
def metadata_edited(spark, d):
    """A new chapter replaces the old one and what was derived from it."""
    old = F.concat(F.lit('{"number":"'), F.col("p_size"), F.lit('","chapter":"old","chapter_key":"old","structure_path":"old"}'))
    return table(spark, d, "part").select("p_partkey", B.edited_metadata(old, {"chapter": F.col("p_brand")}, ["chapter_key", "section_key", "structure_path"]).alias("metadata"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def documents_of_classes(spark, d):
    """C24."""
    report = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "reslice").otherwise("keep").alias("class"))
    return B.classed(table(spark, d, "documents").select("doc_id", "source"), report, ["reslice", "unread"])
