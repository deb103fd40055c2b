"""Registry of the engine's own queries and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import text as T
from quarrystone.operators import analytics as A
from quarrystone.operators import catalog as C
from quarrystone.operators import sequence as S
from quarrystone.operators import vector as V
from quarrystone.plans import standins as R
from quarrystone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its own name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


# ---------------------------------------------------------------- analytics


@query("""
SELECT event_type AS subject, count(*) AS conversations, round(count_if(event_type = 'purchase') / count(*), 4) AS resolved_rate,
       count(DISTINCT user_id) AS people FROM events GROUP BY 1""")
def overview_by_subject(spark, d):
    """D05 F01."""
    return A.overview(R.activity(spark, d))


@query("""
WITH p AS (SELECT user_id, count(*) AS conversations, round(count_if(event_type = 'purchase') / count(*), 4) AS resolved_rate,
                  round(count_if(event_type = 'error') / count(*), 4) AS fallback_rate, max(ts) AS last_seen FROM events GROUP BY 1),
m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2)
SELECT user_id AS person_id, conversations, resolved_rate, fallback_rate, last_seen, event_type AS focus, c_name AS name
FROM p JOIN m USING (user_id) JOIN customer ON c_custkey = user_id WHERE r = 1
ORDER BY conversations DESC, resolved_rate, name LIMIT 12""")
def portraits_topn(spark, d):
    """D09 D07 C01 F01."""
    return A.portraits(R.activity(spark, d), R.people(spark, d))


@query("""
WITH p AS (SELECT user_id, count(*) AS conversations, round(count_if(event_type = 'purchase') / count(*), 4) AS resolved_rate,
                  round(count_if(event_type = 'error') / count(*), 4) AS fallback_rate, max(ts) AS last_seen FROM events GROUP BY 1),
m AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2)
SELECT user_id AS person_id, conversations, resolved_rate, fallback_rate, last_seen, event_type AS focus FROM p JOIN m USING (user_id) WHERE r = 1""")
def student_profile(spark, d):
    """D07."""
    return A.profiles(R.activity(spark, d))


@query("""
WITH p AS (SELECT user_id, count(*) AS n, count_if(event_type = 'purchase') AS ok FROM events GROUP BY 1)
SELECT coalesce(n_name, 'unassigned') AS "group", count(*) AS people, CAST(coalesce(sum(n), 0) AS BIGINT) AS conversations,
       CASE WHEN coalesce(sum(n), 0) = 0 THEN 0.0 ELSE round(sum(ok) / sum(n), 4) END AS resolved_rate, max(c_nationkey) AS last_group_id
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN p ON user_id = c_custkey GROUP BY 1""")
def classroom_breakdown(spark, d):
    """D08 C03."""
    return A.classrooms(R.activity(spark, d), R.people(spark, d), R.groups(spark, d))


@query("""SELECT c_custkey AS person_id, c_name AS name, c_nationkey AS group_id FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)""")
def scope_teacher_semi(spark, d):
    """Regions as teachers."""
    duties = table(spark, d, "nation").select(F.col("n_regionkey").alias("teacher_id"), F.col("n_nationkey").alias("group_id"))
    return A.scoped(R.people(spark, d), "teacher", 1, duties)


TREND = """
WITH spine AS (SELECT unnest(generate_series(date_trunc('{unit}', DATE '2024-01-03'), date_trunc('{unit}', DATE '2024-02-05'), INTERVAL 1 {unit}))::DATE AS period),
e AS (SELECT date_trunc('{unit}', ts)::DATE AS period, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-02-05'),
names AS (SELECT unnest(['total', 'view', 'click']) AS series)
SELECT strftime(spine.period, '{form}') AS period, series, count(e.period) AS n
FROM spine CROSS JOIN names LEFT JOIN e ON e.period = spine.period AND (series = 'total' OR series = event_type) GROUP BY 1, 2"""


def _trend(unit):
    return lambda spark, d: A.trend(R.activity(spark, d), unit, "2024-02-05", "2024-01-03", ["view", "click", "view"])


for _unit, _form in (("day", "%Y-%m-%d"), ("week", "%Y-%m-%d"), ("month", "%Y-%m")):
    QUERIES[f"trend_{_unit}_zero_filled"] = _trend(_unit)  # D06 H41 H42 B11
    ORACLES[f"trend_{_unit}_zero_filled"] = TREND.format(unit=_unit, form=_form)


@query("""SELECT l_returnflag AS model, l_linestatus AS billing, count(*) AS requests, CAST(sum(l_quantity) AS BIGINT) AS tokens
FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-13' AND l_shipdate < TIMESTAMP '1996-03-14' GROUP BY 1, 2""")
def usage_rollup_day(spark, d):
    """D02 B10."""
    return A.usage_rollup(R.usage(spark, d), "1996-03-13")


@query("""SELECT count(*) AS total, CAST(count_if(o_orderstatus IN ('O', 'P')) AS BIGINT) AS active, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS completed,
CAST(count_if(o_orderstatus = 'X') AS BIGINT) AS failed, CAST(count_if(o_orderstatus NOT IN ('O', 'P', 'F', 'X') OR o_orderstatus IS NULL) AS BIGINT) AS other FROM orders""")
def status_summary(spark, d):
    """D01."""
    return A.status_summary(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), ["O", "P"], ["F"], ["X"])


@query("""WITH t AS (SELECT conv_id, count_if(role = 'user') AS turns FROM conversations GROUP BY 1)
SELECT count(*) AS conversations, CAST(sum(turns) AS BIGINT) AS turns, round(sum(turns) / count(*), 2) AS mean_turns FROM t""")
def mean_turns(spark, d):
    """User messages per conversation."""
    return A.mean_turns(table(spark, d, "conversations"))


@query("""SELECT event_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM events GROUP BY 1""")
def share_of_total(spark, d):
    """D28."""
    return A.shares(A.group_counts(table(spark, d, "events"), "event_type"), "event_type", "n")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS label, count(*) AS n, round(count(*) / 21600, 6) AS per_second,
round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1, 2""")
def histogram_p95(spark, d):
    """D21 D22."""
    return A.histogram(table(spark, d, "events").withColumnRenamed("event_type", "label"), "6 hours")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS increase FROM events GROUP BY 1, 2""")
def counter_increase_hourly(spark, d):
    """D22."""
    return A.counter_increase(table(spark, d, "events"), ["event_type"])


@query("""SELECT event_id, user_id, round(avg(CAST(event_type = 'view' AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS hit_rate FROM events""")
def cache_hit_rate_running(spark, d):
    """D23 K11."""
    return A.running_ratio(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view").select("event_id", "user_id", "hit_rate")


@query("""SELECT event_type, CAST(event_type = 'purchase' AS BOOLEAN) AS resolved, count(*) AS n FROM events GROUP BY 1, 2""")
def counters_by_label(spark, d):
    """D33 D16."""
    return A.group_counts(R.activity(spark, d).withColumnRenamed("subject", "event_type"), "event_type", "resolved")


@query("""SELECT event_type AS subject, (event_type = 'purchase') AS resolved, count(*) AS n, CAST(grouping_id(event_type, (event_type = 'purchase')) AS BIGINT) AS level
FROM events GROUP BY CUBE (event_type, (event_type = 'purchase'))""")
def cube_overview(spark, d):
    """Extension: cube."""
    return A.cube_overview(R.activity(spark, d))


# ---------------------------------------------------------------- catalogue


@query("""SELECT o_orderkey, o_orderdate, o_orderstatus, total FROM (SELECT *, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O')
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40""")
def paginated_orders(spark, d):
    """F04 D03 B01."""
    rows = C.matching(table(spark, d, "orders"), {"o_orderstatus": "O", "o_orderpriority": None})
    return C.page_with_total(rows.select("o_orderkey", "o_orderdate", "o_orderstatus"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3, 20)


@query("""SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_size = 10 AND (lower(p_name) LIKE '%brand%' OR lower(p_brand) LIKE '%brand%' OR lower(p_type) LIKE '%brand%')""")
def multi_filter_keyword(spark, d):
    """B01 B02 B03."""
    return C.keyword(C.matching(table(spark, d, "part"), {"p_size": 10}), "BRAND", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name", "p_brand", "p_type")


@query("""SELECT doc_id, lang, source FROM documents LEFT JOIN (SELECT DISTINCT doc_id, toxic FROM labels) USING (doc_id) WHERE toxic IS NULL""")
def soft_delete_tristate(spark, d):
    """B06 B07."""
    joined = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels").select("doc_id", "toxic").distinct(), "doc_id", "left")
    return C.tri_state(joined, "toxic", False).select("doc_id", "lang", "source")


@query("""SELECT c_custkey, c_name, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS active FROM customer""")
def active_flag_semi(spark, d):
    """C06 C21."""
    open_orders = table(spark, d, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return C.with_flag(table(spark, d, "customer"), "c_custkey", open_orders, "active").select("c_custkey", "c_name", "active")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_child(spark, d):
    """C20 E19."""
    return C.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("SELECT doc_id, source FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphans_anti(spark, d):
    """C08 C09 G04."""
    return C.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "source")


@query("""SELECT c_custkey, coalesce(CAST(o_orderkey AS VARCHAR), '') AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, coalesce(o_orderpriority, '') AS o_orderpriority
FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey""")
def archive_flat_left(spark, d):
    """C12 A17."""
    orders = table(spark, d, "orders").where("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return C.flat_archive(table(spark, d, "customer").select("c_custkey"), orders, "c_custkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@query("""WITH s AS (SELECT conv_id, count(*) AS chunks, CAST(count_if(role = 'user') AS BIGINT) AS questions, CAST(count_if(role = 'assistant') AS BIGINT) AS answers,
CAST(count_if(role = 'system') AS BIGINT) AS explanations FROM conversations GROUP BY 1)
SELECT *, CASE WHEN questions = answers AND questions = explanations THEN 'aligned' WHEN answers < questions AND explanations = questions THEN 'missing_answer_only'
WHEN explanations < questions AND answers = questions THEN 'missing_explanation_only' ELSE 'mixed' END AS mismatch FROM s""")
def chunk_summary_mismatch(spark, d):
    """D10 D31."""
    return C.chunk_summary(table(spark, d, "conversations"), "conv_id", F.col("role"))


@query("""SELECT lower(p_type) AS low, min(p_type) AS value, lower(p_type) LIKE 'st%' AS starts FROM (SELECT trim(p_type) AS p_type FROM part) WHERE lower(p_type) LIKE '%st%'
GROUP BY 1 ORDER BY starts DESC, low LIMIT 20""".replace("SELECT lower(p_type) AS low, min", "SELECT value, starts FROM (SELECT lower(p_type) AS low, min").replace("LIMIT 20", "LIMIT 20)"))
def suggest_prefix_rank(spark, d):
    """F08 D34."""
    return C.suggestions(table(spark, d, "part"), "p_type", "ST")


@query("""SELECT term, count(*) AS sources FROM (SELECT DISTINCT trim(p_brand) AS term, 0 FROM part UNION ALL SELECT DISTINCT trim(p_type), 1 FROM part UNION ALL SELECT DISTINCT trim(n_name), 2 FROM nation) WHERE term <> '' GROUP BY 1""")
def vocab_union_distinct(spark, d):
    """D17 G07."""
    part = table(spark, d, "part")
    return C.vocabulary((part, "p_brand"), (part, "p_type"), (table(spark, d, "nation"), "n_name"))


@query("SELECT p_brand, list_sort(list(DISTINCT p_type)) AS sections FROM part GROUP BY 1")
def structure_catalogue(spark, d):
    """D18."""
    return C.structure(table(spark, d, "part"), "p_brand", "p_type")


@query("""WITH k AS (SELECT doc_id, source, substr(sha1(text), 1, 12) AS key FROM documents)
SELECT doc_id, source, key, copies FROM (SELECT *, count(*) OVER (PARTITION BY source, key) AS copies FROM k) WHERE copies > 1""")
def dup_audit(spark, d):
    """D14 H11."""
    docs = table(spark, d, "documents")
    return C.duplicates(docs.select("doc_id", "source", "text"), "source", T.fingerprint(F.col("text"))).select("doc_id", "source", "key", "copies")


@query("""WITH k AS (SELECT source, sha1(text) AS key FROM documents), c AS (SELECT source, count(*) OVER (PARTITION BY source, key) AS copies FROM k),
s AS (SELECT source, count(*) AS n, CAST(count_if(copies > 1) AS BIGINT) AS duplicated FROM c GROUP BY 1)
SELECT source, n, duplicated, CASE WHEN duplicated = 0 THEN 'clean' WHEN duplicated / n < 0.1 THEN 'some' ELSE 'heavy' END AS class FROM s""")
def source_classes(spark, d):
    """D15 D16."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return C.grouped_classes(C.duplicates(docs, "source", T.fingerprint(F.col("text"))), "source", A.group_counts(docs, "source"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'z') AS has_z,
CASE WHEN list_contains(json_keys(props), 'z') THEN json_extract_string(props, '$.z') ELSE event_type END AS z FROM events""")
def json_key_presence(spark, d):
    """H58 B15."""
    props = F.col("props")
    return table(spark, d, "events").select("event_id", F.get_json_object(props, "$.k").alias("k"), C.json_has(props, "k").alias("has_k"), C.json_has(props, "z").alias("has_z"), C.effective(props, "z", F.col("event_type")).alias("z"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(p_brand) ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part""")
def bulk_update_merge(spark, d):
    """Only supplied values change."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    changes = part.where("p_partkey % 3 = 0").select("p_partkey", F.upper("p_brand").alias("p_brand"), F.when(F.col("p_partkey") % 6 == 0, F.col("p_size") + 1).alias("p_size"))
    return C.merge(part, changes, "p_partkey", ["p_brand", "p_size"])


@query("SELECT n_nationkey, n_name, n_nationkey = 7 AS is_active FROM nation")
def exclusive_activation(spark, d):
    """M05."""
    return C.activated(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", 7)


@query("SELECT coalesce(max(n_nationkey), 0) + 1 AS next_version FROM nation")
def next_version(spark, d):
    """D04."""
    return C.next_version(table(spark, d, "nation"), "n_nationkey")


@query("""SELECT a.n_name IS DISTINCT FROM b.n_name AS n_name_changed, a.n_regionkey IS DISTINCT FROM b.n_regionkey AS n_regionkey_changed
FROM nation a, nation b WHERE a.n_nationkey = 8 AND b.n_nationkey = 9""")
def config_diff(spark, d):
    """H66."""
    return C.compared(table(spark, d, "nation"), "n_nationkey", 8, 9, ["n_name", "n_regionkey"])


@query("""WITH i AS (SELECT o_orderkey, o_custkey, CASE WHEN o_totalprice < 20000 THEN 'too small' WHEN o_orderpriority IS NULL THEN 'no priority' END AS reason FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, o_custkey ORDER BY o_orderkey) AS turn FROM i)
SELECT o_orderkey, o_custkey, reason, CASE WHEN reason IS NOT NULL THEN 'invalid' WHEN turn > 1 THEN 'duplicate'
WHEN o_custkey IN (SELECT user_id FROM events) THEN 'existing' ELSE 'created' END AS outcome FROM n""")
def import_reconcile(spark, d):
    """B27 E15 C10 D30 M07."""
    incoming = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    reason = F.when(F.col("o_totalprice") < 20000, "too small").when(F.col("o_orderpriority").isNull(), "no priority")
    known = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    return C.reconciled(incoming, known, "o_custkey", reason, "o_orderkey").select("o_orderkey", "o_custkey", "reason", "outcome")


# ---------------------------------------------------------------- sequences


@query("""SELECT c.event_id, c.user_id, c.ts, v.value AS latest_value FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, value FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_last_view(spark, d):
    """C18."""
    e = table(spark, d, "events")
    clicks, views = e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", "value")
    return S.as_of(clicks, views, "user_id", "ts", "value", "event_id")


@query("""WITH l AS (SELECT doc_id, lines[i] AS line, i - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)),
h AS (SELECT doc_id, line_no, CASE WHEN length(line) < 30 AND NOT line LIKE '%.' THEN line END AS oc, CASE WHEN length(line) < 60 AND line LIKE '%.' THEN line END AS os FROM l),
f AS (SELECT *, last_value(oc IGNORE NULLS) OVER w AS chapter, count(oc) OVER w AS cn, count(coalesce(oc, os)) OVER w AS segment FROM h
      WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, CAST(line_no AS INT) AS line_no, chapter, last_value(os IGNORE NULLS) OVER (PARTITION BY doc_id, cn ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section, segment FROM f""")
def forward_fill_section(spark, d):
    """E03 E05."""
    line = F.col("line")
    short, ends = F.char_length(line), F.endswith(line, F.lit("."))
    filled = S.forward_filled(R.lines(spark, d), "doc_id", "line_no", F.when((short < 30) & ~ends, line), F.when((short < 60) & ends, line))
    return filled.select("doc_id", "line_no", "chapter", "section", "segment")


@query("""SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS r FROM events GROUP BY 1, 2) WHERE r = 1""")
def mode_first_seen(spark, d):
    """D12."""
    return S.mode_first_seen(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY (value < 50), event_id) = 1""")
def keep_first_dedup(spark, d):
    """Preferred rows before fallback rows."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return S.keep_first(e, ["user_id", "event_type"], [F.col("value") < 50, "event_id"])


@query("""SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)) > 1
THEN 'v:' || row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY event_id) ELSE '' END AS suffix FROM events""")
def duplicate_suffix(spark, d):
    """E08."""
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return S.ordinal_suffix(e, ["user_id", "event_type", "day"], "event_id").select("event_id", "suffix")


@query("""SELECT event_id, event_type, value FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS best FROM events) WHERE value >= 90 AND value >= best - 5""")
def relative_window_gate(spark, d):
    """E16."""
    return S.near_best(table(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"], "value", 5.0, 90.0)


@query("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events""")
def rolling_count_6h(spark, d):
    """E18 (plain)."""
    return S.rolling_count(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", F.col("ts"), 6 * 3600).select("event_id", "user_id", "recent")


@query("""SELECT conv_id, turn, role, CAST(count_if(role = 'user') OVER w AS BIGINT) AS user_turns,
CASE WHEN (row_number() OVER w - 1) // 2 = 0 THEN 'initial' WHEN (row_number() OVER w - 1) // 2 >= 3 THEN 'fallback' ELSE 'hint' END AS stage
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def turns_and_stage(spark, d):
    """E14."""
    return S.turns_and_stage(table(spark, d, "conversations").select("conv_id", "turn", "role"))


@query(r"""WITH u AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, arg_min(t, turn) AS t FROM u WHERE t <> '' GROUP BY 1)
SELECT conv_id, coalesce(CASE WHEN length(t) > 22 THEN substr(t, 1, 22) || '...' ELSE t END, 'untitled') AS topic FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id)""")
def topic_first_user(spark, d):
    """E13 H04."""
    return S.first_topic(table(spark, d, "conversations"))


@query("""WITH u AS (SELECT conv_id, trim(text) AS text, max(turn) AS turn FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1, 2),
k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id, substr(string_agg(text, '; ' ORDER BY turn), 1, 500) AS seed FROM k GROUP BY 1""")
def last_n_prompts(spark, d):
    """E11 J06."""
    return S.last_prompts(table(spark, d, "conversations"), 3)


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def last_six_messages(spark, d):
    """E12."""
    return S.last_messages(table(spark, d, "conversations").select("conv_id", "turn", "role", "text"), 6)


@query("""SELECT event_id, user_id, event_type, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) <= 900000000, false) AS replayed FROM events""")
def replay_dedup(spark, d):
    """K10."""
    return S.replays(table(spark, d, "events"), ["user_id", "event_type"], "ts", 900).select("event_id", "user_id", "event_type", "replayed")


@query("""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents),
k AS (SELECT source, regexp_replace(line, '[\\s.·…_-]+', '', 'g') AS key, doc_id FROM l)
SELECT source, key, count(DISTINCT doc_id) AS pages FROM k WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3""".replace("\\\\s", "\\s"))
def boilerplate_lines(spark, d):
    """D13 H25."""
    keyed = R.lines(spark, d).withColumn("key", T.boilerplate_key(F.col("line"))).where("key <> ''")
    return keyed.groupBy("source", "key").agg(F.countDistinct("doc_id").alias("pages")).where("pages >= 3")


# ---------------------------------------------------------------- text


@query("""SELECT doc_id, greatest(1, length(regexp_replace(text, '[^一-鿿]', '', 'g')) + (length(regexp_replace(text, '[一-鿿]', '', 'g')) + 3) // 4) AS tokens FROM documents""")
def token_estimate(spark, d):
    """D20."""
    return table(spark, d, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH b AS (SELECT doc_id, substr(replace(text, chr(10), ' '), i, 2) AS t FROM documents, unnest(range(1, greatest(length(text) - 1, 1) + 1)) r(i))
SELECT doc_id, CAST(CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 128 AS INT) AS bucket, count(*) AS n FROM b GROUP BY 1, 2""")
def hash_tf_buckets(spark, d):
    """H08 H10 D19."""
    return V.hashed_counts(table(spark, d, "documents"))


@query("""WITH b AS (SELECT doc_id, substr(replace(text, chr(10), ' '), i, 2) AS t FROM documents, unnest(range(1, greatest(length(text) - 1, 1) + 1)) r(i)),
c AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(t), 1, 8) AS BIGINT) % 128 AS INT) AS bucket, count(*) AS n FROM b GROUP BY 1, 2)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""")
def hash_embedding_norm(spark, d):
    """H50 J01."""
    return V.hashed_embedding(table(spark, d, "documents"))


QUALITY = """CASE WHEN length(text) > 0 THEN round(length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) / length(text) + 0.2 * (length(regexp_replace(text, '[^ \n]', '', 'g')) / length(text))
- 2.0 * (length(regexp_replace(text, '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')) / length(text)) + least(length(text) / 2000, 1.0) * 0.5, 6) ELSE 0.0 END"""


@query(f"SELECT doc_id, {QUALITY} AS score FROM documents")
def text_quality_score(spark, d):
    """D26 B22."""
    return table(spark, d, "documents").select("doc_id", T.quality(F.col("text")).alias("score"))


@query("""SELECT conv_id, turn, list_filter([CASE WHEN regexp_matches(lower(text), '\\bthe\\b') THEN 'article' END, CASE WHEN regexp_matches(lower(text), 'ing\\b') THEN 'gerund' END,
CASE WHEN regexp_matches(lower(text), '[?!]') THEN 'mark' END], lambda x: x IS NOT NULL) AS flags FROM conversations""")
def policy_flags(spark, d):
    """Ordered rules as an array of names."""
    rules = [("article", r"\bthe\b"), ("gerund", r"ing\b"), ("mark", "[?!]")]
    return table(spark, d, "conversations").select("conv_id", "turn", T.flags(F.lower("text"), rules).alias("flags"))


@query("""SELECT doc_id, regexp_replace(lower(source || ' ' || lang || ' (A-1): B_2'), '[\\s\\-_.,:;()\\[\\]<>]', '', 'g') AS key FROM documents""")
def normalize_key(spark, d):
    """H05."""
    return table(spark, d, "documents").select("doc_id", T.structure_key(F.concat_ws(" ", "source", "lang", F.lit("(A-1): B_2"))).alias("key"))


@query(r"""WITH s AS (SELECT page_id, html AS t FROM pages),
a AS (SELECT page_id, regexp_replace(t, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g') AS t FROM s),
b AS (SELECT page_id, regexp_replace(t, '(?s)<!--.*?-->', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '(?i)</t[dh]>\s*<t[dh][^>]*>', ' | ', 'g') AS t FROM b),
e AS (SELECT page_id, regexp_replace(t, '(?i)</?(p|div|br|li|ul|tr|table|h[1-6]|article|nav|header|footer|section|title)[^>]*>', chr(10), 'g') AS t FROM c),
f AS (SELECT page_id, regexp_replace(regexp_replace(t, '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g') AS t FROM e)
SELECT page_id, trim(regexp_replace(t, ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM f""")
def html_to_text(spark, d):
    """H17 H18."""
    return table(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("""WITH p AS (SELECT p_partkey, list_filter(list_transform(string_split_regex(p_name || ',' || p_type || ',' || upper(p_name), '[,，\n]'), lambda t: substr(trim(t), 1, 32)), lambda t: t <> '') AS parts FROM part),
u AS (SELECT p_partkey, parts[i] AS t, i, row_number() OVER (PARTITION BY p_partkey, lower(parts[i]) ORDER BY i) AS r FROM p, unnest(range(1, len(parts) + 1)) x(i))
SELECT p_partkey, list_slice(list(t ORDER BY i), 1, 20) AS tags FROM u WHERE r = 1 GROUP BY 1""")
def tag_normalize(spark, d):
    """H26 G02."""
    return table(spark, d, "part").select("p_partkey", T.tag_list(F.concat_ws(",", "p_name", "p_type", F.upper("p_name"))).alias("tags"))


@query("""WITH g AS (SELECT c_custkey, CAST(c_custkey % 3 + 1 AS INT) AS grade, CAST(2021 + c_custkey % 4 AS INT) AS y FROM customer)
SELECT c_custkey, grade, CASE WHEN grade + greatest(2024 - y, 0) <= 3 THEN grade + greatest(2024 - y, 0) END AS new_grade FROM g""")
def grade_promotion(spark, d):
    """H45 H46 M08."""
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3 + 1).cast("int").alias("grade"), (2021 + F.col("c_custkey") % 4).cast("int").alias("year"))
    return rows.select("c_custkey", "grade", T.promoted(F.col("grade"), F.col("year"), F.lit("2024-08-15").cast("date")).alias("new_grade"))


# ---------------------------------------------------------------- vectors


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM embeddings, q)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 10""")
def knn_exact(spark, d):
    """Every twentieth vector asks, all are searched."""
    queries, vectors = _asked(spark, d)
    return V.nearest(queries, vectors, 10)


def _asked(spark, d):
    vectors = table(spark, d, "embeddings").withColumnRenamed("embedding", "v")
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("label").alias("own")), vectors


@query("""WITH q AS (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM embeddings JOIN q USING (label))
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 4""")
def knn_by_subject(spark, d):
    """Nearest of the query's own label."""
    queries, vectors = _asked(spark, d)
    return V.nearest(queries.withColumnRenamed("own", "label"), vectors, 4, own=["label"]).select("query_id", "vec_id", "score", "rank")


@query("""WITH q AS (SELECT vec_id AS query_id, label AS ql, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, ql, vec_id, label, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM embeddings, q),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 16),
f AS (SELECT *, round(greatest(0, 1.1 - (1 - score)) + greatest(0, 0.12 - 0.01 * (rank - 1)) + CASE WHEN ql = label THEN 0.34 ELSE -0.1 END, 6) AS final FROM h),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, rank) AS INT) AS place FROM f)
SELECT query_id, vec_id, final, place FROM p WHERE place <= 4 AND vec_id % 7 <> 0""")
def hybrid_rerank(spark, d):
    """Ids divisible by seven stand for disabled rows."""
    queries, vectors = _asked(spark, d)
    hits = V.nearest(queries, vectors, 16).join(vectors.select("vec_id", "label"), "vec_id").join(queries.select("query_id", "own"), "query_id")
    return V.reranked(hits, F.when(F.col("own") == F.col("label"), 0.34).otherwise(-0.1), 4, F.col("vec_id") % 7 == 0).select("query_id", "vec_id", "final", "place")


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, label, round(list_inner_product(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score, CASE WHEN label % 2 = 0 THEN 1 ELSE 2 END AS tier FROM embeddings, q),
k AS (SELECT * FROM s WHERE tier = 1 UNION ALL SELECT * FROM s WHERE tier = 2 AND NOT EXISTS (SELECT 1 FROM embeddings AS o WHERE o.label % 2 = 0 AND o.label = s.label)),
b AS (SELECT *, max(score) OVER (PARTITION BY query_id, tier) AS best FROM k),
g AS (SELECT * FROM b WHERE (tier = 1 AND score >= 0.1 AND score >= best - 0.7) OR (tier = 2 AND score >= 0.15 AND score >= best - 0.1))
SELECT query_id, vec_id, score, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, vec_id) AS INT) AS place FROM g QUALIFY place <= 5""")
def recommend_two_tier(spark, d):
    """Even labels are preferred."""
    queries, vectors = _asked(spark, d)
    return V.recommended(queries, vectors, F.col("label") % 2 == 0, "label", ((0.1, 0.7), (0.15, 0.1)), 5).select("query_id", "vec_id", "score", "tier", "place")
