"""Queries of the document operators and the stateful folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrystone.functions import metadata as M
from quarrystone.operators import documents as D
from quarrystone.operators import lifecycle as Y
from quarrystone.plans.catalogue import ORACLES, QUERIES, query
from quarrystone.sources.tables import table
from quarrystone.streaming import folds as L

__all__ = ["ORACLES", "QUERIES"]


@query()
def chunk_documents(spark, d):
    """No SQL; tests hold the invariants."""
    return D.chunked(table(spark, d, "documents"))


def exams(spark, d):
    """Parts as small exam papers."""
    paper = F.format_string("Part one\n1. What is %s?\n2. Which brand?\nred or blue\n3. What size?\nAnswers\n1. %s\n2. %s\nExplanations\n2. see %s", "p_name", "p_type", "p_brand", "p_type")
    again = F.format_string("\nPart two\n1. How big is it?\nAnswers\n1. %d", "p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 2 == 0, F.concat(paper, again)).otherwise(paper).alias("text"))


@query("""
SELECT p_partkey AS doc_id, CAST(0 AS INT) AS group_no, CAST(1 AS INT) AS number, 'What is ' || p_name || '?' AS question, p_type AS answer, CAST(NULL AS VARCHAR) AS explanation, CASE WHEN p_partkey % 2 = 0 THEN 'v:1' ELSE '' END AS suffix FROM part
UNION ALL SELECT p_partkey, 0, 2, 'Which brand?' || chr(10) || 'red or blue', p_brand, 'see ' || p_type, '' FROM part
UNION ALL SELECT p_partkey, 0, 3, 'What size?', NULL, NULL, '' FROM part
UNION ALL SELECT p_partkey, 1, 1, 'How big is it?', CAST(p_size AS VARCHAR), NULL, 'v:2' FROM part WHERE p_partkey % 2 = 0""")
def question_slices(spark, d):
    """I06 E05 C11 E08 D25."""
    return D.question_slices(exams(spark, d))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 2 = 0 THEN 4 ELSE 3 END::BIGINT AS questions, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS answers,
1::BIGINT AS explanations, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS repeated, CASE WHEN p_partkey % 2 = 0 THEN 'repeated_numbers' ELSE 'partial' END AS class FROM part""")
def slice_audit(spark, d):
    """I14 D14 D15."""
    return D.slice_audit(D.question_slices(exams(spark, d)))


@query(r"""
WITH l AS (SELECT source, doc_id, i AS line_no, lines[i] AS line, i IN (1, len(lines)) AS may FROM (SELECT source, doc_id, string_split(text, chr(10)) AS lines FROM documents), unnest(range(1, len(lines) + 1)) t(i)),
k AS (SELECT *, regexp_replace(line, '[\s.·…_-]+', '', 'g') AS key FROM l),
p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY 1),
r AS (SELECT source, key FROM k JOIN p USING (source) WHERE may AND key <> '' GROUP BY source, key, pages
      HAVING count(DISTINCT doc_id) >= CASE WHEN pages <= 3 THEN greatest(2, pages) ELSE greatest(3, (pages + 1) // 2) END)
SELECT doc_id, count(*) AS n FROM k WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.source = k.source AND r.key = k.key) GROUP BY 1""")
def running_lines_removed(spark, d):
    """Documents as pages of their source, first and last lines as candidates."""
    split = F.split("text", "\n")
    lines = table(spark, d, "documents").select("source", "doc_id", F.size(split).alias("n_lines"), F.posexplode(split).alias("at", "line"))
    edge = (F.col("at") == 0) | (F.col("at") == F.col("n_lines") - 1)
    return D.without_running_lines(lines, "source", "doc_id", "line", edge, F.lit(False)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT p_partkey, lower(p_name) || '讲义' || lower(p_type) AS w FROM part),
tags AS (SELECT DISTINCT lower(trim(tag)) AS tag FROM (SELECT p_type AS tag FROM part WHERE p_size < 5 UNION ALL SELECT string_split(p_type, ' ')[1] FROM part
  UNION ALL SELECT p_name || '讲义' || p_type FROM part WHERE p_size = 7 UNION ALL SELECT unnest(['讲义', '义', 'ing', 'l ring讲', '']))),
h AS (SELECT p_partkey, tag FROM t JOIN tags ON tag <> '' AND contains(w, tag))
SELECT p_partkey AS title_id, list(tag ORDER BY length(tag) DESC, tag) AS tags FROM h
WHERE NOT EXISTS (SELECT 1 FROM h AS o WHERE o.p_partkey = h.p_partkey AND o.tag <> h.tag AND contains(o.tag, h.tag)) GROUP BY 1""")
def contains_longest_first(spark, d):
    """C15 F10 J07."""
    part = table(spark, d, "part")
    title = F.concat("p_name", F.lit("讲义"), "p_type")
    tags = part.where("p_size < 5").select(F.col("p_type").alias("tag")).unionByName(part.select(F.split("p_type", " ")[0].alias("tag"))).unionByName(part.where("p_size = 7").select(title.alias("tag")))
    some = part.limit(1).select(F.explode(F.array(*map(F.lit, ("讲义", "义", "ing", "l ring讲", "")))).alias("tag"))
    return D.contained_tags(part.select(F.col("p_partkey").alias("title_id"), title.alias("title")), tags.unionByName(some))


@query()
def similar_titles(spark, d):
    """customers' segments against nations; tests compare with plain pairs."""
    titles = table(spark, d, "supplier").select(F.col("s_suppkey").alias("title_id"), F.concat(F.lit("nation "), F.col("s_nationkey")).alias("title"))
    labels = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("label_id"), F.col("n_name").alias("label"))
    return D.similar_titles(titles, labels)


@query("""
WITH p AS (SELECT DISTINCT o_orderpriority AS doc_id, CAST(o_orderkey % 97 AS INT) AS page FROM orders),
e AS (SELECT * FROM (VALUES ('chapter', 'A', 3), ('section', 'A1', 5), ('chapter', 'B', 40), ('section', 'B1', 60)) AS t(kind, title, page))
SELECT doc_id, page, (SELECT arg_max(title, e.page) FROM e WHERE kind = 'chapter' AND e.page <= p.page) AS chapter,
CASE WHEN page >= 60 THEN 'B1' WHEN page >= 40 THEN NULL WHEN page >= 5 THEN 'A1' END AS section FROM p""")
def contents_page_context(spark, d):
    """Printed pages are two less than real ones."""
    pages = table(spark, d, "orders").select(F.col("o_orderpriority").alias("doc_id"), (F.col("o_orderkey") % 97).cast("int").alias("page")).distinct()
    docs = pages.select("doc_id").distinct()
    rows = [("chapter", "A", 1), ("section", "A1", 3), ("chapter", "B", 38), ("section", "B1", 58)]
    entry = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("title"), F.lit(p).alias("printed")) for k, t, p in rows])).alias("e")
    entries = docs.select("doc_id", entry).select("doc_id", "e.*")
    headings = entries.where("kind = 'chapter'").select("doc_id", "title", (F.col("printed") + 2).alias("page"))
    return D.page_context(pages, entries, D.page_offset(entries, headings))


def _stamped(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type"), "value")


#: Events of each user in order, as the stateful oracles step through them.
STEPS = """WITH RECURSIVE e AS (SELECT user_id AS key, event_id AS seq, epoch_us(ts) AS moment, event_type, event_type <> 'error' AS ok, CAST(trunc(value) AS BIGINT) AS amount,
row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), """


@query(STEPS + """r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS taken, false AS admitted FROM e
UNION ALL SELECT key, seq, n, CASE WHEN len(recent) < 2 THEN list_append(recent, moment) ELSE recent END, len(recent) < 2
FROM (SELECT e.*, list_filter(r.taken, lambda t: e.moment - t <= 21600000000) AS recent FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1))
SELECT key, seq, admitted FROM r WHERE n > 0""")
def rate_limit_admission(spark, d):
    """Two of any six hours; tests compare with plain Python too."""
    return L.fold_table(_stamped(spark, d), "key", ["at", "seq"], L.rate_limit(2, 6 * 3600))


@query(STEPS + """r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS tries, 0 AS failed, CAST(0 AS BIGINT) AS until, '' AS outcome FROM e
UNION ALL SELECT key, seq, n, CASE WHEN made THEN list_append(recent, moment) ELSE recent END, CASE WHEN made AND (ok OR failed >= 1) THEN 0 WHEN made THEN failed + 1 ELSE failed END,
CASE WHEN made AND NOT ok AND failed >= 1 THEN moment + 86400000000 ELSE until END, CASE WHEN moment < until THEN 'locked' WHEN NOT made THEN 'throttled' WHEN ok THEN 'passed' ELSE 'failed' END
FROM (SELECT *, moment >= until AND len(recent) < 3 AS made FROM (SELECT e.*, r.failed, r.until, list_filter(r.tries, lambda t: e.moment - t < 21600000000) AS recent FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)))
SELECT key, seq, outcome FROM r WHERE n > 0""")
def login_throttling(spark, d):
    """K17."""
    return L.fold_table(_stamped(spark, d).withColumn("ok", F.col("event_type") != "error"), "key", ["at", "seq"], L.login_throttle(3, 6 * 3600, 2, 24 * 3600))


@query(STEPS + """r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, 0 AS failed, CAST(0 AS BIGINT) AS until, false AS open FROM e
UNION ALL SELECT e.key, e.seq, e.n, CASE WHEN e.moment < r.until THEN r.failed WHEN ok OR r.failed >= 1 THEN 0 ELSE r.failed + 1 END,
CASE WHEN e.moment >= r.until AND NOT ok AND r.failed >= 1 THEN e.moment + 86400000000 ELSE r.until END, e.moment < r.until FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)
SELECT key, seq, open FROM r WHERE n > 0""")
def circuit_breaking(spark, d):
    """K13."""
    return L.fold_table(_stamped(spark, d).withColumn("ok", F.col("event_type") != "error"), "key", ["at", "seq"], L.circuit_breaker(2, 24 * 3600))


@query(STEPS + """r AS (SELECT DISTINCT key, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([0, 0, 0] AS BIGINT[]) AS held, ['', '', ''] AS states, false AS denied, CAST(0 AS BIGINT) AS given FROM e
UNION ALL SELECT key, seq, n, used, [CASE WHEN own = 1 THEN now ELSE held[1] END, CASE WHEN own = 2 THEN now ELSE held[2] END, CASE WHEN own = 3 THEN now ELSE held[3] END],
[CASE WHEN own = 1 THEN state ELSE states[1] END, CASE WHEN own = 2 THEN state ELSE states[2] END, CASE WHEN own = 3 THEN state ELSE states[3] END], denied, CASE WHEN state = '' OR denied THEN 0 ELSE now END
FROM (SELECT key, seq, n, own, held, states, denied, CASE WHEN takes AND NOT denied THEN used + amount WHEN gives THEN greatest(0, used + to_now - held[own]) ELSE used END AS used,
  CASE WHEN takes AND NOT denied THEN amount WHEN gives THEN to_now ELSE held[own] END AS now, CASE WHEN takes AND NOT denied THEN 'held' WHEN gives AND op = 'error' THEN 'released' WHEN gives THEN 'settled' ELSE states[own] END AS state
  FROM (SELECT *, takes AND used + amount > 200 AS denied FROM (SELECT *, op NOT IN ('purchase', 'error') AND states[own] IN ('', 'released') AS takes, op IN ('purchase', 'error') AND states[own] = 'held' AS gives, CASE WHEN op = 'error' THEN 0 ELSE amount END AS to_now
    FROM (SELECT e.key, e.seq, e.n, e.amount, e.event_type AS op, e.seq % 3 + 1 AS own, r.used, r.held, r.states FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)))))
SELECT CAST(key AS VARCHAR) AS key, seq, NOT denied AS allowed, CASE WHEN denied THEN 'user' || key END AS denied_by, given AS amount, used FROM r WHERE n > 0""")
def quota_reserve_sequential(spark, d):
    """Views reserve, purchases reconcile, errors release."""
    op = F.when(F.col("event_type") == "purchase", "reconcile").when(F.col("event_type") == "error", "release").otherwise("reserve")
    counters = F.array(F.struct(F.concat(F.lit("user"), F.col("key")).alias("name"), F.lit(200).cast("long").alias("limit")))
    rows = _stamped(spark, d).select(F.col("key").cast("string").alias("key"), "seq", "at", op.alias("op"), F.concat("key", F.lit("-"), (F.col("seq") % 3)).alias("reservation"), counters.alias("counters"), F.col("value").cast("long").alias("amount"))
    return L.fold_table(rows, "key", ["at", "seq"], L.quota())


@query("""SELECT l_returnflag AS model, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS used, CAST(greatest(5000 - sum(l_quantity), 0) AS BIGINT) AS remaining,
CASE WHEN sum(l_quantity) >= 5000 THEN 'day limit' END AS denial FROM lineitem GROUP BY 1, 2""")
def quota_remaining(spark, d):
    """D24 K09."""
    used = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), F.col("l_shipdate").cast("date").alias("day")).agg(F.sum("l_quantity").cast("long").alias("used"))
    return used.select("model", "day", "used", F.greatest(5000 - F.col("used"), F.lit(0)).cast("long").alias("remaining"), F.when(F.col("used") >= 5000, "day limit").alias("denial"))


def cut_in_pieces(turns, size=7):
    """Turns as streams of pieces of so many characters."""
    # In one pass: a place in a string is only found by reading it from its start.
    pieces = F.when(F.char_length("text") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array("text"))
    cut = turns.select(F.concat_ws("-", "conv_id", "turn").alias("key"), pieces.alias("pieces")).select("key", F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "piece"))
    return cut.select("key", F.col("seq").cast("long").alias("seq"), "piece", (F.col("seq") == F.col("n") - 1).alias("done"))


def _pieces(spark, d):
    return cut_in_pieces(table(spark, d, "conversations"))


@query()
def token_segments(spark, d):
    """K01."""
    return L.fold_table(_pieces(spark, d), "key", ["seq"], L.segments())


@query("""SELECT conv_id || '-' || turn AS key, CASE WHEN turn % 3 = 0 THEN replace(text, 'e', '') WHEN turn % 3 = 1 THEN regexp_replace(text, 'a.*', '', 's') ELSE text END AS shown FROM conversations
WHERE CASE WHEN turn % 3 = 0 THEN replace(text, 'e', '') WHEN turn % 3 = 1 THEN regexp_replace(text, 'a.*', '', 's') ELSE text END <> ''""")
def hidden_spans_removed(spark, d):
    """Each e of a third of the turns is dressed as a span, the first a of another third opens one without an end, the others have none."""
    turns = table(spark, d, "conversations")
    dressed = F.when(F.col("turn") % 3 == 0, F.replace("text", F.lit("e"), F.lit("<think>a < b </thin</think>"))).when(F.col("turn") % 3 == 1, F.regexp_replace("text", "(?s)^([^a]*)a", "$1<think>a")).otherwise(F.col("text"))
    shown = L.fold_table(cut_in_pieces(turns.withColumn("text", dressed)), "key", ["seq"], L.hidden_spans())
    return shown.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shown"))), lambda s: s["shown"]), "").alias("shown"))


@query(STEPS + """s AS (SELECT key, event_type, seq, moment, seq % 4 AS hash, row_number() OVER (PARTITION BY key, event_type ORDER BY moment, seq) AS n FROM e),
r AS (SELECT key, event_type, seq, n, moment AS since, hash, 'first' AS outcome FROM s WHERE n = 1
UNION ALL SELECT s.key, s.event_type, s.seq, s.n, CASE WHEN s.moment - since > 172800000000 THEN s.moment ELSE since END, CASE WHEN s.moment - since > 172800000000 THEN s.hash ELSE r.hash END,
CASE WHEN s.moment - since > 172800000000 THEN 'first' WHEN s.hash = r.hash THEN 'replay' ELSE 'conflict' END FROM r JOIN s ON s.key = r.key AND s.event_type = r.event_type AND s.n = r.n + 1)
SELECT key, seq, event_type, outcome FROM r""")
def request_replays(spark, d):
    """Two days of lifetime, four bodies: first answers, replays, conflicts and expiry."""
    rows = _stamped(spark, d).select(F.concat_ws("|", "key", "event_type").alias("key"), "seq", "at", (F.col("seq") % 4).cast("string").alias("hash"))
    out = L.fold_table(rows, "key", ["at", "seq"], L.replay(2 * 24 * 3600))
    split = F.split("key", "[|]")
    return out.select("seq", split[0].cast("long").alias("key"), split[1].alias("event_type"), "outcome")


# ---------------------------------------------------------------- lifecycle and metadata


@query("""WITH n AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_linenumber <= 2), old AS (SELECT * FROM n WHERE l_linenumber = 1),
new AS (SELECT * FROM n WHERE l_linenumber = 2 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) = 1)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE l_partkey NOT IN (SELECT l_partkey FROM old)""")
def idempotent_insert(spark, d):
    """Second lines come in where no first line has their part."""
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return Y.inserted_once(items.where("l_linenumber = 1"), items.where("l_linenumber = 2"), "l_partkey", "l_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, d):
    """Lines of orders that stay."""
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return Y.without_children(table(spark, d, "lineitem"), gone, "l_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def orphan_repair(spark, d):
    """Open orders without a returned line fail."""
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Y.repaired(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", "o_orderstatus", "O", "X")


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 50 AS lane, o_orderdate, CASE WHEN o_totalprice > 300000 AND o_custkey % 50 < 10 THEN 'running' WHEN o_orderstatus = 'O' THEN 'waiting' ELSE 'done' END AS status FROM orders)
SELECT o_orderkey, lane FROM t WHERE status = 'waiting' AND lane NOT IN (SELECT lane FROM t WHERE status = 'running')
QUALIFY row_number() OVER (PARTITION BY lane ORDER BY o_orderdate, o_orderkey) = 1""")
def queue_heads(spark, d):
    """One task at a time in each lane."""
    status = F.when((F.col("o_totalprice") > 300000) & (F.col("o_custkey") % 50 < 10), "running").when(F.col("o_orderstatus") == "O", "waiting").otherwise("done")
    tasks = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("lane"), "o_orderdate", status.alias("status"))
    return Y.queue_heads(tasks, "lane", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "lane")


@query("SELECT o_orderkey, TIMESTAMP '1998-08-02 00:00:30' - o_orderdate >= INTERVAL 3000 SECOND AS stale FROM orders")
def stale_tasks(spark, d):
    """B24."""
    return table(spark, d, "orders").select("o_orderkey", Y.stale(F.col("o_orderdate"), F.lit("1998-08-02 00:00:30").cast("timestamp_ntz"), 300.0).alias("stale"))


@query("""SELECT p_partkey AS model_id, s_suppkey AS account_id, p_size AS rank, p_partkey % 40 = 0 AS is_primary, p_retailprice AS daily,
CAST(row_number() OVER (ORDER BY p_partkey % 40 = 0 DESC, p_size, p_partkey) AS INT) AS place
FROM part JOIN supplier ON s_suppkey = p_partkey % 7 LEFT JOIN (SELECT p_partkey AS m, p_retailprice FROM part WHERE p_size > 25) ON m = p_partkey WHERE s_acctbal > 0""".replace("p_retailprice AS daily", "x.p_retailprice AS daily").replace("ON m = p_partkey", "AS x ON m = p_partkey"))
def model_fallbacks(spark, d):
    """Parts as models, suppliers as accounts; a ranking of the whole list, which is a catalogue's size."""
    part = table(spark, d, "part")
    models = part.select(F.col("p_partkey").alias("model_id"), (F.col("p_partkey") % 7).alias("account_id"), F.col("p_size").alias("rank"), (F.col("p_partkey") % 40 == 0).alias("is_primary"))
    policies = part.where("p_size > 25").select(F.col("p_partkey").alias("model_id"), F.col("p_retailprice").alias("daily"))
    accounts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("account_id"), (F.col("s_acctbal") > 0).alias("enabled"))
    return Y.fallbacks(models, policies, accounts)


@query("SELECT o_orderkey, isoyear(o_orderdate) || '-W' || weekofyear(o_orderdate) AS week FROM orders")
def iso_week_keys(spark, d):
    """H47."""
    return table(spark, d, "orders").select("o_orderkey", M.week_key(F.col("o_orderdate")).alias("week"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS prompt, CAST(event_id % 5 AS BIGINT) AS completion,
CAST(CASE WHEN event_id % 2 = 0 THEN 7 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) + event_id % 5 END AS BIGINT) AS total FROM events""")
def usage_reports(spark, d):
    """H70."""
    k, e = F.get_json_object("props", "$.k"), F.col("event_id")
    report = F.when(e % 2 == 0, F.format_string('{"prompt_tokens":%s,"completion_tokens":%d,"total_tokens":7}', k, e % 5)).otherwise(F.format_string('{"input_tokens":%s,"output_tokens":%d}', k, e % 5))
    return table(spark, d, "events").select("event_id", M.usage_tokens(report).alias("u")).select("event_id", "u.*")


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN '{"retrieval":{"chapter":"' || p_brand || '","section":"' || p_type || '"},"ingestion":{"size":' || p_size || '}}'
ELSE '{"retrieval":{"chapter":"' || p_brand || '"}}' END AS metadata FROM part""")
def metadata_layers(spark, d):
    """Nulls and empty layers are left out."""
    big = F.col("p_size") > 25
    layers = {"retrieval": {"chapter": F.col("p_brand"), "section": F.when(big, F.col("p_type")).otherwise("")}, "ingestion": {"size": F.when(big, F.col("p_size"))}}
    return table(spark, d, "part").select("p_partkey", M.layered(layers).alias("metadata"))


@query("SELECT c_custkey, c_name AS title, CASE WHEN length(c_name) >= 2 THEN [substr(c_name, 1, 32)] ELSE [] END AS tags FROM customer")
def title_cleaning(spark, d):
    """Names dressed as files lose their dress."""
    file = F.concat(F.lit("第三章 "), "c_name", F.lit("_v2 (1).pdf"))
    return table(spark, d, "customer").select("c_custkey", M.clean_title(file).alias("title")).select("c_custkey", "title", M.title_tags(F.col("title")).alias("tags"))


@query("""SELECT 'd:' || p_partkey || '/g:' || p_size || '/q:1' || CASE WHEN p_size % 2 = 0 THEN '/v:1' ELSE '' END AS locator, list_filter([CASE WHEN p_size % 3 = 0 THEN 'missing_required_image' END, CASE WHEN p_size % 5 = 0 THEN 'answer_pairing_suspected' END], lambda x: x IS NOT NULL) AS flags FROM part""")
def question_metadata(spark, d):
    """H68 H69."""
    size = F.col("p_size")
    where = M.locator(F.col("p_partkey"), size, F.lit(1), F.when(size % 2 == 0, "v:1").otherwise(""))
    found = M.question_flags(F.col("p_name"), F.when(size % 5 == 0, "").otherwise("x"), F.when(size % 3 == 0, 0).otherwise(1), F.lit(True))
    return table(spark, d, "part").select(where.alias("locator"), found.alias("flags"))
